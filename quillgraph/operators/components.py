"""Connected components over memberships (node, key): nodes that share a key belong together."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.runtime import cut_lineage, forget

HOT_SHARE, HOT_ROWS = 1_000, 100_000


def give_back(rows: DataFrame, per_key: DataFrame, on: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows joined with per_key, one row per key, where ``n`` counts the rows that hold the key; drops ``n``.

    A key with a thousandth of all rows and at least ``hot_rows`` is hot: at most a thousand of them, which are broadcast. The rows
    of the others are shuffled, and each of their keys is a small group; results do not depend on where the line is.
    """
    total = per_key.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    slim = per_key.drop("n")
    if total["most"] is None or total["most"] < hot_rows:
        return rows.join(slim, on)
    is_hot = (F.col("n") * HOT_SHARE >= total["total"]) & (F.col("n") >= hot_rows)
    names = [c for c in slim.columns if c != on]
    marked = rows.join(F.broadcast(per_key.filter(is_hot).drop("n").withColumn("_hot", F.lit(True))), on, "left")
    found = marked.filter("_hot").drop("_hot")
    rest = marked.filter("_hot is null").drop("_hot", *names).join(per_key.filter(~is_hot).drop("n"), on)
    return found.unionByName(rest)


def components(nodes: DataFrame, memberships: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """nodes(id), memberships(id, key) -> (id, component), the smallest id of each component.

    A shared key is never turned into pairs of its members. Each round every node points to the smallest node it shares a key with,
    and that node's pointer is followed once more; then the graph is contracted: pointers replace nodes, repeated memberships fall
    together, and keys with one node left are settled and go. At least half of the nodes that still share a key vanish in a round,
    so later rounds are small, and where keys do not overlap one round is all. Names of vanished nodes are resolved at the end, from
    the last round to the first. Rounds are written to the shared folder, so that a lost executor costs a file read.
    """
    scratch: list[str] = []

    def kept(df: DataFrame, label: str) -> DataFrame:
        out, path = cut_lineage(df, label)
        scratch.append(path)
        return out
    links = kept(memberships.select("id", "key").distinct(), "links")
    steps: list[DataFrame] = []
    while True:
        keys = kept(links.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"))
                    .filter("least <> most").drop("most"), "keys")
        if keys.isEmpty():
            break
        linked = kept(give_back(links, keys, "key", hot_rows), "linked")
        near = kept(linked.groupBy("id").agg(F.min("least").alias("up"), F.count("*").alias("n")), "near")
        further = near.select(F.col("id").alias("up"), F.col("up").alias("_up"))
        step = kept(near.join(further, "up").select("id", F.least("up", "_up").alias("up"), "n"), "step")
        steps.append(step.drop("n"))
        links = kept(give_back(linked.select("id", "key"), step, "id", hot_rows).select(F.col("up").alias("id"), "key").distinct(), "links")
    if not steps:
        return nodes.select("id", F.col("id").alias("component"))
    labels = steps[-1].withColumnRenamed("up", "component")
    for step in reversed(steps[:-1]):
        known = labels.withColumnRenamed("id", "up")
        labels = step.join(known, "up", "left").select("id", F.coalesce("component", "up").alias("component"))
    labels = cut_lineage(labels, "labels")[0]
    for path in scratch:
        forget(nodes.sparkSession, path)
    return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
