"""Entity resolution: candidate identities, dependency groups, decisions, canonical entities and relations.

Mentions are judged in order of (position, entity_key) inside their corpus against the identities settled so far. Identities never
leave a name: shared spans spell the same name and candidates share it. So the entities of one name of one corpus are dealt to one
place, sorted there and streamed: what is known of the name so far is, per identity, where it was mentioned last, and the mentions
that still lie ahead, which reach no further than a window. Nothing is paired, no group is held, and no rounds are needed.

Entities: corpus_id, entity_key, type, name, folded, position, spans (array of structs with start_char,
end_char, section_order, chunk_id, quote).
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.runtime import stage
from quillgraph.functions.udfs import with_folded
from quillgraph.operators.components import components, give_back
from quillgraph.operators.ontology import is_generic, is_symmetric

TOP = 5


def entity_table(valid_entities: DataFrame) -> DataFrame:
    rows = valid_entities.filter("valid").select(
        "corpus_id", "unit_id", "local_id", F.concat_ws("|", "unit_id", "local_id").alias("entity_key"), "type", "name",
        F.array_min(F.transform("spans", lambda s: s["start_char"])).alias("position"), "spans")
    return with_folded(rows, "name", "folded")


class _Name:
    """The identities of one name, in the order of the text. An identity is the (position, key) of its first entity."""

    def __init__(self, generic: bool):
        self.generic = generic
        self.behind: dict[tuple, int] = {}  # identity -> start of its last mention passed, latest identity last
        self.ahead: dict[tuple, tuple] = {}  # span not yet passed -> identity
        self.count = 0

    def advance(self, position: int) -> None:
        """Spans that begin before ``position`` cannot be shared any more; their starts stay with the identity."""
        for span in sorted(s for s in self.ahead if s[0] < position):
            identity = self.ahead.pop(span)
            self.behind.pop(identity, None)
            self.behind[identity] = span[0]

    def _distances(self, position: int) -> dict[tuple, int]:
        """Distance of the nearest mention per identity: all that have one ahead, and of the others the nearest that may be offered."""
        found: dict[tuple, int] = {}
        for (start, _), identity in self.ahead.items():
            passed = position - self.behind[identity] if identity in self.behind else start - position
            found[identity] = min(found.get(identity, passed), start - position, passed)
        last, n = None, 0
        for identity in reversed(self.behind):
            distance = position - self.behind[identity]
            if n >= TOP and distance > last:
                break
            n, last = n + 1, distance
            found[identity] = min(found.get(identity, distance), distance)
        return found

    def judge(self, position: int, key: str, spans: list[tuple], decision: str | None, wanted: str | None, cited: bool) -> dict:
        self.advance(position)
        shared = sorted({self.ahead[s] for s in spans if s in self.ahead})
        known, total = self._distances(position), self.count
        if self.generic:
            known, total = {i: known[i] for i in shared}, len(shared)
        offered = sorted(known, key=lambda i: (i not in shared, known[i], i))[:TOP]
        named = {i[1]: i for i in offered}
        if shared:
            outcome, into = "shared_span", shared[0]
        elif not offered:
            outcome, into = "new", None
        elif decision == "merge" and cited and wanted in named:
            outcome, into = "merged", named[wanted]
        elif decision == "new" and cited:
            outcome, into = "kept_apart", None
        elif total == 1:
            outcome, into = "same_name_reused", offered[0]
        else:
            outcome, into = "ambiguous", None
        identity = into or (position, key)
        self.count += (into is None) - len(shared[1:])
        for other in shared[1:]:  # one span too many: they were one identity all along
            self.ahead = {s: identity if i == other else i for s, i in self.ahead.items()}
            if other in self.behind:
                self.behind[identity] = max(self.behind.pop(other), self.behind.get(identity, 0))
        if shared[1:]:
            self.behind = dict(sorted(self.behind.items(), key=lambda item: item[1]))
        self.ahead.update(dict.fromkeys(spans, identity))
        return {"outcome": outcome, "joins": into and into[1], "identity": {"position": identity[0], "entity_key": identity[1]},
                "absorbed": [{"position": i[0], "entity_key": i[1]} for i in shared[1:]], "n_candidates": total,
                "offered": [{"candidate_key": i[1], "shared": i in shared, "distance": known[i]} for i in offered]}


_IDENTITY = "struct<position:bigint,entity_key:string>"
_JUDGED = f"entity_key string, outcome string, joins string, identity {_IDENTITY}, absorbed array<{_IDENTITY}>, n_candidates bigint, offered array<struct<candidate_key:string,shared:boolean,distance:bigint>>"


def _judge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by name group and order to their outcomes; one group's state at a time."""
    group, names = None, None
    identity = pa.struct([("position", pa.int64()), ("entity_key", pa.string())])
    offer = pa.struct([("candidate_key", pa.string()), ("shared", pa.bool_()), ("distance", pa.int64())])
    for batch in batches:
        schema = pa.schema([batch.schema.field("corpus_id"), ("entity_key", pa.string()), ("outcome", pa.string()), ("joins", pa.string()), ("identity", identity),
                            ("absorbed", pa.list_(identity)), ("n_candidates", pa.int64()), ("offered", pa.list_(offer))])
        out = []
        for r in batch.to_pylist():
            own = (r["corpus_id"], r["type"], r["folded"], r["generic"])
            if own != group:
                group, names = own, _Name(r["generic"])
            spans = sorted(set(zip(r["starts"], r["ends"])))
            out.append({"corpus_id": r["corpus_id"], "entity_key": r["entity_key"], **names.judge(r["position"], r["entity_key"], spans, r["decision"], r["candidate_key"], r["cited"])})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def resolve(entities: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """One row per entity: what it was offered and what came of it.

    ``offered``: up to five identities of the same type and name (for generic names: that share a span), those that share a mention
    span first, then by the distance of the nearest of all their earlier mentions, then the older one; an identity is named by its
    first entity. ``n_candidates`` counts all of them. Outcomes: a shared span joins (several: they become one, see ``absorbed``); a
    supported merge into an offered identity joins it; ``new`` with valid support keeps apart; otherwise a name with one
    identity is reused, and one with several stays separate. ``identity`` is the identity right after the entity.

    Decisions, one row per entity at most: corpus_id, entity_key, decision, candidate_key, supporting (array), allowed (array of refs
    that may be cited). Entities without one count as doubtful.
    """
    keys = ["corpus_id", "entity_key"]
    rows = entities.select(*keys, "type", "folded", "position", is_generic(F.col("name")).alias("generic"),
                           F.transform("spans", lambda s: s["start_char"]).alias("starts"), F.transform("spans", lambda s: s["end_char"]).alias("ends"))
    cited = (F.coalesce(F.size("supporting"), F.lit(0)) > 0) & (F.size(F.array_except("supporting", "allowed")) == 0)
    if decisions is None:
        none = F.lit(None).cast("string")
        rows = rows.select("*", none.alias("decision"), none.alias("candidate_key"), F.lit(False).alias("cited"))
    else:
        rows = rows.join(decisions.select(*keys, "decision", "candidate_key", F.coalesce(cited, F.lit(False)).alias("cited")), keys, "left").fillna(False, ["cited"])
    group = ["corpus_id", "type", "folded", "generic"]
    placed = rows.repartition(*group).sortWithinPartitions(*group, "position", "entity_key")
    return placed.mapInArrow(_judge_sorted, f"corpus_id {entities.schema['corpus_id'].dataType.simpleString()}, {_JUDGED}")


def candidates(entities: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """The identities that ``resolve`` offers each entity, one row each; ``truncated`` where there were more than five."""
    return offers(resolve(entities, decisions))


def offers(resolved: DataFrame) -> DataFrame:
    return resolved.select("corpus_id", "entity_key", (F.col("n_candidates") > TOP).alias("truncated"), F.posexplode("offered").alias("rank", "o")).select(
        "corpus_id", "entity_key", "o.candidate_key", "o.shared", "o.distance", (F.col("rank") + 1).alias("rank"), "truncated")


def representative_contexts(items: DataFrame, limit: int = 3) -> DataFrame:
    """Nearest contexts of an entity around a position, keeping one earliest anchor.

    Items: group_key, position, start_char, end_char (+ text columns). Duplicate spans count once.
    """
    once = Window.partitionBy("group_key", "start_char", "end_char").orderBy("item")
    unique = items.withColumn("_d", F.row_number().over(once)).filter("_d = 1").drop("_d")
    near = Window.partitionBy("group_key").orderBy(F.abs(F.col("start_char") - F.col("position")), "start_char", "end_char")
    first = Window.partitionBy("group_key").orderBy("start_char", "end_char")
    ranked = unique.withColumn("near_rank", F.row_number().over(near)).withColumn("first_rank", F.row_number().over(first))
    head = max(1, limit - 1)
    lead = Window.partitionBy("group_key")
    inside = F.max((F.col("first_rank") == 1) & (F.col("near_rank") <= head)).over(lead)
    pick = (F.col("near_rank") <= head) | (inside & (F.col("near_rank") <= limit)) | (~inside & (F.col("first_rank") == 1))
    return ranked.withColumn("_pick", pick).filter("_pick").drop("_pick")


def dependency_groups(entities: DataFrame) -> DataFrame:
    """Entities whose name or mention lookups can meet: (corpus_id, entity_key, group_key), the smallest key of each group.

    A name of a corpus is a group by itself, a generic name's entity its own. Only groups that share a mention span with another one
    enter the search for components; in validated tables spans spell their name, and none does but those of generic names.
    """
    own = F.when(is_generic(F.col("name")), F.col("entity_key")).otherwise("")
    rows = stage(entities.select("corpus_id", "entity_key", F.struct("corpus_id", "type", "folded", own.alias("own")).alias("group"),
                                 F.transform("spans", lambda s: F.struct("corpus_id", "type", s["start_char"].alias("a"), s["end_char"].alias("b"))).alias("keys")), "grouped")
    keys = rows.select(F.col("group").alias("id"), F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least <> most").select("key")
    bridges = stage(keys.join(shared, "key", "left_semi").distinct(), "bridges")
    firsts = rows.groupBy(F.col("group").alias("id")).agg(F.min("entity_key").alias("group_key"), F.count("*").alias("n"))
    if not bridges.isEmpty():
        firsts = stage(firsts, "firsts")
        joined = components(bridges.select("id").distinct(), bridges)
        least = joined.join(firsts, "id").groupBy("component").agg(F.min("group_key").alias("_least"))
        named = joined.join(least, "component").select("id", "_least")
        firsts = firsts.join(named, "id", "left").select("id", F.coalesce("_least", "group_key").alias("group_key"), "n")
    per_group = stage(firsts.withColumnRenamed("id", "group"), "groups")
    return give_back(rows.select("corpus_id", "entity_key", "group"), per_group, "group").select("corpus_id", "entity_key", "group_key")


def clusters(resolved: DataFrame) -> DataFrame:
    """(corpus_id, entity_key, cluster): the identity of each entity at the end, named by its first entity.

    The rows of ``resolve`` carry the identity right after each entity. Only identities that a later entity bridged are named anew,
    and only they enter the search for components.
    """
    ident = lambda c: F.struct("corpus_id", F.col(c)["position"].alias("position"), F.col(c)["entity_key"].alias("entity_key"))
    bridges = stage(resolved.filter(F.size("absorbed") > 0).select("corpus_id", F.concat_ws("|", "corpus_id", "entity_key").alias("key"),
                                                                     F.explode(F.concat("absorbed", F.array("identity"))).alias("i")).select(ident("i").alias("id"), "key"), "bridges")
    own = resolved.select("corpus_id", "entity_key", ident("identity").alias("id"))
    if bridges.isEmpty():
        return own.select("corpus_id", "entity_key", F.col("id.entity_key").alias("cluster"))
    found = components(bridges.select("id").distinct(), bridges)
    return own.join(found, "id", "left").select("corpus_id", "entity_key", F.coalesce("component.entity_key", "id.entity_key").alias("cluster"))


def _joined(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(corpus_id, entity_key, cluster) of ids joined by edges (corpus_id, entity_key, joins)."""
    ident = F.struct("corpus_id", "entity_key")
    edge = edges.withColumn("key", F.concat_ws("|", "corpus_id", "entity_key", "joins"))
    members = edge.select(ident.alias("id"), "key").unionByName(edge.select(F.struct("corpus_id", F.col("joins").alias("entity_key")).alias("id"), "key"))
    found = components(ids.select(ident.alias("id")), members)
    return found.select("id.corpus_id", "id.entity_key", F.col("component.entity_key").alias("cluster"))


def merge_identities(entities: DataFrame, clustered: DataFrame, links: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Explicit identity links between clusters; returns (entity_key -> identity, link outcomes).

    Links: corpus_id, link_key, source_key, target_key, evidence_refs, context_refs. Decisions: corpus_id,
    link_key, decision, candidate_key, supporting. A link counts when the ends agree in type, neither established name is
    generic, and the decision names the link's target and cites link evidence and nothing outside the offered refs.
    """
    head = Window.partitionBy("corpus_id", "cluster").orderBy("position", "entity_key")
    named = entities.join(clustered, ["corpus_id", "entity_key"]).withColumn("_first", F.first("name").over(head))
    side = lambda s: named.select("corpus_id", F.col("entity_key").alias(f"{s}_key"), F.col("cluster").alias(f"{s}_cluster"),
                                  F.col("type").alias(f"{s}_type"), F.col("_first").alias(f"{s}_name"))
    rows = (links.join(side("source"), ["corpus_id", "source_key"]).join(side("target"), ["corpus_id", "target_key"])
            .join(decisions, ["corpus_id", "link_key"], "left"))
    fit = ((F.col("source_type") == F.col("target_type")) & ~is_generic(F.col("source_name")) & ~is_generic(F.col("target_name"))
           & (F.col("decision") == "merge") & (F.col("candidate_key") == F.col("target_key")) & F.arrays_overlap("supporting", "evidence_refs")
           & (F.size(F.array_except("supporting", F.array_union("evidence_refs", "context_refs"))) == 0))
    outcome = F.when(F.col("source_cluster") == F.col("target_cluster"), "same").when(F.coalesce(fit, F.lit(False)), "merged").otherwise("ambiguous")
    judged = rows.withColumn("outcome", outcome)
    ids = clustered.select("corpus_id", F.col("cluster").alias("entity_key")).distinct()
    merged = _joined(ids, judged.filter("outcome = 'merged'").select(
        "corpus_id", F.col("source_cluster").alias("entity_key"), F.col("target_cluster").alias("joins")))
    final = clustered.join(merged.select("corpus_id", F.col("entity_key").alias("cluster"), F.col("cluster").alias("identity")), ["corpus_id", "cluster"])
    return final.select("corpus_id", "entity_key", "identity"), judged.select("corpus_id", "link_key", "outcome")


def entity_id(version, start, end, kind):
    return F.sha2(F.concat(F.lit('["'), version, F.lit('",['), start, F.lit(","), end, F.lit(',"'), kind, F.lit('"]]')), 256)


def canonical_entities(entities: DataFrame, identities: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Canonical entity rows (with mentions de-duplicated by span) and the entity_key -> id mapping.

    The name is the earliest mention's text; aliases are the other distinct, non-generic names.
    """
    joined = entities.join(identities, ["corpus_id", "entity_key"])
    keys = ["corpus_id", "identity"]
    mention = joined.select(*keys, "type", F.explode("spans").alias("s")).select(*keys, "type", "s.*")
    once = stage(mention.groupBy(*keys, "start_char", "end_char").agg(
        F.first("type").alias("type"), F.min(F.struct("section_order", "chunk_id", "quote")).alias("m")).select(
        *keys, "start_char", "end_char", "type", "m.*"), "mentions")
    named = once.groupBy(*keys).agg(
        F.min_by("quote", F.struct("start_char", "end_char")).alias("name"), F.min(F.struct("start_char", "end_char")).alias("first"),
        F.first("type").alias("type"), F.min("section_order").alias("first_section_order"), F.count("*").alias("mention_count"))
    names = joined.filter(~is_generic(F.col("name"))).groupBy(*keys).agg(F.collect_set("name").alias("_names"))
    heads = named.join(names, keys, "left").withColumn(
        "entity_id", entity_id(F.lit(version), F.col("first.start_char"), F.col("first.end_char"), F.col("type"))).withColumn(
        "aliases", F.array_sort(F.array_except(F.coalesce("_names", F.array().cast("array<string>")), F.array("name"))))
    # three tables are made of these rows
    out = stage(heads.select("corpus_id", "identity", "entity_id", "type", "name", "aliases", "first_section_order", "mention_count"), "heads")
    mapping = identities.join(out.select(*keys, "entity_id"), keys).select("corpus_id", "entity_key", "entity_id")
    mentions = once.join(out.select(*keys, "entity_id"), keys).drop("identity")
    return out, mapping, mentions


def canonical_relations(relations: DataFrame, mapping: DataFrame, version: str) -> DataFrame:
    """Kept relations on canonical ends: no self loops, sorted ends for symmetric types, evidence groups listed.

    Relations: corpus_id, unit_id, pos, source, target, type, polarity, statement_mode, spans. One row per
    (relation, evidence group); ``group_id`` hashes the sorted span offsets, so repeated groups fall together.
    """
    side = lambda s: mapping.select("corpus_id", F.col("entity_key").alias(f"{s}_key"), F.col("entity_id").alias(f"{s}_id"))
    rows = (relations.withColumn("source_key", F.concat_ws("|", "unit_id", "source")).withColumn("target_key", F.concat_ws("|", "unit_id", "target"))
            .join(side("source"), ["corpus_id", "source_key"]).join(side("target"), ["corpus_id", "target_key"]).filter("source_id <> target_id"))
    sym = is_symmetric(F.col("type"))
    a = F.when(sym, F.least("source_id", "target_id")).otherwise(F.col("source_id"))
    b = F.when(sym, F.greatest("source_id", "target_id")).otherwise(F.col("target_id"))
    rows = rows.select("corpus_id", "unit_id", "pos", a.alias("source_id"), b.alias("target_id"), "type", "polarity", "statement_mode", "spans")
    parts = F.concat_ws('","', F.lit(version), "source_id", "type", "target_id", "polarity", "statement_mode")
    text = F.concat(F.lit('["'), parts, F.lit('"]'))
    return rows.withColumn("relation_id", F.sha2(text, 256))


def evidence_groups(relation_rows: DataFrame) -> DataFrame:
    """Distinct evidence groups per relation with their section range; the first copy of a group is kept."""
    offsets = F.array_sort(F.transform("spans", lambda s: F.struct(s["start_char"].alias("a"), s["end_char"].alias("b"))))
    listed = F.concat(F.lit("["), F.array_join(F.transform(offsets, lambda s: F.concat(F.lit("["), s["a"], F.lit(","), s["b"], F.lit("]"))), ","), F.lit("]"))
    rows = relation_rows.withColumn("evidence_hash", F.sha2(listed, 256)).withColumn(
        "group_id", F.sha2(F.concat(F.lit('["'), "relation_id", F.lit('","'), "evidence_hash", F.lit('"]')), 256))
    sections = F.transform("spans", lambda s: s["section_order"])
    rows = rows.withColumn("first_section", F.array_min(sections)).withColumn("last_section", F.array_max(sections))
    return rows.groupBy("corpus_id", "relation_id", "group_id", "evidence_hash", "first_section", "last_section").agg(
        F.min_by("spans", F.struct("unit_id", "pos")).alias("spans"), F.count("*").alias("copies"))


def relation_table(relation_rows: DataFrame) -> DataFrame:
    keys = ["corpus_id", "relation_id", "source_id", "target_id", "type", "polarity", "statement_mode"]
    return relation_rows.groupBy(*keys).agg(F.count("*").alias("statements"))
