"""Strict ingest of candidate batches: JSON per unit to typed candidate tables and rejects."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.ontology import ENTITY_TYPES, MODES, POLARITIES

ANCHOR = "struct<span_id:string, quote:string, occurrence:bigint>"
SHAPES = {
    "entities": (["local_id", "type", "name", "mentions", "description"],
                 f"struct<local_id:string, type:string, name:string, mentions:array<{ANCHOR}>, description:string>"),
    "relations": (["source", "target", "type", "polarity", "statement_mode", "evidence"],
                  f"struct<source:string, target:string, type:string, polarity:string, statement_mode:string, evidence:array<{ANCHOR}>>"),
    "identity_links": (["source", "target", "evidence"], f"struct<source:string, target:string, evidence:array<{ANCHOR}>>"),
}


def _unknown(json: Column, allowed: list[str]) -> Column:
    return F.size(F.array_except(F.json_object_keys(json), F.array(*[F.lit(k) for k in allowed]))) > 0


def _anchors_bad(anchors: Column, most: int | None) -> Column:
    size = F.coalesce(F.size(anchors), F.lit(0))
    wrong = F.exists(anchors, lambda a: a["span_id"].isNull() | a["quote"].isNull() | ~F.length(a["quote"]).between(1, 600)
                     | (F.coalesce(a["occurrence"], F.lit(1)) < 1))
    return (size < 1) | (F.lit(False) if most is None else size > most) | F.coalesce(wrong, F.lit(False))


def _bad(kind: str, x: Column) -> Column:
    fallback = lambda c, d: F.coalesce(c, F.lit(d))
    if kind == "entities":
        return (x["local_id"].isNull() | ~fallback(x["type"], "").isin(ENTITY_TYPES) | ~F.length(fallback(x["name"], "")).between(1, 100)
                | (F.length(fallback(x["description"], "")) > 300) | _anchors_bad(x["mentions"], None))
    ends = x["source"].isNull() | x["target"].isNull() | _anchors_bad(x["evidence"], 3)
    if kind == "identity_links":
        return ends
    return (ends | x["type"].isNull() | ~fallback(x["polarity"], "affirmed").isin(POLARITIES)
            | ~fallback(x["statement_mode"], "narration").isin(MODES))


# one-argument functions for the array operators, which read a second parameter as the index
def _typed(shape: str):
    return lambda j: F.from_json(j, shape)


def _strange(fields: list[str]):
    return lambda j: F.coalesce(_unknown(j, fields), F.lit(True))


def _strange_inside(inner: str):
    anchors = lambda j: F.from_json(j, f"struct<{inner}:array<string>>")[inner]
    return lambda j: F.coalesce(F.exists(anchors(j), _strange(["span_id", "quote", "occurrence"])), F.lit(False))


def _wrong(kind: str):
    return lambda x: x.isNull() | _bad(kind, x)


def ingest_candidates(units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(corpus_id, unit_id, payload) to (entities, relations, links, rejects).

    A payload is taken or refused as a whole: unknown fields, wrong enums, lengths or evidence counts refuse it.
    """
    top = ", ".join(f"{k} array<string>" for k in SHAPES)
    # JSON elements stay text at first: a typed parse would silently drop unknown fields
    rows = units.withColumn("raw", F.from_json("payload", top))
    parsed = rows
    for kind, (_, shape) in SHAPES.items():
        parsed = parsed.withColumn(kind, F.transform(F.coalesce(F.col(f"raw.{kind}"), F.array().cast("array<string>")),
                                                     _typed(shape)))
    element_unknown, anchor_unknown, wrong = F.lit(False), F.lit(False), F.lit(False)
    for kind, (fields, _) in SHAPES.items():
        inner = "mentions" if kind == "entities" else "evidence"
        element_unknown = element_unknown | F.coalesce(F.exists(f"raw.{kind}", _strange(fields)), F.lit(False))
        anchor_unknown = anchor_unknown | F.coalesce(F.exists(f"raw.{kind}", _strange_inside(inner)), F.lit(False))
        wrong = wrong | F.coalesce(F.exists(kind, _wrong(kind)), F.lit(False))
    reason = (F.when(F.col("raw").isNull() | F.json_object_keys("payload").isNull(), "not_json")
              .when(_unknown(F.col("payload"), list(SHAPES)) | element_unknown | anchor_unknown, "unknown_field")
              .when(wrong, "invalid_value"))
    judged = parsed.withColumn("reason", reason)
    good = judged.filter(F.col("reason").isNull())

    def out(kind, columns):
        return good.select("corpus_id", "unit_id", F.posexplode(kind).alias("pos", "x")).select(
            "corpus_id", "unit_id", F.col("pos").cast("bigint").alias("pos"), *columns)

    anchors = lambda name: F.transform(F.col(f"x.{name}"), lambda a: F.struct(
        a["span_id"].alias("span_id"), a["quote"].alias("quote"), F.coalesce(a["occurrence"], F.lit(1).cast("bigint")).alias("occurrence"))).alias(name)
    entities = out("entities", ["x.local_id", "x.type", "x.name", F.coalesce("x.description", F.lit("")).alias("description"), anchors("mentions")])
    relations = out("relations", ["x.source", "x.target", "x.type", F.coalesce("x.polarity", F.lit("affirmed")).alias("polarity"),
                                  F.coalesce("x.statement_mode", F.lit("narration")).alias("statement_mode"), anchors("evidence")])
    links = out("identity_links", ["x.source", "x.target", anchors("evidence")])
    return entities, relations, links, judged.filter(F.col("reason").isNotNull()).select("corpus_id", "unit_id", "reason")
