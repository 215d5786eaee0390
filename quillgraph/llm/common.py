"""Shared by the training-data operators: let-bindings, size-checked broadcasts, free column names."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.runtime import stage
from quillgraph.llm.words import BLANKS

BROADCAST_ROWS = 200_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    """All words of the text in order; an empty array for null and for blank texts."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANKS}+|{BLANKS}+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{BLANKS}+"))


def small_or_joined(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written copy of the table, marked for broadcast only if its counted rows are at most ``most``; beyond that the
    caller's join runs as a shuffled join."""
    written = stage(table, "lookup")
    return F.broadcast(written) if written.limit(most + 1).count() <= most else written


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """A name per stem that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def need(df: DataFrame, **types: str) -> DataFrame:
    """The named columns alone, cast to the given types; extra columns of any name are dropped."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in types.items()])
