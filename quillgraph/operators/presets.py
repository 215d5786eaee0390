"""Caps of the bounded read tools, applied to request tables before the general operators run."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values per tool: parameter -> (default, lowest, highest).
CAPS: dict[str, dict[str, tuple[int, int, int]]] = {
    "book_structure": {"offset": (0, 0, 2**31 - 1), "limit": (0, 0, 20)},
    "search_text": {"k": (3, 1, 8)},
    "read_context": {"before": (0, 0, 1), "after": (0, 0, 1)},
    "read_section": {"limit": (2, 1, 3)},
    "search_entities": {"limit": (5, 1, 8)},
    "entity_detail": {"limit": (8, 8, 8)},
    "relations": {"depth": (1, 1, 2), "node_limit": (20, 20, 20), "edge_limit": (20, 20, 20)},
    "paths": {"max_hops": (3, 1, 3), "limit": (3, 3, 3)},
}


def bounded(requests: DataFrame, tool: str) -> DataFrame:
    """Missing parameters get the tool's default; given ones are held to its range."""
    out = requests
    for name, (default, low, high) in CAPS[tool].items():
        given = F.col(name).cast("bigint") if name in requests.columns else F.lit(None).cast("bigint")
        out = out.withColumn(name, F.least(F.greatest(F.coalesce(given, F.lit(default)), F.lit(low)), F.lit(high)).cast("bigint"))
    return out


def tool_views(requests: DataFrame) -> DataFrame:
    """All tools at once: rows (request_id, tool, params map) to bounded parameter rows."""
    table = F.create_map(*[x for tool, caps in CAPS.items() for x in (
        F.lit(tool), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("standard"), F.lit(a).alias("low"), F.lit(b).alias("high")) for n, (d, a, b) in caps.items()]))])
    rows = requests.select("request_id", "tool", "params", F.explode(table[F.col("tool")]).alias("c"))
    value = F.coalesce(F.col("params")[F.col("c.name")].cast("bigint"), F.col("c.standard").cast("bigint"))
    return rows.select("request_id", "tool", F.col("c.name").alias("parameter"), F.least(F.greatest(value, F.col("c.low")), F.col("c.high")).cast("bigint").alias("value"))
