"""A table that micro-batches add to, kept in a number of folders that grows with the logarithm of the batches."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quillgraph.functions.runtime import children, forget

WIDTH = 8


class BatchStore:
    """Folders ``tier-T-N``, each with the rows of batches N * width**T up to the next N, merged.

    Every batch is a folder of tier 0. The batch that completes ``width`` folders of a tier merges them into one of the next tier, so
    a row is rewritten once per tier. A folder counts once its writer has committed it. The parts of a merged folder stay until the
    next folder of that tier is complete: a replayed batch, and a reader that began before, still find them.

    ``merge`` takes rows of several folders to one row per key and must not depend on order or grouping. ``by`` lays the rows of a
    folder out by that column's values. Adding a batch again replaces it; rows of other columns or types are refused (ValueError).
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame] | None = None,
                 by: str | None = None, width: int = WIDTH):
        if width < 2:
            raise ValueError("a merge takes two folders at least")
        self.spark, self.path, self.schema, self.merge, self.by, self.width = spark, path.rstrip("/"), schema, merge, by, width

    def folders(self) -> set[tuple[int, int]]:
        """(tier, number) of all committed folders."""
        named = [name.split("-") for name in children(self.spark, self.path, "_SUCCESS") if name.startswith("tier-")]
        return {(int(t), int(n)) for _, t, n in named}

    def _at(self, tier: int, number: int) -> str:
        return f"{self.path}/tier-{tier}-{number}"

    def _write(self, rows: DataFrame, tier: int, number: int) -> None:
        laid = rows.repartition(self.by) if self.by else rows
        writer = laid.write.mode("overwrite")
        (writer.partitionBy(self.by) if self.by else writer).parquet(self._at(tier, number))

    def _rows(self, wanted: list[tuple[int, int]]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        paths = [self._at(*f) for f in wanted]
        # folders with a layout of their own are tables of their own
        parts = reduce(DataFrame.unionByName, map(reader.parquet, paths)) if self.by else reader.parquet(*paths)
        return self.merge(parts) if self.merge else parts

    def add(self, rows: DataFrame, batch: int) -> None:
        given, kept = dict(rows.dtypes), {f.name: f.dataType.simpleString() for f in StructType.fromDDL(self.schema)}
        if given != kept:
            raise ValueError(f"rows have {given}, the store keeps {kept}")
        self._write(rows, 0, batch)
        tier, number = 1, (batch + 1) // self.width - 1
        while (batch + 1) % self.width ** tier == 0:
            first = number * self.width
            present = self.folders()
            self._write(self._rows([(tier - 1, n) for n in range(first, first + self.width) if (tier - 1, n) in present]), tier, number)
            for t, n in present:
                if t == tier - 1 and n < first:
                    forget(self.spark, self._at(t, n))
            tier += 1
            number = (batch + 1) // self.width ** tier - 1

    def covering(self, before: int | None = None) -> list[tuple[int, int]]:
        """The fewest folders that hold each batch (of those before the given one) once."""
        size = lambda tier: self.width ** tier
        present = [(t, n) for t, n in self.folders() if before is None or (n + 1) * size(t) <= before]
        out, upto = [], 0
        for t, n in sorted(present, key=lambda f: (f[1] * size(f[0]), -f[0])):
            if n * size(t) >= upto:
                out.append((t, n))
                upto = (n + 1) * size(t)
        return out

    def read(self, before: int | None = None) -> DataFrame:
        """All rows (of batches before the given one), merged; an empty store gives no rows."""
        wanted = self.covering(before)
        return self._rows(wanted) if wanted else self.spark.createDataFrame([], self.schema)
