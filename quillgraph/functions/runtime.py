"""Session helpers: durable lineage cuts and scratch folders."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, then the context's checkpoint folder, and where
    neither is set a folder below the warehouse, which is shared by definition. The same rule for every master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


def cut_lineage(df: DataFrame, label: str = "cut") -> tuple[DataFrame, str]:
    """Writes the rows once to the shared folder and reads them back: the plan starts anew and a lost
    executor costs a file read, not a recomputation. Returns the frame and its folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path), path


def stage(df: DataFrame, label: str) -> DataFrame:
    """A stage boundary: rows that several later steps read are written once instead of recomputed by each."""
    return cut_lineage(df, label)[0]


def placed(df: DataFrame, label: str, *keys: str, dealt: bool = False, buckets: int = 0) -> DataFrame:
    """A stage boundary whose rows lie in buckets by ``keys``, as many as a shuffle has partitions, at least ``buckets``: joins and
    groups on these keys read the rows where they lie, and only the other side of a join is shuffled. The files lie in the shared
    folder; the catalogue's entry, which the writer asks for, is dropped at once. ``dealt``: the rows of a key come from one task."""
    spark = df.sparkSession
    name, n = f"{label}_{uuid.uuid4().hex}", max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    writer = (df if dealt else df.repartition(n, *keys)).write.format("parquet").bucketBy(n, *keys).option("compression", "zstd")
    writer.option("path", scratch_path(spark, label)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


BROADCAST_ROWS = 200_000


def small_or_joined(df: DataFrame, label: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written copy of the rows, marked for broadcast only if there are at most ``most`` of them; beyond that joins are shuffled."""
    written = stage(df, label)
    return F.broadcast(written) if written.limit(most + 1).count() <= most else written


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def children(spark: SparkSession, path: str, holding: str) -> list[str]:
    """Names of the folders below ``path`` that hold a file of the given name; none where the path does not exist."""
    fs, target = _file_system(spark, path)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [s.getPath() for s in fs.listStatus(target) if s.isDirectory()] if fs.exists(target) else []
    return sorted(p.getName() for p in found if fs.exists(path_of(p, holding)))


def make_folder(spark: SparkSession, path: str) -> None:
    fs, target = _file_system(spark, path)
    fs.mkdirs(target)


def forget(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder that this run wrote itself."""
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
