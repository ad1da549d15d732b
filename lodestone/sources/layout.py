"""A work table in ranges of its key: an update rewrites only the ranges that it touches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sheet import latest, updated

RANGE, STAGED = "_range", "_staged"
#: Keys in one range, and ranges that one job names in its filter.
WIDTH, NAMED = 100_000, 10_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir; under a folder of this machine only where its threads are the executors."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir")
        root = tempfile.mkdtemp(prefix="lodestone-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> None:
    """df by range. The ranges named in it replace those of path; rebalancing splits a range that is full of one key over several files."""
    df.hint("rebalance", RANGE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(path)


def create(df: DataFrame, path: str, key: str = "row_index", width: int = WIDTH) -> None:
    """df under path, by ranges of `width` keys; rows without a key lie in a range of their own, -1."""
    _write(df.withColumn(RANGE, F.coalesce(F.when(F.col(key) >= 0, F.floor(F.col(key) / width)).cast("long"), F.lit(-1).cast("long"))), path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(RANGE)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _forget(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def recover(spark: SparkSession, path: str) -> bool:
    """Put an update in place that was staged whole but whose commit may have been cut; False if there is none. Repeating it changes nothing."""
    staged = f"{path.rstrip('/')}.{STAGED}"
    if not _exists(spark, f"{staged}/_SUCCESS"):
        return False
    _write(spark.read.parquet(staged), path)
    _forget(spark, staged)
    return True


def merge(spark: SparkSession, path: str, updates: DataFrame, key: str = "row_index", width: int = WIDTH) -> int:
    """Updates (key, ord, cells, verifier, error; as sheet.latest takes them) into the table at path. Returns how many ranges were rewritten.

    The touched ranges' new rows are staged beside the table first, so that a run cut while they are put in place is
    mended by `recover`, which the next merge begins with; one writer at a time. Keys that the table lacks, negative ones
    and nulls change nothing. Untouched ranges are neither read nor written. Updates may repeat keys without bound: they are folded
    by partial aggregates.
    """
    recover(spark, path)
    held = spark.read.parquet(path)
    given = updates.filter(F.col(key) >= 0)
    ranges = given.select(F.floor(F.col(key) / width).cast("long").alias(RANGE)).distinct()
    touched = [r[0] for r in ranges.limit(NAMED + 1).collect()]
    # a list of ranges prunes the scan by folders; where it would be long, Spark prunes by the join's own keys at run time
    part = held.filter(F.col(RANGE).isin(touched)) if len(touched) <= NAMED else held.join(ranges, RANGE, "left_semi")
    if not touched:
        return 0
    staged = f"{path.rstrip('/')}.{STAGED}"
    new = updated(part, latest(given, key), key).select(*held.columns)
    new.hint("rebalance", RANGE).write.mode("overwrite").partitionBy(RANGE).parquet(staged)
    recover(spark, path)
    return len(touched) if len(touched) <= NAMED else ranges.count()
