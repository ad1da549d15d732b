"""Tables, recorded responses and caches from files that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A smaller input than this many bytes a core is dealt out over the cores.
SMALL_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is small: a small file is often one row group, and so one task, however costly the expressions on it.

    Large inputs keep their scan's partitions: nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL_BYTES else df


def open_table(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """A table by its suffix (parquet, csv, json, orc, xlsx); if it can't be read, the fallback's."""
    from pyspark.errors import AnalysisException, PySparkException

    try:
        kind = path.rsplit(".", 1)[-1].lower()
        if kind == "xlsx":
            from .workbook import load

            return load(spark, path)
        reader = spark.read.option("header", True) if kind == "csv" else spark.read
        return reader.format(kind if kind in ("csv", "json", "orc") else "parquet").load(path)
    except (AnalysisException, PySparkException, OSError):
        if fallback is None:
            raise
        return open_table(spark, fallback)


def cache_info(spark: SparkSession, folder: str) -> DataFrame:
    """files, bytes of a folder of cached documents; the contents aren't read."""
    return spark.read.format("binaryFile").load(folder).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def expired(spark: SparkSession, folder: str, days: int = 7) -> DataFrame:
    """path of the cached documents that are older than `days`."""
    return spark.read.format("binaryFile").load(folder).filter(F.col("modificationTime") < F.current_timestamp() - F.make_interval(days=F.lit(days))).select("path")


def price_feed(payloads: DataFrame) -> DataFrame:
    """Rows of a recorded price feed (payload), under data or models."""
    row = "array<struct<model_name:string,model_ratio:double,completion_ratio:double,quota_type:int,model_price:double,owner_by:string,supported_endpoint_types:array<string>>>"
    rows = F.coalesce(F.from_json(F.get_json_object("payload", "$.data"), row), F.from_json(F.get_json_object("payload", "$.models"), row))
    return payloads.select(F.explode(rows).alias("r")).select("r.*").withColumnRenamed("supported_endpoint_types", "endpoints")
