"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows with this remainder of crc32(doc_id) mod 5 are never learned from.
FOLDS, HELD_OUT_FOLD = 5, 0


#: Bytes of one Arrow batch to a Python worker, and of a side that is broadcast, at most.
BATCH_BYTES, BROADCAST_BYTES = 4 << 20, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of the session are cut by bytes: rows alone say nothing of the memory that whole texts take."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for a broadcast if its rows, measured whole, take at most most_bytes; else as it is, for a shuffle join."""
    row = F.octet_length(F.to_json(F.struct(*df.columns))) + 32 * len(df.columns)
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= most_bytes else df


def held_out(doc_id: Column) -> Column:
    """True for the fold that is kept from learning; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(True))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


class Scratch:
    """Written tables under the shared folder that the session names in spark.checkpoint.dir.

    Writing a table cuts its lineage: what a lost executor held is read again from the shared
    files. A session without that setting is refused, but for one whose workers are threads of this machine.
    """

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            top = "file://" + tempfile.mkdtemp(prefix="lodestone-")
            spark.conf.set("spark.checkpoint.dir", top)
        self.spark, self.root = spark, f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.root}/{label}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, label: str = "") -> None:
        """Removes the table, or all of them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{label}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one slice stay near most_bytes; one longer text stands alone."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, n in enumerate(sizes):
            if i > at and (total + n > most_bytes or i - at >= most_rows):
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(n)
        if len(sizes) > at:
            yield batch.slice(at)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


#: A key of more than one row in so many is cut before a shuffle.
CUT = 64


def spread_join(rows: DataFrame, side: DataFrame, on: list[str], weight: str, how: str = "left") -> DataFrame:
    """rows joined with side on the columns on, nulls equal; side has each key once, and in weight the number of its rows.

    The rows of a key that has more than one in CUT of them are dealt out over salts, and its row of side is copied to each
    salt. Fewer than CUT keys can have that many, so the list of them that is broadcast and the copies have a bound whatever the input.
    """
    total = side.agg(F.sum(weight)).first()[0] or 0
    copies = F.ceil(F.col(weight) * F.lit(CUT) / F.lit(max(total, 1))).cast("int")
    met = lambda mine: [F.col(f"on_{i}").eqNullSafe(F.col(f"{mine}_{i}")) for i in range(len(on))]
    keys = lambda prefix: [F.col(c).alias(f"{prefix}_{i}") for i, c in enumerate(on)]
    heavy = side.filter(F.col(weight) * CUT > total).select(*keys("heavy"), copies.alias("copies"))
    dealt = rows.select("*", *keys("on")).join(F.broadcast(heavy), met("heavy"), "left")
    dealt = dealt.withColumn("salt", F.when(F.col("copies").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("copies"))).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1)).alias("side_salt")
    others = [c for c in side.columns if c not in on and c not in rows.columns]
    copied = side.select(*keys("side"), *others, salts)
    joined = dealt.join(copied, [*met("side"), F.col("salt") == F.col("side_salt")], how)
    return joined.select(*rows.columns, *others)


def unit_hash(key: Column, seed: int) -> Column:
    """A pseudorandom number in [0, 1) that depends on the key alone."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / float(1 << 53)


def fresh(name: str, columns: list[str]) -> str:
    """name, made longer until it clashes with none of the columns."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
