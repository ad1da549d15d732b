"""Ordered work on hot keys: a key with more than one row in HEAVY is cut into chunks by its order, so that many tasks share it.

What a chunk does depends on the state that the one before leaves. Callers either summarise chunks as functions of that state and compose
these, or run chunks from a guess and run those again whose guess was wrong.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy with more than one in so many rows: fewer than HEAVY keys are, whatever the table.
HEAVY = 64
#: Chunks of a heavy key.
PARTS = 256


def cut(rows: DataFrame, keys: list[str], order: str, parts: int = PARTS, heavy: int = HEAVY) -> DataFrame:
    """rows with chunk: 0 for a key that isn't heavy, else the number of the part that order falls into, by quantiles over the heavy keys' rows.

    Rows equal in keys and order share a chunk. Collected are fewer than heavy keys and parts - 1 bounds.
    """
    total = rows.count()
    hot = rows.groupBy(*keys).count().filter(F.col("count") * heavy > total).collect() if total else []
    if not hot or parts < 2:
        return rows.withColumn("chunk", F.lit(0))
    kinds = dict(rows.dtypes)
    named = rows.sparkSession.createDataFrame([tuple(r)[: len(keys)] for r in hot], ", ".join(f"hot_{i} {kinds[k]}" for i, k in enumerate(keys))).withColumn("is_hot", F.lit(True))
    met = [F.col(k).eqNullSafe(F.col(f"hot_{i}")) for i, k in enumerate(keys)]
    marked = rows.join(F.broadcast(named), met, "left")
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set(marked.filter("is_hot").agg(F.percentile_approx(order, shares, 100 * parts)).first()[0] or []))
    count, at = F.array(*map(F.lit, bounds)), F.col(order)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    place = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(count, n + step - 1) <= at, n + step).otherwise(n)) if bounds else F.lit(0)
    return marked.withColumn("chunk", F.when(F.col("is_hot") & at.isNotNull(), place).otherwise(0)).select(*rows.columns, "chunk")


def several(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, list]:
    """The keys of rows with a chunk beyond the first, and the condition to join rows with them."""
    found = rows.filter("chunk > 0").select(*[F.col(k).alias(f"cut_{k}") for k in keys]).distinct()
    return found, [F.col(k).eqNullSafe(F.col(f"cut_{k}")) for k in keys]


def spans(part: pd.DataFrame, keys: list[str]) -> list[tuple[tuple, int, int]]:
    """key, first, last (exclusive) of the stretches of equal keys in a batch of sorted rows; the first may go on from the batch before."""
    changed = np.zeros(max(len(part) - 1, 0), bool)
    columns = [part[k].to_numpy(dtype=object, na_value=None) for k in keys]
    for values in columns:
        changed |= values[1:] != values[:-1]
    cuts = (np.flatnonzero(changed) + 1).tolist()
    return [(tuple(c[first] for c in columns), first, last) for first, last in zip([0, *cuts], [*cuts, len(part)])] if len(part) else []
