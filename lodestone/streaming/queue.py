"""The work table as streams: new rows are processed as they come, and the circuit breaker keeps its state between batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.model_calls import next_block
from ..operators.sheet import is_open


def process_open_rows(rows: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run `process` on each batch's open rows and write its result once: a repeated batch replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        todo = batch.filter(is_open(F.col("Verifier"), F.col("Error"))).dropDuplicates(["row_index"])
        process(todo).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def breaker_stream(calls: DataFrame) -> DataFrame:
    """calls (client, model, ord, ts, status) with action, in the order of ts within a batch; state is one number per (client, model)."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        unblock = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(["ts", "ord"], kind="stable")
        actions = []
        for ts, status in zip(rows["ts"], rows["status"]):
            action, unblock = next_block(unblock, ts, status)
            actions.append(action)
        state.update((int(unblock),))
        yield rows.assign(action=actions)[["client", "model", "ord", "ts", "status", "action"]]

    return calls.groupBy("client", "model").applyInPandasWithState(step, "client string, model string, ord long, ts long, status int, action string", "unblock long", "append", GroupStateTimeout.NoTimeout)


def status_counts(rows: DataFrame, time: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """start, total, filled, failed by event-time window; rows later than `late` are left out."""
    counts = [F.count("*").alias("total"), F.count_if(F.coalesce("Verifier", F.lit("")) != "").alias("filled"), F.count_if(F.coalesce("Error", F.lit("")) != "").alias("failed")]
    return rows.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(*counts).select(F.col("w.start").alias("start"), "total", "filled", "failed")
