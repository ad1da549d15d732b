"""Conversation logs, written once a row: turns gather in keyed state, a row's log leaves when it ends or falls quiet, and a marker keeps it from leaving again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
#: A row without new turns for QUIET ms is over; a written row is known for REMEMBER ms.
QUIET, REMEMBER = 60_000, 7 * 86_400_000


class FlushOnce(StatefulProcessor):
    """Turns by number, so that a turn delivered again takes its own place; one timer, pushed on by each delivery; a marker with a time to live."""

    def __init__(self, quiet: int = QUIET, remember: int = REMEMBER):
        self.quiet, self.remember = quiet, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "turn long", "role string, text string")
        self.written = handle.getValueState("written", "turns long", self.remember)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        over, known = False, self.written.exists()
        for part in rows:
            for turn, role, text, last in zip(part["turn"], part["role"], part["text"], part["last"]):
                over |= bool(last)
                if not known:
                    self.turns.updateValue((int(turn),), (None if pd.isna(role) else role, None if pd.isna(text) else text))
        if known:
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if over:
            yield from self.flush(key)
        else:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.written.exists() and self.turns.exists():
            yield from self.flush(key)

    def flush(self, key) -> Iterator[pd.DataFrame]:
        turns = sorted((number[0], role, text) for number, (role, text) in self.turns.iterator())
        self.turns.clear()
        self.written.update((len(turns),))
        lines = [f"[{role}] {text or ''}" for _, role, text in turns if role is not None]
        yield pd.DataFrame({"conv_id": [key[0]], "name": [f"row_{key[0]:04d}.txt"], "turns": [len(turns)], "log": ["\n".join(lines)]})

    def close(self) -> None:
        pass


def flushed_once(turns: DataFrame, quiet: int = QUIET, remember: int = REMEMBER) -> DataFrame:
    """conv_id, name, turns, log of turns (conv_id, turn, role, text, last), as a stream or a table: one row a conversation, whatever is delivered again.

    A conversation ends with a turn that is `last`, or `quiet` ms after its newest; what comes for it in the next `remember` ms is
    dropped. Of turns under one number the one delivered last counts; a turn without a role gives no line; rows without conv_id or turn
    are left out. State is one entry a turn, and goes with the log; only a log itself is ever whole in memory. In a table
    all conversations are over when its rows are.
    """
    spark = turns.sparkSession
    keyed_store(spark)
    known = turns.filter("conv_id is not null and turn is not null").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text", "coalesce(last, false) last")
    return known.groupBy("conv_id").transformWithStateInPandas(FlushOnce(quiet if turns.isStreaming else -1, remember), "conv_id long, name string, turns long, log string", "append", "ProcessingTime")


def keyed_store(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store, and tables in place of streams need the session's stream manager started."""
    spark.conf.set(STORE, ROCKS)
    spark.streams.active  # noqa: B018


def write_logs(turns: DataFrame, path: str, checkpoint: str, quiet: int = QUIET, remember: int = REMEMBER, trigger: dict | None = None) -> StreamingQuery:
    """Stream turns into logs under path, one folder a batch. A batch that runs again finds the state before it and replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    how = trigger or {"availableNow": True}
    spark = turns.sparkSession
    before = spark.conf.get(EMPTY_BATCHES)
    # timers ask for one more batch for ever: a run over what is there now would never end
    spark.conf.set(EMPTY_BATCHES, str("availableNow" not in how).lower())
    try:
        return flushed_once(turns, quiet, remember).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**how).start()
    finally:
        spark.conf.set(EMPTY_BATCHES, before)
