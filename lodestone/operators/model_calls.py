"""Model chains and the circuit breaker. A model that refuses a login is left alone for BLOCK_SECONDS; the end of the block is inclusive.

A breaker's calls are a state machine with one number, until when the model is blocked. What a stretch of calls makes of that
number is a step function: an earlier end is overtaken at the first call not before it, a later one stays. Step functions compose, so
a hot key's chunks are summarised side by side, composed in order, and replayed side by side from their true starts. A chain's blocks, one a
model, are too many for such a summary; its chunks run from a guess, and those that guessed wrong run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from . import chunks


def next_block(unblock: float, ts: float, status: int) -> tuple[str, float]:
    """What happens to a call, and until when the model is blocked afterwards."""
    if ts < unblock:
        return "skip", unblock
    return "call", ts + L.BLOCK_SECONDS if status in L.AUTH_FAILURES else 0


class Steps:
    """What a stretch of calls makes of the block it begins with: values[i] if that ends by tops[i] (ascending, the first that holds), itself if later than all."""

    def __init__(self, tops: np.ndarray, values: np.ndarray):
        keep = np.append(values[1:] != values[:-1], True) if len(values) else np.zeros(0, bool)
        self.tops, self.values = tops[keep], values[keep]

    @classmethod
    def of(cls, ts: np.ndarray, refused: np.ndarray) -> Steps:
        """Of calls in order of ts. Only refused calls matter: a call that is made and not refused clears the block until the next refused one."""
        at = np.flatnonzero(refused)
        until = ts[at] + L.BLOCK_SECONDS
        after = np.searchsorted(ts, until)  # the first call not before the block's end,
        then = np.searchsorted(at, after)  # and the first refused one from there
        left = np.zeros(len(at) + 1, ts.dtype)
        for k in reversed(range(len(at))):
            left[k] = until[k] if after[k] == len(ts) else left[then[k]]
        return cls(np.append(ts[at], ts[-1:]), left if len(ts) else left[:0])

    def __call__(self, unblock):
        i = np.searchsorted(self.tops, unblock)
        return self.values[i] if i < len(self.tops) else unblock

    def then(self, later: Steps) -> Steps:
        """This, and later after it."""
        over = later.tops > (self.tops[-1] if len(self.tops) else -np.inf)
        values = np.array([later(v) for v in self.values], later.values.dtype)
        return Steps(np.append(self.tops, later.tops[over]), np.append(values, later.values[over]))


def skipped(ts: np.ndarray, refused: np.ndarray, unblock) -> tuple[np.ndarray, object]:
    """Which calls are passed over, and the block they leave."""
    skip, at = np.zeros(len(ts), bool), np.flatnonzero(refused)
    end = np.searchsorted(ts, unblock)
    skip[:end] = True
    left = unblock if end == len(ts) else 0
    k = np.searchsorted(at, end)
    while k < len(at):
        unblock = ts[at[k]] + L.BLOCK_SECONDS
        end = np.searchsorted(ts, unblock)
        skip[at[k] + 1 : end] = True
        left = unblock if end == len(ts) else 0
        k = np.searchsorted(at, end)
    return skip, left


KEY = ["client", "model"]


def breaker(calls: DataFrame, parts: int = chunks.PARTS, heavy: int = chunks.HEAVY) -> DataFrame:
    """calls (client, model, ord, ts, status) with action (call or skip), each (client, model) in order of ts, then ord.

    A call without a time is made and blocks nothing. Rows are read batch by batch, so a key of any length needs no memory; of the summaries there
    are fewer than heavy x parts, each as long as the refused calls of its last block.
    """
    names, kinds = [*KEY, "ord", "ts", "status"], dict(calls.dtypes)
    timed = chunks.cut(calls.select(*names).filter("ts is not null"), KEY, "ts", parts, heavy)
    told = lambda rows: np.isin(rows["status"].to_numpy(dtype=float, na_value=np.nan), list(L.AUTH_FAILURES))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, steps, done = None, None, []
        for part in batches:
            ts, refused = part["ts"].to_numpy(), told(part)
            for own, first, last in chunks.spans(part, [*KEY, "chunk"]):
                mine = Steps.of(ts[first:last], refused[first:last])
                if own == key:
                    steps = steps.then(mine)
                    continue
                if key is not None:
                    done.append((*key, steps.tops.tolist(), steps.values.tolist()))
                key, steps = own, mine
        if key is not None:
            yield pd.DataFrame([*done, (*key, steps.tops.tolist(), steps.values.tolist())], columns=[*KEY, "chunk", "tops", "values"])

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, unblock = None, 0
        for part in batches:
            starts = []
            for own, tops, values in zip(zip(part["client"], part["model"]), part["tops"], part["values"]):
                unblock = unblock if own == key else 0
                starts.append(unblock)
                key, unblock = own, Steps(np.asarray(tops), np.asarray(values))(unblock)
            yield part[[*KEY, "chunk"]].assign(ord=0, ts=starts, status=0, first=0)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, unblock = None, 0
        for part in batches:
            ts, refused, first_ = part["ts"].to_numpy(), told(part), part["first"].to_numpy()
            skip = np.zeros(len(part), bool)
            for own, first, last in chunks.spans(part, [*KEY, "chunk"]):
                unblock = unblock if own == key else 0
                if first_[first] == 0:
                    unblock, first = ts[first], first + 1
                skip[first:last], unblock = skipped(ts[first:last], refused[first:last], unblock)
                key = own
            yield part[names].assign(action=np.where(skip, "skip", "call"))[first_ == 1]

    ordered = lambda rows, *order: rows.repartition(*KEY, "chunk").sortWithinPartitions(*KEY, "chunk", *order)
    key = f"client {kinds['client']}, model {kinds['model']}, chunk int"
    # Only cut keys have chunks beyond the first; the first one's start is no block.
    hot = timed.join(*chunks.several(timed, KEY), "left_semi")
    summaries = ordered(hot, "ts", "ord").mapInPandas(summarise, f"{key}, tops array<{kinds['ts']}>, values array<{kinds['ts']}>")
    starts = summaries.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").mapInPandas(compose, f"{key}, ord {kinds['ord']}, ts {kinds['ts']}, status {kinds['status']}, first int")
    rows = timed.withColumn("first", F.lit(1)).unionByName(starts)
    out = ordered(rows, "first", "ts", "ord").mapInPandas(replay, ", ".join(f"{c} {kinds[c]}" for c in names) + ", action string")
    return out.unionByName(calls.select(*names).filter("ts is null").withColumn("action", F.lit("call")))


def answered(chain: list[tuple[str, int]], ts: int, blocks: dict[str, int]) -> tuple[str, str | None]:
    """The models tried and the one that answered; blocks is brought up to date."""
    chain = [o for o in chain if blocks.get(o[0], 0) <= ts] or chain
    ends = next((i for i, o in enumerate(chain) if o[1] == 200), None)
    chain = chain if ends is None else chain[: ends + 1]
    blocks.update((name, ts + L.BLOCK_SECONDS) for name, status in chain if status in L.AUTH_FAILURES)
    return ",".join(o[0] for o in chain), None if ends is None else chain[ends][0]


def chain_results(requests: DataFrame, parts: int = chunks.PARTS, heavy: int = chunks.HEAVY) -> DataFrame:
    """client, ord, tried, model from requests (client, ord, ts, outcomes: model and status in the chain's order).

    Blocked models are passed over, unless all are; the first success ends a request; a refused login (re)starts that model's
    block. A client's requests are read in order of ord, then ts, batch by batch, keeping only the current blocks; rows equal
    in both come in the order of their outcomes; a request without a time is one at 0. A hot client's chunks first run from no blocks; each round runs those again whose start
    turned out otherwise. Blocks that end before all later requests are dropped from a start, so a difference rarely outlives one
    block. Starts, fewer than heavy x parts, are held by the driver.
    """

    def walk(batches: Iterator[pd.DataFrame], starts: dict, results: bool) -> Iterator[pd.DataFrame]:
        """The results, or else the blocks that each chunk leaves, and its least time."""
        key, blocks, least, ends = None, {}, None, []
        for part in batches:
            done = []
            for own, first, last in chunks.spans(part, ["client", "chunk"]):
                rows = part.iloc[first:last]
                if own != key:
                    if key is not None:
                        ends.append((*key, list(blocks), list(blocks.values()), least))
                    key, blocks, least = own, dict(starts.get(own, {})), rows["ts"].iat[0]
                least = min(least, rows["ts"].min())
                done += [answered(list(zip(names, statuses)), ts, blocks) for ts, names, statuses in zip(rows["ts"], rows["names"], rows["statuses"])]
            if results:
                ends.clear()
                yield part[["client", "ord"]].assign(tried=[d[0] for d in done], model=[d[1] for d in done])
        if key is not None and not results:
            yield pd.DataFrame([*ends, (*key, list(blocks), list(blocks.values()), least)], columns=["client", "chunk", "names", "untils", "least"])

    part = lambda name, kind: F.transform("outcomes", lambda o: o[name].cast(kind))
    client = dict(requests.dtypes)["client"]
    rows = requests.select("client", F.col("ord").cast("long").alias("ord"), F.coalesce(F.col("ts").cast("long"), F.lit(0)).alias("ts"), part("model", "string").alias("names"), F.transform(part("status", "int"), lambda s: F.coalesce(s, F.lit(0))).alias("statuses"))
    rows = chunks.cut(rows, ["client"], "ord", parts, heavy)
    ordered = lambda rows: rows.repartition("client", "chunk").sortWithinPartitions("client", "chunk", "ord", "ts", "names", "statuses")
    hot = rows.join(*chunks.several(rows, ["client"]), "left_semi")
    starts: dict[tuple, dict] = {}
    ends: dict[tuple, tuple[dict, int]] = {}
    again = None
    while again is None or again:
        todo = hot
        if again is not None:
            asked = rows.sparkSession.createDataFrame(sorted(again, key=str), f"again_client {client}, again_chunk int")
            todo = hot.join(F.broadcast(asked), F.col("client").eqNullSafe(F.col("again_client")) & (F.col("chunk") == F.col("again_chunk")), "left_semi")
        now = dict(starts)
        for r in ordered(todo).mapInPandas(lambda b: walk(b, now, False), f"client {client}, chunk int, names array<string>, untils array<long>, least long").collect():  # noqa: B023
            ends[r["client"], r["chunk"]] = dict(zip(r["names"], r["untils"])), r["least"]
        fresh: dict[tuple, dict] = {}
        for own in {k for k, _ in ends}:
            places = sorted(c for k, c in ends if k == own)
            least = np.minimum.accumulate([ends[own, c][1] for c in reversed(places)])[::-1]
            for i, c in enumerate(places[1:], 1):
                fresh[own, c] = {m: t for m, t in ends[own, places[i - 1]][0].items() if t > least[i]}
        again = {k for k, v in fresh.items() if v != starts.get(k, {})}
        starts = fresh
    return ordered(rows).mapInPandas(lambda b: walk(b, starts, True), f"client {client}, ord long, tried string, model string")
