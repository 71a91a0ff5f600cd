"""A circuit breaker per key on a stream of outcomes.

The state of a key is its run of failures, the last attempt that was counted, and whether the breaker is open. ``limit`` failures in
a row (or one that no retry can mend) open it and set a timer for the cooling time, in event time; when the watermark passes it, the
breaker closes for trial and counts anew. Every change is a row. Attempts that were counted are passed over when they come again, so
a source that repeats rows changes nothing. The state is a few numbers per key, and it survives a restart with the checkpoint.

A call for every key would cost more than its rows, so keys are dealt into buckets by hash: a bucket is one value of state, read and
written once a batch, and its rows are counted together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quire.session import ship_by_value

FATAL = ("import_error", "model_load_error")
#: A bucket's keys and, in the same order, their states; ``due`` is when an open breaker closes for trial, in ms.
STATE = "backends array<string>, failures array<bigint>, seqs array<bigint>, opened array<boolean>, due array<bigint>"
CHANGES = "backend {0}, seq bigint, state string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def follow(failures: int, opened: bool, outcomes: list[tuple[int, bool, bool]], limit: int) -> tuple[int, bool, list[int]]:
    """Failures in a row and openness after ``(seq, ok, fatal)`` in order, and the attempts at which the breaker opened.

    One key, row by row: the plain form that ``follow_bucket`` is tested against.
    """
    at = []
    for seq, ok, fatal in outcomes:
        failures = 0 if ok else failures + 1
        if not opened and not ok and (fatal or failures >= limit):
            opened = True
            at.append(seq)
    return failures, opened, at


def follow_bucket(state: tuple, rows: pd.DataFrame, limit: int, cooling_ms: int, watermark: int) -> tuple[tuple | None, pd.DataFrame]:
    """State of a bucket after ``backend, seq, ok, fatal, at``, and ``backend, seq`` where breakers opened.

    Rows come in any order. The state is None if all of them were counted before.
    """
    backends, *columns = state
    code, names = pd.factorize(np.concatenate([np.array(backends, object), rows["backend"].to_numpy(object)]), use_na_sentinel=False)
    known, size = len(backends), len(names)  # the known keys come first and are distinct, so their codes are their places
    empty = (0, np.iinfo(np.int64).min, False, 0)
    failures, last, opened, due = (np.concatenate([np.array(c, t), np.full(size - known, e, t)]) for c, e, t in zip(columns, empty, ("i8", "i8", "?", "i8"), strict=True))

    key, seq = code[known:], rows["seq"].to_numpy("i8")
    order = np.lexsort((seq, key))
    key, seq = key[order], seq[order]
    new = seq > last[key]
    new[1:] &= (key[1:] != key[:-1]) | (seq[1:] != seq[:-1])
    order, key, seq = order[new], key[new], seq[new]
    if not len(key):
        return None, rows[["backend", "seq"]].iloc[:0]
    ok, fatal = rows["ok"].to_numpy("?")[order], rows["fatal"].to_numpy("?")[order]

    place = np.arange(len(key))
    starts = np.append(True, key[1:] != key[:-1])
    start = np.maximum.accumulate(np.where(starts, place, 0))
    good = np.maximum.accumulate(np.where(ok, place, -1))  # the last success so far, of this key if not before its start
    run = np.where(good >= start, place - good, place - start + 1 + failures[key])
    opens = np.flatnonzero(~opened[key] & ~ok & (fatal | (run >= limit)))
    opens = opens[np.unique(key[opens], return_index=True)[1]]  # the first of each key
    ends = np.append(np.flatnonzero(starts[1:]), len(key) - 1)
    failures[key[ends]], last[key[ends]] = run[ends], seq[ends]
    opened[key[opens]] = True
    due[key[opens]] = np.maximum(rows["at"].to_numpy("i8")[order[opens]] + cooling_ms, watermark + 1)
    names = [None if n is None or n != n else n for n in names.tolist()]
    after = (names, failures.tolist(), last.tolist(), opened.tolist(), due.tolist())
    return after, pd.DataFrame({"backend": pd.Series([names[k] for k in key[opens]], dtype=object), "seq": seq[opens]})


def soonest(state: tuple) -> int | None:
    """When the next open breaker of a bucket closes."""
    *_, opened, due = state
    return min((at for is_open, at in zip(opened, due, strict=True) if is_open), default=None)


class Breaker(StatefulProcessor):
    def __init__(self, limit: int, cooling_ms: int):
        self.limit, self.cooling_ms = limit, cooling_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breakers", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.state.get() or ([], [], [], [], []))
        new = pd.concat([r[["backend", "seq", "ok", "fatal", "at"]] for r in rows], ignore_index=True)
        after, opened = follow_bucket(before, new, self.limit, self.cooling_ms, timerValues.getCurrentWatermarkInMs())
        if after is None:
            return
        self.state.update(after)
        if len(opened):
            if soonest(after) != soonest(before):
                self.handle.registerTimer(soonest(after))
            yield opened.assign(state="open")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        backends, failures, seqs, opened, due = self.state.get()
        now = timerValues.getCurrentWatermarkInMs()
        trial = [i for i, is_open in enumerate(opened) if is_open and due[i] <= now]
        if not trial:
            return  # closed with an earlier timer of the bucket
        closed = set(trial)
        failures = [0 if i in closed else n for i, n in enumerate(failures)]
        opened = [is_open and i not in closed for i, is_open in enumerate(opened)]
        after = (backends, failures, seqs, opened, due)
        self.state.update(after)
        if soonest(after) is not None:
            self.handle.registerTimer(soonest(after))
        yield pd.DataFrame({"backend": pd.Series([backends[i] for i in trial], dtype=object), "seq": [seqs[i] for i in trial], "state": "trial"})

    def close(self) -> None:
        pass


def breaker_changes(outcomes: DataFrame, limit: int = 3, cooling: int = 600, late: str = "10 minutes", buckets: int = 1024) -> DataFrame:
    """``backend, seq, state`` (open or trial) for a stream ``backend, seq, ok, category, ts``; ``cooling`` in seconds.

    Rows of a key must come in the order of ``seq`` from batch to batch; inside a batch they may come in any order. How many
    rows of a bucket meet in a task is bounded by what a trigger reads. ``buckets`` is fixed with the checkpoint: a few hundred
    to thousands of keys each are cheap. A backend must be the same after a cast to a string and back.
    """
    ship_by_value(__name__)
    kind = outcomes.schema["backend"].dataType.simpleString()
    rows = outcomes.withWatermark("ts", late).select(
        F.pmod(F.xxhash64("backend"), F.lit(buckets)).alias("bucket"),
        F.col("backend").cast("string").alias("backend"),
        "seq",
        F.coalesce("ok", F.lit(False)).alias("ok"),
        F.coalesce(F.col("category").isin(*FATAL), F.lit(False)).alias("fatal"),
        F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("at"),
        "ts",
    )
    changes = rows.groupBy("bucket").transformWithStateInPandas(Breaker(limit, cooling * 1000), CHANGES.format("string"), "Append", "EventTime")
    return changes.select(F.col("backend").cast(kind).alias("backend"), "seq", "state")


def start_breaker(outcomes: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Append the changes to a Parquet table. The session needs the state store ``ROCKS``, which keeps timers."""
    return (
        breaker_changes(outcomes, **options)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
