"""Token bucket per key over a stream: one number of state for each key, dropped when idle.

A micro-batch may hold any number of requests of one key: they are sorted outside of memory.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from contextlib import ExitStack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from lectern._workers import importable

IDLE_MS = 60_000
HELD = 1 << 20  # requests of one key's micro-batch in memory, sixteen bytes each
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sorted(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    both = np.stack([np.concatenate(x).astype(np.int64) for x in zip(*parts)], axis=1)
    return both[np.lexsort((both[:, 1], both[:, 0]))]


def in_order(parts: Iterable[tuple[np.ndarray, np.ndarray]], most: int = HELD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows (at, order) of all parts in order, some at a time. At most `most` are held: the rest waits in sorted runs on the task's disk."""
    held, n, runs = [], 0, []
    with ExitStack() as files:
        for p in parts:
            for a in range(0, len(p[0]), most):
                held.append((p[0][a : a + most], p[1][a : a + most]))
                n += len(held[-1][0])
                if n >= most:
                    run = files.enter_context(tempfile.TemporaryFile())
                    _sorted(held).tofile(run)
                    runs.append((run, n))
                    held, n = [], 0
        if not runs:
            if held:
                yield tuple(_sorted(held).T)
            return
        if held:
            run = files.enter_context(tempfile.TemporaryFile())
            _sorted(held).tofile(run)
            runs.append((run, n))
        piece = max(1, most // len(runs))
        read = lambda run: np.fromfile(run, np.int64, 2 * piece).reshape(-1, 2)
        for run, _ in runs:
            run.seek(0)
        heads = [read(run) for run, _ in runs]
        while any(len(h) for h in heads):
            # What is no later than the first of the pieces' last rows can go: whatever is still on disk is later.
            last = min(tuple(h[-1].tolist()) for h in heads if len(h))
            ready, rest = [], []
            for h in heads:
                k = int(np.searchsorted(h[:, 0], last[0], "left"))
                k += int(np.searchsorted(h[k : np.searchsorted(h[:, 0], last[0], "right"), 1], last[1], "right"))
                ready.append((h[:k, 0], h[:k, 1]))
                rest.append(h[k:])
            yield tuple(_sorted(ready).T)
            heads = [h if len(h) else read(run) for h, (run, _) in zip(rest, runs)]


class TokenBucket(StatefulProcessor):
    """Rows (key, at in microseconds, order) to (key, order, accepted); theoretical arrival times as in the batch form."""

    def __init__(self, burst: int, replenish_us: int, idle_ms: int | None):
        self.burst, self.replenish, self.idle = burst, replenish_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("tat", LongType())])
        self.tat = handle.getValueState("tat", schema, ttlDurationMs=self.idle) if self.idle else handle.getValueState("tat", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tat = self.tat.get()[0] if self.tat.exists() else None
        for at, order in in_order((p["at"].to_numpy(), p["order"].to_numpy()) for p in rows):
            accepted = []
            for t in at.tolist():
                nxt = (t if tat is None else max(tat, t)) + self.replenish
                ok = nxt - t <= self.burst * self.replenish
                accepted.append(ok)
                if ok:
                    tat = nxt
            yield pd.DataFrame({"key": key[0], "order": order, "accepted": accepted})
        if tat is not None:
            self.tat.update((tat,))

    def close(self) -> None:
        pass


def admit(requests: DataFrame, burst: int, replenish_seconds: float, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """(key, order, accepted) of a streaming DataFrame (key bigint, at bigint in microseconds, order bigint).

    idle_ms is how long the state of a silent key stays; None keeps it, which replays of old events need.
    With idle_ms streams of the session that start later run no batches without rows: a query over processing
    time would ask for one after the other and never end under availableNow. State goes with the next rows.
    """
    spark = requests.sparkSession
    importable(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if idle_ms:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    schema = StructType([StructField("key", LongType()), StructField("order", LongType()), StructField("accepted", BooleanType())])
    bucket = TokenBucket(burst, int(round(replenish_seconds * 1_000_000)), idle_ms)
    return requests.groupBy("key").transformWithStateInPandas(bucket, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if idle_ms else "None")
