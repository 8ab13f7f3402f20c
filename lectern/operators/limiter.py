"""Token bucket per key as a scan over each key's requests in time order (batch form)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern._workers import importable


def admitted(requests: DataFrame, key: str, at: str, order: str, burst: int, replenish_seconds: float) -> DataFrame:
    """(key, order, accepted) of requests: `burst` at once, one more every `replenish_seconds`; rejected ones cost nothing.

    Theoretical arrival time: a request at t is accepted if max(tat, t) + T - t <= burst * T. Keys are
    spread by hash and sorted by Spark, which spills; the scan holds one Arrow batch and one number, however many requests
    a key has. Null keys are one key; a request without a time is rejected.
    """
    T = int(round(replenish_seconds * 1_000_000))
    importable(requests.sparkSession)
    kind = {c: requests.schema[c].dataType.simpleString() for c in (key, order)}
    rows = requests.select(F.col(key).alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(order).alias("o"))

    def scan(batches):
        last, tat = [], None  # no key is a list
        for b in batches:
            accepted = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != last:
                    last, tat = k, None
                if t is None:
                    accepted.append(False)
                    continue
                after = (t if tat is None or tat < t else tat) + T
                accepted.append(after - t <= burst * T)
                if accepted[-1]:
                    tat = after
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(accepted, pa.bool_())], [key, order, "accepted"])

    return rows.repartition("k").sortWithinPartitions("k", "t", "o").mapInArrow(scan, f"`{key}` {kind[key]}, `{order}` {kind[order]}, accepted boolean")
