"""Index runs and metadata refreshes driven by streams.

Deliveries that arrive together cause one run. Runs of one query follow each other, and the
collection's lock keeps other writers out.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import webhook

log = logging.getLogger(__name__)


def on_deliveries(deliveries: DataFrame, run: Callable[[], object], provider: str, secret: str, branch: str, checkpoint: str, update: Callable[[], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query over deliveries (body, signature): per micro-batch the source is updated and `run` called once if any row triggers.

    A failing update or run is logged; the next delivery tries again.
    """

    def batch(df: DataFrame, number: int) -> None:
        if webhook.outcomes(df, provider, secret, branch).where("triggered").isEmpty():
            return
        try:
            if update:
                update()
            run()
        except Exception:
            log.exception("reindex of batch %s failed", number)

    return deliveries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


class Instructions:
    """Text that a periodic query keeps fresh; readers see the last good one."""

    def __init__(self, text: str):
        self.text = text

    def refresh(self, make: Callable[[], str]) -> None:
        try:
            self.text = make()
        except Exception:
            log.exception("metadata refresh failed")


def refresh_every(spark, seconds: int, make: Callable[[], str], into: Instructions) -> StreamingQuery:
    """Refreshes `into` on a timer; stop() the query to end it. The least interval is 10 seconds."""
    if seconds < 10:
        raise ValueError("the refresh interval must be at least 10 seconds")
    into.refresh(make)
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda df, n: into.refresh(make)).trigger(processingTime=f"{seconds} seconds").start()
