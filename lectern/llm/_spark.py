"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern._workers import importable

ARROW_ROWS = 256  # rows of whole texts in one Arrow batch: bounds a Python worker's memory

_written: list[tuple] = []
_local: dict[str, str | None] = {}


def session_for_texts(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small, and lets Python workers import this package.

    Plans read the batch size when they run, after the operator has returned, so it stays set for the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    importable(spark)


def tidy(spark: SparkSession) -> None:
    """Between rounds of a long operator: plans that are done go, and with them their shuffle files and broadcasts.

    Spark removes those once the driver's garbage collector finds the plan gone, by itself every half hour only.
    """
    gc.collect()
    spark._jvm.System.gc()


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local.setdefault("root", None) or f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        _local["root"] = root
    return root


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    That ends its lineage, and survives lost executors. The files go when the `Scope` around the call
    ends, or else when the driver's Python does.
    """
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


class Scope:
    """Tables that `cut` writes inside go at the end; what a call returns of them goes through `keep`."""

    def __enter__(self) -> Scope:
        self.begin, self.kept = len(_written), []
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """Cuts df into a table that outlives this scope."""
        out = cut(df)
        self.kept.append(_written[-1])
        return out

    def __exit__(self, *_) -> None:
        mine = _written[self.begin :]
        _written[self.begin :] = self.kept
        for x in mine:
            if x not in self.kept:
                _remove(*x)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone by now; the files are scratch
            return
