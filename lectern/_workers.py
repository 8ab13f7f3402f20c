"""Python workers that can import this package, and folders that driver and executors share.

Where executors do not see the package's folder, install it there or pass it with --py-files.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])

_local: list[str] = []
_used: list[tuple[SparkSession, str, int]] = []


def importable(spark: SparkSession) -> None:
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), ROOT]))


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(f"file://{tempfile.mkdtemp(prefix='lectern-')}")
    return _local[0]


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is written there goes with the `scope` around the call, or when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _used.append((spark, path, threading.get_ident()))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope():
    """Scratch paths that this thread makes inside go at the end."""
    before = list(_used)
    try:
        yield
    finally:
        for x in [x for x in _used if x not in before and x[2] == threading.get_ident()]:
            _used.remove(x)
            _remove(*x[:2])


@atexit.register
def _sweep() -> None:
    for spark, path, _ in _used:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone by now; the files are scratch
            return
