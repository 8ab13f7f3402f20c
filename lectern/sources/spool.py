"""Webhook deliveries on disk: written before they are answered, read as a stream with offsets.

A delivery is a file that has the next number for a name; a hard link gives it that name, so writers in several processes never share one. The
stream's offset is a number, kept by its checkpoint: what came while no query ran is read when one starts, once.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lectern._workers import importable
from lectern.sources import trees

RANGE = 256  # deliveries that a task reads


class Spool:
    """A folder, or its file: URL, that the service and the tasks see."""

    def __init__(self, folder: str):
        tree = trees.portable(folder)
        if not isinstance(tree, trees.LocalTree):
            raise ValueError("a spool has to be a folder on a disk that all see")
        self.folder = tree.root

    def numbers(self) -> Iterator[int]:
        try:
            with os.scandir(self.folder) as found:
                yield from (int(e.name[:-5]) for e in found if e.name.endswith(".json") and e.name[:-5].isdigit())
        except FileNotFoundError:
            return

    def path(self, number: int) -> str:
        return os.path.join(self.folder, f"{number:020d}.json")

    def append(self, body: str, signature: str | None) -> int:
        """Keeps a delivery; its number. It is on disk when this returns."""
        os.makedirs(self.folder, exist_ok=True)
        fresh = os.path.join(self.folder, f"{uuid.uuid4().hex}.new")
        with open(fresh, "w", encoding="utf-8") as f:
            json.dump({"body": body, "signature": signature}, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            number = max(self.numbers(), default=0)
            while True:
                number += 1
                try:
                    os.link(fresh, self.path(number))
                    return number
                except FileExistsError:
                    continue
        finally:
            os.unlink(fresh)

    def read(self, number: int) -> tuple[int, str, str | None] | None:
        try:
            with open(self.path(number), encoding="utf-8") as f:
                d = json.load(f)
        except FileNotFoundError:
            return None
        return number, d["body"], d["signature"]

    def forget(self, before: int) -> None:
        """Removes what a stream has done with. The file `before` itself stays, so that numbers go on."""
        for n in list(self.numbers()):
            if n < before:
                os.unlink(self.path(n))


@dataclass
class Numbers(InputPartition):
    first: int
    last: int


class Deliveries(DataSource):
    """Format `spooled_deliveries`: (number, body, signature) of the spool in option `folder`, as a stream."""

    @classmethod
    def name(cls) -> str:
        return "spooled_deliveries"

    def schema(self) -> str:
        return "number bigint, body string, signature string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return DeliveriesReader(Spool(self.options["folder"]))


class DeliveriesReader(DataSourceStreamReader):
    def __init__(self, spool: Spool):
        self.spool, self.last = spool, 0

    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        self.last = max(self.spool.numbers(), default=self.last)
        return {"number": self.last}

    def partitions(self, start: dict, end: dict) -> list[Numbers]:
        # What is there, not what the numbers allow: long ago ones are gone.
        found = sorted(n for n in self.spool.numbers() if start["number"] < n <= end["number"])
        return [Numbers(found[k], found[min(k + RANGE, len(found)) - 1]) for k in range(0, len(found), RANGE)]

    def read(self, partition: Numbers):
        for n in range(partition.first, partition.last + 1):
            if (found := self.spool.read(n)) is not None:
                yield found

    def commit(self, end: dict) -> None:
        self.spool.forget(end["number"])


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """The deliveries of a spool as a streaming DataFrame."""
    importable(spark)
    spark.dataSource.register(Deliveries)
    return spark.readStream.format("spooled_deliveries").option("folder", folder).load()
