"""Discovery and reading of Markdown files as a DataFrame.

Folders are listed by a data source whose partitions are folders: planning looks at the upper levels until there are enough folders
to deal out, and keeps their names only; tasks walk what is below, and yield paths. There is no list of files on the driver.
Symbolic links are skipped, and names that begin with _ or . are names like others, on disks and stores alike. What only
the JVM can open is listed from the driver, in portions that are written as a table.
"""

from __future__ import annotations

import json
import logging
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lectern._workers import importable, scratch
from lectern.config import Indexing
from lectern.functions import text as fn
from lectern.sources import trees

log = logging.getLogger(__name__)

PORTION = 10_000  # paths in a batch
PORTION_BYTES = 32 << 20  # of contents that the driver reads at a time, where only it can
BATCH, BATCH_BYTES = 1000, 1 << 20  # files, and characters of their contents, from which a task sends a batch


# -- what is selected ------------------------------------------------------------------------------

class Selection:
    """The settings' choice of files, by name and relative path."""

    def __init__(self, indexing: Indexing):
        self.include, self.exclude, self.names = fn.any_glob(indexing.include), fn.any_glob(indexing.exclude), set(indexing.exclude_files)

    def __call__(self, path: str) -> bool:
        if posixpath.basename(path) in self.names or not (self.include and re.search(self.include, path)):
            return False
        return not (self.exclude and re.search(self.exclude, path))


def select_paths(paths: DataFrame, indexing: Indexing, column: str = "file_path") -> DataFrame:
    """The same selection over a DataFrame of relative paths."""
    c = F.col(column)
    keep = fn.matches_any(c, indexing.include) & ~fn.file_name(c).isin(list(indexing.exclude_files))
    return paths.where(keep & ~fn.matches_any(c, indexing.exclude))


# -- listing ---------------------------------------------------------------------------------------

def walk(tree, selected, folder: str = "", deep: bool = True) -> Iterator[str]:
    """Selected files of a folder and, if deep, of those below. A folder that cannot be read is an error."""
    folders = [folder]
    while folders:
        at = folders.pop()
        for name, kind in tree.entries(at):
            path = f"{at}/{name}" if at else name
            if kind == trees.LINK:
                log.warning("skipping symbolic link %s", path)
            elif kind == trees.FOLDER and deep:
                folders.append(path)
            elif kind == trees.FILE and selected(path):
                yield path


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool


def dealt(tree, least: int) -> list[Folder]:
    """Folders that hold every file once: upper ones by themselves, and at least so many with all that is below, if there are so many."""
    upper, level = [], [""]
    while level and len(level) < least:
        below = []
        for at in level:
            below += [f"{at}/{name}" if at else name for name, kind in tree.entries(at) if kind == trees.FOLDER]
        upper += level
        level = below
    return [Folder(p, False) for p in upper] + [Folder(p, True) for p in level]


class Listing(DataSource):
    """Format `files_below`: the paths (file_path) below option `root`; `indexing` has the patterns as JSON, `folders` how many to deal out."""

    @classmethod
    def name(cls) -> str:
        return "files_below"

    def schema(self) -> str:
        return "file_path string"

    def reader(self, schema) -> DataSourceReader:
        patterns = json.loads(self.options.get("indexing", "{}"))
        return ListingReader(trees.portable(self.options["root"]), Indexing(**{k: tuple(v) for k, v in patterns.items()}), int(self.options.get("folders", 64)))


class ListingReader(DataSourceReader):
    def __init__(self, tree, indexing: Indexing, folders: int):
        self.tree, self.indexing, self.folders = tree, indexing, folders

    def partitions(self) -> list[Folder]:
        return dealt(self.tree, self.folders)

    def read(self, partition: Folder):
        paths: list[str] = []
        for p in walk(self.tree, Selection(self.indexing), partition.path, partition.deep):
            paths.append(p)
            if len(paths) == PORTION:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["file_path"])
                paths = []
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["file_path"])


def _patterns(indexing: Indexing) -> str:
    return json.dumps({k: list(getattr(indexing, k)) for k in ("include", "exclude", "exclude_files")})


def _portions(rows: Iterator[tuple], size) -> Iterator[list[tuple]]:
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= 1:
            yield held
            held, total = [], 0
    if held:
        yield held


def _written(spark: SparkSession, rows: Iterator[tuple], schema: str, size) -> DataFrame:
    """A table of rows that the driver makes, some of them at a time."""
    at = scratch(spark, "listing")
    spark.createDataFrame([], schema).write.parquet(at)
    for some in _portions(rows, size):
        spark.createDataFrame(some, schema).write.mode("append").parquet(at)
    return spark.read.schema(schema).parquet(at)


def discover(spark: SparkSession, root: str, indexing: Indexing | None = None) -> DataFrame:
    """(file_path) of all selected files, sorted. The root is a folder, its file: URL, or the URL of a store. It has to exist."""
    indexing, tree = indexing or Indexing(), trees.tree(spark, root)
    next(iter(tree.entries("")), None)  # a root that cannot be read is an error now, and not when the plan runs
    if isinstance(tree, trees.HadoopTree):
        paths = ((p,) for p in walk(tree, Selection(indexing)))
        return _written(spark, paths, "file_path string", lambda _: 1 / PORTION).orderBy("file_path")
    importable(spark)
    spark.dataSource.register(Listing)
    folders = max(64, 4 * spark.sparkContext.defaultParallelism)
    found = spark.read.format("files_below").option("root", root).option("indexing", _patterns(indexing)).option("folders", folders).load()
    return found.orderBy("file_path")


# -- reading ---------------------------------------------------------------------------------------

def load(spark: SparkSession, found: DataFrame, root: str, indexing: Indexing | None = None) -> DataFrame:
    """(file_path, content, and what else `found` has) of the files that `discover` found under a root."""
    return read(found, root)


def _text(path: str, data: bytes) -> str | None:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        log.error("%s is not UTF-8: %s", path, e)
        return None


def _contents(tree, paths) -> Iterator[tuple[int, str, str]]:
    """(place among the paths, path, content)"""
    for i, p in enumerate(paths):
        try:
            content = _text(p, tree.read(p))
        except OSError as e:
            log.error("cannot read %s: %s", p, e)
            continue
        if content is not None:
            yield i, p, content


def read(files: DataFrame, root: str) -> DataFrame:
    """(file_path, content, and what else `files` has) of readable UTF-8 files; what cannot be read or decoded is logged and left out."""
    spark = files.sparkSession
    tree = trees.portable(root)
    more = [c for c in files.columns if c != "file_path"]
    if tree is None:
        hadoop = trees.HadoopTree(spark, root)
        rows = ((p, c) for _, p, c in _contents(hadoop, (r[0] for r in files.select("file_path").toLocalIterator())))
        texts = _written(spark, rows, "file_path string, content string", lambda r: len(r[1]) / PORTION_BYTES + 1 / PORTION)
        return texts.join(files, "file_path").select("file_path", "content", *more) if more else texts

    def run(batches):
        for b in batches:
            for some in _portions(_contents(tree, b.column(0).to_pylist()), lambda r: len(r[2]) / BATCH_BYTES + 1 / BATCH):
                places, paths, contents = zip(*some)
                own = b.take(pa.array(places, pa.int64())).columns[1:]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.string()), *own], ["file_path", "content", *more])

    importable(spark)
    # Paths are small and their contents are not: dealt out by number, not by size, and by a hash of its own, as after a join by path
    # the exchange would be left out and the join's, which AQE makes as few as there are bytes of paths, would deal instead.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = ", ".join(["file_path string, content string", *[f"`{c}` {files.schema[c].dataType.simpleString()}" for c in more]])
    return files.select("file_path", *more).repartition(tasks, F.xxhash64("file_path")).mapInArrow(run, schema)
