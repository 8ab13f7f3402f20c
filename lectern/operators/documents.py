"""Raw documents by path, kept inside the data folder and the include patterns: one, or a DataFrame of paths in tasks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from lectern._workers import importable
from lectern.functions import text as fn
from lectern.sources import trees


class DocumentError(Exception):
    pass


def _read(open_tree, path: str, pattern: str) -> str:
    try:
        tree = open_tree()
        inside = tree.resolve(path)
    except (FileNotFoundError, NotADirectoryError):
        raise DocumentError(f"File not found: {path}") from None
    except PermissionError:
        raise DocumentError(f"Permission denied: {path}") from None
    except (OSError, RuntimeError, ValueError):
        raise DocumentError(f"Cannot access file: {path}") from None
    if inside is None:
        raise DocumentError("File path is outside the data directory")
    if not re.search(pattern, inside):
        raise DocumentError("File type not permitted")
    try:
        return tree.read(inside).decode("utf-8")
    except PermissionError:
        raise DocumentError(f"Permission denied: {path}") from None
    except (OSError, UnicodeDecodeError):
        raise DocumentError(f"Failed to read file: {path}") from None


def get_document(root: str, path: str, include, spark=None) -> str:
    """Text of a file under root that an include pattern selects. Excluded names stay readable.

    The root is whatever `discover` takes: a folder, or a URL (a session is needed for what only the JVM opens). Paths are relative to it or
    absolute; links on disks are followed and must end inside.
    """
    return _read(lambda: trees.portable(root) or trees.HadoopTree(spark, root), path, fn.any_glob(include, strict=False, fallback="**/*.md"))


def get_documents(paths: DataFrame, root: str, include, column: str = "path") -> DataFrame:
    """paths plus `document` and `error`, one of which is null: what `get_document` gives or says for each row.

    Tasks read the files, so the root has to be one that they can open (disks and object stores). A null path is not found.
    """
    tree = trees.portable(root)
    if tree is None:
        raise DocumentError(f"tasks cannot open {root}")
    importable(paths.sparkSession)
    pattern = fn.any_glob(include, strict=False, fallback="**/*.md")
    columns, place = paths.columns, paths.columns.index(column)

    def run(batches):
        for b in batches:
            # A row at a time: whole texts of a batch can be more than a task should hold.
            for i, path in enumerate(b.column(place).to_pylist()):
                text = said = None
                try:
                    if path is None:
                        raise DocumentError("File not found")
                    text = _read(lambda: tree, path, pattern)
                except DocumentError as e:
                    said = str(e)
                yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, pa.array([text], pa.string()), pa.array([said], pa.string())], [*columns, "document", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema)
    return paths.mapInArrow(run, f"{schema}, document string, error string")
