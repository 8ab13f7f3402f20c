"""Folders of files wherever they are: on a local or mounted disk, in an object store, or behind Hadoop's file systems.

`LocalTree` and `ArrowTree` travel to tasks, which list and read by themselves. `HadoopTree` serves the schemes that only
the JVM knows (viewfs and the like) from the driver.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

FILE, FOLDER, LINK, OTHER = "file", "folder", "link", "other"
ARROW_SCHEMES = {"s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss"}


class TreeError(OSError):
    """Something other than a missing file or a lack of rights."""


class LocalTree:
    def __init__(self, root: str):
        self.root = root

    def _at(self, path: str) -> str:
        return os.path.join(self.root, path) if path else self.root

    def entries(self, folder: str) -> Iterator[tuple[str, str]]:
        """(name, kind) of what is in a folder. One that cannot be read is an error."""
        with os.scandir(self._at(folder)) as found:
            for e in found:
                kind = LINK if e.is_symlink() else FOLDER if e.is_dir() else FILE if e.is_file() else OTHER
                yield os.fsencode(e.name).decode("utf-8", "replace"), kind

    def read(self, path: str) -> bytes:
        with open(self._at(path), "rb") as f:
            return f.read()

    def resolve(self, path: str) -> str | None:
        """The path below the root that a path, relative or absolute, leads to through all links; None if it leads out of the root."""
        base = os.path.realpath(self.root, strict=True)
        real = os.path.realpath(os.path.join(base, path), strict=True)
        return os.path.relpath(real, base).replace(os.sep, "/") if real == base or real.startswith(base.rstrip(os.sep) + os.sep) else None


def _inside(path: str, *roots: str) -> str | None:
    """A path below a root, without `.` and `..`; None if it leads out. Stores have no links, so names decide."""
    for r in roots:
        if path == r or path.startswith(r.rstrip("/") + "/"):
            path = path[len(r) :]
            break
    else:
        if "://" in path or path.startswith("/"):
            return None
    parts: list[str] = []
    for p in path.split("/"):
        if p == "..":
            if not parts:
                return None
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


class ArrowTree:
    """An object store or HDFS through Arrow's file systems, which tasks open by the URL."""

    def __init__(self, url: str):
        scheme, rest = url.split("://", 1)
        self.root, self.url = url, f"{ARROW_SCHEMES.get(scheme, scheme)}://{rest}"
        self._fs = None

    def __getstate__(self):
        return {"root": self.root, "url": self.url, "_fs": None}

    def _open(self):
        if self._fs is None:
            from pyarrow import fs

            self._fs = fs.FileSystem.from_uri(self.url)
        return self._fs

    def _at(self, path: str) -> str:
        base = self._open()[1].rstrip("/")
        return f"{base}/{path}" if path else base

    def entries(self, folder: str) -> Iterator[tuple[str, str]]:
        from pyarrow import fs

        kinds = {fs.FileType.File: FILE, fs.FileType.Directory: FOLDER}
        for e in self._open()[0].get_file_info(fs.FileSelector(self._at(folder))):
            yield e.base_name, kinds.get(e.type, OTHER)

    def read(self, path: str) -> bytes:
        with self._open()[0].open_input_stream(self._at(path)) as f:
            return f.read()

    def resolve(self, path: str) -> str | None:
        from pyarrow import fs

        inside = _inside(path, self.root, self.url)
        if inside is not None and self._open()[0].get_file_info(self._at(inside)).type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        return inside


class HadoopTree:
    """What only the JVM's file systems reach. Lives on the driver."""

    def __init__(self, spark, url: str):
        self.jvm, self.root = spark._jvm, url
        path = self.jvm.org.apache.hadoop.fs.Path(url)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        uri = self.fs.makeQualified(path).toUri()
        self.scheme, self.authority, self.top = uri.getScheme(), uri.getAuthority(), (uri.getPath() or "").rstrip("/")
        self.base = f"{self.scheme}://{self.authority or ''}{self.top}"

    def _path(self, path: str):
        # Of three parts, so that names with colons or blanks stay names.
        return self.jvm.org.apache.hadoop.fs.Path(self.scheme, self.authority, (f"{self.top}/{path}" if path else self.top) or "/")

    def entries(self, folder: str) -> Iterator[tuple[str, str]]:
        found = self._call(lambda: self.fs.listStatusIterator(self._path(folder)), folder)
        while found.hasNext():
            s = found.next()
            kind = LINK if s.isSymlink() else FOLDER if s.isDirectory() else FILE if s.isFile() else OTHER
            yield s.getPath().getName(), kind

    def read(self, path: str) -> bytes:
        def run():
            stream = self.fs.open(self._path(path))
            try:
                return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()

        return self._call(run, path)

    def resolve(self, path: str) -> str | None:
        inside = _inside(path, self.root, self.base)
        if inside is not None and not self._call(lambda: self.fs.exists(self._path(inside)), path):
            raise FileNotFoundError(path)
        return inside

    def _call(self, run, path: str):
        from py4j.protocol import Py4JJavaError

        try:
            return run()
        except Py4JJavaError as e:
            name = e.java_exception.getClass().getSimpleName()
            kind = {"FileNotFoundException": FileNotFoundError, "AccessControlException": PermissionError, "AccessDeniedException": PermissionError}.get(name, TreeError)
            raise kind(f"{path}: {e.java_exception.getMessage()}") from None


def portable(root: str) -> LocalTree | ArrowTree | None:
    """The tree of a root that tasks can open by themselves, or None. A folder and its file: URL are the same tree."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", root)
    scheme = found.group(1).lower() if found else ""
    if scheme == "file":
        return LocalTree(unquote(urlsplit(root).path) if "%" in root else re.sub(r"^file:(//[^/]*)?", "", root))
    if scheme in ARROW_SCHEMES and "://" in root:
        return ArrowTree(root)
    return None if "://" in root else LocalTree(root)


def tree(spark, root: str):
    return portable(root) or HadoopTree(spark, root)
