"""Points and state of a collection: merge-on-read Parquet tables under numbered versions.

An update writes what is new as segments, and for what it replaces deletion bitmaps of the old segments' files; no old row is written
again. Readers join the bitmaps where there are any. Segments of like size are merged once there are several, as are those that have lost
many rows, so a row is rewritten a logarithm of times. A version is one file that names everything (`versions`); a failed run leaves the old
one. Beside the points stands an index of the indexed fields: how many points of each file hold each value. Filters read the files it names, facets
are its sums; both follow from what an update adds and deletes, without a look at the other points.
"""

from __future__ import annotations

import logging
import math
import uuid
from collections import Counter
from collections.abc import Iterable, Mapping
from contextlib import AbstractContextManager
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern._workers import scope, scratch
from lectern.sources.versions import Conflict, StoreError, Versions

log = logging.getLogger(__name__)

STATE = "file_path string, content_hash string, chunk_count bigint, indexed_at timestamp"
RESERVED = ("file_path", "chunk_index", "text", "line_start", "line_end")  # payload keys that documents cannot set
POINT_COLUMNS = ("id", "vector", "payload", "file_path", "chunk_index", "text", "line_start", "line_end")
POINT = "id string, vector array<float>, payload string, file_path string, chunk_index bigint, text string, line_start bigint, line_end bigint"
KEYWORDS = "field string, kind string, value string, segment string, file string, n bigint"
LOOKUP = 1000  # paths up to which they are a filter of the scan; more are joined
MERGE = 8  # segments of like size that are merged into one ...
FACTOR = 4  # ... sizes being alike within such a factor
DEAD = 0.3  # share of a segment's rows from which it is written anew
ATTEMPTS = 5  # of a commit that others overtake
WAIT = 5.0  # seconds that a writer waits for the lock

#: Kinds of promoted columns: prefix, SQL type, type name of the JSON value.
SCALARS = (("s", "string", "STRING"), ("i", "bigint", "BIGINT"), ("b", "boolean", "BOOLEAN"))


class VectorStore(Protocol):
    """What an index run and a search need of a store; `Collection` is the one on Parquet."""

    def ensure(self, vector_size: int, indexed: list[str]) -> None: ...
    def exists(self) -> bool: ...
    def drop(self) -> None: ...
    def indexed(self) -> list[str]: ...
    def points(self, filters: Mapping[str, Any] | None = None) -> DataFrame: ...
    def facet(self, field: str, limit: int) -> DataFrame: ...
    def nearest(self, vector, k: int, filters: Mapping[str, Any] | None = None) -> DataFrame: ...
    def build_graph(self, least: float = 0.0) -> bool: ...
    def state(self) -> DataFrame: ...
    def count(self) -> int | None: ...
    def apply(self, fresh: DataFrame, stale: DataFrame, new_state: DataFrame, full: bool = False) -> int: ...
    def writing(self) -> AbstractContextManager: ...


# -- promoted columns ------------------------------------------------------------------------------

def promoted_names(field: str) -> dict[str, str]:
    """Column names of an indexed field and their types: one for each kind of scalar and of list element."""
    return {f"{p}_{field}": t for p, t, _ in SCALARS} | {f"{p}list_{field}": f"array<{t}>" for p, t, _ in SCALARS}


def promoted(field: str, raw: Column) -> list[Column]:
    """Columns of a field from the JSON of its value: each value and each element of a list by its own type; others are null."""
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(v)
    items = F.when(kind.startswith("ARRAY"), v.cast("array<variant>"))

    def elements(t: str, name: str) -> Column:
        own = F.filter(F.transform(items, lambda x: F.when(F.schema_of_variant(x) == name, x.cast(t))), lambda x: x.isNotNull())
        return F.when(F.size(own) > 0, own)

    return [F.when(kind == name, v.cast(t)).alias(f"{p}_{field}") for p, t, name in SCALARS] + [elements(t, name).alias(f"{p}list_{field}") for p, t, name in SCALARS]


def points_schema(indexed: Iterable[str]) -> str:
    """Points: id, vector, payload as JSON, the reserved keys and the promoted columns of each indexed field."""
    fields = [f"`{c}` {t}" for f in indexed if f != "file_path" for c, t in promoted_names(f).items()]
    return ", ".join([POINT, *fields])


# -- set operations on the two tables ------------------------------------------------------------

def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new, and those of old whose key new does not have."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new)


def delete_by_files(points: DataFrame, paths: DataFrame) -> DataFrame:
    """Points of other files; no paths delete nothing."""
    return points.join(paths.select("file_path").distinct(), "file_path", "left_anti").select(points.columns)


def upsert_state(state: DataFrame, new: DataFrame, now=None) -> DataFrame:
    """State with new (file_path, content_hash, chunk_count) rows, whose time is now."""
    stamped = new.select("file_path", "content_hash", F.col("chunk_count").cast("bigint").alias("chunk_count"), (F.current_timestamp() if now is None else F.lit(now).cast("timestamp")).alias("indexed_at"))
    return upsert(state, stamped, "file_path")


def delete_state(state: DataFrame, paths: DataFrame) -> DataFrame:
    return state.join(paths.select("file_path").distinct(), "file_path", "left_anti").select(state.columns)


# -- deletion bitmaps ------------------------------------------------------------------------------

def bitmaps(positions: DataFrame) -> DataFrame:
    """(file, bucket, bits): positions (file, pos) as bitmaps of 32,768 rows each."""
    at = F.col("pos") + 1
    return positions.groupBy("file", F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def not_in(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows (.., _file, _pos) whose bit no bitmap (file, bucket, bits) sets."""
    all_bits = deleted.groupBy("file", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    joined = rows.join(all_bits, (F.col("_file") == F.col("file")) & (F.bitmap_bucket_number(F.col("_pos") + 1) == F.col("bucket")), "left")
    bit = F.expr("shiftright(CAST(conv(hex(substring(bits, CAST(bitmap_bit_position(_pos + 1) div 8 + 1 AS INT), 1)), 16, 10) AS INT), CAST(bitmap_bit_position(_pos + 1) % 8 AS INT)) & 1")
    return joined.where(F.col("bits").isNull() | (bit == 0)).drop("file", "bucket", "bits")


# -- keyword index ---------------------------------------------------------------------------------

def keywords(points: DataFrame, indexed: Iterable[str]) -> DataFrame:
    """(field, kind, value, segment, file, n): how many of points (.., _segment, _file) hold each value of each indexed field, lists by element."""
    def entry_of(field: str, kind: str):
        return lambda v: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), v.cast("string").alias("value"))

    entries = []
    for f in indexed:
        if f == "file_path":
            continue
        for p, _, _ in SCALARS:
            entry = entry_of(f, p)
            if f"{p}_{f}" in points.columns:
                entries.append(F.array(entry(F.col(f"`{p}_{f}`"))))
            if f"{p}list_{f}" in points.columns:
                entries.append(F.coalesce(F.transform(F.array_distinct(F.col(f"`{p}list_{f}`")), entry), F.array().cast("array<struct<field:string,kind:string,value:string>>")))
    if not entries:
        return points.sparkSession.createDataFrame([], KEYWORDS)
    each = points.select("_segment", "_file", F.explode(F.concat(*entries)).alias("e")).where("e.value IS NOT NULL")
    return each.groupBy("e.field", "e.kind", "e.value", F.col("_segment").alias("segment"), F.col("_file").alias("file")).agg(F.count("*").alias("n"))


def sought(key: str, value: Any) -> tuple[str, list[str]] | None:
    """Kind and texts of the values that a filter accepts, as the index holds them; None where it does not know the type."""
    if isinstance(value, bool):
        return "b", [str(value).lower()]
    if isinstance(value, int):
        return "i", [str(value)]
    if isinstance(value, str):
        return "s", [value]
    return ("s", list(value)) if isinstance(value, (list, tuple)) and all(isinstance(v, str) for v in value) else None


# -- tables ----------------------------------------------------------------------------------------

class Collection:
    """A named set of points of one vector size, with its state table and its keyword index."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name, self.path = spark, name, f"{root.rstrip('/')}/{name}"
        self.versions = Versions(spark, self.path, f"collection {name}")

    def _have(self) -> dict:
        pointer = self.versions.latest()
        if pointer is None:
            raise StoreError(f"collection {self.name} does not exist")
        return pointer

    def exists(self) -> bool:
        return self.versions.latest() is not None

    def indexed(self) -> list[str]:
        return self._have()["indexed"]

    def ensure(self, vector_size: int, indexed: list[str]) -> None:
        """Creates the collection if it is not there; one of another vector size is an error. The distance is cosine."""
        have = self.versions.latest()
        if have is None:
            empty = {"segments": [], "deletes": []}
            try:
                return self.versions.put({"version": 0, "vector_size": vector_size, "distance": "cosine", "indexed": list(indexed), "used": [], "points": empty, "state": empty, "keywords": [], "old": []})
            except Conflict:
                have = self._have()
        if have["vector_size"] != vector_size:
            raise StoreError(f"collection {self.name} has vectors of {have['vector_size']}, not {vector_size}")

    def drop(self) -> None:
        """Removes the collection if it exists."""
        self.versions.delete(self.path)

    def writing(self, wait: float = WAIT):
        """The writer's lock, waited for. It spares others work that would be in vain; what keeps versions apart is the commit."""
        return self.versions.writing(wait)

    # -- reading -------------------------------------------------------------------------------------

    def _schema(self, pointer: dict, kind: str) -> str:
        return STATE if kind == "state" else points_schema(pointer["indexed"])

    def _scan(self, pointer: dict, kind: str, segments: Iterable[str] | None = None, files: Iterable[tuple[str, str]] | None = None, places: bool = False) -> DataFrame:
        """The rows of a table that no bitmap deletes: of some segments or files, or all; `places` adds _segment, _file and _pos."""
        table = pointer[kind]
        chosen = [s["id"] for s in table["segments"]] if segments is None else list(segments)
        touched = {i for d in table["deletes"] for i in d["segments"]}
        schema = self._schema(pointer, kind)
        paths: dict[bool, list[str]] = {False: [], True: []}
        for s, f in [(s, "") for s in chosen] if files is None else files:
            paths[s in touched].append(f"{self.path}/{s}" + (f"/{f}" if f else ""))
        out = None
        for dirty, some in paths.items():
            if not some:
                continue
            rows = self.spark.read.schema(schema).parquet(*some)
            own = rows.columns
            if dirty or places:
                segment = F.regexp_extract("_metadata.file_path", f"({kind}/[0-9a-f]+)/[^/]+$", 1)
                rows = rows.select("*", segment.alias("_segment"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_pos"))
            if dirty:
                rows = not_in(rows, self.spark.read.parquet(*[f"{self.path}/{d['id']}" for d in table["deletes"]]))
            rows = rows if places else rows.select(own)
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schema + (", _segment string, _file string, _pos bigint" if places else "")) if out is None else out

    def _index(self, pointer: dict) -> DataFrame:
        """The keyword index: what updates have added and deleted, of the segments that are in use."""
        live = [s["id"] for s in pointer["points"]["segments"]]
        if not pointer["keywords"] or not live:
            return self.spark.createDataFrame([], KEYWORDS)
        return self.spark.read.schema(KEYWORDS).parquet(*[f"{self.path}/{k}" for k in pointer["keywords"]]).where(F.col("segment").isin(live))

    def files_with(self, filters: Mapping[str, Any]) -> list[tuple[str, str]] | None:
        """(segment, file) of the files that hold a point for each filter by itself; None where the index cannot tell."""
        pointer = self._have()
        found: set[tuple[str, str]] | None = None
        for key, value in filters.items():
            wanted = sought(key, value)
            if wanted is None or key not in pointer["indexed"] or key == "file_path":
                continue
            kind, values = wanted
            own = self._index(pointer).where((F.col("field") == key) & (F.col("kind") == kind) & F.col("value").isin(values))
            rows = own.groupBy("segment", "file").agg(F.sum("n").alias("n")).where("n > 0").select("segment", "file").collect()  # no more than there are files
            found = {tuple(r) for r in rows} & (found if found is not None else {tuple(r) for r in rows})
        return None if found is None else sorted(found)

    def points(self, filters: Mapping[str, Any] | None = None) -> DataFrame:
        """All points, or at least those that meet the filters: files without any are not read. Of the promoted columns those that hold any value are there."""
        pointer = self._have()
        unused = {c for f in pointer["indexed"] if f != "file_path" for c in promoted_names(f)} - set(pointer["used"])
        files = self.files_with(filters) if filters else None
        return self._scan(pointer, "points", files=files).drop(*sorted(unused))

    def facet(self, field: str, limit: int) -> DataFrame:
        """(value, count) of the string values of an indexed field, as `search.facet`, from the index alone."""
        own = self._index(self._have()).where((F.col("field") == field) & (F.col("kind") == "s"))
        return own.groupBy("value").agg(F.sum("n").alias("count")).where("count > 0").orderBy(F.desc("count"), "value").limit(limit)

    def state(self) -> DataFrame:
        """All indexed files; order by file_path where it shows."""
        pointer = self.versions.latest()
        return self._scan(pointer, "state") if pointer else self.spark.createDataFrame([], STATE)

    def state_of(self, path: str):
        """The state of one file. Rows are in order of paths within files, so few row groups are read."""
        return self._scan(self._have(), "state").where(F.col("file_path") == path).first()

    def count(self) -> int | None:
        """Number of points, None without a collection."""
        pointer = self.versions.latest()
        return sum(s["rows"] - s["dead"] for s in pointer["points"]["segments"]) if pointer else None

    def nearest(self, vector, k: int, filters: Mapping[str, Any] | None = None) -> DataFrame:
        """The k points of highest cosine that meet the filters, without their vectors, with score and rank: by the graph, if there is one.

        What has come since it was built is scanned, what has gone is left out; where the graph finds fewer than k, all points are scanned.
        """
        from lectern.operators import graph, search

        pointer = self._have()
        built = pointer.get("graph")
        scan = lambda: search.top_k(self.points(filters), vector, k, filters).drop("vector")
        if not built or not k:
            return scan()
        have = [s["id"] for s in pointer["points"]["segments"]]
        old, fresh = ([i for i in have if (i in built["segments"]) == known] for known in (True, False))
        unused = {c for f in pointer["indexed"] if f != "file_path" for c in promoted_names(f)} - set(pointer["used"])
        rows = search.where_all(self._scan(pointer, "points", segments=old).drop(*unused), filters or {}).drop("vector")
        more = k if filters else 2 * k + 16  # some may have gone
        found = graph.search(self.spark.read.schema(graph.GRAPH).parquet(f"{self.path}/{built['id']}"), vector, more, rows.select("id") if filters else None)
        found = [(r["id"], r["score"]) for r in found.orderBy(F.desc("score"), "id").limit(more).collect()]
        hits = rows.where(F.col("id").isin([i for i, _ in found])).join(F.broadcast(self.spark.createDataFrame(found, "id string, score double")), "id") if found else None
        if fresh:
            own = search.top_k(self._scan(pointer, "points", segments=fresh).drop(*unused), vector, k, filters).drop("vector", "rank")
            hits = own if hits is None else hits.select(own.columns).unionByName(own)
        if hits is None or hits.limit(k).count() < k:
            return scan()
        return search.ranked(hits, k)

    def build_graph(self, least: float = 0.0) -> bool:
        """Builds the graph of all points, if more than a share `least` of them is in none. Whether it did."""
        from lectern.operators import graph

        pointer, self._made = self._have(), []
        segments = pointer["points"]["segments"]
        known = set((pointer.get("graph") or {}).get("segments", ()))
        new, total = (sum(s["rows"] - s["dead"] for s in some) for some in ([s for s in segments if s["id"] not in known], segments))
        if not total or new <= least * total:
            return False
        name = self._new("graph")
        graph.build(self._scan(pointer, "points"), count=total).write.parquet(f"{self.path}/{name}")
        for _ in range(ATTEMPTS):  # others may go on meanwhile: the graph is of the segments that it names
            if self._put(pointer, {"graph": {"id": name, "segments": [s["id"] for s in segments]}}) is not None:
                return True
            pointer = self._have()
        self.versions.delete(f"{self.path}/{name}")
        return False

    # -- writing -------------------------------------------------------------------------------------

    def _new(self, what: str) -> str:
        self._made.append(f"{what}/{uuid.uuid4().hex}")
        return self._made[-1]

    def _write(self, kind: str, rows: DataFrame, flags: Iterable[str] = ()) -> tuple[list[dict], set[str]]:
        """Rows as a new segment, if there are any, and those of the columns `flags` that hold values."""
        name, flags = self._new(kind), list(flags)
        # Rebalancing makes files of a good size and keeps a path's rows together.
        rows.hint("rebalance", "file_path").sortWithinPartitions("file_path").write.parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")
        got = written.agg(F.count(F.lit(1)).alias("rows"), *[F.bool_or(F.col(f"`{c}`").isNotNull()).alias(f"f{i}") for i, c in enumerate(flags)]).first()
        if not got["rows"]:
            self.versions.delete(f"{self.path}/{self._made.pop()}")
            return [], set()
        return [{"id": name, "rows": got["rows"], "dead": 0}], {c for i, c in enumerate(flags) if got[f"f{i}"]}

    def _write_keywords(self, rows: DataFrame) -> list[str]:
        name = self._new("keywords")
        rows.hint("rebalance", "field", "value").sortWithinPartitions("field", "kind", "value").write.parquet(f"{self.path}/{name}")
        return [name]

    def _delete(self, pointer: dict, kind: str, gone: DataFrame, few: list[str] | None) -> tuple[dict, DataFrame | None]:
        """The table without the rows of the paths in `gone`, and the rows that go, with their places and promoted columns."""
        table = pointer[kind]
        rows = self._scan(pointer, kind, places=True)
        promoted = [c for c in rows.columns if kind == "points" and c not in POINT_COLUMNS and not c.startswith("_")]
        rows = rows.where(F.col("file_path").isin(few)) if few is not None else rows.join(gone, "file_path", "left_semi")
        at = scratch(self.spark, "gone")
        rows.select("_segment", "_file", "_pos", *[F.col(f"`{c}`") for c in promoted]).write.parquet(at)
        hit = self.spark.read.parquet(at)
        dead = {r[0]: r[1] for r in hit.groupBy("_segment").count().collect()}  # no more than there are segments
        if not dead:
            return table, None
        name = self._new(f"{kind}-deleted")
        bitmaps(hit.select(F.col("_file").alias("file"), F.col("_pos").alias("pos"))).write.parquet(f"{self.path}/{name}")
        segments = [s | {"dead": s["dead"] + dead.get(s["id"], 0)} for s in table["segments"]]
        return {"segments": segments, "deletes": [*table["deletes"], {"id": name, "segments": sorted(dead)}]}, hit

    def apply(self, fresh: DataFrame, stale: DataFrame, new_state: DataFrame, full: bool = False) -> int:
        """One update: points and state of the stale files go, fresh points and new state (file_path, content_hash, chunk_count) come.

        Files of new_state are stale too. What is written is in proportion to the update; a full update replaces everything. `fresh` is
        evaluated once, however often other writers are first. Returns the version.
        """
        with scope():
            return self._apply(fresh, stale, new_state, full)

    def _apply(self, fresh: DataFrame, stale: DataFrame, new_state: DataFrame, full: bool) -> int:
        at = scratch(self.spark, "stale")
        stale.select("file_path").unionByName(new_state.select("file_path")).distinct().write.parquet(at)
        gone = self.spark.read.schema("file_path string").parquet(at)
        some = [r[0] for r in gone.limit(LOOKUP + 1).collect()]
        few = some if len(some) <= LOOKUP else None

        def deleted(pointer: dict) -> dict:
            if full:
                return {k: {"segments": [], "deletes": []} for k in ("points", "state")} | {"keywords": [], "used": []}
            points, hit = self._delete(pointer, "points", gone, few)
            state, _ = self._delete(pointer, "state", gone, few)
            less = self._write_keywords(keywords(hit, pointer["indexed"]).withColumn("n", -F.col("n"))) if hit is not None and len(pointer["indexed"]) else []
            return {"points": points, "state": state, "keywords": [*pointer["keywords"], *less], "used": pointer["used"]}

        stamped = upsert_state(self.spark.createDataFrame([], STATE), new_state)
        return self._replace(deleted, fresh, stamped)

    def commit(self, points: DataFrame, state: DataFrame) -> int:
        """Replaces both tables as a whole."""
        return self._replace(lambda _: {k: {"segments": [], "deletes": []} for k in ("points", "state")} | {"keywords": [], "used": []}, points, state)

    def _replace(self, deleted, points: DataFrame, state: DataFrame) -> int:
        """Commits points and state on top of what `deleted` leaves of a version, of the newest one if others commit meanwhile."""
        self._made: list[str] = []
        try:
            pointer = self._have()
            columns = [c for f in pointer["indexed"] if f != "file_path" for c in promoted_names(f)]
            new_points, used = self._write("points", points, columns)
            new_state, _ = self._write("state", state)
            words = self._write_keywords(keywords(self._scan({**pointer, "points": {"segments": new_points, "deletes": []}}, "points", places=True), pointer["indexed"])) if new_points and columns else []
            for attempt in range(ATTEMPTS):
                made = list(self._made)
                left = deleted(pointer)
                tables = {k: left[k] | {"segments": [*left[k]["segments"], *new]} for k, new in (("points", new_points), ("state", new_state))}
                version = self._put(pointer, tables | {"keywords": [*left["keywords"], *words], "used": sorted({*left["used"], *used})})
                if version is not None:
                    break
                for x in self._made[len(made) :]:  # bitmaps of a version that is no longer the newest
                    self.versions.delete(f"{self.path}/{x}")
                self._made, pointer = made, self._have()
            else:
                raise StoreError(f"collection {self.name}: other writers were first {ATTEMPTS} times")
        except BaseException:
            for x in self._made:
                self.versions.delete(f"{self.path}/{x}")
            raise
        self.compact()
        return version

    def _put(self, pointer: dict, change: dict) -> int | None:
        """The version after pointer, or None if another has it. Folders that the last version but one used go."""
        new = pointer | change
        new["version"] = pointer["version"] + 1
        new["old"] = sorted(_folders(pointer) - _folders(new))
        try:
            self.versions.put(new)
        except Conflict:
            return None
        for folder in pointer["old"]:  # readers may still be at the last version's files, not at those before
            self.versions.delete(f"{self.path}/{folder}")
        return new["version"]

    def compact(self, full: bool = False) -> bool:
        """Merges segments of like size, and writes those anew that have lost many rows; `full` makes one segment of all. Whether there was anything to do.

        If another writer is first, nothing changes: the next update tries again.
        """
        pointer, self._made, change = self._have(), [], {}
        for kind in ("points", "state"):
            table = pointer[kind]
            alike = Counter(_size(s) for s in table["segments"])
            chosen = [s for s in table["segments"] if s["dead"] > DEAD * s["rows"] or alike[_size(s)] >= MERGE or full and (len(table["segments"]) > 1 or s["dead"])]
            if not chosen:
                continue
            ids = {s["id"] for s in chosen}
            merged, _ = self._write(kind, self._scan(pointer, kind, segments=sorted(ids)))
            kept = [s for s in table["segments"] if s["id"] not in ids]
            deletes = [d for d in ({**d, "segments": [i for i in d["segments"] if i not in ids]} for d in table["deletes"]) if d["segments"]]
            change[kind] = {"segments": [*kept, *merged], "deletes": deletes}
        if "points" in change or len(pointer["keywords"]) > MERGE or full and len(pointer["keywords"]) > 1:
            after = pointer | change
            own = self._index(after)
            fresh = [s for s in after["points"]["segments"] if s not in pointer["points"]["segments"]]
            if fresh and any(f != "file_path" for f in pointer["indexed"]):
                own = own.unionByName(keywords(self._scan({**after, "points": {"segments": fresh, "deletes": []}}, "points", places=True), pointer["indexed"]))
            sums = own.groupBy("field", "kind", "value", "segment", "file").agg(F.sum("n").alias("n")).where("n <> 0")
            change["keywords"] = self._write_keywords(sums)
        if not change:
            return False
        if self._put(pointer, change) is None:
            for x in self._made:
                self.versions.delete(f"{self.path}/{x}")
        return True

    def clear(self) -> None:
        """No points and no state, the collection stays."""
        self.commit(self.points_of_none(), self.spark.createDataFrame([], STATE))

    def points_of_none(self) -> DataFrame:
        return self.spark.createDataFrame([], points_schema(self.indexed()))


def _size(segment: dict) -> int:
    return int(math.log(max(1, segment["rows"] - segment["dead"]), FACTOR))


def _folders(pointer: dict) -> set[str]:
    """Everything that a version names."""
    tables = [pointer[k] for k in ("points", "state")]
    graph = [pointer["graph"]["id"]] if pointer.get("graph") else []
    return {x["id"] for t in tables for part in ("segments", "deletes") for x in t[part]} | {*pointer["keywords"], *graph}
