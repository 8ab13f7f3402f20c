"""The incremental index run as one plan over discovered files and stored state.

files LEFT JOIN state decides per file (skip, invalid, empty, ready), ready files become
chunk rows with vectors, and the next snapshot is the old one without changed and gone files plus
the new rows. Nothing is visible before the pointer moves.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern._workers import scope, scratch
from lectern.config import Config
from lectern.functions.identity import content_hash, point_id
from lectern.operators import chunking, frontmatter
from lectern.operators.embedding import Embedder, embed
from lectern.sources import discovery, store

log = logging.getLogger(__name__)

GRAPH_AGE = 0.2  # share of points in no graph from which it is built again


class ValidationFailed(RuntimeError):
    pass


def join_state(files: DataFrame, state: DataFrame, full: bool = False, hash_column: str = "content_hash") -> DataFrame:
    """files (file_path, hash) plus `was_indexed` and `changed`: new, of another hash, or all in a full run."""
    return _compared(_with_state(files, state), full, hash_column)


def _with_state(files: DataFrame, state: DataFrame) -> DataFrame:
    """files with the path and hash that the state has of them, if any."""
    old = state.select(F.col("file_path").alias("_sp"), F.col("content_hash").alias("_sh"))
    return files.join(old, F.col("file_path") == F.col("_sp"), "left")


def _compared(joined: DataFrame, full: bool, hash_column: str = "content_hash") -> DataFrame:
    same = F.col(hash_column).eqNullSafe(F.col("_sh")) & F.col("_sp").isNotNull()
    return joined.withColumn("was_indexed", F.col("_sp").isNotNull()).withColumn("changed", F.lit(True) if full else ~same).drop("_sp", "_sh")


def orphans(state: DataFrame, discovered: DataFrame) -> DataFrame:
    """State rows of files that discovery no longer finds."""
    return state.join(discovered.select("file_path").distinct(), "file_path", "left_anti")


def outcome(changed, valid, n_chunks):
    """skipped, invalid, empty or ready."""
    return F.when(~changed, "skipped").when(~valid, "invalid").when(n_chunks == 0, "empty").otherwise("ready")


def plan(found: DataFrame, state: DataFrame, config: Config, full: bool = False, root: str = "") -> DataFrame:
    """One row per readable file of those found (file_path): file_path, hash, was_indexed, outcome, errors, fields, chunks.

    Paths meet the state before files are read, so contents are in no shuffle, and each file is read once. Only changed files are
    parsed, linted and chunked: the content of the others is null from here on.
    """
    files = discovery.load(found.sparkSession, _with_state(found, state), root, config.indexing)
    hashed = _compared(files.withColumn("content_hash", content_hash(F.col("content"))), full)
    work = hashed.withColumn("content", F.when(F.col("changed"), F.col("content")))
    if config.validation.enabled:
        checked = frontmatter.validate(frontmatter.parse(work), config.frontmatter, config.validation, root)
    else:  # the raw file, frontmatter included, and no description
        checked = work.withColumn("body", F.col("content")).withColumn("fields", F.create_map().cast("map<string,string>")).withColumn("errors", F.array().cast("array<string>")).withColumn("valid", F.lit(True))
    described = checked.withColumn("description", frontmatter.string_field(F.col("fields"), "description"))
    chunked = chunking.chunk(described.withColumn("body", F.when(F.col("valid"), F.col("body")).otherwise("")), config.chunking)
    own = lambda c, none: F.when(F.col("changed"), F.col(c)).otherwise(none.cast(chunked.schema[c].dataType)).alias(c)
    said = outcome(F.col("changed"), F.col("valid"), F.size("chunks")).alias("outcome")
    return chunked.select("file_path", "content_hash", "was_indexed", said, own("errors", F.array()), own("fields", F.create_map()), own("chunks", F.array()))


def point_rows(ready: DataFrame, indexed: list[str], embedder: Embedder, size: int) -> DataFrame:
    """Points of ready files: id, vector, payload (JSON, reserved keys win), the indexed fields promoted to typed columns."""
    rows = ready.select("file_path", "fields", F.explode("chunks").alias("c")).select("file_path", "fields", "c.*")
    plain = F.map_filter("fields", lambda k, _: ~k.isin(list(store.RESERVED)))
    quoted = lambda k: F.regexp_extract(F.to_json(F.struct(k.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    pairs = F.transform(F.array_sort(F.map_entries(plain)), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"]))
    reserved = F.to_json(F.struct("file_path", "chunk_index", "text", "line_start", "line_end"))
    body = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit(","), F.expr("substring(_reserved, 2)"))).otherwise(F.col("_reserved"))
    rows = rows.withColumn("_reserved", reserved).withColumn("payload", body).drop("_reserved").withColumn("id", point_id(F.col("file_path"), F.col("chunk_index")))
    fields = [x for x in indexed if x != "file_path"]
    rows = rows.select("*", *[c for f in fields for c in store.promoted(f, F.col("fields")[f])])
    vectors = embed(rows.drop("fields"), embedder, "text", "vector", size)
    return vectors.select("id", "vector", "payload", "file_path", "chunk_index", "text", "line_start", "line_end", *[F.col(f"`{c}`") for f in fields for c in store.promoted_names(f)])


@dataclass(frozen=True)
class Summary:
    discovered: int
    indexed: int
    skipped: int
    invalid: int
    orphans: int
    chunks: int


def run_index(spark: SparkSession, config: Config, embedder: Embedder, full: bool = False, collection: store.VectorStore | None = None) -> Summary:
    """One index run into a store, the configured collection if none is given. Any failure leaves the previous version in place."""
    root, size = config.source.data_path, config.embedding.vector_size
    collection = collection or store.Collection(spark, config.qdrant.url, config.qdrant.collection)
    collection.ensure(size, config.indexed_fields())
    with collection.writing(), scope():
        found = discovery.discover(spark, root, config.indexing).persist()  # listed once
        state = collection.state()
        try:
            at = scratch(spark, "planned")
            planned = plan(found, state, config, full, root)
            planned.write.parquet(at)  # each file is read and validated once
            planned = spark.read.schema(planned.schema).parquet(at)
            counts = {r["outcome"]: r["count"] for r in planned.groupBy("outcome").count().collect()}
            if counts.get("invalid"):
                for r in planned.where("outcome = 'invalid'").orderBy("file_path").select("file_path", "errors").toLocalIterator():
                    log.error("%s: %s", r[0], ", ".join(r[1]))
                if config.validation.strict:
                    first = planned.where("outcome = 'invalid'").orderBy("file_path").select("file_path").first()[0]
                    raise ValidationFailed(f"{counts['invalid']} invalid files, {first} the first; all are in the log")
            ready = planned.where("outcome = 'ready'")
            gone = orphans(state, found)
            n_gone = gone.count()
            fresh = point_rows(ready, collection.indexed(), embedder, size)
            new_state = ready.select("file_path", "content_hash", F.size("chunks").cast("bigint").alias("chunk_count"))
            n_chunks = new_state.agg(F.coalesce(F.sum("chunk_count"), F.lit(0))).first()[0]
            if counts.get("ready") or n_gone or full:
                collection.apply(fresh, gone, new_state, full)
                if config.qdrant.graph:
                    collection.build_graph(GRAPH_AGE)
            n_found = found.count()
        finally:
            found.unpersist()
        return Summary(n_found, counts.get("ready", 0), counts.get("skipped", 0), counts.get("invalid", 0), n_gone, n_chunks)
