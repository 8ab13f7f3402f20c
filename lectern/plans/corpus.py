"""Markdown corpora derived from the test tables, the same projection in Spark and in DuckDB SQL."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern._workers import importable
from lectern.functions.identity import uuid5
from lectern.sources import trees

WEBHOOK_SECRET = "not-a-real-secret"
REPLENISH_SECONDS, BURST = 6 * 3600, 3

CORPUS_SQL = """
corpus AS (
    SELECT doc_id, 'docs/' || lang || '/' || source || '/' || doc_id || '.md' AS file_path,
        CASE WHEN doc_id % 7 <> 0 THEN 'Document ' || doc_id END AS title,
        CASE WHEN doc_id % 5 <> 0 THEN 'About ' || source END AS description,
        lang AS type, source AS domain, ['t' || (doc_id % 3), 'u' || (doc_id % 4)] AS tags,
        '## ' || replace(text, chr(10), chr(10) || chr(10) || '## ') AS body
    FROM documents)"""

STATE_SQL = """
state_before AS (
    SELECT file_path, CASE WHEN doc_id % 10 = 0 THEN 'stale' ELSE sha256(body) END AS content_hash, 1::BIGINT AS chunk_count
    FROM corpus WHERE doc_id % 10 <> 1
    UNION ALL SELECT 'docs/gone/' || i || '.md', 'x', 1 FROM range(5) t(i))"""

POINTS_SQL = """
points AS (
    SELECT vec_id, embedding, 'd' || label AS domain, 't' || (label % 3) AS type,
        ['t' || (vec_id % 3), 'u' || (vec_id % 4)] AS tags
    FROM embeddings)"""

TYPED_SQL = "typed AS (SELECT vec_id FROM embeddings)"

DELIVERIES_SQL = """
deliveries AS (
    SELECT event_id, '{"ref":"' || CASE event_id % 3 WHEN 0 THEN 'refs/heads/main' WHEN 1 THEN 'refs/heads/dev' ELSE 'main' END || '","id":' || event_id || '}' AS body
    FROM events)"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    return d.select(
        "doc_id",
        F.concat(F.lit("docs/"), "lang", F.lit("/"), "source", F.lit("/"), number, F.lit(".md")).alias("file_path"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("Document "), number)).alias("title"),
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("About "), "source")).alias("description"),
        F.col("lang").alias("type"),
        F.col("source").alias("domain"),
        F.array(F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")), F.concat(F.lit("u"), (F.col("doc_id") % 4).cast("string"))).alias("tags"),
        F.concat(F.lit("## "), F.replace("text", F.lit("\n"), F.lit("\n\n## "))).alias("body"),
    )


def state_before(spark: SparkSession, docs: DataFrame) -> DataFrame:
    have = docs.where(F.col("doc_id") % 10 != 1).select("file_path", F.when(F.col("doc_id") % 10 == 0, "stale").otherwise(F.sha2("body", 256)).alias("content_hash"), F.lit(1).cast("bigint").alias("chunk_count"))
    gone = spark.range(5).select(F.concat(F.lit("docs/gone/"), F.col("id").cast("string"), F.lit(".md")).alias("file_path"), F.lit("x").alias("content_hash"), F.lit(1).cast("bigint").alias("chunk_count"))
    return have.unionByName(gone)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    number = F.col("vec_id").cast("string")
    return e.select(
        "vec_id",
        uuid5(F.concat(F.lit("vec/"), number, F.lit("::0"))).alias("id"),
        F.col("embedding").alias("vector"),
        F.concat(F.lit("d"), F.col("label").cast("string")).alias("domain"),
        F.concat(F.lit("t"), (F.col("label") % 3).cast("string")).alias("type"),
        F.array(F.concat(F.lit("t"), (F.col("vec_id") % 3).cast("string")), F.concat(F.lit("u"), (F.col("vec_id") % 4).cast("string"))).alias("tags"),
    )


def stored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as an index run stores them, one for each vector: priorities are integers or strings, tags hold both, flags are booleans."""
    from lectern.plans.indexer import point_rows

    n = F.col("vec_id")
    quoted = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    fields = F.create_map(
        F.lit("priority"), F.when(n % 2 == 0, (n % 7).cast("string")).otherwise(quoted(n % 7)),
        F.lit("active"), (n % 3 == 0).cast("string"),
        F.lit("tags"), F.concat(F.lit("["), quoted(F.concat(F.lit("x"), (n % 5).cast("string"))), F.lit(","), quoted(F.concat(F.lit("u"), n.cast("string"))), F.lit(","), (n % 4).cast("string"), F.lit(",true]")),
    )
    chunk = F.array(F.struct(F.lit(0).cast("bigint").alias("chunk_index"), n.cast("string").alias("text"), F.lit(1).cast("bigint").alias("line_start"), F.lit(1).cast("bigint").alias("line_end")))
    files = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("vec/"), n.cast("string")).alias("file_path"), fields.alias("fields"), chunk.alias("chunks"))
    points = point_rows(files, ["file_path", "priority", "active", "tags"], _Unit(), 1)
    return points.withColumn("vec_id", F.col("text").cast("bigint"))


class _Unit:
    def embed(self, texts):
        return [[1.0]] * len(texts)


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id")


def write_tree(files: DataFrame, root: str) -> None:
    """Writes (path, body, link) as files below a folder that all tasks see; a link leads to a file beside the tree."""
    top = trees.portable(root).root

    def run(batches):
        for b in batches:
            for path, body, link in zip(*(c.to_pylist() for c in b.columns)):
                at = Path(top, path)
                at.parent.mkdir(parents=True, exist_ok=True)
                if link:  # put in one step, as a task may be tried again, or twice at a time
                    beside = at.with_name(f"{uuid.uuid4().hex}.new")
                    beside.symlink_to(top)
                    os.replace(beside, at)
                else:
                    at.write_bytes(body.encode())
            yield b.slice(0, 0).select(["path"])

    importable(files.sparkSession)
    files.mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


def deliveries(spark: SparkSession, sf_dir: str, secret: str = WEBHOOK_SECRET) -> DataFrame:
    from lectern.functions.identity import hmac_sha256

    e = read(spark, sf_dir, "events")
    ref = F.when(F.col("event_id") % 3 == 0, "refs/heads/main").when(F.col("event_id") % 3 == 1, "refs/heads/dev").otherwise("main")
    body = F.concat(F.lit('{"ref":"'), ref, F.lit('","id":'), F.col("event_id").cast("string"), F.lit("}"))
    d = e.select("event_id", body.alias("body"))
    good = hmac_sha256(secret, F.col("body"))
    return d.withColumn("signature", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("0"), F.substring(good, 2, 63))).otherwise(F.concat(F.lit("sha256="), good)))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^(https?://)", "$1user:tok@")).otherwise(F.col("url")).alias("url"))
