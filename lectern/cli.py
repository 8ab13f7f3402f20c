"""Command line: index, validate, status, search, document, health, serve."""

from __future__ import annotations

import argparse
import json
import os
import sys
import urllib.error
import urllib.request

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern import config as settings
from lectern import server
from lectern.operators import documents, frontmatter, search
from lectern.operators.embedding import HashingEmbedder, HttpEmbedder
from lectern.plans import indexer
from lectern.sources import discovery, store, trees


def embedder_of(config: settings.Config):
    """The configured endpoint, or the offline hashing embedder for the URL `hashing:`."""
    e = config.embedding
    return HashingEmbedder(e.vector_size) if e.base_url == "hashing:" else HttpEmbedder(e.base_url, e.model, e.api_key, e.batch_size)


def validate(spark, config, out=print) -> int:
    """Reports invalid files; an error only if there are some and validation is strict."""
    found = discovery.discover(spark, config.source.data_path, config.indexing)
    files = discovery.load(spark, found, config.source.data_path, config.indexing)
    checked = frontmatter.validate(frontmatter.parse(files), config.frontmatter, config.validation, config.source.data_path)
    report = found.join(checked.select("file_path", "valid", "errors"), "file_path", "left").select("file_path", F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("errors", F.array(F.lit("Failed to read file"))).alias("errors")).persist()
    for r in report.where("NOT valid").orderBy("file_path").toLocalIterator():
        out(f"{r['file_path']}: {'; '.join(r['errors'])}")
    counts = frontmatter.summary(report).first()
    report.unpersist()
    out(f"{counts['valid']} valid, {counts['invalid']} invalid")
    return int(bool(counts["invalid"]) and config.validation.strict)


def status(spark, config, out=print) -> int:
    collection = store.Collection(spark, config.qdrant.url, config.qdrant.collection)
    state = collection.state()
    out(f"State: {state.count()} indexed files")
    for r in state.orderBy("file_path").toLocalIterator():
        out(f"  {r['file_path']} (chunks: {r['chunk_count']}, hash: {r['content_hash'][:12]}..., at: {r['indexed_at']})")
    n = collection.count()
    out(f"Collection '{collection.name}': " + ("does not exist" if n is None else f"{n} points"))
    return 0


def find(spark, config, request: search.SearchRequest) -> str:
    collection = store.Collection(spark, config.qdrant.url, config.qdrant.collection)
    return search.find(collection, embedder_of(config), request)


def check_health(url: str, out=print) -> int:
    try:
        with urllib.request.urlopen(url, timeout=10) as r:
            body, good = json.load(r), True
    except urllib.error.HTTPError as e:
        body, good = json.loads(e.read() or b"{}"), False
    except OSError as e:
        out(f"unreachable: {e}")
        return 1
    out(f"status: {body.get('status')}")
    for name, part in sorted((k, v) for k, v in body.items() if isinstance(v, dict)):
        out(f"  {name}: {part.get('status')}" + (f" ({part['error']})" if part.get("error") else ""))
    return 0 if good else 1


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lectern")
    p.add_argument("--config", default=os.environ.get("LECTERN_CONFIG", "config.yaml"))
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("--full", action="store_true")
    sub.add_parser("validate")
    sub.add_parser("status")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--domain")
    s.add_argument("--type")
    s.add_argument("--tag", action="append")
    s.add_argument("--limit", type=int)
    sub.add_parser("document").add_argument("path")
    sub.add_parser("health").add_argument("--url", default="http://127.0.0.1:8001/health")
    sub.add_parser("serve")
    a = p.parse_args(argv)
    if a.command == "health":
        return check_health(a.url)
    config = settings.load(a.config)
    if a.command == "document":
        opens = trees.portable(config.source.data_path)
        print(documents.get_document(config.source.data_path, a.path, config.indexing.include, None if opens else SparkSession.builder.getOrCreate()))
        return 0
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    if a.command == "index":
        print(indexer.run_index(spark, config, embedder_of(config), a.full))
        return 0
    if a.command == "serve":
        return server.serve(spark, config, embedder_of(config))
    if a.command == "search":
        print(find(spark, config, search.SearchRequest(a.query, a.domain, a.type, a.tag, a.limit)))
        return 0
    return {"validate": validate, "status": status}[a.command](spark, config)


if __name__ == "__main__":
    sys.exit(main())
