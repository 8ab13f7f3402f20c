"""Registered queries of the engine's operators over the test tables, each with its SQL oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern._workers import scratch
from lectern.config import Chunking
from lectern.functions import identity, text, vectors
from lectern.operators import chunking, frontmatter, graph, limiter, search, webhook
from lectern.plans import corpus as data
from lectern.plans import indexer
from lectern.sources import store

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register



_DOTS = "list_dot_product(p.embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v)))"


def _topk_sql(where: str, k: int) -> str:
    return f"""WITH {data.POINTS_SQL}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
    SELECT p.vec_id, round({_DOTS}, 6) AS score, row_number() OVER (ORDER BY {_DOTS} DESC, p.vec_id)::BIGINT AS rank
    FROM points p, q {where} ORDER BY rank LIMIT {k}"""


def _shown(best: DataFrame) -> DataFrame:
    return best.select("vec_id", F.round("score", 6).alias("score"), "rank")


# -- search ------------------------------------------------------------------------------------

@_query(_topk_sql("", 10))
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.top_k(data.points(spark, sf_dir), data.query_vector(spark, sf_dir), search.resolve_limit(None), id_col="vec_id"))


@_query(_topk_sql("WHERE p.domain = 'd3' AND p.type = 't0'", 25))
def search_filtered(spark, sf_dir):
    return _shown(search.top_k(data.points(spark, sf_dir), data.query_vector(spark, sf_dir), search.resolve_limit(25), {"domain": "d3", "type": "t0"}, id_col="vec_id"))


@_query(_topk_sql("WHERE list_has_any(p.tags, ['t1', 'u2'])", 50))
def search_tags_any(spark, sf_dir):
    return _shown(search.top_k(data.points(spark, sf_dir), data.query_vector(spark, sf_dir), search.resolve_limit(1_000_000), {"tags": ["t1", "u2"]}, id_col="vec_id"))


@_query(f"""SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
    SELECT q.query_id, p.vec_id, {_DOTS} AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY {_DOTS} DESC, p.vec_id)::BIGINT AS rank
    FROM embeddings p, (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0) q) WHERE rank <= 10""")
def search_batch(spark, sf_dir):
    p = data.points(spark, sf_dir)
    queries = p.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("qv"))
    return search.top_k_batch(p, queries, 10, id_col="vec_id").select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@_query(f"""WITH {data.POINTS_SQL}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
    r AS (SELECT p.*, {_DOTS} AS score, row_number() OVER (ORDER BY {_DOTS} DESC, p.vec_id)::BIGINT AS rank FROM points p, q ORDER BY rank LIMIT 10)
    SELECT rank, '## Result ' || rank || chr(10) || '**Title**: ' || CASE WHEN vec_id % 2 = 0 THEN 'Vector ' || vec_id ELSE '(untitled)' END || chr(10)
        || '**Score**: ' || printf('%.4f', score) || chr(10) || '**File**: vec/' || vec_id || ' (lines 1–' || (vec_id + 1) || ')' || chr(10)
        || '**Domain**: ' || domain || chr(10) || '**Type**: ' || type || chr(10) || '**Tags**: ' || array_to_string(tags, ', ') || chr(10)
        || chr(10) || substr(repeat('word ', (vec_id % 200)::BIGINT + 1), 1, 400) || CASE WHEN ((vec_id % 200) + 1) * 5 > 400 THEN '...' ELSE '' END || chr(10) || chr(10) AS rendered
    FROM r""")
def search_rendered(spark, sf_dir):
    best = search.top_k(data.points(spark, sf_dir), data.query_vector(spark, sf_dir), 10, id_col="vec_id")
    n = F.col("vec_id")
    rows = best.withColumn("title", F.when(n % 2 == 0, F.concat(F.lit("Vector "), n.cast("string")))).withColumn("file_path", F.concat(F.lit("vec/"), n.cast("string")))
    rows = rows.withColumn("line_start", F.lit(1)).withColumn("line_end", n + 1).withColumn("text", F.expr("repeat('word ', CAST(vec_id % 200 AS INT) + 1)"))
    return search.rendered(rows).select("rank", "rendered")


@_query(f"""WITH {data.POINTS_SQL} SELECT 'domain' AS field, domain AS value, count(*)::BIGINT AS count FROM points GROUP BY domain
    UNION ALL SELECT 'type', type, count(*) FROM points GROUP BY type""")
def facet_values(spark, sf_dir):
    p = data.points(spark, sf_dir)
    return reduce(DataFrame.unionByName, [search.facet(p, f).select(F.lit(f).alias("field"), "value", "count") for f in ("domain", "type")])


@_query(f"WITH {data.POINTS_SQL} SELECT value, count(*)::BIGINT AS count FROM (SELECT unnest(tags) AS value FROM points) GROUP BY value")
def facet_tags(spark, sf_dir):
    return search.facet(data.points(spark, sf_dir), "tags")


@_query(f"""WITH {data.POINTS_SQL}, f AS (
        SELECT 1 AS i, 'domain' AS field, domain AS value, count(*) AS n FROM points GROUP BY domain
        UNION ALL SELECT 2, 'type', type, count(*) FROM points GROUP BY type
        UNION ALL SELECT 3, 'tags', value, count(*) FROM (SELECT unnest(tags) AS value FROM points) GROUP BY value),
    l AS (SELECT i, chr(10) || 'Available ' || field || ': ' || string_agg(value, ', ' ORDER BY n DESC, value) AS line FROM f GROUP BY i, field)
    SELECT 'Base.' || string_agg(line, '' ORDER BY i) AS text FROM l""")
def instructions(spark, sf_dir):
    return search.instructions(data.points(spark, sf_dir), ["domain", "type", "tags", "file_path"], "Base.")


@_query(" UNION ALL ".join(f"SELECT '{n}' AS requested, * FROM ({_topk_sql('', k)})" for n, k in (("none", 10), ("0", 0), ("3", 3), ("1000000", 50))))
def search_limits(spark, sf_dir):
    """Ten by default, fifty at most, none at all for a limit of 0."""
    p, q = data.points(spark, sf_dir), data.query_vector(spark, sf_dir)
    best = [_shown(search.top_k(p, q, search.resolve_limit(n), id_col="vec_id")).withColumn("requested", F.lit("none" if n is None else str(n))) for n in (None, 0, 3, 1_000_000)]
    return reduce(DataFrame.unionByName, best)


@_query("""WITH w AS (SELECT vec_id, unnest(['term' || (vec_id % 3), 'item' || (vec_id % 5), 'term' || (vec_id % 3)]) AS word FROM embeddings),
    h AS (SELECT vec_id, md5(word) AS h FROM w),
    v AS (SELECT vec_id, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT % 16 AS slot, sum(CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE) AS x FROM h GROUP BY ALL),
    n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY vec_id)
    SELECT vec_id, slot::BIGINT AS slot, round(x / n, 5) AS value FROM v JOIN n USING (vec_id) WHERE x <> 0""")
def embedded_words(spark, sf_dir):
    """Texts through an embedder; words count whatever their case."""
    from lectern.operators.embedding import HashingEmbedder, embed

    n = F.col("vec_id")
    said = F.concat(F.lit("Term"), (n % 3).cast("string"), F.lit(" ITEM"), (n % 5).cast("string"), F.lit(" term"), (n % 3).cast("string"))
    rows = embed(data.read(spark, sf_dir, "embeddings").select("vec_id", said.alias("text")), HashingEmbedder(16), size=16)
    slots = rows.select("vec_id", F.posexplode("vector").alias("slot", "value")).where("value <> 0")
    return slots.select("vec_id", F.col("slot").cast("bigint").alias("slot"), F.round(F.col("value").cast("double"), 5).alias("value"))


@_query()
def graph_search(spark, sf_dir):
    """Single searches by graphs, without and with a filter; the tests hold them against all points."""
    p, q = data.points(spark, sf_dir), data.query_vector(spark, sf_dir)
    at = scratch(spark, "graph")
    graph.build(p).write.parquet(at)  # once for all searches
    built = spark.read.schema(graph.GRAPH).parquet(at)
    found = [(n, graph.top_k(built, p, q, 10, f)) for n, f in (("all", None), ("t1", {"type": "t1"}), ("any", {"tags": ["t1", "u2"]}))]
    return reduce(DataFrame.unionByName, [_shown(best).withColumn("name", F.lit(n)) for n, best in found])


# -- stored points: typed filters and facets --------------------------------------------------------

@_query(f"WITH {data.TYPED_SQL} SELECT vec_id FROM typed WHERE vec_id % 2 = 0 AND vec_id % 7 = 3")
def stored_integer(spark, sf_dir):
    """An integer filter matches integers only, not the strings of the same digits."""
    return search.where_all(data.stored_points(spark, sf_dir), {"priority": 3}).select("vec_id")


@_query(f"WITH {data.TYPED_SQL} SELECT vec_id FROM typed WHERE vec_id % 2 = 1 AND vec_id % 7 = 3")
def stored_string(spark, sf_dir):
    return search.where_all(data.stored_points(spark, sf_dir), {"priority": "3"}).select("vec_id")


@_query(f"WITH {data.TYPED_SQL} SELECT vec_id FROM typed WHERE vec_id % 3 = 0 AND vec_id % 5 IN (1, 2)")
def stored_boolean(spark, sf_dir):
    return search.where_all(data.stored_points(spark, sf_dir), {"active": True, "tags": ["x1", "x2"]}).select("vec_id")


@_query(f"WITH {data.TYPED_SQL} SELECT vec_id FROM typed WHERE vec_id % 4 = 2")
def stored_list_element(spark, sf_dir):
    """Elements of a list match by their own type, too."""
    return search.where_all(data.stored_points(spark, sf_dir), {"tags": 2}).select("vec_id")


@_query(f"""WITH {data.TYPED_SQL}, f AS (
        SELECT 'priority' AS field, (vec_id % 7)::VARCHAR AS value FROM typed WHERE vec_id % 2 = 1
        UNION ALL SELECT 'tags', 'x' || (vec_id % 5) FROM typed
        UNION ALL SELECT 'tags', 'u' || vec_id FROM typed),
    n AS (SELECT field, value, count(*)::BIGINT AS count FROM f GROUP BY field, value),
    r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY count DESC, value) AS k FROM n)
    SELECT field, value, count FROM r WHERE k <= 50""")
def stored_facets(spark, sf_dir):
    """Strings only, 50 values of a field at most: `tags` has far more."""
    p = data.stored_points(spark, sf_dir)
    return reduce(DataFrame.unionByName, [search.facet(p, f).select(F.lit(f).alias("field"), "value", "count") for f in ("priority", "active", "tags")])


@_query(f"WITH {data.TYPED_SQL} SELECT vec_id, CASE WHEN vec_id % 2 = 1 THEN (vec_id % 7)::VARCHAR END AS priority, 'x' || (vec_id % 5) || ',u' || vec_id AS tags FROM typed")
def payload_strings(spark, sf_dir):
    """Strings read from payloads; values and elements of other types are left out."""
    shown = text.json_string(F.col("payload"), "$.priority"), F.array_join(text.json_strings(F.col("payload"), "$.tags"), ",")
    return data.stored_points(spark, sf_dir).select("vec_id", shown[0].alias("priority"), shown[1].alias("tags"))


# -- identity and text ---------------------------------------------------------------------------

@_query("SELECT doc_id, sha256(text) AS content_hash, left(sha256(text), 12) AS short_hash FROM documents")
def content_hash(spark, sf_dir):
    h = identity.content_hash(F.col("text"))
    return data.read(spark, sf_dir, "documents").select("doc_id", h.alias("content_hash"), F.left(h, F.lit(12)).alias("short_hash"))


@_query(f"""WITH {data.CORPUS_SQL}, h AS (SELECT doc_id, sha1(unhex('{identity.NAMESPACE}') || encode(file_path || '::' || (doc_id % 5))) AS h FROM corpus)
    SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def point_id(spark, sf_dir):
    return data.corpus(spark, sf_dir).select("doc_id", identity.point_id(F.col("file_path"), F.col("doc_id") % 5).alias("point_id"))


@_query("SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END AS snippet, strlen(text)::BIGINT AS n_bytes FROM documents")
def snippet(spark, sf_dir):
    return data.read(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"), text.byte_length(F.col("text")).cast("bigint").alias("n_bytes"))


@_query("""WITH u AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^(https?://)', '\\1user:tok@') ELSE url END AS url FROM pages)
    SELECT page_id, regexp_replace(url, '(https?://)[^/@]+@', '\\1***@', 'g') AS redacted, regexp_replace(url, '^(https?://)', '\\1s3cret$@') AS injected FROM u""")
def redact_urls(spark, sf_dir):
    u = data.urls(spark, sf_dir)
    return u.select("page_id", text.redact_urls(F.col("url")).alias("redacted"), text.inject_token(F.col("url"), "s3cret$").alias("injected"))


_GLOBS = {"include": ["docs/{en,de}/**/*.md", "docs/fr/src?/*"], "exclude": ["docs/*/src1/**", "docs/**/*[05].md"], "names": ["7.md", "11.md"]}


@_query(f"""WITH {data.CORPUS_SQL} SELECT file_path FROM corpus
    WHERE regexp_matches(file_path, '^docs/(en|de)/(.*/)?.*\\.md$|^docs/fr/src./.*$') AND NOT regexp_matches(file_path, '^docs/.*/src1/.*$|^docs/(.*/)?.*[05]\\.md$')
    AND list_last(string_split(file_path, '/')) NOT IN ('7.md', '11.md')""")
def select_paths(spark, sf_dir):
    from lectern.config import Indexing
    from lectern.sources.discovery import select_paths as select

    rules = Indexing(tuple(_GLOBS["include"]), tuple(_GLOBS["exclude"]), tuple(_GLOBS["names"]))
    return select(data.corpus(spark, sf_dir).select("file_path"), rules)


# -- sections and chunks ------------------------------------------------------------------------------

_SECTIONS_SQL = f"""{data.CORPUS_SQL},
    lines AS (SELECT file_path, description, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM corpus),
    marked AS (SELECT *, (starts_with(line, '#') AND coalesce(max(CASE WHEN trim(line) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1)::INT AS b FROM lines),
    ruled AS (SELECT *, sum(b) OVER (PARTITION BY file_path ORDER BY n) AS s FROM marked),
    sections AS (SELECT file_path, any_value(description) AS description, row_number() OVER (PARTITION BY file_path ORDER BY s) AS sec,
        ltrim(string_agg(line, chr(10) ORDER BY n), chr(10)) AS text, min(n)::BIGINT AS line_start, max(n)::BIGINT AS line_end FROM ruled GROUP BY file_path, s HAVING bool_or(trim(line) <> ''))"""


@_query(f"WITH {_SECTIONS_SQL} SELECT file_path, sec::BIGINT AS sec, text, line_start, line_end FROM sections")
def sections(spark, sf_dir):
    d = data.corpus(spark, sf_dir)
    return d.select("file_path", F.posexplode(chunking.sections(F.col("body"))).alias("p", "s")).select("file_path", (F.col("p") + 1).cast("bigint").alias("sec"), "s.*")


_WHOLE = Chunking(max_chunk_size=1 << 30, target_chunk_size=1000)  # no section is over this maximum
_PACKED_SQL = f"""WITH RECURSIVE {_SECTIONS_SQL},
    sized AS (SELECT *, strlen(trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS size, strlen(text) AS whole FROM sections),
    fold AS (
        SELECT file_path, description, sec, 1 AS g, text AS cur, line_start, line_end FROM sized WHERE sec = 1
        UNION ALL
        SELECT s.file_path, s.description, s.sec,
            CASE WHEN strlen(trim(f.cur, ' ' || chr(10) || chr(9) || chr(13))) + 2 + s.size <= 1000 THEN f.g ELSE f.g + 1 END,
            CASE WHEN strlen(trim(f.cur, ' ' || chr(10) || chr(9) || chr(13))) + 2 + s.size <= 1000 THEN f.cur || chr(10) || chr(10) || s.text ELSE s.text END,
            CASE WHEN strlen(trim(f.cur, ' ' || chr(10) || chr(9) || chr(13))) + 2 + s.size <= 1000 THEN f.line_start ELSE s.line_start END, s.line_end
        FROM fold f JOIN sized s ON s.file_path = f.file_path AND s.sec = f.sec + 1),
    chunks AS (SELECT file_path, any_value(description) AS description, g - 1 AS chunk_index, arg_max(cur, sec) AS text, min(line_start) AS line_start, max(line_end) AS line_end FROM fold GROUP BY file_path, g)"""


@_query(f"{_PACKED_SQL} SELECT file_path, chunk_index::BIGINT AS chunk_index, text, line_start, line_end FROM chunks")
def packed_chunks(spark, sf_dir):
    return chunking.chunk_rows(chunking.chunk(data.corpus(spark, sf_dir), _WHOLE, description=None)).select("file_path", "chunk_index", "text", "line_start", "line_end")


@_query(f"{_PACKED_SQL} SELECT file_path, count(*)::BIGINT AS n_chunks FROM chunks GROUP BY file_path")
def chunk_counts(spark, sf_dir):
    return chunking.chunk(data.corpus(spark, sf_dir), _WHOLE).select("file_path", F.size("chunks").cast("bigint").alias("n_chunks"))


@_query(f"{_PACKED_SQL} SELECT file_path, chunk_index::BIGINT AS chunk_index, coalesce(description || chr(10) || chr(10), '') || text AS text FROM chunks")
def described_chunks(spark, sf_dir):
    return chunking.chunk_rows(chunking.chunk(data.corpus(spark, sf_dir), _WHOLE)).select("file_path", "chunk_index", "text")


@_query()
def split_chunks(spark, sf_dir):
    """Production sizes, force split included."""
    return chunking.chunk_rows(chunking.chunk(data.corpus(spark, sf_dir))).select("file_path", "chunk_index", "text", "line_start", "line_end")


# -- frontmatter rules ---------------------------------------------------------------------------------

def _fields(spark, sf_dir) -> DataFrame:
    d = data.corpus(spark, sf_dir)
    pair = lambda k, c: F.when(F.col(c).isNotNull(), F.create_map(F.lit(k), F.to_json(F.array(F.col(c))))).otherwise(F.create_map().cast("map<string,string>"))
    return d.withColumn("fields", F.map_concat(pair("title", "title"), pair("description", "description"), pair("type", "type")))


_DEFAULTS = {"description": "none", "status": "active"}


@_query(f"""WITH {data.CORPUS_SQL} SELECT file_path, CASE WHEN title IS NULL THEN '' ELSE 'title,' END || 'description,type,status' AS keys,
    CASE WHEN description IS NULL THEN '"none"' ELSE '["' || description || '"]' END AS description, '"active"' AS status FROM corpus""")
def defaults_applied(spark, sf_dir):
    filled = frontmatter.with_defaults(F.col("fields"), _DEFAULTS)
    order = F.array(*[F.lit(k) for k in ("title", "description", "type", "status")])
    return _fields(spark, sf_dir).withColumn("f", filled).select("file_path", F.array_join(F.filter(order, lambda k: F.map_contains_key("f", k)), ",").alias("keys"), F.col("f")["description"].alias("description"), F.col("f")["status"].alias("status"))


_MISSING_SQL = f"""{data.CORPUS_SQL}, missing AS (
    SELECT file_path, array_to_string(list_filter([CASE WHEN title IS NULL THEN 'Missing required frontmatter field: ''title''' END, CASE WHEN description IS NULL THEN 'Missing required frontmatter field: ''description''' END, 'Missing required frontmatter field: ''owner'''], lambda x: x IS NOT NULL), '; ') AS errors,
        title IS NOT NULL AND description IS NOT NULL AS valid FROM corpus)"""


@_query(f"WITH {_MISSING_SQL} SELECT file_path, errors FROM missing")
def missing_required(spark, sf_dir):
    return _fields(spark, sf_dir).select("file_path", F.array_join(frontmatter.missing_errors(F.col("fields"), ["title", "description", "owner"]), "; ").alias("errors"))


@_query(f"WITH {_MISSING_SQL} SELECT count(*) FILTER (valid)::BIGINT AS valid, count(*) FILTER (NOT valid)::BIGINT AS invalid FROM missing")
def validation_summary(spark, sf_dir):
    return frontmatter.summary(_fields(spark, sf_dir).withColumn("valid", F.size(frontmatter.missing_errors(F.col("fields"), ["title", "description"])) == 0))


@_query(f"WITH {data.CORPUS_SQL} SELECT file_path, title, description, body FROM corpus")
def frontmatter_parsed(spark, sf_dir):
    """Files with YAML fences, made from the corpus and parsed again."""
    d = data.corpus(spark, sf_dir)
    line = lambda k: F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}: "), F.to_json(F.array(F.col(k))), F.lit("\n"))).otherwise(F.lit(""))
    files = d.select("file_path", F.concat(F.lit("---\n"), line("title"), line("description"), F.lit("date: 2024-01-02\n---\n"), F.col("body")).alias("content"))
    first = lambda k: F.from_json(F.col("fields")[k], "array<string>")[0].alias(k)
    return frontmatter.parse(files).select("file_path", first("title"), first("description"), "body")


@_query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{"a":' || doc_id || ',"b":true,"c":null,"d":1.5}' WHEN 1 THEN '{"d":"2024-01-02","l":[1,"x",null],"m":{"k":"v' || doc_id || '"}}'
    WHEN 2 THEN '{}' WHEN 3 THEN '{}' WHEN 4 THEN '{"n":null,"s":"12"}' ELSE '{}' END AS fields, 'rest ' || doc_id AS body FROM documents""")
def yaml_values(spark, sf_dir):
    """Types of YAML values; lists, broken YAML and no frontmatter at all give no fields."""
    n = F.col("doc_id").cast("string")
    heads = [F.concat(F.lit("---\na: "), n, F.lit("\nb: yes\nc: ~\nd: 1.5\n---\n")), F.concat(F.lit("---\nd: 2024-01-02\nl: [1, x, null]\nm: {k: v"), n, F.lit("}\n---\n")), F.lit("---\n- 1\n---\n"), F.lit("---\na: b: c\n---\n"), F.lit("---\nn: .inf\ns: '12'\n---\n"), F.lit("")]
    files = data.read(spark, sf_dir, "documents").select("doc_id", n.alias("file_path"), F.concat(F.element_at(F.array(*heads), (F.col("doc_id") % 6 + 1).cast("int")), F.lit("rest "), n).alias("content"))
    shown = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return frontmatter.parse(files).select("doc_id", F.concat(F.lit("{"), F.array_join(shown, ","), F.lit("}")).alias("fields"), "body")


@_query(f"""WITH {data.CORPUS_SQL} SELECT file_path, title IS NOT NULL AND description IS NOT NULL AS valid,
    array_to_string(list_filter([CASE WHEN title IS NULL THEN 'Missing required frontmatter field: ''title''' END, CASE WHEN description IS NULL THEN 'Missing required frontmatter field: ''description''' END], lambda x: x IS NOT NULL), '; ') AS errors FROM corpus""")
def validation_report(spark, sf_dir):
    """Files with frontmatter through the whole validation."""
    from lectern.config import Frontmatter

    d = data.corpus(spark, sf_dir)
    line = lambda k: F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}: "), F.to_json(F.array(F.col(k))), F.lit("\n"))).otherwise(F.lit(""))
    files = d.select("file_path", F.concat(F.lit("---\n"), line("title"), line("description"), F.lit("x: 1\n---\nbody")).alias("content"))
    checked = frontmatter.validate(frontmatter.parse(files), Frontmatter(required=("title", "description", "status"), defaults={"status": "active"}))
    return checked.select("file_path", "valid", F.array_join("errors", "; ").alias("errors"))


# -- index plan and store ----------------------------------------------------------------------------------

_PLAN_SQL = f"""{data.CORPUS_SQL}, {data.STATE_SQL}, plan AS (
    SELECT c.file_path, sha256(c.body) AS content_hash, s.file_path IS NOT NULL AS was_indexed, coalesce(s.content_hash = sha256(c.body), false) = false AS changed,
        CASE WHEN coalesce(s.content_hash = sha256(c.body), false) THEN 'skipped' WHEN c.title IS NULL THEN 'invalid' ELSE 'ready' END AS outcome
    FROM corpus c LEFT JOIN state_before s USING (file_path))"""


def _plan(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = data.corpus(spark, sf_dir)
    state = data.state_before(spark, docs)
    planned = indexer.join_state(docs.withColumn("content_hash", identity.content_hash(F.col("body"))), state)
    return planned.withColumn("outcome", indexer.outcome(F.col("changed"), F.col("title").isNotNull(), F.lit(1))), state


@_query(f"WITH {_PLAN_SQL} SELECT file_path, content_hash, was_indexed, changed, outcome FROM plan")
def index_plan(spark, sf_dir):
    return _plan(spark, sf_dir)[0].select("file_path", "content_hash", "was_indexed", "changed", "outcome")


@_query(f"WITH {_PLAN_SQL} SELECT outcome, count(*)::BIGINT AS files FROM plan GROUP BY outcome")
def outcome_summary(spark, sf_dir):
    return _plan(spark, sf_dir)[0].groupBy("outcome").agg(F.count("*").alias("files"))


@_query(f"WITH {_PLAN_SQL} SELECT s.file_path, s.content_hash, s.chunk_count FROM state_before s ANTI JOIN corpus c USING (file_path)")
def orphans(spark, sf_dir):
    planned, state = _plan(spark, sf_dir)
    return indexer.orphans(state, planned)


@_query(f"""WITH {_PLAN_SQL} SELECT file_path, content_hash, chunk_count FROM state_before WHERE file_path IN (SELECT file_path FROM plan WHERE outcome <> 'ready')
    UNION ALL SELECT file_path, content_hash, 1 FROM plan WHERE outcome = 'ready'""")
def state_after_run(spark, sf_dir):
    planned, state = _plan(spark, sf_dir)
    kept = store.delete_state(state.withColumn("indexed_at", F.current_timestamp()), indexer.orphans(state, planned))
    ready = planned.where("outcome = 'ready'").select("file_path", "content_hash", F.lit(1).alias("chunk_count"))
    return store.upsert_state(kept, ready).select("file_path", "content_hash", "chunk_count")


@_query(f"""WITH {data.POINTS_SQL} SELECT vec_id, domain, type FROM points WHERE vec_id % 3 <> 0
    UNION ALL SELECT vec_id, 'new', type FROM points WHERE vec_id % 3 = 0 UNION ALL SELECT -1 - vec_id, 'new', type FROM points WHERE vec_id % 6 = 0""")
def upsert_result(spark, sf_dir):
    old = data.points(spark, sf_dir).select("vec_id", "domain", "type")
    changed = old.where("vec_id % 3 = 0").withColumn("domain", F.lit("new"))
    return store.upsert(old, changed.unionByName(old.where("vec_id % 6 = 0").select((-1 - F.col("vec_id")).alias("vec_id"), F.lit("new").alias("domain"), "type")), "vec_id")


@_query(f"WITH {data.POINTS_SQL} SELECT vec_id, 'vec/' || (vec_id % 50) AS file_path FROM points WHERE vec_id % 50 NOT IN (1, 2, 3)")
def delete_by_files(spark, sf_dir):
    p = data.points(spark, sf_dir).select("vec_id", F.concat(F.lit("vec/"), (F.col("vec_id") % 50).cast("string")).alias("file_path"))
    return store.delete_by_files(p, spark.createDataFrame([("vec/1",), ("vec/2",), ("vec/3",), ("vec/3",)], "file_path string"))


@_query(f"WITH {_PLAN_SQL} SELECT count(*)::BIGINT AS files, sum(chunk_count)::BIGINT AS chunks FROM state_before")
def state_totals(spark, sf_dir):
    return _plan(spark, sf_dir)[1].agg(F.count("*").alias("files"), F.sum("chunk_count").alias("chunks"))


_STORED_SQL = f"""{data.TYPED_SQL}, stored AS (
    SELECT vec_id, 'vec/' || vec_id AS file_path, CASE WHEN vec_id % 5 = 0 THEN 'again ' ELSE '' END || vec_id AS text, CASE WHEN vec_id % 5 = 0 THEN 'h2' ELSE 'h1' END AS content_hash FROM typed WHERE vec_id % 7 <> 0 OR vec_id % 5 = 0)"""


def _stored(spark, sf_dir) -> store.Collection:
    """A collection after two updates: all vectors, then every fifth anew and every seventh gone."""
    collection = store.Collection(spark, scratch(spark, "store"), "c")
    collection.ensure(1, ["file_path", "priority", "active", "tags"])
    points = data.stored_points(spark, sf_dir)
    state = lambda rows, h: rows.select("file_path", F.lit(h).alias("content_hash"), F.lit(1).alias("chunk_count"))
    with collection.writing():
        collection.apply(points.drop("vec_id"), points.limit(0).select("file_path"), state(points, "h1"))
        fifth = points.where("vec_id % 5 = 0").withColumn("text", F.concat(F.lit("again "), "text"))
        collection.apply(fifth.drop("vec_id"), points.where("vec_id % 7 = 0 AND vec_id % 5 <> 0").select("file_path"), state(fifth, "h2"))
    return collection


def _joined(c: store.Collection) -> DataFrame:
    return c.points().select("file_path", "text").join(c.state().select("file_path", "content_hash", "chunk_count"), "file_path", "full")


@_query(f"WITH {_STORED_SQL} SELECT file_path, text, content_hash, 1::BIGINT AS chunk_count FROM stored")
def stored_collection(spark, sf_dir):
    """Points and state of a collection on disk after updates and deletions, read through its deletion bitmaps."""
    return _joined(_stored(spark, sf_dir))


@_query(f"WITH {_STORED_SQL} SELECT file_path, text, content_hash, 1::BIGINT AS chunk_count FROM stored WHERE vec_id % 11 <> 0")
def stored_compacted(spark, sf_dir):
    """The same after one more deletion and a merge of all segments."""
    c = _stored(spark, sf_dir)
    gone = data.typed(spark, sf_dir).where("vec_id % 11 = 0").select(F.concat(F.lit("vec/"), F.col("vec_id").cast("string")).alias("file_path"))
    c.apply(c.points_of_none(), gone, spark.createDataFrame([], "file_path string, content_hash string, chunk_count bigint"))
    c.compact(full=True)
    return _joined(c)


@_query(f"""WITH {_STORED_SQL}, again AS (SELECT *, vec_id % 2 = 0 AS even FROM stored)
    SELECT 'priority' AS field, (vec_id % 7)::VARCHAR AS value, count(*)::BIGINT AS count FROM again WHERE NOT even GROUP BY ALL
    UNION ALL SELECT 'tags', value, n FROM (SELECT unnest(['x' || (vec_id % 5), 'u' || vec_id]) AS value, count(*)::BIGINT AS n FROM stored GROUP BY value ORDER BY n DESC, value LIMIT 50)""")
def maintained_facets(spark, sf_dir):
    """Facets from the keyword index, which updates have added to and taken from; no point is read."""
    c = _stored(spark, sf_dir)
    return reduce(DataFrame.unionByName, [c.facet(f, search.FACET_LIMIT).select(F.lit(f).alias("field"), "value", "count") for f in ("priority", "active", "tags")])


_INDEX_FILTERS = (("p3", {"priority": 4}), ("ps", {"priority": "3"}), ("off", {"active": False}), ("one", {"tags": "u10"}), ("any", {"tags": ["u11", "u12", "u14"]}), ("both", {"tags": "x1", "active": True}))


@_query(f"""WITH {_STORED_SQL} SELECT 'p3' AS name, file_path FROM stored WHERE vec_id % 2 = 0 AND vec_id % 7 = 4 UNION ALL SELECT 'ps', file_path FROM stored WHERE vec_id % 2 = 1 AND vec_id % 7 = 3
    UNION ALL SELECT 'off', file_path FROM stored WHERE vec_id % 3 <> 0 UNION ALL SELECT 'one', file_path FROM stored WHERE vec_id = 10
    UNION ALL SELECT 'any', file_path FROM stored WHERE vec_id IN (11, 12, 14) UNION ALL SELECT 'both', file_path FROM stored WHERE vec_id % 5 = 1 AND vec_id % 3 = 0""")
def keyword_filters(spark, sf_dir):
    """Equality and any-of, of scalars and lists, on the files that the keyword index names."""
    c = _stored(spark, sf_dir)
    return reduce(DataFrame.unionByName, [search.where_all(c.points(f), f).select(F.lit(n).alias("name"), "file_path") for n, f in _INDEX_FILTERS])


@_query(f"WITH {_STORED_SQL} SELECT (SELECT count(*) FROM stored)::BIGINT AS points, (SELECT content_hash FROM stored WHERE file_path = 'vec/10') AS found, (SELECT content_hash FROM stored WHERE file_path = 'vec/14') AS gone, 0::BIGINT AS cleared, false AS dropped")
def stored_counts(spark, sf_dir):
    """Size, state of single files, size once cleared, and whether a dropped collection is there."""
    c = _stored(spark, sf_dir)
    n, found, gone = c.count(), c.state_of("vec/10"), c.state_of("vec/14")
    c.clear()
    cleared = c.count() + c.state().count()
    c.drop()
    return spark.createDataFrame([(n, found["content_hash"], gone and gone["content_hash"], cleared, c.exists())], "points bigint, found string, gone string, cleared bigint, dropped boolean")


# -- discovery ---------------------------------------------------------------------------------------------

_TREE_SQL = f"""{data.CORPUS_SQL}, tree AS (
    SELECT CASE WHEN doc_id % 6 = 0 THEN '_' WHEN doc_id % 6 = 1 THEN '.' ELSE '' END || type || '/' || CASE WHEN doc_id % 4 = 0 THEN '.h/' ELSE '' END || CASE WHEN doc_id % 10 = 3 THEN '_' ELSE '' END
        || doc_id || CASE WHEN doc_id % 9 = 0 THEN '.txt' ELSE '.md' END AS file_path, body, doc_id FROM corpus)"""


@_query(f"WITH {_TREE_SQL} SELECT file_path, sha256(body) AS content_hash FROM tree WHERE file_path LIKE '%.md' AND file_path NOT LIKE '%/_3_.md' AND doc_id % 10 <> 7")
def discovered_files(spark, sf_dir):
    """The corpus written as a tree of files, hidden names and links among them, and discovered by its URL. Files of doc_ids that end in 7 are links."""
    from lectern.config import Indexing
    from lectern.sources import discovery

    d = data.corpus(spark, sf_dir)
    n = F.col("doc_id")
    name = F.concat(F.when(n % 6 == 0, "_").when(n % 6 == 1, ".").otherwise(""), "type", F.lit("/"), F.when(n % 4 == 0, ".h/").otherwise(""), F.when(n % 10 == 3, "_").otherwise(""), n.cast("string"), F.when(n % 9 == 0, ".txt").otherwise(".md"))
    root = scratch(spark, "tree")
    data.write_tree(d.select(name.alias("path"), "body", (n % 10 == 7).alias("link")), root)
    found = discovery.discover(spark, root, Indexing(exclude=("**/?3?.md",)))
    return discovery.load(spark, found, root).select("file_path", identity.content_hash(F.col("content")).alias("content_hash"))


@_query(f"""WITH {data.CORPUS_SQL} SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1) AND doc_id % 10 <> 7 THEN sha256(body) END AS content_hash,
    CASE WHEN doc_id % 6 = 2 THEN 'File path is outside the data directory' WHEN doc_id % 6 = 3 THEN 'File not found: none/' || doc_id || '.md'
        WHEN doc_id % 6 = 4 OR doc_id % 10 = 7 AND doc_id % 6 <> 5 THEN 'File type not permitted' WHEN doc_id % 6 = 5 THEN 'File not found: ' || doc_id || '.md/x' END AS error FROM corpus""")
def retrieved_documents(spark, sf_dir):
    """A path for every document: plain, roundabout, out of the root, of no file, of another type, below a file, or of a link to a folder."""
    from lectern.operators import documents

    d = data.corpus(spark, sf_dir)
    n = F.col("doc_id").cast("string")
    ending = F.when(F.col("doc_id") % 6 == 4, ".txt").otherwise(".md")
    root = scratch(spark, "raw")
    data.write_tree(d.select(F.concat(n, ending).alias("path"), "body", ((F.col("doc_id") % 10 == 7) & (F.col("doc_id") % 6 != 5)).alias("link")), root)
    kinds = [F.concat(n, ending), F.concat(F.lit("./../"), F.lit(root.rsplit("/", 1)[1]), F.lit("/"), n, ending), F.lit(".."), F.concat(F.lit("none/"), n, ending), F.concat(n, ending), F.concat(n, ending, F.lit("/x"))]
    asked = d.select("doc_id", F.element_at(F.array(*kinds), (F.col("doc_id") % 6 + 1).cast("int")).alias("path"))
    return documents.get_documents(asked, root, ["**/*.md"]).select("doc_id", identity.content_hash(F.col("document")).alias("content_hash"), "error")


_CHANGED_SQL = f"""changed AS (
    SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN body || chr(10) || chr(10) || '## Added' || chr(10) || 'later' ELSE body END AS body) FROM corpus WHERE doc_id % 11 <> 3)"""
_RUNS_SQL = _PACKED_SQL.replace(",\n    lines AS", f",\n    {_CHANGED_SQL},\n    lines AS", 1).replace("FROM corpus)", "FROM changed WHERE title IS NOT NULL)")


@_query(f"""{_RUNS_SQL}, texts AS (
        SELECT file_path, count(*)::BIGINT AS chunk_count, sha256(string_agg(coalesce(description || chr(10) || chr(10), '') || text, chr(10) ORDER BY chunk_index)) AS text_hash FROM chunks GROUP BY file_path)
    SELECT file_path, sha256('---' || chr(10) || 'title: ' || title || chr(10) || CASE WHEN description IS NULL THEN '' ELSE 'description: ' || description || chr(10) END || '---' || chr(10) || body) AS content_hash,
        chunk_count, chunk_count AS n_points, text_hash, true AS dated,
        (SELECT count(*) FROM changed)::BIGINT AS discovered, (SELECT count(*) FROM changed WHERE title IS NOT NULL AND doc_id % 5 = 0)::BIGINT AS indexed,
        (SELECT count(*) FROM changed WHERE title IS NOT NULL AND doc_id % 5 <> 0)::BIGINT AS skipped, (SELECT count(*) FROM changed WHERE title IS NULL)::BIGINT AS invalid,
        (SELECT count(*) FROM corpus WHERE title IS NOT NULL AND doc_id % 11 = 3)::BIGINT AS orphans
    FROM changed JOIN texts USING (file_path)""")
def indexed_runs(spark, sf_dir):
    """Two index runs of the corpus as files: between them every fifth file grows, and every eleventh makes way for a link and so is gone.

    The collection's state and points after the second, its chunks put together in order, and that run's summary. Files without a title are invalid.
    """
    from lectern import config
    from lectern.operators.embedding import HashingEmbedder

    n, root = F.col("doc_id"), scratch(spark, "files")
    field = lambda k: F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}: "), F.col(k), F.lit("\n"))).otherwise("")
    files = lambda d: d.select(F.col("file_path").alias("path"), F.concat(F.lit("---\n"), field("title"), field("description"), F.lit("---\n"), "body").alias("body"), (n % 11 == 3).alias("link"))
    settings = config.Config(
        source=config.Source(data_path=root), chunking=_WHOLE, embedding=config.Embedding(vector_size=8), qdrant=config.Qdrant(url=scratch(spark, "runs")),
        frontmatter=config.Frontmatter(required=("title",), indexed_fields=("title",)),
    )
    docs = data.corpus(spark, sf_dir)
    data.write_tree(files(docs).withColumn("link", F.lit(False)), root)
    indexer.run_index(spark, settings, HashingEmbedder(8))
    grown = docs.withColumn("body", F.when(n % 5 == 0, F.concat("body", F.lit("\n\n## Added\nlater"))).otherwise(F.col("body")))
    data.write_tree(files(grown.where((n % 5 == 0) | (n % 11 == 3))), root)
    began = spark.range(1).select(F.current_timestamp()).first()[0]
    s = indexer.run_index(spark, settings, HashingEmbedder(8))
    c = store.Collection(spark, settings.qdrant.url, settings.qdrant.collection)
    texts = c.points().groupBy("file_path").agg(F.count("*").alias("n_points"), F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("own"))
    whole = texts.select("file_path", "n_points", F.sha2(F.array_join(F.col("own")["text"], "\n"), 256).alias("text_hash"))
    dated = F.col("indexed_at").isNotNull() & ((F.col("indexed_at") >= F.lit(began)) == F.col("file_path").rlike(r"[05]\.md$"))
    said = [F.lit(getattr(s, k)).cast("bigint").alias(k) for k in ("discovered", "indexed", "skipped", "invalid", "orphans")]
    return c.state().select("file_path", "content_hash", "chunk_count", dated.alias("dated")).join(whole, "file_path", "full").select("*", *said)


@_query(f"""WITH {data.TYPED_SQL} SELECT vec_id, '{{"active":' || (vec_id % 3 = 0) || ',"priority":' || CASE WHEN vec_id % 2 = 0 THEN (vec_id % 7)::VARCHAR ELSE '"' || (vec_id % 7) || '"' END
    || ',"tags":["x' || (vec_id % 5) || '","u' || vec_id || '",' || (vec_id % 4) || ',true],"file_path":"vec/' || vec_id || '","chunk_index":0,"text":"' || vec_id || '","line_start":1,"line_end":1}}' AS payload FROM typed""")
def stored_payloads(spark, sf_dir):
    """Payloads keep every value's type; the reserved keys come last."""
    return data.stored_points(spark, sf_dir).select("vec_id", "payload")


@_query(f"WITH {_PLAN_SQL} SELECT file_path, was_indexed, true AS changed, CASE WHEN title IS NULL THEN 'invalid' ELSE 'ready' END AS outcome FROM plan JOIN corpus USING (file_path)")
def index_plan_full(spark, sf_dir):
    """A full run takes every file, whatever its hash."""
    docs = data.corpus(spark, sf_dir)
    planned = indexer.join_state(docs.withColumn("content_hash", identity.content_hash(F.col("body"))), data.state_before(spark, docs), full=True)
    return planned.select("file_path", "was_indexed", "changed", indexer.outcome(F.col("changed"), F.col("title").isNotNull(), F.lit(1)).alias("outcome"))


# -- webhooks and limits ---------------------------------------------------------------------------------------

_INNER, _OUTER = identity.hmac_pads(data.WEBHOOK_SECRET)
_HOOKS_SQL = f"""{data.DELIVERIES_SQL}, hooks AS (
    SELECT event_id, event_id % 5 <> 0 OR substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(body)))), 1, 1) = '0' AS good,
        CASE event_id % 3 WHEN 1 THEN 'dev' ELSE 'main' END AS branch FROM deliveries)"""


@_query(f"WITH {_HOOKS_SQL} SELECT event_id, good AS verified FROM hooks")
def webhook_verify(spark, sf_dir):
    return data.deliveries(spark, sf_dir).select("event_id", webhook.verified(F.col("body"), F.col("signature"), "github", data.WEBHOOK_SECRET).alias("verified"))


@_query(f"""WITH {_HOOKS_SQL} SELECT event_id, 'gitea' AS provider, good AS verified FROM hooks
    UNION ALL SELECT event_id, 'gitlab', event_id % 4 = 0 FROM hooks""")
def webhook_providers(spark, sf_dir):
    """Plain hex signatures, and tokens that are missing, wrong or right."""
    d = data.deliveries(spark, sf_dir)
    bare = d.withColumn("signature", F.regexp_replace("signature", "^sha256=", ""))
    token = F.when(F.col("event_id") % 4 == 0, data.WEBHOOK_SECRET).when(F.col("event_id") % 4 == 1, data.WEBHOOK_SECRET.upper())
    check = lambda rows, p: rows.select("event_id", F.lit(p).alias("provider"), webhook.verified(F.col("body"), F.col("signature"), p, data.WEBHOOK_SECRET).alias("verified"))
    return check(bare, "gitea").unionByName(check(d.withColumn("signature", token), "gitlab"))


@_query(f"WITH {_HOOKS_SQL} SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'x/' || event_id END AS branch FROM hooks")
def webhook_branch_types(spark, sf_dir):
    """Only a string ref is a branch: numbers, missing ones and texts that are no JSON give none."""
    n = F.col("event_id").cast("string")
    kinds = [F.concat(F.lit('{"ref":"refs/heads/x/'), n, F.lit('"}')), F.concat(F.lit('{"ref":'), n, F.lit("}")), F.concat(F.lit('{"id":'), n, F.lit("}")), F.concat(F.lit("ref="), n)]
    return data.read(spark, sf_dir, "events").select("event_id", webhook.branch(F.element_at(F.array(*kinds), (F.col("event_id") % 4 + 1).cast("int"))).alias("branch"))


@_query(f"WITH {_HOOKS_SQL} SELECT event_id, branch FROM hooks")
def webhook_branch(spark, sf_dir):
    return data.deliveries(spark, sf_dir).select("event_id", webhook.branch(F.col("body")).alias("branch"))


@_query(f"""WITH {_HOOKS_SQL} SELECT event_id, branch, CASE WHEN good THEN 200 ELSE 401 END::BIGINT AS status,
    CASE WHEN NOT good THEN 'Invalid signature' WHEN branch = 'main' THEN 'Reindex triggered' ELSE 'Branch ignored: ''' || branch || ''' (expected ''main'')' END AS message, good AND branch = 'main' AS triggered FROM hooks""")
def webhook_outcome(spark, sf_dir):
    return webhook.outcomes(data.deliveries(spark, sf_dir), "github", data.WEBHOOK_SECRET, "main").select("event_id", "branch", "status", "message", "triggered")


@_query(f"""WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    fold AS (
        SELECT user_id, event_id, n, true AS accepted, t + {data.REPLENISH_SECONDS}000000 AS tat FROM r WHERE n = 1
        UNION ALL
        SELECT r.user_id, r.event_id, r.n, greatest(f.tat, r.t) + {data.REPLENISH_SECONDS}000000 - r.t <= {data.BURST} * {data.REPLENISH_SECONDS}000000,
            CASE WHEN greatest(f.tat, r.t) + {data.REPLENISH_SECONDS}000000 - r.t <= {data.BURST} * {data.REPLENISH_SECONDS}000000 THEN greatest(f.tat, r.t) + {data.REPLENISH_SECONDS}000000 ELSE f.tat END
        FROM fold f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
    SELECT user_id, event_id, accepted FROM fold""")
def rate_limit(spark, sf_dir):
    return limiter.admitted(data.read(spark, sf_dir, "events"), "user_id", "ts", "event_id", data.BURST, data.REPLENISH_SECONDS)


@_query("SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.v) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.v, b.v))), 6) AS score FROM embeddings a, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 1) b")
def cosine_scores(spark, sf_dir):
    q = data.query_vector(spark, sf_dir, 1)
    return data.points(spark, sf_dir).select("vec_id", F.round(vectors.cosine(F.col("vector"), vectors.literal(q)), 6).alias("score"))


@_query(ORACLE_SQL["rate_limit"])
def rate_limit_stream(spark, sf_dir):
    """The limiter over `events` as a stream, run until the input is used up."""
    from lectern.streaming.limiter import admit

    at = scratch(spark, "stream")
    schema = data.read(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events*.parquet")
    requests = events.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("order"))
    admitted = admit(requests, data.BURST, data.REPLENISH_SECONDS, idle_ms=None)
    query = admitted.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.col("key").alias("user_id"), F.col("order").alias("event_id"), "accepted")
