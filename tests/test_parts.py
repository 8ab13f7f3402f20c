"""Frontmatter, identity, text, filters, requests, documents, webhooks, config, embedding."""

import hashlib
import hmac
import random
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern import config as conf
from lectern.functions import identity, text, vectors
from lectern.operators import blocks, documents, embedding, frontmatter, search, service, webhook
from lectern.sources import spool
from lectern.streaming import limiter as stream_limiter


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def parsed(spark, content):
    return frontmatter.parse(spark.createDataFrame([("a.md", content)], "file_path string, content string")).first()


@pytest.mark.parametrize(
    "content, fields, body",
    [
        ("---\ntitle: Test\ntype: guide\n---\n# Hello\nBody", {"title": '"Test"', "type": '"guide"'}, "# Hello\nBody"),
        ("no fence", {}, "no fence"),
        ("---\n- a\n---\nx", {}, "x"),
        ("---\na: [1, 2.5, null]\nd: 2024-01-02\nn: .inf\nb: yes\n---\n\nx", {"a": "[1,2.5,null]", "d": '"2024-01-02"', "n": "null", "b": "true"}, "\nx"),
        ("---\na: b: c\n---\nx", {}, "x"),
        ("---\nopen: 1\nnever closed", {}, "---\nopen: 1\nnever closed"),
        ("---\n---\nx", {}, "x"),
    ],
)
def test_frontmatter(spark, content, fields, body):
    r = parsed(spark, content)
    assert r["fields"] == fields and r["body"] == body


def test_rules_defaults_and_lint(spark):
    df = frontmatter.parse(spark.createDataFrame([("a.md", "---\ntitle: T\nstatus: null\n---\n")], "file_path string, content string"))
    rules = conf.Frontmatter(required=("title", "type", "status"), defaults={"status": "active", "lang": "en"})
    r = frontmatter.validate(df, rules, conf.Validation(lint_command=("sh", "-c", "echo bad >&2; exit 1", "--"))).first()
    assert r["fields"] == {"title": '"T"', "status": "null", "lang": '"en"'}
    assert r["errors"] == ["Missing required frontmatter field: 'type'", "Lint command failed: bad"] and not r["valid"]
    r = frontmatter.validate(df, conf.Frontmatter(), conf.Validation(lint_command=("/no/such/program",))).first()
    assert r["errors"][0].startswith("Failed to run lint command")
    assert frontmatter.validate(df, conf.Frontmatter(), conf.Validation(lint_command=())).first()["valid"]


def test_lint_of_files_that_are_on_no_disk(spark):
    """Tasks lint copies of the same name and content; messages name the file where it is."""
    rows = [("sub/a.md", "good\n"), ("sub/é.md", "bad\r\n")]
    df = spark.createDataFrame(rows, "file_path string, content string")
    command = ("sh", "-c", 'grep -q good "$1" || { echo "$1: $(wc -c < "$1") bytes"; exit 1; }', "--")
    got = {r["file_path"]: r["lint_errors"] for r in frontmatter.lint(df, command, "s3://bucket/data/").collect()}
    assert got == {"sub/a.md": [], "sub/é.md": ["Lint command failed: s3://bucket/data/sub/é.md: 5 bytes"]}


def test_lint_by_a_file_url(spark, tmp_path):
    (tmp_path / "a.md").write_text("good")
    df = spark.createDataFrame([("a.md", "not looked at")], "file_path string, content string")
    assert frontmatter.lint(df, ("grep", "-q", "good"), f"file://{tmp_path}").first()["lint_errors"] == []


@pytest.mark.parametrize("name", ["docs/a.md", "é/ü.md", ""])
def test_point_id(spark, name):
    assert one(spark, name, lambda x: identity.point_id(x, F.lit(3))) == str(uuid.uuid5(uuid.NAMESPACE_X500, f"{name}::3"))


@pytest.mark.parametrize("secret", ["s", "k" * 64, "long" * 40])
def test_hmac(spark, secret):
    assert one(spark, "body é", lambda x: identity.hmac_sha256(secret, x)) == hmac.new(secret.encode(), "body é".encode(), hashlib.sha256).hexdigest()


def test_text(spark):
    assert one(spark, "  a b \n", text.trim) == "a b"
    assert one(spark, "x" * 401, text.snippet) == "x" * 400 + "..." and one(spark, "é" * 400, text.snippet) == "é" * 400
    assert one(spark, "at https://u:p@h/x and http://t@g, not https://h/a@b", text.redact_urls) == "at https://***@h/x and http://***@g, not https://h/a@b"
    assert one(spark, "https://h/x", lambda x: text.inject_token(x, "a$1\\b")) == "https://a$1\\b@h/x"
    assert one(spark, "git@h:x", lambda x: text.inject_token(x, "t")) == "git@h:x"
    assert one(spark, [3.0, 4.0], lambda x: vectors.cosine(x, vectors.literal([0.0, 0.0])), "array<float>") is None


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        ("**/*.md", ["README.md", "docs/guide.md", "a/b/c.md"], ["state.db", "x.mdx"]),
        ("archive/**", ["archive/old.md", "archive/a/b"], ["x/archive/old.md", "archive"]),
        ("*.md", ["a.md", "a/b.md"], ["a.txt"]),
        ("{a,b}/?.[!x]", ["a/1.y", "b/2.z"], ["c/1.y", "a/1.x"]),
        ("a\\*b", ["a*b"], ["axb"]),
    ],
)
def test_globs(spark, pattern, yes, no):
    df = spark.createDataFrame([(p,) for p in yes + no], "p string").select("p", text.matches_any(F.col("p"), [pattern]).alias("m"))
    assert {r["p"]: r["m"] for r in df.collect()} == {p: p in yes for p in yes + no}


def test_invalid_globs():
    with pytest.raises(text.GlobError):
        text.any_glob(["[oops"])
    assert text.any_glob(["[oops"], strict=False) is None
    assert text.any_glob(["[oops"], strict=False, fallback="**/*.md") == text.any_glob(["**/*.md"])


def test_filters(spark):
    df = spark.createDataFrame([("eng", 42, True, ["rust", "rag"]), ("ops", 7, False, [])], "domain string, priority bigint, active boolean, tags array<string>")
    count = lambda f: search.where_all(df, f).count()
    assert count({}) == 2 and count({"domain": "eng"}) == 1 and count({"priority": 42, "active": True}) == 1
    assert count({"nowhere": "x"}) == 0
    assert count({"tags": ["rag", "x"]}) == 1 and count({"tags": "rust"}) == 1 and count({"tags": []}) == 0 and count({"domain": ["eng", "ops"]}) == 2
    for bad in (1.5, None, {"a": 1}, ["a", 1], 2**63):
        with pytest.raises(search.RequestError):
            count({"domain": bad})


def test_requests():
    assert [search.resolve_limit(x) for x in (None, 0, 25, 1_000_000)] == [10, 0, 25, 50]
    search.SearchRequest("q" * 4096, "d" * 256, "t" * 256, ["x" * 256] * 20).check()
    for bad in (dict(query="q" * 4097), dict(query="é" * 2049), dict(query="", domain="d" * 257), dict(query="", type="t" * 257), dict(query="", tags=["x"] * 21), dict(query="", tags=["x" * 257])):
        with pytest.raises(search.RequestError):
            search.SearchRequest(**bad).check()


def test_batch_search_equals_single_searches(spark, monkeypatch):
    """Blocks of queries and tiles of points; ties, nulls, zeros, and fewer points than asked for."""
    rng = random.Random(3)
    vectors = [[rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)] for _ in range(150)]
    rows = [(f"p{k:03d}", v) for k, v in enumerate(vectors)] + [("zero", [0.0] * 4), ("none", None), ("hole", [1.0, None, 0.0, 1.0]), ("short", [1.0])]
    points = spark.createDataFrame(rows, "id string, vector array<float>").repartition(3)
    queries = spark.createDataFrame([(k, vectors[k]) for k in range(0, 150, 9)], "query_id bigint, qv array<double>")
    for k, block, tile in ((5, blocks.BLOCK_BYTES, blocks.TILE), (5, 300, 64), (200, 300, 64), (0, 300, 64)):
        monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
        monkeypatch.setattr(blocks, "TILE", tile)
        got = {}
        for r in search.top_k_batch(points, queries, k).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"] is None, r["score"] or 0))
        for q in queries.collect() if k else []:
            single = sorted((-_cosine(v, q["qv"]) if v and len(v) == 4 and None not in v and any(v) and any(q["qv"]) else 9.0, i) for i, v in rows)[:k]
            assert sorted(got[q["query_id"]]) == [(n + 1, i, s == 9.0, 0 if s == 9.0 else -s) for n, (s, i) in enumerate(single)]
        assert k or not got
    assert search.top_k_batch(points.limit(0), queries, 3).isEmpty() and search.top_k_batch(points, queries.limit(0), 3).isEmpty()


def _cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 5)), max_size=12), max_size=8), st.integers(1, 7))
def test_requests_are_sorted_outside_of_memory(parts, most):
    given_ = [(np.array([t for t, _ in p], np.int64), np.array([o for _, o in p], np.int64)) for p in parts]
    pieces = [np.stack(x, axis=1) for x in stream_limiter.in_order(iter(given_), most)]
    got = [tuple(r) for p in pieces for r in p.tolist()]
    assert got == sorted(x for p in parts for x in p) and all(len(p) <= 2 * most + 8 for p in pieces)


def test_a_stream_decides_as_the_batch_form(monkeypatch):
    """Many requests of one key, held a thousand at a time."""
    rng = np.random.default_rng(1)
    at, order = rng.integers(0, 50_000, 20_000), np.arange(20_000)
    monkeypatch.setattr(stream_limiter, "HELD", 1000)
    bucket = stream_limiter.TokenBucket(3, 4, None)

    class Value:
        v = None
        exists = lambda self: self.v is not None
        get = lambda self: self.v

        def update(self, v):
            self.v = v

    bucket.tat, tat, want = Value(), None, []
    monkeypatch.setattr(stream_limiter.in_order, "__defaults__", (1000,))
    chunks = iter([pd.DataFrame({"at": at[k : k + 700], "order": order[k : k + 700]}) for k in range(0, 20_000, 700)])
    got = pd.concat(bucket.handleInputRows((7,), chunks, None))
    for t, o in sorted(zip(at.tolist(), order.tolist())):
        nxt = (t if tat is None else max(tat, t)) + 4
        want.append((o, nxt - t <= 12))
        tat = nxt if nxt - t <= 12 else tat
    assert list(zip(got["order"], got["accepted"])) == want and bucket.tat.v == (tat,)


def test_deliveries_get_numbers_that_go_on(tmp_path):
    box = spool.Spool(f"file://{tmp_path}/spool")
    with ThreadPoolExecutor(8) as pool:
        assert sorted(pool.map(lambda k: box.append(f"b{k}", None), range(40))) == list(range(1, 41))
    reader = spool.DeliveriesReader(box)
    end = reader.latestOffset()
    assert end == {"number": 40} and len({d[1] for p in reader.partitions({"number": 0}, end) for d in reader.read(p)}) == 40
    reader.commit(end)
    assert list(box.numbers()) == [40] and box.append("é", "s") == 41
    assert [d for p in reader.partitions(end, reader.latestOffset()) for d in reader.read(p)] == [(41, "é", "s")]
    with pytest.raises(ValueError):
        spool.Spool("s3://bucket/x")


def test_search_without_results(spark):
    df = spark.createDataFrame([], "id string, vector array<float>, title string, file_path string, line_start bigint, line_end bigint, domain string, type string, tags array<string>, text string")
    assert search.result_text(search.top_k(df, [1.0], 5)) == "No results found."


def test_documents(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/README.md").write_text("hello")
    (tmp_path / "in/x.db").write_text("")
    (tmp_path / "in/bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "out.md").write_text("secret")
    (tmp_path / "in/link.md").symlink_to(tmp_path / "out.md")
    get = lambda p: documents.get_document(str(tmp_path / "in"), p, ["**/*.md"])
    assert get("README.md") == "hello"
    for path, message in (("no.md", "File not found"), ("../out.md", "outside"), ("link.md", "outside"), (str(tmp_path / "out.md"), "outside"), ("x.db", "not permitted"), ("bad.md", "Failed to read")):
        with pytest.raises(documents.DocumentError, match=message):
            get(path)


def test_many_documents_as_one(spark, tmp_path):
    """The batch form says what the single form says, for each row and with its other columns."""
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "out.md").write_text("secret")
    (tmp_path / "in" / "sub" / "a.md").write_text("é")
    (tmp_path / "in" / "b.txt").write_text("x")
    (tmp_path / "in" / "c.md").write_bytes(b"\xff")
    (tmp_path / "in" / "l.md").symlink_to(tmp_path / "out.md")
    root, paths = str(tmp_path / "in"), ["sub/a.md", "./sub/../sub/a.md", f"{tmp_path}/in/sub/a.md", "b.txt", "c.md", "l.md", "../out.md", "/etc/passwd", "none.md", "sub", "", "sub/a.md"]

    def single(p):
        try:
            return documents.get_document(root, p, ["**/*.md"]), None
        except documents.DocumentError as e:
            return None, str(e)

    df = spark.createDataFrame([(i, p) for i, p in enumerate([*paths, None])], "n int, path string")
    got = {r["n"]: (r["document"], r["error"]) for r in documents.get_documents(df, root, ["**/*.md"]).collect()}
    assert got == {**{i: single(p) for i, p in enumerate(paths)}, len(paths): (None, "File not found")}
    assert got[0] == ("é", None) and got[5][1] == got[6][1] == "File path is outside the data directory"


def test_webhook_providers(spark):
    body = '{"ref":"refs/heads/master"}'
    mac = hmac.new(b"s", body.encode(), hashlib.sha256).hexdigest()
    cases = [("github", f"sha256={mac}", True), ("gitea", mac, True), ("gitea", "00" + mac[2:], False), ("gitlab", "s", True), ("gitlab", "t", False), ("github", None, False)]
    for provider, header, good in cases:
        df = spark.createDataFrame([(body, header)], "body string, signature string")
        r = webhook.outcomes(df, provider, "s", "master").first()
        assert (r["status"], r["triggered"]) == ((200, True) if good else (401, False)), (provider, header)
    df = spark.createDataFrame([(b, hmac.new(b"s", b.encode(), hashlib.sha256).hexdigest()) for b in ('{"ref":"main"}', '{"action":"push"}', "not json", '{"ref":5}')], "body string, signature string")
    assert [(r["status"], r["message"]) for r in webhook.outcomes(df, "gitea", "s", "master").collect()] == [(200, "Branch ignored: 'main' (expected 'master')")] + [(200, "No ref in payload, ignored")] * 3
    with pytest.raises(ValueError):
        webhook.verified(F.col("body"), F.col("signature"), "other", "s")


@pytest.mark.parametrize("body", ['{"ref":"refs/heads/master"}', '{"ref":"x"}', '{"ref":5}', "[1]", "no", '{"ref":"master"}'])
@pytest.mark.parametrize("provider", ["github", "gitlab"])
def test_one_delivery_and_many_agree(spark, provider, body):
    mac = "s" if provider == "gitlab" else "sha256=" + hmac.new(b"s", body.encode(), hashlib.sha256).hexdigest()
    for header in (mac, "other", None):
        r = webhook.outcomes(spark.createDataFrame([(body, header)], "body string, signature string"), provider, "s", "master").first()
        calls = []
        assert webhook.respond(body.encode(), header, provider, "s", "master", trigger=lambda: calls.append(1)) == (r["status"], r["message"])  # noqa: B023
        assert bool(calls) == r["triggered"]


def test_a_failing_update_is_a_server_error():
    body = b'{"ref":"master"}'
    calls = []
    fail = lambda code, err: webhook.GitUpdate("/d", "https://h/r.git", "master", "tok", lambda *a, **_: type("R", (), {"returncode": code, "stderr": err}))
    assert webhook.respond(body, "s", "gitlab", "s", "master", fail(1, "https://tok@h"), lambda: calls.append(1)) == (500, "Git fetch failed")
    assert webhook.respond(body, "s", "gitlab", "s", "master", fail(0, ""), lambda: calls.append(1)) == (200, "Reindex triggered") and calls == [1]
    assert webhook.respond(b"x" * (1 << 20) + b"x", "s", "gitlab", "s", "master")[0] == 413

    def none(*_, **__):
        raise OSError("no git")

    assert webhook.respond(body, "s", "gitlab", "s", "master", webhook.GitUpdate("/d", "u", "master", run=none)) == (500, "Failed to run git")


def test_strings_of_json(spark):
    df = spark.createDataFrame([('{"a":"x","l":["a",1,true,null,"b"]}',), ('{"a":5,"l":"x"}',), ("no",), (None,)], "j string")
    got = df.select(text.json_string(F.col("j"), "$.a"), text.json_strings(F.col("j"), "$.l")).collect()
    assert [tuple(r) for r in got] == [("x", ["a", "b"]), (None, None), (None, None), (None, None)]


def test_git_update_hides_the_token():
    calls = []

    def run(args, **_):
        calls.append(args)
        return type("R", (), {"returncode": 1, "stderr": f"fatal: {args[-2]}"})

    with pytest.raises(RuntimeError) as e:
        webhook.GitUpdate("/d", "https://h/r.git", "main", "tok", run)()
    assert calls[0][-2] == "https://tok@h/r.git" and "tok@" not in str(e.value)


def test_auth_and_health():
    assert webhook.same_token(None, None) and webhook.same_token("t", "Bearer t")
    assert not any(webhook.same_token("t", h) for h in (None, "Bearer x", "Basic t", "t"))
    with pytest.raises(RuntimeError):
        service.bearer_token({}, "T", False)
    assert service.bearer_token({}, "T", True) is None and service.bearer_token({"T": "x"}, "T", False) == "x"
    assert service.health({"a": lambda: 1}).http_status == 200
    bad = service.health({"a": lambda: 1, "b": lambda: 1 / 0}, log=lambda _: None)
    assert (bad.status, bad.http_status, bad.body()) == ("degraded", 503, {"status": "degraded", "a": {"status": "ok"}, "b": {"status": "unavailable"}})


ENV = {"EMBEDDING_BASE_URL": "u", "EMBEDDING_MODEL": "m", "QDRANT_URL": "/store"}


def test_config_defaults_and_environment(tmp_path):
    c = conf.load(tmp_path / "missing.yaml", ENV | {"EMBEDDING_VECTOR_SIZE": "4"})
    assert (c.embedding.vector_size, c.chunking.target, c.qdrant.collection, c.indexed_fields()) == (4, 1000, "knowledge-base", ["file_path"])
    (tmp_path / "c.yaml").write_text("chunking: {max_chunk_size: 500, target_chunk_size: null}\nfrontmatter: {indexed_fields: [file_path, tags]}\nindexing: {include: ['*.txt']}\n")
    c = conf.load(tmp_path / "c.yaml", ENV)
    assert c.chunking.target == 500 and c.indexed_fields() == ["file_path", "tags"] and c.indexing.include == ("*.txt",)


@pytest.mark.parametrize(
    "yaml, message",
    [
        ("nope: 1", "unknown key"), ("chunking: {nope: 1}", "unknown key"), ("chunking: {max_chunk_size: 0}", "max_chunk_size"), ("chunking: {max_chunk_size: 500}", "target_chunk_size"),
        ("embedding: {vector_size: 0}", "vector_size"), ("embedding: {batch_size: 0}", "batch_size"), ("rate_limit: {burst_size: 0}", "burst_size"), ("mcp: {metadata_refresh_secs: 9}", "metadata_refresh_secs"),
        ("webhook: {provider: other}", "provider"), ("indexing: {include: x}", "list of strings"), ("validation: {strict: 1}", "bool"), ("[]", "mapping"),
    ],
)
def test_config_errors(yaml, message):
    with pytest.raises(conf.ConfigError, match=message):
        conf.resolve(conf.parse(yaml), ENV)


def test_config_lists_all_that_is_missing():
    with pytest.raises(conf.ConfigError) as e:
        conf.resolve(conf.Config(), {})
    assert all(x in str(e.value) for x in ("base_url", "model", "qdrant.url"))


def test_retry():
    waits, tries = [], []
    clock = lambda: sum(waits)

    def call():
        tries.append(1)
        if len(tries) < 4:
            raise embedding.EmbeddingError("Service Unavailable")
        return "ok"

    assert embedding.with_retry(call, waits.append, clock) == "ok" and waits == [1, 2, 4]
    with pytest.raises(embedding.EmbeddingError):
        embedding.with_retry(lambda: (_ for _ in ()).throw(embedding.EmbeddingError("bad input")), waits.append, clock)
    waits.clear()
    with pytest.raises(ConnectionError):
        embedding.with_retry(lambda: (_ for _ in ()).throw(ConnectionError()), waits.append, clock)
    assert sum(waits) <= 120 and max(waits) == 30


def test_http_embedder_batches_and_sorts():
    e = embedding.HttpEmbedder("http://x", "m", batch_size=2)
    seen = []
    e._post = lambda texts: (seen.append(len(texts)), {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(texts)))]})[1]
    assert e.embed(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]] and seen == [2, 1]
    e._post = lambda texts: {"data": []}
    with pytest.raises(embedding.EmbeddingError, match="count mismatch"):
        e.embed(["a"])


def test_words_are_hashed_once_however_often_they_occur(monkeypatch):
    plain, seen = hashlib.md5, []
    monkeypatch.setattr(embedding.hashlib, "md5", lambda b: seen.append(b) or plain(b))
    words = [f"Once{i}" for i in range(50)]
    got = embedding.HashingEmbedder(8).embed([" ".join(words * 40), " ".join(words[:7])])
    assert len(seen) <= len(words)
    for vector, said in zip(got, (words * 40, words[:7])):
        want = np.zeros(8)
        for w in said:
            h = plain(w.lower().encode()).digest()
            want[int.from_bytes(h[:4], "little") % 8] += 1 if h[4] & 1 else -1
        assert np.allclose(vector, want / (np.linalg.norm(want) or 1))
