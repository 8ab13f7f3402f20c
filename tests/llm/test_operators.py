"""The ten operators on hand-made rows, against brute force, round trips and held-out labels."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import ann, chat, decontaminate, jaccard, mixing, queries, secrets, sharding, suffix, toxicity, warc
from tests.llm import util
from tests.oracle import SF, duck, same

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, extra=False):
    """documents of (id, text) or (id, text, source) rows; extra adds columns whose names the operators use inside."""
    df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows], DOCS)
    if extra:
        for c in ("id", "th", "key", "_row", "_k", "items", "size", "shard", "spans", "_id", "component_id", "hull"):
            df = df.withColumn(c, F.lit(7))
    return df


# -- operator 1 -----------------------------------------------------------------------------------

def removed(df):
    r = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    rows = suffix.dedup(df).select("doc_id", "n_bytes", r, F.size("spans"), F.sha2("kept", 256)).collect()
    return sorted(map(tuple, rows), key=repr)


def varied(rng, n):
    return "".join(rng.choice("abcdefghij klmno") for _ in range(n))


def test_suffix_cases(spark):
    rng = random.Random(1)
    a, b, c = varied(rng, 1500), varied(rng, 399), varied(rng, 400)
    rows = [(1, None), (2, ""), (3, "short"), (4, a), (5, "x" + a[200:900] + "y"), (6, b), (7, b), (8, c), (9, c), (10, a), (10, a), (None, a[:700] + "é" * 300), (11, "é" * 250), (12, "z" * 2000), (13, varied(rng, 300) + a[100:600] + varied(rng, 50) + a[550:1100])]
    rows += [(100 + k, varied(rng, rng.randrange(600)) + a[k * 7 : k * 7 + 390 + k] + varied(rng, rng.randrange(300))) for k in range(40)]
    assert removed(docs(spark, rows, extra=True)) == sorted(util.repeated(rows), key=repr)
    assert suffix.dedup(docs(spark, [])).count() == 0


def test_suffix_repeats_inside_one_text(spark):
    rng = random.Random(2)
    p = varied(rng, 500)
    rows = [(1, p + varied(rng, 100) + p[50:]), (2, "ab" * 700), (3, varied(rng, 900))]
    assert removed(docs(spark, rows)) == sorted(util.repeated(rows), key=repr)


def test_long_texts_are_sampled_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(suffix, "PIECE", 1000)
    p = varied(rng, 1200)
    data = np.frombuffer((varied(rng, 4000) + p + varied(rng, 500) + p).encode(), np.uint8)
    import pyarrow as pa

    whole = [x for x in suffix._pieces(pa.array([data.tobytes().decode()]))]
    assert len(whole) > 3 and all(len(d) <= 1000 + suffix.LENGTH for _, _, d, _ in whole)
    starts = set()
    for _, base, part, offsets in whole:
        row, lo, hi, *_ = suffix.runs(part, offsets)
        for x, y in zip(lo, hi):
            starts.update(range(base + x, base + y + 1))
    assert starts == set(range(len(data) - suffix.LENGTH + 1))


@pytest.mark.parametrize("most, broadcast", [(suffix.MOST, suffix.BROADCAST_ITEMS), (suffix.MOST, 0), (1, suffix.BROADCAST_ITEMS), (3, 0)])
def test_suffix_on_documents(spark, monkeypatch, most, broadcast):
    """Buckets sorted in a task and by shuffle, items joined by broadcast and by shuffle."""
    monkeypatch.setattr(suffix, "MOST", most)
    monkeypatch.setattr(suffix, "BROADCAST_ITEMS", broadcast)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op1_suffix_dedup(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(util.repeated(rows))


def test_suffix_near_copies(spark, monkeypatch):
    """Unequal runs around common samples, some of which stand for several."""
    rng = random.Random(11)
    base = varied(rng, 1300)
    rows = []
    for k in range(60):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = "#"
        rows += [(k, "".join(t[rng.randrange(200) :]))] * (1 + (k % 7 == 0))
    want = sorted(util.repeated(rows), key=repr)
    assert removed(docs(spark, rows)) == want
    monkeypatch.setattr(suffix, "MOST", 4)
    assert removed(docs(spark, rows)) == want


def test_periodic_texts_are_settled_inside(spark):
    """A few rows stand for thousands of equal runs; different documents still meet."""
    import pyarrow as pa

    for unit in ("z", "ab", "abcdefg", "Lorem ipsum dolor sit amet. " * 3):
        text = (unit * 20_000)[:20_000]
        batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array([1]), pa.array([2])], ["text", "id", "th"])
        n = sum(len(b) for b in suffix._sampled([batch]))
        assert n <= len(unit) + 3, (unit, n)
    rng = random.Random(12)
    rows = [(1, "z" * 3000), (2, varied(rng, 200) + "z" * 401 + varied(rng, 50)), (3, "ab" * 600 + "z" * 400), (4, "ba" * 220), (5, "z" * 399), (6, "abz" * 200)]
    assert removed(docs(spark, rows)) == sorted(util.repeated(rows), key=repr)


def test_suffix_takes_any_ids_and_texts_that_fool_rolling_hashes(spark):
    t = "a"
    for _ in range(10):  # a Thue-Morse word and its complement
        t += t.translate(str.maketrans("ab", "ba"))
    df = docs(spark, [(1, t), (2, t.translate(str.maketrans("ab", "ba")))]).withColumn("doc_id", F.concat(F.lit("x"), "doc_id"))
    got = {r["doc_id"]: (r["n_bytes"], len(r["spans"])) for r in suffix.dedup(df).collect()}
    want = {f"x{i}": (n, k) for i, n, _, k, _ in util.repeated([(1, t), (2, t.translate(str.maketrans("ab", "ba")))])}
    assert got == want
    same = df.withColumn("text", F.lit(varied(random.Random(1), 450)))
    assert all(r["kept"] == b"" for r in suffix.dedup(same).collect())


# -- operator 2 -----------------------------------------------------------------------------------

def test_toxicity_learns_and_generalises():
    rng = random.Random(4)
    clean = [varied_word(rng) for _ in range(800)]
    bad = ["wretchling", "dunderpate", "grimblefool"]
    make = lambda toxic: " ".join(rng.choice(clean) for _ in range(rng.randrange(20, 120))) + ((" " + " ".join(rng.choice(bad) + " " + rng.choice(clean) for _ in range(3))) if toxic else "")
    y = [int(rng.random() < 0.2) for _ in range(700)]
    texts = [make(t) for t in y]
    model = toxicity.fit(texts[:500], y[:500])
    import pyarrow as pa

    s = model.scores(pa.array(texts[500:]))
    assert ((s >= 0.3) == np.array(y[500:], bool)).mean() > 0.95
    odd, plain = model.scores(pa.array([" ".join(clean[:10]) + " wretchlling dunderpatte grimblefol", " ".join(clean[:13])]))
    assert odd > plain
    assert np.array_equal(model.bucket, toxicity.fit(texts[:500], y[:500]).bucket)


def varied_word(rng):
    return "".join(rng.choice(["ba", "ke", "ti", "ro", "mu", "sa"]) for _ in range(rng.randrange(1, 4)))


def test_toxicity_edges(spark):
    import pyarrow as pa

    for texts, y in (([], []), (["a b"], [1]), (["", ""], [0, 1])):
        s = toxicity.fit(texts, y).scores(pa.array(["", None, "x " * 5000, "?!"], pa.string()))
        assert len(s) == 4 and ((s >= 0) & (s <= 1)).all()
    model = toxicity.fit(["good day", "vile vile"] * 30, [0, 1] * 30)
    df = toxicity.score(docs(spark, [(1, None), (1, None), (None, "vile"), (3, "x" * 100_000)], extra=True), model)
    assert df.columns == ["doc_id", "score", "predicted"] and df.count() == 4
    assert toxicity.score(docs(spark, []), model).count() == 0
    assert toxicity.drop_toxic(docs(spark, [(1, "a")], extra=True), model).columns == docs(spark, [], extra=True).columns


def test_toxicity_learns_only_from_rows_that_are_not_held_out(spark):
    ids = list(range(60))
    df, labels = docs(spark, [(i, f"text {i}") for i in ids]), spark.createDataFrame([(i, 1, i % 2) for i in ids] + [(None, 1, 1), (1, 1, None)], "doc_id bigint, quality int, toxic int")
    seen = []
    keep, toxicity.fit = toxicity.fit, lambda texts, y, **k: seen.extend(texts)
    try:
        toxicity.train(df, labels)
    finally:
        toxicity.fit = keep
    assert sorted(seen) == sorted(f"text {i}" for i in ids if not util.held_out(i))
    got = {r["doc_id"]: r["h"] for r in df.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {i: util.held_out(i) for i in ids}


def test_toxicity_learns_one_text_of_each_id(spark, monkeypatch):
    ids = [i for i in range(20) if not util.held_out(i)]
    rows = [(ids[0], f"copy {k}") for k in range(200)] + [(i, f"text {i}") for i in ids[1:]]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id bigint, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, **k: seen.append(texts))
    for part in (rows, rows[::-1]):
        toxicity.train(docs(spark, part), labels, sample=len(ids))
    assert seen[0] == seen[1] and len(seen[0]) == len(ids) and {t for _, t in rows[200:]} < set(seen[0])


def test_toxicity_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    scored = {r["doc_id"]: r for r in queries.op2_toxicity(spark, sf).collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in scored]
    held = [(scored[i]["score"], y) for i, y in labels if scored[i]["held_out"]]
    order = [y for _, y in sorted(held, reverse=True)]
    precision = [sum(order[: k + 1]) / (k + 1) for k, y in enumerate(order) if y]
    assert np.mean(precision) > 0.5  # chance is about 0.13


def slow_score(model, text):
    """Word by word and window by window: the worst window of WINDOW words decides."""
    total = []
    for word in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").translate(util.LOWER).encode()):
        w = b"<" + word + b">"
        values = []
        for n in toxicity.NGRAMS:
            for i in range(len(w) - n + 1):
                h = sum(w[i + j] * int(toxicity._K[n][j]) for j in range(n)) % 2**32
                h ^= h >> 15
                values.append(float(model.bucket[(h * 0x9E3779B1) % 2**32 >> (32 - toxicity.BUCKETS_LOG2)]))
        total.append(sum(values) / len(values))
    k = toxicity.WINDOW
    windows = [total[i : i + k] for i in range(max(1, len(total) - k + 1))] if total else []
    best = max(sum(x) / len(x) for x in windows) + model.bias if windows else min(0.0, model.bias)
    return 1 / (1 + np.exp(-(model.scale * best + model.shift)))


def test_long_texts_are_scored_in_portions(monkeypatch):
    import pyarrow as pa

    rng = random.Random(14)
    model = toxicity.fit(["good day " * 5, "vile wretch " * 5] * 30, [0, 1] * 30)
    texts = [" ".join(rng.choice(["good", "day", "vile", "w" * rng.randrange(1, 90)]) for _ in range(rng.randrange(1, 400))) for _ in range(60)] + ["x" * 700, "?" * 700, " " * 700 + "vile"]
    whole = [float(model.scores(pa.array([t]))[0]) for t in texts]
    monkeypatch.setattr(toxicity, "PORTION", 200)
    assert [float(model.scores(pa.array([t]))[0]) for t in texts] == pytest.approx(whole, abs=1e-9)


def test_words_are_hashed_in_portions(monkeypatch):
    from lectern.llm import _text

    rng = random.Random(15)
    words = ["".join(rng.choice("abé") for _ in range(rng.choice([1, 3, 60, 64, 65, 200, 900]))) for _ in range(300)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    whole, _ = _text.word_hashes(data, np.array([0, len(data)]))
    assert len(set(whole.tolist())) == len(set(words))
    for n in (1, 7, 100, 5000):
        monkeypatch.setattr(_text, "PORTION", n)
        assert np.array_equal(_text.word_hashes(data, np.array([0, len(data)]))[0], whole)


def test_toxicity_query_against_a_slow_scorer(spark):
    df, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(df, labels)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    got = queries.op2_toxicity(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["score"] == pytest.approx(slow_score(model, texts[r["doc_id"]]), abs=1e-9)
        assert r["held_out"] == util.held_out(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.3)


# -- operator 3 -----------------------------------------------------------------------------------

def test_lookup_table():
    t = sharding.lookup_table(["a", "b", "c"], 31)
    assert max(collections.Counter(t).values()) - min(collections.Counter(t).values()) <= 1
    names = [f"s{i}" for i in range(10)]
    big, less = sharding.lookup_table(names, 1009), sharding.lookup_table(names[:-1], 1009)
    moved = sum(x != y for x, y in zip(big, less) if x != 9)
    assert moved < 0.25 * 1009
    for bad in (([], 31), (["a", "a"], 31), (["a"], 30), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement(spark):
    df = docs(spark, [(1, "a"), (1, "a"), (None, "b"), (2, None)], extra=True)
    rows = sharding.place(df).collect()
    assert len(rows) == 4 and sharding.place(df).columns[:-1] == [c for c in df.columns if c != "shard"]
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert sharding.place(docs(spark, [])).count() == 0
    table = sharding.lookup_table()
    for r in rows:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == table[int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE]


def test_placement_is_native(spark):
    plan = queries.op3_sharding(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


# -- operator 4 -----------------------------------------------------------------------------------

def parse_record(data):
    head, block = data.split(b"\r\n\r\n", 1)
    first, *lines = head.decode().split("\r\n")
    return first, dict(x.split(": ", 1) for x in lines), block


def test_warc_records(spark):
    import base64

    html = '<html><head><title>t</title></head><body><p>A &amp;lt; b<br>cé </p><script>x</script></body></html>'
    rows = [(1, "http://a/", html, "HTTP/1.1 404 Not Found\nServer: x\nX-Y: z\n"), (2, None, None, None), (2, None, None, None), (3, "http://b/", "x" * 200_000, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, headers string")
    out = warc.derive(df, http_headers="headers")
    assert out.count() == 12
    got = collections.defaultdict(dict)
    for r in out.withColumn("bytes", warc.record_bytes(out)).collect():
        version, fields, block = parse_record(bytes(r["bytes"]))
        block = block[: int(fields["Content-Length"])]
        assert version == "WARC/1.1" and bytes(r["bytes"]).endswith(b"\r\n\r\n")
        assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        got[r["page_id"]][r["record_type"]] = (fields, block.decode())
    response, metadata, conversion = (got[1][k] for k in ("response", "metadata", "conversion"))
    assert metadata[0]["WARC-Refers-To"] == conversion[0]["WARC-Refers-To"] == response[0]["WARC-Record-ID"] and "WARC-Refers-To" not in response[0]
    assert response[1] == "HTTP/1.1 404 Not Found\r\nServer: x\r\nX-Y: z\r\n\r\n" + html
    assert "source-status: HTTP/1.1 404 Not Found\r\n" in metadata[1] and "source-header: Server: x\r\nsource-header: X-Y: z\r\n" in metadata[1]
    assert conversion[1] == "A &lt; b\ncé"
    assert response[0]["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert got[2]["conversion"][1] == ""
    assert len({x[0]["WARC-Record-ID"] for p in got.values() for x in p.values()}) == 9
    assert warc.derive(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


UNITS = ["<!-- ", "-->", "<script >", "<SCRIPT ", "</script >", "<style>", "</Style>", "<head ", "</head>", "<!doctype", ">", "<p", "<p ", "</div>", "<a", "<a href=1>", "text", "\n", "<", "</", "<!--", "ſ", "<noscript>", "</noscript   >"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(UNITS), max_size=30).map("".join))
def test_markup_goes_as_the_patterns_say(html):
    ascii_ = lambda p: re.compile(p.replace("(?is)", "").replace("(?i)", ""), re.I | re.S | re.A)
    want = re.compile(warc._TAGS).sub("", ascii_(warc._BREAKS).sub("\n", ascii_(warc._DROPPED).sub(" ", html)))
    assert warc.without_markup(html) == want


def test_two_megabytes_of_openings_take_linear_time():
    import time

    for unit in ("<!-- a", "<script ", "<head >x", "<!doctype", "<p ", "<a", "</div ", "<script </script ", "<!-- <style> ", "< ", "<!--><p>"):
        began = time.time()
        warc.without_markup(unit * (2_000_000 // len(unit)))
        assert time.time() - began < 4, unit


def test_warc_decodes_every_reference(spark):
    import html

    names = [f"&{n}" for n in html.entities.html5]
    forms = ["&#8217;", "&#x2019;", "&#X1F600;", "&#8217 x", "&#x41;&#0065;", "&#128;&#x9f;&#129;", "&#0;&#xD800;&#1114112;&#99999999999999999999999;&#xFFFFFFFFFFFFFFFFFFFFFF;", "a&#xFEFF;b", "&copy2026", "&notit; &notin;", "&amp;copy; &am &unknown; & && &; &#; &#x; &#xg;", "Müller &mdash; caf&eacute; &copy; &middot;"]
    rows = [(i, "u", f"<p>[{t}]</p>") for i, t in enumerate(names + forms)]
    got = {r["page_id"]: r["block"] for r in warc.derive(spark.createDataFrame(rows, "page_id bigint, url string, html string")).where("record_type = 'conversion'").collect()}

    def plain(t):
        t = html.unescape(t.replace("&#129;", "\x81")).replace("\xa0", " ")  # 0x81 stands for itself in HTML5
        return re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\x0b\f]+", " ", f"[{t}]"))

    assert len(names) > 2000 and got == {i: plain(t) for i, t in enumerate(names + forms)}


def test_warc_pages_hold_no_references(spark):
    got = warc.derive(spark.read.parquet(f"{SF}/pages.parquet")).where("record_type = 'conversion'").select("block", "payload_digest").collect()
    assert got and all("©" in r[0] and "·" in r[0] and not re.search("&(copy|middot);", r[0]) for r in got)


def test_warc_oracle_decodes_every_reference(spark, tmp_path):
    import html

    import duckdb

    texts = [f"<p>[&{n}]</p>" for n in html.entities.html5] + ["", "&#128;&#x9f;&#129;&#0;&#xD800;&#1114112;&#99999999999999999999999;", "&copy20 &notit; &nosuch; & &&amp;lt; &#8217 x &#X1F600;"]
    spark.createDataFrame(list(enumerate(texts)), "page_id bigint, html string").withColumn("url", F.lit("u")).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    cur = con.execute(warc.oracle_sql())
    names = [c[0] for c in cur.description]
    got = warc.derive(spark.read.parquet(f"{tmp_path}/pages.parquet")).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cur.fetchall()))


def test_warc_keeps_what_the_source_says(spark):
    lines = "WARC-Type: response\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-IP-Address: 192.0.2.1\ncontent-length: 7\nWARC-Warcinfo-ID: <urn:uuid:0>\n"
    rows = [(1, "http://a/", "<p>x</p>", "<urn:uuid:1>", "sha1:GIVEN", lines, "2024-05-06T07:08:09Z"), (2, "http://a/", "<p>x</p>", None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, rid string, pd string, wh string, at string")
    for c in ("id", "uri", "payload", "block", "r", "text", "given", "lines", "own_id", "http", "name"):
        df = df.withColumn(c, F.lit(7))  # names that the operator uses inside
    out = warc.derive(df, date="at", source_id="rid", source_digest="pd", warc_headers="wh")
    got = {(r["page_id"], r["record_type"]): r for r in out.collect()}
    one, meta, text = (got[1, k] for k in ("response", "metadata", "conversion"))
    assert one["record_id"] == meta["refers_to"] == text["refers_to"] == "<urn:uuid:1>" and one["payload_digest"] == "sha1:GIVEN" and text["payload_digest"] != "sha1:GIVEN"
    assert "WARC-IP-Address: 192.0.2.1\r\nWARC-Warcinfo-ID: <urn:uuid:0>\r\n" in one["header"] and one["header"].count("WARC-Record-ID") == 1 and one["header"].lower().count("content-length") == 1
    assert "source-warc-header: WARC-IP-Address: 192.0.2.1\r\n" in meta["block"] and "source-payload-digest: sha1:GIVEN\r\n" in meta["block"] and meta["block"].count("source-warc-header") == 5
    assert all(r["date"] == "2024-05-06T07:08:09Z" for r in (one, meta, text)) and "WARC-IP-Address" not in meta["header"]
    plain = {(r["page_id"], r["record_type"]): r for r in warc.derive(df).collect()}
    assert got[2, "response"] == plain[2, "response"] and got[2, "metadata"] == plain[2, "metadata"]


# -- operator 5 -----------------------------------------------------------------------------------

def slow_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(x[2] for x in sorted(out))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "token", "api_key", "apikey", '"', "'", " ", "=", ":", "abcdef123456", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "\n", "x", "secret", "ſecret", "K"]), max_size=25))
def test_base_spans(parts):
    text = "".join(parts)
    assert secrets.joined([s for s in secrets.scan(text) if s.kind != "named"]) == slow_base(text)


def test_named_spans():
    def named(text):
        return [text[s.start : s.end] for s in secrets.scan(text) if s.kind == "named"]

    assert named('db_pwd = "Xk29!fjw#Qz81"') == ["Xk29!fjw#Qz81"]
    assert named('KEY = "aB3$kd92LmQ!x"\nclientCredential = KEY\n') == ["aB3$kd92LmQ!x"]
    assert named('{"authToken": "q8#Zr!92kdPw5"}') == ["q8#Zr!92kdPw5"]
    assert named('passphrase = "aB3$kd9" + "2LmQ!x"') == ['aB3$kd9" + "2LmQ!x']
    assert named('password = "changeme"\ncolour = "aB3$kd92LmQ!x"\nsecret = "the quick brown fox"') == []
    assert named("note: token of love, 3 = 4") == []


def test_unquoted_constants_are_carried_on():
    def named(text):
        return [text[s.start : s.end] for s in secrets.scan(text) if s.kind == "named"]

    value = "Zk93!fjw#Qz81"
    for ref in ("$A", "${A}", "A"):
        assert named(f"A={value}\npassphrase={ref}\n") == [value]
        assert named(f"A: {value}\nB: {ref}\npassphrase: ${{B}}\n") == [value]
        assert named(f'A = "{value}"\npassphrase = {ref}\n') == [value]
    assert named(f"passphrase = ${{A}} + '!x'\nA={value}\n") == []
    assert named(f'A = "{value}"\nif A == b:\n  A=none\npassphrase = A\n') == [value]
    assert named(f"A=none\nA = \"{value}\"\nB = A\npassphrase = B\n") == [value]
    assert named("Zk93fjwQz81x = 5\npassphrase = Zk93fjwQz81x\n") == ["Zk93fjwQz81x"]
    assert named(f"A={value}\npassphrase = A + (b)\n") == [value]


def test_constants_that_double_and_names_of_any_length():
    import time

    began = time.time()
    assert secrets.joined(secrets.scan('tok = "xxxxxxxxxxxxxxxx"\n' + "tok = tok + tok\n" * 10_000)) == ""
    for text in ("token=" * 20_000, "a=b+" * 30_000, 'k0 = "' + "aB1%" * 900 + '"\n' + "".join(f"k{i + 1} = k{i} + 'y'\n" for i in range(20_000)), "='" * 50_000, "=" + " " * 50_000 + "="):
        secrets.scan(text)
    assert time.time() - began < 20
    named = lambda text: [text[s.start : s.end] for s in secrets.scan(text) if s.kind == "named"]
    value = "Zk93!fjw#Qz81"
    assert named(f'a = "Zk93!f"\na = a + "jw#Qz81"\npassphrase = a\n') == ['Zk93!f"\na = a + "jw#Qz81']
    assert named(f'secret.{"x" * 500} = "{value}"') == [value] and named(f'passphrase{" " * 300}= "{value}"') == [value]
    assert named(f'credential: str = "{value}"') == [value] and named(f'x["passphrase"] = "{value}"') == [value]


def test_literals_of_any_length():
    import base64
    import time

    rng, began = random.Random(3), time.time()
    named = lambda text: [text[s.start : s.end] for s in secrets.scan(text) if s.kind == "named"]
    for n in (4000, 6300, 100_000, 3_000_000):
        value = base64.b64encode(rng.randbytes(n)).decode()[:n]
        assert named(f"db_passphrase = '{value}'") == [value]
        assert named(f"a = '{value}'\nb = a + '!'\ndb_passphrase = b\n") == [f"{value}'\nb = a + '!"]
        for hidden in ("x" * n, "<" + value + ">", "${" + value + "}", "your_" + value, value + " " + value, "*" * n):
            assert not named(f"db_passphrase = '{hidden}'")
    grown = named("passphrase = 'aB3$kd92LmQ!x7Zp'\n" + "passphrase = passphrase + passphrase\n" * 3000)
    assert len(grown) == 1  # one span, from the constant itself
    named("".join(f"token{k} = '{'aB3$kd92LmQ!x7Zp' * 4}'\ntoken{k} = token{k - 1} + token{k}\n" for k in range(1, 5000)))
    assert time.time() - began < 30


@given(st.lists(st.text(alphabet="xX*.<>${}%ab Zk9!_your-", max_size=40), min_size=1, max_size=5))
def test_scores_of_sums_are_those_of_the_whole(parts):
    whole = "".join(parts)
    total = secrets.Characters.of("")
    for p in parts:
        total = total + secrets.Characters.of(p)
    assert abs(secrets.character_score(total) - secrets.literal_score(whole)) < 1e-9
    long = secrets.Characters.of(whole * 20)
    assert "\n" in whole or secrets.is_placeholder(long) == bool(secrets.PLACEHOLDER.match(whole * 20))


def test_secrets_query_on_documents(spark):
    sf = SF.replace("0.001", "0.01")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op5_secrets(spark, sf).collect()
    assert len(got) == len(texts)
    found = 0
    for r in got:
        t = texts[r["doc_id"]] or ""
        base = slow_base(t)
        kinds = collections.Counter(x.split(":")[0] for x in base.split(",") if x)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [x for x in spans if not x.startswith("named")] == [x for x in base.split(",") if x] and r["spans"] == secrets.joined(secrets.scan(t))
        found += len(spans)
    assert found


def test_secrets_rows(spark):
    rows = secrets.find_secrets(docs(spark, [(1, None), (1, None), (2, ""), (None, "token=abcdefghijkl"), (3, "x=" * 50_000)], extra=True)).collect()
    assert sorted(len(r["spans"]) for r in rows) == [0, 0, 0, 0, 1]
    assert secrets.find_secrets(docs(spark, [])).count() == 0


# -- operator 6 -----------------------------------------------------------------------------------

TEXT = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", " ", "a", "\n", ">", "]", "é", "INST", "/s"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "<s>", "a\\"]), TEXT), max_size=5))
def test_chat_round_trip(turns):
    rendered, spans = chat.render(turns)
    assert [(r, t) for r, t, _, _ in chat.parse(rendered)] == turns
    assert [chat.unescape(rendered[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_plain_texts_are_not_escaped_and_bad_text_is_refused():
    assert chat.render_turn("user", "plain \\ < [ text") == ("[INST] plain \\ < [ text [/INST]", False, 7, 23)
    assert chat.render_turn("user", "</s>")[1]
    for bad in ("x", "[INST] a", "[INST]a[/INST]", "</s>", "<|role|>x<|end|>"):
        with pytest.raises(chat.GrammarError):
            list(chat.parse(bad))


def test_chat_rows(spark):
    kind = "conv_id bigint, turn bigint, role string, text string"
    df = spark.createDataFrame([(1, 0, None, None), (1, 1, "assistant", "a</s>"), (1, 1, "assistant", "a</s>"), (None, 0, "user", "x"), (2, None, "tool", "y" * 100_000)], kind)
    rows = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert rows[1]["n_turns"] == 3 and rows[1]["loss_chars"] == 10 and rows[1]["loss_sha256"] == hashlib.sha256(b"a</s>a</s>").hexdigest()
    assert rows[1]["turns_sha256"] == hashlib.sha256(b"\n\nassistant\na</s>\nassistant\na</s>\n").hexdigest()
    assert set(rows) == {1, 2, None}
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], kind))).count() == 0


def test_chat_with_clashing_names_and_long_texts(spark):
    rows = [(k, t, "assistant" if t % 2 else "user", "y </s> " * 20_000 if t else None) for k in range(3) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for c in ("conv", "piece", "escaped", "text_start", "text_end", "in_loss"):
        df = df.withColumn(c, F.lit(7))
    got = chat.read_back(chat.format_turns(df)).collect()
    assert sorted((r["conv_id"], r["n_turns"], r["loss_chars"]) for r in got) == [(k, 4, 2 * 140_000) for k in range(3)]
    renamed = df.drop("conv").withColumnsRenamed({"conv_id": "c d", "text": "t"})
    assert chat.read_back(chat.format_turns(renamed, conv="c d", text="t"), conv="c d").count() == 3


# -- operator 7 -----------------------------------------------------------------------------------

def sized_docs(rng, n, sources):
    return [(i, "w " * rng.randrange(1, 60), sources[min(int(rng.random() ** 2 * len(sources)), len(sources) - 1)]) for i in range(n)]


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40)
    rng = random.Random(7)
    rows = sized_docs(rng, 900, ["a", "B", "é", "z", None, "m"]) + [(5000, None, "a"), (5001, "", "only-empty"), (5002, "one two three", "z"), (5002, "one two three", "z")]
    df = docs(spark, rows, extra=True)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = util.targets(sizes)
    taken, docs_of = collections.Counter(), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        docs_of[r["source"]] += 1
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60, s
    again = mixing.mix(df.repartition(7, "text")).collect()
    key = lambda rs: sorted((r["doc_id"], r["size"], r["taken"]) for r in rs)
    assert key(got) == key(again)
    whole = mixing.mixed_rows(df)
    assert whole.columns == df.columns and whole.count() == sum(r["n_copies"] for r in got)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_repeated_rows_share_what_the_mix_takes(spark, monkeypatch):
    """Rows of one id, text and source, equal or not in other columns: shares differ by one at most, whatever the steps and partitions."""
    rows = [(1, "a b c", "x", i % 3) for i in range(500)] + [(2, "a b", "x", i) for i in range(300)] + [(None, None, None, 0)] * 40 + [(10 + i, "w " * (i % 9), ("x", "y", None)[i % 3], 0) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra bigint")
    want = collections.Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"]] += r["n_copies"]
    have = collections.Counter(rows)
    results = []
    for step, broadcast, parts in ((10_000, 500_000, 4), (7, 0, 3)):
        monkeypatch.setattr(mixing, "STEP", step)
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
        got = collections.Counter(map(tuple, mixing.mixed_rows(df.repartition(parts)).collect()))
        by_id = collections.Counter()
        for r, n in got.items():
            by_id[r[0]] += n
        assert by_id == +want and all(n <= 2 * have[r] for r, n in got.items())
        for i, n in ((1, 500), (2, 300), (None, 40)):
            least = want[i] // n
            assert all(least * m <= got[r] <= (least + 1) * m for r, m in have.items() if r[0] == i)
        results.append(got)
    assert results[0] == results[1]


def test_mixing_query_on_documents(spark):
    """Targets, bounds and sizes of the query's rows, the same rows on a rerun, and words near every target."""
    sf = SF.replace("0.001", "0.01")
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sizes, size_of = collections.Counter(), {}
    for r in rows:
        size_of[r["doc_id"]] = (r["source"], len(util.WORD.findall(r["text"] or "")))
        sizes[r["source"]] += size_of[r["doc_id"]][1]
    want = util.targets(sizes)
    got = queries.op7_mixing(spark, sf).collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        source, size = size_of[r["doc_id"]]
        assert r["size"] == size and r["source_size"] == sizes[source] and r["target"] == pytest.approx(want[source])
        assert 0 <= r["taken"] <= 2 * size and (r["taken"] % size == 0 if size else True)
        taken[source] += r["taken"]
    assert max(abs(taken[s] - want[s]) / want[s] for s in want) < 0.01
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op7_mixing(spark, sf).collect()))


def test_mixing_by_shuffle_and_of_any_ids(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    key = lambda: (sorted((r["doc_id"], r["taken"]) for r in mixing.mix(df).collect()), sorted(r["doc_id"] for r in mixing.mixed_rows(df).collect()))
    few = key()
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert key() == few


def test_flight_leaves_two_and_keeps_totals():
    rng = np.random.RandomState(8)
    size = rng.randint(1, 1000, 500).astype(float)
    pi = np.full(500, 0.37)
    out = mixing.flight(pi, size, rng.rand(500))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(pi.sum()) and (out * size).sum() == pytest.approx((pi * size).sum())
    assert set(mixing.land(out, size)) <= {0.0, 1.0}
    out = mixing.flight(pi, size, rng.rand(500), mixing.LAND)
    left = ((out > 0) & (out < 1)).sum()
    assert 2 < left <= mixing.LAND and (out * size).sum() == pytest.approx((pi * size).sum())
    assert abs((mixing.land(out, size) * size).sum() - (pi * size).sum()) < 1
    assert mixing.flight(np.full(4, 0.5), np.zeros(4), np.full(4, 0.5)).sum() == pytest.approx(2)


# -- operator 8 -----------------------------------------------------------------------------------

def slow_tiles(item, doc, least):
    mi, md, out = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] and i + k not in mi and d + k not in md:
                    k += 1
                if k > best[0]:
                    best = (k, i, d)
        if best[0] < least:
            return out
        out += best[0]
        mi.update(range(best[1], best[1] + best[0]))
        md.update(range(best[2], best[2] + best[0]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=40))
def test_tiling(item, doc):
    a, b = np.array(item, np.uint64), np.array(doc, np.uint64)
    assert sum(t[2] for t in decontaminate.tile(a, b, 3)) == slow_tiles(item, doc, 3)


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, "tiny item"), (4, "One, two! three; four five six seven eight nine ten")], "item_id bigint, text string")
    rows = [(1, "x ONE two three four FIVE y z"), (2, "six seven eight nine ten and one two three four five"), (3, "one two three four"), (4, None), (5, ""), (6, "a tiny, item"), (None, "five six seven eight nine"), (7, "w " * 50_000 + "six seven eight nine ten")]
    df = docs(spark, rows, extra=True)
    got = collections.defaultdict(list)
    for r in decontaminate.contaminated(df, bench).collect():
        got[r["doc_id"]].append((r["item_id"], r["covered_words"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, 5), (4, 5)], 2: [(1, 10), (4, 10)], 6: [(3, 2)], None: [(1, 5), (4, 5)], 7: [(1, 5), (4, 5)]}
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(df, empty).count() == 0 and decontaminate.drop_contaminated(df, empty).count() == 8
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    whole = sorted(map(tuple, queries.op8_decontaminate(spark, SF).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert whole and sorted(map(tuple, queries.op8_decontaminate(spark, SF).collect())) == whole


def test_decontamination_against_brute_force(spark):
    words = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").translate(util.LOWER))
    items = [(r[0], words(r[1])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        d = words(r["text"])
        runs = {tuple(d[i : i + 5]) for i in range(len(d) - 4)}
        for k, w in items:
            if any(tuple(w[i : i + 5]) in runs for i in range(len(w) - 4)) and len(d) < 1500 and slow_tiles(w, d, 5) * 2 >= len(w):
                want.add((r["doc_id"], k))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op8_decontaminate(spark, SF).collect()}
    assert want <= got and want


def test_decontamination_equals_brute_force_on_all_documents(spark):
    words = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").translate(util.LOWER))
    items = [(r[0], words(r[1])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        d = words(r["text"])
        runs = {k: {tuple(d[i : i + k]) for i in range(len(d) - k + 1)} for k in range(1, 6)}
        for k, w in items:
            n = min(5, len(w))
            if n and any(tuple(w[i : i + n]) in runs[n] for i in range(len(w) - n + 1)) and slow_tiles(w, d, n) * 2 >= len(w):
                want.add((r["doc_id"], k))
    assert want and {(r["doc_id"], r["item_id"]) for r in queries.op8_decontaminate(spark, SF).collect()} == want


def test_decontamination_of_any_ids_and_repeated_rows(spark):
    words = [f"w{i}" for i in range(12)]
    items = [(7, " ".join(words)), (7, " ".join(words)), (8, "other words entirely unlike the first one")]
    rows = [(1, " ".join(["x", *words, "y"])), (1, " ".join(["x", *words, "y"])), (2, "nothing"), (3, " ".join(words[6:] + ["z"] + words[:6]))]
    for kind in ("int", "bigint", "string", "smallint"):
        bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("item_id", F.col("item_id").cast(kind))
        df = docs(spark, rows, extra=True).withColumn("doc_id", F.col("doc_id").cast(kind))
        got = decontaminate.contaminated(df, bench)
        assert dict(got.dtypes)["doc_id"] == dict(got.dtypes)["item_id"] == kind
        assert sorted((int(r["doc_id"]), int(r["item_id"]), r["tiles"]) for r in got.collect()) == [(1, 7, 1)] * 4 + [(3, 7, 2)] * 2
        assert [int(r["doc_id"]) for r in decontaminate.drop_contaminated(df, bench).collect()] == [2]


def test_tiles_are_compared_word_by_word(monkeypatch):
    """Runs whose hashes collide are no match."""
    monkeypatch.setattr(decontaminate, "_runs", lambda h, width: np.zeros(max(0, len(h) - width + 1), np.uint64))
    a, b = np.arange(30, dtype=np.uint64), np.arange(100, 130, dtype=np.uint64)
    b[10:17] = a[3:10]
    assert decontaminate.tile(a, b, 5) == [(3, 10, 7)]


# -- operator 9 -----------------------------------------------------------------------------------

def linked(df):
    return sorted(map(tuple, jaccard.component_ids(jaccard.link(df)).collect()), key=repr)


def near_copies(rng, n):
    base = [varied_word(rng) for _ in range(60)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"u{rng.randrange(10**6)}"
        out.append((1000 + k, " ".join(w)))
    return out


def test_jaccard_cases(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG", 8)
    rng = random.Random(9)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "A  B"), (6, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (8, "a b c d e f"), (None, "A b c d e"), (9, "lone words here now ok"), (10, "q " * 30_000)]
    half = [f"w{i}" for i in range(40)]
    rows += [(20, " ".join(half + [f"x{i}" for i in range(6)])), (20, " ".join(half + [f"x{i}" for i in range(6)])), (21, " ".join(half + [f"y{i}" for i in range(6)])), (21, " ".join(half + [f"y{i}" for i in range(6)]))]
    rows += near_copies(rng, 80)
    assert linked(docs(spark, rows, extra=True)) == sorted(util.components(rows), key=repr)
    assert linked(docs(spark, [])) == []


def test_jaccard_on_documents_and_by_shuffle(spark, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted(util.components(rows), key=repr)
    assert sorted(map(tuple, queries.op9_ngram_jaccard(spark, SF).collect()), key=repr) == want
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 10)
    assert sorted(map(tuple, queries.op9_ngram_jaccard(spark, SF).collect()), key=repr) == want


def test_jaccard_of_texts_that_fool_rolling_hashes(spark):
    t = "a"
    for _ in range(10):  # a Thue-Morse word and its complement
        t += t.translate(str.maketrans("ab", "ba"))
    rows = [(1, t), (2, t.translate(str.maketrans("ab", "ba"))), (3, t.upper())]
    assert linked(docs(spark, rows)) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_jaccard_of_any_ids(spark):
    rows = [(1, "a b c d e"), (2, "A b c d e"), (3, "f g h i j")]
    df = docs(spark, rows).withColumn("doc_id", F.concat(F.lit("x"), "doc_id"))
    assert linked(df) == [("x1", 1, "x1"), ("x2", 1, "x1"), ("x3", 1, "x3")]
    assert sorted(r["doc_id"] for r in jaccard.keep_one(df).collect()) == ["x1", "x3"]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60), st.integers(0, 60))
def test_bitmaps_bound_the_difference(a, b, common):
    b = b | set(list(a)[:common])
    x, y = (jaccard.bitmap(np.array(sorted(s), np.uint64)) for s in (a, b))
    assert sum(bin(int(v)).count("1") for v in (x ^ y).view(np.uint64)) <= len(a ^ b)


def test_keep_one(spark):
    rows = [(5, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, "other words are here too"), (1, None), (2, ""), (None, "a b c d e"), (None, "only null ids are here")]
    df = docs(spark, rows, extra=True)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(3, "a b c d e"), (9, "other words are here too"), (1, None), (2, ""), (None, "only null ids are here")], key=repr)
    assert jaccard.keep_one(docs(spark, [])).count() == 0


def test_keep_one_of_near_copies_without_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words, f"x{k}"]) for k in range(3)]
    lone, other = "only null ids are here", " ".join(f"v{i}" for i in range(60))
    rows = [(None, t) for t in [*near, near[0], lone]] + [(None, other), (4, other + " y")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(docs(spark, rows, extra=True)).collect()]
    assert len(kept) == 3 and {(None, lone), (4, other + " y")} < set(kept) and len([t for _, t in kept if t in near]) == 1


def test_rare_and_frequent_shingles_are_cut_into_fragments(spark):
    words = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(words, 1)], "text string, rid bigint")
    for level, most in ((0, set(range(jaccard.RARE_FRAGMENTS))), (4, {6}), (12, {7})):
        parts = jaccard._fragments(df, np.full(1 << jaccard.SLOTS_LOG2, level, np.uint8)).collect()
        assert {r["fragment"] for r in parts} == most and sum(len(r["part"]) for r in parts) == 396
    assert (jaccard.RARE_FRAGMENTS, jaccard.FRAGMENTS) == (6, 8)


# -- operator 10 ----------------------------------------------------------------------------------

def exact(rows, queries_, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in queries_:
        v = dict(good)[q]
        best = sorted(((-float((v * x).sum()), i) for i, x in dict(good).items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def test_ann_small_is_exact(spark):
    rng = np.random.RandomState(10)
    rows = [(i, rng.randn(8).tolist()) for i in range(60)] + [(100 + i, [1.0] * 8) for i in range(30)]
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [None] + [1.0] * 7), (204, [1.0]), (205, []), (None, [2.0] * 8), (206, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1)).withColumn("list", F.lit(1))
    qs = [0, 20, 40, 100, 120]
    got = collections.defaultdict(list)
    for r in ann.search(df, df.where(F.col("vec_id").isin(qs))).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = exact([r for r in rows if r[1] is None or len(r[1]) != 1], qs, 20)
    for q in qs:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]])
    assert ann.search(df.limit(0), df).count() == 0
    few = df.where("vec_id IN (0, 1, 2)")
    assert ann.search(few, few).count() == 6


def test_ann_recall(spark):
    sf = SF.replace("0.001", "0.01")
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = collections.defaultdict(set)
    for r in queries.op10_ann(spark, sf).collect():
        got[r["query_id"]].add(r["vec_id"])
    want = exact(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert np.mean([len(got[q] & {i for i, _ in w}) / 20 for q, w in want.items()]) >= 0.9


def test_ann_query_rows(spark):
    """Scores, order and ties of the query's rows; with every list and no shortlist they are the exact answer."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    vector = {i: np.array(v, float) for i, v in rows}
    asked = [i for i, _ in rows if i % 20 == 0]
    got = collections.defaultdict(list)
    for r in queries.op10_ann(spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(asked)
    for q, near in got.items():
        assert [k for k, _, _ in near] == list(range(1, 21)) and len({i for _, i, _ in near}) == 20 and q not in {i for _, i, _ in near}
        assert all(s == pytest.approx(float((vector[q] * vector[i]).sum()), abs=1e-12) for _, i, s in near)
        assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near)
    want = exact(rows, asked, 20)
    whole = collections.defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 20 = 0"), probe_share=1, shortlist=None).orderBy("query_id", "rank").collect():
        whole[r["query_id"]].append(r["vec_id"])
    assert whole == {q: [i for i, _ in near] for q, near in want.items()}


def test_ann_repeated_rows_and_any_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "PORTION", 16)
    monkeypatch.setattr(ann, "BLOCK_BYTES", 200)  # several blocks of queries
    rng = np.random.RandomState(13)
    rows = [(i, rng.randn(4).tolist()) for i in range(50)]
    rows += [rows[5]] * 4 + [(7, (np.array(rows[7][1]) * 2).tolist())] * 2 + [rows[0]] * 3
    for kind in ("int", "bigint", "string"):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("vec_id", F.lpad(F.col("vec_id").cast("string"), 3, "0") if kind == "string" else F.col("vec_id").cast(kind))
        out = ann.search(df, df.where(F.col("vec_id").cast("int") < 6), k=10, probe_share=1, shortlist=None)
        assert dict(out.dtypes)["vec_id"] == kind
        got = collections.defaultdict(list)
        for r in out.orderBy("query_id", "rank").collect():
            got[int(r["query_id"])].append(int(r["vec_id"]))
        best = collections.defaultdict(dict)
        for q in range(6):
            for i, v in rows:
                if i != q:
                    best[q][i] = max(best[q].get(i, -np.inf), float((np.array(rows[q][1]) * np.array(v)).sum()))
        assert got == {q: sorted(x, key=lambda i: (-x[i], i))[:10] for q, x in best.items()}


@pytest.mark.parametrize("kind", ["prime", "lengths", "outliers", "clusters"])
def test_ann_misses_none_whatever_the_vectors(spark, monkeypatch, kind):
    """Dimensions that 16 does not divide, lengths that differ widely, few vectors far longer than the rest, tight clusters: the exact answer."""
    monkeypatch.setattr(ann, "PORTION", 700)
    rng = np.random.RandomState(14)
    x = rng.randn(2000, 67 if kind == "prime" else 32)
    if kind == "lengths":
        x *= np.exp(rng.randn(len(x), 1))
    if kind == "outliers":
        x[::50] *= 100
    if kind == "clusters":
        x = 3 * x[rng.randint(0, 20, len(x))] + 0.01 * x
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q in range(0, len(x), 20):
        s = (x * x[q]).sum(1)
        assert got[q] == [i for i in np.lexsort((np.arange(len(x)), -s)).tolist() if i != q][:20]


# -- scratch tables ---------------------------------------------------------------------------------

def test_operators_remove_their_scratch_tables(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from lectern.llm import _spark

    folder = Path(urlparse(_spark.scratch(spark)).path)
    tables = lambda: len(list(folder.glob("lectern-*")))
    df = docs(spark, [(k, "a b c d e f " * (k % 3) + str(k)) for k in range(20)])
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "vec_id int, embedding array<double>")
    for make in (lambda: jaccard.link(df), lambda: suffix.dedup(df), lambda: mixing.mix(df), lambda: ann.search(vectors, vectors)):
        before = tables()
        kept = make()
        assert tables() == before + 1 and kept.count()
    with pytest.raises(ZeroDivisionError), _spark.Scope():
        before = tables()
        _spark.cut(df)
        raise ZeroDivisionError
    assert tables() == before


# -- all -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_oracle(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name])


def test_registry():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert duck("SELECT count(*) AS n FROM documents")[0] == ["n"]
