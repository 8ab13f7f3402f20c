"""Spelling variants and the filter audit on hand-made rows, against plain loops."""

import collections
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import audit, spelling
from tests.llm import util


def counted(rows):
    """Words of (id, text) rows, misspelt as the operator says."""
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(util.LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(n):
    near = {w: [x for x in n if x != w and one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def variants(spark, n, more=()):
    df = spark.createDataFrame([*n.items(), *more], "word string, n bigint").withColumn("form", F.lit(1)).withColumn("a", F.lit("x"))
    return sorted(tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_words_of_odd_rows(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["Reading", "réading", "readings", "ÀÉreading", "x", "short", "under_scored", "digits9between", "ẞharpened", "İstanbul"]) for _ in range(300))) for k in range(40)]
    rows += [(None, "nameless " * 250), (1, None), (2, ""), (3, "12 !?"), (4, "longest" * 5000 + " " + "longest" * 5000), (7, "repeated " * 3), (7, "repeated " * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("n", F.lit(2))
    got = {r["word"]: r["n"] for r in spelling.word_counts(df).collect()}
    assert got == counted(rows) and len(got) > 8
    assert spelling.word_counts(df.limit(0)).isEmpty()


@pytest.mark.parametrize("letters, size", [("ab", 7), ("abcdé", 8), ("xyz", 12)])
def test_every_pair_one_edit_apart_is_found(spark, letters, size):
    rng = random.Random(size)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, size))) for _ in range(250)}
    for w in list(words)[:60]:
        k = rng.randrange(len(w))
        words |= {w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :], w + w[-1]}
    words.discard("")
    found = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert sorted(map(tuple, found)) == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))


def test_a_word_takes_part_a_logarithm_of_times(spark):
    words = spark.createDataFrame([("".join(p),) for p in itertools.product("abcd", repeat=5)], "word string")
    at, tree = spelling._tree(words)
    light = tree.where("ch <> heavy").select(F.col("node").alias("_n"), F.col("ch").alias("_c"))
    most = at.join(light, (F.col("node") == F.col("_n")) & (F.col("ch") == F.col("_c"))).groupBy("word").count().agg(F.max("count")).first()[0]
    assert most <= 10  # log2 of 1,024 words


def test_forms_and_roots(spark):
    n = {"spelling": 1000, "speling": 150, "spelinge": 30, "speelinge": 5, "spellings": 1000, "spellinga": 200, "colour": 50, "color": 50, "coloor": 10, "alone here": 7, "naïveté": 30, "naivété": 6, "naivété!": 6, "naiveté": 6}
    assert variants(spark, n) == grouped(n)
    assert dict((w, r) for w, _, r, *_ in variants(spark, n))["speelinge"] == "spelling"
    assert variants(spark, n, more=[(None, 5), ("", 9)]) == grouped(n)
    assert variants(spark, {"spelling": 10}, more=[("spelling", 15), ("speling", 5)]) == grouped({"spelling": 25, "speling": 5})
    assert variants(spark, {}) == []


def test_variants_of_random_counts(spark):
    rng = random.Random(8)
    n = {"".join(rng.choice("abc") for _ in range(rng.randrange(5, 9))): rng.choice([5, 6, 25, 30, 125, 150, 700, 3125]) for _ in range(300)}
    assert variants(spark, n) == grouped(n)


def test_spelling_query_on_documents(spark):
    from lectern.llm import queries
    from tests.oracle import SF

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op12_spelling_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == grouped(counted(rows))


# -- filter audit ---------------------------------------------------------------------------------

def failures(rows):
    """Letters that each (id, text, source) row fails."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = t in least and (i is None or i > least[t])
        out.append({f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), copy)) if x})
    return out


def audited(rows, labels):
    failed = failures(rows)
    said = lambda i, k: i is not None and any(x[k] == 1 for x in labels if x[0] == i)
    out, removed = {}, collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {r[2] or "" for r in rows}:
            mine = [(r, f) for r, f in zip(rows, failed) if (r[2] or "") == part]
            for k, f in enumerate(order):
                here = [r for r, x in mine if f in x and not x & set(order[:k])]
                out[part, order, k + 1] = [sum(not x & set(order[: k + 1]) for _, x in mine), len(here), sum(f in x and bool(x & set(order[:k])) for _, x in mine), sum(x == {f} for _, x in mine), sum(said(r[0], 1) for r in here), sum(said(r[0], 2) for r in here)]
                removed[part, f] += len(here)
    return sorted((*key, *v, removed[key[0], key[1][key[2] - 1]]) for key, v in out.items())


def test_audit_of_odd_rows(spark):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "few words", "A" * 30, "word " * 60, " ".join(f"w{k}" for k in range(80)), " ".join(f"W{k}" for k in range(80)) + " $", "# " + " ".join(f"v{k % 40}" for k in range(90)), "é x " * 70, " ".join(f"L{k}" for k in range(20_000))]
    rows = [(rng.choice([None, *range(25)]), rng.choice(texts), rng.choice([None, "", "a", "b"])) for _ in range(150)] + [(3, "few words", "a")] * 3
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 22)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for c in ("id", "part", "fails", "good", "toxic", "digest", "n", "edge", "step"):
        df = df.withColumn(c, F.lit(1))
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("x"))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = sorted(tuple(r) for r in audit.audit(df, known).select(*columns).collect())
    assert got == audited(rows, labels)
    assert audit.audit(df.limit(0), known).isEmpty()
    assert sorted(tuple(r) for r in audit.audit(df, known.limit(0)).select(*columns).collect()) == audited(rows, [])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(1, 9)), min_size=1, max_size=6))
def test_edges_of_any_number_of_filters(spark, counts):
    """Removals of a filter over all orders, from three filters' edges, equal a run over each order."""
    df = spark.createDataFrame([("p", m, False, False, n) for m, n in counts], "part string, fails int, good boolean, toxic boolean, n bigint")
    got = {r["next"]: r["shapley"] for r in audit.edges(df, 3).collect()}
    want = collections.Counter()
    for order in itertools.permutations(range(3)):
        for k, f in enumerate(order):
            want[f] += sum(n for m, n in counts if m >> f & 1 and not any(m >> g & 1 for g in order[:k]))
    assert got == {f: want[f] for f in range(3)}
