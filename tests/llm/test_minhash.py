"""MinHash near-dedup on hand-made rows, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import jaccard, minhash, queries
from tests.llm import util
from tests.oracle import SF

DOCS = "doc_id bigint, text string"


def linked(df):
    return sorted((tuple(r) for r in minhash.link(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def brute(rows):
    return sorted(((i, n, c, i == c) for i, n, c in util.components(rows, 85)), key=repr)


def words(rng, n):
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


def near(rng, base, changes):
    w = list(base)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"u{rng.randrange(10**7)}"
    return w


def test_threshold_of_matches():
    assert minhash.least_matches(4, 0.5, 1 / 16) == 1 and minhash.least_matches(4, 0.5, 0.06) == 0
    assert minhash.LEAST == 34
    rng = np.random.RandomState(3)
    agree = []
    for _ in range(300):  # sets of similarity 0.85
        s = rng.randint(0, 2**63, 115, dtype=np.int64).astype(np.uint64)
        a, b = minhash.signatures([np.sort(np.concatenate((s[:100], s[100:107]))), np.sort(np.concatenate((s[:100], s[107:])))])
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - 100 / 115) < 0.01 and abs(np.std(agree) - (0.87 * 0.13 / 64) ** 0.5) < 0.01


def test_odd_rows(spark):
    rng = random.Random(1)
    half = words(rng, 60)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  B"), (6, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "A b c d e"), (None, None), (9, "lone words here now ok"), (10, "q " * 30_000), (None, "only null ids have this text here")]
    rows += [(11, " ".join(half)), (12, " ".join(half + ["x"])), (13, " ".join(half + ["x", "y", "z"])), (13, " ".join(half + ["x", "y", "z"])), (None, " ".join(half + ["v"]))]
    rows += [(14, " ".join(words(rng, 50_000))), (15, "é ü " * 12)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("id", "th", "n", "rid", "rep", "hub", "sig", "c", "component_id", "kept"):
        df = df.withColumn(c, F.lit(3))
    want = [r if r[0] is not None else (*r[:3], r[2] is None) for r in brute(rows)]
    assert linked(df) == sorted(want, key=repr)
    assert linked(df.limit(0)) == []


@pytest.mark.parametrize("long", [jaccard.LONG, 6])
def test_groups_of_near_copies(spark, monkeypatch, long):
    """Chains, groups around a common original, and passages that many share."""
    monkeypatch.setattr(jaccard, "LONG", long)
    rng = random.Random(long)
    rows, passage = [], words(rng, 40)
    for g in range(12):
        base = words(rng, rng.choice([30, 80, 200]))
        for k in range(rng.choice([2, 5, 40])):
            base = near(rng, base, 1) if g % 3 == 0 else base  # a chain
            rows.append((1000 * g + k, " ".join(near(rng, base, rng.randrange(4)))))
    rows += [(50_000 + k, " ".join(words(rng, 30) + passage + words(rng, 5))) for k in range(60)]
    rng.shuffle(rows)
    assert linked(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_on_documents_and_by_shuffle(spark, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = lambda: sorted(map(tuple, queries.op11_minhash(spark, SF).collect()), key=repr)
    assert got() == brute(rows)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 10)
    assert got() == brute(rows)


def test_copies_of_two_near_texts_cost_what_reading_them_costs(spark):
    """Thousands of repeated rows stand for one row each, in this join and in that of operator 9."""
    rng = random.Random(7)
    base = words(rng, 400)
    texts = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near(rng, base, 3)))], DOCS)
    df = texts.crossJoin(spark.range(5000)).drop("id")
    for link in (minhash.link, jaccard.link):
        found = link(df).groupBy("doc_id", "component_id").count().collect()
        assert sorted(map(tuple, found)) == [(1, 1, 5000), (2, 1, 5000)]
    assert [r["doc_id"] for r in jaccard.keep_one(df).collect()] == [1]


def test_each_representative_is_read_once(spark):
    sets = spark.createDataFrame([(1, 5, 9), (1, 5, 9), (2, 6, 9), (None, 7, 3), (None, 7, 3)], "id bigint, th bigint, n bigint")
    classes = sets.groupBy("n").agg(F.min(F.struct("id", "th")).alias("rep")).withColumn("rid", F.col("n"))
    reps = jaccard.representatives(classes, sets)
    assert sorted((r["rid"], r["more"]) for r in reps.collect()) == [(3, True), (9, True)]
    docs = spark.createDataFrame([(1, 5, "x")] * 4 + [(None, 7, "y")] * 3 + [(2, 6, "z")], "id bigint, th bigint, text string")
    assert sorted(map(tuple, jaccard.one_text_each(docs, reps).collect())) == [("x", 9), ("y", 3)]
