"""Each stage on its own input, and run() against plain code over the same decisions."""

import collections
import hashlib
import math
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import decontaminate, mixing, sharding, toxicity
from tests.llm import util
from tests.llm.test_operators import slow_score
from tests.oracle import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "sharding"]
    stages = dict(corpus_pipeline.STAGES)

    # toxicity: the rows that score under the threshold
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    low = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    got = stages["toxicity"](spark, docs, SF)
    assert got.columns == columns and sorted(r["doc_id"] for r in got.collect()) == sorted(low)
    rows = [r for r in rows if r[0] in low]

    # near copies: the smallest id of each component, all texts without words
    comp = util.components([(r[0], r[1]) for r in rows])
    first = {c for _, n, c in comp if n} | {i for i, n, _ in comp if not n}
    docs = spark.createDataFrame(got.collect(), got.schema)
    got = stages["ngram_jaccard"](spark, docs, SF)
    assert got.columns == columns and sorted(r["doc_id"] for r in got.collect()) == sorted(first)
    docs = spark.createDataFrame(got.collect(), got.schema)

    # decontamination
    bad = {r["doc_id"] for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    got = stages["decontamination"](spark, docs, SF)
    assert got.columns == columns and sorted(r["doc_id"] for r in got.collect()) == sorted(first - bad)
    docs = spark.createDataFrame(got.collect(), got.schema)

    # mixing: words of each source near its target
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(util.WORD.findall(r["text"]))
    got = stages["mixing"](spark, docs, SF)
    taken = collections.Counter()
    for r in got.collect():
        taken[r["source"]] += len(util.WORD.findall(r["text"]))
    longest = max(len(util.WORD.findall(r["text"])) for r in docs.collect())
    assert got.columns == columns
    for s, t in util.targets(sizes).items():
        assert abs(taken[s] - t) <= longest
    n = got.count()

    placed = stages["sharding"](spark, got, SF)
    assert placed.count() == n and placed.columns == [*columns, "shard"] and placed.where(f"shard NOT BETWEEN 0 AND {len(sharding.SHARDS) - 1}").count() == 0


def brute_tiles(item, doc, least):
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


def test_run(spark):
    """run() against plain code: scores word by word, all pairs, greedy tiles, one block of the cube method for each source, MD5 slots."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.withColumn("_key", F.xxhash64("doc_id", "text")).collect() if slow_score(model, r["text"]) < toxicity.THRESHOLD]

    comp = {i: (n, c) for i, n, c in util.components([(r["doc_id"], r["text"]) for r in rows])}
    rows = [r for r in rows if not comp[r["doc_id"]][0] or comp[r["doc_id"]][1] == r["doc_id"]]

    words = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").translate(util.LOWER))
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        d = words(text)
        runs = {n: {tuple(d[i : i + n]) for i in range(len(d) - n + 1)} for n in range(1, 6)}
        for w in items:
            n = min(5, len(w))
            if n and any(tuple(w[i : i + n]) in runs[n] for i in range(len(w) - n + 1)) and brute_tiles(w, d, n) * 2 >= len(w):
                return True
        return False

    rows = [r for r in rows if not leaks(r["text"])]

    size = {r["doc_id"]: len(util.WORD.findall(r["text"] or "")) for r in rows}
    total = collections.Counter()
    for r in rows:
        total[r["source"]] += size[r["doc_id"]]
    copies = {}
    for s, target in util.targets(total).items():
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: r["_key"])
        rate = target / total[s]
        whole = math.floor(rate + mixing.EPS)
        pi, sizes = np.full(len(own), rate - whole), np.array([size[r["doc_id"]] for r in own], float)
        unit = (np.array([r["_key"] for r in own], np.int64).view(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
        drawn = mixing.land(mixing.flight(pi, sizes, unit, mixing.LAND), sizes) if pi.max() > mixing.EPS else np.zeros(len(own))
        copies |= {r["doc_id"]: whole + int(x) for r, x in zip(own, drawn)}
    table = sharding.lookup_table()
    want = sorted((r["doc_id"], table[int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE]) for r in rows for _ in range(copies[r["doc_id"]]))
    assert want and sorted((r["doc_id"], r["shard"]) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, clashing names, empty tables."""
    lone = "quite other words of their own stand in this one"
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").orderBy(F.desc(F.length("text"))).first()["text"]
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, " \n", "en", None), (4, lone, "en", "b"), (5, lone.upper(), "en", "b"), (4, lone, "en", "b"), (None, lone, None, None), (None, None, None, None), (6, f"first {item} last", "en", "a"), (7, "word " * 60_000, "en", "a"), (7, "word " * 60_000, "en", "a"), (8, "x" * 200_000, "en", "c")]
    df = spark.createDataFrame([(*r, None) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in ("id", "th", "key", "_row", "_k", "size", "_id", "rid", "shard", "score", "component_id", "n_copies"):
        df = df.withColumn(c, F.lit(7))
    stages = dict(corpus_pipeline.STAGES)
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    ids = lambda d: sorted((r["doc_id"] for r in d.collect()), key=repr)
    low = [r for r in rows if slow_score(model, r[1]) < toxicity.THRESHOLD]
    assert ids(stages["toxicity"](spark, df, SF)) == sorted((r[0] for r in low), key=repr)
    assert ids(stages["ngram_jaccard"](spark, df, SF)) == sorted([1, 2, 3, None, 4, 6, 7, 8], key=repr)
    assert ids(stages["decontamination"](spark, df, SF)) == sorted([r[0] for r in rows if r[0] != 6], key=repr)
    mixed = stages["mixing"](spark, df, SF)
    taken = collections.Counter(ids(mixed))
    assert set(taken) <= {r[0] for r in rows} and all(n <= 2 * sum(r[0] == i for r in rows) for i, n in taken.items()) and taken == collections.Counter(ids(stages["mixing"](spark, df.repartition(3), SF)))
    placed = stages["sharding"](spark, df, SF)
    assert placed.count() == len(rows) and placed.columns == [*[c for c in df.columns if c != "shard"], "shard"] and len({r["shard"] for r in placed.where("doc_id IS NULL").collect()}) == 1
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, df.limit(0), SF)
        assert none.count() == 0 and set(df.columns) <= set(none.columns), name
        if name != "sharding":
            assert stage(spark, df, SF).columns == df.columns, name
