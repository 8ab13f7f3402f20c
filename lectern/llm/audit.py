"""Filter interaction audit (operator 13): what each filter removes under every order of the filters.

A document is the set of the filters that it fails. With five filters there are 32 such sets, and 80
edges of the lattice of subsets: filters already applied, and the one that comes next. Documents are
counted by part, set and labels first; each count adds to the 80 edges, and an order of the filters is
a path of five edges, so its steps are read off the edges by a join. No order is run over the documents.

All of it is DataFrame expressions. Texts are read once and never shuffled: what moves is an id, a digest and a few
bits for each document.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = "ABCDE"  # those of `rules`, then E: a text that a row with a smaller id has, anywhere in the table


def rules(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that a text decides by itself, by letter."""
    words = F.array_remove(F.split(text, SPACES), "")
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, fails, good, toxic, n): documents counted by part, the bits of the filters they fail, and their labels.

    Null texts are empty texts, a null part is the empty string. A copy is a row whose text a row with a smaller id has; null ids
    come after all others and are not smaller than each other. Repeated rows each count; equal ids with one text are no copies of each other.
    An id is good or toxic if any of its labels says 1; labels that are null, and ids without labels, are neither.
    Other columns are not read.
    """
    body = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    bits = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(rules(F.col("text")).values())), F.lit(0))
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{part}`"].cast("string"), F.lit("")).alias("part"), body.alias("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("fails"))
    rows = rows.groupBy("id", "digest", "part", "fails").agg(F.count("*").alias("n"))

    said = lambda c: F.coalesce(F.max(labels[f"`{c}`"].cast("int") == 1), F.lit(False)).alias(c)
    known = labels.groupBy(labels[f"`{id_col}`"].alias("_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    rows = rows.join(known, F.col("id") == F.col("_id"), "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})

    # Of one text: how many rows each (part, labels) has, and how many of them with its smallest id.
    place = F.struct(F.col("id").isNull().alias("none"), "id")
    texts = rows.groupBy("digest", "part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct(place.alias("at"), "n")).alias("least"))
    first = F.min("least.at").over(Window.partitionBy("digest"))  # at most four rows for each part
    firsts = F.when(F.col("least.at").eqNullSafe(first), F.col("least.n")).otherwise(0)
    texts = texts.withColumn("firsts", firsts)
    both = F.array(F.struct("fails", F.col("firsts").alias("n")), F.struct(F.col("fails").bitwiseOR(1 << len(FILTERS) - 1).alias("fails"), (F.col("n") - F.col("firsts")).alias("n")))
    counted = texts.select("part", "good", "toxic", F.explode(both).alias("x")).where("x.n > 0")
    return counted.groupBy("part", "x.fails", "good", "toxic").agg(F.sum("x.n").alias("n"))


def edges(counts: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """One row per part and edge (applied, next) of the lattice of `filters` filters, with what happens on it.

    kept and removed: rows that passed all of `applied` and pass or fail `next`; redundant: rows that fail `next` but went
    before; unique_fails: rows that fail `next` alone; shapley: removed by `next`, summed over all orders. `counts` is as
    from `verdicts`: (part, fails, good, toxic, n).
    """
    lattice = [F.struct(F.lit(s).alias("applied"), F.lit(k).alias("next")) for s in range(1 << filters) for k in range(filters) if not s >> k & 1]
    met = counts.withColumn("edge", F.explode(F.array(*lattice))).select("*", "edge.*")
    own = F.expr("shiftleft(1, next)")
    there, failed = F.col("fails").bitwiseAND(F.col("applied")) == 0, F.col("fails").bitwiseAND(own) != 0
    count = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    sums = met.groupBy("part", "applied", "next").agg(
        count(there & ~failed).alias("kept"), count(there & failed).alias("removed"), count(failed & ~there).alias("redundant"),
        count(F.col("fails") == own).alias("unique_fails"), count(there & failed & F.col("good")).alias("good_lost"), count(there & failed & F.col("toxic")).alias("toxic_lost"),
    )
    orders = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(filters - 1 - k)) for k in range(filters)]), F.bit_count("applied") + 1)
    return sums.withColumn("shapley", F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "next")))


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order of the filters and step, as paths through the edges of `verdicts`; empty docs give no rows."""
    spark = docs.sparkSession
    steps = [("".join(order), k + 1, sum(1 << FILTERS.index(f) for f in order[:k]), FILTERS.index(f)) for order in permutations(FILTERS) for k, f in enumerate(order)]
    paths = spark.createDataFrame(steps, "filter_order string, step int, applied int, next int")
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return edges(verdicts(docs, labels, **columns)).join(F.broadcast(paths), ["applied", "next"]).select("part", "filter_order", "step", *counts)


#: DuckDB SQL of the query's rows: every order is run over the documents, counted by part, failed filters and labels.
ORACLE_SQL = r"""
WITH bodies AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
failed AS (
    SELECT doc_id, part, concat(CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
        CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' END,
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > first THEN 'E' END) AS fails FROM bodies),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
counts AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM failed LEFT JOIN said USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
ran AS (
    SELECT part, o, step, substr(o, step, 1) AS f, n, good, toxic, fails, contains(fails, substr(o, step, 1)) AS fail,
        len(list_filter(range(1, step), lambda i: contains(fails, substr(o, i, 1)))) > 0 AS gone FROM counts, steps),
summed AS (
    SELECT part, o, step, f, sum(CASE WHEN NOT fail AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fail AND NOT gone THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN fail AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN fail AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN fail AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost
    FROM ran GROUP BY part, o, step, f)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM summed
"""
