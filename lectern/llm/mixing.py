"""Mixing sources to target weights by balanced sampling, the cube method (operator 7).

Every document of a source has the same expected number of copies, the source's
target over its size. The whole part is taken for sure; for the fractional part the
cube method draws which documents get one copy more, so that within each source the
words taken and the documents taken both stay next to their expectation.

The flight phase walks the vector of inclusion probabilities through the null space
of the two balancing constraints (size and count) until almost every entry is 0 or 1.
It runs in blocks of bounded size: a source is dealt into blocks by a hash of the
document, each block flies alone and hands on the at most two documents that are
still fractional, and the survivors fly again until one block per source is left. That one
flies until LAND entries are fractional, and of all their outcomes the one nearest to both totals is taken. So
no task ever holds more than a block, however large a source is.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm._spark import Scope, cut, session_for_texts

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 2000  # documents that fly together on average
LAND = 14  # entries that are left to the landing, all of whose 2 ** LAND outcomes are compared
EPS = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


MOST_SOURCES = 100_000  # sources up to this many (some 10 MB) are ranked in one window and broadcast; more are dealt by ranges and joined by shuffle


def _running(rows: DataFrame, few: bool, order: list, *sums: str) -> DataFrame:
    """rows with `_nr`, the place of each in a total order, from 0, and for each of `sums` the total over the rows before it.

    Many rows are dealt by ranges of the order; what reaches the driver is one row for each range.
    """
    if few:
        own = Window.partitionBy(F.lit(1)).orderBy(*order)
        before = own.rowsBetween(Window.unboundedPreceding, -1)
        return rows.select("*", (F.row_number().over(own) - 1).alias("_nr"), *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"_before{c}") for c in sums])
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(F.count("*").alias("n"), *[F.sum(c).cast("double").alias(c) for c in sums]).orderBy("_part").collect()
    offsets, at = [], [0, *[0.0] * len(sums)]
    for r in totals:
        offsets.append((r["_part"], *at))
        at = [x + r[k + 1] for k, x in enumerate(at)]
    schema = "_part int, _first bigint" + "".join(f", `_first{c}` double" for c in sums)
    own = Window.partitionBy("_part").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(rows.sparkSession.createDataFrame(offsets, schema)), "_part")
    out = placed.withColumn("_nr", F.col("_first") + F.row_number().over(own) - 1)
    for c in sums:
        out = out.withColumn(f"_before{c}", F.col(f"_first{c}") + F.coalesce(F.sum(c).over(before), F.lit(0.0)))
    return out.drop("_part", "_first", *[f"_first{c}" for c in sums])


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, few: bool = False) -> DataFrame:
    """(source, source_size, n_docs) with `target`: the words that the mix takes from the source.

    Water filling in closed form: with level L, target = min(most * size, L * weight).
    Sources that are full come first in order of most * size / weight, so L follows
    from running sums over the sources, one row each. `few` says that there are at most MOST_SOURCES.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % F.lit(len(weights)) + 1).cast("int"))
    ranked = _running(sources, few, [F.col("source").asc_nulls_last()]).withColumnRenamed("_nr", "_rank").withColumn("_w", w).withColumn("_cap", F.lit(most) * F.col("source_size"))
    filled = _running(ranked.withColumn("_order", F.col("_cap") / F.col("_w")), few, [F.col("_order").asc(), F.col("_rank").asc()], "_cap", "_w")
    size, weight = filled.agg(F.sum("source_size"), F.sum("_w")).first()
    # The right level is the first that leaves its source, and so all later ones, at or under the
    # cap; levels fall from there on, so it is the largest of those that do.
    level = (F.lit(share * (size or 0.0)) - F.col("_before_cap")) / (F.lit(weight or 0.0) - F.col("_before_w"))
    best = filled.agg(F.max(F.when(level * F.col("_w") <= F.col("_cap"), level))).first()[0]
    target = F.col("_cap") if best is None else F.least(F.col("_cap"), F.lit(best) * F.col("_w"))
    return filled.select("source", "source_size", "n_docs", target.alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, unit: np.ndarray, leave: int = 2) -> np.ndarray:
    """Flight phase over one block: at most `leave` entries, two or more, stay fractional.

    Three fractional documents at a time span one direction u with sum(u) = 0 and
    sum(u * size) = 0; a step along +u or -u, the side drawn by `unit`, ends where an
    entry reaches 0 or 1, and its place goes to the next document.
    """
    pi, n = pi.copy(), len(pi)
    live = [i for i in range(n) if EPS < pi[i] < 1 - EPS]
    hand, nxt, step = live[:3], 3, 0
    while len(hand) == 3 and len(hand) + len(live) - nxt > leave:
        a, b, c = hand
        u = np.array([size[b] - size[c], size[c] - size[a], size[a] - size[b]], float)
        if not u.any():  # equal sizes: two of them trade
            u = np.array([1.0, -1.0, 0.0])
        x = pi[hand]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = min(((1 - x[k]) / u[k] if u[k] > 0 else -x[k] / u[k]) for k in range(3) if u[k])
            down = min((x[k] / u[k] if u[k] > 0 else (x[k] - 1) / u[k]) for k in range(3) if u[k])
        x = x + up * u if unit[step % n] < down / (up + down) else x - down * u
        step += 1
        pi[hand] = np.clip(x, 0.0, 1.0)
        kept = [i for i in hand if EPS < pi[i] < 1 - EPS]
        if len(kept) == 3:  # rounding kept all three: settle the nearest
            i = min(hand, key=lambda i: min(pi[i], 1 - pi[i]))
            pi[i] = round(pi[i])
            kept.remove(i)
        take = live[nxt : nxt + 3 - len(kept)]
        nxt += len(take)
        hand = kept + take
    pi[pi <= EPS], pi[pi >= 1 - EPS] = 0.0, 1.0
    return pi


def land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Landing: of all outcomes of the few entries left, the one nearest to both expected totals, sizes first."""
    rest = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    out = pi.copy()
    if len(rest):
        taken = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1
        off = np.abs((taken - pi[rest]) @ size[rest]) + 1e-6 * np.abs((taken - pi[rest]).sum(1))
        out[rest] = taken[np.argmin(off)]
    return out


_COLS = "key bigint, dup bigint, source string, size bigint, pi double"


def _fly(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "dup", "size"], kind="stable").reset_index(drop=True)
        size = pdf["size"].to_numpy(float)
        unit = ((pdf["key"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)).astype(float)) / 2.0**53
        pi = flight(pdf["pi"].to_numpy(float), size, unit, LAND if last else 2)
        pdf["pi"] = land(pi, size) if last else pi
        return pdf[["key", "dup", "source", "size", "pi"]]

    return run


def cube_sample(units: DataFrame, largest: int, block: int = BLOCK) -> DataFrame:
    """`pi` of units (key, dup, source, size, pi) driven to 0 or 1, balanced in each source.

    `largest` is the document count of the largest source; it sets the number of
    rounds, log(largest) to the base block / 2, and the number of blocks of each.
    Same rows, same draw: keys decide blocks, order and sides.
    """
    settled, open_, n = None, units, largest
    salt = 0
    while True:
        blocks = max(1, math.ceil(n / block))
        last = blocks == 1
        dealt = open_.withColumn("_b", F.pmod(F.xxhash64("key", "dup", F.lit(salt)), F.lit(blocks)))
        flown = dealt.groupBy("source", "_b").applyInPandas(_fly(last), _COLS)
        if last:
            return flown if settled is None else settled.unionByName(flown)
        flown = cut(flown)
        done = flown.where((F.col("pi") == 0) | (F.col("pi") == 1))
        settled = done if settled is None else settled.unionByName(done)
        open_ = flown.where((F.col("pi") > 0) & (F.col("pi") < 1))
        n = 2 * blocks
        salt += 1


STEP = 10_000  # copies of a row that are made from one array


def _times(rows: DataFrame, n, name: str, spread: bool = False) -> DataFrame:
    """Every row n times, numbered from 1 in `name`, STEP at a time; `spread` deals the steps of a row to many tasks."""
    steps = rows.withColumn("_times", n).where("_times > 0").withColumn("_step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_times") - 1) / F.lit(STEP)))))
    if spread:
        steps = steps.repartition(F.xxhash64(*[c for c in rows.columns if c != "_row"], "_step"))
    within = F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(STEP).cast("bigint"), F.col("_times") - F.col("_step") * F.lit(STEP)))
    return steps.withColumn(name, F.explode(within)).withColumn(name, F.col(name) + F.col("_step") * F.lit(STEP)).drop("_times", "_step")


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size and a `key` drawn from id and text; equal rows share a key and differ in `dup`."""
    base = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{source}`"].cast("string").alias("source"), F.coalesce(F.regexp_count(docs[f"`{text}`"], F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64(docs[f"`{id_col}`"], docs[f"`{text}`"]).alias("key"))
    return base


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per document: doc_id, key, source, size, source_size, target, n_copies, taken.

    n_copies is how often the mix holds the document, taken = n_copies * size. A null
    text has size 0; a null source is a source of its own, last in order; repeated rows
    are documents of their own; an empty table gives no rows. Ids may be of any type. Columns of docs other
    than the three named are not read.
    """
    with Scope() as scope:
        return scope.keep(_mix(docs, id_col, text, source, weights, share, most))


def _mix(docs, id_col, text, source, weights, share, most) -> DataFrame:
    session_for_texts(docs.sparkSession)
    every = cut(sized(docs, id_col, text, source))
    sources = every.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"), F.count("*").alias("n_docs"))
    sources = cut(sources)
    few = sources.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    mixed = cut(targets(sources, weights, share, most, few))
    largest = mixed.agg(F.max("n_docs")).first()[0] or 0
    # Rows equal in key, source and size are interchangeable: they are counted, not told apart.
    grouped = cut(every.groupBy("doc_id", "key", "source", "size").agg(F.count("*").alias("_n")))
    apart = _times(grouped, F.col("_n"), "dup", spread=not grouped.where(F.col("_n") > STEP).isEmpty()).drop("_n")
    rate = mixed.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).withColumnRenamed("source", "_source")
    full = apart.join(F.broadcast(rate) if few else rate, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor(F.col("rate") + F.lit(EPS))
    full = full.withColumn("whole", whole).withColumn("pi", F.greatest(F.lit(0.0), F.col("rate") - whole))
    units = full.where(F.col("pi") > EPS).select("key", "dup", "source", "size", "pi")
    drawn = cube_sample(units, largest).select("key", "dup", F.col("source").alias("_s"), F.col("pi").alias("drawn"))
    out = full.join(drawn, (full["key"] == drawn["key"]) & (full["dup"] == drawn["dup"]) & full["source"].eqNullSafe(drawn["_s"]), "left").drop(drawn["key"]).drop(drawn["dup"])
    copies = (F.col("whole") + F.coalesce(F.col("drawn"), F.lit(0.0))).cast("bigint")
    return out.select("doc_id", "key", "dup", "source", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", copies.alias("n_copies"), (copies * F.col("size")).alias("taken"))


BROADCAST_ROWS = 500_000  # keys up to this many (some 30 MB) are broadcast to the scan; more are joined by shuffle


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of docs as often as the mix holds them, all columns kept.

    Rows of one id, text and source share what the mix takes of them as evenly as can be; where it does not come out even, those
    whose other columns have the smaller hashes are taken once more.
    """
    taken = mix(docs, id_col, text, source, **options).groupBy(F.col("key").alias("_key"), F.col("source").alias("_source")).agg(F.sum("n_copies").alias("_total"), F.count("*").alias("_rows"))
    drawn = cut(taken.where("_total > 0"))
    # The row travels as one struct, so its columns' names cannot clash with the keys'.
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.xxhash64(docs[f"`{id_col}`"], docs[f"`{text}`"]).alias("_k"), docs[f"`{source}`"].cast("string").alias("_s"))
    small = drawn.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = keyed.join(F.broadcast(drawn) if small else drawn, (F.col("_k") == F.col("_key")) & F.col("_s").eqNullSafe(F.col("_source")))
    odd = F.col("_total") % F.col("_rows") != 0
    out = _times(found.where(~odd), F.expr("_total div _rows"), "_copy").select("_row")
    if not drawn.where(odd).isEmpty():
        out = out.unionByName(_shared(found.where(odd)))
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def _shared(found: DataFrame) -> DataFrame:
    """`_row` of rows of one key (_k, _s) that share _total copies among _rows: the first _total % _rows in the order of hashes get one more.

    Equal rows are counted first and rank as a block, and blocks are ranked over ranges of the order, so no key meets in one task.
    """
    blocks = found.groupBy("_k", "_s", F.sha2(F.to_json("_row"), 256).alias("_v"), "_total", "_rows").agg(F.first("_row").alias("_row"), F.count("*").cast("double").alias("_m"))
    placed = cut(_running(blocks, False, [F.col("_k").asc(), F.col("_s").asc_nulls_last(), F.col("_v").asc()], "_m"))
    begin = cut(placed.groupBy(F.col("_k").alias("_bk"), F.col("_s").alias("_bs")).agg(F.min("_before_m").alias("_begin")))
    small = begin.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ranked = placed.join(F.broadcast(begin) if small else begin, (F.col("_k") == F.col("_bk")) & F.col("_s").eqNullSafe(F.col("_bs")))
    before, m = (F.col("_before_m") - F.col("_begin")).cast("bigint"), F.col("_m").cast("bigint")
    more = F.greatest(F.lit(0), F.least(before + m, F.col("_total") % F.col("_rows")) - before)
    copies = F.expr("_total div _rows") * m + more
    counted = ranked.select("_row", "_k", "_s", "_v", copies.cast("bigint").alias("_copies")).where("_copies > 0")
    return _times(counted, F.col("_copies"), "_copy", spread=True).select("_row")
