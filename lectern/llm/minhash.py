"""MinHash near-dedup by an inverted join of signature coordinates (operator 11).

A document is the set of its 5-word shingles, as in `jaccard`; equal sets are one class. The signature of a set holds
64 minimum hashes, and the class is posted under each pair of coordinate and value. Two sets of similarity J agree in each
coordinate with probability J, so pairs of 0.85 that agree in fewer than 34 of 64 (`LEAST`) are less than one in a billion; pairs that do
agree so often are confirmed on their full sets.

Counting collisions merges the posting lists without expanding them. Lists of one member are no lists; a class with fewer than
34 lists has no partner. Prefix: with its lists in order of length, shortest first, a class need only be met in all but its
33 longest, since two classes that share 34 share one of those. Skip: the long lists are never merged; what they would add
is counted by comparing the two signatures where a short list has brought them together. In a list every member meets one hub, members of
long lists also hubs of small random groups (`jaccard.dealt`), and after that only members that are outside the hub's component
meet the others. A link inside a component adds nothing to the components, so none is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import _text, jaccard
from lectern.llm._spark import Scope, cut, session_for_texts, tidy
from lectern.llm.components import merge

COORDINATES = 64
PERCENT = 85  # similarity of a link
DEALT = 2  # lists of a class, the longest of those it is met in, in which groups are dealt; in a group of near copies all lists hold much the same members
MISS = 1e-9  # chance that a pair of exactly that similarity agrees in too few coordinates


def least_matches(coordinates: int = COORDINATES, similarity: float = PERCENT / 100, miss: float = MISS) -> int:
    """The largest t for which fewer than t of so many coordinates agree with a chance of at most `miss`."""
    below, t = 0.0, 0
    while True:
        below += math.comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            return t
        t += 1


LEAST = least_matches()
_rng = np.random.RandomState(20250611)
_SEEDS, _FACTORS = (_rng.randint(0, 2**63, COORDINATES, dtype=np.int64).astype(np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES 32-bit numbers for each set of 64-bit hashes, none empty: bits of the minimum under each hash function."""
    out = np.empty((len(sets), COORDINATES), np.int32)
    if sets:
        values = np.concatenate(sets)
        first = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
        with np.errstate(over="ignore"):
            for k in range(COORDINATES):
                h = (values ^ _SEEDS[k]) * _FACTORS[k]
                h ^= h >> np.uint64(31)
                h *= np.uint64(0x9E3779B97F4A7C15)
                out[:, k] = np.minimum.reduceat(h, first).astype(np.uint32).view(np.int32)
    return out


def _describe(batches):
    """(id, th, n, two halves of a digest, signature, bitmap) of each text of column 0; empty sets have no signature."""
    names = ["id", "th", "n", "h1", "h2", "sig", "bits"]
    for b in batches:
        count, digests, sig, bits = [], [], [], []
        for _, _, data, offsets in _text.text_slices(b.column(0)):
            sets = _text.shingles(data, offsets)
            rows = iter(signatures([s for s in sets if len(s)]))
            for s in sets:
                count.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig.append(next(rows) if len(s) else None)
                bits.append(jaccard.bitmap(s))
        h1, h2 = (pa.array([int.from_bytes(d[k : k + 8], "little", signed=True) for d in digests], pa.int64()) for k in (0, 8))
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(count, pa.int64()), h1, h2, pa.array(sig, pa.list_(pa.int32())), pa.array(bits, pa.list_(pa.int64()))], names)


def _members(classes: DataFrame) -> DataFrame:
    """(shingle, rid, hub, deal) of the posting lists in which each class has to be met; `shingle` is coordinate and value in one number, `deal` marks the longest of them."""
    posted = classes.select("rid", F.posexplode("sig").alias("k", "v")).select("rid", F.shiftleft(F.col("k").cast("bigint"), 32).bitwiseOR(F.col("v").cast("bigint").bitwiseAND(0xFFFFFFFF)).alias("token"))
    lists = posted.groupBy(F.col("token").alias("_token")).agg(F.count("*").alias("length"), F.min("rid").alias("hub")).where("length > 1")
    shared = posted.join(lists.hint("merge"), F.col("token") == F.col("_token")).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("length", "token", "hub"))).alias("at"))
    met = shared.where(F.size("at") >= LEAST).select("rid", F.size("at").alias("lists"), F.posexplode(F.slice("at", F.lit(1), F.size("at") - (LEAST - 1))).alias("k", "x"))
    return met.select(F.col("x.token").alias("shingle"), "rid", F.col("x.hub").alias("hub"), (F.col("k") + LEAST + DEALT > F.col("lists")).alias("deal"))


# Columns of two classes, ending in a and b: their sizes allow the similarity, they agree in enough coordinates, and their parity bitmaps
# differ in no more bits than their sets may (jaccard.bitmap).
_ALIKE = f"""100 * least(na, nb) >= {PERCENT} * greatest(na, nb)
    AND aggregate(zip_with(siga, sigb, (x, y) -> CAST(x = y AS INT)), 0, (d, x) -> d + x) >= {LEAST}
    AND {100 + PERCENT} * aggregate(zip_with(bitsa, bitsb, (x, y) -> bit_count(x ^ y)), 0, (d, x) -> d + x) <= {100 - PERCENT} * (na + nb)"""


# The first of the lists that both have to be met in and do meet in: there a pair is taken, and in no other.
_FIRST = "array_position(transform(zip_with(siga, sigb, (x, y) -> x = y), (e, k) -> e AND (shiftright(posteda & postedb, k) & 1) = 1), true) = shiftright(l.shingle, 32) + 1"


def _record(records: DataFrame, x: str) -> DataFrame:
    return records.select(F.col("rid").alias(f"_{x}"), *[F.col(c).alias(f"{c}{x}") for c in ("n", "sig", "bits", "posted")])


def _sets(docs: DataFrame) -> DataFrame:
    """(rid, part): the whole set of each text."""

    def run(batches):
        for b in batches:
            of = b.column(1)
            for i, j, data, offsets in _text.text_slices(b.column(0)):
                parts = [_text.signed(s) for s in _text.shingles(data, offsets)]
                yield pa.RecordBatch.from_arrays([of.slice(i, j - i), pa.array(parts, pa.list_(pa.int64()))], ["rid", "part"])

    return docs.mapInArrow(run, "rid bigint, part array<bigint>")


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose full sets have the similarity."""
    ids = pairs.select(F.col("a").alias("r")).unionByName(pairs.select(F.col("b").alias("r"))).distinct()
    wanted = cut(reps.join(ids, F.col("rid") == F.col("r"), "left_semi"))
    sets = cut(_sets(jaccard.one_text_each(docs, wanted)))
    one, two = (sets.select(F.col("rid").alias(f"_{x}"), F.col("part").alias(f"p{x}")) for x in "ab")
    both = pairs.join(two, F.col("b") == F.col("_b")).join(one, F.col("a") == F.col("_a"))
    overlap = F.size(F.array_intersect("pa", "pb"))
    return both.where(100 * overlap >= PERCENT * (F.size("pa") + F.size("pb") - overlap)).select("a", "b")


def _counted(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Those of the pairs that agree in enough coordinates."""
    both = pairs.join(_record(records, "a"), F.col("a") == F.col("_a")).join(_record(records, "b"), F.col("b") == F.col("_b"))
    return cut(both.where(_ALIKE).select("a", "b"))


def _across(members: DataFrame, records: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components that meet in a list and agree in enough coordinates; one of the two is outside the component of the list's hub."""
    own = labels.select(F.col("node").alias("_n"), "c")
    hub = labels.select(F.col("node").alias("_h"), F.col("c").alias("hc"))
    lists = members.join(own, F.col("rid") == F.col("_n")).join(hub, F.col("hub") == F.col("_h"), "left").select("shingle", "rid", "c", F.coalesce("hc", "hub").alias("hc"))
    lists = cut(lists)
    outside = lists.where("c <> hc")
    inside = lists.join(outside.select("shingle").distinct(), "shingle", "left_semi")
    side = lambda rows, x: rows.join(_record(records, x), F.col("rid") == F.col(f"_{x}")).select("shingle", F.col("hc").alias(f"hc{x}"), F.col("rid").alias(f"rid{x}"), F.col("c").alias(f"c{x}"), f"n{x}", f"sig{x}", f"bits{x}", f"posted{x}")
    met = F.expr(f"ca <> cb AND (cb = hcb OR rida < ridb) AND {_ALIKE} AND {_FIRST}")
    pairs = side(outside, "a").alias("l").join(side(inside, "b").alias("r"), (F.col("l.shingle") == F.col("r.shingle")) & met)
    return cut(pairs.select(F.least("rida", "ridb").alias("a"), F.greatest("rida", "ridb").alias("b")).distinct())


def link(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept, and `class_id` of equal sets.

    Words are runs of anything but ASCII white space, A-Z lowered. Fewer than five words are one shingle; no words (or null)
    are the empty set, linked with nothing. component_id is the smallest id that links reach, its own included; null ids link, but are not
    smallest, and have a null component_id where all of a component's are null. `kept` says that id and component_id are equal (or both null). Ids may be of
    any type with an order. Repeated rows are copies of each other. Other columns are not read; an empty table gives no rows.
    """
    with Scope() as scope:
        return scope.keep(_link(docs, id_col, text))


def _link(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    session_for_texts(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    body = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(docs[f"`{text}`"].cast("string")).alias("th"), F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("text"))
    sets = cut(body.select("text", "id", "th").mapInArrow(_describe, f"id {kind}, th bigint, n bigint, h1 bigint, h2 bigint, sig array<int>, bits array<bigint>"))
    classes = sets.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("least"), F.min(F.struct("id", "th")).alias("rep"), F.any_value("sig").alias("sig"), F.any_value("bits").alias("bits"))
    classes = cut(classes.withColumn("rid", F.monotonically_increasing_id()))
    reps = jaccard.representatives(classes, sets)
    members = cut(_members(classes))
    coordinate = F.shiftright("shingle", 32).cast("int")
    posted = members.groupBy(F.col("rid").alias("_m")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), coordinate)).alias("posted"))
    records = cut(classes.join(posted, F.col("rid") == F.col("_m")).select("rid", "n", "sig", "bits", "posted"))
    labels = cut(records.select(F.col("rid").alias("node"), F.col("rid").alias("c")))

    longest = members.where("deal")

    # First each class against the hub that it shares most lists with, and the hubs of its groups.
    near = members.where("rid <> hub").groupBy("hub", "rid").agg(F.count("*").alias("k"))
    best = near.groupBy("rid").agg(F.max_by("hub", F.struct("k", "hub")).alias("a")).select("a", F.col("rid").alias("b"))
    for pairs in (
        lambda: _counted(best.unionByName(jaccard.dealt(longest, labels, jaccard.DEALS[0])).distinct(), records),
        lambda: _counted(jaccard.dealt(longest, labels, jaccard.DEALS[1]), records),
        lambda: _across(members, records, labels),
    ):
        labels = merge(labels, _confirmed(pairs(), reps, body))
        tidy(docs.sparkSession)

    known = classes.join(labels, F.col("rid") == F.col("node"), "left").select("n", "h1", "h2", "rid", F.coalesce("c", "rid").alias("c"), "least")
    component = known.groupBy(F.col("c").alias("_c")).agg(F.min("least").alias("component_id"))
    named = known.join(component, F.col("c") == F.col("_c")).select(F.col("n").alias("_n"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "rid", "component_id")
    out = sets.join(named, (F.col("n") == F.col("_n")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    where = F.when(F.col("rid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), where.alias("component_id"), F.col("id").eqNullSafe(where).alias("kept"), F.col("rid").alias("class_id"))


#: DuckDB SQL of the query's rows.
ORACLE_SQL = f"SELECT *, doc_id = component_id AS kept FROM ({jaccard.oracle_sql(PERCENT)})"
