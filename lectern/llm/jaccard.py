"""N-gram Jaccard join by vertical partitioning (operator 9).

A document is the set of its 5-word shingles; two documents link if their Jaccard
similarity is 0.8 or more. Equal sets are one class, and only classes are compared.

One global order of the shingles, rare ones first, is cut into fragments. A pair's
overlap is counted in every fragment by itself, and the sum over the fragments
decides. A pair can only link if the heads of both sets in that order share a shingle, so the heads
(a fifth of a set) give the candidates. The order puts shingles that are frequent by a fixed-size
sketch last; it steers cost alone, any order gives the same links.

Before whole sets are compared, the heads bound the overlap: with k shared head
shingles it is at most k plus the longer rest, and where a partner's head reaches into the
frequent shingles, rare ones in no list cannot be shared. So does a parity bitmap of each set: two
sets differ in at least as many shingles as their bitmaps in bits. Few pairs are left to count.

Only the components are wanted, so the shingles' posting lists are not expanded into
pairs. Each list compares its members with one hub, then long lists deal their members into
small random groups with a hub each; what hubs leave apart is compared exhaustively, but only across components: members outside the hub's component against
the list. A link inside a component can add nothing, so no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import _text
from lectern.llm._spark import Scope, cut, session_for_texts, tidy
from lectern.llm.components import merge

WIDTH = 5
SLOTS_LOG2 = 20  # of the frequency sketch: 1 MB whatever the data
CHUNK = 3_000_000  # shingles that are counted together in a task
OFTEN = 2  # sets of a chunk that hold a shingle from which it is counted ...
FREQUENT = 12  # ... and of all chunks from which it is frequent
RARE_FRAGMENTS, FRAGMENTS = 6, 8  # fragments of the rare part of the order, and of all of it
BITMAP = 1024  # bits of a set's parity bitmap
BROADCAST_ROWS = 500_000  # ids up to this many (some 30 MB) are broadcast to a scan; more are joined by shuffle


def _sets(batches):
    """(row, sorted distinct shingle hashes) of each text of column 0 of Arrow batches."""
    for b in batches:
        for i, _, data, offsets in _text.text_slices(b.column(0)):
            for k, s in enumerate(_text.shingles(data, offsets, WIDTH)):
                yield b, i + k, s


def bitmap(s: np.ndarray) -> np.ndarray:
    """BITMAP bits in words of 64: whether an odd number of the set's shingles falls on each."""
    odd = np.bincount((s & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _describe(batches):
    """Rows of sets (kind 0: id, th, n, two halves of a digest, bitmap) and of frequent shingles (kind 1: shingle, count)."""
    pending: list[np.ndarray] = []
    held, seen = 0, set()

    def frequent():
        values, n = np.unique(np.concatenate(pending), return_counts=True)
        often = n >= OFTEN
        k = int(often.sum())
        none = pa.nulls(k, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int8)), pa.nulls(k, id_type), none, pa.array(n[often]), pa.array(_text.signed(values[often])), none, pa.nulls(k, pa.list_(pa.int64()))], names)

    names = ["kind", "id", "th", "n", "h1", "h2", "bits"]
    id_type = None
    for b in batches:
        id_type = b.column(1).type
        count, h1, h2, bits = [], [], [], []
        for _, _, s in _sets([b]):
            bits.append(bitmap(s))
            d = xxhash.xxh3_128_digest(s.tobytes())
            count.append(len(s))
            h1.append(int.from_bytes(d[:8], "little", signed=True))
            h2.append(int.from_bytes(d[8:], "little", signed=True))
            if d not in seen and len(s):
                seen.add(d)
                pending.append(s)
                held += len(s)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(b), np.int8)), b.column(1), b.column(2), pa.array(count, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], names)
        if held >= CHUNK:
            yield frequent()
            pending, held, seen = [], 0, set()
    if pending:
        yield frequent()


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)


def _sketch(described: DataFrame) -> np.ndarray:
    """For each slot the binary logarithm of the count of its most frequent shingle."""
    counts = described.where("kind = 1").groupBy("h1").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    slot = F.shiftrightunsigned("h1", 64 - SLOTS_LOG2)
    rows = counts.groupBy(slot.alias("slot")).agg(F.max("n").alias("n")).toArrow()  # at most 2 ** SLOTS_LOG2 rows
    levels = np.zeros(1 << SLOTS_LOG2, np.uint8)
    levels[rows.column("slot").to_numpy().astype(np.int64)] = np.floor(np.log2(np.maximum(rows.column("n").to_numpy(), 1))).astype(np.uint8)
    return levels


def _ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in the global order: by level, then by hash."""
    return s[np.argsort(levels[_slot(s)], kind="stable")]


def head_length(n: int) -> int:
    """A set of n shingles shares at least ceil(0.8 n) with a partner, so one of its first n - ceil(0.8 n) + 1."""
    return n - (4 * n + 4) // 5 + 1


def representatives(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(rid, n, _id, _th, more) of classes (rid, n, rep): the row that stands for each; `more` if sets (id, th, n) holds that row repeatedly."""
    repeated = cut(sets.where("n > 0").groupBy(F.col("id").alias("_i"), F.col("th").alias("_t")).agg(F.count("*").alias("_k")).where("_k > 1"))
    reps = classes.select("rid", "n", F.col("rep.id").alias("_id"), F.col("rep.th").alias("_th"))
    if repeated.isEmpty():
        return reps.withColumn("more", F.lit(False))
    return cut(reps.join(repeated, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")), "left").select("rid", "n", "_id", "_th", F.col("_k").isNotNull().alias("more")))


def one_text_each(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, rid): of docs (id, th, text) one row for each of wanted (_id, _th, rid, more), however often it is repeated."""
    copies = not wanted.where("more").isEmpty()
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    found = docs.join(wanted, docs["id"].eqNullSafe(wanted["_id"]) & (docs["th"] == wanted["_th"])).select("text", "rid", "more")
    if not copies:
        return found.select("text", "rid")
    # Copies are reduced to one in each task before they move.
    return found.where("NOT more").select("text", "rid").unionByName(found.where("more").groupBy("rid").agg(F.any_value("text").alias("text")).select("text", "rid"))


def _postings(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(shingle, rid, pos, n, z) of the head of each set, z being how many of its shingles are rare (level 0)."""

    def run(batches):
        for b in batches:
            heads, rids, sizes, rare = [], [], [], []
            of = b.column(1).to_pylist()
            for _, i, s in _sets([b]):
                if len(s):
                    heads.append(_ordered(s, levels)[: head_length(len(s))])
                    rids.append(of[i])
                    sizes.append(len(s))
                    rare.append(int((levels[_slot(heads[-1])] == 0).sum()))
            if heads:
                n = [len(h) for h in heads]
                pos = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
                yield pa.RecordBatch.from_arrays([pa.array(_text.signed(np.concatenate(heads))), pa.array(np.repeat(np.array(rids, np.int64), n)), pa.array(pos), pa.array(np.repeat(np.array(sizes, np.int32), n)), pa.array(np.repeat(np.array(rare, np.int32), n))], ["shingle", "rid", "pos", "n", "z"])

    return docs.mapInArrow(run, "shingle bigint, rid bigint, pos int, n int, z int")


def _fragments(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(rid, fragment, part): each set cut at the pivots of the global order."""

    def run(batches):
        for b in batches:
            rids, numbers, parts = [], [], []
            of = b.column(1).to_pylist()
            for _, i, s in _sets([b]):
                level = levels[_slot(s)]
                at = np.where(level == 0, ((s >> np.uint64(32)) * np.uint64(RARE_FRAGMENTS) >> np.uint64(32)).astype(np.int64), RARE_FRAGMENTS + (level > 8))
                for f in np.unique(at).tolist():
                    rids.append(of[i])
                    numbers.append(f)
                    parts.append(_text.signed(s[at == f]))
            if rids:
                yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], ["rid", "fragment", "part"])

    return docs.mapInArrow(run, "rid bigint, fragment int, part array<bigint>")


def _records(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(rid, n, h, z, loose, listed, bits): a set's size, its head's, how much of that is rare, and rare but in no list; the listed rest; its bitmap."""
    head = F.col("n") - F.floor((4 * F.col("n") + 4) / 5).cast("int") + 1
    own = members.groupBy("rid").agg(F.max("n").alias("n"), F.max("z").alias("z"), F.count_if(F.col("pos") < F.col("z")).cast("int").alias("_rare"), F.collect_list("shingle").alias("listed"))
    own = own.select("rid", "n", head.alias("h"), "z", (F.col("z") - F.col("_rare")).alias("loose"), "listed")
    return own.join(classes.select(F.col("rid").alias("_rid"), "bits"), F.col("rid") == F.col("_rid")).drop("_rid")


# Columns of two records, ending in a and b: the sizes allow the similarity, and so do the rare shingles that are
# in no list. Those are in no other head, so in no set whose head ends among the frequent ones.
_SIZES = "5 * least(na, nb) >= 4 * greatest(na, nb)"
_LOOSE = "(zb >= hb OR 9 * (na - loosea) >= 4 * (na + nb)) AND (za >= ha OR 9 * (nb - looseb) >= 4 * (na + nb))"
# With k shared head shingles: the head that ends first in the order holds all that are shared up to there.
_HEADS = "9 * (size(array_intersect(lista, listb)) + greatest(na - ha, nb - hb)) >= 4 * (na + nb)"
# The bitmaps' distance is at most the sets', na + nb - 2 overlap.
_BITS = "9 * aggregate(zip_with(bitsa, bitsb, (x, y) -> bit_count(x ^ y)), 0, (d, x) -> d + x) <= na + nb"


def _record(records: DataFrame, x: str) -> DataFrame:
    return records.select(F.col("rid").alias(f"_{x}"), *[F.col(c).alias(f"{c}{x}") for c in ("n", "h", "z", "loose")], F.col("listed").alias(f"list{x}"), F.col("bits").alias(f"bits{x}"))


def _verified(pairs: DataFrame, records: DataFrame, reps: DataFrame, docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """Pairs (a, b) of classes that link: partial overlaps by fragment, summed for each pair."""
    bounded = pairs.join(_record(records, "a"), F.col("a") == F.col("_a")).join(_record(records, "b"), F.col("b") == F.col("_b"))
    pairs = cut(bounded.where(f"{_SIZES} AND {_LOOSE} AND {_BITS} AND {_HEADS}").select("a", "b", "na", "nb"))
    ids = pairs.select(F.col("a").alias("r")).unionByName(pairs.select(F.col("b").alias("r"))).distinct()
    wanted = cut(reps.join(ids, F.col("rid") == F.col("r"), "left_semi"))
    parts = cut(_fragments(one_text_each(docs, wanted), levels))
    one, two = (parts.select(F.col("rid").alias(f"_{x}"), F.col("fragment").alias(f"f{x}"), F.col("part").alias(f"p{x}")) for x in "ab")
    partial = pairs.join(two, F.col("b") == F.col("_b")).join(one, (F.col("a") == F.col("_a")) & (F.col("fa") == F.col("fb")))
    overlap = partial.groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("pa", "pb"))).alias("o"))
    return overlap.where("100 * o >= 80 * (na + nb - o)").select("a", "b")


def link(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, and `class_id`, `component` and `text_hash` for dedup.

    Words are runs of anything but ASCII white space, A-Z lowered. Sets are of distinct 5-word
    shingles; fewer words are one shingle; no words (or null) are the empty set, linked with nothing.
    component_id is the smallest id that links reach, its own included; null ids link, but are
    not smallest; `component` is one label for each component, whatever its ids. Ids may be of any type with an order. Repeated rows are copies of each other. Other columns are not read; an empty
    table gives no rows.
    """
    with Scope() as scope:
        return scope.keep(_link(docs, id_col, text))


def _link(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    session_for_texts(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    body = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(docs[f"`{text}`"].cast("string")).alias("th"), F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("text"))
    described = cut(body.select("text", "id", "th").mapInArrow(_describe, f"kind tinyint, id {kind}, th bigint, n bigint, h1 bigint, h2 bigint, bits array<bigint>"))
    levels = _sketch(described)
    sets = described.where("kind = 0")
    classes = sets.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("least"), F.min(F.struct("id", "th")).alias("rep"), F.any_value("bits").alias("bits"))
    classes = cut(classes.withColumn("rid", F.monotonically_increasing_id()))
    reps = representatives(classes, sets)
    postings = _postings(one_text_each(body, reps), levels).repartition("shingle")
    # All columns are read here too, so that both uses of the postings share one exchange.
    hubs = postings.groupBy("shingle").agg(F.min("rid").alias("hub"), F.max("rid").alias("_other"), F.min(F.least("pos", "n", "z")).alias("_all")).where("hub < _other AND _all >= 0").select(F.col("shingle").alias("_shingle"), "hub")
    members = cut(postings.join(hubs.hint("merge"), F.col("shingle") == F.col("_shingle")).select("shingle", "rid", "pos", "n", "z", "hub"))
    records = cut(_records(members, classes))
    labels = cut(classes.select(F.col("rid").alias("node"), F.col("rid").alias("c")))

    # First each class against the hub that it shares most shingles with, and the hubs of its groups.
    near = members.where("rid <> hub").groupBy("hub", "rid").agg(F.count("*").alias("k"))
    best = near.groupBy("rid").agg(F.max_by("hub", F.struct("k", "hub")).alias("hub"))
    best = best.select(F.col("hub").alias("a"), F.col("rid").alias("b"))
    for pairs in (lambda: best.unionByName(dealt(members, labels, DEALS[0])).distinct(), lambda: dealt(members, labels, DEALS[1]), lambda: _across(members, records, labels)):
        labels = merge(labels, _verified(pairs(), records, reps, body, levels))
        tidy(spark)

    least = classes.join(labels, F.col("rid") == F.col("node")).select("n", "h1", "h2", "rid", "c", "least")
    component = least.groupBy(F.col("c").alias("_c")).agg(F.min("least").alias("component_id"))
    named = least.join(component, F.col("c") == F.col("_c")).select(F.col("n").alias("_n"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "rid", "c", "component_id")
    out = sets.join(named, (F.col("n") == F.col("_n")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("rid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.col("rid").alias("class_id"), F.col("c").alias("component"), F.col("th").alias("text_hash"))


LONG = 24  # members of a list from which it is dealt into random groups
DEALS = (range(4), range(4, 20))  # ways of dealing in two rounds; a member meets about as many others


def dealt(members: DataFrame, labels: DataFrame, deals: range) -> DataFrame:
    """Pairs of each member of a long list with the hub of its random group, some four members large, for each deal.

    Groups depend on the member and the length of the list, so similar lists give the same pairs. Ends of
    one component make no pair.
    """
    sizes = members.groupBy(F.col("shingle").alias("_s")).agg(F.count("*").alias("m")).where(F.col("m") >= LONG)
    groups = F.expr("shiftleft(1L, CAST(floor(log2(m / 4)) AS INT))")
    own = labels.select(F.col("node").alias("_n"), "c")
    long = cut(members.join(sizes, F.col("shingle") == F.col("_s")).join(own, F.col("rid") == F.col("_n")).select("shingle", "rid", "c", groups.alias("groups")))
    seat = long.withColumn("deal", F.explode(F.array(*[F.lit(d) for d in deals]))).withColumn("g", F.pmod(F.xxhash64("rid", "deal"), F.col("groups")))
    first = seat.groupBy(F.col("shingle").alias("_s"), F.col("deal").alias("_d"), F.col("g").alias("_g")).agg(F.min("rid").alias("a"), F.min_by("c", "rid").alias("ca"))
    met = seat.join(first, (F.col("shingle") == F.col("_s")) & (F.col("deal") == F.col("_d")) & (F.col("g") == F.col("_g")))
    return met.where("a <> rid AND ca <> c").select("a", F.col("rid").alias("b")).distinct()


def _across(members: DataFrame, records: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a head shingle and may be alike by size and place.

    One end is always outside the hub's component, so a list whose members the hubs have
    joined costs nothing.
    """
    own = records.drop("listed", "bits").join(labels.select(F.col("node").alias("_n"), "c"), F.col("rid") == F.col("_n")).select(F.col("rid").alias("_rid"), "c", "h", "loose")
    hub = labels.select(F.col("node").alias("_h"), F.col("c").alias("hc"))
    lists = members.join(own, F.col("rid") == F.col("_rid")).join(hub, F.col("hub") == F.col("_h")).select("shingle", "rid", "pos", "n", "z", "h", "loose", "c", "hc")
    lists = cut(lists)
    side = lambda x: [F.col(c).alias(f"{c}{x}") for c in ("rid", "pos", "n", "z", "h", "loose", "c")]
    outside = lists.where("c <> hc").select("shingle", *side("a"))
    inside = lists.join(outside.select("shingle").distinct(), "shingle", "left_semi").select("shingle", "hc", *side("b"))
    places = "9 * (least(posa, posb) + 1 + least(na - posa - 1, nb - posb - 1)) >= 4 * (na + nb)"
    # A pair that cannot do without a shared rare shingle is met in that shingle's list.
    enough = "posa < za OR (9 * (na - za) >= 4 * (na + nb) AND 9 * (nb - zb) >= 4 * (na + nb))"
    # Heads share at least `least` shingles, so the first of them stands before the last `least` places.
    least = "4 * (na + nb) - 9 * greatest(na - ha, nb - hb)"
    early = f"9 * (ha - posa) >= {least} AND 9 * (hb - posb) >= {least}"
    alike = F.expr(f"ca <> cb AND (cb = hc OR rida < ridb) AND {_SIZES} AND {places} AND {early} AND {_LOOSE} AND ({enough})")
    pairs = outside.alias("l").join(inside.alias("r"), (F.col("l.shingle") == F.col("r.shingle")) & alike)
    return pairs.select(F.least("rida", "ridb").alias("a"), F.greatest("rida", "ridb").alias("b")).distinct()


def component_ids(linked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return linked.select(id_col, "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are their component's first: smallest id (null last), then text hash.

    Texts without words are linked with nothing and all stay; of a repeated row that is first one
    stays. All columns are kept.
    """
    linked = cut(link(docs, id_col, text))
    rows = linked.select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_th"), F.col("class_id"), F.col("component").alias("_c"))
    worded = rows.where(F.col("class_id").isNotNull())
    first = worded.groupBy("_c").agg(F.min(F.struct(F.col("_id").isNull().alias("null"), "_id", "_th")).alias("at"))
    first = cut(first.select("at._id", "at._th").join(worded.groupBy(F.col("_id").alias("_i"), F.col("_th").alias("_t")).agg(F.count("*").alias("_times")), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t"))).select("_id", "_th", "_times"))
    empty = rows.where(F.col("class_id").isNull()).select("_id", "_th").distinct().withColumn("_times", F.lit(1).cast("bigint"))
    kept = cut(first.unionByName(empty))
    if kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        kept = F.broadcast(kept)
    # The row travels as one struct, so its columns' names cannot clash with the keys'.
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), docs[f"`{id_col}`"].alias("_i"), F.xxhash64(docs[f"`{text}`"].cast("string")).alias("_t"))
    found = row.join(kept, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")))
    if not first.where("_times > 1").isEmpty():
        found = found.where("_times = 1").unionByName(found.where("_times > 1").dropDuplicates(["_id", "_th"]))
    return found.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def oracle_sql(percent: int = 80) -> str:
    """DuckDB SQL of the query's rows: all pairs that share a shingle are counted, links are followed to their closure."""
    return rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (any_value(p.n) + any_value(q.n) - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM words UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(y)::BIGINT AS component_id
FROM words d JOIN reach r ON r.x = d.doc_id LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""


ORACLE_SQL = oracle_sql()
