"""Removal of long repeated byte strings by blockwise difference-cover suffix sorting (operator 1).

A byte goes if a LENGTH-byte string that covers it starts anywhere else too. So the
suffixes of all texts are compared to a depth of LENGTH bytes, and each one that
ties with another marks LENGTH bytes. The suffixes are dealt into buckets, one bucket is sorted at a
time, and long ties are settled by ranks of cover samples:

1. Cover. Sample positions are chosen by content: of each LENGTH-byte string the
   KEY-byte string with the least hash. This has what a difference cover is for: two
   equal strings have a sample at the same distance from their starts. Residues modulo
   v have it too, but would sample every 14th byte, content every 137th or so. Runs that repeat
   inside their own text, as in periodic texts, are settled there: one of them stands for all.
2. Buckets. The suffixes whose string has the same sample bytes are a bucket, those at one distance from
   the sample a part of it. A bucket of one suffix run (the suffixes around one sample) is done at once: nothing repeats.
   Inside a bucket, runs that are equal in all their bytes are repeats as a whole, and one of them stands for all.
3. Ranks. Of the unequal runs that are left, each with the bytes around its sample, a task takes one bucket after the
   other. Every STEP-th distance to the sample is a cover position there, a difference cover of the distances;
   the LENGTH - STEP + 1 bytes from it on, which all STEP suffixes at these distances have in common, are sorted, and the place in
   that order is its rank. Ranks without a tie end their suffixes.
4. Suffixes. What is left is sorted by rank, then by the STEP - 1 bytes beside it: the long tie is the
   rank's, the short comparison is on bytes. Neighbours that are equal are repeats.

A bucket of more than MOST unequal runs is too much for a task. There ranks are classes of hashes: the
runs' parts are grouped by rank in a shuffle, and suffixes by rank and bytes in another, so a passage
that a third of all rows share costs what its rows cost. Contents of runs are compared by 64-bit XXH3 inside a
bucket, buckets by 64-bit XXH3 of the sample; a rolling hash only chooses the samples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import _text
from lectern.llm._spark import Scope, cut, session_for_texts, tidy

LENGTH = 400
KEY = 128
STEP = 16
MOST = 2048  # unequal runs of a bucket that a task sorts; there are some 400 to 700 bytes to each
PIECE = 1 << 20  # a longer text is sampled in pieces of so many suffixes
_PLACE_BITS = np.uint64(22)  # a place in a slice: of PIECE + LENGTH bytes, or of a slice of rows
BROADCAST_ITEMS = 500_000  # rows up to this many (some 40 MB) are broadcast to a scan; more are joined by shuffle

_ROWS = "key bigint, hull bigint, w int, id {kind}, th bigint, p bigint, lo bigint, hi bigint"
_NAMES = ["key", "hull", "w", "id", "th", "p", "lo", "hi"]
_U = np.uint64


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, key: int = KEY):
    """Suffix runs of rows: (row, lo, hi, p, key hash, content hash), places counted in `data`.

    lo to hi are consecutive starts whose strings have their sample at p (the leftmost of equal ones).
    The sample depends on the string alone: hashes are cut to the same number of bits in every slice.
    """
    n, w = len(data), length - key + 1
    if n < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, _U)] * 2
    at = np.arange(n - key + 1)
    h = _text.window_hash(_text.rolling(data, 0), at, at + key, 0)
    assert n < 1 << int(_PLACE_BITS)
    packed = ((h >> _PLACE_BITS) << _PLACE_BITS) | at.astype(_U)
    padded = np.concatenate((packed, np.full(-len(packed) % w, ~_U(0)))).reshape(-1, w)
    ahead = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(padded, 1).ravel()
    k = n - length + 1
    p = (np.minimum(ahead[:k], behind[w - 1 : w - 1 + k]) & ((_U(1) << _PLACE_BITS) - _U(1))).astype(np.int64)
    row = np.searchsorted(offsets, at[:k], side="right") - 1
    inside = at[:k] + length <= offsets[row + 1]
    new = np.ones(k, bool)
    new[1:] = (p[1:] != p[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    end = np.ones(k, bool)
    end[:-1] = new[1:] | ~inside[1:]
    lo, hi = np.flatnonzero(new & inside), np.flatnonzero(end & inside)
    p, row = p[lo], row[lo]
    return [row, lo, hi, p, _text.contents(data, p, p + key), _text.contents(data, lo, hi + length, p - lo)]


def _own_repeats(row, lo, hi, key, hull, length: int = LENGTH):
    """Runs of equal content in one row: (w, kept, marks).

    w is 2 for a run that stands for several of its row, kept says which runs do not have one standing for them;
    marks (row, lo, hi) are the starts that repeat inside their row, overlapping and touching strings merged.
    """
    order = np.lexsort((lo, hull, key, row))
    same = np.zeros(len(row), bool)
    same[1:] = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1]) & (hull[order][1:] == hull[order][:-1])
    w, kept, marked = np.ones(len(row), np.int32), np.ones(len(row), bool), np.zeros(len(row), bool)
    if same.any():
        kept[order[same]] = False
        first = np.concatenate((same[1:], [False])) & ~same
        w[order[first]] = 2
        marked[order[same | first]] = True
    at = np.flatnonzero(marked)  # in order of row and lo, and so of hi
    if not len(at):
        return w, kept, (at, at, at)
    new = np.ones(len(at), bool)
    new[1:] = (row[at][1:] != row[at][:-1]) | (lo[at][1:] > hi[at][:-1] + length)
    return w, kept, (row[at[new]], lo[at[new]], hi[at[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(at) - 1]))]])


def _pieces(column):
    """Slices of rows; a text over PIECE bytes comes in pieces that overlap by LENGTH - 1 bytes: (first row, base, bytes, offsets)."""
    for i, _, data, offsets in _text.text_slices(column):
        if len(data) <= PIECE + LENGTH:
            yield i, 0, data, offsets
        else:
            for base in range(0, max(1, len(data) - LENGTH + 1), PIECE):
                part = data[base : base + PIECE + LENGTH - 1]
                yield i, base, part, np.array([0, len(part)])


def _rows(parts) -> pa.RecordBatch:
    key, hull, w, ids, th, p, lo, hi = parts
    return pa.RecordBatch.from_arrays([pa.array(_text.signed(key)), pa.array(_text.signed(hull)), pa.array(w, pa.int32()), ids, th, pa.array(p), pa.array(lo), pa.array(hi)], _NAMES)


def _sampled(batches):
    """Step 2's rows: all suffix runs, those that repeat inside their text once; w = 0 marks what is repeated there."""
    for b in batches:
        for i, base, data, offsets in _pieces(b.column(0)):
            row, lo, hi, p, key, hull = runs(data, offsets)
            if not len(row):
                continue
            w, kept, marks = _own_repeats(row, lo, hi, key, hull)
            row, lo, hi, p, key, hull = (np.concatenate((x[kept], m)) for x, m in zip((row, lo, hi, p, key, hull), (*marks, marks[1], np.zeros(len(marks[0]), _U), np.zeros(len(marks[0]), _U))))
            w = np.concatenate((w[kept], np.zeros(len(marks[0]), np.int32)))
            shift = base - offsets[row]
            of = pa.array(row + i)
            yield _rows((key, hull, w, b.column(1).take(of), b.column(2).take(of), p + shift, lo + shift, hi + shift))


def _items(batch, i, column, *fields):
    got = batch.column(column)[i].values
    return tuple(np.zeros(0, np.int64) if got is None else got.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields)


def _around(batches):
    """The open runs with their bytes."""
    for b in batches:
        for i, data in enumerate(_each(b.column(0))):
            p, lo, hi, w, key = _items(b, i, 3, "p", "lo", "hi", "w", "key")
            view = memoryview(np.ascontiguousarray(data))
            around = pa.array([bytes(view[x:y]) for x, y in zip(lo.tolist(), (hi + LENGTH).tolist())], pa.binary())
            of = pa.array([i] * len(p))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(w.astype(np.int32)), b.column(1).take(of), b.column(2).take(of), pa.array(p), pa.array(lo), pa.array(hi), around], [*_AROUND])


_AROUND = {"key": "bigint", "w": "int", "id": "{kind}", "th": "bigint", "p": "bigint", "lo": "bigint", "hi": "bigint", "around": "binary"}


def _whole_buckets(batches):
    """Batches sorted by key, put together so that none ends inside a bucket; some MOST rows each."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= MOST:
            t = pa.Table.from_batches(held)
            keys = t.column(0).to_numpy()
            end = int(np.searchsorted(keys, keys[-1]))
            if end:
                yield t.slice(0, end).combine_chunks()
                held, n = t.slice(end).to_batches(), len(t) - end
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes in lexicographic order: (rank of each row, equal rows having one rank; an order by rank)."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), kind="stable")
    new = np.ones(len(rows), bool)
    new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(1)
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order


def ties(key: np.ndarray, w: np.ndarray, near: np.ndarray, far: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """Steps 3 and 4 for runs in order of their bucket: (run, least distance, largest distance) of suffixes that tie.

    A run holds the suffixes at distances near to far from its sample; data[offsets[r] : offsets[r + 1]] are its bytes, from
    the farthest suffix's first to the nearest one's last. w is 2 for a run that stands for several.
    """
    first, last = near // STEP, far // STEP
    n = last - first + 1
    run = np.repeat(np.arange(len(key)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[run]
    sample = offsets[:-1][run] + far[run] - step * STEP
    bucket = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64))))
    depth = LENGTH - STEP + 1
    part = (bucket[run] << 16 | step).astype(">i8").view(np.uint8).reshape(-1, 8)
    rank, _ = _order(np.concatenate((part, np.lib.stride_tricks.sliding_window_view(data, depth)[sample]), 1))
    tied = np.flatnonzero(np.bincount(rank, weights=w[run])[rank] >= 2)
    run, step, sample, rank = run[tied], step[tied], sample[tied], rank[tied]
    least, most = np.maximum(step * STEP, near[run]), np.minimum(step * STEP + STEP - 1, far[run])
    n = most - least + 1
    of = np.repeat(np.arange(len(run)), n)
    distance = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + least[of]
    left = (distance - step[of] * STEP)[:, None]
    beside = np.arange(STEP - 1)
    place = sample[of][:, None] - left + beside + np.where(beside < left, 0, depth)
    head = (rank[of] << 8 | left[:, 0]).astype(">i8").view(np.uint8).reshape(-1, 8)
    rank, _ = _order(np.concatenate((head, data[place]), 1)) if len(of) else (of, of)
    run = run[of]
    found = np.flatnonzero((np.bincount(rank, weights=w[run])[rank] >= 2) & (w[run] == 1)) if len(of) else of
    run, distance = run[found], distance[found]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (distance[1:] != distance[:-1] + 1)
    end = np.roll(new, -1)
    return run[new], distance[new], distance[end]


def _sorted_buckets(batches):
    for t in _whole_buckets(batches):
        key, w, p, lo, hi = (t.column(c).to_numpy() for c in ("key", "w", "p", "lo", "hi"))
        around = t.column("around").combine_chunks()
        around = around.chunk(0) if isinstance(around, pa.ChunkedArray) else around
        offsets = np.frombuffer(around.buffers()[1], np.int32)[around.offset : around.offset + len(around) + 1].astype(np.int64)
        data = np.frombuffer(around.buffers()[2], np.uint8)
        run, least, most = ties(key, w, p - hi, p - lo, data, offsets)
        of = pa.array(run)
        # A run that stands for several is marked as a whole already.
        yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks().take(of), t.column("th").combine_chunks().take(of), pa.array(p[run] - most), pa.array(p[run] - least)], ["id", "th", "lo", "hi"])


def _ranked(batches):
    """For buckets over MOST: for each group of STEP suffixes of a run the hash of their common bytes and of all their bytes."""
    for b in batches:
        for i, data in enumerate(_each(b.column(0))):
            p, lo, hi, w, key = _items(b, i, 3, "p", "lo", "hi", "w", "key")
            first, last = (p - hi) // STEP, (p - lo) // STEP
            n = last - first + 1
            of = np.repeat(np.arange(len(p)), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[of]
            near, far = np.maximum(step * STEP, (p - hi)[of]), np.minimum(step * STEP + STEP - 1, (p - lo)[of])
            sample = p[of] - step * STEP
            core = _text.contents(data, sample, sample + LENGTH - STEP + 1, step)
            hull = _text.contents(data, p[of] - far, p[of] - near + LENGTH, (near % STEP) * STEP + far % STEP)
            ids = pa.array([i] * len(of))
            yield _rows((_text.mix(core ^ key[of].view(_U)), hull, w[of].astype(np.int32), b.column(1).take(ids), b.column(2).take(ids), sample, p[of] - far, p[of] - near))


def _each(column):
    """The bytes of each row."""
    for _, _, data, offsets in _text.text_slices(column):
        for a, b in zip(offsets[:-1], offsets[1:]):
            yield data[a:b]


def _compared(batches):
    """For buckets over MOST: each suffix with its distance to the ranked sample and the STEP - 1 bytes beside the sample."""
    for b in batches:
        for i, data in enumerate(_each(b.column(0))):
            p, lo, hi, w, key = _items(b, i, 3, "p", "lo", "hi", "w", "key")
            n = hi - lo + 1
            of = np.repeat(np.arange(len(p)), n)
            start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[of]
            left = p[of] - start
            beside = np.arange(STEP - 1)
            place = np.where(beside < left[:, None], start[:, None] + beside, p[of][:, None] + LENGTH - STEP + 1 + beside - left[:, None])
            literal = np.concatenate((left[:, None].astype(np.uint8), data[place]), 1)
            ids = pa.array([i] * len(of))
            yield pa.RecordBatch.from_arrays([pa.array(key[of]), pa.array([x.tobytes() for x in literal], pa.binary()), pa.array(w[of].astype(np.int32)), b.column(1).take(ids), b.column(2).take(ids), pa.array(start), pa.array(start), pa.array(start)], _NAMES)


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marks, open) of rows (key, hull, w, id, th, p, lo, hi), w being 2 where the row stands for several places, 0 where it is a mark.

    marks (id, th, lo, hi) are rows whose content occurs more than once in its bucket. open are
    buckets with several contents: one row for each content, w saying whether it is repeated, m how many there are in the bucket.
    """
    every = cut(rows)
    rows = every.where("w > 0")
    contents = cut(rows.groupBy("key", "hull").agg(F.sum("w").alias("n")))
    buckets = contents.groupBy(F.col("key").alias("_bk")).agg(F.sum("n").alias("_total"), F.count("*").alias("_m")).where("_total > 1")
    kept = contents.join(buckets, F.col("key") == F.col("_bk")).select(F.col("key").alias("_k"), F.col("hull").alias("_h"), "n", "_m")
    found = cut(rows.join(kept, (F.col("key") == F.col("_k")) & (F.col("hull") == F.col("_h"))).drop("_k", "_h"))
    marks = found.where("n > 1").select("id", "th", "lo", "hi").unionByName(every.where("w = 0").select("id", "th", "lo", "hi"))
    one = found.where("_m > 1").groupBy("key", "hull").agg(F.least(F.max("n"), F.lit(2)).cast("int").alias("w"), F.max("_m").alias("m"), F.min(F.struct("id", "th", "p", "lo", "hi")).alias("at"))
    out = cut(one.select("key", "w", "m", "at.*"))
    tidy(rows.sparkSession)
    return marks, out


def _with(docs: DataFrame, table: DataFrame, items: int, how: str) -> DataFrame:
    """docs (id, th, text) joined to a table (_id, _th, items): by broadcast if it holds few items, else by shuffle."""
    if items <= BROADCAST_ITEMS:
        table = F.broadcast(table)
    return docs.join(table, docs["id"].eqNullSafe(table["_id"]) & (docs["th"] == table["_th"]), how).select("text", "id", "th", "items")


def _next(docs: DataFrame, open_: DataFrame, step, kind: str) -> DataFrame:
    """Rows that a step makes of the open rows and their texts."""
    grouped = open_.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("p", "lo", "hi", "w", "key")).alias("items"))
    return _with(docs, cut(grouped), open_.count(), "inner").mapInArrow(step, kind.format(kind=_kind(docs)))


def _kind(docs: DataFrame) -> str:
    return docs.schema["id"].dataType.simpleString()


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(_id, _th, items): for each text with repeats the maximal byte ranges (lo, hi) of repeated strings."""
    kind = _kind(docs)
    marks, open_ = _settle(docs.select("text", "id", "th").mapInArrow(_sampled, _ROWS.format(kind=kind)))
    bounded = _next(docs, open_.where(F.col("m") <= MOST), _around, ", ".join(f"{c} {t}" for c, t in _AROUND.items()))
    ordered = bounded.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_buckets, f"id {kind}, th bigint, lo bigint, hi bigint")
    marks = marks.unionByName(ordered)
    large = open_.where(F.col("m") > MOST)
    if not large.isEmpty():
        more, open_ = _settle(_next(docs, large, _ranked, _ROWS))
        last, _ = _settle(_next(docs, open_, _compared, _ROWS.replace("hull bigint", "hull binary")))
        marks = marks.unionByName(more).unionByName(last)
    every = marks.select("id", "th", "lo", (F.col("hi") + LENGTH).alias("hi"))
    # A set: rows repeated under one id have the same ranges, and each range travels once.
    own = every.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set(F.struct("lo", "hi")).alias("items"))
    return own.mapInArrow(_maximal, f"_id {kind}, _th bigint, items array<struct<lo:bigint,hi:bigint>>")


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching ranges."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.concatenate(([True], lo[1:] > reach[:-1])))
    return lo[new], reach[np.concatenate((new[1:] - 1, [len(lo) - 1]))]


def _ranges(los: list, his: list, names) -> pa.ListArray:
    """Ranges of each row as an array of structs."""
    cuts = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in los]))), pa.int32())
    whole = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
    return pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([whole(los), whole(his)], names))


def _maximal(batches):
    for b in batches:
        los, his = zip(*(_merged(*_items(b, i, 2, "lo", "hi")) for i in range(len(b)))) if len(b) else ((), ())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _ranges(los, his, ["lo", "hi"])], ["_id", "_th", "items"])


def _removed(batches):
    for b in batches:
        size, starts, ends, kept = [], [], [], []
        for i, data in enumerate(_each(b.column(0))):
            lo, hi = _items(b, i, 3, "lo", "hi")
            edges = [0, *np.stack((lo, hi), 1).ravel().tolist(), len(data)]
            view = memoryview(np.ascontiguousarray(data))
            kept.append(b"".join(view[x:y] for x, y in zip(edges[::2], edges[1::2])))
            size.append(len(data))
            starts.append(lo)
            ends.append(hi)
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(size, pa.int64()), _ranges(starts, ends, ["start", "end"]), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, spans (maximal removed byte ranges, ends exclusive), kept (the other bytes).

    Texts are UTF-8 bytes, null is empty; strings are judged on the input, matches never cross
    rows. Repeated rows are repeats of each other. Texts under LENGTH bytes keep everything. Ids may be of any
    type and null; other columns are not read; an empty table gives no rows.
    """
    session_for_texts(docs.sparkSession)
    body = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    with Scope() as scope:
        spans = scope.keep(repeated_spans(body))
    items = spans.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
    out = _with(body, spans, items, "left").mapInArrow(_removed, f"id {_kind(body)}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("id", id_col)


#: DuckDB SQL of the query's rows: every window of 400 bytes of hexadecimal text, cut out of pieces of 800, is counted by its MD5.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS nr, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT nr, length(h) // 2 AS n, p, substr(h, 800 * p + 1, 1600) AS piece FROM (SELECT nr, h, unnest(range(0, greatest(0, length(h) // 800))) AS p FROM t)),
starts AS (SELECT nr, 400 * p + i AS s, md5(substr(piece, 2 * i + 1, 800)) AS k FROM (SELECT nr, n, p, piece, unnest(range(0, least(400, n - 399 - 400 * p))) AS i FROM pieces)),
twice AS (SELECT k FROM starts GROUP BY k HAVING count(*) > 1),
marked AS (SELECT nr, s, s > lag(s) OVER w + 400 AS apart FROM starts SEMI JOIN twice USING (k) WINDOW w AS (PARTITION BY nr ORDER BY s)),
runs AS (SELECT nr, min(s) AS a, max(s) + 400 AS b FROM (SELECT nr, s, sum(CASE WHEN coalesce(apart, true) THEN 1 ELSE 0 END) OVER (PARTITION BY nr ORDER BY s) AS g FROM marked) GROUP BY nr, g),
edges AS (SELECT nr, list(a ORDER BY a) AS lo, list(b ORDER BY a) AS hi, sum(b - a) AS gone, count(*) AS spans FROM runs GROUP BY nr)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(array_to_string(list_transform(range(0, len(lo) + 1), lambda i: CASE WHEN i = 0 THEN substr(h, 1, 2 * lo[1]) WHEN i = len(lo) THEN substr(h, 2 * hi[i] + 1) ELSE substr(h, 2 * hi[i] + 1, 2 * (lo[i + 1] - hi[i])) END), ''), h))) AS kept_sha256
FROM t LEFT JOIN edges USING (nr)
"""
