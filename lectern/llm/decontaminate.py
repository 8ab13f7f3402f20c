"""Benchmark decontamination by greedy string tiling (operator 8).

Documents and benchmark items are word sequences. An item meets a document if they
share a seed, a run of SEED words with equal Karp-Rabin hash. For such a pair the
longest match between unmarked words is marked as a tile, again and again (ties to
the earliest place in the item, then in the document), running Karp-Rabin hashes of the
current length finding the candidates, until no match of SEED words is left. The
tiles' share of the item's words is its coverage; passages whose parts were moved
around are covered all the same. Tiles never overlap on either side.

The benchmark is split into blocks of bounded size; each block is broadcast and
meets every document in one pass without a shuffle.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from lectern.llm import _text
from lectern.llm._spark import session_for_texts

SEED = 5  # least words of a match
THRESHOLD = 0.5  # coverage from which a document counts as contaminated
BLOCK_ITEMS = 50_000  # items broadcast at a time ...
BLOCK_BYTES = 16 << 20  # ... and the bytes of their texts

# Separators: ASCII characters that are neither letter nor digit. Bytes of longer characters are letters.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[:128] = [not chr(i).isalnum() for i in range(128)]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _text.word_hashes(data, offsets, SEPARATORS)


def _runs(h: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of each run of `width` words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, inverse = _text.powers(1, len(h) + 1)
    prefix = np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(h * inverse[: len(h)], out=prefix[1:])
        return _text.mix((prefix[width:] - prefix[:-width]) * base[:n])


def tile(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in doc, length), longest first, of two sequences of word hashes."""
    tiles: list[tuple[int, int, int]] = []
    marked_i, marked_d = np.zeros(len(item) + 1, np.int64), np.zeros(len(doc) + 1, np.int64)  # marked words up to each place

    def common(width: int) -> tuple[int, int] | None:
        """Earliest unmarked match of `width` words; what the hashes find is compared word by word."""
        hi, hd = _runs(item, width), _runs(doc, width)
        free_i = np.flatnonzero(marked_i[width:] == marked_i[: len(hi)]) if len(hi) else np.zeros(0, np.int64)
        free_d = np.flatnonzero(marked_d[width:] == marked_d[: len(hd)]) if len(hd) else np.zeros(0, np.int64)
        for i in free_i[np.isin(hi[free_i], hd[free_d])].tolist():
            for d in free_d[hd[free_d] == hi[i]].tolist():
                if np.array_equal(item[i : i + width], doc[d : d + width]):
                    return i, d
        return None

    longest = min(len(item), len(doc))
    while longest >= least:
        # A common run holds common runs of all smaller lengths: bisect for the longest.
        low, high, at = least - 1, longest, None
        while low < high:
            mid = (low + high + 1) // 2
            found = common(mid)
            if found:
                low, at = mid, found
            else:
                high = mid - 1
        if at is None:
            break
        tiles.append((*at, low))
        marked_i[at[0] + 1 :] += np.minimum(np.arange(1, len(item) - at[0] + 1), low)
        marked_d[at[1] + 1 :] += np.minimum(np.arange(1, len(doc) - at[1] + 1), low)
        longest = low
    return tiles


def coverage(item_words: np.ndarray, doc_words: np.ndarray, least: int = SEED) -> tuple[int, int]:
    """(words of the item under tiles, tiles). Items of fewer than `least` words match as a whole."""
    if 0 < len(item_words) < least:
        least = len(item_words)
    tiles = tile(item_words, doc_words, least)
    return sum(t[2] for t in tiles), len(tiles)


def _blocks(benchmark: DataFrame, item_id: str, text: str):
    """Items in blocks that never exceed BLOCK_ITEMS or so, each as (ids, word hashes of each)."""
    items = benchmark.select(benchmark[f"`{item_id}`"].alias("item_id"), F.coalesce(benchmark[f"`{text}`"].cast("string"), F.lit("")).alias("text"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for k in range(parts if n else 0):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        ids = [r[0] for r in rows]
        hashed = []
        for _, _, data, offsets in _text.text_slices(pa.array([r[1] for r in rows], pa.string()), 1 << 40):
            h, row = word_hashes(data, offsets)
            cut = np.searchsorted(row, np.arange(len(offsets)))
            hashed += [h[cut[i] : cut[i + 1]] for i in range(len(offsets) - 1)]
        yield ids, hashed


class Matcher:
    """One block of items with its seeds sorted for lookup."""

    def __init__(self, ids: list, items: list[np.ndarray], threshold: float):
        self.ids, self.items, self.threshold = ids, items, threshold
        widths = sorted({min(SEED, len(x)) for x in items if len(x)})
        self.seeds = {}
        for w in widths:
            pairs = [(s, k) for k, x in enumerate(items) if min(SEED, len(x)) == w for s in np.unique(_runs(x, w)).tolist()]
            order = np.argsort(np.array([s for s, _ in pairs], np.uint64), kind="stable")
            self.seeds[w] = (np.array([s for s, _ in pairs], np.uint64)[order], np.array([k for _, k in pairs], np.int64)[order])

    def matches(self, column: pa.Array) -> list[list[tuple]]:
        """For each text its (item, words covered, tiles) at or over the threshold."""
        out: list[list[tuple]] = []
        for _, _, data, offsets in _text.text_slices(column):
            h, row = word_hashes(data, offsets)
            n = len(offsets) - 1
            cut = np.searchsorted(row, np.arange(n + 1))
            met: dict[int, set[int]] = {}
            for w, (keys, owner) in self.seeds.items():
                runs = _runs(h, w)
                hit = np.flatnonzero(np.isin(runs, keys))
                hit = hit[row[hit] == row[hit + w - 1]]
                for p in hit.tolist():
                    a, b = np.searchsorted(keys, runs[p], "left"), np.searchsorted(keys, runs[p], "right")
                    met.setdefault(int(row[p]), set()).update(owner[a:b].tolist())
            found: list[list[tuple]] = [[] for _ in range(n)]
            for i, items in met.items():
                words = h[cut[i] : cut[i + 1]]
                for k in sorted(items):
                    covered, tiles = coverage(self.items[k], words)
                    if covered >= self.threshold * len(self.items[k]):
                        found[i].append((k, covered, tiles))
            out += found
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item whose tiles cover `threshold` of the item or more.

    Columns: the document's id, item_id, covered_words, item_words, coverage, tiles. Null and
    empty texts and items meet nothing; repeated documents or items give repeated rows; an
    empty table gives none; ids may be of any type and null; columns other than ids and texts are not read.
    """
    session_for_texts(docs.sparkSession)
    item_kind = to_arrow_type(benchmark.schema[item_id].dataType)
    body = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text}`"].cast("string").alias("text"))
    kinds = body.schema["id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"id {kinds[0]}, item_id {kinds[1]}, covered_words bigint, item_words bigint, coverage double, tiles bigint"
    out = None
    for ids, items in _blocks(benchmark, item_id, item_text):
        packed = pickle.dumps(Matcher(ids, items, threshold))

        def run(batches, packed=packed):
            m = pickle.loads(packed)
            for b in batches:
                rows = [(i, *x) for i, found in enumerate(m.matches(b.column(1))) for x in found]
                if rows:
                    at = [r[0] for r in rows]
                    size = [len(m.items[r[1]]) for r in rows]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([m.ids[r[1]] for r in rows], item_kind), pa.array([r[2] for r in rows], pa.int64()), pa.array(size, pa.int64()), pa.array([r[2] / s for r, s in zip(rows, size)], pa.float64()), pa.array([r[3] for r in rows], pa.int64())], ["id", "item_id", "covered_words", "item_words", "coverage", "tiles"])

        part = body.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that no item contaminates, all columns kept, in one pass for each block of items."""
    session_for_texts(docs.sparkSession)
    place = docs.columns.index(text)
    for ids, items in _blocks(benchmark, item_id, item_text):
        packed = pickle.dumps(Matcher(ids, items, threshold))

        def run(batches, packed=packed):
            m = pickle.loads(packed)
            for b in batches:
                yield b.filter(pa.array([not found for found in m.matches(b.column(place))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
