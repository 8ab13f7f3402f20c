"""Toxicity scoring with subword-bag embeddings and a linear softmax (operator 2).

A word is the mean of the vectors of its character n-grams (hashed into BUCKETS
rows), a window of WINDOW words is the mean of its words, and a linear softmax over
that mean gives the window's class. Embeddings and softmax are trained jointly with
Adam in NumPy. Labels belong to documents while insults sit in single windows, so
training has two passes: the first gives every window its document's label, the second
keeps of the toxic documents only the windows that the first pass finds toxic. A
document's logit is that of its worst window, calibrated on held-back training rows.

Fitting uses at most SAMPLE labelled rows of at most SAMPLE_BYTES of text each; scoring
reads whole texts. As the model is linear in the embeddings, scoring needs one number
for each bucket, 256 KB whatever the data, and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import _text
from lectern.llm._spark import session_for_texts

BUCKETS_LOG2 = 16
BUCKETS = 1 << BUCKETS_LOG2
DIMENSIONS = 8
NGRAMS = (3, 4, 5)
WINDOW = 12
SAMPLE = 3000
SAMPLE_BYTES = 4000
PORTION = 1 << 20  # bytes of a longer text that are scored at a time
THRESHOLD = 0.3
HELD_OUT = 2  # rows with crc32(id as text) mod 4 of this are never learnt from

SEPARATORS = np.zeros(256, bool)
SEPARATORS[:128] = [not chr(i).isalnum() for i in range(128)]
_K = {n: np.random.RandomState(n).randint(1, 2**31, n, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1) for n in NGRAMS}


@dataclass
class Words:
    """Words of a slice of rows and their n-grams; `code` and `valid` go over a buffer of <word> after <word>."""

    row: np.ndarray
    first: np.ndarray  # where each word starts in the buffer
    count: np.ndarray  # n-grams of each word
    codes: list[np.ndarray]
    valid: list[np.ndarray]


def subwords(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = _text.lower_ascii(data)
    start, end, row = _text.words(low, offsets, SEPARATORS)
    size = end - start
    first = np.concatenate(([0], np.cumsum(size + 2)))[: len(size)] if len(size) else np.zeros(0, np.int64)
    total = int((size + 2).sum())
    buffer = np.full(total + 8, ord(">"), np.uint8)
    if len(size):
        word = np.repeat(np.arange(len(size)), size)
        source = np.arange(len(word)) + np.repeat(start - np.concatenate(([0], np.cumsum(size)))[:-1], size)
        buffer[np.arange(len(word)) + 2 * word + 1] = low[source]
        buffer[first] = ord("<")
    left = np.repeat(size + 2, size + 2) - (np.arange(total) - np.repeat(first, size + 2))  # bytes of the word from here on
    wide = buffer.astype(np.uint32)
    codes, valid = [], []
    with np.errstate(over="ignore"):
        for n in NGRAMS:
            h = np.zeros(total, np.uint32)
            for j in range(n):
                h += wide[j : j + total] * _K[n][j]
            h ^= h >> np.uint32(15)
            codes.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS_LOG2))
            valid.append(left >= n)
    count = sum(np.maximum(size + 3 - n, 0) for n in NGRAMS) if len(size) else np.zeros(0, np.int64)
    return Words(row, first, count, codes, valid)


@dataclass
class Model:
    bucket: np.ndarray  # logit of each bucket: embedding times the difference of the softmax columns
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Calibrated logit of each row: that of its highest window of WINDOW consecutive words."""
        n = len(offsets) - 1
        w = subwords(data, offsets)
        best = np.full(n, min(0.0, self.bias))
        if len(w.first):
            values = np.zeros(len(w.codes[0]), np.float64)
            for codes, valid in zip(w.codes, w.valid):
                values += np.where(valid, self.bucket[codes], 0.0)
            word = np.add.reduceat(values, w.first) / w.count
            prefix = np.concatenate(([0.0], np.cumsum(word)))
            cut = np.searchsorted(w.row, np.arange(n + 1))
            at = np.arange(len(word))
            # A window starts at each word that has WINDOW words ahead, or at the row's first word.
            stop = np.minimum(at + WINDOW, cut[w.row + 1])
            starts = (stop - at == WINDOW) | (at == cut[w.row])
            mean = np.where(starts, (prefix[stop] - prefix[at]) / (stop - at), -np.inf)
            some = np.flatnonzero(cut[1:] > cut[:-1])
            best[some] = np.maximum.reduceat(mean, cut[some]) + self.bias
        return self.scale * best + self.shift

    def scores(self, column: pa.Array) -> np.ndarray:
        parts = [self.logits(data, offsets) if len(data) <= PORTION else np.array([self._long(data)]) for _, _, data, offsets in _text.text_slices(column)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(parts), -30, 30))) if parts else np.zeros(0)

    def _long(self, data: np.ndarray) -> float:
        """The logit of one text over PORTION bytes: the highest of its portions, which share WINDOW - 1 words, so that no window is missed."""
        start, end, _ = _text.words(_text.lower_ascii(data), np.array([0, len(data)]), SEPARATORS)
        pieces, i = [], 0
        while i < len(start):
            j = max(i + WINDOW, int(np.searchsorted(end, start[i] + PORTION, side="right")))
            pieces.append(data[start[i] : end[min(j, len(end)) - 1]])
            if j >= len(start):
                break
            i = j - WINDOW + 1
        # The scale may be negative: raw logits are compared, as in `logits`.
        plain = Model(self.bucket, self.bias)
        raw = max((float(plain.logits(x, np.array([0, len(x)]))[0]) for x in pieces), default=min(0.0, self.bias))
        return self.scale * raw + self.shift


class _Trainer:
    """Joint training of embeddings and softmax by Adam over mini-batches of windows."""

    def __init__(self, seed: int):
        rng = np.random.RandomState(seed)
        self.p = [rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS, rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)]
        self.m = [np.zeros_like(x) for x in self.p]
        self.v = [np.zeros_like(x) for x in self.p]
        self.t = 0

    def step(self, codes, weight, first, count, y, rate, decay):
        """Window k is the sum of weight * embedding over its `count[k]` n-grams from first[k] on."""
        E, W, b = self.p
        x = np.add.reduceat(E[codes] * weight[:, None], first, axis=0)
        z = x @ W + b
        z -= z.max(1, keepdims=True)
        g = np.exp(z)
        g /= g.sum(1, keepdims=True)
        g[np.arange(len(y)), y] -= 1
        g /= len(y)
        spread = np.repeat(g @ W.T, count, axis=0) * weight[:, None]
        gE = np.stack([np.bincount(codes, weights=spread[:, d], minlength=BUCKETS) for d in range(DIMENSIONS)], 1).astype(np.float32)
        grads = [gE, x.T @ g, g.sum(0)]
        self.t += 1
        for k, grad in enumerate(grads):
            self.m[k] *= 0.9
            self.m[k] += 0.1 * grad
            self.v[k] *= 0.999
            self.v[k] += 0.001 * grad * grad
            self.p[k] -= rate / (1 - 0.9**self.t) * self.m[k] / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
        self.p[0] *= 1 - rate * decay

    def model(self) -> Model:
        E, W, b = self.p
        return Model((E @ (W[:, 1] - W[:, 0])).astype(np.float32), float(b[1] - b[0]))


@dataclass
class _Set:
    """Non-overlapping windows of texts: n-grams by word, words by window, windows by text."""

    codes: np.ndarray
    word_cut: np.ndarray  # n-grams of word j are codes[word_cut[j] : word_cut[j + 1]]
    window_cut: np.ndarray  # words of window k, likewise
    doc: np.ndarray
    spans: np.ndarray  # bytes of each window
    data: np.ndarray
    weight: np.ndarray = None  # of each n-gram: a word is the mean of its n-grams, a window that of its words

    def __post_init__(self):
        grams, words = np.diff(self.word_cut), np.diff(self.window_cut)
        self.weight = np.repeat(1.0 / (grams * np.repeat(words, words)), grams).astype(np.float32)

    @classmethod
    def of(cls, texts: list[str]) -> _Set:
        """Built slice by slice, so that only the two bytes of each n-gram's bucket are held for all texts."""
        codes, per_word, per_window, docs, spans, parts = [], [], [], [], [], []
        base = 0
        for i, _, data, offsets in _text.text_slices(pa.array(texts, pa.string()), 1 << 18):
            w = subwords(data, offsets)
            n = len(w.first)
            parts.append(data.copy())
            if n:
                widest = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.concatenate((w.first, [len(w.codes[0])]))))
                word = np.concatenate([widest[v] for v in w.valid])
                order = np.argsort(word, kind="stable")
                codes.append(np.concatenate([c[v] for c, v in zip(w.codes, w.valid)]).astype(np.uint16)[order])
                per_word.append(np.bincount(word, minlength=n))
                cut = np.searchsorted(w.row, np.arange(len(offsets)))
                place = (np.arange(n) - cut[w.row]) // WINDOW
                fresh = np.flatnonzero(np.concatenate(([True], (np.diff(w.row) != 0) | (np.diff(place) != 0))))
                size = np.diff(np.concatenate((fresh, [n])))
                start, end, _ = _text.words(_text.lower_ascii(data), offsets, SEPARATORS)
                per_window.append(size)
                docs.append(w.row[fresh] + i)
                spans.append(np.stack([start[fresh], end[fresh + size - 1]], 1) + base)
            base += len(data)
        whole = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        bounds = lambda x: np.concatenate(([0], np.cumsum(whole(x, np.int64)))).astype(np.int64)
        return cls(whole(codes, np.uint16), bounds(per_word), bounds(per_window), whole(docs, np.int64), whole(spans, np.int64).reshape(-1, 2), whole(parts, np.uint8))

    def take(self, windows: np.ndarray):
        """Arguments of a training step for these windows."""
        cut = self.word_cut[self.window_cut]
        count = cut[windows + 1] - cut[windows]
        first = np.cumsum(count) - count
        at = np.arange(count.sum()) + np.repeat(cut[windows] - first, count)
        return self.codes[at], self.weight[at], first, count

    def logits(self, model: Model) -> np.ndarray:
        word = np.add.reduceat(model.bucket[self.codes].astype(np.float64), self.word_cut[:-1]) / np.diff(self.word_cut)
        return np.add.reduceat(word, self.window_cut[:-1]) / np.diff(self.window_cut) + model.bias

    def text(self, window: int) -> str:
        a, b = self.spans[window]
        return self.data[a:b].tobytes().decode("utf-8", "replace")


def misspell(text: str, rng: np.random.RandomState) -> str:
    """Each word of four letters or more with one letter doubled, dropped, replaced or swapped with the next."""
    out = []
    for word in text.split():
        if len(word) >= 4:
            i, kind = rng.randint(len(word) - 1), rng.randint(4)
            if kind == 0:
                word = word[: i + 1] + word[i:]
            elif kind == 1:
                word = word[:i] + word[i + 1 :]
            elif kind == 2:
                word = word[:i] + "abcdefghijklmnopqrstuvwxyz0123456789"[rng.randint(36)] + word[i + 1 :]
            else:
                word = word[:i] + word[i + 1] + word[i] + word[i + 2 :]
        out.append(word)
    return " ".join(out)


def fit(texts: list[str], toxic: list[int], seed: int = 7, steps: int = 160, batch: int = 2048, rate: float = 0.05, decay: float = 0.03, variants: int = 3) -> Model:
    """Model of texts and their 0/1 labels. Without both classes, or without words, a constant one."""
    y = np.array(toxic, int)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    constant = Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(prior / (1 - prior))))
    if not len(y) or y.min() == y.max():
        return constant
    rng = np.random.RandomState(seed)
    back = rng.rand(len(y)) < 0.2  # for calibration only
    used = np.flatnonzero(~back)
    plain = _Set.of([texts[i] for i in used])
    if not len(plain.codes):
        return constant
    labels = y[used][plain.doc]
    trainer = _Trainer(seed)

    def run(sets):
        """Epochs over windows of several sets until `steps` are made; sets: (windows, the chosen ones, their labels)."""
        per_epoch = sum(-(-len(chosen) // batch) for _, chosen, _ in sets)
        for _ in range(-(-steps // max(1, per_epoch))):
            parts = [(s, part, to) for s, chosen, to in sets if len(chosen) for part in np.array_split(rng.permutation(chosen), -(-len(chosen) // batch))]
            for k in rng.permutation(len(parts)):
                s, part, to = parts[k]
                trainer.step(*s.take(part), to[part], rate, decay)

    everything = np.arange(len(labels))
    run([(plain, everything, labels)])
    logit = plain.logits(trainer.model())
    keep = (labels == 0) | (logit > 0)
    if labels[keep].any():
        worst = np.flatnonzero(keep & (labels == 1))
        clean = rng.choice(np.flatnonzero(labels == 0), min(len(worst), int((labels == 0).sum())), replace=False)
        of = np.concatenate((worst, clean))
        odd = _Set.of([misspell(plain.text(i), rng) for i in of for _ in range(variants)])
        odd_labels = labels[of][odd.doc // variants]
        run([(plain, np.flatnonzero(keep), labels), (odd, np.arange(len(odd_labels)), odd_labels)])
    return _calibrated(trainer.model(), [texts[i] for i in np.flatnonzero(back)], y[back], prior)


def _calibrated(model: Model, texts: list[str], y: np.ndarray, prior: float) -> Model:
    """Logistic regression of the label on the raw logit, lightly held towards slope 1."""
    if not len(texts):
        return model
    x = np.concatenate([model.logits(data, offsets) for _, _, data, offsets in _text.text_slices(pa.array(texts, pa.string()), 1 << 18)])
    mid, wide = float(np.median(x)), float(x.std()) or 1.0
    v = (x - mid) / wide
    a, c = 1.0, float(np.log(prior / (1 - prior)))

    def loss(a, c):
        z = a * v + c
        return float((np.logaddexp(0, z) - y * z).sum() + 0.05 * a * a)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * v + c, -30, 30)))
        g = np.array([((p - y) * v).sum() + 0.1 * a, (p - y).sum()])
        w = p * (1 - p)
        d = np.linalg.solve(np.array([[(w * v * v).sum() + 0.1, (w * v).sum()], [(w * v).sum(), w.sum() + 1e-6]]), g)
        step = 1.0
        while step > 1e-6 and loss(a - step * d[0], c - step * d[1]) > loss(a, c):
            step /= 2
        a, c = a - step * d[0], c - step * d[1]
        if np.abs(step * d).max() < 1e-8:
            break
    if a <= 0:
        return model
    return Model(model.bucket, model.bias, float(a / wide), float(c - a * mid / wide))


def is_held_out(id_column):
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 4 == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Model of a bounded sample of labelled rows that are not held out.

    Of the labelled ids the `sample` with the smallest hashes are taken, then their texts of up
    to `sample_bytes`. An id labelled several times has the highest label; null labels are none. Of
    an id with several texts the one with the least hash counts, so at most `sample` rows are collected.
    """
    ids = labels.select(labels[f"`{id_col}`"].alias("_id"), labels[f"`{label}`"].cast("int").alias("_y")).where(F.col("_y").isNotNull() & F.col("_id").isNotNull() & ~is_held_out(F.col("_id")))
    ids = ids.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    body = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text}`"].cast("string").alias("text")).where(F.octet_length("text") <= sample_bytes)
    least = F.min(F.struct(F.xxhash64("text").alias("th"), "text")).alias("least")
    rows = body.join(F.broadcast(ids), F.col("id") == F.col("_id")).groupBy("id").agg(least, F.max("_y").alias("_y")).select("id", "least.text", "_y").collect()
    rows.sort(key=lambda r: (str(r[0]), r[1]))
    return fit([r[1] for r in rows], [int(r[2] > 0) for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, score in [0, 1] and predicted (1 if score >= threshold).

    Null and empty texts get the score of no evidence; repeated rows score alike; other columns
    are not read; an empty table gives no rows.
    """
    session_for_texts(docs.sparkSession)
    body = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text}`"].cast("string").alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1)), pa.float64())], ["id", "score"])

    out = body.mapInArrow(run, f"id {body.schema['id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under the threshold, all columns kept."""
    session_for_texts(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.scores(b.column(place)) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
