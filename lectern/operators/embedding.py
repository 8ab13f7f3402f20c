"""Embedders and their use on DataFrames: the vector is a column of the row that holds the text."""

from __future__ import annotations

import hashlib
import json
import math
import time
import urllib.error
import urllib.request
from collections import Counter
from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from lectern._workers import importable

# Fixed values of the retry rule: first wait, factor, longest wait, longest time in all (seconds).
FIRST_WAIT, FACTOR, MOST_WAIT, MOST_TIME = 1.0, 2.0, 30.0, 120.0
# Fixed values of API errors that are worth another try.
RETRIED_CODE, RETRIED_TYPE = "rate_limit_exceeded", "server_error"
RETRIED_WORDS = ("service unavailable", "overloaded")


class EmbeddingError(RuntimeError):
    def __init__(self, message: str, code: str | None = None, kind: str | None = None):
        super().__init__(message)
        self.code, self.kind = code, kind


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


@lru_cache(1 << 16)
def _hashed(word: str) -> tuple[int, float]:
    h = hashlib.md5(word.encode()).digest()
    return int.from_bytes(h[:4], "little"), 1.0 if h[4] & 1 else -1.0


class HashingEmbedder:
    """Signed feature hashing of lower-cased words: deterministic and offline, for tests and trials."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts):
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w, n in Counter(t.lower().split()).items():
                slot, sign = _hashed(w)
                v[slot % self.size] += sign * n
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


def is_retryable(error: BaseException) -> bool:
    """Connection failures, timeouts, rate limits and server errors."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code == 429 or error.code >= 500
    if isinstance(error, (urllib.error.URLError, TimeoutError, ConnectionError)):
        return True
    if isinstance(error, EmbeddingError):
        return error.code == RETRIED_CODE or error.kind == RETRIED_TYPE or any(w in str(error).lower() for w in RETRIED_WORDS)
    return False


def with_retry(call: Callable, sleep=time.sleep, clock=time.monotonic):
    """call() again after retryable errors, waiting longer each time, for two minutes at most."""
    wait, until = FIRST_WAIT, clock() + MOST_TIME
    while True:
        try:
            return call()
        except Exception as e:
            if not is_retryable(e) or clock() + wait > until:
                raise
        sleep(wait)
        wait = min(wait * FACTOR, MOST_WAIT)


class HttpEmbedder:
    """Client of an HTTP embeddings endpoint with the widespread `input`/`data` JSON form."""

    def __init__(self, base_url: str, model: str, api_key: str | None = None, batch_size: int = 32, timeout: float = 60.0):
        self.base_url, self.model, self.api_key, self.batch_size, self.timeout = base_url.rstrip("/"), model, api_key, batch_size, timeout

    def _post(self, texts: Sequence[str]) -> dict:
        body = json.dumps({"model": self.model, "input": list(texts)}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{self.base_url}/embeddings", body, headers), timeout=self.timeout) as r:
                answer = json.load(r)
        except urllib.error.HTTPError as e:
            try:
                answer = json.loads(e.read())
            except ValueError:
                raise e from None
            if "error" not in answer:
                raise e from None
        if "error" in answer:
            e = answer["error"]
            raise EmbeddingError(e.get("message", "error"), e.get("code"), e.get("type"))
        return answer

    def embed(self, texts):
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch_size):
            part = texts[at : at + self.batch_size]
            answer = with_retry(lambda part=part: self._post(part))
            vectors = [d["embedding"] for d in sorted(answer["data"], key=lambda d: d["index"])]
            if len(vectors) != len(part):
                raise EmbeddingError(f"Embedding count mismatch: {len(part)} texts, {len(vectors)} vectors")
            out += vectors
        return out


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", out: str = "vector", size: int | None = None) -> DataFrame:
    """rows plus their vectors, Arrow batch by Arrow batch; a wrong count or size is an error."""
    importable(rows.sparkSession)
    columns, place = rows.columns, rows.columns.index(text)

    def run(batches):
        for b in batches:
            vectors = embedder.embed(b.column(place).to_pylist()) if len(b) else []
            if len(vectors) != len(b):
                raise EmbeddingError(f"Embedding count mismatch: {len(b)} texts, {len(vectors)} vectors")
            if size is not None and any(len(v) != size for v in vectors):
                raise EmbeddingError(f"a vector does not have {size} components")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], [*columns, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, `{out}` array<float>")


def embed_query(embedder: Embedder, query: str) -> list[float]:
    return embedder.embed([query])[0]
