"""Embeddings: a deterministic one from character bigrams, and a way in for models.

The built-in embedding counts the bigrams of a text in ``DIMS`` buckets, by the
first 8 hex digits of the bigram's md5, and scales the counts to unit length.  It
runs in Arrow batches, with a table of the bigrams met so far.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docloom.session import ship

DIMS = 256
#: Texts a call to a model gets at most, and tries it gets.
BATCH, TRIES = 10, 3
#: Seconds before the second try; doubled before each later one.
WAIT = 0.5
#: Code points whose pairs have a table, and characters counted at once.
DENSE, CHARS = 1024, 1 << 20


class Busy(Exception):
    """A model's answer that it can't serve now (status 429, or 500 and above); ``status`` says which."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def passing(error: Exception) -> bool:
    """Whether another try may do: a failed link, or a status of 429 or 500 and above on the error or its response."""
    status = getattr(error, "status", None) or getattr(error, "status_code", None) or getattr(getattr(error, "response", None), "status_code", None)
    return isinstance(error, (ConnectionError, TimeoutError)) or isinstance(status, int) and (status == 429 or status >= 500)


def tried(call, tries: int = TRIES, wait: float = WAIT):
    """call(), again after a growing wait if its error is passing."""
    for n in range(1, tries + 1):
        try:
            return call()
        except Exception as e:
            if n == tries or not passing(e):
                raise
            time.sleep(wait * 2 ** (n - 1))


class Provider(Protocol):
    """Turns texts into vectors; must be picklable, as it runs on the executors."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def bucket(bigram: str, dims: int = DIMS) -> int:
    return int(hashlib.md5(bigram.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % dims


class Bigrams:
    def __init__(self, dims: int = DIMS):
        self.dims, self.known = dims, {}
        self.table = np.full(DENSE * DENSE, -1, np.int32)

    def counts(self, text: str | None) -> np.ndarray:
        """Each different bigram is looked up once a text."""
        code = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pairs, n = np.unique((code[:-1] << 21) | code[1:], return_counts=True)
        at = np.empty(len(pairs), np.int64)
        for i, pair in enumerate(pairs.tolist()):
            if (b := self.known.get(pair)) is None:
                b = self.known[pair] = bucket(chr(pair >> 21) + chr(pair & 0x1FFFFF), self.dims)
            at[i] = b
        return np.bincount(at, n, self.dims).astype(np.int64)

    def buckets(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The bucket of each pair of code points: by a table for those under DENSE, else a look a different pair."""
        near = (first < DENSE) & (second < DENSE)
        out = np.empty(len(first), np.int64)
        at = first[near] * DENSE + second[near]
        found = self.table[at]
        if len(new := np.unique(at[found < 0])):
            self.table[new] = [bucket(chr(p // DENSE) + chr(p % DENSE), self.dims) for p in new.tolist()]
            found = self.table[at]
        out[near] = found
        if not near.all():
            pairs, back = np.unique((first[~near] << 21) | second[~near], return_inverse=True)
            for p in pairs.tolist():
                if p not in self.known:
                    self.known[p] = bucket(chr(p >> 21) + chr(p & 0x1FFFFF), self.dims)
            out[~near] = np.array([self.known[p] for p in pairs.tolist()], np.int64)[back]
        return out

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        """The unit vectors of texts, a row each; all pairs of code points of CHARS characters are counted at once."""
        texts = [t or "" for t in texts]
        out, a = np.zeros((len(texts), self.dims)), 0
        while a < len(texts):
            b, size = a + 1, len(texts[a])
            while b < len(texts) and size + len(texts[b]) <= CHARS:
                size += len(texts[b])
                b += 1
            code = np.frombuffer("".join(texts[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            row = np.repeat(np.arange(b - a), [len(t) for t in texts[a:b]])
            inside = row[:-1] == row[1:]
            at = row[:-1][inside] * self.dims + self.buckets(code[:-1][inside], code[1:][inside])
            out[a:b] = np.bincount(at, minlength=(b - a) * self.dims).reshape(b - a, self.dims)
            a = b
        size = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return out / np.where(size > 0, size, 1.0)

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return self.matrix(texts).tolist()


def embed(provider: Provider | None = None):
    """A function from a text column to array<float>; calls the provider with at most BATCH texts, and again if it can't serve now."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = provider or Bigrams()
        for part in parts:
            if isinstance(call, Bigrams):
                yield pd.Series(list(call.matrix(list(part)).astype(np.float32)), dtype=object)
                continue
            texts, out = list(part), []
            for a in range(0, len(texts), BATCH):
                out += tried(lambda: call(texts[a : a + BATCH]))  # noqa: B023
            yield pd.Series(out, dtype=object)

    return run


def histogram(docs: DataFrame, text: Column, key: str = "doc_id", dims: int = DIMS) -> DataFrame:
    """(key, bucket, n): the bigram counts of each text, buckets without bigrams left out."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<struct<bucket:int,n:long>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams = Bigrams(dims)
        for part in parts:
            counts = [grams.counts(t) for t in part]
            yield pd.Series([[{"bucket": int(b), "n": int(c[b])} for b in np.flatnonzero(c)] for c in counts], dtype=object)

    return docs.select(key, F.explode(run(text)).alias("x")).select(key, "x.bucket", "x.n")
