"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins.  Training goes round the features again
and again: a shallow tree over one feature's bins is fitted to the gradient of
the log loss, and a small part of it is added to that feature's lookup table.
Then the pairs of features whose residuals split best get tables of their own in
the same way.  A score is the sum of a bin of every table, through a logistic.

Fitting takes a bounded sample (``most`` labelled rows, those of least hash of
the id), whose features go to the driver; all else covers every row and the
whole of its text.  The model is a few kilobytes.

Cases: null texts count as empty; texts without words have all word features 0;
labels with a null id or value are left out, and of several for one id the least
holds; no labels give the score 0.5; repeated rows are scored alike; texts of any
length are read whole; an empty table gives an empty result; an input column named
like the score is replaced, all others come through, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docloom.llm.names import col, fresh, rest
from docloom.session import ship

#: Labelled rows that training takes at most.
MOST = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 32, 8, 150, 60, 10, 0.1
THRESHOLD = 0.3
NAMES = (
    "chars words word_length upper lower digits spaces newlines stops commas exclaims questions pipes symbols other entropy "
    "top_byte distinct top_word repeats short long lines distinct_lines line_words ends"
).split()
_SETS = [
    np.frombuffer(x, np.uint8)
    for x in (bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b" \t", b"\n", b".", b",", b"!", b"?", b"|", b"#$%&*+/<=>@\\^_`~{}[]")
]


def features(text: str | None) -> np.ndarray:
    out = np.zeros(len(NAMES), np.float32)
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / len(raw)
    words = raw.split()
    out[:2] = np.log1p(len(text)), np.log1p(len(words))
    out[3:14] = [share[s].sum() for s in _SETS]
    out[14] = share[128:].sum()
    some = share[share > 0]
    out[15], out[16] = -(some * np.log2(some)).sum(), share.max()
    if words:
        seen = Counter(words)
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        out[2] = sizes.mean()
        out[17], out[18] = len(seen) / n, max(seen.values()) / n
        out[19] = sum(map(bytes.__eq__, words, words[1:])) / n
        out[20], out[21] = (sizes <= 3).mean(), (sizes >= 12).mean()
        lines = [x for x in raw.split(b"\n") if x]
        out[22], out[23] = np.log1p(len(lines)), len(set(lines)) / len(lines)
        out[24] = np.log1p(n / len(lines))
        out[25] = sum(x[-1:] in b".!?:;\"')" for x in lines) / len(lines)
    return out


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """Value of each of the ordered bins by a tree with so many leaves, from sums of gradients and hessians."""
    G, H = np.cumsum(g), np.cumsum(h)
    edges = [0, len(g)]
    span = lambda a, b: (G[b - 1] - (G[a - 1] if a else 0), H[b - 1] - (H[a - 1] if a else 0))
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(edges, edges[1:]):
            if b - a < 2:
                continue
            gt, ht = span(a, b)
            gl = G[a : b - 1] - (G[a - 1] if a else 0)
            hl = H[a : b - 1] - (H[a - 1] if a else 0)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], a + at + 1)
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        gt, ht = span(a, b)
        out[a:b] = gt / (ht + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four by one edge on each axis: its gain, and the value of each cell."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    score = lambda a, b: a**2 / (b + ridge)
    a, b = G[:-1, :-1], H[:-1, :-1]
    right, below, total = (G[:-1, -1:], H[:-1, -1:]), (G[-1:, :-1], H[-1:, :-1]), (G[-1, -1], H[-1, -1])
    parts = [(a, b), (right[0] - a, right[1] - b), (below[0] - a, below[1] - b), (total[0] - right[0] - below[0] + a, total[1] - right[1] - below[1] + b)]
    gain = sum(score(*p) for p in parts) - score(*total)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    out = np.empty_like(g)
    for (x, y), p in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), parts):
        out[x, y] = p[0][i, j] / (p[1][i, j] + ridge)
    return float(gain[i, j]), out


class Model:
    """Cut points, one table a feature, and one grid a chosen pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        quantile = lambda v, n: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1])) if len(v) else np.empty(0)
        self.cuts = [quantile(x[:, j], BINS) for j in range(x.shape[1])]
        self.coarse = [quantile(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if not 0 < y.sum() < len(y):
            return
        bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]
        total = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for table, b in zip(self.tables, bins):
                p = 1 / (1 + np.exp(-total))
                step = RATE * _tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)))
                table += step
                total += step[b]
        small = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.coarse)]
        size = [len(c) + 1 for c in self.coarse]
        grid = lambda i, j, w: np.bincount(small[i] * size[j] + small[j], w, size[i] * size[j]).reshape(size[i], size[j])
        p = 1 / (1 + np.exp(-total))
        able = [j for j in range(x.shape[1]) if size[j] > 1]
        gains = [(_quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)))[0], i, j) for i in able for j in able if i < j]
        self.pairs = [(i, j, np.zeros((size[i], size[j]))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for i, j, cells in self.pairs:
                p = 1 / (1 + np.exp(-total))
                step = RATE * _quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)))[1]
                cells += step
                total += step[small[i], small[j]]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (c, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(c, x[:, j], "right")]
        for i, j, cells in self.pairs:
            total += cells[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if len(texts) else np.empty((0, len(NAMES)), np.float32)


def held_out(ident: Column, of: int = 5, remainder: int = 0) -> Column:
    """Whether the CRC-32 of the id's text has this remainder; false for a null id."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % of == remainder, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST, text: str = "text", ident: str = "doc_id") -> Model:
    """Learns from at most ``most`` labelled rows whose id is not held out."""
    ship(docs.sparkSession)
    chosen = (
        labels.where(F.col(ident).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(ident)))
        .groupBy(ident)
        .agg(F.min(label).alias("_y"))
        .orderBy(F.xxhash64(ident), ident)
        .limit(most)
    )

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"i": batch["i"], "y": batch["_y"].astype(float), "x": list(_matrix(batch["t"]))})

    kind = docs.schema[ident].dataType.simpleString()
    found = docs.select(F.col(ident).alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen.withColumnRenamed(ident, "i")), "i")
    found = found.mapInPandas(rows, f"i {kind}, y double, x array<float>").groupBy("i").agg(F.first("y").alias("y"), F.min("x").alias("x")).orderBy("i").collect()
    x = np.array([r["x"] for r in found], np.float32).reshape(len(found), len(NAMES))
    return Model(x, np.array([r["y"] for r in found]))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with score (0 to 1); a column of that name is replaced."""
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(known.value(_matrix(part)))

    return docs.select(*map(col, rest(docs, name)), scored(col(text)).alias(name))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that score at least ``threshold``; columns as in docs."""
    (name,) = fresh(docs, "_score")
    return score(docs, fit(docs, labels, **options), name=name).where(F.col(name) >= threshold).select(*map(col, docs.columns))
