"""Language identification by error-correcting output codes.

Every language gets a codeword of bits.  For each bit a binary linear classifier
over character n-grams of words (1 to 3 letters, spaces count as word edges)
tells the languages with the bit from those without.  A text gets a margin for
each bit; the codeword of least loss wins, where a bit's loss is weighted by how
well that bit was told apart in training.  Texts whose best two codewords lie
close together are flagged as ambiguous.

N-grams are hashed to ``DIMS`` places, counted over whole texts, and taken as
square roots of shares.  Training takes at most ``MOST`` labelled texts, an equal
number of each language as far as there are, those of least hash of id and text; of
more than ``MOST`` languages, those of most texts.

Cases: a null text or one without letters is ``und`` with score 0; null languages
teach nothing; without any known language all texts are ``und``; with one known
language every text with letters is that; texts of any length are counted whole; repeated rows
are alike; an empty table gives an empty result; input columns named like the results
are replaced, all others come through, whatever their names.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from docloom.llm.names import col, fresh, rest
from docloom.session import ARRAY_MEMORY, ship

DIMS, MOST, RIDGE, CLOSE = 4096, 2400, 0.3, 0.6
#: Characters that are counted at once; longer texts are counted in such pieces.
PIECE = 500_000
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point to code point: lower-cased letters and marks stay, all else is a space."""
    if not _FOLD:
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if unicodedata.category(ch)[0] in "LM":
                low = ch.lower()
                table[c] = ord(low[0])
        _FOLD.append(table)
    return _FOLD[0]


def counts(texts: list[str | None]) -> np.ndarray:
    """Hashed n-gram counts of each text; rows of texts without letters are 0."""
    out = np.zeros((len(texts), DIMS), np.float32)
    # (row, text with a character of context on either side, characters of context before)
    pieces = [(i, t[max(0, a - 1) : a + PIECE + 1], min(a, 1)) for i, t in enumerate(texts) if t for a in range(0, len(t), PIECE)]
    at = 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + len(pieces[end][1]) < PIECE):
            size += len(pieces[end][1])
            end += 1
        own = pieces[at:end]
        at = end
        codes = _fold()[np.frombuffer((" " + "".join(f"{t}  " for _, t, _ in own)).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        starts = np.cumsum([1] + [len(t) + 2 for _, t, _ in own])[:-1]
        letter = codes != 32
        row = np.concatenate([[0], np.repeat(np.array([i for i, _, _ in own]) - own[0][0], [len(t) + 2 for _, t, _ in own])])
        for start, (_, t, before) in zip(starts, own):  # what is context here is counted in its own piece
            if before:
                letter[start] = False
            if len(t) > PIECE + before:
                letter[start + PIECE + before :][: len(t) - PIECE - before] = False
        c = np.flatnonzero(letter)
        here, last, next_ = codes[c], codes[c - 1], codes[np.minimum(c + 1, len(codes) - 1)]
        step, rows = np.uint64(0x1F1F3), int(row[-1]) + 1
        total = np.zeros(rows * DIMS)
        edge = last == 32
        for gram, of in (
            (here, row[c]),
            (here * step + next_ + np.uint64(1 << 40), row[c]),
            (np.uint64(32) * step + here[edge] + np.uint64(1 << 40), row[c][edge]),
            ((last * step + here) * step + next_ + np.uint64(1 << 50), row[c]),
        ):
            place = (gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int64)
            total += np.bincount(of * DIMS + place, minlength=rows * DIMS)
        out[own[0][0] : own[0][0] + rows] += total.reshape(rows, DIMS).astype(np.float32)
    return out


def _shares(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    x = counts(texts)
    total = x.sum(1)
    return np.sqrt(x / np.maximum(total, 1)[:, None]), np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1: all distinct splits for up to 5 languages, else random ones far apart."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        bits = [[1 if (s >> i) & 1 else -1 for i in range(n)] for s in range(1, 2 ** (n - 1))]
        return np.array(bits).T.reshape(n, -1)
    width, rng = int(np.ceil(10 * np.log2(n))), np.random.default_rng(7)
    best, far = None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], (n, width))
        gap = (code @ code.T - 2 * width * np.eye(n)).max()
        if best is None or -gap > far:
            best, far = code, -gap
    return best


class Model:
    def __init__(self, names: list[str], x: np.ndarray, y: np.ndarray):
        """y: for each row of x the place of its language in names."""
        self.names, self.code = names, codewords(len(names))
        target = self.code[y] if len(names) else np.empty((0, 0))
        # Languages weigh alike, however many texts they have.
        weight = np.sqrt(1 / np.maximum(np.bincount(y, minlength=max(1, len(names))), 1)[y])[:, None] * np.sqrt(len(y) / max(1, len(names)))
        mean = x.mean(0) if len(x) else np.zeros(DIMS, np.float32)
        xc = (x - mean) * weight
        alpha = np.linalg.solve(xc @ xc.T + RIDGE * np.eye(len(x)), target * weight) if len(x) else np.empty((0, self.code.shape[1] if len(names) else 0))
        self.w, self.mean = (xc.T @ alpha).astype(np.float32), mean.astype(np.float32)
        margin = (x - self.mean) @ self.w if len(x) else alpha
        right = (np.sign(margin) == target).mean(0) if len(x) else np.empty(0)
        self.trust = np.maximum(right - 0.5, 0.01)
        self.trust = self.trust / self.trust.sum() if len(self.trust) else self.trust

    def __call__(self, texts: list[str | None]) -> pd.DataFrame:
        x, some = _shares(texts)
        if not self.names:
            some = np.zeros(len(texts), bool)
        if not self.names or not self.code.shape[1]:
            best = np.zeros(len(texts), int)
            return pd.DataFrame({"lang_pred": np.where(some, self.names[0] if self.names else "und", "und"), "score": some * 1.0, "ambiguous": ~some})
        margin = np.clip((x - self.mean) @ self.w, -1.5, 1.5)
        # Hinge-like squared loss of each bit against each codeword.
        loss = (np.maximum(0, 1 - margin[:, None, :] * self.code[None]) ** 2 * self.trust).sum(2)
        order = np.sort(loss, 1)
        p = np.exp(-4 * (loss - order[:, :1]))
        score = 1 / p.sum(1)
        return pd.DataFrame(
            {"lang_pred": np.where(some, np.array(self.names, object)[loss.argmin(1)], "und"), "score": np.where(some, score, 0.0), "ambiguous": ~some | (score < CLOSE)}
        )


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, most: int = MOST, text: str = "text", lang: str = "lang", ident: str = "doc_id") -> Model:
    """Learns from at most ``most`` texts with a language, none held out."""
    spark = docs.sparkSession
    ship(spark, ARRAY_MEMORY)
    able = docs.select(col(ident).alias("i"), col(lang).alias("l"), col(text).alias("t")).where(F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("i")))
    able = able.withColumn("h", F.xxhash64("i", "t"))
    found = {r["l"]: r["n"] for r in able.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(most).collect()}
    each = max(1, most // max(1, len(found)))
    # Hashes are even, so the least of a language's n lie below a bound; only such rows are ranked, however many rows it has.
    below = spark.createDataFrame([(l, min(2**63 - 1, -(2**63) + 2**64 * (4 * each + 200) // n)) for l, n in found.items()], "l string, bound long")
    light = able.select("i", "l", "h").join(F.broadcast(below), "l").where(F.col("h") <= F.col("bound"))  # at most ``most`` languages
    nth = F.row_number().over(W.partitionBy("l").orderBy("h", "i"))
    chosen = light.withColumn("n", nth).where(F.col("n") <= each).select("l", "h").distinct()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, some = _shares(list(batch["t"]))
            yield pd.DataFrame({"h": batch["h"], "l": batch["l"], "x": [v.astype(np.float16).tobytes() for v in x]})[some]

    texts = able.select("h", "l", "t").join(F.broadcast(chosen), ["l", "h"])  # at most ``most`` hashes
    got = texts.mapInPandas(rows, "h long, l string, x binary").dropDuplicates(["h", "l"]).orderBy("h", "l").collect()
    names = sorted({r["l"] for r in got})
    x = np.array([np.frombuffer(r["x"], np.float16) for r in got], np.float32).reshape(len(got), DIMS)
    return Model(names, x, np.array([names.index(r["l"]) for r in got], int))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous; columns of these names are replaced."""
    ship(docs.sparkSession, ARRAY_MEMORY)
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = list(part)
            yield pd.concat([known.value(texts[a : a + 256]) for a in range(0, max(1, len(texts)), 256)], ignore_index=True)

    names, (pair,) = rest(docs, "lang_pred", "score", "ambiguous"), fresh(docs, "_told")
    rows = docs.select(*map(col, names), told(col(text)).alias(pair))
    return rows.select(*map(col, names), *[F.col(pair)[c].alias(c) for c in ("lang_pred", "score", "ambiguous")])
