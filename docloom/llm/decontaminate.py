"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage of a document by k =
floor(rate * m) edits.  Cut into k + 1 pieces, at least one piece must then occur
unchanged.  One automaton finds all pieces of a block of items in one pass over a
text; around each hit Myers' bit-parallel algorithm finds the least edit distance
of the item to any substring.  An item shorter than ``SHORT`` has no budget and must
stand between word edges, as such strings turn up inside other words.  Items come in
blocks of bounded size, so the
automaton a worker holds is bounded whatever the size of the benchmark, and the
corpus is read once a block.

Both sides are lower-cased, and white space runs become one space; positions
count characters of that form.

Cases: null and empty texts and items match nothing; texts and items may have any
length; of places of equal distance the first is told; repeated documents and items
each give their own rows; empty tables give an empty result; other columns of the
inputs don't matter, whatever their names, and :func:`clean` returns those of docs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docloom.llm.names import col, fresh
from docloom.session import Workspace, ship

#: Edits allowed to a character of an item; the shortest item with edits; characters of the items of a block.
RATE, SHORT, BLOCK = 0.08, 16, 4_000_000
#: Documents with items that may be sent to all tasks; more are joined by a shuffle.
FEW = 200_000


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 adjacent pieces of near equal length, with their offsets."""
    edges = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


class Pattern:
    """Myers' algorithm for one pattern; any length, as Python's integers have no word size."""

    def __init__(self, text: str):
        self.m, self.peq = len(text), defaultdict(int)
        for i, c in enumerate(text):
            self.peq[c] |= 1 << i

    def best(self, text: str, anchored: bool = False) -> tuple[int, int]:
        """Least edit distance to a substring of text, and its earliest end; anchored: substrings that begin the text."""
        m = self.m
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score = full, 0, m
        low, end = m, 0
        get = self.peq.get
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            if score < low:
                low, end = score, j
            ph = (ph << 1) & full | anchored
            mh = (mh << 1) & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
        return low, end


class Matcher:
    """All items of a block: (item_id, plain text)."""

    def __init__(self, items: list[tuple], rate: float):
        self.items, self.auto = [], ahocorasick.Automaton()
        found: dict[str, list] = defaultdict(list)
        for ident, text in items:
            k = int(rate * len(text)) if len(text) >= SHORT else 0
            self.items.append((ident, text, k, Pattern(text), Pattern(text[::-1])))
            for at, piece in pieces(text, k):
                found[piece].append((len(self.items) - 1, at))
        for piece, where in found.items():
            self.auto.add_word(piece, (len(piece), where))
        self.auto.make_automaton()

    def __call__(self, text: str) -> list[tuple]:
        """(item_id, distance, start, end) of each item in the text, at the place of least distance."""
        hits: dict[int, set] = defaultdict(set)
        for last, (size, where) in self.auto.iter(text):
            for i, at in where:
                hits[i].add(last + 1 - size - at)
        out = []
        for i, diagonals in hits.items():
            ident, item, k, forward, backward = self.items[i]
            if len(item) < SHORT:
                whole = [d for d in diagonals if not text[max(0, d - 1) : d].isalnum() and not text[d + len(item) : d + len(item) + 1].isalnum()]
                out += [(ident, 0, min(whole), min(whole) + len(item))] if whole else []
                continue
            best = None
            spans: list[list[int]] = []
            for d in sorted(diagonals):  # where the item would start; windows that overlap become one
                low, high = max(0, d - k), min(len(text), d + len(item) + k)
                if spans and low <= spans[-1][1] and d - spans[-1][2] <= k:
                    spans[-1][1:] = high, d
                else:
                    spans.append([low, high, d])
            for low, high, _ in spans:
                distance, end = forward.best(text[low:high])
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, low + end, low)
            if best:
                distance, end, low = best
                _, size = backward.best(text[low:end][::-1], anchored=True)
                out.append((ident, distance, end - size, end))
        return out


def _blocks(items: DataFrame, ident: str, text: str, block: int) -> Iterator[list[tuple]]:
    """Items in blocks of about ``block`` characters; one block at a time is on the driver."""
    usable = items.select(col(ident).alias("i"), col(text).alias("t")).where(F.length("t") > 0)
    total = usable.agg(F.sum(F.length("t"))).first()[0] or 0
    n = int(total // block) + 1
    for b in range(n):
        rows = usable.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).toLocalIterator()
        yield [x for x in sorted(((r["i"], plain(r["t"])) for r in rows), key=str) if x[1]]


def _found(docs: DataFrame, items: DataFrame, rate: float, block: int, text: str, ident: str, item: str, item_text: str) -> DataFrame:
    """(id, key, item, distance, start, stop), where key is a hash of the document's id and text."""
    spark = docs.sparkSession
    ship(spark)
    kind = lambda name, df, c: T.StructField(name, df.schema[c].dataType)
    shape = T.StructType(
        [kind("id", docs, ident), T.StructField("key", T.LongType()), kind("item", items, item), *(T.StructField(c, T.IntegerType()) for c in ("distance", "start", "stop"))]
    )
    rows = docs.select(col(ident).alias("_id"), _key(text, ident).alias("_key"), col(text).alias("_text")).where("_text is not null")
    found = spark.createDataFrame([], shape)
    for part in _blocks(items, item, item_text, block):
        if part:
            found = found.unionByName(rows.mapInPandas(_search(spark.sparkContext.broadcast(part), rate, shape.names), shape))
    return found


def _key(text: str, ident: str) -> Column:
    return F.xxhash64(col(ident).cast("string"), col(text))


def _search(items, rate: float, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(items.value, rate)
        for batch in batches:
            rows = [(i, key, *hit) for i, key, t in zip(batch["_id"], batch["_key"], batch["_text"]) for hit in matcher(plain(t))]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return run


def find(docs: DataFrame, items: DataFrame, rate: float = RATE, block: int = BLOCK, text: str = "text", ident: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, stop): every document and item that it holds within the error budget."""
    found = _found(docs, items, rate, block, text, ident, item, item_text)
    return found.select(F.col("id").alias(ident), F.col("item").alias(item), "distance", "start", "stop")


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, block: int = BLOCK, text: str = "text", ident: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item; columns as in docs.  Rows are told apart by id and text, so each text is judged for itself."""
    key, gone_id, gone_key = fresh(docs, "_key", "_gone_id", "_gone_key")
    with Workspace(docs.sparkSession, "leaks") as work:
        gone = work.save(_found(docs, items, rate, block, text, ident, item, item_text).select("id", "key").distinct(), "gone", keep=True)
    few = gone.limit(FEW + 1).count() <= FEW
    gone = gone.select(F.col("id").alias(gone_id), F.col("key").alias(gone_key)).hint("broadcast" if few else "merge")
    rows = docs.withColumn(key, _key(text, ident))
    return rows.join(gone, (F.col(key) == F.col(gone_key)) & col(ident).eqNullSafe(F.col(gone_id)), "left_anti").select(*map(col, docs.columns))
