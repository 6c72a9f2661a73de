"""Approximate nearest neighbours with a hash-prefix forest.

A tree gives every vector a string of symbols: each symbol is the nearest of the
2m signed axes after a random rotation (cross-polytope hashing), so that near
vectors share long prefixes.  The vectors are dealt by their hash into shards of
bounded size, and every shard holds a forest: the sorted arrays of its strings,
one a tree.  A query descends in every tree of every shard to its longest prefix
match; then the trees of a shard ascend in step, level by level, and a candidate
gains a point in every tree at every level where it is met, until ``wanted``
candidates are met, at the root if need be, where all are.  The ``wanted`` with most
points, all that have as many points as the last of them, and all that have nearly
all points (a tight cluster) are compared with the query exactly.

``wanted`` follows the size of a shard, and the number of shards the size of the
table, so more trees and candidates serve a larger table.  A shard is a sample of
the table: what it must find are at most its own nearest, so recall doesn't fall
as shards are added.  Equal vectors are one entry, with their smallest ids, so a
vector that owns a third of all rows costs no more than another.

Cases: vectors that are null, empty, zero, of another length than most, or hold a
null or non-finite component take no part, as queries or candidates; rows equal
in id and vector count once; with fewer than ``k`` candidates all are returned;
ties go to the smaller id; an empty table gives an empty result; other columns of the
input don't matter, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from docloom.session import Workspace, ship

TREES = 128
#: Share of all points from which strings don't tell candidates apart, so that all of them are compared.
ALIKE = 0.9
#: Coordinates of a rotation; bits of a hash string; vectors of a shard, and the least number of shards; queries a task takes.
AXES, STRING_BITS, SHARD, SHARDS, SLAB = 64, 28, 65_536, 8, 8192


def wanted_of(size: int) -> int:
    """Candidates that the trees of a shard of ``size`` vectors ascend to."""
    return math.ceil(16 * math.sqrt(size))


class Hashes:
    """Hash strings of vectors: for each tree ``symbols`` numbers below 2m, packed into one integer."""

    def __init__(self, dims: int, trees: int, mean: list[float], seed: int = 5):
        self.dims, self.trees, self.mean, self.seed = dims, trees, np.array(mean, np.float32), seed
        self.axes = min(dims, AXES)
        self.bits = max(1, int(np.ceil(np.log2(2 * self.axes))))
        self.symbols = STRING_BITS // self.bits if self.bits * 8 > STRING_BITS else 8

    def rotations(self, tree: int) -> np.ndarray:
        rng = np.random.default_rng((self.seed, tree))
        turn = [np.linalg.qr(rng.standard_normal((self.dims, self.axes)))[0] for _ in range(self.symbols)]
        return np.concatenate(turn, axis=1).astype(np.float32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Rows of ``trees`` codes."""
        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            turn = self.rotations(t)
            for a in range(0, len(x), 1024):
                part = x[a : a + 1024].astype(np.float32) - self.mean
                row, col = np.arange(len(part))[:, None], np.arange(self.symbols)[None]
                p = (part @ turn).reshape(len(part), self.symbols, self.axes)
                at = np.abs(p).argmax(2)
                symbol = 2 * at + (p[row, col, at] > 0)
                for s in range(self.symbols):
                    out[a : a + 1024, t] = (out[a : a + 1024, t] << self.bits) | symbol[:, s]
        return out


def usable(vector: Column) -> Column:
    """Whether a vector takes part: some non-zero component, and none null or non-finite."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


class Forest:
    """The trees of a shard: for each the places of its vectors in the order of their strings."""

    def __init__(self, codes: np.ndarray, bits: int, symbols: int):
        self.bits, self.symbols = bits, symbols
        self.order = np.argsort(codes, axis=0, kind="stable").T.astype(np.int32)
        self.codes = np.take_along_axis(codes.T, self.order, 1)

    def ranges(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends in every tree of what shares 1, 2 .. symbols with each query: level x tree x query."""
        out = np.empty((2, self.symbols, len(self.codes), len(asked)), np.int32)
        for level in range(self.symbols):
            shift = self.bits * (self.symbols - 1 - level)
            low = (asked >> shift) << shift
            for t, code in enumerate(self.codes):
                out[0, level, t] = np.searchsorted(code, low[:, t])
                out[1, level, t] = np.searchsorted(code, low[:, t] + (1 << shift))
        return out[0], out[1]

    def candidates(self, start: np.ndarray, end: np.ndarray, wanted: int) -> np.ndarray:
        """Places of the vectors to compare with one query, of its ranges: level x tree."""
        points, level = np.zeros(self.order.shape[1], np.int64), self.symbols
        sizes = (end - start).sum(1)
        while level and np.count_nonzero(points) < wanted:
            level -= 1
            while level and sizes[level] < wanted:  # so few entries can't be enough vectors
                level -= 1
            points[:] = 0
            for up in range(level, self.symbols):
                met = [self.order[t, start[up, t] : end[up, t]] for t in np.flatnonzero(end[up] > start[up])]
                points += np.bincount(np.concatenate(met), minlength=len(points)) if met else 0
        if np.count_nonzero(points) < wanted:  # the root
            return np.arange(len(points))
        at_least = np.cumsum(np.bincount(points)[::-1])[::-1]
        alike = int(ALIKE * len(self.codes) * (self.symbols - level))
        return np.flatnonzero(points >= min(max(alike, 1), np.flatnonzero(at_least >= wanted)[-1]))


def _nearest(k: int, hashes: Hashes, candidates: float | None):
    """Of every query the k nearest candidates in a shard; ``candidates`` is a share of the shard's vectors."""

    def run(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(shard):
            shard = shard.sort_values("first")
            cid, x = shard["cid"].to_numpy(np.int64), np.stack(list(shard["v"]))
            wanted = max(k, wanted_of(len(x)) if candidates is None else math.ceil(candidates * len(x)))
            forest = Forest(hashes(x), hashes.bits, hashes.symbols)
            start, end = forest.ranges(np.stack(list(asked["codes"])))
            for i, (q, v) in enumerate(zip(asked["q"], asked["qv"])):
                at = forest.candidates(start[:, :, i], end[:, :, i], wanted)
                d = np.sqrt(((x[at].astype(np.float64) - np.asarray(v, np.float64)) ** 2).sum(1))
                best = np.argsort(d, kind="stable")[:k]  # ties to the smaller id
                out.append(pd.DataFrame({"q": q, "cid": cid[at[best]], "d": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "cid": [], "d": []})

    return run


def search(vectors: DataFrame, queries: Column, k: int = 10, trees: int = TREES, candidates: int | None = None, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``queries`` holds, its own id apart.

    score is the Euclidean distance in double precision.  ``candidates`` is the number wanted of the whole table, in
    place of ``wanted_of`` each shard.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(ident).alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col(ident).isNotNull() & usable(F.col(vector)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return none
    dims = common["n"]
    with Workspace(spark, "ann") as work:
        rows = rows.where(F.size("v") == dims).withColumn("cid", F.xxhash64("v"))
        # The k + 1 smallest different ids of each vector; enough for k besides the query's own.
        few = rows.select("cid", "id", "v").dropDuplicates(["cid", "id"]).withColumn("n", F.row_number().over(W.partitionBy("cid").orderBy("id"))).where(F.col("n") <= k + 1)
        classes = few.groupBy("cid").agg(F.first("v").alias("v"), F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))
        classes = work.save(classes.withColumn("first", F.element_at("ids", 1).cast("long")), "classes", keep=True)
        asks = work.save(rows.where("asks").select("id", "cid").distinct(), "asks", keep=True)
        mean = classes.select(*[F.avg(F.element_at("v", i + 1)).alias(f"m{i}") for i in range(dims)]).first()
        total = classes.count()
        hashes = Hashes(dims, trees, [float(m) for m in mean])
        shards = max(SHARDS, -(-total // SHARD))

        def strings(batches):
            for batch in batches:
                if len(batch):
                    yield pd.DataFrame({"q": batch["cid"], "qv": batch["v"], "codes": list(hashes(np.stack(list(batch["v"]))))})

        asked = classes.join(asks.select("cid").distinct(), "cid", "left_semi").select("cid", "v")
        kind = classes.schema["v"].dataType.simpleString()
        asked = work.save(asked.mapInPandas(strings, f"q long, qv {kind}, codes array<long>"), "asked")
        slabs = max(1, -(-asked.count() // SLAB))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        deal = lambda c, n: F.pmod(F.col(c), F.lit(n)).cast("int")
        asked = asked.withColumn("slab", deal("q", slabs)).withColumn("shard", each(shards))
        forest = classes.select("cid", "v", "first", deal("cid", shards).alias("shard"), each(slabs).alias("slab"))
        share = None if candidates is None else candidates / total
        near = asked.groupBy("shard", "slab").cogroup(forest.groupBy("shard", "slab")).applyInPandas(_nearest(k + 1, hashes, share), "q long, cid long, d double")
        near = work.save(near, "near", keep=True)
        firsts = W.partitionBy("q").orderBy("d", "first")
        near = near.join(classes.select("cid", "ids", "first"), "cid").withColumn("n", F.row_number().over(firsts)).where(F.col("n") <= k + 1)
    each = near.select("q", "d", F.explode("ids").alias("vec_id")).join(asks.select(F.col("id").alias("query_id"), F.col("cid").alias("q")), "q")
    order = W.partitionBy("query_id").orderBy("d", "vec_id")
    ranked = each.where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("d").alias("score"))
