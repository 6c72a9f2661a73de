"""Sharding by histogram sort.

Rows are ordered by a 124-bit key (62 bits from the hash of the text, 62 from
the hash of the id), so that equal texts lie side by side.  Splitters are found
without sorting: each round counts exact bytes below evenly spaced probe keys
inside the intervals that still hold a wanted splitter, and keeps the probe
interval around each target, until a probe lies within the tolerance.  Then
every row knows its shard, and rows move once.

Only ``2**STEP`` counts a target reach the driver in a round, whatever the
input.  A text that owns a large share of all rows is one value of the first
half of the key; the search then goes on in the second half, so its copies are
cut at exact byte positions like all others.  Equal texts otherwise stay in one
shard, because a splitter within the tolerance lies between two texts.

In the exchange a shard falls into cells of about ``CELL_BYTES``: ranges of the first
half of the key, and where one of them is much larger (a text with many copies),
ranges of the second half in it.  Slots number the cells' rows one cell after the
other, so no task holds a whole shard, however large the input.

Cases: a null text counts one byte (its size is 1) and has a null crc; empty
texts have size 1; a text of any length is one row of its size; rows with a null
id sort by the text and a fixed id hash; rows equal in both id and text have equal
keys and stay together; an empty table gives an empty result; input columns named
like the results are replaced, all others come through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from docloom.llm.names import col, fresh, rest
from docloom.session import Workspace, ship

BITS = 62
#: Bits of the key that one round resolves.
STEP = 10
#: Bytes of text of a cell in the exchange, about, and bits of the key that name the cells of the smallest input.
CELL_BYTES, LEAST_BITS = 64 << 20, 6


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def keys_of(text: Column, ident: Column) -> list[Column]:
    """The halves of the key (both in 0 .. 2**62-1), and the bytes of a row."""
    cut = lambda c: F.shiftrightunsigned(c, 64 - BITS)
    return [cut(F.xxhash64(text)), cut(F.xxhash64(F.lit("id"), ident.cast("string"))), text_bytes(text)]


def _below(rows: DataFrame, half: str, bits: int, intervals: list[tuple[int, int]]) -> dict:
    """Bytes of each of the probe intervals in ``intervals`` of (first half, low end), all 2**bits wide."""
    step = min(STEP, bits)
    if half == "_k2":
        rows = rows.where(F.col("_k1").isin(sorted({k for k, _ in intervals})))
    if bits < BITS:
        rows = rows.where(F.shiftrightunsigned(half, bits).isin(sorted({lo >> bits for _, lo in intervals})))
    first = F.col("_k1") if half == "_k2" else F.lit(-1).cast("long")
    found: dict = {}
    for r in rows.groupBy(first.alias("k"), F.shiftrightunsigned(half, bits - step).alias("p")).agg(F.sum("_w").alias("b")).collect():
        found.setdefault((r["k"], (r["p"] >> step) << bits), []).append((r["p"] << (bits - step), r["b"]))
    return {k: sorted(v) for k, v in found.items()}


def splitters(keys: DataFrame, parts: int, slack: float) -> list[tuple[int, int]]:
    """Ascending boundaries (k1, k2): a row is in part i if i boundaries are at or below its key.

    keys: _k1, _k2 and _w.  The bytes below each boundary are within ``slack`` of
    its share of the total, or the boundary is exact to one key.
    """
    total = keys.agg(F.sum("_w")).first()[0] or 0
    open_ = [{"aim": total * i / parts, "k": -1, "lo": 0, "bits": BITS, "below": 0} for i in range(1, parts)]
    done: list[tuple[int, int]] = []
    while open_:
        later = []
        for half, bits in {("_k1" if t["k"] < 0 else "_k2", t["bits"]) for t in open_}:
            own = [t for t in open_ if t["bits"] == bits and (t["k"] < 0) == (half == "_k1")]
            counts = _below(keys, half, bits, [(t["k"], t["lo"]) for t in own])
            width = 1 << (bits - min(STEP, bits))
            for t in own:
                below = t["below"]
                at, weight = t["lo"], 0
                for at, weight in counts.get((t["k"], t["lo"]), []):
                    if below + weight >= t["aim"]:
                        break
                    below += weight
                under, over = t["aim"] - below, below + weight - t["aim"]
                edge = at if under <= over else at + width
                if min(under, over) <= slack or width == 1 and half == "_k2":
                    done.append((edge, 0) if half == "_k1" else (t["k"], edge))
                elif width > 1:
                    later.append(t | {"lo": at, "bits": bits - STEP, "below": below})
                else:
                    later.append(t | {"k": at, "lo": 0, "bits": BITS, "below": below})
        open_ = later
    return sorted(done)


def _part_of(bounds: list[tuple[int, int]]):
    firsts, seconds = (np.array([b[i] for b in bounds], dtype=np.int64) for i in (0, 1))

    @F.pandas_udf(T.IntegerType())
    def part(k1: pd.Series, k2: pd.Series) -> pd.Series:
        a, b = k1.to_numpy(np.int64), k2.to_numpy(np.int64)
        low, high = np.searchsorted(firsts, a, "left"), np.searchsorted(firsts, a, "right")
        for at in np.unique(low[high > low]):
            own = (low == at) & (high > at)
            low[own] += np.searchsorted(seconds[at : high[own][0]], b[own], "right")
        return pd.Series(low.astype(np.int32))

    return part


def _sub(rows: DataFrame, large: DataFrame, names: list[str]) -> DataFrame:
    """rows with the last two of the names (shard, k1, k2, bucket, sub): the cell of each row in its shard."""
    shard, k1, k2, bucket, sub = names
    large = large.select(F.col("shard").alias(shard), F.col("bucket").alias(bucket), F.col("cut").alias(sub))
    # At most one bucket to 4 * CELL_BYTES of the input is large: 24 bytes to 256 MB.
    rows = rows.join(F.broadcast(large), [shard, bucket], "left")
    return rows.withColumn(sub, F.coalesce(F.expr(f"shiftrightunsigned(`{k2}`, {BITS} - `{sub}`)"), F.lit(0).cast("long")))


def shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.005, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Adds shard (0 .. shards-1), slot (gapless from 0 in each shard) and size (bytes + 1).

    Shards hold near equal bytes: each boundary is off by at most ``tolerance`` of
    a shard, or by one row where a row is larger.
    """
    spark = docs.sparkSession
    ship(spark)
    keys_ = keys_of(col(text), col(ident))
    cell = ["shard", "k1", "k2", "bucket", "sub"]
    with Workspace(spark, "shard") as work:
        keys = work.save(docs.select(*[k.alias(n) for k, n in zip(keys_, ("_k1", "_k2", "_w"))]), "keys")
        total = keys.agg(F.sum("_w")).first()[0] or 0
        told = _part_of(splitters(keys, shards, tolerance * total / shards))
        # A key that can't be null gets no filter, which would tell the parts a second time below it.
        part = lambda k1, k2: F.coalesce(told(k1, k2), F.lit(0))
        bits = min(BITS, max(LEAST_BITS, (total // CELL_BYTES).bit_length()))
        bucket = lambda k1: F.shiftrightunsigned(k1, BITS - bits)
        light = keys.select(part("_k1", "_k2").alias("shard"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), bucket("_k1").alias("bucket"), "_w")
        large = light.groupBy("shard", "bucket").agg(F.sum("_w").alias("b")).where(F.col("b") > 4 * CELL_BYTES)
        large = work.save(large.select("shard", "bucket", F.ceil(F.log2(F.col("b") / CELL_BYTES)).cast("int").alias("cut")), "large", keep=True)
        before = W.partitionBy("shard").orderBy("bucket", "sub").rowsBetween(W.unboundedPreceding, -1)
        starts = _sub(light, large, cell).groupBy("shard", "bucket", "sub").agg(F.count("*").alias("n"))
        starts = work.save(starts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "starts", keep=True)
    shard_, k1, k2, bucket_, sub, start, size = fresh(docs, "_shard", "_k1", "_k2", "_bucket", "_sub", "_start", "_size")
    rows = docs.withColumns(dict(zip((k1, k2, size), keys_))).withColumn(shard_, part(k1, k2)).withColumn(bucket_, bucket(k1))
    rows = _sub(rows, large, [shard_, k1, k2, bucket_, sub])
    starts = starts.select(*[F.col(a).alias(b) for a, b in zip(("shard", "bucket", "sub", "start"), (shard_, bucket_, sub, start))])
    # One exchange: the join and the numbering deal rows by the same cells.
    rows = rows.join(starts, [shard_, bucket_, sub])
    order = W.partitionBy(shard_, bucket_, sub).orderBy(k1, k2)
    rows = rows.withColumn(k1, F.col(start) + F.row_number().over(order) - 1)
    return rows.select(*map(col, rest(docs, "shard", "slot", "size")), F.col(shard_).alias("shard"), F.col(k1).alias("slot"), F.col(size).alias("size"))
