"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source size copies.  The documents
of a source stand in a fixed order (by size, so that the copies follow the sizes
closely); their expected copies are summed from the left, one offset is drawn
for the source, and a document is emitted once for each integer boundary that
the running sum crosses.  As all documents of a source expect the same number,
the running sum at the i-th is i times it, and i comes from exact counts: rows
are numbered inside small cells (source, size class, hash cell), and cells are
numbered by sums over their counts.  No task gets a whole source.

Cases: a null text has size 0; documents of size 0 are dealt copies like others
and take no words; a null source is a source, after all others; rows equal in id
and text are numbered one after the other, and rows that tie in all of the order
are alike to it; a text of any length is counted whole; an empty table gives an
empty result.  Columns of the input named like the results are replaced, all others
come through, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from docloom.llm.names import col, fresh, rest
from docloom.session import Workspace, ship

WEIGHTS = (5, 2, 1)
#: Rows that a cell has about.
CELL_ROWS = 20_000
LEAST_CELLS, MOST_CELLS = 16, 1 << 16
#: Size classes to a doubling of the size.
CLASSES = 8


def _words(text: pd.Series) -> pd.Series:
    return text.map(lambda t: len(t.encode("utf-8", "surrogatepass").split()) if t else 0).astype("int64")  # bytes split at just these


def words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    return F.pandas_udf(_words, "long")(text)


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target words of each source: shares of ``share`` times all words by weight, none above ``most`` times its own."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), list(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free = [s for s in free if s not in full]
    return out


def mix_plan(docs: DataFrame, seed: int = 17, text: str = "text", source: str = "source", ident: str = "doc_id", **rule) -> DataFrame:
    """All documents, with size, source_size and target (of the source), copies, and taken = copies * size.

    One row a source (name, words) goes to the driver, where the targets are set;
    ``rule`` goes to :func:`targets`.
    """
    spark = docs.sparkSession
    ship(spark)
    size = words(col(text))
    h = F.xxhash64(F.lit(seed), col(ident).cast("string"), col(text))
    of = F.coalesce(F.concat(F.lit("="), col(source)), F.lit("null"))
    # Keys that can't be null get no filter, which would count the words a second time below it.
    class_ = lambda n: F.coalesce(F.when(F.col(n) >= 1, F.floor(F.log2(n) * CLASSES)).cast("int"), F.lit(-1))
    cell_ = lambda n, count: F.coalesce(F.pmod(n, F.lit(count)).cast("int"), F.lit(0))
    with Workspace(spark, "mix") as work:
        light = work.save(docs.select(of.alias("s"), h.alias("h"), size.alias("size")).withColumn("class", class_("size")), "light")
        fine = light.groupBy("s", "class", F.pmod("h", F.lit(LEAST_CELLS)).alias("c")).agg(F.count("*").alias("n"), F.sum("size").alias("w"))
        per_source = fine.groupBy("s").agg(F.sum("w").alias("w"), F.max("n").alias("most")).collect()
        sizes = {None if r["s"] == "null" else r["s"][1:]: r["w"] for r in per_source}
        largest = max((r["most"] for r in per_source), default=1)
        cells = LEAST_CELLS * min(MOST_CELLS // LEAST_CELLS, max(1, 2 ** math.ceil(math.log2(largest / CELL_ROWS)) if largest > CELL_ROWS else 1))
        aims = targets(sizes, **rule)
        consts = []
        for name, all_ in sizes.items():
            rate = aims[name] / all_ if all_ else 0.0
            key = "null" if name is None else f"={name}"
            offset = (zlib.crc32(f"{seed} {key}".encode()) + 0.5) / 2**32
            consts.append((key, all_, float(aims[name]), int(rate), rate - int(rate), offset))
        known = spark.createDataFrame(consts, "s string, source_size long, target double, whole int, part double, offset double")
        before = W.partitionBy("s").orderBy("class", "cell").rowsBetween(W.unboundedPreceding, -1)
        starts = light.groupBy("s", "class", cell_("h", cells).alias("cell")).agg(F.count("*").alias("n"))
        starts = starts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).join(known, "s").drop("n")
        starts = work.save(starts, "starts", keep=True)
    own = dict(zip(("s", "class", "cell", "source_size", "target", "whole", "part", "offset", "start", "h", "i", "size"), fresh(docs, *"_s _class _cell _all _aim _whole _part _offset _start _h _i _size".split())))
    at = lambda name: F.col(own[name])
    rows = docs.withColumns({own["size"]: size, own["h"]: h, own["s"]: of})
    rows = rows.withColumns({own["class"]: class_(own["size"]), own["cell"]: cell_(at("h"), cells)})
    inside = W.partitionBy(at("s"), at("class"), at("cell")).orderBy(at("size"), at("h"), col(ident))
    crossed = lambda i: F.floor(at("offset") + at("part") * i)
    # Cells grow with the table, so they are never broadcast; the windows need this exchange of the rows anyway.
    cells_of = starts.select(*[F.col(c).alias(own[c]) for c in starts.columns]).hint("shuffle_hash")
    rows = rows.join(cells_of, [own["s"], own["class"], own["cell"]])
    rows = rows.withColumn(own["i"], at("start") + F.row_number().over(inside))
    copies = (at("whole") + crossed(at("i")) - crossed(at("i") - 1)).cast("int")
    results = [at("size").alias("size"), at("source_size").alias("source_size"), at("target").alias("target"), copies.alias("copies"), (copies * at("size")).alias("taken")]
    return rows.select(*map(col, rest(docs, "size", "source_size", "target", "copies", "taken")), *results)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document as often as the mix takes it, with the columns of the input."""
    results = [c for c in docs.columns if c not in rest(docs, "size", "source_size", "target", "copies", "taken")]
    aside = dict(zip(results, fresh(docs, *[f"_{c}" for c in results])))
    plan = mix_plan(docs.withColumnsRenamed(aside), **options).where("copies > 0")
    (copy,) = fresh(plan, "_copy")
    plan = plan.withColumn(copy, F.explode(F.sequence(F.lit(1), "copies")))
    return plan.select(*[col(aside.get(c, c)).alias(c) for c in docs.columns])
