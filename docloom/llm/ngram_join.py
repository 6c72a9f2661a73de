"""Exact Jaccard join over word n-grams by vertical partitioning.

All n-grams stand in one global order: by the count of their hash bucket over all
documents, then by hash.  The order is cut into fragments of equal mass; a
document's set falls into one segment a fragment; overlaps are counted segment by
segment and summed per pair.  Steps:

1. Bucket counts over all documents (a table of fixed size) give the order.
2. Equal sets become one class: its members link to each other without pairs.
3. Candidate pairs share an n-gram in both prefixes (the rarest part of a set,
   which two linked sets must share), have sizes that allow a link, and can still
   reach the wanted overlap from the positions of the shared n-gram.
4. In a first round each n-gram's list is paired only with its hub, the class
   that has it earliest in its order (an unedited original has no rare n-grams of
   its own, so it is the hub of its copies).  In the second round all pairs of a
   list are compared whose classes are not yet in one component.
5. Components are found by contraction.  Every link lies inside a component, so
   the links of all classes are counted there: a component's classes are dealt to
   blocks of bounded size, and a task takes two blocks, adds the overlaps of their
   pairs up fragment by fragment in a matrix, and gives each class the number of
   documents that it links with.  No pair leaves the task, and none is left out.

The list of a common n-gram is dealt to tasks by blocks too: its rows meet their
hub by broadcast (of lists longer than a share of all rows, so few by count), and
its pairs are compared block by block.

Sets are sets of 64-bit hashes.  The order, the fragments and the bloom filter
of candidates have fixed sizes and only steer the work; they never decide a link.

Cases: a null or empty text, or one of white space only, has the empty set and
is linked with nothing; a word may have any length; repeated rows are equal sets;
rows with equal ids and different texts each get the component of their own text;
rows with a null id take part, and have a null component if no other id is
reachable; an empty table gives an empty result; other columns of the input don't
matter to the join, whatever their names, and :func:`keep_first` returns them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, Window as W

from docloom.llm.graph import components
from docloom.llm.names import col, fresh
from docloom.session import Workspace, ship

#: Bits of an n-gram's hash that name its bucket in the order; 4 bytes a bucket.
ORDER_BITS = 20
FRAGMENTS = 4
#: Bits of the bloom filter of candidates: 16 a candidate, within these powers of two.
BLOOM_LEAST, BLOOM_MOST = 16, 28
#: Classes of a block, n-grams of a block, and lists that may be sent to all tasks.
BLOCK, BLOCK_GRAMS, LONG_LISTS = 512, 1 << 18, 50_000
#: Sets of an n-gram up to which its pairs are counted one by one; cells of a matrix.
RARE, MATRIX = 32, 1 << 22
_NONE = np.empty(0, np.int64)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


#: Bytes of a text that are hashed at once.
PIECE = 1 << 20
_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 5
_UP = np.cumprod(np.full(PIECE + 1, _BASE, np.uint64)) * np.uint64(pow(_BASE, -1, 1 << 64))
_DOWN = np.cumprod(np.full(PIECE + 1, pow(_BASE, -1, 1 << 64), np.uint64)) * np.uint64(_BASE)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word between ASCII white space, by differences of running sums over the bytes.

    A word over the edge of a piece is put together from its parts, so its hash is that of any other of its bytes.
    """
    data, out, held = np.frombuffer(raw, np.uint8), [], None
    for a in range(0, len(data), PIECE):
        part = data[a : a + PIECE]
        edge = np.flatnonzero(np.diff(_SPACE[part], prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * _UP[: len(part)])])
        h, size = (run[end] - run[start]) * _DOWN[start], (end - start).astype(np.uint64)
        if held is not None:
            if len(start) and start[0] == 0:
                h[:1] = h[:1] * np.uint64(pow(_BASE, int(held[1]), 1 << 64)) + held[:1]
                size[:1] += held[1:]
            else:
                out.append(held[None])
        held = None
        if a + PIECE < len(data) and len(end) and end[-1] == len(part):
            held, h, size = np.array([h[-1], size[-1]]), h[:-1], size[:-1]
        out.append(np.stack([h, size], axis=1))
    h, size = np.concatenate(out).T if out else np.empty((2, 0), np.uint64)
    h = (h ^ (h >> np.uint64(32))) * _MIX[0] + size
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sorted distinct hashes of the n-word shingles of a text; the whole sequence if it has fewer words."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self, text: str | None) -> np.ndarray:
        ids = word_hashes(text.encode("utf-8", "surrogatepass").lower()) if text else np.empty(0, np.uint64)
        if not len(ids):
            return ids
        n = min(self.n, len(ids))
        h = np.full(len(ids) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * _MULT + ids[i : len(ids) - n + 1 + i]
            h ^= h >> np.uint64(29)
        for m in _MIX:
            h = (h ^ (h >> np.uint64(33))) * m
        h.sort()
        return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _histogram(n: int):
    """Rows (range, counts) of the buckets of a partition's sets: 2**(ORDER_BITS-10) ranges of 1024 buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, total = Shingler(n), np.zeros(1 << ORDER_BITS, np.uint32)
        held: list[np.ndarray] = []

        def flush() -> None:
            if held:
                total[:] += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint32)
                held.clear()

        for batch in batches:
            for text in batch["_text"]:
                held.append((shingles(text) >> np.uint64(64 - ORDER_BITS)).astype(np.int64))
                if len(held) >= 1000 or len(held[-1]) > 1_000_000:
                    flush()
        flush()
        parts = total.reshape(-1, 1024)
        some = np.flatnonzero(parts.any(axis=1))
        yield pd.DataFrame({"range": some.astype(np.int32), "counts": [zlib.compress(parts[i].tobytes(), 1) for i in some]})

    return run


class Order:
    """The global order: rank of each bucket, and the fragment of each rank."""

    def __init__(self, rank: np.ndarray, cuts: np.ndarray):
        self.rank, self.cuts = rank, cuts

    @classmethod
    def of(cls, counts: np.ndarray, fragments: int) -> "Order":
        by_count = np.argsort(counts, kind="stable")
        rank = np.empty(len(counts), np.uint32)
        rank[by_count] = np.arange(len(counts), dtype=np.uint32)
        mass = np.cumsum(counts[by_count])
        cuts = np.searchsorted(mass, [mass[-1] * i // fragments for i in range(1, fragments)])
        return cls(rank, cuts)

    def ranks(self, h: np.ndarray) -> np.ndarray:
        return self.rank[(h >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]

    def sort(self, h: np.ndarray) -> np.ndarray:
        return h[np.argsort(self.ranks(h), kind="stable")]  # h is ascending: ties by hash


def _prefixes(n: int, order, num: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, place = Shingler(n), order.value
        for batch in batches:
            sizes, sigs, prefixes = [], [], []
            for text in batch["_text"]:
                h = shingles(text)
                k = len(h)
                sizes.append(k)
                sigs.append(xxhash.xxh3_128_hexdigest(h.tobytes()))
                prefixes.append(place.sort(h)[: k - (num * k + 99) // 100 + 1].view(np.int64) if k else np.empty(0, np.int64))
            yield pd.DataFrame({"doc_id": batch["_id"], "key": batch["_key"], "n": np.array(sizes, np.int64), "sig": sigs, "prefix": prefixes})

    return run


def _bit(values: pd.Series, bits: int) -> np.ndarray:
    x = values.to_numpy(np.uint64) * _MULT
    return ((x ^ (x >> np.uint64(32))) * _MIX[0] >> np.uint64(64 - bits)).astype(np.int64)


def _bloom_rows(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(1 << size, bool)
        for batch in batches:
            bits[_bit(batch["key"], size)] = True
        parts = np.packbits(bits).reshape(1024, -1)
        some = np.flatnonzero(parts.any(axis=1))
        yield pd.DataFrame({"range": some.astype(np.int32), "bits": [zlib.compress(parts[i].tobytes(), 1) for i in some]})

    return run


def _segments(n: int, order, bloom):
    """The segments of the sets of the documents whose key may be a candidate's; of a task's repeated rows those of one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, place, bits = Shingler(n), order.value, bloom.value
        size, told = len(bits).bit_length() + 2, set()
        for batch in batches:
            at = _bit(batch["_key"], size)
            wanted = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
            rows: list[tuple] = []
            for key, text in zip(batch["_key"][wanted], batch["_text"][wanted]):
                if key in told:
                    continue
                told.add(key)
                h = shingles(text)
                fragment = np.searchsorted(place.cuts, place.ranks(h), "right")
                rows += [(key, len(h), int(f), h[fragment == f].view(np.int64)) for f in np.unique(fragment)]
            yield pd.DataFrame(rows, columns=["key", "n", "f", "seg"])

    return run


def _added(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1024, np.uint64)
    for blob in group["counts"]:
        total += np.frombuffer(zlib.decompress(blob), np.uint32)
    return pd.DataFrame({"range": group["range"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})


def _counts(texts: DataFrame, n: int) -> np.ndarray:
    """Bucket counts over all documents: 2**ORDER_BITS numbers."""
    shape = "range int, counts binary"
    total = np.zeros((1 << (ORDER_BITS - 10), 1024), np.uint64)
    for r in texts.select("_text").mapInPandas(_histogram(n), shape).groupBy("range").applyInPandas(_added, shape).collect():
        total[r["range"]] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint64)
    return total.reshape(-1)


def _bloom(keys: DataFrame) -> np.ndarray:
    """Bits that hold the keys (long); at most 2**BLOOM_MOST, so they may be sent to all."""

    def either(group: pd.DataFrame) -> pd.DataFrame:
        blobs = [np.frombuffer(zlib.decompress(b), np.uint8) for b in group["bits"]]
        return pd.DataFrame({"range": group["range"].iloc[:1], "bits": [zlib.compress(np.bitwise_or.reduce(blobs).tobytes(), 1)]})

    size = min(BLOOM_MOST, max(BLOOM_LEAST, (16 * keys.count()).bit_length()))
    out = np.zeros((1024, (1 << size) // 8192), np.uint8)
    shape = "range int, bits binary"
    for r in keys.mapInPandas(_bloom_rows(size), shape).groupBy("range").applyInPandas(either, shape).collect():
        out[r["range"]] = np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)
    return out.reshape(-1)


def _may_link(percent: int):
    """For postings x and y of one n-gram: whether sizes and positions allow the wanted overlap."""
    rest = lambda s: F.col(f"{s}.n") - F.col(f"{s}.pos")
    sizes = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    return sizes & ((100 + percent) * F.least(rest("x"), rest("y")) >= percent * (F.col("x.n") + F.col("y.n")))


def _as_pairs(joined: DataFrame) -> DataFrame:
    """Distinct (a, b, na, nb, ka, kb), a < b, of joined postings x and y."""
    first = F.col("x.node") < F.col("y.node")
    side = lambda one, two: [F.when(first, F.col(f"{one}.{c}")).otherwise(F.col(f"{two}.{c}")) for c in ("node", "n", "key")]
    (a, na, ka), (b, nb, kb) = side("x", "y"), side("y", "x")
    return joined.select(a.alias("a"), b.alias("b"), na.alias("na"), nb.alias("nb"), ka.alias("ka"), kb.alias("kb")).distinct()


def _pairs_that_link(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, na, nb, ka, kb) whose overlap, counted by fragment and summed, is enough.

    Rows of one document that is repeated give equal counts, of which one is taken.
    """
    side = lambda x: segments.select(F.col("key").alias(f"k{x}"), F.col("n").alias(f"n{x}"), "f", F.col("seg").alias(f"s{x}"))
    each = pairs.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    partial = each.join(side("a").hint("merge"), ["ka", "na", "f"]).join(side("b").hint("merge"), ["kb", "nb", "f"])
    counted = partial.select("a", "b", "na", "nb", "f", F.size(F.array_intersect("sa", "sb")).cast("long").alias("o"))
    summed = counted.groupBy("a", "b", "na", "nb", "f").agg(F.max("o").alias("o")).groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return summed.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _overlaps(sets: list[dict[int, np.ndarray]]) -> np.ndarray:
    """Sizes of the overlaps of all pairs of sets (fragment to n-grams): counted fragment by fragment, and summed."""
    m = len(sets)
    total = np.zeros(m * m, np.int64)
    for f in sorted(set().union(*sets)):
        parts = [s.get(f, _NONE) for s in sets]
        row, gram = np.repeat(np.arange(m), [len(p) for p in parts]), np.concatenate(parts)
        by_gram = np.argsort(gram, kind="stable")
        row, gram = row[by_gram], gram[by_gram]
        edge = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        size = np.diff(np.append(edge, len(gram)))
        often = np.repeat(size > RARE, size)
        # N-grams of many sets: products of columns of a 0/1 matrix, some columns at a time.
        column, r = np.repeat(np.cumsum(size > RARE) - 1, size)[often], row[often]
        wide = max(1, MATRIX // m)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
            at = slice(*np.searchsorted(column, [low, low + wide]))
            x = np.zeros((m, wide), np.float32)
            x[r[at], column[at] - low] = 1
            total += np.rint(x @ x.T).astype(np.int64).reshape(-1)
        # N-grams of few sets: their pairs, by distance in the n-gram's list.
        gram, r = gram[~often], row[~often]
        for by in range(1, RARE):
            same = np.flatnonzero(gram[by:] == gram[:-by])
            if not len(same):
                break
            total += np.bincount(r[same] * m + r[same + by], minlength=m * m)
            total += np.bincount(r[same + by] * m + r[same], minlength=m * m)
    return total.reshape(m, m)


def _links_of(percent: int, pairs: bool):
    """For a group of components, or two blocks of one: (node, links) of its classes, or its linking pairs (a, b, o)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in group.groupby(["root", "low", "high"], sort=False):
            own = own.sort_values("node", kind="stable")
            nodes, at = np.unique(own["node"].to_numpy(np.int64), return_index=True)
            n, weight, block = (own[c].to_numpy(np.int64)[at] for c in ("n", "n_equal", "block"))
            sets: list[dict[int, np.ndarray]] = [{} for _ in nodes]
            for i, f, seg in zip(np.searchsorted(nodes, own["node"].to_numpy(np.int64)), own["f"], own["seg"]):
                sets[i][f] = seg
            o = _overlaps(sets)
            link = 100 * o >= percent * (n[:, None] + n[None] - o)
            np.fill_diagonal(link, False)
            if own["low"].iloc[0] != own["high"].iloc[0]:  # pairs inside a block are another task's
                link &= block[:, None] != block[None]
            if pairs:
                a, b = np.nonzero(np.triu(link))
                out.append(pd.DataFrame({"a": nodes[a], "b": nodes[b], "o": o[a, b]}))
            else:
                out.append(pd.DataFrame({"node": nodes, "links": (link * weight[None]).sum(1)}))
        return pd.concat(out)

    return run


def _counted(in_class: DataFrame, segments: DataFrame, percent: int, pairs: bool = False) -> DataFrame:
    """(node, links): the documents of other classes that each class links with; or (a, b, o), the pairs of classes that link.

    in_class: node, key, n, n_equal and root of each class; segments: key, f and seg of all that are in a component.
    """
    ceil = lambda c, by: F.ceil(F.col(c) / by)
    sizes = in_class.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("m > 1")
    sizes = sizes.withColumn("blocks", F.greatest(ceil("m", BLOCK), ceil("total", BLOCK_GRAMS)).cast("int"))
    small = sizes.where("blocks = 1").agg(F.sum("total")).first()[0] or 0
    dealt = in_class.join(sizes.select("root", "blocks"), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.join(segments.select("key", "f", "seg"), "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    # Small components share tasks of about BLOCK_GRAMS n-grams; two blocks of a large one are a task.
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(int(small // BLOCK_GRAMS) + 1))).otherwise(F.xxhash64("root", "low", "high"))
    dealt = dealt.select("root", "low", "high", "block", "node", "n", "n_equal", "f", "seg", (F.col("blocks") == 1).alias("whole"), group.alias("task"))
    found = dealt.groupBy("whole", "task").applyInPandas(_links_of(percent, pairs), "a long, b long, o long" if pairs else "node long, links long")
    return found if pairs else found.groupBy("node").agg(F.sum("links").alias("links"))


class _Join:
    """The tables of a join: light (a row a document) and classes with their roots, in ``work``."""

    def __init__(self, docs: DataFrame, n: int, percent: int, text: str, ident: str, work: Workspace):
        spark = docs.sparkSession
        ship(spark)
        texts = docs.select(col(ident).alias("_id"), col(text).alias("_text"))
        keyed = texts.withColumn("_key", F.xxhash64(F.col("_id").cast("string"), F.col("_text")))
        kind = dict(docs.dtypes)[ident]
        order = spark.sparkContext.broadcast(Order.of(_counts(texts, n), FRAGMENTS))
        self.light = work.save(keyed.mapInPandas(_prefixes(n, order, percent), f"doc_id {kind}, key long, n long, sig string, prefix array<long>"), "light")
        classes = work.save(
            self.light.where("n > 0")
            .groupBy("sig")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")).alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.count("*").alias("n_equal"))
            .select("sig", "rep", F.col("rep.key").alias("key"), "n", "prefix", "n_equal", F.monotonically_increasing_id().alias("node")),
            "classes",
        )
        postings = classes.select("node", "key", "n", F.posexplode("prefix").alias("pos", "t"))
        # The hub of a list of one n-gram is the first in the order of positions; lists of one entry go.
        lists = postings.groupBy("t").agg(F.min(F.struct("pos", "node", "n", "key")).alias("hub"), F.count("*").alias("size")).where("size > 1")
        lists = work.save(lists, "lists")
        much = max(BLOCK, (lists.agg(F.sum("size")).first()[0] or 0) // LONG_LISTS)  # so fewer than LONG_LISTS lists are longer
        postings = work.save(_with_lists(postings, lists, much), "postings")
        self.segments: DataFrame | None = None

        def linking(pairs: DataFrame) -> DataFrame:
            """The pairs that link, by the sets of the documents that stand for the classes, read from the texts."""
            bloom = spark.sparkContext.broadcast(_bloom(pairs.select(F.explode(F.array("ka", "kb")).alias("key")).distinct()))
            segments = work.save(keyed.mapInPandas(_segments(n, order, bloom), "key long, n long, f int, seg array<long>"), "segments")
            self.segments = segments if self.segments is None else self.segments.unionByName(segments)
            return work.save(_pairs_that_link(pairs, segments, percent), "linked")

        star = postings.where("hub.node <> node").select(F.struct("node", "n", "pos", "key").alias("x"), F.col("hub").alias("y")).where(_may_link(percent))
        star = work.save(_as_pairs(star), "star")
        linked = linking(star)

        roots = components(linked, work)
        # Lists whose classes are all in one component need no more comparing to find components; the others are joined with themselves.
        rooted = postings.select("t", "size", "node", "n", "pos", "key").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = work.save(rooted, "rooted")
        mixed = rooted.groupBy("t").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.first("size").alias("size")).where("least <> most").select("t", "size")
        rooted = _with_lists(rooted.drop("size"), mixed, much)
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        block = F.pmod(F.xxhash64("node"), blocks).cast("int")
        left = rooted.withColumns({"low": block, "high": F.explode(F.sequence(block, blocks - 1))})
        right = rooted.withColumns({"high": block, "low": F.explode(F.sequence(F.lit(0), block))})
        cross = left.alias("x").join(right.alias("y"), ["t", "low", "high"])
        once = (F.col("low") < F.col("high")) | (F.col("x.node") < F.col("y.node"))
        cross = work.save(_as_pairs(cross.where(once & (F.col("x.root") != F.col("y.root")) & _may_link(percent))).join(star.select("a", "b"), ["a", "b"], "left_anti"), "cross")
        if not cross.isEmpty():
            linked = linked.unionByName(linking(cross))
            roots = components(linked, work)
        in_class = classes.drop("prefix").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        self.in_class = work.save(in_class, "in-class")

    def counted(self, percent: int, pairs: bool = False) -> DataFrame:
        return _counted(self.in_class.select("node", "key", "n", "n_equal", "root"), self.segments, percent, pairs)

    def told(self) -> DataFrame:
        """light without prefixes, with root, and rep: the id and key of its component's first document."""
        least = self.in_class.groupBy("root").agg(F.min("rep").alias("rep"))
        in_class = self.in_class.select("sig", "root", "node", "n_equal").join(least, "root")
        return self.light.drop("prefix").join(in_class, "sig", "left")


def _with_lists(postings: DataFrame, lists: DataFrame, much: int) -> DataFrame:
    """postings joined with their lists (t, size ..); those of lists longer than ``much`` stay where they lie."""
    few, many = lists.where(F.col("size") > much), lists.where(F.col("size") <= much)
    return postings.join(many.hint("merge"), "t").unionByName(postings.join(F.broadcast(few), "t"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, n_equal (documents with its set), and n_links (other documents that it links with).

    Two documents link if 100 * |A & B| >= percent * |A | B|, of sets of ``n``-word shingles.
    """
    with Workspace(docs.sparkSession, "ngram") as work:
        join = _Join(docs, n, percent, text, ident, work)
        out = join.told().join(work.save(join.counted(percent), "counted"), "node", "left")
        some = F.col("n") > 0
        out = out.select(
            F.col("doc_id").alias(ident),
            F.col("n").alias("n_shingles"),
            F.when(some, F.col("rep.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
            F.coalesce("n_equal", F.lit(1)).alias("n_equal"),
            F.when(some, F.col("n_equal") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).alias("n_links"),
        )
        return work.save(out, "out", keep=True)


def linking_pairs(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", ident: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """All links between different sets, without expanding copies.

    First (class_a, class_b, overlap), a row a pair of classes of equal sets that link; then (doc_id, class_id, n_shingles), the members of the classes.
    """
    with Workspace(docs.sparkSession, "pairs") as work:
        join = _Join(docs, n, percent, text, ident, work)
        pairs = join.counted(percent, pairs=True).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), F.col("o").alias("overlap"))
        members = join.told().select(F.col("doc_id").alias(ident), F.col("node").alias("class_id"), F.col("n").alias("n_shingles"))
        return work.save(pairs, "links", keep=True), work.save(members, "members", keep=True)


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Of each component one document, that with the smallest id (null ids last; of one id, the text of smallest hash).  Columns as in docs.

    Rows are told apart by id and text, so different texts under one id are judged each for itself; rows equal in both are
    one document, of which the least by its other columns stays.  Documents without words are linked with nothing and all stay.
    """
    key, rows = fresh(docs, "_key", "_rows")
    with Workspace(docs.sparkSession, "first") as work:
        join = _Join(docs, n, percent, text, ident, work)
        first = join.told().where((F.col("n") > 0) & F.col("rep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("rep.key") == F.col("key")))
        first = first.groupBy("doc_id", "key").agg(F.count("*").alias("rows")).select("doc_id", "key", "rows")
        wordless = join.light.where("n = 0").select("doc_id", "key", F.lit(1).cast("long").alias("rows")).distinct()
        stays = work.save(first.unionByName(wordless), "stays", keep=True)
        repeated = not stays.where("rows > 1").isEmpty()
    stays = stays.select(F.col("doc_id").alias(f"{key}i"), F.col("key").alias(f"{key}k"), F.col("rows").alias(rows))
    keyed = docs.withColumn(key, F.xxhash64(col(ident).cast("string"), col(text)))
    kept = keyed.join(stays.hint("merge"), col(ident).eqNullSafe(F.col(f"{key}i")) & (F.col(key) == F.col(f"{key}k"))).drop(f"{key}i", f"{key}k")
    if repeated:
        others = [c for c in docs.columns if c not in (ident, text)]
        least_of = F.first if any("map<" in kind for _, kind in docs.dtypes) else F.min
        one = kept.where(F.col(rows) > 1).groupBy(col(ident), F.col(key))
        least = one.agg(F.first(col(text)).alias(text), *([least_of(F.struct(*[col(c) for c in others])).alias(rows)] if others else []))
        least = least.select(*[F.col(rows)[c].alias(c) if c in others else col(c) for c in docs.columns])
        return kept.where(F.col(rows) == 1).select(*map(col, docs.columns)).unionByName(least)
    return kept.select(*map(col, docs.columns))
