"""Removal of line runs that occurred before, by suffix ranks over line sequences.

All texts are read as one sequence of lines, in the order of doc_id, of the text's
hash, and of the line.  Suffixes get ranks by prefix doubling: the rank of the first
1, 2, 4 ... lines of a suffix is the place in the corpus where those lines first
stand.  The suffixes of one rank at n lines are an interval of the suffix array
whose common prefix has n lines at least; the interval's first place is the copy
that stays, and the others are later copies.  Doubling goes on as long as a rank
is shared, so the deepest interval of a suffix gives its longest repeated run to a
power of two; lengths between combine two overlapping ranks.  All intervals of a
run together cover it wholly, as a run of n lines is covered by its parts of
2**k <= n lines, each of which stands earlier as well.

A run of lines that stands earlier in the corpus is deleted if it has ``min_words``
words, or ``min_lines`` lines with a word among them.  Lines of white space do not
break a run and go with it: such a line far from the next line with words goes if
all lines from there to it stand earlier, which two overlapping ranks tell.

Work is cut in three ways.  Texts that are equal are one text of its first document;
its other copies are one run from end to end.  A suffix leaves when its rank is its
own.  And ranks come from partial aggregates, whose few very large classes meet
their rows by broadcast, so a line in a third of all documents is neither gathered
in one task nor paired with itself.

Cases: a null text has no lines and stays null; an empty text has one empty line;
rows equal in doc_id and text are one document, and get the same result; texts of
one doc_id follow each other in the order of their hash; null ids come first; texts
of any length are read whole; an empty table gives an empty result; input columns
named like the results are replaced, all others come through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W, WindowSpec

from docloom.llm.names import col, fresh, rest
from docloom.session import Workspace

MIN_LINES, MIN_WORDS = 3, 50
#: Members of a class from which it is large, and the most classes that can be (more members are then asked for).
LARGE, MOST_LARGE = 1024, 50_000


def _place() -> Column:
    return F.struct("id", "h", "i")


def _in_text() -> WindowSpec:
    return W.partitionBy("h").orderBy("i")


def _lines(docs: DataFrame, text: str, ident: str) -> DataFrame:
    """(h, i, id, a, b, words): the lines of each different text, and its first document; a and b are two hashes of the line."""
    line = F.col("line")
    # The text itself must not travel with each of its lines.
    rows = docs.select(col(ident).alias("id"), F.xxhash64(col(text)).alias("h"), F.split(col(text), "\n", -1).alias("lines"))
    rows = rows.select("id", "h", F.posexplode("lines").alias("i", "line"))
    words = F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.select("id", "h", "i", F.xxhash64(line).alias("a"), F.crc32(line.cast("binary")).alias("b"), words.alias("words"))
    rows = rows.groupBy("h", "i").agg(F.min(F.struct("id")).alias("doc"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("words").alias("words"))
    return rows.select("h", "i", F.col("doc.id").alias("id"), "a", "b", "words")


def _ranked(rows: DataFrame, by: list[str], large: bool, much: int, work: Workspace, name: str) -> DataFrame:
    """Those of the rows whose values of ``by`` stand more than once, with rank, the first place of them, and their number, for these columns.

    Where no class can have more than ``much`` rows (not ``large``), classes meet in a window; else in a join.
    """
    if not large:
        own = W.partitionBy(*by)
        return rows.withColumns({"rank": F.min(_place()).over(own), "size": F.count("*").over(own)}).where("size > 1").drop(*by)
    classes = rows.groupBy(*by).agg(F.min(_place()).alias("rank"), F.count("*").alias("size")).where("size > 1")
    classes = work.save(classes, f"classes-{name}")
    few, many = classes.where(F.col("size") > much), classes.where(F.col("size") <= much)
    return rows.join(many.hint("merge"), by).unionByName(rows.join(F.broadcast(few), by)).drop(*by)


def _grown(ranks: DataFrame, by: int) -> DataFrame:
    """From ranks of n lines, the pairs (one, two) that make up n + by lines; they overlap if by < n."""
    ahead = F.first(F.struct("rank", "upto")).over(_in_text().rangeBetween(by, by))
    pairs = ranks.withColumn("ahead", ahead).where("ahead is not null")
    return pairs.select("h", "i", "id", "before", F.col("ahead.upto").alias("upto"), F.col("rank").alias("one"), F.col("ahead.rank").alias("two"))


def suffix_ranks(docs: DataFrame, work: Workspace, min_lines: int = MIN_LINES, text: str = "text", ident: str = "doc_id") -> tuple[DataFrame, dict[int, DataFrame]]:
    """The lines of all different texts, and for each length the suffixes whose first so many lines stand more than once.

    Lengths are 1, 2, 4 ... until no such suffix is left, and all up to ``min_lines``.  Of a suffix: its place (h, i, id), the
    place ``rank`` where its lines stand first, and the words of the text's repeated lines ``before`` it and ``upto`` its last.
    """
    lines = work.save(_lines(docs, text, ident), "lines")
    much = max(LARGE, lines.count() // MOST_LARGE)
    ranks, most = {}, much + 1  # of the rows of a class

    def add(n: int, rows: DataFrame, by: list[str]) -> int:
        found = _ranked(rows, by, most > much, much, work, str(n))
        if n == 1:
            upto = F.sum("words").over(_in_text())
            found = found.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
        ranks[n] = work.save(found, f"ranks-{n}")
        return ranks[n].agg(F.max("size")).first()[0] or 0

    n, most = 1, add(1, lines, ["a", "b"])
    while most:
        for by in range(1, n):
            if n + by <= min_lines:
                add(n + by, _grown(ranks[n], by), ["one", "two"])
        most = add(2 * n, _grown(ranks[n], n), ["one", "two"])
        n *= 2
    return lines, ranks


def _far_blanks(ranks: dict[int, DataFrame], min_lines: int) -> DataFrame | None:
    """(h, i, n = 1): lines of white space, with over ``min_lines`` lines from the next line with words to them, where all of these stand earlier."""
    if ranks[1].where("words = 0").isEmpty():
        return None
    at = F.when(F.col("words") > 0, F.struct("i", "group"))
    rows = ranks[1].withColumn("group", F.col("i") - F.row_number().over(_in_text()))  # equal in adjacent lines
    rows = rows.withColumns(
        {
            "left": F.last(at, True).over(_in_text().rowsBetween(W.unboundedPreceding, -1)),
            "right": F.first(at, True).over(_in_text().rowsBetween(1, W.unboundedFollowing)),
        }
    ).where("words = 0")
    side = lambda c, start, n: rows.where(F.col(f"{c}.group") == F.col("group")).select("id", "h", start.alias("start"), n.cast("int").alias("n"), "i")
    far = side("left", F.col("left.i"), F.col("i") - F.col("left.i") + 1).unionByName(side("right", F.col("i"), F.col("right.i") - F.col("i") + 1))
    far = far.where(F.col("n") > min_lines)
    if far.isEmpty():
        return None
    known = None
    for n, found in ranks.items():
        if n & (n - 1) == 0:
            found = found.select("h", F.col("i").alias("at"), F.lit(n).alias("half"), "rank")
            known = found if known is None else known.unionByName(found)
    far = far.withColumn("half", F.expr("cast(pow(2, floor(log2(n))) as int)"))
    far = far.join(known.select("h", F.col("at").alias("start"), "half", F.col("rank").alias("one")), ["h", "start", "half"])
    far = far.withColumn("at", F.col("start") + F.col("n") - F.col("half")).join(known.select("h", "at", "half", F.col("rank").alias("two")), ["h", "at", "half"])
    place = F.struct("id", "h", "start")
    first = far.groupBy("n", "one", "two").agg(F.min(place).alias("rank"))
    return far.join(first, ["n", "one", "two"]).where(F.col("rank") != place).select("h", "i", F.lit(1).alias("n"))


def repeated_runs(docs: DataFrame, work: Workspace, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(id, h, removed): for each document the runs of lines that go, each from start to before stop."""
    lines, ranks = suffix_ranks(docs, work, min_lines, text, ident)
    spans = None
    for n, found in ranks.items():
        words = F.col("upto") - F.col("before")
        good = found.where((F.col("rank") != _place()) & (words >= (min_words if n < min_lines else min(1, min_words)))).select("h", "i", F.lit(n).alias("n"))
        spans = good if spans is None else spans.unionByName(good)
    far = _far_blanks(ranks, min_lines)
    spans = spans if far is None else spans.unionByName(far)
    # Spans that touch are one run: a span opens one if it starts behind all before it.
    stop = F.col("i") + F.col("n")
    reach = F.max(stop).over(_in_text().rowsBetween(W.unboundedPreceding, -1))
    opens = spans.withColumns({"stop": stop, "opens": F.when(reach >= F.col("i"), 0).otherwise(1)})
    runs = opens.withColumn("run", F.sum("opens").over(_in_text().rowsBetween(W.unboundedPreceding, 0))).groupBy("h", "run").agg(F.min("i").alias("start"), F.max("stop").alias("stop"))
    runs = runs.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("removed"))
    # Texts that several documents hold: the first one's runs are those found, the others' are the whole text.
    whose = docs.where(col(text).isNotNull()).select(col(ident).alias("id"), F.xxhash64(col(text)).alias("h"))
    texts = lines.groupBy("h").agg(F.first(F.struct("id")).alias("doc"), F.count("*").cast("int").alias("n"), F.sum("words").alias("words"))
    first = runs.join(texts.select("h", "doc"), "h").select("doc.id", "h", "removed")
    counts = work.save(whose.groupBy("h").agg(F.count("*").alias("size"), F.max(F.struct("id")).alias("last")), "copies")
    often = counts.where("size > 1").join(texts, "h").where(F.col("last") != F.col("doc"))
    whole = (F.col("words") >= min_words) | ((F.col("n") >= min_lines) & (F.col("words") > 0))
    often = work.save(often.where(whole).select("h", "size", "doc", F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("stop"))).alias("removed")), "often")
    much = max(LARGE, (often.agg(F.sum("size")).first()[0] or 0) // MOST_LARGE)
    met = lambda part, how: whose.join(part.hint(how), "h")
    copies = met(often.where(F.col("size") <= much), "merge").unionByName(met(often.where(F.col("size") > much), "broadcast"))
    copies = copies.where(~F.struct("id").eqNullSafe(F.col("doc"))).select("id", "h", "removed").dropDuplicates(["id", "h"])
    return first.unionByName(copies)


def _kept(lines: Column, removed: Column) -> Column:
    """The lines without the runs, which are ascending and apart."""
    starts = F.concat(F.array(F.lit(0)), F.transform(removed, lambda r: r["stop"]))
    stops = F.concat(F.transform(removed, lambda r: r["start"]), F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, b - a)))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """docs with the text without the repeated runs, n_lines, n_removed, and removed (the runs that went: first line, end)."""
    with Workspace(docs.sparkSession, "lines") as work:
        gone = work.save(repeated_runs(docs, work, min_lines, min_words, text, ident), "gone", keep=True)
    h, gone_id, gone_h, removed = fresh(docs, "_h", "_gone_id", "_gone_h", "_removed")
    rows = docs.withColumn(h, F.xxhash64(col(text)))
    gone = gone.select(F.col("id").alias(gone_id), F.col("h").alias(gone_h), F.col("removed").alias(removed))
    # What goes grows with the corpus, so this is a sort-merge join at any size; the texts are shuffled once.
    rows = rows.join(gone.hint("merge"), (F.col(h) == F.col(gone_h)) & col(ident).eqNullSafe(F.col(gone_id)), "left")
    lines = F.split(col(text), "\n", -1)
    size = F.aggregate(removed, F.lit(0), lambda n, r: n + r["stop"] - r["start"])
    results = {
        "n_lines": F.when(col(text).isNotNull(), F.size(lines)).otherwise(0),
        "n_removed": F.coalesce(size, F.lit(0)),
        "removed": F.col(removed),
        text: F.when(F.col(removed).isNull(), col(text)).otherwise(F.array_join(_kept(lines, F.col(removed)), "\n")),
    }
    names = rest(docs, "n_lines", "n_removed", "removed")
    return rows.select(*[results.pop(c).alias(c) if c == text else col(c) for c in names], *[results[c].alias(c) for c in ("n_lines", "n_removed", "removed")])
