"""Cutting texts into blocks, as folds over arrays inside the JVM: no shuffle, no Python.

Blocks are structs <section, block_type, text>; :func:`blocks` numbers them and
adds the columns every block carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from docloom.functions import text as X

BLOCK = "array<struct<section:string,block_type:string,text:string>>"
STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(STRINGS)


def windows(text: Column) -> Column:
    """Fixed windows of TARGET characters, each OVERLAP into the one before."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(X.TARGET - X.OVERLAP))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(X.TARGET)))).otherwise(_none())


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, X.SENTENCE_END, -1), lambda s: s.rlike(r"(?U)[^\s\x1c-\x1f]"))


def cut_paragraph(text: Column) -> Column:
    """A long paragraph: sentences gathered to TARGET, each piece led by the end of the one before; windows where a piece is still too long."""

    def add(state: Column, s: Column) -> Column:
        full = (F.length(state["cur"]) + F.length(s) > X.TARGET) & (state["cur"] != "")
        lead = F.when(F.length(state["cur"]) > X.OVERLAP, F.right(state["cur"], F.lit(X.OVERLAP))).otherwise("")
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["cur"]))).otherwise(state["done"]).alias("done"),
            F.when(full, F.concat(lead, s)).otherwise(F.concat(state["cur"], s)).alias("cur"),
        )

    start = F.struct(_none().alias("done"), F.lit("").alias("cur"))
    pieces = F.aggregate(sentences(text), start, add, lambda st: F.when(st["cur"] != "", F.concat(st["done"], F.array(st["cur"]))).otherwise(st["done"]))
    return F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) > X.MAX, windows(p)).otherwise(F.array(p))))


def pack(parts: Column) -> Column:
    """Adjacent parts joined by an empty line while they fit in MAX; a part is never cut."""

    def add(state: Column, p: Column) -> Column:
        size = F.length(p) + 2
        full = (state["size"] + size > X.MAX) & state["cur"].isNotNull()
        joined = F.when(state["cur"].isNull(), p).otherwise(F.concat(state["cur"], F.lit("\n\n"), p))
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["cur"]))).otherwise(state["done"]).alias("done"),
            F.when(full, p).otherwise(joined).alias("cur"),
            F.when(full, size).otherwise(state["size"] + size).alias("size"),
        )

    start = F.struct(_none().alias("done"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("size"))
    return F.aggregate(parts, start, add, lambda st: F.when(st["cur"].isNotNull(), F.concat(st["done"], F.array(st["cur"]))).otherwise(st["done"]))


def split_oversized(text: Column) -> Column:
    """Paragraphs between empty lines, long ones cut, all packed again."""
    found = F.filter(F.transform(F.split(text, r"(?U)\n[\s\x1c-\x1f]*\n", -1), X.strip_long), lambda p: p != "")
    return pack(F.flatten(F.transform(found, lambda p: F.when(F.length(p) > X.MAX, cut_paragraph(p)).otherwise(F.array(p)))))


def fit(text: Column) -> Column:
    """The text itself if it fits in a block, else its pieces."""
    return F.when(F.length(text) > X.MAX, split_oversized(text)).otherwise(F.array(text))


def _typed(section: Column, kind: str, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(section.cast("string").alias("section"), F.lit(kind).alias("block_type"), t.alias("text")))


def plain_text(text: Column) -> Column:
    """Paragraphs are runs of lines that aren't blank; they are never joined."""
    stripped = F.array_join(F.transform(X.lines(text), X.strip), "\n")
    paragraphs = F.filter(F.split(stripped, r"\n{2,}", -1), lambda p: X.strip(p) != "")
    return _typed(F.lit(None), "paragraph", F.flatten(F.transform(paragraphs, lambda p: fit(X.strip(p)))))


HEADING = r"^(#{1,6})(?U)[\s\x1c-\x1f]+(.*)$"


def markdown_sections(text: Column, strict_levels: bool = False) -> Column:
    """array<struct<section, text>>: a block a heading, in one fold over the lines.

    The section is the chain of headings above.  A heading of level n keeps the
    first n - 1 entries of the chain, whatever their levels; ``strict_levels``
    keeps those of lower levels instead.  Fenced lines are never headings.
    """

    def flushed(st: Column) -> Column:
        body = X.strip(F.array_join(st["parts"], "\n"))
        block = F.struct(F.nullif(st["section"], F.lit("")).alias("section"), body.alias("text"))
        return F.when(body != "", F.concat(st["done"], F.array(block))).otherwise(st["done"])

    def add(st: Column, raw: Column) -> Column:
        line = F.regexp_replace(raw, r"(?U)[\s\x1c-\x1f]+$", "")
        bare = X.strip(line)
        fence = bare.startswith("```")
        head = ~fence & ~st["fenced"] & bare.rlike(HEADING)
        level = F.length(F.regexp_extract(bare, HEADING, 1))
        title = X.strip(F.regexp_extract(bare, HEADING, 2))
        if strict_levels:
            above = F.filter(st["chain"], lambda c: c["level"] < level)
        else:
            above = F.slice(st["chain"], F.lit(1), level - 1)
        chain = F.concat(above, F.array(F.struct(level.alias("level"), title.alias("title"))))
        return F.struct(
            F.when(head, flushed(st)).otherwise(st["done"]).alias("done"),
            F.when(head, chain).otherwise(st["chain"]).alias("chain"),
            F.when(head, F.array_join(F.transform(chain, lambda c: c["title"]), " / ")).otherwise(st["section"]).alias("section"),
            F.when(head, F.array(title)).otherwise(F.concat(st["parts"], F.array(line))).alias("parts"),
            F.when(fence, ~st["fenced"]).otherwise(st["fenced"]).alias("fenced"),
        )

    start = F.struct(
        F.array().cast("array<struct<section:string,text:string>>").alias("done"),
        F.array().cast("array<struct<level:int,title:string>>").alias("chain"),
        F.lit("").alias("section"),
        _none().alias("parts"),
        F.lit(False).alias("fenced"),
    )
    return F.aggregate(X.lines(text), start, add, flushed)


def markdown(text: Column, strict_levels: bool = False) -> Column:
    def cut(b: Column) -> Column:
        return F.when(F.length(b["text"]) > X.MAX, _typed(b["section"], "paragraph", split_oversized(b["text"]))).otherwise(
            _typed(b["section"], "section", F.array(b["text"]))
        )

    return F.flatten(F.transform(markdown_sections(text, strict_levels), cut))


def record_text(columns: list[str]) -> Column:
    """``name：value`` of the cells that aren't blank, joined by ``；``; null if all are."""
    cells = [X.strip(F.col(c).cast("string")) for c in columns]
    joined = F.concat_ws("；", *[F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{c}："), v)) for c, v in zip(columns, cells)])
    return F.nullif(joined, F.lit(""))


def records(rows: DataFrame, columns: list[str], sheet: str) -> Column:
    return _typed(F.lit(f"工作表 {sheet}"), "table_record", fit(record_text(columns)))


def blocks(docs: DataFrame, found: Column, page: Column | None = None, title: Column | None = None, source_file: Column | None = None, kind: str = "txt") -> DataFrame:
    """One row a block: BLOCK_SCHEMA.  docs has doc_id; the blocks of a document are numbered from 0 in their order."""
    name = (title if title is not None else F.col("doc_id")).cast("string")
    date = X.doc_date(name)
    ids = X.image_ids(F.col("b.text"))
    return docs.withColumn("_page", (page if page is not None else F.lit(None)).cast("int")).select(
        F.col("doc_id").cast("string").alias("doc_id"),
        name.alias("title"),
        "_page",
        (source_file if source_file is not None else F.lit(None)).cast("string").alias("source_file"),
        date.alias("doc_date"),
        F.posexplode(found).alias("block_seq", "b"),
    ).select(
        "doc_id",
        "block_seq",
        F.concat_ws(":", "doc_id", "block_seq").alias("block_id"),
        "title",
        F.col("_page").alias("page"),
        F.col("b.section").alias("section"),
        F.col("b.block_type").alias("block_type"),
        "source_file",
        F.lit(kind).alias("format"),
        F.when(F.size(ids) > 0, ids).alias("image_ids"),
        "doc_date",
        X.doc_year(F.col("doc_date")).alias("doc_year"),
        F.col("b.text").alias("text"),
    )


BLOCK_SCHEMA = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("doc_id", T.StringType()), ("block_seq", T.IntegerType()), ("block_id", T.StringType()), ("title", T.StringType()),
            ("page", T.IntegerType()), ("section", T.StringType()), ("block_type", T.StringType()), ("source_file", T.StringType()),
            ("format", T.StringType()), ("image_ids", T.ArrayType(T.StringType())), ("doc_date", T.StringType()),
            ("doc_year", T.IntegerType()), ("text", T.StringType()),
        )
    ]
)
