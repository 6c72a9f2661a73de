"""Blocks of laid-out pages: reading order, tables across pages, groups of page parts.

The input is a table of pages: doc_id, page, page_height and items, an array of
<kind, x0, y0, x1, y1, lines, rows, image_id>, where kind is text, table or image,
lines are arrays of spans <text, x0, x1, size>, and rows are arrays of cells.
Rendering and order are column expressions.  Tables that cross pages depend on what
was done to the page before, so a document's pages are gone through together in
order; the group is one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions import text as X
from docloom.functions.arrays import bound
from docloom.operators.chunking import BLOCK, fit
from docloom.session import ship

# Layout thresholds.
GAP, ROW, BOTTOM, TOP = 0.35, 8.0, 0.78, 0.12
ITEMS = (
    "array<struct<kind:string,x0:double,y0:double,x1:double,y1:double,lines:array<array<struct<text:string,x0:double,x1:double,size:double>>>,"
    "rows:array<array<string>>,image_id:string>>"
)
PART = "struct<text:string,is_table:boolean,at_bottom:boolean,at_top:boolean>"


def line_text(spans: Column) -> Column:
    """Spans of a line, with a space where the gap is over GAP of the font size."""

    def add(st: Column, s: Column) -> Column:
        gap = st["end"].isNotNull() & (s["x0"] - st["end"] > GAP * F.coalesce(s["size"], F.lit(10.0)))
        return F.struct(F.concat(st["out"], F.when(gap, " ").otherwise(""), F.coalesce(s["text"], F.lit(""))).alias("out"), s["x1"].alias("end"))

    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("double").alias("end"))
    return X.strip_long(F.aggregate(spans, start, add, lambda st: st["out"]))


def text_block(lines: Column) -> Column:
    return F.array_join(F.filter(F.transform(lines, line_text), lambda t: t != ""), "\n")


def table_text(rows: Column) -> Column:
    """Cells with white space folded, joined by `` | ``; null and blank cells and empty rows go."""
    cell = lambda c: F.trim(F.regexp_replace(c, rf"{X.SPACE}+", " "))
    # Most rows have no white space in their cells: one look at the row tells.
    folded = lambda r: F.when(F.array_join(r, "").rlike(X.SPACE), F.transform(r, cell)).otherwise(r)
    row = lambda r: F.array_join(F.filter(folded(r), lambda c: c != ""), " | ")
    return F.array_join(F.filter(F.transform(rows, row), lambda t: t != ""), "\n")


def page_parts(items: Column, height: Column) -> Column:
    """array<PART> of a page in reading order: text in tables left out, rows of ROW points, then from the left.

    The marks at_bottom and at_top go to the last table near each edge.
    """
    rank = lambda i: F.when(i["kind"] == "text", 0).when(i["kind"] == "table", 1).otherwise(2)

    def inside(tables: Column, i: Column) -> Column:
        x, y = (i["x0"] + i["x1"]) / 2, (i["y0"] + i["y1"]) / 2
        return (i["kind"] == "text") & F.exists(tables, lambda t: (x >= t["x0"]) & (x < t["x1"]) & (y >= t["y0"]) & (y < t["y1"]))

    place = lambda i, n: (F.bround(i["y0"] / ROW).alias("row"), i["x0"].alias("x"), rank(i).alias("r"), n.alias("n"))
    tables = F.filter(items, lambda i: i["kind"] == "table")
    keyed = bound(tables, lambda t: F.transform(items, lambda i, n: F.struct(*place(i, n), inside(t, i).alias("gone"), i.alias("i"))))
    sorted_ = F.transform(F.array_sort(F.filter(keyed, lambda k: ~k["gone"]), _by_place), lambda k: k["i"])
    shown = lambda i: (
        F.when(i["kind"] == "text", text_block(i["lines"])).when(i["kind"] == "table", table_text(i["rows"])).when(i["image_id"].isNotNull(), F.concat(F.lit("[IMAGE:"), i["image_id"], F.lit("]")))
    )
    last = lambda items, good: F.array_max(F.transform(items, lambda i, n: F.when((i["kind"] == "table") & good(i), n)))

    def marked(s: Column) -> Column:
        return F.transform(
            s["ordered"],
            lambda i, n: F.struct(
                shown(i).alias("text"),
                (i["kind"] == "table").alias("is_table"),
                F.coalesce(n == s["bottom"], F.lit(False)).alias("at_bottom"),
                F.coalesce(n == s["top"], F.lit(False)).alias("at_top"),
            ),
        )

    ends = lambda o: F.struct(
        o.alias("ordered"), last(o, lambda i: i["y1"] >= height * BOTTOM).alias("bottom"), last(o, lambda i: i["y0"] <= height * TOP).alias("top")
    )
    parts = bound(bound(sorted_, ends), marked)
    return F.filter(parts, lambda p: p["text"].isNotNull() & (p["text"] != ""))


def _by_place(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for c in ("n", "r", "x", "row"):
        out = F.when(a[c] < b[c], -1).when(a[c] > b[c], 1).otherwise(out)
    return out


def chain_tables(pages: list[list[dict]]) -> list[list[dict]]:
    """Tables that run over a page's end: short ones join the part above, long ones get its first two lines on top.

    Pages are gone through in order, so a table over many pages hands its head on.
    A table that was joined away is no longer at its page's bottom.
    """
    for above, below in zip(pages, pages[1:]):
        end = next((p for p in above if p["at_bottom"]), None)
        start = next((p for p in below if p["at_top"]), None)
        if end is None or start is None:
            continue
        if len(end["text"]) + len(start["text"]) <= X.MAX:
            end["text"] = end["text"].rstrip() + "\n" + start["text"].strip()
            below.remove(start)
        else:
            head = "\n".join(end["text"].splitlines()[:2])
            if not start["text"].startswith(head):
                start["text"] = f"{head}\n{start['text']}"
    return pages


def chain_rows(rows: DataFrame, column: str) -> DataFrame:
    """The same for documents that are one row, whose ``column`` is array<array<PART>>, a page after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            pages = [None if doc is None else chain_tables([list(page) for page in doc]) for doc in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(pages, batch.schema.field(at).type))

    return rows.mapInArrow(run, rows.schema)


def split_table(text: Column) -> Column:
    """A long table by rows, each piece led by the first row; one long row stays whole.

    Rows, the first one and its length are bound: the fold names them at every row.
    """

    def cut(t: Column) -> Column:
        def add(st: Column, row: Column) -> Column:
            full = (st["size"] + F.length(row) + 1 > t["budget"]) & (st["n"] > 0)
            return F.struct(
                F.when(full, F.concat(st["done"], F.array(st["cur"]))).otherwise(st["done"]).alias("done"),
                F.concat(F.when(full, t["head"]).otherwise(st["cur"]), F.lit("\n"), row).alias("cur"),
                (F.when(full, t["length"]).otherwise(st["size"]) + F.length(row) + 1).alias("size"),
                (F.when(full, 0).otherwise(st["n"]) + 1).alias("n"),
            )

        start = F.struct(F.array().cast("array<string>").alias("done"), t["head"].alias("cur"), t["length"].alias("size"), F.lit(0).alias("n"))
        return F.aggregate(F.slice(t["rows"], F.lit(2), F.size(t["rows"])), start, add, lambda st: F.concat(st["done"], F.array(st["cur"])))

    def led(rows: Column) -> Column:
        head = F.element_at(rows, 1)
        measured = bound(F.length(head), lambda n: F.struct(rows.alias("rows"), head.alias("head"), n.alias("length"), (X.MAX - n - 4).alias("budget")))
        return F.when(F.size(rows) > 1, bound(measured, cut)).otherwise(fit(text))

    return bound(F.split(text, X.LINE_END, -1), led)


def page_blocks(parts: Column, page: Column) -> Column:
    """Blocks of a page: tables stand alone, other parts are gathered to MAX; page numbers go."""
    atom = lambda t, table: F.transform(t, lambda x: F.struct(x.alias("text"), table.alias("table")))

    def atoms(p: Column) -> Column:
        table = atom(F.when(F.length(p["text"]) <= X.MAX, F.array(p["text"])).otherwise(split_table(p["text"])), F.lit(True))
        plain = F.when(X.is_page_number(p["text"]), F.array().cast("array<string>")).otherwise(fit(p["text"]))
        return F.when(p["is_table"], table).otherwise(atom(plain, F.lit(False)))

    section = F.concat(F.lit("第 "), page.cast("string"), F.lit(" 页"))
    block = lambda t, kind: F.struct(section.alias("section"), F.lit(kind).alias("block_type"), t.alias("text"))
    none = F.lit(None).cast("string")

    def add(st: Column, a: Column) -> Column:
        held = F.when(st["cur"].isNotNull(), F.concat(st["done"], F.array(block(st["cur"], "page")))).otherwise(st["done"])
        full = st["cur"].isNotNull() & (st["size"] + F.length(a["text"]) + 2 > X.MAX)
        fresh = full | st["cur"].isNull()
        return F.struct(
            F.when(a["table"], F.concat(held, F.array(block(a["text"], "table")))).when(full, held).otherwise(st["done"]).alias("done"),
            F.when(a["table"], none).when(fresh, a["text"]).otherwise(F.concat(st["cur"], F.lit("\n\n"), a["text"])).alias("cur"),
            F.when(a["table"], 0).otherwise(F.when(fresh, 0).otherwise(st["size"]) + F.length(a["text"]) + 2).alias("size"),
        )

    start = F.struct(F.array().cast(BLOCK).alias("done"), none.alias("cur"), F.lit(0).alias("size"))
    end = lambda st: F.when(st["cur"].isNotNull(), F.concat(st["done"], F.array(block(st["cur"], "page")))).otherwise(st["done"])
    return F.aggregate(F.flatten(F.transform(parts, atoms)), start, add, end)


def transcript_blocks(text: Column, page: Column) -> Column:
    """The blocks of a transcribed page."""
    section = F.concat(F.lit("第 "), page.cast("string"), F.lit(" 页"))
    return F.transform(fit(text), lambda t: F.struct(section.alias("section"), F.lit("figure_transcript").alias("block_type"), t.alias("text")))


def laid_out_blocks(pages: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """(doc_id, block_seq, page, section, block_type, text): all pages in order, then the transcripts.

    transcripts (doc_id, page, text): their pages give no other blocks, and no tables.
    Pages and transcripts of a document meet in one row, by one exchange.
    """
    ship(pages.sparkSession)
    kept, text = f"array<{PART}>", F.lit(None).cast("string")
    rows = pages.select("doc_id", "page", page_parts(F.col("items"), F.col("page_height")).cast(kept).alias("parts"), text.alias("text"), F.lit(False).alias("told"))
    if transcripts is not None:
        rows = rows.unionByName(transcripts.select("doc_id", "page", F.lit(None).cast(kept).alias("parts"), "text", F.lit(True).alias("told")))
    # Pages without a number are chained last and stand first, as rows without a value are sorted.
    row = F.struct(F.col("page").isNull().alias("unnumbered"), "page", "parts", "text", "told")
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    of = lambda told: F.filter("r", lambda r: r["told"] == told)
    docs = docs.select("doc_id", of(False).alias("p"), F.transform(of(True), lambda r: F.struct(r["page"].alias("page"), r["text"].alias("text"))).alias("told"))
    red = lambda p: F.coalesce(F.exists("told", lambda t: t["page"] == p["page"]), F.lit(False))
    docs = docs.select(
        "doc_id", "told", F.transform("p", lambda p: p["page"]).alias("pages"), F.transform("p", lambda p: F.when(red(p), F.array().cast(kept)).otherwise(p["parts"])).alias("parts")
    )
    cut = lambda page, blocks: F.struct(page.alias("page"), blocks.alias("blocks"))
    read = F.zip_with("pages", "parts", lambda page, parts: cut(page, page_blocks(parts, page)))
    told = F.transform("told", lambda t: cut(t["page"], transcript_blocks(t["text"], t["page"])))
    flat = F.flatten(F.transform(F.concat(F.array_sort(read), F.array_sort(told)), lambda p: F.transform(p["blocks"], lambda b: F.struct(p["page"].alias("page"), b.alias("b")))))
    found = chain_rows(docs, "parts").select("doc_id", F.posexplode(flat).alias("block_seq", "x"))
    return found.select("doc_id", "block_seq", "x.page", "x.b.section", "x.b.block_type", "x.b.text")
