"""Laid-out pages: reading order, chained tables, groups of parts."""

import time

from pyspark.sql import functions as F

from docloom.operators import layout


def span(t, x0=0.0, x1=1.0, size=10.0):
    return (t, x0, x1, size)


def text(t, y, x=0.0):
    return ("text", float(x), float(y), x + 10.0, y + 5.0, [[span(t)]], None, None)


def table(rows, y0, y1):
    return ("table", 0.0, float(y0), 500.0, float(y1), None, rows, None)


def blocks(spark, pages, told=()):
    data = [("d", n, 1000.0, items) for n, items in enumerate(pages, 1)]
    df = spark.createDataFrame(data, f"doc_id string, page int, page_height double, items {layout.ITEMS}")
    t = spark.createDataFrame(list(told), "doc_id string, page int, text string") if told else None
    return [(r["page"], r["block_type"], r["text"]) for r in layout.laid_out_blocks(df, t).orderBy("block_seq").collect()]


def test_order_spaces_and_page_numbers(spark):
    line = [[span("ab", 0.0, 10.0), span("cd", 13.0, 20.0), span("ef", 24.0, 30.0)]]
    got = blocks(spark, [[text("right", 101, 300.0), text("left", 103, 0.0), text(" 12 ", 990), ("text", 0.0, 10.0, 5.0, 12.0, line, None, None)]])
    assert got == [(1, "page", "abcd ef\n\nleft\n\nright")]


def test_text_inside_a_table_goes(spark):
    got = blocks(spark, [[text("cell", 310), table([["a", None, " b\n c "], [None, " "]], 300, 400), text("after", 500)]])
    assert got == [(1, "table", "a | b c"), (1, "page", "after")]


def test_short_table_over_two_pages_is_joined(spark):
    got = blocks(spark, [[table([["h", "k"], ["1", "2"]], 900, 990)], [table([["3", "4"]], 20, 60), text("x", 300)]])
    assert got == [(1, "table", "h | k\n1 | 2\n3 | 4"), (2, "page", "x")]


def test_third_page_of_a_short_table_stays_apart(spark):
    got = blocks(spark, [[table([["h"]], 900, 990)], [table([["m"]], 20, 990)], [table([["t"]], 20, 60)]])
    assert got == [(1, "table", "h\nm"), (3, "table", "t")]


def test_long_table_hands_its_head_on(spark):
    rows = [["head"], ["unit"]] + [["r" * 90]] * 13
    got = blocks(spark, [[table(rows, 500, 990)], [table([["q" * 90]] * 3, 20, 990)], [table([["s" * 90]] * 13, 20, 80)]])
    assert [b[2].split("\n")[0] for b in got] == ["head"] * len(got)
    assert [b[2].split("\n")[1] for b in got if b[0] > 1][0] == "unit"
    assert all(len(b[2]) <= 1200 for b in got)


def test_transcripts_replace_their_pages_and_stand_last(spark):
    got = blocks(spark, [[text("a", 10)], [text("broken", 10)], [text("c", 10)]], [("d", 2, "read again")])
    assert got == [(1, "page", "a"), (3, "page", "c"), (2, "figure_transcript", "read again")]


def test_rows_are_never_cut(spark):
    long = "\n".join(["h" * 100] + ["v" * 500] * 4 + ["w" * 1500])
    [got] = [r["x"] for r in spark.range(1).select(layout.split_table(F.lit(long)).alias("x")).collect()]
    assert [x.split("\n")[0] for x in got] == ["h" * 100] * len(got)
    assert [len(x.split("\n")) - 1 for x in got] == [1, 1, 1, 1, 1] and "w" * 1500 in got[-1]


def test_table_of_many_rows_is_cut_in_linear_time(spark):
    began = time.perf_counter()
    rows = "\n".join(["head"] + [f"{i} " + "r" * 60 for i in range(4000)])
    [got] = [r["x"] for r in spark.createDataFrame([(rows,)], "t string").select(layout.split_table(F.col("t")).alias("x")).collect()]
    assert [line for x in got for line in x.split("\n")[1:]] == rows.split("\n")[1:]
    assert time.perf_counter() - began < 30


def test_pages_and_transcripts_meet_in_one_exchange(spark):
    pages = spark.createDataFrame([("d", 1, 1000.0, [text("a", 10)])], f"doc_id string, page int, page_height double, items {layout.ITEMS}")
    told = spark.createDataFrame([("d", 2, "b"), ("only", 1, "c"), ("only", None, "e")], "doc_id string, page int, text string")
    found = layout.laid_out_blocks(pages, told)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r["doc_id"], r["block_seq"], r["page"], r["text"]) for r in found.collect()}
    assert got == {("d", 0, 1, "a"), ("d", 1, 2, "b"), ("only", 0, None, "e"), ("only", 1, 1, "c")}


def test_white_space_of_cells_and_ends(spark):
    got = blocks(spark, [[table([[" a \x1cb ", "c"], ["d", None, ""], [" ", "\t"]], 300, 400), text("　x y\x85", 500), text("\n12 ", 600)]])
    assert got == [(1, "table", "a b | c\nd"), (1, "page", "x y")]
