"""Chunking by literal cases, and against a plain model of the rules on random texts."""

import random
import re

from pyspark.sql import functions as F

from docloom.operators import chunking as C, json_blocks


def run(spark, texts, make):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["x"] for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def packed(parts, most=1200):
    """Model: parts join while the sum of their lengths, 2 for each, stays within the limit."""
    groups = []
    for p in parts:
        if groups and sum(len(x) + 2 for x in groups[-1]) + len(p) + 2 <= most:
            groups[-1].append(p)
        else:
            groups.append([p])
    return ["\n\n".join(g) for g in groups]


def test_packing_lengths(spark):
    parts = ["a" * n for n in (500, 600, 300, 1190, 5)]
    [found] = run(spark, ["\n\n".join(parts)], C.split_oversized)
    assert [len(x) for x in found] == [1102, 300, 1197]


def test_text_without_ends_is_cut_in_windows(spark):
    [found] = run(spark, ["b" * 2000], C.split_oversized)
    assert [len(x) for x in found] == [900, 900, 360]


def test_overlap_leads_the_next_piece(spark):
    text = "".join("x" * 299 + "！" for _ in range(5))
    [found] = run(spark, [text], C.cut_paragraph)
    assert [len(x) for x in found] == [900, 680]
    assert found[1].startswith(found[0][-80:])


def test_packing_on_random_parts(spark):
    rng = random.Random(3)
    texts = ["\n".join("w" * rng.choice([0, 3, 200, 599, 1200, 1300]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    for text, got in zip(texts, run(spark, texts, lambda t: C.pack(F.split(t, "\n", -1)))):
        assert got == packed(text.split("\n"))


def test_no_loss_on_random_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["字", "a", "。", "!", " ", "\n", "\n\n"]) * rng.randint(1, 90) for _ in range(80)) for _ in range(30)]
    for text, got in zip(texts, run(spark, texts, C.split_oversized)):
        assert all(x for x in got)
        squeezed = "".join("".join(got).split())
        for piece in re.split(r"\s+", text):
            assert piece[:100] in squeezed or not piece.strip("。!")


def test_plain_text(spark):
    got = run(spark, ["a\nb \n\n \n c\r\nd\n\n", "", None, "   "], C.plain_text)
    assert [[b["text"] for b in x] if x is not None else None for x in got] == [["a\nb", "c\nd"], [], None, []]
    assert {b["block_type"] for b in got[0]} == {"paragraph"}


def test_heading_chain_is_positional(spark):
    text = "\n".join(["# H1", "### A", "### B", "x", "## C"])
    [got], [strict] = run(spark, [text], C.markdown), run(spark, [text], lambda t: C.markdown(t, strict_levels=True))
    assert [b["section"] for b in got] == ["H1", "H1 / A", "H1 / A / B", "H1 / C"]
    assert [b["section"] for b in strict] == ["H1", "H1 / A", "H1 / B", "H1 / C"]


def test_fence_and_preamble(spark):
    [got] = run(spark, ["intro\n# T\n```\n# no heading\n```\nend\n#nospace"], C.markdown)
    assert [(b["section"], b["text"]) for b in got] == [(None, "intro"), ("T", "T\n```\n# no heading\n```\nend\n#nospace")]


def test_long_section_becomes_paragraphs(spark):
    [got] = run(spark, ["# T\n" + "z" * 1300], C.markdown)
    assert {b["block_type"] for b in got} == {"paragraph"} and {b["section"] for b in got} == {"T"}


def test_json(spark):
    texts = ['[{"名称":"蓝牙耳机","价格":199},{"b":{"c":[1,null]},"a":true}]', '{"x":[1,2],"y":[{"k":"v"}],"z":{}}', "5", "{oops"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = json_blocks.with_json(df, "t").orderBy("i").collect()
    found = [[(b["section"], b["text"]) for b in r["blocks"]] for r in rows]
    assert found[0] == [("$[0]", "$[0].名称：蓝牙耳机\n$[0].价格：199"), ("$[1]", "$[1].b.c[0]：1\n$[1].b.c[1]：None\n$[1].a：True")]
    assert found[1] == [("$.x", "[1, 2]"), ("$.y[0]", "$.y[0].k：v")]
    assert found[2] == [("$", "5")]
    assert found[3] == [] and "JSON" in rows[3]["error"]


def test_records(spark):
    df = spark.createDataFrame([("耳机", " 199 ", None), (None, " ", None)], "`商品名称` string, `价格` string, `库存` string")
    got = [r[0] for r in df.select(C.record_text(df.columns)).collect()]
    assert got == ["商品名称：耳机；价格：199", None]


def test_blocks_are_numbered_and_dated(spark):
    docs = spark.createDataFrame([("r_2024", "a\n\nb [IMAGE:p-1]")], "doc_id string, text string")
    rows = C.blocks(docs, C.plain_text(F.col("text"))).orderBy("block_seq").collect()
    assert [(r["block_id"], r["doc_year"], r["image_ids"]) for r in rows] == [("r_2024:0", 2024, None), ("r_2024:1", 2024, ["p-1"])]
    assert [f.name for f in C.blocks(docs, C.plain_text(F.col("text"))).schema] == [f.name for f in C.BLOCK_SCHEMA]
