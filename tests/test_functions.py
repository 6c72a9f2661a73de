"""Column functions, by literal cases."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "title, date",
    [
        ("某公司2025年年度报告", "2025"),
        ("某公司2024年年度报告（更正后）", "2024"),
        ("2025-04-29_公告", "2025-04-29"),
        ("2025.4.9_公告", "2025-04-09"),
        ("2025年4月29日公告", "2025-04-29"),
        ("Annual_Report_2025_ZH", "2025"),
        ("1_some_manual_cn", None),
        ("项目规划", None),
        ("项目规划_2025-99-99_v2", "2025"),
        ("编号20251234", None),
        ("plan 2035", None),
        ("", None),
    ],
)
def test_doc_date(spark, title, date):
    assert one(spark, X.doc_date(F.col("t")), t=title) == date


@pytest.mark.parametrize(
    "question, years",
    [
        ("2024年报的营收？", [2024]),
        ("2025 与 2024 对比", [2024, 2025]),
        ("2025年，2025年？", [2025]),
        ("营收是多少", None),
        ("1,420,836", None),
        ("编号 20251234", None),
    ],
)
def test_years(spark, question, years):
    assert one(spark, X.question_years(F.col("q")), q=question) == years


@pytest.mark.parametrize(
    "raw, valid, cleaned, refs",
    [
        ("根据[1]与[9]可知，该功能支持[1]引用。[99]越界。", 2, "根据[1]与可知，该功能支持[1]引用。越界。", [1]),
        ("完全越界[3]，无有效引用。", 2, "完全越界，无有效引用。", []),
        ("正常句子，无角标。", 3, "正常句子，无角标。", []),
        ("[2][1][2] [0] [99999999999999]", 2, "[2][1][2]", [2, 1]),
    ],
)
def test_citations(spark, raw, valid, cleaned, refs):
    assert one(spark, X.without_ghosts(F.col("a"), F.lit(valid)), a=raw).strip() == cleaned
    assert one(spark, X.cited(F.col("a"), F.lit(valid)), a=raw) == refs


def test_hint_only_with_hits_and_an_answer(spark):
    hint = lambda text, refs, hits: one(spark, X.with_hint(F.col("a"), F.array(*[F.lit(r) for r in refs]).cast("array<int>"), F.lit(hits)), a=text)
    assert hint("答", [], 2).endswith(X.NO_SOURCE_HINT)
    assert hint("答", [1], 2) == "答"
    assert hint("答", [], 0) == "答"
    assert hint("知识库中未找到内容", [], 2) == "知识库中未找到内容"


@pytest.mark.parametrize("question, plain, words", [("你好", True, True), ("What is this?", True, False), ("Hi there", True, True), ("营收是多少", False, False), ("hi " * 20, False, False)])
def test_greeting(spark, question, plain, words):
    assert one(spark, X.is_greeting(F.col("q")), q=question) is plain
    assert one(spark, X.is_greeting(F.col("q"), whole_words=True), q=question) is words


def test_white_space_is_unicode(spark):
    assert one(spark, X.normalise(F.col("t")), t=" A　b \tC\x1c ") == "abc"
    assert one(spark, X.strip(F.col("t")), t="　 a b\x1f\n") == "a b"


def test_images(spark):
    text = "a [IMAGE:x-1] b [IMAGE:y.2] [IMAGE:x-1] [IMAGE: no]"
    assert one(spark, X.image_ids(F.col("t")), t=text) == ["x-1", "y.2"]
    assert one(spark, X.images_shown(F.col("t")), t=text) == "a (图) b (图) (图) [IMAGE: no]"


def test_eta(spark):
    eta = lambda pages, size: one(spark, X.eta_seconds(F.lit(pages), F.lit(size)))
    assert (eta(30, 1), eta(2, 1), eta(None, 10), eta(None, 3 << 20)) == (60, 15, 20, 60)
    words = lambda s: one(spark, X.eta_words(F.lit(s)))
    assert (words(59), words(60), words(90), words(150)) == ("59 秒", "1 分钟", "2 分钟", "2 分钟")
