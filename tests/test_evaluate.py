"""Evaluation, retrieval with years, answers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import embedding, evaluate, qa, quality_gate, retrieval, transcribe


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_metrics(spark):
    m = evaluate.metrics(frame(spark, [("a", True, 1), ("b", True, 3), ("c", False, None)], "id string, hit boolean, rank int")).first()
    assert (m["cases"], m["recall"], m["mrr"], m["mrr_all"]) == (3, 0.6667, 0.6667, 0.4444)
    empty = evaluate.metrics(frame(spark, [], "id string, hit boolean, rank int")).first()
    assert (empty["cases"], empty["recall"], empty["mrr"]) == (0, 0.0, 0.0)


@pytest.mark.parametrize(
    "recall, cases, provider, degraded, referenced, rate, passed",
    [
        (0.9, 5, "mock", None, None, None, None),
        (0.9, 0, "given", None, None, None, None),
        (0.9, 5, "given", None, None, None, True),
        (0.5, 5, "given", None, None, None, False),
        (0.9, 5, "given", False, 3, 1.0, True),
        (0.9, 5, "given", False, 3, 0.8, False),
        (0.9, 5, "given", False, 0, None, False),
        (0.9, 5, "given", True, 0, None, True),
    ],
)
def test_gate(spark, recall, cases, provider, degraded, referenced, rate, passed):
    lit = lambda v, t: F.lit(v).cast(t)
    got = spark.range(1).select(evaluate.gate(lit(recall, "double"), lit(cases, "int"), lit(provider, "string"), lit(degraded, "boolean"), lit(referenced, "int"), lit(rate, "double")).alias("x"))
    assert got.first()["x"] is passed


def test_golden_is_loaded_and_validated(spark, tmp_path):
    cases = [
        {"id": "a", "query": "what is it", "expect_doc": "d", "anchor": "anchor"},
        {"id": "a", "query": "what", "expect_doc": "d", "anchor": "anchor"},
        {"id": "b", "query": "", "expect_doc": "d", "anchor": ""},
        {"query": "x"},
        {"id": "c", "query": "abc", "expect_doc": "d", "anchor": "anchor"},
    ]
    for n, payload in enumerate((cases, {"meta": 1, "cases": cases})):
        path = tmp_path / f"g{n}.json"
        path.write_text(json.dumps(payload), encoding="utf-8")
        got = [r["errors"] for r in evaluate.validated(evaluate.load_golden(spark, str(path))).orderBy("pos").collect()]
        assert got == [[], ["id 重复: a"], ["b 缺字段: ['query', 'anchor']"], ["#3 缺字段: ['id']"], ["c query/anchor 过短，无法定位"]]


def test_anchors_ignore_space_and_case(spark):
    blocks = frame(spark, [("a:0", "a", "Nous  Research\n开源"), ("b:1", "b", "x nousresearch开源 y"), ("b:2", "b", "no")], "block_id string, doc_id string, text string")
    cases = frame(spark, [("q", "a", "nous research 开源"), ("z", "a", "missing"), ("e", "a", " ")], "id string, expect_doc string, anchor string")
    got = {(r["id"], r["block_id"], r["elsewhere"]) for r in evaluate.located(cases, blocks).collect()}
    assert got == {("q", "a:0", False), ("q", "b:1", True)}


def test_traceability_counts_null_ids(spark):
    sources = frame(spark, [("x", "a:0"), ("x", None), ("y", "a:0")], "id string, block_id string")
    got = {r["id"]: (r["source_count"], r["untraceable"], r["traceable"]) for r in evaluate.traceability(sources, frame(spark, [("a:0",)], "block_id string")).collect()}
    assert got == {"x": (2, 1, False), "y": (1, 0, True)}


BLOCKS = "block_id string, doc_id string, title string, source_file string, page int, doc_date string, doc_year int, image_ids array<string>, text string, embedding array<float>"


def store(spark):
    rows = [
        ("t24:0", "t24", "天力2024", None, 1, "2024", 2024, None, "甲", [1.0, 0.0]),
        ("z25:0", "z25", "振华2025", None, 2, "2025", 2025, ["i-1"], "乙 [IMAGE:i-1]", [0.0, 1.0]),
        ("z25:1", "z25", "振华2025", None, 3, "2025", 2025, None, "丙", [0.1, 0.9]),
        ("n:0", "n", "", "n.txt", None, None, None, None, "丁", [0.5, 0.5]),
    ]
    return frame(spark, rows, BLOCKS)


def test_year_arbitration(spark):
    q = frame(spark, [("own", [2025], [0.0, 1.0]), ("off", [2024], [0.0, 1.0]), ("empty", [2001], [0.0, 1.0]), ("none", None, [0.0, 1.0])], "query_id string, years array<int>, embedding array<float>")
    got = {}
    for r in retrieval.year_aware(q, store(spark), 3).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["block_id"], r["note"] is not None))
    assert got["own"] == [("z25:0", False), ("z25:1", False)]
    assert got["off"] == [("z25:0", True), ("z25:1", True), ("n:0", True)]
    assert got["empty"] == got["off"]
    assert got["none"] == [(b, False) for b, _ in got["off"]]


def test_answers(spark):
    q = frame(spark, [(1, "振华2025年营收？", [0.0, 1.0]), (2, "你好", [0.0, 1.0])], "query_id int, question string, embedding array<float>")
    model = lambda context, question: "结论[1][9]。" if "[1]（来源：振华2025，第 2 页，文档日期 2025）" in context else None
    got = {r["query_id"]: r for r in qa.answered(q, store(spark), model, 2).collect()}
    assert got[1]["answer"] == "结论[1]。" and [s["document_name"] for s in got[1]["sources"]] == ["振华2025"]
    assert got[1]["sources"][0]["snippet"] == "乙 (图)" and got[1]["sources"][0]["image_ids"] == ["i-1"]
    assert got[2]["answer"] == qa.GREETING and got[2]["sources"] == []
    bare = {r["query_id"]: r for r in qa.answered(q, store(spark), None, 2).collect()}
    assert bare[1]["degraded"] and bare[1]["answer"].startswith(qa.NO_MODEL)
    nothing = {r["query_id"]: r for r in qa.answered(q, store(spark).limit(0), model, 2).collect()}
    assert nothing[1]["answer"] == qa.NOTHING and nothing[1]["note"] == "检索无命中"


def test_page_gate(spark):
    texts = ["", "a" * 30, "b" * 200, "C" * 200, "ok " * 50 + "�", "汉" * 100]
    df = frame(spark, [("d", i, t) for i, t in enumerate(texts, 1)], "doc_id string, page int, text string")
    judged = quality_gate.judged(df, F.col("text"), F.lit(0), F.lit(0))
    assert [r["verdict"] for r in judged.orderBy("page").collect()] == ["红", "黄", "绿", "红", "红", "绿"]
    s = quality_gate.summary(judged).first()
    assert (s["red"], s["yellow"], s["green"], s["red_pages"]) == (3, 1, 2, [1, 4, 5]) and s["notes"][0] == "P1: 覆盖率极低(0字符,疑似纯图页)"


def test_transcripts(spark):
    pages = frame(spark, [("d", p, bytearray(b"bad" if p == 2 else b"ok")) for p in (1, 2, 3)], "doc_id string, page int, image binary")

    def read(image, model):
        if image == b"bad":
            raise TimeoutError("late")
        return "text", 10, 5

    got = {r["page"]: (r["text"], r["error"]) for r in transcribe.transcribed(pages, read, most=2).collect()}
    assert got == {1: ("text", None), 2: (None, "TimeoutError: late")}


def test_models_that_fail_stop_no_question(spark):
    q = frame(spark, [(1, "甲是什么", [1.0, 0.0]), (2, "丙是什么", [0.0, 1.0])], "query_id int, question string, embedding array<float>")

    def model(context, question):
        if "甲" in question:
            raise ValueError("refused")
        return qa.Reply("答[1]", 7, 3)

    got = {r["query_id"]: r for r in qa.answered(q, store(spark), model, 2).collect()}
    assert got[1]["degraded"] and got[1]["prompt_tokens"] == 0
    assert not got[2]["degraded"] and got[2]["answer"] == "答[1]" and (got[2]["prompt_tokens"], got[2]["completion_tokens"]) == (7, 3)
    one = qa.answer_one(spark, store(spark).withColumn("embedding", F.array(*[F.lit(0.1)] * 256).cast("array<float>")), "丙是什么", model=model)
    assert one["answer"] == "答[1]" and one["usage"] == {"prompt_tokens": 7, "completion_tokens": 3, "total_tokens": 10} and one["seconds"] > 0


def test_answers_are_evaluated(spark, tmp_path):
    from docloom import cli
    from docloom.plans import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("the boats leave at nine in the morning", encoding="utf-8")
    golden = tmp_path / "g.json"
    golden.write_text(json.dumps([{"id": "1", "query": "when do boats leave", "expect_doc": "a", "anchor": "boats leave at nine"}, {"id": "2", "query": "hi", "expect_doc": "a", "anchor": "morning"}]), encoding="utf-8")
    ingest.ingest(spark, [str(folder)], str(tmp_path / "s"), F.lit("2026-01-01").cast("timestamp")).collect()
    report = cli.evaluation(spark, str(golden), str(tmp_path / "s"), 3, model=lambda context, question: qa.Reply("At nine [1].", 5, 2), answers=True)
    layer = report["answers"]
    assert (layer["cases_total"], layer["referenced_cases"], layer["traceable_rate"], layer["total_tokens"], layer["degraded"]) == (1, 1, 1.0, 7, False)
    assert layer["rows"][0]["source_count"] == 1 and layer["rows"][0]["traceable"] and report["retrieval"]["metrics"]["recall"] == 1.0
    assert layer["elapsed_s"] > 0 and report["retrieval"]["elapsed_s"] > 0 and any("2" in d for d in report["defects"])
    cli.write_text(spark, str(tmp_path / "r.json"), "é")
    assert (tmp_path / "r.json").read_text(encoding="utf-8") == "é"
    assert cli.evaluation(spark, str(golden), str(tmp_path / "s"), 3)["answers"] is None


def test_year_arbitration_is_limited_before_the_shuffle(spark):
    q = frame(spark, [("own", [2025], [0.0, 1.0])], "query_id string, years array<int>, embedding array<float>")
    plan = retrieval.year_aware(q, store(spark), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def _near(spark):
    """Blocks of small whole components, so many distances are equal, and rows without a sound vector; queries with years and without."""
    rows = [(f"b{i * 37 % 400:03d}", f"d{i % 9}", 2000 + i % 7 if i % 5 else None, [float(i % 3), float(i * 7 % 4), float(i % 2)]) for i in range(400)]
    odd = [("x0", "d", 2001, None), ("x1", "d", 2001, [float("nan"), 0.0, 0.0]), ("x2", "d", 2001, [1.0]), ("x3", "d", 2001, [1.0, None, 0.0])]
    blocks = frame(spark, rows + odd, "block_id string, doc_id string, doc_year int, embedding array<float>").repartition(5)
    asked = [(i, [[2001, 2003], None, [2099]][i % 3], [0.1 * i, 1.0, 0.5]) for i in range(12)]
    return rows, blocks, asked, frame(spark, asked, "query_id int, years array<int>, embedding array<float>")


def _plain(rows, v, k, years=None):
    v = np.array(v, np.float32).astype(float)
    dist = sorted((sum((a - b) ** 2 for a, b in zip(v, e)), b) for b, _, y, e in rows if years is None or y in years)
    return [(n, b, d) for n, (d, b) in enumerate(dist[:k], 1)]


def test_search_estimates_in_batches_and_is_exact(spark):
    rows, blocks, asked, q = _near(spark)
    found = retrieval.search(q.drop("years"), blocks.drop("doc_year"), 6)
    assert "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = {i: [] for i, _, _ in asked}
    for r in found.orderBy("rank").collect():
        got[r["query_id"]].append((r["rank"], r["block_id"], r["distance"]))
    assert got == {i: _plain(rows, v, 6) for i, _, v in asked}
    assert retrieval.search(q.drop("years"), blocks.where("block_id = 'b003'"), 6).count() == 12
    assert retrieval.search(q.drop("years").limit(0), blocks, 6).count() == 0


def test_embedding_of_batches_is_that_of_each_text(spark):
    texts = ["", None, "a", "ab", "你好，ab 你好", "x" * 50, "é😀é😀", "the cat and the hat"]
    many = embedding.Bigrams().matrix(texts)
    for t, v in zip(texts, many):
        c = embedding.Bigrams().counts(t).astype(float)
        assert v.tolist() == (c / (np.sqrt((c**2).sum()) or 1.0)).tolist()


def test_search_by_years_estimates_in_batches_and_is_exact(spark):
    rows, blocks, asked, q = _near(spark)
    found = retrieval.year_aware(q, blocks, 4)
    assert "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = {i: [] for i, _, _ in asked}
    for r in found.orderBy("rank").collect():
        got[r["query_id"]].append((r["rank"], r["block_id"], r["distance"]))
    of = {b: d for b, d, _, _ in rows}
    for i, years, v in asked:
        any_year, own = _plain(rows, v, 4), _plain(rows, v, 4, years) if years else []
        assert got[i] == (own if any(of[b] == of[any_year[0][1]] for _, b, _ in own) else any_year)
