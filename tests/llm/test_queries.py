"""The registered queries and the pipeline on the driver's smallest tables."""

import os

import duckdb
import pytest

from docloom.llm import decontaminate
from docloom.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[columns].astype(str).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name, table", [("op2_additive_quality", "documents"), ("op3_ngram_jaccard", "documents"), ("op4_histogram_shards", "documents"), ("op6_output_code_language", "documents"), ("op7_template_removal", "pages"), ("op9_systematic_mix", "documents")])
def test_a_row_for_every_row(spark, duck, name, table):
    assert QUERIES[name](spark, SF).count() == duck.execute(f"select count(*) from {table}").fetchone()[0]


def test_held_out_accuracy(spark, duck):
    q = QUERIES["op2_additive_quality"](spark, SF).toPandas().merge(duck.execute("select doc_id, quality from labels").df(), on="doc_id")
    assert (q.predicted == q.quality).mean() > 0.95
    g = QUERIES["op6_output_code_language"](spark, SF).toPandas().merge(duck.execute("select doc_id, lang from documents").df(), on="doc_id")
    assert (g.lang_pred == g.lang)[g.held_out].mean() > 0.95


def test_exact_leaks_are_all_found(spark, duck):
    docs, items = (duck.execute(f"select * from {t}").fetchall() for t in ("(select doc_id, text from documents)", "(select item_id, text from benchmark)"))
    want = {(d, i) for d, t in docs for i, x in items if decontaminate.plain(x) in decontaminate.plain(t or "")}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op10_pigeonhole_decontamination"](spark, SF).collect()}
    assert want <= got


def test_pipeline(spark, duck):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).toPandas()
    leaks = {r["doc_id"] for r in QUERIES["op10_pigeonhole_decontamination"](spark, SF).collect()}
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op2_additive_quality"](spark, SF).collect()}
    assert len(out) and not set(out.doc_id) & leaks and all(scores[d] for d in out.doc_id)
    assert not out.drop_duplicates("doc_id").text.duplicated().any()
    assert sorted(out.groupby("shard").slot.max() + 1) == sorted(out.groupby("shard").size())
    assert {"doc_id", "text", "lang", "source", "n_chars", "size", "shard", "slot"} <= set(out.columns)
