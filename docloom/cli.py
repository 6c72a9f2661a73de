"""Commands: ingest PATH... --store DIR [--rebuild] [--dump DIR];  eval GOLDEN --store DIR [--top-k N] [--answers] [--out FILE];  ask QUESTION --store DIR."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession, functions as F

from docloom.operators import evaluate, qa, retrieval, store
from docloom.operators.embedding import embed
from docloom.plans import ingest
from docloom.session import release, ship


def run_ingest(spark: SparkSession, paths: list[str], target: str, rebuild: bool, dump: str | None = None) -> int:
    """0: all well; 1: nothing to ingest; 2: some file failed."""
    rows = ingest.ingest(spark, paths, target, rebuild=rebuild, dump_folder=dump).persist()
    for r in ingest.report_line(rows).orderBy("doc_id").toLocalIterator():
        print(r["line"])
    total = store.batch_summary(rows).first()
    print(total.asDict())
    release(spark)  # the rows are told
    return 1 if not total["documents"] else 2 if total["failed"] else 0


def evaluation(spark: SparkSession, golden: str, target: str, k: int, provider=None, model: qa.Answerer | None = None, answers: bool = False) -> dict:
    """The report: metrics, the outcome of each case, defects of the cases, answers if asked for, the gate, and the time each part took."""
    ship(spark)
    began = time.perf_counter()
    cases = evaluate.validated(evaluate.load_golden(spark, golden))
    sound = cases.where(F.size("errors") == 0)
    blocks = store.Snapshots(spark, target).read()
    expected = evaluate.located(sound, blocks).persist()
    asked = sound.join(expected.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), embed(provider)(F.col("query")).alias("embedding"))
    hits = retrieval.search(asked, blocks.select("block_id", "doc_id", "embedding"), k).withColumnRenamed("query_id", "id").persist()
    rows = evaluate.outcomes(hits, expected)
    m = evaluate.metrics(rows)
    outcomes = [r.asDict() for r in rows.orderBy("id").collect()]
    seconds = round(time.perf_counter() - began, 2)
    layer = None
    if answers:
        began = time.perf_counter()
        questions = sound.select(F.col("id").alias("query_id"), F.col("query").alias("question"), embed(provider)(F.col("query")).alias("embedding"))
        said = qa.answered(questions, blocks, model, k).withColumnRenamed("query_id", "id").persist()
        layer = evaluate.answer_layer(said, blocks.select("block_id")).first().asDict()
        traced = evaluate.traceability(said.select("id", F.explode("sources").alias("s")).select("id", "s.block_id"), blocks.select("block_id"))
        told = said.select("id", "answer", "note").join(traced, "id", "left").withColumns({"source_count": F.coalesce("source_count", F.lit(0)), "untraceable": F.coalesce("untraceable", F.lit(0)), "traceable": F.coalesce("traceable", F.lit(True))})
        layer |= {"rows": [r.asDict() for r in told.orderBy("id").collect()], "elapsed_s": round(time.perf_counter() - began, 2)}
    name = F.lit("given" if provider else "mock")
    known = layer or {"degraded": None, "referenced_cases": None, "traceable_rate": None}
    passed = evaluate.gate(
        F.col("recall"), F.col("cases"), name, F.lit(known["degraded"]).cast("boolean"), F.lit(known["referenced_cases"]).cast("int"), F.lit(known["traceable_rate"]).cast("double")
    )
    m = m.withColumn("passed", passed).first().asDict()
    defects = [e for r in cases.where(F.size("errors") > 0).orderBy("pos").collect() for e in r["errors"]]
    defects += [f"{r['block_id']} 命中但 doc_id≠期望({r['expect_doc']})" for r in expected.where("elsewhere").orderBy("id", "block_id").collect()]
    return {
        "meta": {"golden": golden, "top_k": k, "provider": "given" if provider else "mock", "degraded": provider is None},
        "retrieval": {"metrics": m, "rows": outcomes, "elapsed_s": seconds},
        "answers": layer,
        "defects": defects,
        "gate": {"passed": m["passed"]},
    }


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A text to any file system Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    stream.write(text.encode("utf-8"))
    stream.close()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docloom")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest")
    one.add_argument("paths", nargs="+")
    one.add_argument("--store", required=True)
    one.add_argument("--rebuild", action="store_true")
    one.add_argument("--dump")
    two = commands.add_parser("eval")
    two.add_argument("golden")
    two.add_argument("--store", required=True)
    two.add_argument("--top-k", type=int, default=5)
    two.add_argument("--answers", action="store_true")
    two.add_argument("--out")
    three = commands.add_parser("ask")
    three.add_argument("question")
    three.add_argument("--store", required=True)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("docloom").getOrCreate()
    if given.command == "ingest":
        return run_ingest(spark, given.paths, given.store, given.rebuild, given.dump)
    if given.command == "ask":
        print(json.dumps(qa.answer_one(spark, store.Snapshots(spark, given.store).read(), given.question), ensure_ascii=False, indent=2))
        return 0
    report = evaluation(spark, given.golden, given.store, given.top_k, answers=given.answers)
    text = json.dumps(report, ensure_ascii=False, indent=2)
    if given.out:
        write_text(spark, given.out, text)
    print(text)
    return 2 if report["gate"]["passed"] is False else 0


if __name__ == "__main__":
    sys.exit(main())
