"""Ingest: files to blocks, blocks to a snapshot, and a report of each file."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.functions import text as X
from docloom.operators import chunking, images, json_blocks, layout, quality_gate, store, transcribe
from docloom.operators.embedding import Provider, embed
from docloom.session import Workspace
from docloom.sources import files as S, ooxml, pdf

PAGED = ooxml.BLOCKS


def file_blocks(found: DataFrame) -> DataFrame:
    """Detected files (S.detected) with error, quality (of PDF pages), images, and blocks: array<struct<page, b>>.

    Each type is its own branch of the plan, so that only its readers run on it.
    """
    none, no_images, no_quality = F.array().cast(PAGED), F.lit(None).cast(ooxml.IMAGES), F.lit(None).cast(quality_gate.QUALITY)
    unpaged = lambda blocks: F.transform(blocks, lambda b: F.struct(F.lit(None).cast("int").alias("page"), b.alias("b")))
    keep = [c for c in found.columns if c not in ("content", "error", "images", "blocks", "quality")]

    def shaped(rows: DataFrame, blocks: Column, images: Column = no_images, quality: Column = no_quality) -> DataFrame:
        return rows.select(*keep, "error", quality.alias("quality"), images.cast(ooxml.IMAGES).alias("images"), blocks.cast(PAGED).alias("blocks"))

    good = found.where(F.col("error").isNull())
    of = lambda kind: good.where(F.col("document_type") == kind)
    out = shaped(found.where(F.col("error").isNotNull() | F.col("document_type").isNull()), none)
    for kind, cut in (("markdown", chunking.markdown), ("txt", chunking.plain_text)):
        out = out.unionByName(shaped(of(kind).withColumn("_text", S.as_text(F.col("content"))), unpaged(cut(F.col("_text")))))
    parsed = json_blocks.with_json(of("json").withColumn("_text", S.as_text(F.col("content"))).drop("error"), "_text")
    out = out.unionByName(shaped(parsed, unpaged(F.col("blocks"))))
    for kind in ("word", "excel", "slides"):
        rows = ooxml.office_blocks(of(kind), kind)
        out = out.unionByName(shaped(rows, F.col("blocks"), F.col("images")))
    rows = pdf.with_pages(of("pdf"))
    parts = F.transform("pages", lambda p: layout.page_parts(p["items"], p["page_height"])).cast(f"array<array<{layout.PART}>>")
    quality = quality_gate.document_quality(F.col("pages"), pdf.judgement).cast(quality_gate.QUALITY)
    rows = rows.select(*keep, "error", "images", quality.alias("quality"), F.transform("pages", lambda p: p["page"]).alias("_pages"), parts.alias("_parts"))
    rows = layout.chain_rows(rows, "_parts")
    paged = F.zip_with("_pages", "_parts", lambda p, q: F.transform(layout.page_blocks(q, p), lambda b: F.struct(p.alias("page"), b.alias("b"))))
    return out.unionByName(shaped(rows, F.coalesce(F.flatten(paged).cast(PAGED), none), F.col("images"), F.col("quality")))


def block_rows(cut: DataFrame) -> DataFrame:
    """One row a block, in the schema of the store."""
    date = X.doc_date(F.col("doc_id"))
    rows = cut.select("doc_id", "file_name", "document_type", F.posexplode("blocks").alias("block_seq", "x"))
    ids = X.image_ids(F.col("x.b.text"))
    return rows.select(
        "doc_id",
        "block_seq",
        F.concat_ws(":", "doc_id", "block_seq").alias("block_id"),
        F.col("doc_id").alias("title"),
        F.col("x.page").alias("page"),
        F.col("x.b.section").alias("section"),
        F.col("x.b.block_type").alias("block_type"),
        F.col("file_name").alias("source_file"),
        F.col("document_type").alias("format"),
        F.when(F.size(ids) > 0, ids).alias("image_ids"),
        date.alias("doc_date"),
        X.doc_year(date).alias("doc_year"),
        F.col("x.b.text").alias("text"),
    )


def red_pages(found: DataFrame, cut: DataFrame, renderer: Callable[[bytes, int], bytes] | None = None) -> DataFrame:
    """(doc_id, page, image) of the red pages of PDF files: found has their content, cut their verdicts.

    renderer: the file's bytes and a page to an image; without one the image is the whole file.
    """

    @F.pandas_udf("binary")
    def drawn(content: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([renderer(c, p) for c, p in zip(content, page)], dtype=object)

    image = F.col("content") if renderer is None else drawn("content", "page")
    red = cut.where((F.col("document_type") == "pdf") & (F.size("quality.red_pages") > 0)).select("path", F.explode("quality.red_pages").alias("page"))
    return found.where(F.col("document_type") == "pdf").select("path", "doc_id", "content").join(red, "path").select("doc_id", "page", image.alias("image"))


def with_transcripts(cut: DataFrame, told: DataFrame | None, most: int = transcribe.MOST) -> DataFrame:
    """cut with transcribed pages, a block each behind all others, and transcription: pages, failed, tokens, and a note for the report.

    Pages that could not be read, and all where there is no transcriber (told is None), keep the text they have.
    """
    red = F.when(F.col("document_type") == "pdf", F.coalesce(F.size("quality.red_pages"), F.lit(0))).otherwise(0)
    if told is None:
        note = F.when(red > 0, F.concat(F.lit("未配转录模型："), red.cast("string"), F.lit(" 个红页未转录（保持原文入库）")))
        return cut.withColumn("transcription", F.struct(F.lit(0).alias("pages"), F.lit(0).cast("long").alias("tokens"), note.alias("note")))
    good = F.col("text").isNotNull() & (F.trim("text") != "")
    blocks = F.transform(layout.transcript_blocks(F.col("text"), F.col("page")), lambda b: F.struct(F.col("page").alias("page"), b.alias("b")))
    a_doc = told.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(good, F.struct("page", blocks.alias("b"))))).alias("_told"),
        F.array_sort(F.collect_list(F.when(~good, F.col("page")))).alias("_lost"),
        F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), F.lit(0)).cast("long").alias("_tokens"),
    )
    lost, over = F.coalesce(F.size("_lost"), F.lit(0)), red - most
    note = F.concat_ws(
        "；",
        F.when(lost > 0, F.concat(lost.cast("string"), F.lit(" 页转录失败保留原文: P["), F.array_join(F.slice("_lost", 1, 5), ", "), F.lit("]"))),
        F.when(over > 0, F.concat(F.lit("超过单文档转录上限，"), over.cast("string"), F.lit(" 页未转录"))),
    )
    rows = cut.join(a_doc.hint("merge"), "doc_id", "left")
    count = F.coalesce(F.size("_told"), F.lit(0))
    taken, told_blocks = F.transform("_told", lambda p: p["page"]), F.flatten(F.transform("_told", lambda p: p["b"])).cast(PAGED)
    # A transcript takes the place of what the page had.
    blocks = F.when(count > 0, F.concat(F.filter("blocks", lambda b: b["page"].isNull() | ~F.array_contains(taken, b["page"])), told_blocks)).otherwise(F.col("blocks"))
    state = F.struct(count.alias("pages"), F.coalesce("_tokens", F.lit(0).cast("long")).alias("tokens"), F.nullif(note, F.lit("")).alias("note"))
    return rows.withColumns({"blocks": blocks, "transcription": state}).drop("_told", "_lost", "_tokens")


def ingest(
    spark: SparkSession, paths: list[str], target: str, now: Column | None = None, provider: Provider | None = None, rebuild: bool = False,
    image_folder: str | None = None, transcriber: transcribe.Transcriber | None = None, renderer: Callable[[bytes, int], bytes] | None = None, dump_folder: str | None = None,
) -> DataFrame:
    """Brings files into the snapshots at ``target``; one report row a file.  Files that fail do not touch the others."""
    now = F.current_timestamp() if now is None else now
    found = S.detected(S.read_files(spark, paths))
    return ingest_blocks(file_blocks(found), target, now, provider, rebuild, image_folder, found, transcriber, renderer, dump_folder)


def ingest_blocks(
    cut: DataFrame, target: str, now: Column, provider: Provider | None = None, rebuild: bool = False, image_folder: str | None = None,
    found: DataFrame | None = None, transcriber: transcribe.Transcriber | None = None, renderer: Callable[[bytes, int], bytes] | None = None, dump_folder: str | None = None,
) -> DataFrame:
    """The same from cut files.  What was cut is kept in the shared folder for the store, the images and the report, so files are read once.

    found and transcriber: files with red pages are read again, and the pages transcribed.  dump_folder: a readable text of each document's blocks goes there.
    """
    spark = cut.sparkSession
    work = Workspace(spark, "ingest")
    cut = work.save(cut, "cut", keep=True)
    told = None
    if transcriber is not None and found is not None:
        told = work.save(transcribe.transcribed(red_pages(found, cut, renderer), transcriber), "told", keep=True)
    cut = with_transcripts(cut, told)
    if dump_folder:
        # One file a document; Spark's part files lie in its folder, so that any file system will do.
        chunk_dump(block_rows(cut)).select("doc_id", F.col("dump").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(dump_folder)
    reports = store.Snapshots(spark, target).upsert(block_rows(cut), embed(provider), now, rebuild)
    rows = cut.select("doc_id", "file_name", "document_type", "detected_by", "quality", "error", F.size("blocks").alias("_n"), F.coalesce(F.size("images"), F.lit(0)).alias("images"), "transcription")
    saved = F.lit(0)
    joined = rows.join(reports, "doc_id", "left")
    if image_folder:
        found = cut.select("doc_id", F.explode("images").alias("i")).select("doc_id", "i.*")
        fresh = images.save(found, image_folder, now).groupBy("doc_id").agg(F.count("*").alias("_saved"))
        joined, saved = joined.join(fresh, "doc_id", "left"), F.coalesce("_saved", F.lit(0))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        F.col("file_name").alias("source_file"),
        "doc_id",
        store.status(F.col("error").isNotNull(), F.col("_n"), count("stored")).alias("status"),
        F.col("document_type").alias("format"),
        "detected_by",
        "quality",
        count("chunks").alias("chunks"),
        count("stored").alias("stored"),
        count("skipped").alias("skipped"),
        "images",
        saved.alias("images_saved"),
        "transcription",
        F.lit("given" if provider else "mock").alias("provider"),
        F.lit(provider is None).alias("degraded"),
        "error",
    )


def chunk_dump(blocks: DataFrame) -> DataFrame:
    """(doc_id, dump): the blocks of each document as one readable text, each led by a comment with what is known of it."""
    known = [("block_type", "block_type"), ("page", "page"), ("section", "section"), ("doc_date", "doc_date"), ("doc_year", "doc_year")]
    marks = [F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{n}="), F.col(c).cast("string"))) for n, c in known]
    images = F.when(F.size("image_ids") > 0, F.concat(F.lit("image_ids="), F.array_join("image_ids", ",")))
    head = F.concat_ws(" | ", F.concat(F.lit("块 "), F.col("block_seq").cast("string")), F.concat(F.lit("chars="), F.length("text").cast("string")), *marks, images)
    shown = F.concat(F.lit("<!-- "), head, F.lit(" -->\n\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("block_seq", shown.alias("t"))))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("dump"))


def report_line(report: DataFrame) -> DataFrame:
    """(doc_id, line): a report as one line of text."""
    mark = F.element_at(F.create_map(*[F.lit(x) for x in ("ok", "OK ", "skipped", "SKIP", "failed", "FAIL")]), F.col("status"))
    cell = F.when(F.col("quality").isNull(), "-").otherwise(F.format_string("红%d/黄%d/绿%d", "quality.red", "quality.yellow", "quality.green"))
    line = F.format_string("%s  %-32s %-10s块%4d 入%4d 跳%4d  %10s%s", mark, F.col("source_file"), F.coalesce("format", F.lit("None")), "chunks", "stored", "skipped", cell, F.when(F.col("degraded"), " (mock降级)").otherwise(""))
    return report.select("doc_id", F.concat(line, F.coalesce(F.concat(F.lit("\n       原因: "), "error"), F.lit(""))).alias("line"))
