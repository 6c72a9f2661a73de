"""The page-quality gate: verdicts red, yellow and green from a page's text and layout counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions import text as X
from docloom.functions.arrays import bound

# Thresholds and verdicts.
RED_BELOW, YELLOW_BELOW, LOWER_LEAST = 20, 80, 0.35
RED, YELLOW, GREEN = "红", "黄", "绿"
SIGNALS = ("chars", "cjk", "latin", "fffd", "lower_ratio", "tables", "imgs")
QUALITY = "struct<red:int,yellow:int,green:int,red_pages:array<int>,notes:array<string>>"


def judgement(text: Column, tables: Column, images: Column) -> Column:
    """struct of chars, cjk, latin, fffd, lower_ratio, tables, imgs, verdict and reasons; the signals are computed once."""

    def verdict(s: Column) -> Column:
        few, some = s["chars"] < RED_BELOW, s["chars"].between(RED_BELOW, YELLOW_BELOW - 1)
        broken, garbled = s["fffd"] > 0, F.coalesce(s["lower_ratio"] < LOWER_LEAST, F.lit(False))
        n = s["chars"].cast("string")
        reasons = F.concat_ws(
            "; ",
            F.when(few, F.concat(F.lit("覆盖率极低("), n, F.lit("字符,疑似纯图页)"))).when(some, F.concat(F.lit("覆盖率偏低("), n, F.lit("字符,可能含图)"))),
            F.when(broken, F.concat(F.lit("替换/控制符x"), s["fffd"].cast("string"))),
            F.when(garbled, F.concat(F.lit("乱码指纹(小写占比"), F.bround(s["lower_ratio"] * 100, 0).cast("int").cast("string"), F.lit("%)"))),
        )
        colour = F.when(few | broken | garbled, RED).when(some | (s["tables"] > 0) | (s["imgs"] > 0), YELLOW).otherwise(GREEN)
        return F.struct(*[s[c].alias(c) for c in SIGNALS], colour.alias("verdict"), reasons.alias("reasons"))

    signals = X.page_signals(text) | {"tables": tables, "imgs": images}
    return bound(F.struct(*[v.alias(k) for k, v in signals.items()]), verdict)


def judged(pages: DataFrame, text: Column, tables: Column, images: Column) -> DataFrame:
    """pages with the fields of their judgement."""
    return pages.withColumn("_j", judgement(text, tables, images)).select("*", "_j.*").drop("_j")


def document_quality(pages: Column, judge) -> Column:
    """struct<red, yellow, green, red_pages, notes> of an array of pages; judge(page) is its judgement."""
    count = lambda j, v: F.size(F.filter(j, lambda x: x["j"]["verdict"] == v))

    def summed(j: Column) -> Column:
        red = F.filter(j, lambda x: x["j"]["verdict"] == RED)
        noted = F.filter(red, lambda x: x["j"]["reasons"] != "")
        return F.struct(
            count(j, RED).alias("red"),
            count(j, YELLOW).alias("yellow"),
            count(j, GREEN).alias("green"),
            F.transform(red, lambda x: x["page"]).alias("red_pages"),
            F.transform(noted, lambda x: F.concat(F.lit("P"), x["page"].cast("string"), F.lit(": "), x["j"]["reasons"])).alias("notes"),
        )

    return bound(F.transform(pages, lambda p: F.struct(p["page"].alias("page"), judge(p).alias("j"))), summed)


def summary(pages: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """Per document: pages of each verdict, the red pages in order, and their notes.

    Pages go to arrays per document: a document's pages bound them.
    """
    red = F.col("verdict") == RED
    note = F.when(red & (F.col("reasons") != ""), F.struct(F.col(page).alias("p"), F.concat(F.lit("P"), F.col(page).cast("string"), F.lit(": "), F.col("reasons")).alias("note")))
    return pages.groupBy(doc).agg(
        F.count_if(red).alias("red"),
        F.count_if(F.col("verdict") == YELLOW).alias("yellow"),
        F.count_if(F.col("verdict") == GREEN).alias("green"),
        F.array_sort(F.collect_list(F.when(red, F.col(page)))).alias("red_pages"),
        F.transform(F.array_sort(F.collect_list(note)), lambda x: x["note"]).alias("notes"),
    )


def to_transcribe(summaries: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` red pages of each document: those a slow path may read again."""
    return summaries.withColumn("red_pages", F.slice("red_pages", 1, most))
