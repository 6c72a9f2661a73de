"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.llm import ann, decontaminate, html_text, language, licenses, line_dedup, mixing, ngram_join, quality, sharding
from docloom.session import table


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op2_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=85)


def op4_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text_crc32", F.crc32(F.col("text").cast("binary")))
    return sharding.shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_suffix_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.octet_length("text").alias("kept_bytes"), F.md5("text").alias("kept_md5"))


def op6_output_code_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.select("doc_id", "text", "lang"))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def op7_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_prefix_forest": op1_prefix_forest,
    "op2_additive_quality": op2_additive_quality,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_histogram_shards": op4_histogram_shards,
    "op5_suffix_line_dedup": op5_suffix_line_dedup,
    "op6_output_code_language": op6_output_code_language,
    "op7_template_removal": op7_template_removal,
    "op8_patience_licenses": op8_patience_licenses,
    "op9_systematic_mix": op9_systematic_mix,
    "op10_pigeonhole_decontamination": op10_pigeonhole_decontamination,
}

#: DuckDB SQL; the other queries are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op5_suffix_line_dedup": r"""
with l as (
  select doc_id, i - 1 as i, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) as words
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
),
blocks as (
  select *, line as b1,
    line || chr(10) || lead(line, 1) over d as b2,
    line || chr(10) || lead(line, 1) over d || chr(10) || lead(line, 2) over d as b3,
    words + lead(words, 1) over d as w2,
    words + lead(words, 1) over d + lead(words, 2) over d as w3
  from l window d as (partition by doc_id order by i)
),
firsts as (
  select doc_id, i, words, w2, w3,
    first_value(doc_id) over p1 = doc_id and first_value(i) over p1 = i as f1,
    b2 is null or first_value(doc_id) over p2 = doc_id and first_value(i) over p2 = i as f2,
    b3 is null or first_value(doc_id) over p3 = doc_id and first_value(i) over p3 = i as f3
  from blocks
  window p1 as (partition by b1 order by doc_id, i), p2 as (partition by b2 order by doc_id, i), p3 as (partition by b3 order by doc_id, i)
),
blanks as (
  select doc_id, i, line, words, before, after,
    string_agg(line, chr(10)) over (partition by doc_id, before order by i) as from_words,
    string_agg(line, chr(10)) over (partition by doc_id, after order by i desc) as to_words
  from (
    select *, max(case when words > 0 then i end) over (partition by doc_id order by i) as before,
      min(case when words > 0 then i end) over (partition by doc_id order by i rows between current row and unbounded following) as after
    from l
  )
),
far as (
  select doc_id, i from (
    select doc_id, i, first_value(doc_id) over p = doc_id and first_value(before) over p = before as f
    from blanks where words = 0 and i - before >= 3 window p as (partition by from_words order by doc_id, before)
  ) where not f
  union
  select doc_id, i from (
    select doc_id, i, first_value(doc_id) over p = doc_id and first_value(i) over p = i as f
    from blanks where words = 0 and after - i >= 3 window p as (partition by to_words order by doc_id, i)
  ) where not f
),
goes as (
  select doc_id, i, case when not f3 and w3 > 0 then 3 when not f2 and w2 >= 50 then 2 when not f1 and words >= 50 then 1 else 0 end as goes from firsts
),
gone as (
  select doc_id, i, far.i is not null or greatest(goes, coalesce(lag(goes, 1) over d, 0) - 1, coalesce(lag(goes, 2) over d, 0) - 2) > 0 as gone
  from goes left join far using (doc_id, i) window d as (partition by doc_id order by i)
)
select doc_id, count(*)::int as n_lines, (count(*) filter (where gone))::int as n_removed,
  strlen(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), ''))::int as kept_bytes,
  md5(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_md5
from l join gone using (doc_id, i) group by doc_id
""",
}
