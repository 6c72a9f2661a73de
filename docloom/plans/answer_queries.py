"""Registered queries of evaluation, answers, layout and embedding, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import embedding, evaluate, layout, qa, retrieval
from docloom.plans import sqltext as Q
from docloom.plans.registry import ORACLE_SQL, QUERIES, SQL_BLOCKS, SQL_PAIRS, SQL_YEARS, doc_blocks, docs_of, query, texts_of, vectors
from docloom.session import ship, table
from docloom.streaming import inbox

__all__ = ["QUERIES", "ORACLE_SQL"]

_SPACELESS = r"lower(regexp_replace({}, '\s', '', 'g'))"
_ANCHORED = f"""anchored as (select b.item_id, d.doc_id from benchmark b join documents d
  on contains({_SPACELESS.format('d.text')}, {_SPACELESS.format('b.text')}))"""


@query(f"with {_ANCHORED} select item_id::varchar as id, doc_id::varchar as block_id, doc_id % 20 <> item_id % 20 as elsewhere from anchored")
def j2_anchor_location(spark, d):
    cases = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), (F.col("item_id") % 20).cast("string").alias("expect_doc"), F.col("text").alias("anchor"))
    blocks = texts_of(spark, d).withColumn("block_id", F.col("doc_id").cast("string")).withColumn("doc_id", (F.col("doc_id") % 20).cast("string"))
    return evaluate.located(cases, blocks).select("id", "block_id", "elsewhere")


_SQL_OUTCOMES = f"""{SQL_PAIRS}, ranked as (select query_id, vec_id, row_number() over (partition by query_id order by dist, vec_id) as rank from pairs),
  expected as (select distinct query_id, vec_id from pairs where label = asked),
  outcomes as (select e.query_id, min(r.rank) filter (where r.rank <= 5)::int as rank from expected e left join ranked r using (query_id, vec_id) group by e.query_id)"""


def _outcomes(spark, d):
    q, e = vectors(spark, d)
    hits = retrieval.search(q, e, 5, F.col("vec_id") != F.col("query_id"), "vec_id").select(F.col("query_id").alias("id"), F.col("vec_id").alias("block_id"), "rank")
    cases = q.select(F.col("query_id").alias("id"), "asked")
    pairs = e.select(F.col("vec_id").alias("block_id"), "label").join(cases, (F.col("label") == F.col("asked")) & (F.col("block_id") != F.col("id")))
    return evaluate.outcomes(hits, pairs)


@query(f"with {_SQL_OUTCOMES} select query_id as id, rank is not null as hit, rank from outcomes")
def j3_case_outcomes(spark, d):
    return _outcomes(spark, d)


@query(
    f"""with {_SQL_OUTCOMES} select count(*) as cases, round(avg((rank is not null)::int), 4) as recall, coalesce(round(avg(1.0 / rank), 4), 0.0) as mrr,
  round(avg(coalesce(1.0 / rank, 0.0)), 4) as mrr_all from outcomes"""
)
def a3_a4_recall_mrr(spark, d):
    return evaluate.metrics(_outcomes(spark, d))


_SQL_SOURCES = "sources as (select conv_id as id, case when turn % 5 = 4 then null else turn + conv_id % 50 end as block_id from conversations)"
_SQL_KNOWN = "(select distinct item_id from benchmark) b on block_id = b.item_id"


def _traced(spark, d):
    block = F.when(F.col("turn") % 5 != 4, F.col("turn") + F.col("conv_id") % 50)
    sources = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), block.alias("block_id"))
    return evaluate.traceability(sources, table(spark, d, "benchmark").select(F.col("item_id").alias("block_id")))


@query(
    f"""with {_SQL_SOURCES} select id, count(*) as source_count, count(*) filter (where b.item_id is null) as untraceable,
  count(*) filter (where b.item_id is null) = 0 as traceable from sources left join {_SQL_KNOWN} group by id"""
)
def j4_traceability(spark, d):
    return _traced(spark, d)


@query(
    f"""with {_SQL_SOURCES}, t as (select id, count(*) filter (where b.item_id is null) = 0 as ok from sources left join {_SQL_KNOWN} group by id)
  select count(*) as referenced_cases, round(avg(ok::int), 4) as traceable_rate from t"""
)
def a5_traceable_rate(spark, d):
    return evaluate.traceable_rate(_traced(spark, d))


@query(
    """select sum(turn)::bigint as prompt_tokens, coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as completion_tokens,
  (sum(turn) + coalesce(sum(length(text)) filter (where role = 'assistant'), 0))::bigint as total_tokens from conversations"""
)
def a6_token_usage(spark, d):
    c = table(spark, d, "conversations")
    return evaluate.usage_total(c.select(F.col("turn").alias("prompt_tokens"), F.when(F.col("role") == "assistant", F.length("text")).alias("completion_tokens")))


@query(
    """select doc_id, case when doc_id % 5 = 0 or doc_id % 7 = 0 then null when doc_id % 100 < 80 then false when doc_id % 3 = 0 or doc_id % 4 = 0 then true
    else doc_id % 6 > 0 and doc_id % 8 = 1 end as passed from documents"""
)
def eval_gate(spark, d):
    n = F.col("doc_id")
    passed = evaluate.gate(
        (n % 100) / 100, n % 7, F.when(n % 5 == 0, "mock").otherwise("given"), n % 4 == 0, F.when(n % 3 != 0, n % 6), F.when(n % 8 == 1, 1.0).otherwise(0.5)
    )
    return docs_of(spark, d, passed.alias("passed"))


_CASES = """cases as (select item_id as pos, case when item_id % 9 = 0 then ' ' when item_id % 7 = 0 then 'dup' else 'c' || item_id end as id,
  case when item_id % 5 = 0 then null else repeat('q', (item_id % 6 + 1)::int) end as query, case when item_id % 4 = 0 then '' else 'doc' end as expect_doc, 'anchor' as anchor from benchmark)"""


@query(
    f"""with {_CASES}, m as (select *, trim(id) as tid, array_to_string(list_filter([case when trim(coalesce(query, '')) = '' then chr(39) || 'query' || chr(39) end,
      case when trim(expect_doc) = '' then chr(39) || 'expect_doc' || chr(39) end], lambda x: x is not null), ', ') as missing,
      row_number() over (partition by trim(id) order by pos) as nth from cases)
    select pos, case when tid = '' then '#' || pos || ' 缺字段: [' || chr(39) || 'id' || chr(39) || ']' else concat_ws(' / ', case when nth > 1 then 'id 重复: ' || tid end,
      case when missing <> '' then tid || ' 缺字段: [' || missing || ']' when length(query) < 4 then tid || ' query/anchor 过短，无法定位' end) end as errors from m"""
)
def f11_w5_golden_validation(spark, d):
    made = table(spark, d, "benchmark").selectExpr(
        "item_id as pos",
        "case when item_id % 9 = 0 then ' ' when item_id % 7 = 0 then 'dup' else 'c' || item_id end as id",
        "case when item_id % 5 = 0 then null else repeat('q', cast(item_id % 6 + 1 as int)) end as query",
        "case when item_id % 4 = 0 then '' else 'doc' end as expect_doc",
        "'anchor' as anchor",
    )
    return evaluate.validated(made).select("pos", F.array_join("errors", " / ").alias("errors"))


_SHOWN = Q.strip(r"regexp_replace(t, '\[IMAGE:[A-Za-z0-9_.-]+\]', '(图)', 'g')")


@query(
    f"""select doc_id, coalesce(nullif(title, ''), nullif(source, ''), '未知文档') as document_name, md5(substr({_SHOWN}, 1, 160)) as snippet
    from (select doc_id, case when doc_id % 3 = 0 then '' else 't' || doc_id end as title, case when doc_id % 6 = 0 then null else source end as source, '[IMAGE:a.b] ' || text as t from documents)"""
)
def f13_source_contract(spark, d):
    title = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("t"), F.col("doc_id").cast("string")))
    source = F.when(F.col("doc_id") % 6 != 0, F.col("source"))
    return docs_of(spark, d, X.document_name(title, source).alias("document_name"), F.md5(X.snippet(F.concat(F.lit("[IMAGE:a.b] "), F.col("text")))).alias("snippet"))


@query(
    """select doc_id, md5('[' || doc_id % 5 || ']（来源：' || source || case when doc_id % 4 > 0 then '，第 ' || doc_id % 4 || ' 页' else '' end ||
    case when doc_id % 2 = 0 then '，文档日期 2024' else '' end || '）' || chr(10) || substr(text, 1, 1500)) as block from documents"""
)
def f14_e4_prompt_block(spark, d):
    date = F.when(F.col("doc_id") % 2 == 0, "2024")
    block = X.prompt_block(F.col("doc_id") % 5, F.lit(None).cast("string"), F.col("source"), F.col("doc_id") % 4, date, F.col("text"))
    return docs_of(spark, d, F.md5(block).alias("block"))


@query(
    """select conv_id, turn, ['x', 'y', 'z'][(n)::int] as cited from (select conv_id, turn, unnest(case when turn % 4 between 1 and 3 and conv_id % 4 between 1 and 3 and turn % 4 <> conv_id % 4
  then [turn % 4, conv_id % 4] when turn % 4 between 1 and 3 then [turn % 4] when conv_id % 4 between 1 and 3 then [conv_id % 4] else [] end) as n from conversations)"""
)
def j7_citation_lookup(spark, d):
    answer = F.expr("concat('a[', turn % 4, ']b[', conv_id % 4, ']')")
    hits = F.array(F.lit("x"), F.lit("y"), F.lit("z"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.transform(X.cited(answer, F.lit(3)), lambda n: F.element_at(hits, n))).alias("cited"))


@query(
    """select doc_id, (('0x' || substr(md5(g), 1, 8))::bigint % 256)::int as bucket, count(*) as n
    from (select doc_id, substr(t, i, 2) as g from (select doc_id, text as t from documents), unnest(range(1, length(t))) as u(i)) group by all"""
)
def a9_bigram_histogram(spark, d):
    return embedding.histogram(texts_of(spark, d), F.col("text"))


@query(f"with {SQL_BLOCKS} select block_id, title from blocks qualify row_number() over (partition by md5(text) order by doc_id, block_seq) = 1")
def w5_first_occurrences(spark, d):
    blocks = doc_blocks(spark, d).select("block_id", "title", F.col("doc_id").cast("long").alias("n"), "block_seq", X.fingerprint(F.col("text")).alias("md5"))
    first = blocks.groupBy("md5").agg(F.min_by(F.struct("block_id", "title"), F.struct("n", "block_seq")).alias("f"))
    return first.select("f.block_id", "f.title")


@query(
    """select event_id, ts from events where event_type is null or event_type = 'view' union all
  (select event_id, ts from events where event_type <> 'view' order by ts desc, event_id limit 200)"""
)
def v2_v3_newest_jobs(spark, d):
    return inbox.retained(table(spark, d, "events"), F.col("event_type") != "view", "ts", "event_id", 200).select("event_id", "ts")


@query(
    """select doc_id, string_agg(w, ' ' order by (round_even(y / 8.0, 0)), x, i) as read_order from (
      select doc_id, i, trim(string_split(text, ' ')[i]) as w, ((i * 37 + doc_id) % 100) * 4.0 as y, ((i * 53) % 7) * 50.0 as x
      from documents, unnest(range(1, len(string_split(text, ' ')) + 1)) as u(i)) where w <> '' group by doc_id"""
)
def p1_p3_p4_reading_order(spark, d):
    span = lambda w: F.struct(w.alias("text"), F.lit(0.0).alias("x0"), F.lit(1.0).alias("x1"), F.lit(10.0).alias("size"))
    none = F.lit(None)

    def item(w, n):
        i = (n + 1).cast("long")
        x, y = ((i * 53) % 7) * 50.0, ((i * 37 + F.col("doc_id")) % 100) * 4.0
        return F.struct(
            F.lit("text").alias("kind"), x.alias("x0"), y.alias("y0"), (x + 10.0).alias("x1"), (y + 5.0).alias("y1"), F.array(F.array(span(w))).alias("lines"),
            none.cast("array<array<string>>").alias("rows"), none.cast("string").alias("image_id"),
        )

    found = F.transform(F.split("text", " ", -1), item).cast(layout.ITEMS)
    parts = layout.page_parts(found, F.lit(800.0))
    return texts_of(spark, d).select("doc_id", F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("read_order")).where("read_order <> ''")


@query("select n_regionkey, string_agg(n_nationkey || ' | ' || n_name, chr(10) order by n_nationkey) as shown from nation group by n_regionkey")
def p5_table_rendering(spark, d):
    row = F.array(F.col("n_nationkey").cast("string"), F.lit(None).cast("string"), F.concat(F.lit(" "), F.col("n_name"), F.lit("\n ")))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))).alias("x"))
    return rows.select("n_regionkey", layout.table_text(F.transform("x", lambda x: x["r"])).alias("shown"))


def _pages(spark, d):
    """Three documents in a row are the pages of one: a paragraph, with tables at the head and the foot."""
    lines = F.col("lines")
    span = lambda t: F.struct(t.alias("text"), F.lit(0.0).alias("x0"), F.lit(1.0).alias("x1"), F.lit(10.0).alias("size"))
    item = lambda kind, y0, y1, lines, rows: F.struct(
        F.lit(kind).alias("kind"), F.lit(0.0).alias("x0"), F.lit(y0).alias("y0"), F.lit(500.0).alias("x1"), F.lit(y1).alias("y1"),
        lines.alias("lines"), rows.alias("rows"), F.lit(None).cast("string").alias("image_id"),
    )
    no_lines, no_rows = F.lit(None).cast("array<array<struct<text:string,x0:double,x1:double,size:double>>>"), F.lit(None).cast("array<array<string>>")
    cells = F.col("cells")
    items = F.array(
        item("table", 10.0, 60.0, no_lines, cells),
        item("text", 100.0, 500.0, F.transform(lines, lambda x: F.array(span(x))), no_rows),
        item("table", 700.0, 790.0, no_lines, cells),
    ).cast(layout.ITEMS)
    docs = texts_of(spark, d).withColumn("lines", F.split("text", "\n", -1)).withColumn("cells", F.transform("lines", lambda x: F.split(x, " ", -1)))
    return docs.select(
        F.floor(F.col("doc_id") / 3).alias("doc_id"), (F.col("doc_id") % 3 + 1).cast("int").alias("page"), F.lit(800.0).alias("page_height"), items.alias("items"), "text"
    )


@query()
def c15_p7_p9_layout_blocks(spark, d):
    """Rows only: tables that cross pages are handed on in order; tests hold this against fixtures."""
    found = layout.laid_out_blocks(_pages(spark, d).drop("text"))
    return found.select("doc_id", "block_seq", "page", "section", "block_type", F.md5("text").alias("md5"))


@query()
def c15_p10_u1_transcripts(spark, d):
    """Rows only, as above, with transcripts in the place of some pages."""
    pages = _pages(spark, d)
    told = pages.where("doc_id % 4 = 0 and page = 2").select("doc_id", "page", "text")
    found = layout.laid_out_blocks(pages.drop("text"), told)
    return found.select("doc_id", "block_seq", "page", "section", "block_type", F.md5("text").alias("md5"))


_SQL_NEAR = f"""{SQL_BLOCKS}, named as (select 'b' as kind, block_id as id, text as t from blocks union all select 'q', item_id::varchar, text from benchmark),
  grams as (select kind, id, (('0x' || substr(md5(substr(t, i, 2)), 1, 8))::bigint % 256)::int as bucket, count(*) as n from named, unnest(range(1, length(t))) as u(i) group by all),
  filled as (select kind, id, map_from_entries(list((bucket, n))) as m, sqrt(sum(n * n)) as size from grams group by kind, id),
  vectors as (select n.kind, n.id, list_transform(range(256), lambda b: (coalesce(f.m[b::int], 0) / coalesce(f.size, 1.0))::float::double) as v from named n left join filled f using (kind, id)),
  near as (select q.id::bigint as query_id, b.id as block_id, list_distance(q.v, b.v) ^ 2 as dist from vectors q join vectors b on q.kind = 'q' and b.kind = 'b')"""


@query(f"""with {_SQL_NEAR} select query_id, rank, block_id, round(dist, 6) as distance from (
  select *, (row_number() over (partition by query_id order by dist, block_id))::int as rank from near) where rank <= 5""")
def e1_block_retrieval(spark, d):
    """The built-in embedding of all blocks, and the blocks nearest to the benchmark's items."""
    ship(spark)
    run = embedding.embed()
    blocks = doc_blocks(spark, d).withColumn("embedding", run("text")).select("block_id", "doc_id", "embedding")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), run("text").alias("embedding"))
    return retrieval.search(asked, blocks, 5).select("query_id", "rank", "block_id", F.round("distance", 6).alias("distance"))


_QUESTIONS = "case when item_id % 5 = 0 then 'hello' when item_id % 3 = 1 then concat(text, ' ', 2000 + item_id % 45) else text end"


@query(
    f"""with {_SQL_NEAR.replace("select 'q', item_id::varchar, text from", f"select 'q', item_id::varchar, {_QUESTIONS} from")},
    asked as (select item_id as query_id, {_QUESTIONS} as q, {SQL_YEARS.format(_QUESTIONS)} as ys from benchmark),
    routed as (select query_id, case when len(ys) > 0 then list_sort(list_distinct(list_transform(ys, lambda y: y::int))) end as years,
      length({Q.strip('q')}) <= 40 and (contains(lower(q), 'hi') or contains(lower(q), 'hello') or contains(q, '你好') or contains(q, '谢谢')) as greeting from asked),
    dated as (select n.*, b.doc_id, a.years, coalesce(list_contains(a.years, {SQL_YEARS.format('b.title')}[1]::int), false) as fits
      from near n join blocks b using (block_id) join routed a using (query_id) where not a.greeting),
    ranked as (select *, row_number() over (partition by query_id order by dist, block_id) as ra, row_number() over (partition by query_id, fits order by dist, block_id) as rf from dated),
    judged as (select query_id, max(doc_id) filter (where ra = 1) as top, list(doc_id) filter (where fits and rf <= {X.TOP_K}) as own, any_value(years) as years from ranked group by query_id)
    select query_id, case when greeting then '{qa.GREETING}' else '{qa.NO_MODEL}' || chr(10) || chr(10) || '{X.NO_SOURCE_HINT}' end as answer, 0 as sources,
      case when not greeting then concat_ws('；', case when r.years is not null and not coalesce(list_contains(own, top), false)
        then '知识库无 [' || array_to_string(r.years, ', ') || '] 年相关文档，已按语义不限年份检索（“' || top || '” 的近期文档）' end, 'chat 未可用（无 Key/调用失败）') end as note,
      not greeting as degraded from routed r left join judged using (query_id)"""
)
def qa_answers_without_model(spark, d):
    """Routing, search by years, and the answers given where no model can be reached."""
    ship(spark)
    run = embedding.embed()
    blocks = doc_blocks(spark, d).withColumn("embedding", run("text"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(_QUESTIONS).alias("question"))
    return qa.answered(asked.withColumn("embedding", run("question")), blocks).select("query_id", "answer", F.size("sources").alias("sources"), "note", "degraded")
