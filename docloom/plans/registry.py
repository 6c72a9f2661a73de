"""All registered queries of the engine and the SQL that states the same result.

The tables have no paragraphs, headings, years, citations or images of their own;
queries derive them from the rows in the same way in both engines, over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from docloom.functions import text as X
from docloom.operators import chunking as C, embedding, evaluate, images, json_blocks, layout, qa, quality_gate, retrieval, store
from docloom.plans import ingest, sqltext as Q
from docloom.session import spread, table
from docloom.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


TITLE = "concat('report_', 2000 + doc_id % 40, '-', doc_id % 14, '-', doc_id % 33)"
SQL_YEARS = "list_filter(regexp_extract_all({}, '[0-9]+'), lambda yy: regexp_full_match(yy, '20[0-2][0-9]'))"


def docs_of(spark, d, *columns):
    return table(spark, d, "documents").select("doc_id", *columns)


def texts_of(spark, d, *columns):
    """doc_id, text and more of all documents, over all cores: for work that is heavy to a text."""
    return spread(table(spark, d, "documents").select("doc_id", "text", *columns))


def _titled(spark, d, *columns):
    return docs_of(spark, d, *columns).withColumn("title", F.expr(TITLE))


def _text_blocks(found, **more):
    """(doc_id, block_seq, md5, chars) of an array of blocks; texts are compared by fingerprint."""
    return found.select("doc_id", F.posexplode("b").alias("block_seq", "x")).select("doc_id", "block_seq", F.md5("x.text").alias("md5"), F.length("x.text").alias("chars"))


def _strings(found):
    return found.select("doc_id", F.posexplode("b").alias("block_seq", "t")).select("doc_id", "block_seq", F.md5("t").alias("md5"), F.length("t").alias("chars"))


def _sql_blocks(expr: str, source: str = "documents") -> str:
    return f"""select doc_id, (i - 1)::int as block_seq, md5(t) as md5, length(t)::int as chars from (
      select doc_id, unnest(b) as t, generate_subscripts(b, 1) as i from (select doc_id, {expr} as b from {source}))"""


# ---- chunking


@query(_sql_blocks(Q.split("text")))
def c1_split_oversized(spark, d):
    return _strings(texts_of(spark, d).select("doc_id", C.split_oversized(F.col("text")).alias("b")))


@query(_sql_blocks(Q.cut("replace(text, '. ', '! ')")))
def c2_c3_sentences_with_overlap(spark, d):
    return _strings(texts_of(spark, d).select("doc_id", C.cut_paragraph(F.replace("text", F.lit(". "), F.lit("! "))).alias("b")))


@query(_sql_blocks(Q.pack("string_split(text, chr(10))")))
def c4_pack_lines(spark, d):
    return _strings(texts_of(spark, d).select("doc_id", C.pack(F.split("text", "\n", -1)).alias("b")))


@query(_sql_blocks(Q.windows("text")))
def c5_hard_windows(spark, d):
    return _strings(texts_of(spark, d).select("doc_id", C.windows(F.col("text")).alias("b")))


_HEADED = "list_transform(string_split(text, chr(10)), lambda ln, li: case when doc_id % 3 = 0 and (li - 1) % 7 = 6 then '```' when (li - 1) % 5 = 0 then repeat('#', (1 + (doc_id + li - 1) % 3)::int) || ' ' || ln else ln end)"


def _headed(spark, d):
    """Every 5th line a heading of level 1 to 3; in every third document every 7th line a fence."""
    line = lambda x, i: F.when((F.col("doc_id") % 3 == 0) & (i % 7 == 6), "```").when(
        i % 5 == 0, F.concat(F.repeat(F.lit("#"), (1 + (F.col("doc_id") + i) % 3).cast("int")), F.lit(" "), x)
    ).otherwise(x)
    return texts_of(spark, d).select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("md"))


_SQL_MARKDOWN = f"""
with recursive l as (
  select doc_id, i, regexp_replace(line, '\\s+$', '') as line, {Q.strip('line')} as bare
  from (select doc_id, unnest(b) as line, generate_subscripts(b, 1) as i from (select doc_id, {_HEADED} as b from documents))
),
f as (
  select *, starts_with(bare, '```') as fence,
    coalesce(sum(starts_with(bare, '```')::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as fenced
  from l
),
h as (select *, not fence and not fenced and regexp_full_match(bare, '#{{1,6}}\\s+.*') as head from f),
g as (
  select *, length(regexp_extract(bare, '^(#{{1,6}})\\s+(.*)$', 1)) as level, {Q.strip("regexp_extract(bare, '^(#{1,6})\\s+(.*)$', 2)")} as title,
    sum(head::int) over (partition by doc_id order by i) as n
  from h
),
heads as (select doc_id, n, level, title, row_number() over (partition by doc_id order by n) as k from g where head),
chain as (
  select doc_id, k, n, [title] as c from heads where k = 1
  union all
  select e.doc_id, e.k, e.n, list_append(a.c[1:e.level - 1], e.title) from chain a join heads e on e.doc_id = a.doc_id and e.k = a.k + 1
),
b as (
  select doc_id, n, {Q.strip("string_agg(case when head then title else line end, chr(10) order by i)")} as t from g group by doc_id, n
),
s as (select b.doc_id, b.n, b.t, array_to_string(c.c, ' / ') as section from b left join chain c on b.doc_id = c.doc_id and b.n = c.n where t <> ''),
p as (select doc_id, n, section, unnest(x) as t, generate_subscripts(x, 1) as j, length(t) > 1200 as long from (select *, {Q.fit('t')} as x from s))
select doc_id, (row_number() over (partition by doc_id order by n, j) - 1)::int as block_seq, nullif(section, '') as section,
  case when long then 'paragraph' else 'section' end as block_type, md5(t) as md5 from p
"""


@query(_SQL_MARKDOWN)
def c6_c7_markdown_sections(spark, d):
    found = _headed(spark, d).select("doc_id", F.posexplode(C.markdown(F.col("md"))).alias("block_seq", "x"))
    return found.select("doc_id", "block_seq", "x.section", "x.block_type", F.md5("x.text").alias("md5"))


@query(_sql_blocks(Q.plain("replace(text, chr(10), chr(10) || chr(10))")))
def c8_plain_text_paragraphs(spark, d):
    return _text_blocks(texts_of(spark, d).select("doc_id", C.plain_text(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("b")))


@query(
    """select event_id, 0 as block_seq, '$' || '.k' as section, json_extract_string(props, '$.k') as text from events"""
)
def c9_c10_json_elements(spark, d):
    rows = json_blocks.with_json(table(spark, d, "events").select("event_id", "props"), "props")
    return rows.select("event_id", F.posexplode("blocks").alias("block_seq", "x")).select("event_id", "block_seq", "x.section", "x.text")


@query(
    """select event_id, '$[0].k：' || json_extract_string(props, '$.k') || chr(10) || '$[0].user：' || user_id as text, '$[0]' as section from events"""
)
def c11_json_flatten(spark, d):
    made = F.concat(F.lit("["), F.regexp_replace("props", r"\}$", ""), F.lit(', "user": '), F.col("user_id").cast("string"), F.lit("}]"))
    rows = json_blocks.with_json(table(spark, d, "events").select("event_id", made.alias("made")), "made")
    return rows.select("event_id", F.explode("blocks").alias("x")).select("event_id", "x.text", "x.section")


def _record_sql(t: str, key: str, columns: list[str]) -> str:
    cells = ", ".join(f"case when trim({c}::varchar) <> '' then '{c}：' || trim({c}::varchar) end" for c in columns)
    return f"select {key}, concat_ws('；', {cells}) as text, '工作表 {t}' as section from {t}"


def _records(spark, d, t, key, columns):
    rows = table(spark, d, t)
    return rows.select(key, F.explode(C.records(rows, columns, t)).alias("x")).select(key, "x.text", "x.section")


@query(_record_sql("customer", "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]))
def c12_records_customer(spark, d):
    return _records(spark, d, "customer", "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


@query(_record_sql("part", "p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]))
def c12_records_part(spark, d):
    return _records(spark, d, "part", "p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])


@query(_record_sql("supplier", "s_suppkey", ["s_suppkey", "s_name", "s_nationkey"]))
def c12_records_supplier(spark, d):
    return _records(spark, d, "supplier", "s_suppkey", ["s_suppkey", "s_name", "s_nationkey"])


def doc_blocks(spark, d):
    """The blocks of documents whose lines are paragraphs, in the store's schema."""
    docs = texts_of(spark, d, "source").withColumn("title", F.expr(TITLE))
    cut = C.plain_text(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return C.blocks(docs.withColumn("doc_id", F.col("doc_id").cast("string")), cut, title=F.col("title"), source_file=F.col("source"))


SQL_BLOCKS = f"""blocks as (
  select doc_id, title, source, (i - 1)::int as block_seq, doc_id || ':' || (i - 1) as block_id, t as text from (
    select *, unnest(b) as t, generate_subscripts(b, 1) as i from (
      select doc_id, {TITLE} as title, source, {Q.plain("replace(text, chr(10), chr(10) || chr(10))")} as b from documents)))"""


@query(
    f"""with {SQL_BLOCKS},
    anchors as (select item_id, lower(regexp_replace(text, '\\s', '', 'g')) as a from benchmark),
    hit as (select distinct b.block_id from blocks b join anchors on contains(lower(regexp_replace(b.text, '\\s', '', 'g')), a))
    select source, count(distinct doc_id) as documents, count(*) as blocks, sum(length(text))::bigint as chars, count(distinct md5(text)) as distinct_texts,
      count(h.block_id) as anchored from blocks left join hit h using (block_id) group by source"""
)
def flagship_block_summary(spark, d):
    """Documents to blocks, fingerprints and located anchors, summed by source."""
    blocks = doc_blocks(spark, d)
    cases = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.lit("").alias("expect_doc"), F.col("text").alias("anchor"))
    hit = evaluate.located(cases, blocks).select("block_id").distinct().withColumn("hit", F.lit(1))
    marked = blocks.select("block_id", F.col("source_file").alias("source"), "doc_id", F.length("text").alias("n"), X.fingerprint(F.col("text")).alias("md5")).join(hit, "block_id", "left")
    return marked.groupBy("source").agg(
        F.countDistinct("doc_id").alias("documents"), F.count("*").alias("blocks"), F.sum("n").alias("chars"), F.countDistinct("md5").alias("distinct_texts"), F.count("hit").alias("anchored")
    )


@query(
    f"""with {SQL_BLOCKS},
    y as (select distinct title, {SQL_YEARS.format("title")} as ys,
      regexp_extract(title, '(20[0-2][0-9])-([0-9]+)-([0-9]+)', ['y', 'm', 'd']) as p from blocks),
    dated as (select title, case when p.y <> '' and try_cast(p.m as int) between 1 and 12 and try_cast(p.d as int) between 1 and 31
      then p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') when len(ys) > 0 then ys[1] end as doc_date from y)
    select doc_id::varchar as doc_id, block_seq, block_id, title, null::int as page, null::varchar as section, 'paragraph' as block_type, source as source_file,
      'txt' as format, doc_date, substr(doc_date, 1, 4)::int as doc_year, md5(text) as md5 from blocks join dated using (title)"""
)
def f15_w1_block_metadata(spark, d):
    return doc_blocks(spark, d).withColumn("md5", X.fingerprint(F.col("text"))).drop("text", "image_ids")


# ---- functions


@query(
    f"""select doc_id, title, doc_date, substr(doc_date, 1, 4)::int as doc_year from (select doc_id, title, case
      when p.y <> '' and try_cast(p.m as int) between 1 and 12 and try_cast(p.d as int) between 1 and 31 then p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0')
      when len(ys) > 0 then ys[1] end as doc_date
      from (select doc_id, {TITLE} as title, {SQL_YEARS.format(TITLE)} as ys, regexp_extract({TITLE}, '(20[0-2][0-9])-([0-9]+)-([0-9]+)', ['y', 'm', 'd']) as p from documents))"""
)
def x1_x2_doc_date(spark, d):
    date = X.doc_date(F.col("title"))
    return _titled(spark, d).withColumns({"doc_date": date, "doc_year": X.doc_year(date)})


_QUESTION = "concat('q', turn, ' ', 1990 + (conv_id * 7 + turn) % 60, ' vs ', 2000 + (conv_id + turn) % 35, ' id 20251234 ', 2000 + turn % 40)"


@query(f"""select conv_id, turn, case when len(y) > 0 then list_sort(list_distinct(list_transform(y, lambda v: v::int))) end as years
  from (select conv_id, turn, {SQL_YEARS.format(_QUESTION)} as y from conversations)""")
def f4_year_filter(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.question_years(F.expr(_QUESTION)).alias("years"))


@query(f"""with y as (select doc_id, {SQL_YEARS.format(TITLE)} as ys from documents)
  select doc_id, ys[1]::int as doc_year from y where len(ys) > 0 and ys[1]::int in (2003, 2011, 2024)""")
def f5_year_predicate(spark, d):
    rows = _titled(spark, d).select("doc_id", X.doc_year(X.doc_date(F.col("title"))).alias("doc_year"))
    return rows.where(retrieval.in_years(F.col("doc_year"), F.array(F.lit(2003), F.lit(2011), F.lit(2024))))


@query("select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_linenumber = 3")
def f6_equality_filter(spark, d):
    return store.where_equal(table(spark, d, "lineitem"), l_returnflag="R", l_linenumber=3).select("l_orderkey", "l_linenumber")


_ASKED = "case when conv_id % 3 = 0 then concat(role, ' ', turn) when conv_id % 3 = 1 then concat('Hello ', role) else text end"


@query(
    f"""select conv_id, turn, length(q) <= 40 and (contains(lower(q), 'hi') or contains(lower(q), 'hello') or contains(q, '你好') or contains(q, '谢谢')) as greeting
    from (select conv_id, turn, {Q.strip(_ASKED)} as q from conversations)"""
)
def f7_greeting_router(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.is_greeting(F.expr(_ASKED)).alias("greeting"))


@query("""select doc_id, regexp_full_match(trim(t), '[0-9]{1,4}') as page_number from (
  select doc_id, case when doc_id % 3 = 0 then concat(' ', doc_id, ' ') when doc_id % 3 = 1 then concat(doc_id * 1000, '') else text end as t from documents)""")
def f8_page_number(spark, d):
    made = F.expr("case when doc_id % 3 = 0 then concat(' ', doc_id, ' ') when doc_id % 3 = 1 then concat(doc_id * 1000, '') else text end")
    return docs_of(spark, d, X.is_page_number(made).alias("page_number"))


_PAGE = "case when doc_id % 13 = 0 then concat(text, chr(1)) when doc_id % 11 = 0 then source when doc_id % 7 = 0 then translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') when doc_id % 5 = 0 then repeat(source, 8) else text end"
_SQL_QUALITY = f"""judged as (select *, chars < 20 as few, chars between 20 and 79 as low, coalesce(lower_ratio < 0.35, false) as garbled from (
  select doc_id, source, length(regexp_replace(t, '\\s', '', 'g')) as chars, 0 as cjk, latin, len(regexp_extract_all(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) as fffd,
    case when latin >= 150 then len(regexp_extract_all(t, '[a-z]')) / latin end as lower_ratio, doc_id % 2 as tables, doc_id % 3 as imgs
  from (select doc_id, source, t, len(regexp_extract_all(t, '[A-Za-z]')) as latin from (select doc_id, source, {_PAGE} as t from documents)))),
verdicts as (select *, case when few or fffd > 0 or garbled then '红' when low or tables > 0 or imgs > 0 then '黄' else '绿' end as verdict,
  concat_ws('; ', case when few then '覆盖率极低(' || chars || '字符,疑似纯图页)' when low then '覆盖率偏低(' || chars || '字符,可能含图)' end,
    case when fffd > 0 then '替换/控制符x' || fffd end, case when garbled then '乱码指纹(小写占比' || round_even(lower_ratio * 100, 0)::int || '%)' end) as reasons from judged)"""


def _judged(spark, d):
    return quality_gate.judged(texts_of(spark, d, "source").select("doc_id", "source", F.expr(_PAGE).alias("t")), F.col("t"), F.col("doc_id") % 2, F.col("doc_id") % 3)


@query(f"with {_SQL_QUALITY} select doc_id, chars, cjk, latin, fffd, round(lower_ratio, 6) as lower_ratio, verdict, reasons from verdicts")
def f1_f2_f3_page_quality(spark, d):
    return _judged(spark, d).select("doc_id", "chars", "cjk", "latin", "fffd", F.round("lower_ratio", 6).alias("lower_ratio"), "verdict", "reasons")


@query(
    f"""with {_SQL_QUALITY} select source, count(*) filter (where verdict = '红') as red, count(*) filter (where verdict = '黄') as yellow,
    count(*) filter (where verdict = '绿') as green, array_to_string(list(doc_id order by doc_id) filter (where verdict = '红'), ',') as red_pages,
    array_to_string(list('P' || doc_id || ': ' || reasons order by doc_id) filter (where verdict = '红' and reasons <> ''), ' / ') as notes from verdicts group by source"""
)
def a1_quality_summary(spark, d):
    found = quality_gate.summary(_judged(spark, d), "source", "doc_id")
    blank = lambda c: F.when(F.size(c) > 0, c)
    return found.select("source", "red", "yellow", "green", F.array_join(blank(F.col("red_pages")), ",").alias("red_pages"), F.array_join(blank(F.col("notes")), " / ").alias("notes"))


@query(f"""with {_SQL_QUALITY} select source, array_to_string(list_sort(list(doc_id) filter (where verdict = '红'))[1:20], ',') as red_pages from verdicts group by source""")
def v4_page_cap(spark, d):
    found = quality_gate.to_transcribe(quality_gate.summary(_judged(spark, d), "source", "doc_id"))
    return found.select("source", F.array_join(F.when(F.size("red_pages") > 0, F.col("red_pages")), ",").alias("red_pages"))


@query("""select doc_id, 'doc' || doc_id || '-' || substr(md5(text), 1, 10) as image_id from documents""")
def x3_image_id(spark, d):
    return docs_of(spark, d, X.image_id(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.col("text").cast("binary")).alias("image_id"))


_PICTURED = "concat('a [IMAGE:p', doc_id % 5, '.x] ', text, ' [IMAGE:q-', doc_id % 3, '] [IMAGE:p', doc_id % 5, '.x] [IMAGE: bad]')"


@query(f"""select doc_id, concat('p', doc_id % 5, '.x,q-', doc_id % 3) as ids,
  md5(regexp_replace({_PICTURED}, '\\[IMAGE:[A-Za-z0-9_.-]+\\]', '(图)', 'g')) as shown from documents""")
def x4_a8_image_marks(spark, d):
    made = F.expr(_PICTURED)
    return docs_of(spark, d, F.array_join(X.image_ids(made), ",").alias("ids"), F.md5(X.images_shown(made)).alias("shown"))


@query("""select doc_id, md5(lower(regexp_replace(text, '\\s', '', 'g'))) as normal from documents""")
def x5_normalise(spark, d):
    return docs_of(spark, d, F.md5(X.normalise(F.col("text"))).alias("normal"))


_ANSWER = "concat('[', turn % 7, ']', text, '[', conv_id % 7, '][', turn % 7, ']')"
_SQL_CITED = f"""cited as (select conv_id, turn, {Q.strip(f"regexp_replace({_ANSWER}, '\\[(0*|0*[5-9]|0*[1-9][0-9]+)\\]', '', 'g')")} as answer,
  list_filter([turn % 7, conv_id % 7, turn % 7], lambda n: n between 1 and 4) as refs from conversations)"""


@query(
    f"""with {_SQL_CITED} select conv_id, turn, md5(answer || case when len(refs) = 0 then chr(10) || chr(10) || '{X.NO_SOURCE_HINT}' else '' end) as answer,
    array_to_string(case when len(refs) = 3 and refs[1] <> refs[2] then refs[1:2] when len(refs) > 0 then refs[1:1] || list_filter(refs[2:2], lambda r: r <> refs[1]) else [] end, ',') as refs from cited"""
)
def x6_x7_citations(spark, d):
    made, four = F.expr(_ANSWER), F.lit(4)
    refs = X.cited(made, four)
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.md5(X.with_hint(X.without_ghosts(made, four), refs, four)).alias("answer"), F.array_join(refs, ",").alias("refs")
    )


@query("""select doc_id, e as eta, case when e < 60 then e || ' 秒' else round_even(e / 60.0, 0)::int || ' 分钟' end as words from (
  select doc_id, greatest(15, case when doc_id % 3 > 0 then (doc_id % 50 + 1) * 2 else greatest(20, floor(n_chars * 100 / 1048576.0 * 20)) end)::int as e
  from documents)""")
def x10_eta(spark, d):
    pages = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 50 + 1)
    rows = docs_of(spark, d, "n_chars")
    eta = X.eta_seconds(pages, F.col("n_chars") * 100)
    return rows.select("doc_id", eta.alias("eta"), X.eta_words(eta).alias("words"))


@query(
    """select doc_id, case when e in ('pdf') then 'pdf' when e = 'docx' then 'word' when e in ('md', 'markdown') then 'markdown' when e in ('xlsx', 'xlsm') then 'excel'
    when e = 'json' then 'json' when e in ('txt', 'text') then 'txt' when e = 'pptx' then 'slides' end as document_type,
    case when e in ('doc', 'xls', 'ppt', 'bin', '') then null else 'extension' end as detected_by, e in ('doc', 'xls', 'ppt') as legacy
    from (select doc_id, ['pdf', 'docx', 'md', 'markdown', 'xlsx', 'xlsm', 'json', 'txt', 'text', 'pptx', 'doc', 'xls', 'ppt', 'bin', ''][(doc_id % 15 + 1)::int] as e from documents)"""
)
def s2_extension_detection(spark, d):
    names = ["PDF", "docx", "md", "markdown", "xlsx", "xlsm", "Json", "txt", "text", "pptx", "doc", "xls", "PPT", "bin", ""]
    ext = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % 15 + 1).cast("int"))
    path = F.concat(F.lit("/inbox/file."), F.col("doc_id").cast("string"), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(F.lit(".")))
    found = files.by_extension(F.col("extension"))
    rows = files.with_names(docs_of(spark, d, path.alias("path"), F.col("doc_id").alias("k")))
    return rows.withColumn("f", found).select(F.col("k").alias("doc_id"), "f.document_type", "f.detected_by", F.col("f.error").isNotNull().alias("legacy"))


_HEAD = "case when doc_id % 4 = 0 then concat('# ', text) when doc_id % 4 = 1 then concat('{\"k\": ', doc_id, '}') when doc_id % 4 = 2 then concat('{ ', text) else text end"


@query("""select doc_id, case doc_id % 4 when 0 then 'markdown' when 1 then 'json' else 'txt' end as document_type, 'content_sniffing:text' as detected_by from documents""")
def s3_s6_content_sniffing(spark, d):
    rows = docs_of(spark, d, F.lit("x.unknown").alias("path"), F.expr(_HEAD).cast("binary").alias("content"), F.col("doc_id").alias("k"))
    return files.detected(files.with_names(rows)).select(F.col("k").alias("doc_id"), "document_type", "detected_by")


@query(
    f"""with {SQL_BLOCKS} select doc_id::varchar as doc_id, md5(string_agg('<!-- 块 ' || block_seq || ' | chars=' || length(text) || ' | block_type=paragraph -->' || chr(10) || chr(10) || text,
    chr(10) || chr(10) order by block_seq)) as dump from blocks group by doc_id"""
)
def s15_block_dump(spark, d):
    blocks = doc_blocks(spark, d).withColumns({"doc_date": F.lit(None).cast("string"), "doc_year": F.lit(None).cast("int")})
    return ingest.chunk_dump(blocks).select("doc_id", F.md5("dump").alias("dump"))


# ---- store


_NEW = "case when doc_id % 4 = 0 then concat(text, '!') else text end"
_SQL_CHANGES = f"""changes as (select doc_id, source, md5(n) as md5, case when doc_id % 10 = 0 then 'added' when n = text then 'skipped' else 'changed' end as change
  from (select *, {_NEW} as n from documents))"""


def _changes(spark, d):
    docs = docs_of(spark, d, "source", "text")
    stored = docs.where("doc_id % 10 <> 0").select("doc_id", X.fingerprint(F.col("text")).alias("md5"))
    return store.classified(docs.withColumn("text", F.expr(_NEW)), stored, "doc_id")


@query(f"with {_SQL_CHANGES} select doc_id, md5, change from changes")
def j1_m1_m2_upsert_changes(spark, d):
    return _changes(spark, d).select("doc_id", "md5", "change")


@query(
    f"""with {_SQL_CHANGES} select source, count(*) as chunks, count(*) filter (where change <> 'skipped') as stored, count(*) filter (where change = 'skipped') as skipped,
    case when count(*) filter (where change <> 'skipped') = 0 then 'skipped' else 'ok' end as status from changes group by source"""
)
def m3_document_status(spark, d):
    return store.report(_changes(spark, d), "source")


@query(
    f"""with {_SQL_CHANGES}, r as (select doc_id, count(*) filter (where change <> 'skipped') as stored, count(*) filter (where change = 'skipped') as skipped from changes group by doc_id)
    select count(*) as documents, count(*) filter (where stored > 0) as ok, count(*) filter (where stored = 0) as skipped, 0::bigint as failed,
    sum(stored)::bigint as blocks_stored, sum(skipped)::bigint as blocks_skipped from r"""
)
def a2_batch_summary(spark, d):
    return store.batch_summary(store.report(_changes(spark, d)))


@query("select source, count(*) as blocks from documents group by source")
def a7_count_blocks(spark, d):
    return store.counts(docs_of(spark, d, "source"), "source")


@query(
    f"""select doc_id, case when len(ys) > 0 then ys[1]::int end as doc_year, timestamp '2026-01-01' as ingested_at, md5(text) as md5
    from (select doc_id, text, {SQL_YEARS.format(TITLE)} as ys from documents)"""
)
def m4_backfill(spark, d):
    rows = _titled(spark, d, F.md5("text").alias("md5"), F.lit("2000").alias("doc_date"), F.lit(2000).alias("doc_year"))
    return store.backfilled(rows, F.lit("2026-01-01").cast("timestamp")).select("doc_id", "doc_year", "ingested_at", "md5")


@query("select doc_id from documents where source <> 'src1'")
def u3_delete_documents(spark, d):
    docs = docs_of(spark, d, "source")
    return store.without(docs, docs.where("source = 'src1'")).select("doc_id")


@query("""select image_id, 'd' || min(doc_id) as doc_id, count(*)::int as copies from (select doc_id, 'img-' || substr(md5(text), 1, 10) as image_id from documents)
  where image_id not in (select 'img-' || substr(md5(text), 1, 10) from documents where doc_id % 9 = 0) group by image_id""")
def m5_u2_image_registry(spark, d):
    rows = docs_of(spark, d, X.image_id(F.lit("img"), F.col("text").cast("binary")).alias("image_id"))
    known = rows.where("doc_id % 9 = 0")
    fresh = rows.join(known.select("image_id"), "image_id", "left_anti")
    counted = fresh.groupBy("image_id").agg(F.min("doc_id").alias("first"), F.count("*").cast("int").alias("copies"))
    return store.with_new_images(known, counted).select("image_id", F.concat(F.lit("d"), F.col("first").cast("string")).alias("doc_id"), "copies")


@query("""select d.doc_id, i.item_id from documents d left join benchmark i on d.doc_id % 50 = i.item_id""")
def j8_registry_lookup(spark, d):
    reg = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("image_id"), F.col("item_id").alias("doc_id"), F.lit("p").alias("rel_path"), F.lit("png").alias("ext"))
    rows = docs_of(spark, d).select(F.col("doc_id").alias("asked"), (F.col("doc_id") % 50).cast("string").alias("image_id"))
    return images.looked_up(rows, reg).select(F.col("asked").alias("doc_id"), F.col("doc_id").alias("item_id"))


# ---- retrieval


SQL_PAIRS = """pairs as (select q.vec_id as query_id, e.vec_id, e.label, q.label as asked, list_distance(q.embedding::double[], e.embedding::double[]) ^ 2 as dist
  from embeddings q join embeddings e on q.vec_id % 50 = 0 and q.vec_id <> e.vec_id)"""


def vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("asked")), e


@query(f"""with {SQL_PAIRS} select query_id, vec_id, rank, round(dist, 6) as distance from (
  select *, (row_number() over (partition by query_id order by dist, vec_id))::int as rank from pairs) where rank <= 5""")
def j5_v1_w2_nearest(spark, d):
    q, e = vectors(spark, d)
    hits = retrieval.search(q, e, 5, F.col("vec_id") != F.col("query_id"), "vec_id")
    return hits.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@query(f"""with {SQL_PAIRS} select query_id, vec_id, rank, round(dist, 6) as distance from (
  select *, (row_number() over (partition by query_id order by dist, vec_id))::int as rank from pairs where label = asked) where rank <= 5""")
def f5_v1_filtered_nearest(spark, d):
    q, e = vectors(spark, d)
    hits = retrieval.search(q, e, 5, (F.col("vec_id") != F.col("query_id")) & (F.col("label") == F.col("asked")), "vec_id")
    return hits.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@query(
    f"""with {SQL_PAIRS}, y as (select *, 'd' || label as doc_id, 2020 + vec_id % 7 as doc_year, case when query_id % 4 > 0 then [2020 + query_id % 9] end as years from pairs),
    r as (select *, coalesce(list_contains(years, doc_year), false) as fits, row_number() over (partition by query_id order by dist, vec_id) as ra from y),
    s as (select *, case when fits then row_number() over (partition by query_id, fits order by dist, vec_id) end as ry from r),
    t as (select query_id, max(doc_id) filter (where ra = 1) as top from s group by query_id),
    u as (select s.query_id, bool_or(ry <= 5 and doc_id = top) as served from s join t using (query_id) group by s.query_id)
    select query_id, vec_id, (case when served then ry else ra end)::int as rank, years is not null and not coalesce(served, false) as noted
    from s join u using (query_id) where case when served then ry else ra end <= 5"""
)
def j6_year_arbitration(spark, d):
    q, e = vectors(spark, d)
    q = q.withColumn("years", F.when(F.col("query_id") % 4 > 0, F.array((2020 + F.col("query_id") % 9).cast("int")))).drop("asked")
    blocks = e.select("vec_id", F.concat(F.lit("d"), F.col("label").cast("string")).alias("doc_id"), (2020 + F.col("vec_id") % 7).cast("int").alias("doc_year"), "embedding")
    hits = retrieval.year_aware(q, blocks, 5, "vec_id", F.col("vec_id") != F.col("query_id"))
    return hits.select("query_id", "vec_id", "rank", F.col("note").isNotNull().alias("noted"))
