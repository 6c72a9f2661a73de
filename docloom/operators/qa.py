"""Answers with sources: routing, context, citations.  The model is a parameter."""

from __future__ import annotations

import time
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.functions import text as X
from docloom.operators import retrieval
from docloom.operators.embedding import embed, tried
from docloom.session import ship

# Sentences of the answers.
GREETING = "你好，我是文档助手。把文档摄取进知识库后，可以问我文档里的内容（会带出处回答）。"
NOTHING = "知识库中未找到与问题相关的内容（可先摄取文档，或换个问法）。"
NO_MODEL = "（未配置模型 Key 或模型调用失败：已检索到文档内容，但无法生成带出处的回答。）"

#: What a model is told before the blocks: whence to answer, how to cite, what to do without evidence.
RULES = (
    "You answer from a document archive. Below are numbered excerpts; they are the only evidence you have. "
    "Put the number of the excerpt in square brackets, like [2], right behind every statement it supports; a statement may carry several. "
    "Reply in the language in which you are asked, and briefly. If the excerpts leave the question open, say so instead of guessing.\n\n"
)


class Reply(NamedTuple):
    """An answer, and what it used."""

    text: str | None
    prompt_tokens: int = 0
    completion_tokens: int = 0


class Answerer(Protocol):
    """(context, question) to an answer with citations [n] or a Reply with it, or None if the model can't be reached."""

    def __call__(self, context: str, question: str) -> str | Reply | None: ...


def asked_model(model: Answerer, context: str, question: str) -> Reply:
    """The model's reply, after tries where an error may pass; one without text if it fails, so that no question stops the others."""
    try:
        reply = tried(lambda: model(context, question))
    except Exception:
        return Reply(None)
    return reply if isinstance(reply, Reply) else Reply(reply)


def routed(questions: DataFrame, whole_words: bool = False) -> DataFrame:
    return questions.withColumns({"needs_search": ~X.is_greeting(F.col("question"), whole_words), "years": X.question_years(F.col("question"))})


def contexts(hits: DataFrame) -> DataFrame:
    """(query_id, context, hits array in rank order, note) of ranked hits; at most k rows a query come together."""
    block = X.prompt_block(F.col("rank"), F.col("title"), F.col("source_file"), F.col("page"), F.col("doc_date"), F.col("text"))
    row = F.struct("rank", block.alias("block"), F.struct("block_id", "title", "source_file", "page", "doc_date", "image_ids", "text").alias("hit"))
    grouped = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("r"), F.max("note").alias("note"))
    return grouped.select(
        "query_id", F.concat(F.lit(RULES), F.array_join(F.transform("r", lambda x: x["block"]), "\n\n")).alias("context"), F.transform("r", lambda x: x["hit"]).alias("hits"), "note"
    )


def source(hit: Column) -> Column:
    """What is shown for a cited block."""
    return F.struct(
        hit["block_id"].alias("block_id"),
        X.document_name(hit["title"], hit["source_file"]).alias("document_name"),
        hit["page"].alias("page_number"),
        hit["doc_date"].alias("doc_date"),
        X.snippet(hit["text"]).alias("snippet"),
        F.coalesce(hit["image_ids"], F.array().cast("array<string>")).alias("image_ids"),
    )


def answered(questions: DataFrame, blocks: DataFrame, model: Answerer | None = None, k: int = X.TOP_K) -> DataFrame:
    """questions (query_id, question, embedding) with answer, sources, note, degraded, prompt_tokens and completion_tokens."""
    asked = routed(questions)
    search = asked.where("needs_search")
    hits = retrieval.year_aware(search.select("query_id", "years", "embedding"), blocks, k)
    found = search.join(contexts(hits), "query_id", "left")

    @F.pandas_udf("text string, prompt_tokens long, completion_tokens long")
    def ask(context: pd.Series, question: pd.Series) -> pd.DataFrame:
        replies = [Reply(None) if c is None else asked_model(model, c, q) for c, q in zip(context, question)]
        return pd.DataFrame(replies, columns=Reply._fields).astype({"prompt_tokens": "int64", "completion_tokens": "int64"})

    none_said = F.lit(None).cast("struct<text:string,prompt_tokens:long,completion_tokens:long>")
    found = found.withColumn("_reply", ask("context", "question") if model else none_said).withColumn("_raw", F.col("_reply.text"))
    count = F.coalesce(F.size("hits"), F.lit(0))
    none = F.col("context").isNull()
    text = F.when(none, NOTHING).when(F.col("_raw").isNull(), NO_MODEL).otherwise(F.col("_raw"))
    refs = X.cited(F.col("_text"), count)
    # Both notes stay where the search and the answer have one.
    note = F.nullif(F.concat_ws("；", "note", F.when(none, "检索无命中").when(F.col("_raw").isNull(), "chat 未可用（无 Key/调用失败）")), F.lit(""))
    done = found.withColumn("_text", X.strip(text)).withColumn("_refs", refs)
    done = done.select(
        "query_id",
        "question",
        X.with_hint(X.without_ghosts(F.col("_text"), count), F.col("_refs"), count).alias("answer"),
        F.transform("_refs", lambda n: source(F.element_at("hits", n))).alias("sources"),
        note.alias("note"),
        (~none & F.col("_raw").isNull()).alias("degraded"),
        *[F.coalesce(F.col(f"_reply.{c}"), F.lit(0).cast("long")).alias(c) for c in ("prompt_tokens", "completion_tokens")],
    )
    kind = dict(done.dtypes)["sources"]
    greeted = asked.where("not needs_search").select(
        "query_id", "question", F.lit(GREETING).alias("answer"), F.array().cast(kind).alias("sources"), F.lit(None).cast("string").alias("note"), F.lit(False).alias("degraded"),
        F.lit(0).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"),
    )
    return done.unionByName(greeted)


def answer_one(spark: SparkSession, blocks: DataFrame, question: str, provider=None, model: Answerer | None = None, k: int = X.TOP_K) -> dict:
    """One question: answer, sources, note, degraded, usage and seconds."""
    began = time.perf_counter()
    ship(spark)
    asked = spark.createDataFrame([(0, question)], "query_id long, question string").withColumn("embedding", embed(provider)(F.col("question")))
    r = answered(asked, blocks, model, k).first().asDict(recursive=True)
    usage = {c: r.pop(c) for c in ("prompt_tokens", "completion_tokens")}
    r.pop("query_id")
    return r | {"usage": usage | {"total_tokens": sum(usage.values())}, "seconds": round(time.perf_counter() - began, 2)}
