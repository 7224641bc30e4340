"""Prompts: ordered context for reading one document and for answering over many, up to the call of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parts of a guided reading.
PARTS = ("abstract", "method", "problem", "conclusion")


def in_order(order: Column, value: Column, separator: str = "\n") -> Column:
    """An aggregate: the values joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), separator)


def conversation_context(df: DataFrame) -> DataFrame:
    """(conv_id, context): a conversation's turns as ``role: text`` lines, in order."""
    return df.groupBy("conv_id").agg(in_order(F.col("turn"), F.concat_ws(": ", "role", "text")).alias("context"))


def guided_prompts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n") -> DataFrame:
    """(id, part, prompt): for each part of a guided reading, a prompt over all the document's paragraphs that are not blank, its conclusion included.
    A document without any has prompts without paragraphs. Paragraphs are joined where the document is read, without a shuffle."""
    parts = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), separator), lambda x: F.trim(x) != "")
    context = documents.select(F.col(id_col), F.array_join(parts, "\n").alias("context"))
    return context.select(id_col, F.explode(F.array(*map(F.lit, PARTS))).alias("part"), "context").select(
        id_col, "part", F.concat(F.lit("State the "), F.col("part"), F.lit(" of this paper.\n\n"), F.col("context")).alias("prompt")
    )


def corpus_prompts(hits: DataFrame, questions: DataFrame, documents: DataFrame, question_id: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(question_id, prompt, sources): each question with the texts of its hits in order of rank. hits: question_id, id, score, rank. A question
    without hits has a prompt without passages, and no sources."""
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("passage"))
    found = hits.join(texts, "id").groupBy("question_id").agg(
        in_order(F.col("rank"), F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("passage", F.lit("")))).alias("context"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda x: F.struct(x["id"].alias("doc_id"), x["score"].alias("score"))).alias("sources"),
    )
    asked = questions.select(F.col(question_id).alias("question_id"), F.coalesce(F.col(text_col), F.lit("")).alias("question"))
    prompt = F.concat(F.lit("Answer from the passages.\n\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col("question"))
    sources = F.coalesce("sources", F.array().cast("array<struct<doc_id: bigint, score: double>>"))
    return asked.join(found, "question_id", "left").select("question_id", prompt.alias("prompt"), sources.alias("sources"))
