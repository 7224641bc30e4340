"""Text as columns: paragraphs, letters-only tokens, html paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of letters. Chinese has no spaces, so a run of it is a clause; give r"[\p{IsHan}]|[\p{L}&&[^\p{IsHan}]]+" for its characters one by one.
LETTERS = r"\p{L}+"


def tokens(text: Column, pattern: str = LETTERS) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))


def paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n") -> DataFrame:
    """(id, pos, para, n_chars): the parts of every text, numbered from 0; blank ones are left out and keep their number.
    ``separator`` is a regular expression; blank lines part paragraphs of parsed papers (``\\n\\s*\\n``)."""
    parts = df.select(F.col(id_col), F.posexplode(F.split(text_col, separator)).alias("pos", "para"))
    return parts.filter(F.trim("para") != "").select(id_col, F.col("pos").cast("long").alias("pos"), "para", F.length("para").cast("long").alias("n_chars"))


def html_paragraphs(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, para): the bodies of ``<p>`` elements without tags, a stand-in for a document parser."""
    bodies = F.regexp_extract_all(html_col, F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    parts = df.select(F.col(id_col), F.posexplode(bodies).alias("pos", "para"))
    return parts.select(id_col, F.col("pos").cast("long").alias("pos"), F.trim(F.regexp_replace("para", "<[^>]*>", "")).alias("para")).filter(F.col("para") != "")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token, n): how often each document has each token."""
    rows = df.select(F.col(id_col), F.explode(tokens(F.col(text_col))).alias("token"))
    return rows.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n"))
