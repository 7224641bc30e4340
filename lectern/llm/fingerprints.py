"""Document fingerprints: bottom-k sketches of shingle hashes, with built-in functions only.

A fingerprint holds the k smallest of the distinct 64-bit hashes of a text's five-word shingles, in order. Fingerprints of
parts merge into that of the whole, and give estimates of resemblance, containment and of the number of distinct shingles.

Defined cases: a null text counts as empty; a text without words has an empty fingerprint, which is like another empty one (1)
and unlike any other (0); fewer than five words make one shingle of them all; equal texts have equal fingerprints; rows are
fingerprinted one by one, so repeated ids and rows are no matter; ids can be spread over all of bigint in any way, be null or repeat;
an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import col, text_of, with_shingles


def with_fingerprint(df: DataFrame, text: Column, out: str, k: int = 128, n: int = 5) -> DataFrame:
    """df with ``out``, an array of the k smallest shingle hashes of ``text``, ascending."""
    found = f"_{out}_set"
    df = with_shingles(df, text, n, found)
    return df.withColumn(out, F.slice(F.sort_array(found), 1, k)).drop(found, f"{found}_words")


def merged(a: Column, b: Column, k: int = 128) -> Column:
    """The fingerprint of two parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(fingerprints: Column, k: int = 128) -> Column:
    """An aggregate: the fingerprint of a group's shingles together. It gathers the group's distinct fingerprints; groups that may
    be large are for ``merge_groups``."""
    return F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_set(fingerprints)))), 1, k)


def merge_groups(df: DataFrame, key: str, column: str, k: int = 128, fan: int = 256) -> DataFrame:
    """(key, column): each key's fingerprints merged into one. A key of any size is folded in rounds, each of which merges about ``fan``
    fingerprints at a time, so that no task holds a group."""
    rows = df.select(col(key).alias("key"), col(column).alias("sketch")).filter("sketch IS NOT NULL")
    most = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-most // fan)
    while parts > 1:
        rows = rows.groupBy("key", F.pmod(F.xxhash64("sketch"), F.lit(parts)).alias("part")).agg(merge_all(F.col("sketch"), k).alias("sketch"))
        parts = -(-parts // fan)
    return rows.groupBy(F.col("key").alias(key)).agg(merge_all(F.col("sketch"), k).alias(column))


def _common(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    """Of the k smallest of both: how many there are, and how many of them are in both."""
    union = merged(a, b, k)
    return F.size(union), F.size(F.array_intersect(F.array_intersect(union, a), b))


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """Estimates the Jaccard similarity of the shingle sets, 0 to 1. Both columns hold fingerprints of the same k."""
    size, both = _common(a, b, k)
    return F.when(size == 0, F.lit(1.0)).otherwise(both / size).cast("double")


def distinct_count(a: Column, k: int = 128) -> Column:
    """Estimates the number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1) / F.lit(2.0**64)) + F.lit(0.5)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """Estimates the share of a's shingles that b has too."""
    union = distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """The fingerprint in 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


#: The most buckets of ``with_next``; their bounds, 8 bytes each, go to every task.
BUCKETS = 1 << 20


def _before(bounds: Column, steps: int, value: Column, strictly: bool) -> Column:
    """How many of the sorted bounds are less than a value (strictly), or not greater: a binary search of that many steps."""
    def at(found: Column, step: Column) -> Column:
        bound = F.try_element_at(bounds, found + step)
        return F.when((bound < value) if strictly else (bound <= value), found + step).otherwise(found)

    powers = F.array(*(F.lit(1 << k) for k in reversed(range(steps))))
    return F.aggregate(powers, F.lit(0), at)


def with_next(df: DataFrame, prepare, columns: list[str], per_bucket: int = 2048) -> DataFrame:
    """df with ``next``, a struct of ``columns`` of the row that follows in descending order of ``id``; the first follows the last.
    Of equal ids, the one with the lesser ``tie`` comes first; null ids come last.

    Rows are dealt to buckets of about ``per_bucket`` rows by quantiles of their ids, however the ids are spread; rows that repeat an id more
    often than that are dealt by ranges of ``tie``. Within a bucket, rows are sorted. What joins one bucket to the next is the first
    row of the bucket below, which is read a second time; the first rows' ids are found by an aggregation and broadcast, a row
    per bucket, of which there are ``BUCKETS`` at most. ``prepare`` is applied to rows that are already dealt."""
    n, known = df.agg(F.count(F.lit(1)), F.count("id")).first()
    count = max(1, min(BUCKETS, -(-known // per_bucket)))
    nulls = max(1, min(BUCKETS, -(-(n - known) // per_bucket)))
    share = lambda parts: F.least(parts - 1, F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * parts)).cast("int")
    if count > 1:
        bounds = df.agg(F.percentile_approx("id", F.lit(np.arange(1, count) / count), F.lit(max(10_000, 2 * count)))).first()[0]
        bounds = F.lit(np.array(bounds, np.int64))
        upto, less = (_before(bounds, count.bit_length(), F.col("id"), x) for x in (False, True))
        # An id that is a bound several times has as many buckets, and the least ties in the highest.
        bucket = F.when(upto - less > 1, upto - share(upto - less)).otherwise(upto)
    else:
        bucket = F.lit(0)
    bucket = F.when(F.col("id").isNull(), -1 - share(F.lit(nulls))).otherwise(bucket).cast("long")
    first = F.min(F.struct(F.col("id").isNull().alias("null"), (-1 - F.col("id")).alias("down"), "tie"))
    tops = df.groupBy(bucket.alias("below")).agg(first.alias("top")).select("below", (-1 - F.col("top.down")).alias("top_id"), "top.tie")
    # In one task, but a row per bucket: each bucket's first row follows the last of the bucket above it, and of the lowest for the highest.
    above = F.lead("below").over(Window.orderBy("below"))
    ghosts = tops.withColumn("above", F.coalesce(above, F.min("below").over(Window.partitionBy(F.lit(0))))).withColumnRenamed("tie", "top_tie")
    dealt = df.withColumn("bucket", bucket).join(F.broadcast(ghosts), F.col("id").eqNullSafe(F.col("top_id")) & (F.col("tie") == F.col("top_tie")) & (F.col("bucket") == F.col("below")), "left")
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost"))
    there = F.struct(F.col("above").alias("bucket"), F.lit(True).alias("ghost"))
    dealt = dealt.select(*df.columns, F.explode(F.when(F.col("above").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("at"))
    dealt = prepare(dealt.select(*df.columns, "at.*").repartition("bucket"))
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("id"), "tie")
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(order)).filter("NOT ghost").drop("ghost", "bucket")


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 128, n: int = 5) -> DataFrame:
    """Fingerprints of every text and of an edited text, whose second half (rounded down) is the beginning of the next
    document's text, in descending id order; and how much the fingerprint is like the edited text's and the next one's."""

    def prepare(rows: DataFrame) -> DataFrame:
        return with_fingerprint(rows, F.col("text"), "sketch", k, n)

    own = df.select(col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = with_next(own, prepare, ["text", "sketch"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next.text", F.lit(1), half))
    rows = rows.select("id", "n_chars", "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    rows = with_fingerprint(rows, F.col("edited"), "edited_sketch", k, n)
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_shingles_estimate"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_in_edited"),
    )
