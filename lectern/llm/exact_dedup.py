"""Exact deduplication with a split for heavy hitters.

Every text becomes a SHA-256 digest. Misra-Gries summaries, one per partition and merged, name the digests that may be
frequent; one aggregation counts those exactly. The verified winners, ``counters`` at most, are broadcast, so that the
rows of a very large group of copies are settled where they are read. The remaining digests, none of which has more than
1 / (counters + 1) of all rows, take an ordinary shuffle of (digest, id) rows: their largest ids and counts are aggregated, first
within each task, and joined back, so that no task holds a group. Texts are never shuffled to be marked.

Defined cases: a null text counts as empty; a null id is smaller than any other; rows that repeat both id and text are one
group, of which exactly one row is kept; an empty table gives an empty result; other columns are carried in one struct, so they
can have any name, dots and the names used here included.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import col, row_of, staged, text_of


class MisraGries:
    """Counters for at most ``size`` keys. A key with more than n / (size + 1) of n rows is always among them."""

    def __init__(self, size: int):
        self.size, self.counts = size, {}

    def add(self, key, n: int = 1) -> None:
        self.counts[key] = self.counts.get(key, 0) + n
        if len(self.counts) > 2 * self.size:
            self.shrink()

    def shrink(self) -> None:
        """Takes the (size + 1)-th largest count off every counter, and drops those that reach zero."""
        if len(self.counts) > self.size:
            off = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = {k: v - off for k, v in self.counts.items() if v > off}


def frequent(df: DataFrame, column: str, counters: int) -> DataFrame:
    """(key, counted): the merged Misra-Gries summary of a column, at most ``counters`` rows.

    Summaries of partitions merge by adding counts; what exceeds the size is cut with the largest counts first."""

    def summaries(batches):
        found = MisraGries(counters)
        for batch in batches:
            for x in batch.column(0).value_counts():
                found.add(x["values"].as_py(), x["counts"].as_py())
        found.shrink()
        yield pa.RecordBatch.from_pydict({"key": list(found.counts), "counted": list(found.counts.values())}, schema=schema)

    kind = df.schema[column].dataType.simpleString()
    schema = pa.schema([("key", {"binary": pa.binary(), "bigint": pa.int64()}[kind]), ("counted", pa.int64())])
    local = df.select(F.col(column).alias("key")).mapInArrow(summaries, f"key {kind}, counted long")
    return local.groupBy("key").agg(F.sum("counted").alias("counted")).orderBy(F.desc("counted"), "key").limit(counters)


def digest(text: str) -> Column:
    return F.unhex(F.sha2(text_of(text), 256))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(rows, winners). rows: id, digest, keep_id, group_size, kept; one for each row of df. winners: the verified heavy
    digests with keep_id, group_size and twins, the number of their rows that carry keep_id; at most ``counters`` rows."""
    keyed = staged(df.select(col(id_col).alias("id"), digest(text_col).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")
    least = keyed.count() / (counters + 1)
    candidates = frequent(keyed, "digest", counters).select(F.col("key").alias("digest"))
    best = F.max(F.struct("id", "row"))
    # As many rows as there are counters at most, which bounds both broadcasts.
    winners = keyed.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    winners = staged(winners.filter((F.col("group_size") > least) & (F.col("group_size") > 1)), "winners")
    marked = keyed.join(F.broadcast(winners), "digest", "left")
    light = marked.filter("best IS NULL").select("id", "digest", "row")
    light = light.join(light.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "digest")
    rows = marked.filter("best IS NOT NULL").unionByName(light)
    return rows.select("id", "digest", F.col("best.id").alias("keep_id"), "group_size", (F.col("best.row") == F.col("row")).alias("kept")), winners.select("digest", F.col("best.id").alias("keep_id"), "group_size")


def mark_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """One row per row of df: its id, keep_id (the largest id of its group), group_size, kept, text_sha256."""
    rows, _ = groups(df, id_col, text_col, counters)
    return rows.select(col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """The rows of df that stay, with their columns. Copies of heavy texts go where they are read, by the broadcast
    winners; the other copies by a join on the ids that go."""
    rows, winners = groups(df, id_col, text_col, counters)
    rows = staged(rows, "groups")
    own = df.select(row_of(df).alias("row"), col(id_col).alias("id"), digest(text_col).alias("digest"))
    heavy = F.broadcast(winners.select("digest", F.col("keep_id").alias("heavy_id"), F.lit(True).alias("heavy")))
    own = own.join(heavy, "digest", "left").filter("heavy IS NULL OR id <=> heavy_id")
    gone = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").filter("NOT kept AND NOT id <=> keep_id").select(F.col("id").alias("gone"), F.col("digest").alias("gone_digest"))
    own = own.join(gone, F.col("id").eqNullSafe(F.col("gone")) & (F.col("digest") == F.col("gone_digest")), "left_anti")
    twins = rows.filter("NOT kept AND id <=> keep_id").select("digest").distinct()
    if not twins.isEmpty():  # rows that repeat the id too: one of them stays
        same = own.join(twins.withColumn("twin", F.lit(True)), "digest", "left")
        own = same.filter("twin IS NULL").unionByName(same.filter("twin").dropDuplicates(["id", "digest"]))
    return own.select("row.*")
