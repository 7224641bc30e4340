"""Helpers that several operators share: words, shingle hashes and tables written to the shared folder."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import shared_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space that parts words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: With this, Spark deletes a query's shuffle files when the query ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The most rows that go to Python at once, from a task whose rows may be large.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def col(name: str) -> Column:
    """A column by its whole name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(df: DataFrame) -> Column:
    """All columns as one struct, so that none can clash with a name of an operator's own."""
    return F.struct(*(col(c) for c in df.columns))


def staged(df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back: cuts lineage, survives the loss of executors. The query that
    writes it is run this once, so that its shuffle files can go when it ends. arrow_rows: as many rows go to Python at once."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = {CLEAN_UP: spark.conf.get(CLEAN_UP, "false")} | ({ARROW_ROWS: spark.conf.get(ARROW_ROWS)} if arrow_rows else {})
    try:
        spark.conf.set(CLEAN_UP, "true")
        if arrow_rows:
            spark.conf.set(ARROW_ROWS, str(arrow_rows))
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    found = spark.read.schema(df.schema).parquet(path)
    _PLACES[found] = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more. Tables that a result still reads are left to the application's end."""
    for table in tables:
        remove(table.sparkSession, _PLACES.pop(table))


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_of(column: str) -> Column:
    """Null texts count as empty."""
    return F.coalesce(col(column), F.lit(""))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z in lower case."""
    same = F.translate(text, UPPER + SPACES[1:], LOWER + " " * (len(SPACES) - 1))
    return F.array_remove(F.split(same, " "), "")


def with_shingles(df: DataFrame, text: Column, n: int, out: str) -> DataFrame:
    """Adds ``out``: the distinct 64-bit hashes of the text's n-word shingles, and ``out_words``: the number of words.

    Fewer words than n make one shingle of them all; no words make none. Each word is hashed once; a shingle's hash
    is made of its words' hashes. Only built-in functions are used."""
    h, w = f"_{out}_h", f"_{out}_w"
    rest = ", ".join(f"{h}[i + {k}]" for k in range(1, n))
    found = f"""CASE WHEN size({h}) = 0 THEN cast(array() AS array<bigint>)
        WHEN size({h}) < {n} THEN array(xxhash64({h}))
        ELSE array_distinct(transform(slice({h}, 1, size({h}) - {n - 1}), (x, i) -> xxhash64(x{', ' if rest else ''}{rest}))) END"""
    return (
        df.withColumn(w, words(text))
        .withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
        .withColumn(out, F.expr(found))
        .withColumn(f"{out}_words", F.size(h).cast("long"))
        .drop(h, w)
    )
