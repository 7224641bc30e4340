"""Labelled text: dropping fields, class labels, cleaning, splitting, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NAMES = ("negative", "positive")


def drop_column(df: DataFrame, column: str = "cat") -> DataFrame:
    return df.drop(column)


def class_label(df: DataFrame, label_col: str = "label", names: tuple[str, ...] = NAMES, strict: bool = False) -> DataFrame:
    """df with the label as a class (an int from 0) and ``<label>_name``. Other values, text that is no number among them, are null, or an
    error if strict."""
    code = F.col(label_col).try_cast("int")
    bad = F.raise_error(F.concat(F.lit("not a class: "), F.coalesce(F.col(label_col).cast("string"), F.lit("null")))).cast("int") if strict else F.lit(None).cast("int")
    df = df.withColumn(label_col, F.when((code >= 0) & (code < len(names)), code).otherwise(bad))
    return df.withColumn(f"{label_col}_name", F.get(F.array(*map(F.lit, names)), F.col(label_col)))


def clean(df: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """Rows with a label and a text that is not blank; nothing more is dropped or changed."""
    return df.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & (F.trim(text_col) != ""))


def stratified_split(df: DataFrame, label_col: str = "label", key_col: str = "doc_id", fraction: float = 0.2) -> DataFrame:
    """df with ``split``: of each class, exactly floor(n * fraction) rows are "test", the first by MD5 of their key.

    A class may hold most rows, so ranks are taken in two steps: rows are numbered within ranges of their MD5, 4,096 to a class, and
    a range's offset is the sum of the counts before it."""
    key = F.md5(F.col(key_col).cast("string").cast("binary"))
    rows = df.withColumns({"_key": key, "_range": F.substring(key, 1, 3)})
    sizes = rows.groupBy(label_col, "_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(label_col).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(upto), F.lit(0)), "_quota": F.floor(F.sum("_n").over(Window.partitionBy(label_col)) * F.lit(fraction))})
    sizes = sizes.select(F.col(label_col).alias("_label"), F.col("_range").alias("_at"), "_before", "_quota")
    rank = F.row_number().over(Window.partitionBy(label_col, "_range").orderBy("_key", key_col))
    rows = rows.withColumn("_rank", rank).join(sizes, F.col(label_col).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_at")))
    split = F.when(F.col("_before") + F.col("_rank") <= F.col("_quota"), "test").otherwise("train")
    return rows.select(*df.columns, split.alias("split"))


def one_per_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str | None = None) -> DataFrame:
    """One row of each distinct text, that with the least id, so that a split has no text on both sides. Of rows that share both id and text, one
    is left; an id that stands with several texts keeps its row of each text whose least id it is. Null texts are one text. With label_col, that column
    is the label of the least id that has one among the copies, the least of them if it has several; null if none has."""
    digest = F.sha2(F.coalesce(F.concat(F.lit("t"), text_col), F.lit("")), 256)
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).alias("id"), digest.alias("digest"))
    label = F.col(f"row.`{label_col}`") if label_col else F.lit(None).cast("int")
    first = F.min(F.when(label.isNotNull(), F.struct(F.col("id").isNull().alias("none"), "id", label.alias("label"))))["label"]
    kept = rows.groupBy("digest").agg(F.min("id").alias("least"), first.alias("label")).select(F.col("digest").alias("kept"), "least", "label")
    rows = rows.join(kept, (F.col("digest") == F.col("kept")) & F.col("id").eqNullSafe(F.col("least")))
    found = rows.groupBy("digest").agg(F.first("row").alias("row"), F.first("label").alias("label"))
    return found.select(*(F.col("label" if c == label_col else f"row.`{c}`").alias(c) for c in df.columns))


def accuracy(predictions: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    """(accuracy, n): of the rows that have both."""
    both = predictions.filter(F.col(label_col).isNotNull() & F.col(prediction_col).isNotNull())
    return both.agg(F.avg((F.col(label_col) == F.col(prediction_col)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
