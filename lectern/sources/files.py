"""Reading and writing files: reviews, PDF bytes, chunks, papers, embeddings, datasets, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def review_schema(text_col: str = "review") -> T.StructType:
    return T.StructType([T.StructField("cat", T.StringType()), T.StructField("label", T.StringType()), T.StructField(text_col, T.StringType())])


def read_reviews(spark: SparkSession, path: str, text_col: str = "review", schema: T.StructType | None = None) -> DataFrame:
    """A CSV of reviews with a header: quoted commas, line ends and doubled quotes, and a byte-order mark, are read as meant.
    Columns are text; an empty field is null."""
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8", "enforceSchema": True}
    return spark.read.schema(schema or review_schema(text_col)).options(**options).csv(path)


def read_pdfs(spark: SparkSession, path: str, recursive: bool = True, pattern: str = "*.pdf") -> DataFrame:
    """(path, modificationTime, length, content) of PDF files in a folder, or of one file such as an upload. Corrupt files are
    rows like others; it is for the parser to say so."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(path)


def write_chunks(df: DataFrame, path: str, json: bool = False, mode: str = "overwrite") -> None:
    """Chunks (doc_id, pos, para), as Parquet or as JSON lines."""
    writer = df.write.mode(mode)
    writer.json(path) if json else writer.parquet(path)


def write_papers(df: DataFrame, path: str, json: bool = False, mode: str = "overwrite") -> None:
    """Metadata of papers, one row each."""
    write_chunks(df, path, json, mode)


def write_reviews(df: DataFrame, path: str) -> None:
    """Reviews as CSV that ``read_reviews`` reads back as they were, but for empty texts, which come back as null."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_embeddings(df: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """(id, embedding as array<float>); the key is carried, never a row's position."""
    df.select(id_col, F.col(vector_col).cast("array<float>").alias(vector_col)).write.mode("overwrite").parquet(path)


def write_dataset(df: DataFrame, path: str, split_col: str = "split") -> None:
    """A preprocessed dataset, one folder for each split; a reader of one split opens no other."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def read_dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def save_best(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_best(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
