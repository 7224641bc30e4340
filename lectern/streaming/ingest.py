"""Papers that keep arriving: new files are parsed and their paragraphs appended to a table, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.text import paragraphs
from lectern.operators import providers


def new_papers(spark: SparkSession, folder: str, parser: providers.PdfParser, pattern: str = "*.pdf") -> DataFrame:
    """A stream of (path, text, error) of files as they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return providers.parse_pdfs(files.select("path", "content"), parser)


def append_paragraphs(papers: DataFrame, target: str, checkpoint: str, separator: str = r"\n\s*\n", once: bool = True) -> StreamingQuery:
    """Writes paragraphs of new papers. With ``once``, it takes what is there and ends."""
    parts = paragraphs(papers.filter("text IS NOT NULL"), "path", "text", separator)
    writer = parts.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
