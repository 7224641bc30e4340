"""The facade over papers: index a corpus, read one paper, answer over many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import paragraphs
from lectern.operators import prompts, providers, retrieval
from lectern.sources import files


class Reader:
    """``store`` is a folder that all workers reach; the index lies in it as Parquet: chunks, papers, vectors."""

    def __init__(self, spark: SparkSession, store: str, embedder: providers.Embedder, model: providers.LanguageModel, separator: str = r"\n\s*\n"):
        self.spark, self.store, self.embedder, self.model, self.separator = spark, store, embedder, model, separator

    def build(self, papers: DataFrame) -> None:
        """papers: doc_id, text and any metadata. What was there before is replaced."""
        self._write(papers, "overwrite")

    def add(self, papers: DataFrame) -> None:
        """More papers, beside those that are there; their ids must be new."""
        self._write(papers, "append")

    def _write(self, papers: DataFrame, mode: str) -> None:
        chunks = paragraphs(papers.filter("text IS NOT NULL"), separator=self.separator)
        # Ids of chunks are 0 or more, those of questions below, so that none is taken for a question's own.
        chunks = chunks.withColumn("chunk_id", F.xxhash64("doc_id", "pos").bitwiseAND(F.lit((1 << 63) - 1)))
        files.write_chunks(chunks, f"{self.store}/chunks", mode=mode)
        files.write_papers(papers.drop("text"), f"{self.store}/papers", mode=mode)
        fresh = papers.select("doc_id").distinct() if mode == "append" else None
        written = self.spark.read.parquet(f"{self.store}/chunks")
        embedded = providers.embed(written.join(fresh, "doc_id", "left_semi") if fresh else written, self.embedder)
        if mode == "append":
            self.index().add(embedded)
        else:
            retrieval.VectorIndex.save(embedded, f"{self.store}/index", "chunk_id")

    def index(self) -> retrieval.VectorIndex:
        return retrieval.VectorIndex.load(self.spark, f"{self.store}/index")

    def retrieve(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """(question_id, id, score, rank) of chunks. questions: item_id, text."""
        asked = providers.embed(questions.select("item_id", "text"), self.embedder, "text").select((-1 - F.col("item_id")).alias("chunk_id"), "embedding")
        found = self.index().search(asked, k)
        return found.select((-1 - F.col("query_id")).alias("question_id"), "id", "score", "rank")

    def answer(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """(question_id, prompt, sources, answer)."""
        chunks = self.spark.read.parquet(f"{self.store}/chunks")
        asked = prompts.corpus_prompts(self.retrieve(questions, k), questions.select("item_id", F.col("text").alias("para")), chunks, id_col="chunk_id", text_col="para")
        return providers.complete(asked, self.model)

    def read_paper(self, paper: DataFrame) -> DataFrame:
        """(doc_id, guide): abstract, method, problem and conclusion of each paper given, over its whole text."""
        answers = providers.complete(prompts.guided_prompts(paper, separator=self.separator), self.model)
        parts = [F.max(F.when(F.col("part") == x, F.col("answer"))).alias(x) for x in prompts.PARTS]
        return answers.groupBy("doc_id").agg(*parts).select("doc_id", F.struct(*prompts.PARTS).alias("guide"))
