"""Retrieval: exact vector search, a stored index with an approximate side, and a lexical scorer.

The lexical scorer stands in for semantic retrieval where no embedding model is at hand; it is not a substitute for one.

Searches take a set of queries against all rows. Queries go to the rows: they are broadcast in blocks of a fixed size, so many as it takes, and each
task keeps the k best rows it has met for each query. What is shuffled is k rows a query and task; the rows searched are never moved,
and no pair of query and row is ever a row of its own.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import tokens
from lectern.session import shared_path

#: Bytes of queries that are broadcast at once, and numbers of scores that a task holds at once.
QUERY_BYTES, SCORES = 32 << 20, 1 << 22
#: The score of a place that is not taken.
NONE = -(1 << 62)
FOUND = "query_id long, id long, score double"
FOUND_SCHEMA = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


class Best:
    """The k best of all rows met so far, for each query: by rounded score, then by the lesser id."""

    def __init__(self, queries: int, k: int, digits: int):
        self.k, self.scale = k, 10.0**digits
        self.scores = np.full((queries, k), NONE)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each query from ``first`` on, a column for each id, ids ascending, fewer than 2**20; those that are not finite do not count."""
        known = np.isfinite(scores)
        whole = np.rint(np.where(known, scores, 0.0) * self.scale).astype(np.int64)
        key = np.where(known, whole * (1 << 20) - np.arange(len(ids)), NONE)
        take = min(self.k, len(ids))
        at = np.argpartition(key, len(ids) - take, axis=1)[:, len(ids) - take :]
        here = slice(first, first + len(scores))
        found = np.where(np.take_along_axis(known, at, 1), np.take_along_axis(whole, at, 1), NONE)
        all_scores, all_ids = np.concatenate([self.scores[here], found], 1), np.concatenate([self.ids[here], ids[at]], 1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores[here], self.ids[here] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)

    def rows(self, queries: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = self.scores > NONE
        columns = np.repeat(queries, some.sum(1)), self.ids[some], self.scores[some] / self.scale
        for at in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], schema=FOUND_SCHEMA)


def _ranked(found: list[DataFrame], spark: SparkSession, k: int) -> DataFrame:
    rows = spark.createDataFrame([], FOUND)
    for x in found:
        rows = rows.unionByName(x)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.full_like(x, np.nan), where=norm > 0)


def search(queries: DataFrame, index: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the k most similar vectors of the index by cosine, other than the query's own id. Ties go
    by id; a zero vector, a null one or one of another length has no similarity to any. Ids of queries are unique."""
    spark = index.sparkSession
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    blocks = -(-(asked.agg(F.coalesce(F.sum(F.size("vector") + 1), F.lit(0))).first()[0] * 8) // QUERY_BYTES)
    rows = index.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    return _ranked([_search_block(asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else asked, rows, k, digits) for b in range(blocks)], spark, k)


def _search_block(asked: DataFrame, rows: DataFrame, k: int, digits: int) -> DataFrame:
    by_width = defaultdict(list)
    for x in asked.collect():  # of QUERY_BYTES on average
        by_width[len(x.vector)].append((x.id, x.vector))
    shared = rows.sparkSession.sparkContext.broadcast({n: (np.array([x for x, _ in q], np.int64), _unit(np.array([v for _, v in q], float).reshape(len(q), n))) for n, q in by_width.items()})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Best(len(q), k, digits) for n, (q, _) in shared.value.items()}
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            flat, offsets = vectors.values.to_numpy(zero_copy_only=False).astype(float), vectors.offsets.to_numpy()
            sizes = np.diff(offsets)
            for n in np.unique(sizes):
                if n not in best:
                    continue
                at = np.flatnonzero(sizes == n)
                at = at[np.argsort(ids[at], kind="stable")]
                matrix = _unit(flat[(offsets[at][:, None] + np.arange(n)).ravel()].reshape(-1, n))
                names, own = shared.value[n]
                step = max(1, SCORES // len(at))
                for first in range(0, len(names), step):
                    scores = own[first : first + step] @ matrix.T
                    scores[names[first : first + step, None] == ids[at][None, :]] = np.nan
                    best[n].add(first, scores, ids[at])
        for n, found in best.items():
            yield from found.rows(shared.value[n][0])

    return rows.mapInArrow(score, FOUND)


class VectorIndex:
    """Vectors in a folder that all workers reach: (id, vector) as Parquet, to which more can be added, and, if fitted, random
    projections for approximate search, saved beside them. Every row is indexed."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.spark, self.path, self.id_col, self.vector_col = spark, path, id_col, vector_col

    @classmethod
    def save(cls, df: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
        own = cls(df.sparkSession, path, id_col, vector_col)
        own._write(df, "overwrite")
        names = json.dumps({"id_col": id_col, "vector_col": vector_col})
        df.sparkSession.createDataFrame([(names,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/names")
        return own

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        return cls(spark, path, **json.loads(spark.read.text(f"{path}/names").first().value))

    def _write(self, df: DataFrame, mode: str) -> None:
        df.select(self.id_col, F.col(self.vector_col).cast("array<float>").alias(self.vector_col)).write.mode(mode).parquet(f"{self.path}/vectors")

    def add(self, df: DataFrame) -> None:
        """More vectors; searches that are made from now on see them."""
        self._write(df, "append")

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        return search(queries, self.rows, k, self.id_col, self.vector_col)

    def fit_projections(self, width: float = 1.0, tables: int = 8, seed: int = 7) -> None:
        ApproximateIndex(self.rows, self.id_col, self.vector_col, width, tables, seed).model.write().overwrite().save(f"{self.path}/projections")

    def approximate(self, queries: DataFrame, k: int = 5, distance: float = 1.5) -> DataFrame:
        from pyspark.ml.feature import BucketedRandomProjectionLSHModel

        model = BucketedRandomProjectionLSHModel.load(f"{self.path}/projections")
        return ApproximateIndex(self.rows, self.id_col, self.vector_col, model=model).search(queries, k, distance)


class ApproximateIndex:
    """Random projections over unit vectors; for what exact search is too slow for. Every row is indexed: rows and queries that share a bucket in
    any table are compared where the row is read, as in exact search, so that neither rows nor candidate pairs are shuffled."""

    def __init__(self, index: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: float = 1.0, tables: int = 8, seed: int = 7, model=None):
        from pyspark.ml.feature import BucketedRandomProjectionLSH

        self.index, self.id_col, self.vector_col = index, id_col, vector_col
        self.rows = self._units(index)
        self.model = model or BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(self.rows)

    def _units(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        wide = F.transform(self.vector_col, lambda x: x.cast("double"))
        norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
        return df.filter(norm > 0).select(F.col(self.id_col).cast("long").alias("id"), array_to_vector(F.transform(wide, lambda x: x / norm)).alias("unit")).filter("id IS NOT NULL")

    def _hashed(self, units: DataFrame) -> DataFrame:
        """(id, vector, buckets): the bucket in each table."""
        from pyspark.ml.functions import vector_to_array

        buckets = F.array(*(vector_to_array(F.col("hashes")[t])[0] for t in range(self.model.getNumHashTables())))
        return self.model.transform(units).select("id", vector_to_array("unit").alias("vector"), buckets.alias("buckets"))

    def search(self, queries: DataFrame, k: int = 5, distance: float = 1.5, digits: int = 6) -> DataFrame:
        """(query_id, id, score, rank) of neighbours within a Euclidean distance of the unit vectors; ids of queries are unique. Queries with fewer than k
        of them are searched exactly. What was found is written to the shared folder once, as it also says which queries are left."""
        spark = self.index.sparkSession
        asked, rows = self._hashed(self._units(queries)), self._hashed(self.rows)
        blocks = -(-(asked.agg(F.coalesce(F.sum(F.size("vector") + F.size("buckets") + 1), F.lit(0))).first()[0] * 8) // QUERY_BYTES)
        found = [_near_block(asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else asked, rows, k, distance, digits) for b in range(blocks)]
        path = shared_path(spark, "near")
        _ranked(found, spark, k).write.parquet(path)
        found = spark.read.schema(f"{FOUND}, rank long").parquet(path)
        full = found.filter(F.col("rank") == k).select(F.col("query_id").alias(self.id_col))
        rest = search(queries.join(full, self.id_col, "left_anti"), self.index, k, self.id_col, self.vector_col, digits)
        return found.join(full.withColumnRenamed(self.id_col, "query_id"), "query_id", "left_semi").unionByName(rest)


def _near_block(asked: DataFrame, rows: DataFrame, k: int, distance: float, digits: int) -> DataFrame:
    queries = asked.collect()  # of QUERY_BYTES on average
    codes, at = np.unique(np.array([x.buckets for x in queries], float).reshape(len(queries), -1), axis=0, return_inverse=True)
    order = np.argsort(at, kind="stable")  # queries in the same buckets stand together
    names, own = np.array([x.id for x in queries], np.int64)[order], np.array([x.vector for x in queries], float).reshape(len(queries), -1)[order]
    shared = rows.sparkSession.sparkContext.broadcast((names, own, codes, np.searchsorted(at[order], np.arange(len(codes) + 1))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own, codes, starts = shared.value
        best = Best(len(names), k, digits)
        for batch in batches:
            if not len(batch) or not len(names):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            matrix, buckets = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order] for c in (1, 2))
            for code, start, end in zip(codes, starts[:-1], starts[1:], strict=True):
                some = np.flatnonzero((buckets == code).any(1))
                if not len(some):
                    continue
                near, step = matrix[some], max(1, SCORES // len(some))
                for first in range(start, end, step):
                    here = slice(first, min(first + step, end))
                    scores = own[here] @ near.T
                    scores[(2 - 2 * scores >= distance**2) | (names[here, None] == ids[some][None, :])] = np.nan
                    best.add(first, scores, ids[some])
        yield from best.rows(names)

    return rows.mapInArrow(score, FOUND)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall, n): the share of exact hits that the approximate ones hold."""
    same = exact.join(approximate.select("query_id", "id", F.lit(1.0).alias("hit")), ["query_id", "id"], "left")
    return same.agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"), F.count(F.lit(1)).alias("n"))


def bm25(questions: DataFrame, documents: DataFrame, k: int = 5, question_id: str = "item_id", id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
    """(question_id, id, score, rank): the k documents that share most with each question's distinct tokens.

    Document frequencies are counted for the questions' tokens alone; then each document is scored where it is read against a block of
    questions, whose tokens are broadcast."""
    spark = documents.sparkSession
    asked = questions.select(F.col(question_id).cast("long").alias("id"), F.array_distinct(tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("tokens")).filter("id IS NOT NULL")
    docs = documents.select(F.col(id_col).cast("long").alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    n, mean = docs.agg(F.count(F.lit(1)), F.avg(F.size("tokens"))).first()
    size = asked.agg(F.coalesce(F.sum(F.size("tokens") + 1), F.lit(0))).first()[0]
    blocks = -(-size * 64 // QUERY_BYTES)  # a token and its place take about 64 bytes
    part = lambda i: asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i) if blocks > 1 else asked
    found = [_bm25_block(part(i), docs, n, float(mean or 1), k, k1, b, digits) for i in range(blocks)]
    return _ranked(found, spark, k).withColumnRenamed("query_id", "question_id")


def _bm25_block(asked: DataFrame, docs: DataFrame, n: int, mean: float, k: int, k1: float, b: float, digits: int) -> DataFrame:
    spark = docs.sparkSession
    questions = asked.collect()  # of QUERY_BYTES on average
    places = defaultdict(list)
    for q, x in enumerate(questions):
        for token in x.tokens:
            places[token].append(q)
    # A block's tokens are bounded, and so are the rows that the frequencies come in.
    names = F.broadcast(spark.createDataFrame([(x,) for x in places], "token string"))
    counted = docs.select(F.explode(F.array_distinct("tokens")).alias("token")).join(names, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()
    weight = {x.token: (log(1 + (n - x.n + 0.5) / (x.n + 0.5)), np.array(places[x.token], np.int64)) for x in counted}
    shared = spark.sparkContext.broadcast((np.array([x.id for x in questions], np.int64), weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight = shared.value
        best = Best(len(names), k, digits)
        step = max(1, min(1024, SCORES // max(1, len(names))))
        held: list[tuple[int, np.ndarray]] = []

        def settle() -> None:
            held.sort(key=lambda x: x[0])
            scores = np.stack([x for _, x in held], 1)
            best.add(0, np.where(scores > 0, scores, np.nan), np.array([x for x, _ in held], np.int64))
            held.clear()

        for batch in batches:
            for key, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words.as_py()
                own = np.zeros(len(names))
                for token, tf in Counter(words).items():
                    if token in weight:
                        idf, at = weight[token]
                        own[at] += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / mean))
                held.append((key, own))
                if len(held) == step:
                    settle()
        if held:
            settle()
        yield from best.rows(names)

    return docs.filter("id IS NOT NULL").mapInArrow(score, FOUND)
