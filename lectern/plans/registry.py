"""Queries over the fixture tables, for each operator of the survey that can be checked, with their DuckDB equivalents.

The fixtures are generic: documents stand in for papers, benchmark passages for questions, quality labels for sentiment, html for
a format to be parsed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import labels, prompts, providers, retrieval, training
from lectern.operators.pdf import PdfText
from lectern.plans import sentiment
from lectern.plans.reader import Reader
from lectern.session import shared_path, table
from lectern.sources import files


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.paragraphs(table(spark, sf_dir, "documents"))


def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.html_paragraphs(table(spark, sf_dir, "pages"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.token_counts(table(spark, sf_dir, "documents"))


def drop_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.drop_column(table(spark, sf_dir, "documents"), "source")


def class_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return labels.class_label(rows)


def _labelled(spark: SparkSession, sf_dir: str, text: Column | str = "text") -> DataFrame:
    found = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return table(spark, sf_dir, "documents").select("doc_id", text).join(found, "doc_id")


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.clean(_labelled(spark, sf_dir))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return labels.stratified_split(rows)


def dedup_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are told apart by their digests, made where they are read: none is returned, so none is shuffled."""
    rows = _labelled(spark, sf_dir, F.sha2("text", 256).alias("text"))
    return labels.stratified_split(labels.one_per_text(rows, label_col="label")).select("doc_id", "label", "split")


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction"))
    return labels.accuracy(rows).select(F.round("accuracy", 9).alias("accuracy"), "n")


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, against all."""
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.search(rows.filter(F.col("vec_id") % 50 == 0), rows, 5)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 5)


def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.conversation_context(table(spark, sf_dir, "conversations"))


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate index against exact search: how many hits there are, and whether 9 in 10 of them are found."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = rows.filter(F.col("vec_id") % 50 == 0)
    index = retrieval.VectorIndex.save(rows, shared_path(spark, "ann"))
    index.fit_projections()
    found = retrieval.recall(retrieval.VectorIndex.load(spark, index.path).approximate(asked, 5), index.search(asked, 5))
    return found.select("n", (F.col("recall") >= 0.9).alias("enough"))


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index: saved with half of the vectors, loaded, the other half added."""
    rows = table(spark, sf_dir, "embeddings")
    path = shared_path(spark, "index")
    retrieval.VectorIndex.save(rows.filter("vec_id % 2 = 0"), path)
    index = retrieval.VectorIndex.load(spark, path)
    index.add(rows.filter("vec_id % 2 <> 0"))
    return index.rows.select("vec_id", F.size("embedding").alias("width"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def embeddings_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "embeddings")
    files.write_embeddings(table(spark, sf_dir, "embeddings"), path)
    return spark.read.parquet(path).select("vec_id", F.element_at("embedding", 1).cast("double").alias("first"), F.element_at("embedding", -1).cast("double").alias("last"))


def corpus_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of chunks and metadata of papers, through JSON and back."""
    papers, path = table(spark, sf_dir, "documents"), shared_path(spark, "corpus")
    files.write_chunks(text.paragraphs(papers), f"{path}/chunks", json=True)
    files.write_papers(papers.drop("text"), f"{path}/papers", json=True)
    chunks = spark.read.schema("doc_id long, pos long, para string, n_chars long").json(f"{path}/chunks")
    kept = spark.read.schema("doc_id long, lang string, source string").json(f"{path}/papers")
    return chunks.join(kept, "doc_id").select("doc_id", "pos", "para", "lang", "source")


def corpus_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader's store, built from documents: how many chunks each has, with vectors of which width."""
    papers = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    reader = Reader(spark, shared_path(spark, "store"), providers.HashEmbedder(32), providers.EchoModel(), separator="\n")
    reader.build(papers.filter("doc_id % 2 = 0"))
    reader.add(papers.filter("doc_id % 2 <> 0"))
    chunks = spark.read.parquet(f"{reader.store}/chunks").join(reader.index().rows, "chunk_id")
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.min(F.size("embedding")).alias("width"))


def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made into PDF files of one page, a string for each line in two-byte codes, stored, read as files and parsed."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("<"), F.hex(F.encode(x, "UTF-16BE")), F.lit("> Tj T*")))
    page = F.concat(F.lit("BT /F1 9 Tf\n"), F.array_join(lines, "\n"), F.lit("\nET"))
    head = "%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n" + (
        "3 0 obj << /Type /Page /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >> endobj\n5 0 obj << /Type /Font /Subtype /Type0 >> endobj\n4 0 obj << /Length "
    )
    content = F.concat(F.lit(head), F.length(page).cast("string"), F.lit(" >> stream\n"), page, F.lit("\nendstream endobj\n%%EOF")).cast("binary")
    made = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return providers.parse_pdfs(made, PdfText()).select("doc_id", "text", "error")


def sentiment_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents through a CSV of reviews: read, cat dropped, labelled, cleaned, split, saved by split and read back."""
    path = shared_path(spark, "reviews")
    rows = _labelled(spark, sf_dir).groupBy("text").agg(F.min("label").alias("label"))
    files.write_reviews(rows.select(F.lit("all").alias("cat"), F.col("label").cast("string").alias("label"), F.col("text").alias("review")), f"{path}/csv")
    files.write_dataset(sentiment.prepare(files.read_reviews(spark, f"{path}/csv")), f"{path}/dataset")
    train, test = (files.read_dataset(spark, f"{path}/dataset", x) for x in ("train", "test"))
    return train.unionByName(test).select(F.sha2("review", 256).alias("review"), "label", "label_name", "split")


def best_by_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models that give every row the same probability, by their log loss on the labels."""
    rows = table(spark, sf_dir, "labels").select(F.col("quality").alias("label"))
    models = F.array(*(F.struct(F.lit(f"always {p}").alias("model"), F.lit(p).alias("positive")) for p in (0.5, 0.8, 0.95)))
    return training.log_losses(rows.select("label", F.inline(models)))


def guided_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.guided_prompts(table(spark, sf_dir, "documents"))


def corpus_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bm25_topk(spark, sf_dir)
    found = prompts.corpus_prompts(hits, table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
    return found.select("question_id", "prompt", F.concat_ws(",", F.transform("sources", lambda x: x["doc_id"].cast("string"))).alias("sources"))


def guided_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts over whole texts, answered by a stub, which returns a prompt's first line."""
    asked = prompts.guided_prompts(table(spark, sf_dir, "documents"))
    return providers.complete(asked, providers.EchoModel()).select("doc_id", "part", "answer")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (paragraphs, html_paragraphs, token_counts, drop_column, class_label, clean, stratified_split, dedup_split, accuracy, cosine_topk, bm25_topk, conversation_context, guided_prompt, corpus_prompt, guided_reading,
              ann_recall, index_rows, embeddings_stored, corpus_stored, corpus_index, pdf_text, sentiment_prepare, best_by_loss)
}

_SPLIT = """CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id)
    <= floor(count(*) OVER (PARTITION BY label) * 0.2) THEN 'test' ELSE 'train' END AS split"""

_PARAGRAPHS = """
SELECT doc_id, pos, para FROM (
    SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS para FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
) WHERE trim(para, ' ') <> ''
"""

_BM25 = """
WITH asked AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '\\p{L}+'))) AS token FROM benchmark),
docs AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS tokens FROM documents),
rows AS (SELECT doc_id, len(tokens) AS length, unnest(tokens) AS token FROM docs),
tf AS (SELECT doc_id, length, token, count(*) AS tf FROM rows GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
total AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM docs),
scored AS (
    SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
    FROM tf JOIN df USING (token) JOIN asked USING (token), total GROUP BY item_id, doc_id
),
hits AS (
    SELECT item_id AS question_id, doc_id AS id, score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored
    ) WHERE rank <= 5
)
"""

_GUIDED = f"""
WITH parts AS ({_PARAGRAPHS}),
filled AS (SELECT doc_id, string_agg(para, chr(10) ORDER BY pos) AS context FROM parts GROUP BY doc_id),
context AS (SELECT d.doc_id, coalesce(context, '') AS context FROM documents AS d LEFT JOIN filled AS f ON f.doc_id = d.doc_id),
named AS (SELECT unnest(['abstract', 'method', 'problem', 'conclusion']) AS part)
"""

ORACLES: dict[str, str] = {
    "paragraphs": f"SELECT doc_id, pos, para, length(para) AS n_chars FROM ({_PARAGRAPHS})",
    "html_paragraphs": """
SELECT page_id, pos, trim(regexp_replace(para, '<[^>]*>', '', 'g'), ' ') AS para FROM (
    SELECT page_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS para FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS parts FROM pages)
) WHERE trim(regexp_replace(para, '<[^>]*>', '', 'g'), ' ') <> ''
""",
    "token_counts": r"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS token FROM documents) GROUP BY ALL",
    "drop_column": "SELECT doc_id, text, lang, n_chars FROM documents",
    "class_label": """
SELECT doc_id, CASE WHEN quality IN (0, 1) THEN quality END AS label, CASE quality WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' END AS label_name FROM labels
""",
    "clean": "SELECT doc_id, text, quality AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND trim(text, ' ') <> ''",
    "stratified_split": f"SELECT doc_id, label, {_SPLIT} FROM (SELECT doc_id, quality AS label FROM labels)",
    "dedup_split": f"""
SELECT doc_id, label, {_SPLIT} FROM (
    SELECT min(doc_id) AS doc_id, any_value(quality) AS label FROM documents JOIN labels USING (doc_id) GROUP BY text
)
""",
    "accuracy": "SELECT round(avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL",
    "cosine_topk": """
SELECT query_id, id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
        SELECT q.vec_id AS query_id, x.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])), 6) AS score
        FROM embeddings AS q JOIN embeddings AS x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
    )
) WHERE rank <= 5
""",
    "bm25_topk": f"{_BM25} SELECT question_id, id, score, rank FROM hits",
    "conversation_context": "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id",
    "guided_prompt": f"{_GUIDED} SELECT doc_id, part, 'State the ' || part || ' of this paper.' || chr(10) || chr(10) || context AS prompt FROM context, named",
    "corpus_prompt": f"""
{_BM25}, found AS (
    SELECT question_id, string_agg('[' || rank || '] ' || text, chr(10) ORDER BY rank) AS context, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS sources
    FROM hits JOIN documents ON doc_id = id GROUP BY question_id
)
SELECT item_id AS question_id, 'Answer from the passages.' || chr(10) || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || text AS prompt, coalesce(sources, '') AS sources
FROM benchmark LEFT JOIN found ON item_id = question_id
""",
    "guided_reading": f"{_GUIDED} SELECT doc_id, part, 'State the ' || part || ' of this paper.' AS answer FROM context, named",
    "ann_recall": "SELECT sum(least(5, total - 1)) AS n, true AS enough FROM (SELECT vec_id, count(*) OVER () AS total FROM embeddings) WHERE vec_id % 50 = 0",
    "index_rows": "SELECT vec_id, len(embedding) AS width, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings",
    "embeddings_stored": "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last FROM embeddings",
    "corpus_stored": f"SELECT p.doc_id, pos, para, lang, source FROM ({_PARAGRAPHS}) AS p JOIN documents AS d ON d.doc_id = p.doc_id",
    "corpus_index": f"SELECT doc_id, count(*) AS chunks, 32 AS width FROM ({_PARAGRAPHS}) GROUP BY doc_id",
    "pdf_text": "SELECT doc_id, text, CAST(NULL AS VARCHAR) AS error FROM documents",
    "sentiment_prepare": """
WITH rows AS (SELECT text, min(quality) AS label FROM documents JOIN labels USING (doc_id) WHERE trim(text, ' ') <> '' GROUP BY text)
SELECT sha256(text) AS review, label, CASE label WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' END AS label_name,
       CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(text), text) <= floor(count(*) OVER (PARTITION BY label) * 0.2) THEN 'test' ELSE 'train' END AS split
FROM rows WHERE label IN (0, 1)
""",
    "best_by_loss": """
WITH models AS (SELECT 'always ' || p AS model, p FROM (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.95::DOUBLE)) AS t(p)),
losses AS (SELECT model, round(-avg(ln(CASE quality WHEN 1 THEN p ELSE 1 - p END)), 9) AS loss FROM labels, models WHERE quality IS NOT NULL GROUP BY model)
SELECT model, loss, model = (SELECT arg_min(model, loss) FROM losses) AS best FROM losses
""",
}
