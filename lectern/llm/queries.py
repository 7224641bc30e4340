"""The registered query of each operator and, where SQL can express it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import chat, exact_dedup, fingerprints, jaccard_join, licenses, lm, mixing, packing, quality, warc
from lectern.llm.common import LOWER, UPPER, remove
from lectern.session import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.render(rows))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    found = warc.report(spark, path)
    remove(spark, path)  # the report rests on a table of its own
    return found


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rows = quality.score(documents, quality.train(documents, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to 95 % of the greatest entropy, from whichever side, with none repeated more than twice."""
    decided, _ = mixing.plan(table(spark, sf_dir, "documents"), entropy_share=0.95, repeats=2.0)
    return decided.select(F.col("id").alias("doc_id"), "source", "n_tokens", "block", F.round("weight", 6).alias("weight"), "copies")


def license_files() -> list[tuple[int, str]]:
    """Rows that join the documents in the scan, with ids below zero: the shorter known licences as files have them, in several spellings, and texts
    that are almost one."""
    rows = []
    for k, x in sorted(licenses.LICENCES.items()):
        if len(x) < 5000:
            title = licenses.TITLES.get(k, ["Copyright 2001 Other Holders"])[0]
            rows += [f"{title}\n\nCopyright (c) 2019-2021 Some Holder\n\n{x}\n", x.upper(), "Copyright Some Holder 2020\n" + x.replace(" ", "\n "), f"{x}\nwith one more condition"]
    return [(-1 - n, x) for n, x in enumerate(rows)]


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and some licence files."""
    more = spark.createDataFrame(license_files(), "doc_id long, text string")
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(more))


def license_sql() -> str:
    """The canonical form, the digests and both lookups, in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    punctuation = licenses.PUNCTUATION

    def canonical(text: str) -> str:
        same = f"regexp_replace(regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), {quote(punctuation)}, ' ', 'g'), '[ \\t\\x0B\\f\\r]+', ' ', 'g')"
        same = f"regexp_replace({same}, {quote(licenses.COPYRIGHT)}, '', 'g')"
        for other, one in licenses.SPELLINGS.items():
            same = f"replace({same}, {quote(other)}, {quote(one)})"
        return same

    def known(texts: dict[str, list[str]]) -> str:
        rows = ", ".join(f"({quote(k)}, {quote(x)})" for k, xs in texts.items() for x in xs)
        return f"SELECT sha256({whole(canonical('text'))}) AS digest, min(licence) AS licence FROM (VALUES {rows}) AS t(licence, text) GROUP BY 1"

    def whole(lines: str) -> str:
        return f"trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g'), ' ')"

    texts = licenses.titled(licenses.LICENCES, licenses.TITLES)
    both = {k: [*texts.get(k, []), *licenses.NOTICES.get(k, [])] for k in {**texts, **licenses.NOTICES}}
    more = ", ".join(f"({n}, {quote(x)})" for n, x in license_files())
    return f"""
WITH scanned AS (SELECT doc_id, text FROM documents UNION ALL VALUES {more}),
own AS (SELECT doc_id, {canonical("coalesce(text, '')")} AS lines FROM scanned),
texts AS ({known(both)}),
notices AS ({known(licenses.NOTICES)}),
named AS (
    SELECT doc_id, n.licence FROM (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line FROM own) AS l
    JOIN notices AS n ON n.digest = sha256(trim(l.line, ' '))
),
found AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n_notices FROM named GROUP BY doc_id)
SELECT own.doc_id, sha256({whole("own.lines")}) AS canonical_sha256, t.licence, f.notices, coalesce(f.n_notices, 0) AS n_notices
FROM own LEFT JOIN texts AS t ON t.digest = sha256({whole("own.lines")}) LEFT JOIN found AS f ON f.doc_id = own.doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_fingerprints": op2_fingerprints,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_packing": op4_packing,
    "op5_lm_scores": op5_lm_scores,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_license_scan": op10_license_scan,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
),
escaped AS (
    SELECT *, length(regexp_replace(role, '[\\:]', '\\\0', 'g')) AS role_chars,
           length(regexp_replace(regexp_replace(text, '(\\*)(### |</turn>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1')) AS text_chars,
           CASE WHEN regexp_matches(text, '\\$') THEN 2 WHEN regexp_matches(text, '### |</turn>') THEN 1 ELSE 0 END AS step
    FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + role_chars + 2 + text_chars + 8) AS BIGINT) AS formatted_chars, CAST(max(step) AS BIGINT) AS steps
FROM escaped GROUP BY conv_id
""",
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op6_jaccard_join": f"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
shingled AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END AS s
    FROM worded
),
own AS (SELECT doc_id, len(s) AS n_shingles, hash(list_sort(s)) AS h, s FROM shingled),
tokens AS (SELECT doc_id, n_shingles, unnest(s) AS t FROM own),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM tokens AS a JOIN tokens AS b ON a.t = b.t AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n_shingles, b.n_shingles HAVING 100 * count(*) >= 85 * (a.n_shingles + b.n_shingles - count(*))
),
reached AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reached AS r JOIN pairs AS p ON r.b = p.a),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT doc_id, n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id FROM own LEFT JOIN least ON a = doc_id
""",
    "op7_warc": """
WITH own AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
sized AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM own),
newest AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM sized)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM newest
""",
    "op9_mixing": f"""
WITH RECURSIVE own AS (
    SELECT doc_id, source, text, len(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+')) AS n_tokens, md5(CAST(doc_id AS VARCHAR)) AS rank
    FROM documents
),
placed AS (SELECT *, CAST('0x' || substr(rank, 1, 8) AS BIGINT) % 4096 AS block FROM own),
sources AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM own GROUP BY source),
lists AS (
    SELECT list(tokens ORDER BY source) AS ts, CAST(sum(tokens) AS DOUBLE) AS total,
           list(tokens / (SELECT sum(tokens) FROM sources) ORDER BY source) AS shares FROM sources
),
-- the least exponent with at most the target entropy
target AS (
    SELECT 0 AS step, CAST(0 AS DOUBLE) AS low, CAST(64 AS DOUBLE) AS high FROM lists
    UNION ALL
    SELECT step + 1, CASE WHEN e <= 0.95 * ln(len(shares)) + 1e-12 THEN low ELSE m END, CASE WHEN e <= 0.95 * ln(len(shares)) + 1e-12 THEN m ELSE high END
    FROM (
        SELECT f.*, shares, (low + high) / 2 AS m, list_transform(shares, lambda s: exp((low + high) / 2 * ln(s))) AS r,
               -list_sum(list_transform(r, lambda x: x / list_sum(r) * ln(x / list_sum(r)))) AS e
        FROM target AS f, lists
    ) WHERE step < 70
),
-- the least and the greatest exponent with which no source is repeated more than twice
least AS (
    SELECT 0 AS step, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high FROM lists
    UNION ALL
    SELECT step + 1, CASE WHEN e <= 2.0 THEN low ELSE m END, CASE WHEN e <= 2.0 THEN m ELSE high END
    FROM (
        SELECT f.*, (low + high) / 2 AS m, list_transform(shares, lambda s: exp((low + high) / 2 * ln(s))) AS r,
               list_max(list_transform(range(1, len(r) + 1), lambda i: r[i] / list_sum(r) * total / ts[i])) AS e
        FROM least AS f, lists
    ) WHERE step < 60
),
greatest_one AS (
    SELECT 0 AS step, CAST(1 AS DOUBLE) AS low, CAST(64 AS DOUBLE) AS high FROM lists
    UNION ALL
    SELECT step + 1, CASE WHEN e <= 2.0 THEN m ELSE low END, CASE WHEN e <= 2.0 THEN high ELSE m END
    FROM (
        SELECT f.*, (low + high) / 2 AS m, list_transform(shares, lambda s: exp((low + high) / 2 * ln(s))) AS r,
               list_max(list_transform(range(1, len(r) + 1), lambda i: r[i] / list_sum(r) * total / ts[i])) AS e
        FROM greatest_one AS f, lists
    ) WHERE step < 70
),
found AS (
    SELECT least((SELECT low FROM greatest_one WHERE step = 70), greatest(
        (SELECT high FROM target WHERE step = 70),
        (SELECT CASE WHEN list_max(list_transform(ts, lambda t: total / len(ts) / t)) <= 2.0 THEN 0.0 ELSE (SELECT high FROM least WHERE step = 60) END FROM lists)
    )) AS x
),
weights AS (
    SELECT source, tokens, exp(x * ln(tokens / total)) / list_sum(list_transform(shares, lambda s: exp(x * ln(s)))) AS weight, total FROM sources, lists, found
),
asked AS (SELECT source, weight, CAST(round(weight * total) AS BIGINT) // tokens AS epochs, CAST(round(weight * total) AS BIGINT) % tokens AS rest FROM weights),
ordered AS (
    SELECT p.*, a.weight, a.epochs, a.rest, sum(n_tokens) OVER (
        PARTITION BY p.source ORDER BY md5(p.source || '|' || block), block, rank, md5(coalesce(text, '')) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW
    ) AS upto
    FROM placed AS p JOIN asked AS a ON a.source = p.source
)
SELECT doc_id, source, n_tokens, block, round(weight, 6) AS weight, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies
FROM ordered
""",
    "op10_license_scan": license_sql(),
}
