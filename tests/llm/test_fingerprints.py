import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import fingerprints
from lectern.llm.queries import op2_fingerprints

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def shingles(text, n=5):
    """The shingle hashes of a text, one by one."""
    words = re.findall(r"[^\x20\x09-\x0d]+", text.translate(UP))
    h = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in words]

    def chain(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
        return signed(seed)

    if not h:
        return set()
    return {chain(h[i : i + n]) for i in range(len(h) - n + 1)} if len(h) >= n else {chain(h)}


def as_text(found, k=128):
    return "".join(f"{x & (2**64 - 1):016x}" for x in sorted(found)[:k])


def likeness(a, b, k=128):
    a, b = set(sorted(a)[:k]), set(sorted(b)[:k])
    union = sorted(a | b)[:k]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda x: -x[0])
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        a, b, c = shingles(t), shingles(edited), shingles(u)
        yield (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), as_text(a), as_text(b), likeness(a, b), likeness(a, c))


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_query_against_brute_force(spark):
    rows = op2_fingerprints(spark, SF).select(*COLUMNS).collect()
    source = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, rows)) == sorted(expected(source))


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(5, None)],
        [(5, "")],
        [(7, "one two")],
        [(1, "é😀 b c d e f g"), (10**12, None), (-4, "x " * 40000), (3, "b\tc\x0bd \n"), (2, "same text here"), (99, "Same text HERE")],
        [(k, f"word{k} and some more words here {k % 3}") for k in range(5000)],
    ],
)
def test_edges(spark, rows):
    df = spark.createDataFrame([(*r, 1, "s", 2, True) for r in rows], "doc_id long, text string, bucket int, sketch string, tie int, ghost boolean")
    found = fingerprints.compare_with_next(df).select(*COLUMNS).collect()
    assert sorted(map(tuple, found)) == sorted(expected(rows))


def test_extreme_and_skewed_ids(spark, monkeypatch):
    texts = lambda k: f"word{k} and some more words here {k % 3}"
    ids = [-(2**63), 2**63 - 1, 10**15, *range(3000)]
    df = spark.createDataFrame([(k, texts(k)) for k in ids], "doc_id long, text string").repartition(3)
    found = fingerprints.compare_with_next(df).select(*COLUMNS).collect()
    assert sorted(map(tuple, found)) == sorted(expected([(k, texts(k)) for k in ids]))


def test_order_and_buckets_where_ids_repeat_or_are_null(spark):
    rows = [(k, k * 7919 % 2**40 - 2**39) for k in range(800)] + [(5, k * 2**54 - 2**62) for k in range(400)] + [(None, k * 2**54 - 2**62) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, tie long").repartition(4)
    seen = []

    def prepare(x):
        seen.append(x)
        return x

    found = [(x.id, x.tie, tuple(x.next)) for x in fingerprints.with_next(df, prepare, ["id", "tie"], per_bucket=20).collect()]
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert sorted(found, key=repr) == sorted([(*a, b) for a, b in zip(order, order[1:] + order[:1], strict=True)], key=repr)
    assert max(x["count"] for x in seen[0].groupBy("bucket").count().collect()) <= 70


def test_groups_are_merged_in_rounds(spark):
    rows = [(k % 3, [k, k + 1000, k % 7]) for k in range(2000)] + [(9, [4]), (None, [1, 2]), (9, None)]
    df = spark.createDataFrame(rows, "g int, s array<long>")
    found = {x.g: list(x.s) for x in fingerprints.merge_groups(df, "g", "s", 16, fan=5).collect()}
    want = {}
    for g, s in rows:
        want.setdefault(g, set()).update(s or [])
    assert found == {g: sorted(s)[:16] for g, s in want.items()}


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (1, "c"), (2, "d")], "doc_id long, text string")
    assert fingerprints.compare_with_next(df).count() == 5


def test_merging_and_estimates(spark):
    a, b = " ".join(f"w{k}" for k in range(3000)), " ".join(f"w{k}" for k in range(1500, 4500))
    df = spark.createDataFrame([(1, a, b)], "id int, a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, F.col("a"), "x", 512), F.col("b"), "y", 512)
    row = df.select(fingerprints.merged(F.col("x"), F.col("y"), 512).alias("m"), fingerprints.resemblance(F.col("x"), F.col("y"), 512).alias("r"), fingerprints.containment(F.col("x"), F.col("y"), 512).alias("c"), fingerprints.distinct_count(F.col("x"), 512).alias("n")).first()
    assert list(row.m) == sorted(shingles(a) | shingles(b))[:512]
    assert abs(row.r - 1 / 3) < 0.08 and abs(row.c - 0.5) < 0.12 and abs(row.n / 2996 - 1) < 0.15
    both = df.select(F.explode(F.array("x", "y")).alias("x")).agg(fingerprints.merge_all(F.col("x"), 512).alias("m")).first()
    assert list(both.m) == list(row.m)


def test_no_python_on_the_main_path(spark):
    plan = fingerprints.compare_with_next(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
