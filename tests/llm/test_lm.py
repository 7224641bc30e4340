import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lectern.llm import lm
from lectern.llm.queries import op5_lm_scores

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute_force(rows):
    """Scores with counts in dictionaries and expectation-maximisation over every deleted token."""
    docs = [(i, [*re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(UP)), "\n"]) for i, t in rows]
    one, two, start = Counter(), Counter(), "\n\n"
    for i, w in docs:
        if not held_out(i):
            one.update(w)
            two.update(zip([start, *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    one[start] = sum(not held_out(i) for i, _ in docs)
    bucket = lambda c: c if c < 4 else int(math.floor(2 * math.log2(c)))
    level = 0.5
    for _ in range(200):
        seen = [(c, (c - 1) / (n - 1) * (v + 1)) for w, c in one.items() if w != start] if n > 1 else []
        level = (sum(c * level * r / (level * r + 1 - level) for c, r in seen) + 0.5) / (n + 1)
    low = lambda c, n: (1 - level) / (v + 1) + level * c / max(n, 1) if n else 1.0
    ratios = defaultdict(list)
    for i, w in docs:
        if not held_out(i):
            for a, b in zip([start, *w], w, strict=False):
                if one[a] > 1:
                    ratios[bucket(one[a])].append((two[a, b] - 1) / (one[a] - 1) / low(one[b] - 1, n - 1))
    weight = {}
    for k, r in ratios.items():
        r, m = np.array(r), 0.5
        for _ in range(200):
            m = ((m * r / (m * r + 1 - m)).sum() + 0.5) / (len(r) + 1)
        weight[k] = m
    for i, w in docs:
        base = score = 0.0
        for a, b in zip([start, *w], w, strict=False):
            p0, p1 = (one[b] + 1) / (n + v + 1), low(one[b], n)
            m = weight.get(bucket(one[a]), 0.0)
            p2 = two[a, b] / one[a] if one[a] else 0.0
            base, score = base + math.log10(p0), score + math.log10((1 - m) * p1 + m * p2)
        yield i, held_out(i), len(w), sum(one[b] > 0 for b in w), n, base, score


def same(found, expected):
    order = lambda x: (x[0] is not None, x[0] or 0, x[2], x[5])
    found, expected = sorted(map(tuple, found), key=order), sorted(expected, key=order)
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9), (a, b)
        assert math.isclose(a[6], b[6], rel_tol=2e-3, abs_tol=1e-3 * a[2]), (a, b)  # ratios are binned for learning the weights


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = op5_lm_scores(spark, sf).collect()
    same(found, brute_force(rows))
    tokens = sum(x.n_tokens for x in found if x.held_out)
    assert sum(x.score - x.base_score for x in found if x.held_out) / tokens > 0.05


def test_batches_and_edges(spark):
    rows = [(k, f"the word{k % 5} of the {'very ' * (k % 4)}End") for k in range(200)] + [(None, "the null"), (3, None), (9, ""), (9, ""), (77, "w " * 50000), (1000, "\n\t "), (1001, "Ünïcode ünïcode")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, part int, batch int").repartition(4)
    same(lm.scores(df, batch_bytes=3000).collect(), brute_force(rows))
    assert lm.scores(df.limit(0)).count() == 0
    only = [k for k in range(60) if held_out(k)]
    found = lm.scores(spark.createDataFrame([(k, "a b") for k in only], "doc_id long, text string")).collect()
    assert all(x.train_tokens == 0 and x.n_known == 0 and x.score == x.base_score == 0.0 for x in found)


def test_rows_grow_with_the_input_alone(spark):
    docs = [(k, " ".join(f"w{(k * 31 + j * j) % 5000}" for j in range(60))) for k in range(600)]
    sent = []
    for n in (200, 600):
        own = spark.createDataFrame(docs[:n], "id long, text string").withColumns({"train": F.lit(True), "batch": F.col("id") % (n // 50), "part": F.lit(None).cast("long"), "reply": F.lit(None).cast("binary")})
        sent.append(lm._ask(own, lm.PARTS).count())
    assert sent[1] <= 3 * sent[0]


def test_python_gets_few_rows_at_once(spark, monkeypatch):
    """All rows of a task at once took more memory than executors have."""
    sizes, plain = [], lm.staged

    def spied(df, name, *limit):
        probe = plain(spark.range(1000).coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [x.num_rows]}) for x in batches), "n long"), "probe", *limit)
        sizes.append(max(x.n for x in probe.collect()))
        return plain(df, name, *limit)

    monkeypatch.setattr(lm, "staged", spied)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    lm.scores(spark.createDataFrame([(k, "a b a") for k in range(20)], "doc_id long, text string")).count()
    assert len(sizes) == 2 and max(sizes) <= 256
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_levels_of_counts():
    counts = np.array([1, 2, 4095, 4096, 4097, 5000, 2**40])
    found = lm._level(counts)
    assert list(found[:4]) == [1, 2, 4095, 4096] and (np.diff(found) >= 0).all() and found[-1] == lm.SINGLE + 28 * lm.FINE
    assert list(lm._bucket(np.array([0, 1, 2, 3, 4, 5, 6, 8, 2**60]))) == [0, 1, 2, 3, 4, 4, 5, 6, 120]


@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=50))
def test_keys_are_packed_and_unpacked(keys):
    keys = np.array(sorted(keys), np.uint64)
    assert (lm.unpack_keys(lm.pack_keys(keys)) == keys).all()


def test_probabilities_sum_to_one():
    """Over all words of the vocabulary and one unknown, after a seen context."""
    one, after, n = Counter(a=5, b=3, c=2), Counter(b=3, c=2), 10
    weight = lm.unigram_weight({c: (1, c) for c in one.values()})
    assert 0 < weight < 1
    p1 = {w: (1 - weight) / (len(one) + 1) + weight * one[w] / n for w in [*one, "unknown"]}
    m = 0.3
    assert math.isclose(sum((1 - m) * p1[w] + m * after[w] / 5 for w in p1), 1)
