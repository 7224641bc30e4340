import hashlib
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lectern.llm import exact_dedup
from lectern.llm.exact_dedup import MisraGries


@given(st.lists(st.integers(0, 12), max_size=200), st.integers(1, 6))
def test_misra_gries_keeps_every_frequent_key(keys, size):
    found = MisraGries(size)
    for k in keys:
        found.add(k)
    found.shrink()
    true = Counter(keys)
    assert len(found.counts) <= size
    assert all(k in found.counts for k, n in true.items() if n > len(keys) / (size + 1))
    assert all(n <= true[k] for k, n in found.counts.items())


ROWS = [(1, "a"), (2, None), (3, ""), (4, "a"), (5, "A"), (5, "A"), (None, "a"), (None, "z"), (6, "a " * 50000), (7, "a " * 50000), (8, "q")] + [(100 + k, "hot") for k in range(60)]


@pytest.mark.parametrize("counters", [1, 2, 1024])
def test_marks(spark, counters):
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in ROWS], "doc_id long, text string, digest int, kept string, row int").repartition(5)
    rows = exact_dedup.mark_duplicates(df, counters=counters).collect()
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    by = {hashlib.sha256(t.encode()).hexdigest(): (max((x for x in ids if x is not None), default=None), len(ids)) for t, ids in groups.items()}
    assert len(rows) == len(ROWS) and all((x.keep_id, x.group_size) == by[x.text_sha256] for x in rows)
    assert Counter(x.text_sha256 for x in rows if x.kept) == Counter(list(by))
    assert all(x.doc_id == x.keep_id for x in rows if x.kept)
    left = exact_dedup.drop_duplicates(df, counters=counters)
    assert left.columns == df.columns
    assert sorted((x.text or "", x.doc_id) for x in left.collect()) == sorted((t, max((x for x in ids if x is not None), default=None)) for t, ids in groups.items())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.mark_duplicates(df).count() == 0 and exact_dedup.drop_duplicates(df).count() == 0


def test_columns_of_any_name_are_carried(spark):
    names = ["doc_id", "text", "a.b", "gone", "row", "best", "digest`", "keep_id"]
    df = spark.createDataFrame([(k, "ab"[k % 2], *range(k, k + 6)) for k in range(6)], names)
    left = exact_dedup.drop_duplicates(df, counters=1)
    assert left.columns == names and sorted(map(tuple, left.collect())) == [(k, "ab"[k % 2], *range(k, k + 6)) for k in (4, 5)]
    odd = df.withColumnRenamed("doc_id", "id.of").withColumnRenamed("text", "the.text")
    assert exact_dedup.mark_duplicates(odd, "id.of", "the.text").filter("kept").count() == 2
