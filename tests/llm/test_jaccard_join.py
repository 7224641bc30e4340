import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import jaccard_join
from lectern.llm.components import components

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, n=4, share=85, of=100):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(UP))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and of * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


@settings(deadline=None, max_examples=100)
@given(st.integers(1, 900), st.integers(0, 10**9), st.sampled_from([(85, 100), (80, 100), (1, 2)]))
def test_linked_sets_share_enough_signatures(size, seed, threshold):
    """Of two sets that just link, however the differences fall, each shares as many signatures as it must."""
    share, of = threshold
    rng = random.Random(seed)
    a = [rng.randrange(2**63) for _ in range(size)]
    differ = (of - share) * 2 * size // (of + share)
    b = list(a)
    for _ in range(rng.randint(0, max(differ, 0))):
        if rng.random() < 0.5 and len(b) > 1:
            b.pop(rng.randrange(len(b)))
        else:
            b.append(rng.randrange(2**63))
    common, union = len(set(a) & set(b)), len(set(a) | set(b))
    if of * common < share * union or set(a) == set(b):
        return
    ranges = jaccard_join.Ranges(share, of, max(len(a), len(b)))
    doc, sig, least = jaccard_join.signatures(np.array(sorted(a) + sorted(b), np.uint64), np.array([len(a), len(b)]), ranges)
    by = [{}, {}]
    for d, s, x in zip(doc, sig, least, strict=True):
        by[d].setdefault(x >> 20, (x & ((1 << 20) - 1), set()))[1].add(s)
    both = [set().union(*(s for _, s in x.values())) for x in by]
    assert any(len(s & both[1]) >= need for need, s in by[0].values())
    assert any(len(s & both[0]) >= need for need, s in by[1].values())


def texts(seed=3):
    """Groups of near copies of all sizes, chains, documents that share a passage, copies, and odd ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows, n = [], 0
    for size in (7, 9, 12, 20, 40, 90, 200, 400):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for _ in range(6):
                rows.append(" ".join(base))
                for _ in range(max(1, size // 60)):
                    base = list(base)
                    base[rng.randrange(len(base))] = word()
    rows += [" ".join(passage + [word() for _ in range(rng.randint(0, 30))]) for _ in range(60)]
    rows += ["copy of this very text"] * 30 + ["Copy of\tthis very text", "one", "ONE", "two words", "", None, " \n", "x y z w " * 3000]
    rng.shuffle(rows)
    for x in rows:
        n += rng.randint(1, 5)
        yield n, x


def test_against_brute_force(spark):
    rows = list(texts())
    df = spark.createDataFrame([(*r, "a", 1, "g") for r in rows], "doc_id long, text string, a string, id int, set string").repartition(6)
    found = {tuple(x) for x in jaccard_join.similar(df, group_tokens=5000, counters=3, batch_tokens=3000).collect()}
    assert found == brute_force(rows)
    left = jaccard_join.one_of_each(df, n=5, share=80, of=100)
    assert left.columns == df.columns and {x.doc_id for x in left.collect()} == {c for _, _, c in brute_force(rows, 5, 80, 100)}


def test_queries_are_bounded_by_the_matrix_before_groups_are_opened(spark):
    """Documents that share some signatures with other groups: most are turned away by the stored unions, and none asks its own group."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for _ in range(12):
        passage = [word() for _ in range(60)]
        for _ in range(12):
            base = passage + [word() for _ in range(rng.choice((3, 14, 18)))]
            rows += [" ".join(base), " ".join([*base[:-1], word()])]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    seen = {}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {tuple(x) for x in jaccard_join.similar(df, group_tokens=3000, seen=seen).collect()}
    assert found == brute_force(rows)
    assert 0 < seen["qualified"] < seen["asked"]


def test_a_groups_members_are_bounded_by_the_union_of_the_others():
    a, b, c = np.arange(100), np.arange(3, 100), np.concatenate([np.arange(40), np.arange(1000, 1060)])
    group = jaccard_join.Group([7, 8, 9], [a, b, c], 85, 100)
    assert group.links([a, b, c]) == [(7, 8)] and group.counted == 2  # c is turned away by the bound
    assert list(group.union) == sorted({*a, *b, *c}) and len(jaccard_join.places(group.union, np.array([5, 500, 1001]))) == 2


def test_one_of_each_carries_columns_of_any_name(spark):
    names = ["doc_id", "text", "gone", "a.b", "component_id", "row"]
    df = spark.createDataFrame([(k, f"one two three four five {k // 2}", k, k, k, k) for k in range(6)], names)
    left = jaccard_join.one_of_each(df)
    assert left.columns == names and sorted(map(tuple, left.collect())) == [(k, f"one two three four five {k // 2}", k, k, k, k) for k in (0, 2, 4)]


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.similar(empty).count() == 0 and jaccard_join.one_of_each(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (None, "q r s t"), (4, None), (5, "z"), (5, "z")], "doc_id long, text string")
    rows = sorted(map(tuple, jaccard_join.similar(odd).collect()), key=repr)
    assert rows == sorted([(None, 2, 3), (3, 2, 3), (None, 1, None), (4, 0, 4), (5, 1, 5), (5, 1, 5)], key=repr)


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(500, 501), (501, 500)]
    found = {tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {(k, 100) for k in range(100, 161)} | {(k, 1) for k in range(1, 40)} | {(500, 500), (501, 500)}
