import hashlib
import math
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lectern.llm import mixing

TOKENS = st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(0, 10**6), min_size=1, max_size=8)


class Local(mixing.Sources):
    """The sums without Spark, source by source."""

    def __init__(self, tokens):
        some = [x for x in tokens.values() if x > 0]
        self.total, self.n = sum(some), len(some)
        self.shares = [x / self.total for x in some]
        self.least, self.most = (math.log(f(self.shares)) for f in (min, max))

    def weights(self, e):
        raised = [math.exp(e * (math.log(s) - self.most)) for s in self.shares]
        return [x / sum(raised) for x in raised]

    def sums(self, exponents):
        found = []
        for e in exponents:
            w = self.weights(e)
            found.append((math.log(sum(math.exp(e * (math.log(s) - self.most)) for s in self.shares)) + e * self.most, -sum(x * math.log(x) for x in w if x > 0)))
        return found


def entropy(w):
    return -sum(x * math.log(x) for x in w if x > 0)


@settings(deadline=None, max_examples=60)
@given(TOKENS, st.floats(0.05, 1), st.floats(1, 5))
def test_exponent_meets_its_target(tokens, target, repeats):
    if sum(x > 0 for x in tokens.values()) < 2:
        return
    s = Local(tokens)
    most = math.log(s.n)
    try:
        assert abs(entropy(s.weights(s.exponent(s.total, target, None))) - target * most) < 1e-6 * max(1, most)
    except mixing.Unmeetable:
        assert entropy(s.weights(mixing.STEEPEST)) > target * most - 1e-9
    times = lambda e: max(w / x for w, x in zip(s.weights(e), s.shares, strict=True))
    e = s.exponent(s.total, None, repeats)
    assert 0 <= e <= 1 and times(e) <= repeats * (1 + 1e-9) and (e == 0 or times(e - 1e-6 * e) > repeats * (1 - 1e-4))
    try:
        assert times(s.exponent(s.total, target, repeats)) <= repeats * (1 + 1e-9)
    except mixing.Unmeetable:
        assert entropy(s.weights(mixing.STEEPEST)) > target * most - 1e-9


def test_targets_that_no_exponent_meets_are_an_error():
    with pytest.raises(mixing.Unmeetable):
        Local({"a": 5, "b": 5}).exponent(10, 0.5, None)
    with pytest.raises(mixing.Unmeetable):
        Local({"a": 5, "b": 3}).exponent(24, None, 2.0)
    s = Local({"a": 60, "b": 40})
    e = s.exponent(100, 0.5, None)  # below the natural entropy
    assert e > 1 and abs(entropy(s.weights(e)) - 0.5 * math.log(2)) < 1e-9


def rows():
    out = [(k, "hot", "w " * (k % 17 + 1)) for k in range(900)] + [(1000 + k, f"s{k % 3}", "v " * (k % 5 + 3)) for k in range(120)]
    return out + [(5000, None, "a b c"), (5001, None, None), (5002, "s1", ""), (5003, "s1", "z " * 30000), (5004, "none", ""), (7, "hot", "twice"), (7, "hot", "twice"), (None, "s0", "no id")]


HOWS = [{"entropy_share": 0.9, "repeats": 2.0}, {"entropy_share": 0.35}, {"budget_share": 0.4}, {"budget_share": None, "repeats": 2.0}, {"budget_share": 2.5, "entropy_share": 1.0}]


@pytest.mark.parametrize(("how", "broadcast"), [(x, mixing.BROADCAST_ROWS) for x in HOWS] + [(HOWS[0], 1)])
def test_against_brute_force(spark, monkeypatch, how, broadcast):
    """With rows per source broadcast, and met by a shuffle."""
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    names = ["doc_id", "source", "text", "block", "rank", "a.b", "weight"]
    df = spark.createDataFrame([(*r, 1, "r", 2, 3) for r in rows()], "doc_id long, source string, text string, block int, rank string, `a.b` int, weight int").repartition(4)
    decided, sources = mixing.plan(df, blocks=16, **how)
    md5 = lambda *x: hashlib.md5("|".join(x).encode()).hexdigest()
    docs = []
    for i, s, t in rows():
        rank = md5("" if i is None else str(i))
        docs.append((i, s, t or "", len((t or "").split()), rank, int(rank[:8], 16) % 16))
    tokens = defaultdict(int)
    for _, s, _, n, _, _ in docs:
        tokens[s] += n
    local = Local(tokens)
    budget = None if how.get("budget_share", 1.0) is None else how.get("budget_share", 1.0) * local.total
    e = local.exponent(budget, how.get("entropy_share"), how.get("repeats"))
    weight = dict(zip([k for k in tokens if tokens[k]], local.weights(e), strict=True))
    budget = budget or max(tokens[k] / w for k, w in weight.items())
    want = Counter()
    for source in tokens:
        own = sorted((d for d in docs if d[1] == source), key=lambda d: (md5(source or "", str(d[5])), d[5], d[4], md5(d[2])))
        epochs, rest = divmod(round(weight[source] * budget), tokens[source]) if tokens[source] else (1, 0)
        for d in own:
            place = lambda x: (md5(source or "", str(x[5])), x[5], x[4], md5(x[2]))
            upto = sum(x[3] for x in own if place(x) <= place(d))
            want[d[0], source, d[2], epochs + (rest > 0 and upto <= rest)] += 1
    found = decided.select("id", "source", F.coalesce("row.text", F.lit("")).alias("text"), "copies", "weight").collect()
    assert Counter((x.id, x.source, x.text, x.copies) for x in found) == want
    assert all(math.isclose(x.weight, weight.get(x.source, 0.0), rel_tol=1e-6) for x in found)
    assert {x.source for x in sources.collect()} == set(tokens)
    if how is HOWS[0] and broadcast > 1:
        mixed = mixing.mixed(df, blocks=16, **how)
        assert mixed.columns == names and mixed.count() == sum(x.copies for x in found)
    if how.get("budget_share", 1.0) is None:
        assert min(x.copies for x in found) >= 1


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.plan(empty, entropy_share=0.5)[0].count() == 0 and mixing.mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", ""), (2, "b", None)], "doc_id long, source string, text string")
    assert [x.copies for x in mixing.plan(blank, repeats=2.0)[0].collect()] == [1, 1]
    one = spark.createDataFrame([(k, None, "a b") for k in range(5)], "doc_id long, source string, text string")
    assert [x.copies for x in mixing.plan(one, entropy_share=0.5, repeats=2.0)[0].collect()] == [1] * 5


def test_the_query_mixes(spark):
    from lectern.llm.queries import op9_mixing

    found = op9_mixing(spark, "/root/testdata/sf0.001").collect()
    assert len({x.copies for x in found}) > 1 and max(x.weight for x in found) > 1.1 * min(x.weight for x in found)
