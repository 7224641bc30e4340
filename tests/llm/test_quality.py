import bisect
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import quality
from lectern.llm.queries import op8_quality


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    table, n_lines = rng.normal(size=(11, quality.N_FEATURES)), np.array([1, 4, 6])
    field = quality.Field(np.stack([np.quantile(table[:, f], quality.QUANTILES) for f in range(quality.N_FEATURES)]))
    field.weights, field.pairs = rng.normal(size=len(field.weights)), rng.normal(size=(2, 2))
    cells = field.cells(table, n_lines)
    good, pairs = field.marginals(cells, n_lines)
    score, at, expected, expected_pairs = field.weights[cells].sum(1), 0, [], np.zeros((2, 2))
    for n in n_lines:
        ways = list(itertools.product((0, 1), repeat=int(n)))
        weight = np.exp([sum(score[at + k] * y for k, y in enumerate(w)) + sum(field.pairs[a, b] for a, b in zip(w, w[1:], strict=False)) for w in ways])
        weight /= weight.sum()
        expected += list(np.array(ways).T @ weight)
        for w, p in zip(ways, weight, strict=True):
            for a, b in zip(w, w[1:], strict=False):
                expected_pairs[a, b] += p
        at += n
    assert np.allclose(good, expected) and np.allclose(pairs, expected_pairs)


def test_features_of_lines_and_blocks(monkeypatch):
    texts = ["", "One two.\n\n$$$ ### x\nsame\nsame", "é " * 1000, "\n", "a" * 5000]
    table, lengths, n_lines = quality.features(texts)
    assert list(n_lines) == [1, 5, 1, 2, 1] and len(table) == len(lengths) == 10 and np.isfinite(table).all()
    assert table[4][-1] == table[5][-1] == 2 / 5 and table[1][-1] == 0
    monkeypatch.setattr(quality, "BLOCK", 3)
    assert np.allclose(quality.features(texts)[0], table)


def line_features(line, lines):
    """Of one line, byte by byte and word by word."""
    data = line.encode()
    kind = lambda b: "space" if b in b" \t\n\x0b\x0c\r" else "lower" if 97 <= b <= 122 else "upper" if 65 <= b <= 90 else "digit" if 48 <= b <= 57 else "symbol" if 33 <= b <= 126 else "other"
    kinds = [kind(b) for b in data]
    words = [x for x in re.split(rb"[\x20\x09-\x0d]+", data) if x]
    some, chars = max(len(words), 1), max(len(data), 1)
    odd = lambda b: kind(b) == "symbol" and chr(b) not in ".,;:?'\")("
    counts = Counter(words)
    letters = max(sum(k in ("lower", "upper", "other") for k in kinds), 1)
    first = (kinds or ["space"])[0]  # an empty line begins and ends with its line feed
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        sum(map(len, words)) / some,
        kinds.count("upper") / letters,
        kinds.count("digit") / chars,
        kinds.count("symbol") / chars,
        sum(map(odd, data)) / chars,
        sum(a == b == "symbol" for a, b in zip(kinds, kinds[1:], strict=False)) / some,
        sum(odd(w[-1]) for w in words) / some,
        sum(len(w) == 1 and odd(w[0]) for w in words) / some,
        len(counts) / some,
        max(counts.values(), default=0) / some,
        sum(len(w) <= 3 for w in words) / some,
        float(data[-1:] == b"."),
        {"upper": 1.0, "lower": 2.0}.get(first, 0.0),
        lines.count(line) / len(lines) if lines.count(line) > 1 else 0.0,
    ]


def brute_force(field, text):
    """A document's score, line by line."""
    lines = text.split("\n")
    own = [[bisect.bisect_right(list(e), x) for e, x in zip(field.edges, line_features(line, lines), strict=True)] for line in lines]
    weight = field.weights.reshape(3, quality.N_FEATURES, field.width)
    none = [field.width - 1] * quality.N_FEATURES
    emit = []
    for k in range(len(lines)):
        places = (own[k], own[k - 1] if k else none, own[k + 1] if k + 1 < len(lines) else none)
        emit.append(sum(weight[p][f][b] for p, bins in enumerate(places) for f, b in enumerate(bins)))
    add = lambda *x: max(x) + math.log(sum(math.exp(y - max(x)) for y in x))
    forward = [[0.0, emit[0]]]
    for e in emit[1:]:
        forward.append([add(*(forward[-1][a] + field.pairs[a][b] for a in (0, 1))) + b * e for b in (0, 1)])
    backward = [[0.0, 0.0]]
    for e in emit[:0:-1]:
        backward.append([add(*(field.pairs[a][b] + b * e + backward[-1][b] for b in (0, 1))) for a in (0, 1)])
    good = [math.exp(f[1] + b[1] - add(f[0] + b[0], f[1] + b[1])) for f, b in zip(forward, backward[::-1], strict=True)]
    sizes = [len(x.encode()) + 1 for x in lines]
    share = min(max(sum(g * n for g, n in zip(good, sizes, strict=True)) / sum(sizes), 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-(field.curve[0] * math.log(share / (1 - share)) + field.curve[1])))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    field = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    found = {x.doc_id: x.score for x in op8_quality(spark, sf).collect()}
    texts = {x.doc_id: x.text for x in docs.collect()}
    assert set(found) == set(texts)
    for k, text in texts.items():
        assert math.isclose(found[k], brute_force(field, text), rel_tol=1e-6, abs_tol=1e-9), k


def test_cells_are_the_same_in_learning_and_scoring(spark):
    """A value on a bin's edge is in the same bin, whether it comes from the learner's table or a text."""
    texts = [f"{'a' * (k % 7)} b{k % 3}, c.\n" * (k % 5 + 1) for k in range(60)]
    table, _, n_lines = quality.features(texts)
    field = quality.Field(np.stack([np.quantile(table[:, f], quality.QUANTILES) for f in range(quality.N_FEATURES)]))
    again = np.concatenate([np.frombuffer(quality.features([t])[0].astype("<f8").tobytes(), "<f8").reshape(-1, quality.N_FEATURES) for t in texts])
    assert (field.cells(again, n_lines) == field.cells(table, n_lines)).all()


def test_good_lines_of_bad_documents_are_learnt_as_good():
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 7))) for _ in range(rng.randint(4, 9))).capitalize() + "."
    bad = lambda: " ".join("".join(rng.choices("#$%@*", k=3)) + "x" for _ in range(rng.randint(4, 9)))
    texts = ["\n".join(good() for _ in range(rng.randint(4, 8))) for _ in range(40)] + ["\n".join([good(), bad(), bad(), bad(), good()]) for _ in range(20)]
    table, lengths, n_lines = quality.features(texts)
    field = quality.fit(table, lengths, n_lines, np.array([1] * 40 + [0] * 20))
    line, _ = field.marginals(field.cells(*quality.features(texts[-1:])[::2]), np.array([5]))
    assert line[0] > 0.8 and line[4] > 0.8 and max(line[1:4]) < 0.5
    scores = field.scores([texts[0], texts[-1]])
    assert scores[0] > 0.9 and scores[1] < 0.1


def test_conflicting_labels_are_not_used(spark):
    docs = spark.createDataFrame([(k, "Good text, all of it." if k % 2 else "### $$$") for k in range(40)], "doc_id long, text string")
    labels = [(k, k % 2) for k in range(40)]
    fields = [quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int").repartition(3)) for x in (labels[2:], [*labels, (0, 1), (1, 0)])]
    assert (fields[0].weights == fields[1].weights).all()


def test_columns_of_any_name_are_carried(spark):
    names = ["doc_id", "text", "a.b", "score", "row", "label"]
    docs = spark.createDataFrame([(k, "x", k, k, k, k) for k in range(3)], names)
    kept = quality.keep_good(docs, quality.train(docs, spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")), 0.0)
    assert kept.columns == names and sorted(map(tuple, kept.collect())) == [(k, "x", k, k, k, k) for k in range(3)]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {x.doc_id: x for x in op8_quality(spark, sf).collect()}
    assert len(rows) == 1000 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in rows.values())
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in rows.values())
    tested = [(rows[x.doc_id].predicted, x.quality) for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[x.doc_id].held_out]
    assert sum(a == b for a, b in tested) >= 0.95 * len(tested)
    assert sum(a == 1 for a, b in tested if b == 1) >= 0.95 * sum(b == 1 for _, b in tested)


@pytest.mark.parametrize("labelled", [[], [(1, None)], [(99, 1)], [(1, 1), (1, 1), (3, 0)]])
def test_edges(spark, labelled):
    docs = spark.createDataFrame([(1, "Good text, all of it.", 5.0), (2, None, 1.0), (3, "### $$$", None), (3, "### $$$", None), (4, "x y " * 40000, 0.0), (None, "", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame(labelled, "doc_id long, quality int")
    field = quality.train(docs, labels)
    rows = quality.score(docs, field).collect()
    assert len(rows) == 6 and all(0 <= x.score <= 1 for x in rows)
    assert rows[2].score == rows[3].score and rows[1].score == rows[5].score
    if not labelled or labelled[0] in ((1, None), (99, 1)):
        assert field is None and all(x.score == 0.5 for x in rows)
    kept = quality.keep_good(docs, field, 0.0)
    assert kept.columns == docs.columns and kept.count() == 6
    assert quality.score(docs.limit(0), field).count() == 0


def test_lines_after_the_400th_are_learnt_from(spark):
    prefix = "The same line in all documents.\n" * 400
    texts = {1: "Good text, all of it, and more of that.\n" * 400, 0: "### $$$ %%% @@@\n" * 400}
    docs = spark.createDataFrame([(k, prefix + texts[k % 2]) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    bad, good = quality.train(docs, labels).share(*quality.features([prefix + texts[0], prefix + texts[1]]))
    assert good - bad > 3  # in log-odds of the share of good text
    scores = quality.score(docs, quality.train(docs, labels)).collect()
    assert min(x.score for x in scores if x.doc_id % 2) > max(x.score for x in scores if not x.doc_id % 2) + 0.01
