"""A quality classifier: a linear-chain conditional random field over a document's lines.

Every line is described by shape, symbols and repetition, each put into quantile bins, together with the bins of the lines
before and after it. The field gives each line the label good or bad; its forward-backward marginals, weighted by the lines'
lengths, make the document's share of good text, which a logistic curve turns into a score. Scoring maps rows: nothing is
shuffled, and a text is taken whole.

The field is fitted on the driver, on a bounded sample of labelled rows: ``sample`` of those allowed for learning, the first by the
MD5 of their id, and of each all lines. Only documents are labelled, so the labels of lines are latent: they begin as their document's, and
are then learnt by expectation-maximisation. The expected labels, and pairs of neighbouring labels, are those of the field itself, given the
document's label (``GOOD``, ``BAD``); so a good line of a bad document is learnt as good, and chains are mixed. A bad document of which too little
would be bad (``LEAST_BAD``) keeps its label for all lines.

Defined cases: a null text counts as empty, an empty text is one empty line; rows are scored one by one, so repeated ids and rows
are no matter; labels that are null, other than 0 and 1, contradicted by another of the same id, or of documents that are missing are not
used; without any usable label every score is 0.5; an empty table gives an empty result; columns other than the id, the text and the
label are not read, or carried in a struct whatever their names (``keep_good``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import col, row_of, text_of

#: Where bins part, finer at both ends, as junk is rare.
QUANTILES = (0.01, 0.04, 0.11, 0.22, 0.33, 0.44, 0.56, 0.67, 0.78, 0.89, 0.96, 0.99)
N_FEATURES = 16
#: Log-odds that are added to what the field says of a line being good, in a good document and in a bad one: there, to make up for having been
#: learnt as bad at first.
GOOD, BAD = 3.0, 1.0
#: The least share of a bad document that is taken to be bad.
LEAST_BAD = 0.2
#: After which share of the rounds of learning the lines' expected labels are found, and found again. Until the first, only a line's own
#: features are learnt from, as those of its neighbours would tell all lines of a bad document.
EXPECT = (0.3, 0.45, 0.6, 0.75, 0.9)
#: Bytes of lines that are described at once.
BLOCK = 1 << 20

_CLASS = np.zeros(256, np.uint8)  # 0: other bytes, among them all of letters beyond ASCII
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 3
_CLASS[ord("0") : ord("9") + 1] = 4
_CLASS[[x for x in range(33, 127) if not chr(x).isalnum()]] = 5
_ENDS = np.zeros(256, bool)
_ENDS[[ord(x) for x in ".,;:?'\")("]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (base, inverse))


def _block(lines: list[bytes]) -> np.ndarray:
    """A row of features for each line, but for the last one, which depends on the document."""
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    n = len(lines)
    sizes = np.array([len(x) + 1 for x in lines])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    kind = _CLASS[data]
    total = lambda mask: np.add.reduceat(mask.astype(np.int32), starts).astype(float)
    space = kind == 1
    chars = np.maximum(sizes - 1, 1)
    before = np.concatenate([[True], space[:-1]])
    begins = np.flatnonzero(~space & before)
    after = np.concatenate([space[1:], [True]])
    ends = np.flatnonzero(~space & after) + 1
    line_of = np.searchsorted(starts, begins, "right") - 1
    words = np.bincount(line_of, minlength=n).astype(float)
    some = np.maximum(words, 1)
    lengths = ends - begins
    symbol = (kind == 5) & ~_ENDS[data]
    runs = (kind == 5) & np.concatenate([[False], (kind == 5)[:-1]])
    # words by their hash: a sum of bytes times powers, moved to the word's beginning
    up, down = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * up[:-1], dtype=np.uint64)])
    hashes = (sums[ends] - sums[begins]) * down[begins]
    hashes ^= hashes >> np.uint64(29)
    order = np.lexsort((hashes, line_of))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])
    distinct = np.bincount(line_of[order][new], minlength=n)
    most = np.zeros(n)
    if len(order):
        counts = np.diff(np.concatenate([np.flatnonzero(new), [len(order)]]))
        np.maximum.at(most, line_of[order][new], counts)
    per_word = lambda x: np.bincount(line_of, x, minlength=n) / some
    last = data[np.maximum(starts + sizes - 2, starts)]
    first = kind[starts]
    letters = np.maximum(total((kind == 2) | (kind == 3) | (kind == 0)), 1)
    return np.stack(
        [
            np.log1p(sizes - 1),
            np.log1p(words),
            per_word(lengths),
            total(kind == 3) / letters,
            total(kind == 4) / chars,
            total(kind == 5) / chars,
            total(symbol) / chars,
            total(runs) / some,
            per_word(symbol[ends - 1].astype(float)),
            per_word((lengths == 1) & symbol[begins]),
            distinct / some,
            most / some,
            per_word(lengths <= 3),
            (last == ord(".")).astype(float),
            (first == 3).astype(float) + 2 * (first == 2),
        ],
        axis=1,
    )


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of features, lengths of lines, number of lines of each text), over all lines of the texts in order."""
    found, block, held, repeats, n_lines, lengths = [], [], 0, [], [], []
    for text in texts:
        lines = text.encode().split(b"\n")
        n_lines.append(len(lines))
        seen = Counter(lines)
        repeats += [seen[x] / len(lines) if seen[x] > 1 else 0.0 for x in lines]
        for x in lines:
            block.append(x)
            held += len(x) + 1
            lengths.append(len(x) + 1)
            if held >= BLOCK:
                found.append(_block(block))
                block, held = [], 0
    if block:
        found.append(_block(block))
    table = np.concatenate(found) if found else np.zeros((0, N_FEATURES - 1))
    return np.column_stack([table, repeats]) if len(table) else np.zeros((0, N_FEATURES)), np.array(lengths, float), np.array(n_lines, np.int64)


class Field:
    """The linear-chain field: one weight for each bin of each feature at three places (the line, the one before, the one after), of the label
    good against bad, and one for each pair of neighbouring labels."""

    def __init__(self, edges: np.ndarray):
        self.edges = edges  # of bins, by feature
        self.width = len(QUANTILES) + 2  # bins, and one more for a line that is not there
        self.weights = np.zeros(3 * N_FEATURES * self.width)
        self.pairs = np.zeros((2, 2))
        self.curve = np.array([1.0, 0.0])

    def cells(self, table: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """Where in the weights each line's features are."""
        own = np.stack([np.searchsorted(e, table[:, f], "right") for f, e in enumerate(self.edges)], 1) if len(table) else np.zeros((0, N_FEATURES), np.int64)
        ends = np.cumsum(n_lines)
        before, after = np.full_like(own, self.width - 1), np.full_like(own, self.width - 1)
        before[1:], after[:-1] = own[:-1], own[1:]
        before[ends - n_lines], after[ends - 1] = self.width - 1, self.width - 1
        base = np.arange(N_FEATURES) * self.width
        step = N_FEATURES * self.width
        return np.concatenate([own + base, before + base + step, after + base + 2 * step], 1)

    def marginals(self, cells: np.ndarray, n_lines: np.ndarray, prior: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line by forward-backward, and the expected number of each pair of neighbouring labels. prior: log-odds that are
        known of each line besides."""
        score = self.weights[cells].sum(1) + prior
        order = np.argsort(-n_lines, kind="stable")
        starts = (np.cumsum(n_lines) - n_lines)[order]
        sizes = n_lines[order]
        most = int(sizes[0]) if len(sizes) else 0
        alive = [int(np.searchsorted(-sizes, -t, "left")) for t in range(most + 1)]  # alive[t]: sequences longer than t
        forward = np.zeros((len(score), 2))
        backward = np.zeros((len(score), 2))
        emit = np.stack([np.zeros_like(score), score], 1)
        at = starts
        forward[at] = emit[at]
        for t in range(1, most):
            at = starts[: alive[t]] + t
            forward[at] = emit[at] + np.logaddexp(forward[at - 1, :1] + self.pairs[0], forward[at - 1, 1:] + self.pairs[1])
        total = np.zeros((2, 2))
        for t in range(most - 2, -1, -1):
            at = starts[: alive[t + 1]] + t
            coming = emit[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(self.pairs[:, 0] + coming[:, :1], self.pairs[:, 1] + coming[:, 1:])
            joint = forward[at][:, :, None] + self.pairs + coming[:, None, :]
            whole = np.logaddexp(*(forward[at] + backward[at]).T)
            total += np.exp(joint - whole[:, None, None]).sum(0)
        both = forward + backward
        return np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1])), total

    def share(self, table: np.ndarray, lengths: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """The log-odds of the share of good text of each document: its lines' marginals, weighted by length."""
        good, _ = self.marginals(self.cells(table, n_lines), n_lines)
        starts = np.cumsum(n_lines) - n_lines
        share = np.clip(np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts), 1e-6, 1 - 1e-6)
        return np.log(share / (1 - share))

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] * self.share(*features(texts)) + self.curve[1]))) if texts else np.zeros(0)


def fit(table: np.ndarray, lengths: np.ndarray, n_lines: np.ndarray, labels: np.ndarray, rounds: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Fits the field by Adam on the likelihood of the lines' latent labels, then the curve by Newton steps on the documents'."""
    field = Field(np.stack([np.quantile(table[:, f], QUANTILES) for f in range(N_FEATURES)]))
    cells, truth = field.cells(table, n_lines), np.repeat(labels, n_lines).astype(float)
    prior = np.where(truth > 0, GOOD, BAD)
    starts = np.cumsum(n_lines) - n_lines
    inner = np.setdiff1d(np.arange(len(truth)), starts)
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[inner - 1].astype(int), truth[inner].astype(int)), 1)
    theta = np.zeros(len(field.weights) + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        field.weights, field.pairs = theta[:-4], theta[-4:].reshape(2, 2)
        if k in {1 + int(x * rounds) for x in EXPECT}:
            truth, seen = field.marginals(cells, n_lines, prior)
            good = np.add.reduceat(truth * lengths, starts) / np.add.reduceat(lengths, starts)
            kept = np.where(np.repeat((labels == 0) & (good > 1 - LEAST_BAD), n_lines), -50.0, prior)
            truth, seen = field.marginals(cells, n_lines, kept)
        good, pairs = field.marginals(cells, n_lines)
        slope = np.bincount(cells.ravel(), np.repeat(truth - good, cells.shape[1]), minlength=len(field.weights))
        grad = np.concatenate([slope, (seen - pairs).ravel()]) / len(truth) - decay * theta
        if k <= EXPECT[0] * rounds:
            grad[N_FEATURES * field.width :] = 0
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        theta = theta + rate * (1 - k / (rounds + 1)) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
    field.weights, field.pairs = theta[:-4], theta[-4:].reshape(2, 2)
    x = np.stack([field.share(table, lengths, n_lines), np.ones(len(labels))], 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ field.curve, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        field.curve = field.curve + np.linalg.solve(hessian, x.T @ (labels - p) - 1e-2 * field.curve)
    return field


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 6000) -> Field | None:
    """The field learnt from the labelled rows that may be learnt from; None without any."""
    chosen = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    chosen = chosen.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high")).filter("label = high").drop("high")
    chosen = chosen.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(sample)
    # At most ``sample`` rows of two numbers are broadcast.
    rows = documents.select(col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")
    schema = pa.schema([("label", pa.int32()), ("table", pa.binary()), ("lengths", pa.binary())])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table, lengths, _ = features([text])
                made.append({"label": label, "table": table.astype("<f8").tobytes(), "lengths": lengths.astype("<f8").tobytes()})
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    found = rows.select("text", "label").mapInArrow(describe, "label int, table binary, lengths binary").collect()
    if not found:
        return None
    found.sort(key=lambda x: (x.label, bytes(x.table)))  # in one order, whatever the partitions
    table = np.concatenate([np.frombuffer(x.table, "<f8").reshape(-1, N_FEATURES) for x in found])
    lengths = [np.frombuffer(x.lengths, "<f8") for x in found]
    return fit(table, np.concatenate(lengths), np.array([len(x) for x in lengths]), np.array([x.label for x in found]))


def _scored(field: Field | None, spark, text: Column) -> Column:
    if field is None:
        return F.lit(0.5)
    shared = spark.sparkContext.broadcast(field)  # some thousand weights

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            out, some, held = [], [], 0
            for text in texts:
                some.append(text)
                held += len(text)
                if held >= 4 * BLOCK:
                    out.append(own.scores(some))
                    some, held = [], 0
            out.append(own.scores(some))
            yield pd.Series(np.concatenate(out))

    return scored(text)


def score(documents: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of documents: its id and score, 0 to 1, higher where label 1 is likelier."""
    return documents.select(col(id_col), _scored(field, documents.sparkSession, text_of(text_col)).alias("score"))


def keep_good(documents: DataFrame, field: Field | None, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of documents, with their columns, that score ``least`` or more; all of them where nothing could be learnt."""
    if field is None:
        return documents
    rows = documents.select(row_of(documents).alias("row"), _scored(field, documents.sparkSession, text_of(text_col)).alias("score"))
    return rows.filter(F.col("score") >= least).select("row.*")
