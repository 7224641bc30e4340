"""Language-model scores by deleted interpolation of uniform, unigram and bigram estimates.

The probability of a word after another is (1 - m) * P1 + m * P2, where P2 is the maximum-likelihood bigram estimate and m belongs to
the bucket of the context's frequency; and P1 is (1 - l) * U + l * c / N, of the maximum-likelihood unigram estimate and the uniform one over all
words seen and one unseen. The weights l and m are learnt by expectation-maximisation on deleted counts: every training token is
held out of the counts that predict it. A context's bucket is by its frequency in the training texts, in learning as in scoring: single counts up to 3,
then two to each power of two. So a context that occurs once has no weight: without the token held out, nothing is known of it, and no training
text is scored by what it alone says.

Counts are exact and of all training documents. Documents are dealt to batches. A batch asks for the counts of its distinct
words and bigrams, by sending its own counts, sorted by hash and cut into parts, to where each part is summed; what comes back is
the totals in the same order. So what is shuffled is a batch's distinct n-grams, however often they occur in it, and a
frequent one is pre-aggregated in each batch. The number of parts is ``PARTS`` up to as many times ``part_bytes`` of text, so that rows grow with
the batches alone; beyond, a part's memory sets it, and rows are batches times parts, but never more than there are n-grams. Nothing of the vocabulary is broadcast. Words are told apart by 63 bits of a hash.

What a mixture needs of a token is its context's bucket and the ratio of P2 to P1. A document keeps these, and the deleted tokens are
counted by bucket and ratio; the counts, of a fixed size, are all that the driver sees.

Defined cases: a null text is empty and has only the end token; a null id is for training; repeated ids and rows are scored
as often as they come, each counted; without training documents every token is unknown; an empty table gives an empty result;
columns other than the id and text are not read; rows that repeat both id and text lie in one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import col, discard, staged, text_of, words

U64 = np.uint64
END, START = U64(0x9D39247E33776D41), U64(0x2AF7398005AAA5C7)
BUCKETS = 128
#: Rows that go to Python at once. Tens of thousands of keys or tokens stand in one, and all of a task's rows would otherwise go together.
ROWS = 128
#: The least number of parts that the n-grams are cut into.
PARTS = 128
#: Counts of words are told apart up to this one, and then in so many bins to a power of two.
SINGLE, FINE = 4096, 64
#: Bins of the ratio's binary logarithm, eight to a power of two; the first is for 0.
LOW, BINS = -24, 8 * 72
KEY = U64(0xFFFFFFFFFFFFFFFE)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: those that are mostly zero then compress to almost nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=U64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, U64), dtype=U64)


class Batch:
    """The tokens of some documents, and their distinct n-grams in order of key. Keys of words are odd, those of bigrams even."""

    def __init__(self, docs: list[np.ndarray], train: list[bool]):
        self.sizes = np.array([len(x) + 1 for x in docs], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        tokens = np.empty(self.sizes.sum(), U64)
        tokens[self.starts + self.sizes - 1] = END
        inner = np.ones(len(tokens), bool)
        inner[self.starts + self.sizes - 1] = False
        tokens[inner] = np.concatenate(docs).view(U64) if docs else np.zeros(0, U64)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.starts] = START
        self.train = np.repeat(np.array(train, bool), self.sizes)
        one = _mix(tokens) | U64(1)
        two = _mix(tokens + _mix(before ^ START)) & KEY
        self.keys, at = np.unique(np.concatenate([one, two]), return_inverse=True)
        self.one, self.two = at[: len(tokens)], at[len(tokens) :]

    def counts(self) -> np.ndarray:
        n = len(self.keys)
        return (np.bincount(self.one[self.train], minlength=n) + np.bincount(self.two[self.train], minlength=n)).astype(np.uint32)


def edges(parts: int) -> np.ndarray:
    """Where parts of the keys begin."""
    return (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(U64)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, Batch, list[bytes]]]:
    """(batch, ids, documents, replies) of rows (batch, id, train, hashes, reply) that come sorted by batch, replies first."""
    at, ids, docs, train, replies = None, [], [], [], []
    for rows in batches:
        hashes = rows.column(3)
        flat, offsets = hashes.values.to_numpy(zero_copy_only=False), hashes.offsets.to_numpy()
        numbers, keys, kinds, blobs = (rows.column(c).to_pylist() for c in (0, 1, 2, 4))
        for k, number in enumerate(numbers):
            if number != at:
                if at is not None:
                    yield at, ids, Batch(docs, train), replies
                at, ids, docs, train, replies = number, [], [], [], []
            if blobs[k] is not None:
                replies.append(blobs[k])
            else:
                ids.append(keys[k])
                train.append(kinds[k])
                docs.append(flat[offsets[k] : offsets[k + 1]].copy())
    if at is not None:
        yield at, ids, Batch(docs, train), replies


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows together by batch, replies first and by part; hashes are made after the shuffle, as texts are smaller."""
    rows = rows.repartition("batch").sortWithinPartitions("batch", F.col("part").isNull(), "part")
    found = F.transform(words(F.coalesce("text", F.lit(""))), lambda x: F.xxhash64(x))
    return rows.select("batch", "id", "train", found.alias("hashes"), "reply")


def _ask(docs: DataFrame, parts: int) -> DataFrame:
    """(part, batch, keys, counts): what each batch has of each part."""
    schema = pa.schema([("part", pa.int64()), ("batch", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    bounds = edges(parts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, batch, _ in _batches(batches):
            cuts, counts = [0, *np.searchsorted(batch.keys, bounds), len(batch.keys)], batch.counts()
            rows = [(p, number, pack_keys(batch.keys[a:b]), _planes(counts[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _dealt(docs).mapInArrow(ask, "part long, batch long, keys binary, counts binary")


def _answer(asked: DataFrame) -> DataFrame:
    """(batch, part, reply, level, types, tokens): totals in the order asked; and, without batch, how many distinct words of a part have a
    level of training count, and how many tokens they are."""
    schema = pa.schema([("batch", pa.int64()), ("part", pa.int64()), ("reply", pa.binary()), ("level", pa.int64()), ("types", pa.int64()), ("tokens", pa.int64())])

    def summed(part: int, batches: list[int], keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros(len(distinct), np.int64)
        np.add.at(totals, at, np.concatenate(counts))
        sizes = np.cumsum([0, *map(len, keys)])
        replies = [_planes(totals[at[a:b]]) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        words = totals[(distinct & U64(1)) == 1]
        words = words[words > 0]
        levels, where = np.unique(_level(words), return_inverse=True)
        types, tokens = np.bincount(where, minlength=len(levels)), np.zeros(len(levels), np.int64)
        np.add.at(tokens, where, words)
        none = [None] * len(levels)
        columns = [[*batches, *none], [*[part] * len(keys), *none], [*replies, *none], [*[None] * len(keys), *levels], [*[None] * len(keys), *types], [*[None] * len(keys), *tokens]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, numbers, keys, counts = None, [], [], []
        for rows in batches:
            for part, number, k, c in zip(*(x.to_pylist() for x in rows.columns), strict=True):
                if part != at:
                    if at is not None:
                        yield summed(at, numbers, keys, counts)
                    at, numbers, keys, counts = part, [], [], []
                numbers.append(number)
                keys.append(unpack_keys(k))
                counts.append(_unplanes(c, np.uint32))
        if at is not None:
            yield summed(at, numbers, keys, counts)

    return asked.repartition("part").sortWithinPartitions("part").mapInArrow(answer, "batch long, part long, reply binary, level long, types long, tokens long")


def _level(counts: np.ndarray) -> np.ndarray:
    """The level of a count: itself up to ``SINGLE``."""
    fine = SINGLE + np.floor(FINE * np.log2(np.maximum(counts, SINGLE) / SINGLE)).astype(np.int64)
    return np.where(counts <= SINGLE, counts, fine)


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts that were never seen, single counts up to 3, then by halves of powers of two."""
    halves = np.floor(2 * np.log2(np.maximum(context, 4))).astype(np.int64)
    return np.where(context < 4, context, np.minimum(halves, BUCKETS - 1)).astype(np.int64)


def _bin(ratio: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.clip((np.log2(ratio) - LOW) * 8, 0, BINS - 2).astype(np.int64) + 1, 0)


MEASURED = "id long, held_out boolean, n_tokens long, n_known long, base_score double, low_score double, zeros binary, buckets binary, ratios binary, cell long, n long"


def _measure(rows: DataFrame, n: int, v: int, starts: int, weight: float) -> DataFrame:
    """Per document what its score needs, and (with cell) how many deleted tokens have a bucket and ratio."""
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("low_score", pa.float64()), ("zeros", pa.binary()), ("buckets", pa.binary()), ("ratios", pa.binary()), ("cell", pa.int64()), ("n", pa.int64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, b, replies in _batches(batches):
            totals = np.concatenate([_unplanes(x, np.int64) for x in replies])
            one, two = totals[b.one], totals[b.two]
            context = np.empty_like(one)
            context[1:] = one[:-1]
            context[b.starts] = starts
            p1 = (1 - weight) / (v + 1) + weight * one / max(n, 1)
            ratio = np.where(context > 0, two / np.maximum(context, 1) / p1, 0.0)
            bucket = _bucket(context)
            # deleted: the token itself is taken out of all three counts
            own = b.train & (context > 1)
            less = (1 - weight) / (v + 1) + weight * (one[own] - 1) / max(n - 1, 1)
            deleted = (two[own] - 1) / (context[own] - 1) / less
            cells = np.bincount(_bucket(context[own]) * BINS + _bin(deleted), minlength=BUCKETS * BINS)
            known = np.add.reduceat((one > 0).astype(np.int64), b.starts)
            base = np.add.reduceat(np.log10((one + 1) / (n + v + 1)), b.starts)
            low = np.add.reduceat(np.log10(p1), b.starts)
            out = []
            for d, (key, start, size) in enumerate(zip(ids, b.starts, b.sizes, strict=True)):
                here = slice(start, start + size)
                some = ratio[here] > 0
                zeros = np.bincount(bucket[here][~some], minlength=BUCKETS).astype(np.uint32)
                out.append((key, not b.train[start], int(size), int(known[d]), float(base[d]), float(low[d]), _planes(zeros), bucket[here][some].astype(np.uint8).tobytes(), _planes(ratio[here][some].astype(np.float32)), None, None))
            full = np.flatnonzero(cells)
            out += [(None,) * 9 + (int(c), int(cells[c])) for c in full]
            for k in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out[k : k + 4096], strict=True), schema, strict=True)], schema=schema)

    return _dealt(rows).mapInArrow(measure, MEASURED)


def unigram_weight(levels: dict[int, tuple[int, int]], rounds: int = 200) -> float:
    """The weight of the unigram estimate beside the uniform one, by expectation-maximisation on deleted counts: each of a word's c tokens is
    predicted by its other c - 1. levels: types and tokens by level of count. One more token for either side keeps it off 0 and 1."""
    types, tokens = (np.array([x[k] for x in levels.values()], float) for k in (0, 1))
    n, v = tokens.sum(), types.sum()
    if not n:
        return 0.0
    ratio = (tokens / types - 1) / max(n - 1, 1) * (v + 1)
    found = 0.5
    for _ in range(rounds):
        found = ((tokens * found * ratio / (found * ratio + 1 - found)).sum() + 0.5) / (n + 1)
    return float(found)


def mixture(cells: dict[int, int], rounds: int = 200) -> np.ndarray:
    """The weight of bigrams in each bucket, by expectation-maximisation on the deleted tokens' ratios. One more token for
    either side keeps a weight off 0 and 1; a bucket without tokens, and that of unseen contexts, has none."""
    counts = np.zeros((BUCKETS, BINS))
    for cell, n in cells.items():
        counts[cell // BINS, cell % BINS] += n
    ratio = np.concatenate([[0.0], 2.0 ** (LOW + (np.arange(BINS - 1) + 0.5) / 8)])
    found = np.full(BUCKETS, 0.5)
    total = counts.sum(1)
    for _ in range(rounds):
        share = found[:, None] * ratio / (found[:, None] * ratio + 1 - found[:, None])
        found = ((counts * share).sum(1) + 0.5) / (total + 1)
    return np.where((total > 0) & (np.arange(BUCKETS) > 0), found, 0.0)


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20, part_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of df: id, held_out, n_tokens, n_known, train_tokens, base_score, score. batch_bytes: of the texts of a batch,
    on average; part_bytes: of the texts whose n-grams are in a part, at most."""
    own = df.select(col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    size, docs = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum((~held_out(F.col("id"))).cast("long")), F.lit(0))).first()
    count, parts = max(1, -(-size // batch_bytes)), max(PARTS, -(-size // part_bytes))
    own = own.withColumns({"train": ~held_out(F.col("id")), "batch": F.pmod(F.xxhash64("id", "text"), F.lit(count)), "part": F.lit(None).cast("long"), "reply": F.lit(None).cast("binary")})
    replies = staged(_answer(_ask(own, parts)), "replies", ROWS)
    levels = replies.filter("batch IS NULL").groupBy("level").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect()  # a few thousand at most
    levels = {x.level: (x.types, x.tokens) for x in sorted(levels)}
    v, n = (sum(x[k] for x in levels.values()) for k in (0, 1))
    asked = replies.filter("batch IS NOT NULL").select("batch", "part", "reply")
    measured = staged(_measure(own.unionByName(asked, allowMissingColumns=True), n, v, docs, unigram_weight(levels)), "measured", ROWS)
    discard(replies)
    cells = measured.filter("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # of BUCKETS * BINS rows at most
    weights = mixture({x.cell: x.n for x in cells})

    @F.pandas_udf("double")
    def mixed(low: pd.Series, zeros: pd.Series, buckets: pd.Series, ratios: pd.Series) -> pd.Series:
        none = np.log10(1 - weights)
        found = []
        for start, z, b, r in zip(low, zeros, buckets, ratios, strict=True):
            m = weights[np.frombuffer(b, np.uint8)]
            found.append(start + float(_unplanes(z, np.uint32) @ none) + float(np.log10(1 - m + m * _unplanes(r, np.float32)).sum()))
        return pd.Series(found, dtype=float)

    return measured.filter("cell IS NULL").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", mixed("low_score", "zeros", "buckets", "ratios").alias("score")
    )
