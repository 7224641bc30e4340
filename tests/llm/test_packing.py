import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import packing
from lectern.llm.queries import op4_packing, tokenizer_path

SF = "/root/testdata/sf0.001"


@cache
def hugging_face():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def brute_force(lengths, window):
    """Best fit, decreasing, by looking at every window."""
    used = []
    pieces = []
    rest = [(k, n - n % window, n % window) for k, n in enumerate(lengths) if n % window]
    used += [window] * sum(n // window for n in lengths)
    for k, start, n in sorted(rest, key=lambda x: -x[2]):
        best = min((window - u for u in used if window - u >= n), default=None)
        pieces.append((k, start, n, best))
        if best is None:
            used.append(n)
        else:
            used[max(i for i, u in enumerate(used) if window - u == best)] += n
    return len(used), pieces


@settings(deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(1, 20))
def test_best_fit_takes_the_tightest_window(lengths, window):
    pieces = packing.pack(lengths, window)
    assert len({x[3] for x in pieces}) == brute_force(lengths, window)[0]
    spans, windows = defaultdict(list), defaultdict(list)
    for k, start, n, at, offset in pieces:
        spans[k].append((start, n))
        windows[at].append((offset, n))
    for k, n in enumerate(lengths):
        assert sum(x for _, x in spans[k]) == n and all(a + x == b for (a, x), (b, _) in zip(sorted(spans[k]), sorted(spans[k])[1:], strict=False))
    for at in windows.values():
        at.sort()
        assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False)) and sum(at[-1]) <= window


@settings(deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_tokenizer(text):
    own, theirs = packing.tokenizer(tokenizer_path()), hugging_face()
    assert np.frombuffer(own.ids(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_query_against_brute_force(spark):
    rows = op4_packing(spark, SF).collect()
    tokenizer = hugging_face()
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {k: tokenizer.encode(v or "", add_special_tokens=False).ids + [1] for k, v in texts.items()}
    seen = defaultdict(int)
    for x in sorted(rows, key=lambda x: (x.doc_id, x.start)):
        assert seen[x.doc_id] == x.start and x.doc_tokens == len(ids[x.doc_id])
        seen[x.doc_id] += x.length
        assert x.ids_crc32 == zlib.crc32(np.array(ids[x.doc_id][x.start : x.start + x.length], "<u4").tobytes())
    assert seen == {k: len(v) for k, v in ids.items()}
    filled = defaultdict(list)
    for x in rows:
        filled[x.sequence_id].append((x.offset, x.length))
    for at in filled.values():
        at.sort()
        assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False)) and sum(at[-1]) <= 2048
    assert sum(seen.values()) >= 0.97 * 2048 * len(filled)


@pytest.mark.parametrize("texts", [[], [None], ["", None, ""], ["x"] * 3, ["word " * 30000]])
def test_edges(spark, texts):
    df = spark.createDataFrame([(k, x, 1, 2) for k, x in enumerate(texts)], "doc_id long, text string, ids int, start int")
    rows = packing.pack_documents(df, tokenizer_path(), group_tokens=100).collect()
    assert {x.doc_id for x in rows} == set(range(len(texts)))
    if texts in ([None], ["", None, ""]):
        assert all((x.length, x.start, bytes(x.ids)) == (1, 0, b"\1\0\0\0") for x in rows)


@settings(deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", "'s", "é", "12", "!"]), max_size=12))
def test_added_tokens_are_those_of_the_tokenizer(parts):
    text = "<|endoftext|>".join(["".join(parts), "a "])
    own, theirs = packing.tokenizer(tokenizer_path()), hugging_face()
    assert np.frombuffer(own.ids(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("partitions", [1, 32, 211])
def test_padding_does_not_depend_on_partitions(spark, partitions):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(partitions)
    rows = packing.pack_documents(docs, tokenizer_path()).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset").collect()
    held, whole = defaultdict(list), defaultdict(list)
    for x in rows:
        held[x.sequence_id].append((x.offset, x.length))
        whole[x.doc_id, x.doc_tokens].append((x.start, x.length))
    for at in [*held.values(), *whole.values()]:
        at.sort()
        assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False))
    assert all(sum(at[-1]) <= 2048 for at in held.values()) and all(sum(at[-1]) == n for (_, n), at in whole.items()) and len(whole) == 1000
    assert sum(x.length for x in rows) >= 0.97 * 2048 * len(held)


def test_packed_ids_of_an_added_token(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    row = packing.pack_documents(df, tokenizer_path()).first()
    assert np.frombuffer(bytes(row.ids), "<u4").tolist() == [64, 220, 50256, 275, 1] and row.doc_tokens == row.length == 5
