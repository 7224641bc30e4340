"""Packing token sequences: best-fit decreasing with a segment tree.

Each task tokenises its documents, cuts overlong ones into full windows, and places the remaining pieces, longest first, into
the open window with the least room that still holds them. The room of open windows is the index of a segment tree, so a
window is found in a number of steps that is the tree's height. A task packs ``group_tokens`` tokens at a time, which bounds its memory.
Its windows that are filled to ``enough`` are settled. The pieces of the others, of which there are few unless tasks are small, are written to the shared
folder too, dealt anew into groups of about ``group_tokens`` tokens, however many tasks they come from, and packed once more. So padding does
not depend on how the documents are partitioned.

Defined cases: null and empty texts are the end id alone; equal lengths keep their order; repeated rows are packed as often as
they come; a document of any length is cut as it is; a null id is carried; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import col, staged, text_of

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class BestFit:
    """Open windows by their room. A node of the tree counts the open windows below it."""

    def __init__(self, window: int):
        self.window, self.leaves = window, 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.used: list[int] = []

    def _add(self, room: int, n: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += n
            node >>= 1

    def _tightest(self, length: int) -> int | None:
        """The least room that holds the length."""
        count, node = self.count, self.leaves + length
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not count[2 * node])
        return node - self.leaves

    def place(self, length: int) -> tuple[int, int]:
        """The window that takes a piece, and the offset in it."""
        room = self._tightest(length)
        if room is None:
            at, room = len(self.used), self.window
            self.used.append(0)
        else:
            at = self.open[room].pop()
            self._add(room, -1)
        offset = self.used[at]
        self.used[at] += length
        if room > length:
            self.open[room - length].append(at)
            self._add(room - length, 1)
        return at, offset


def pack(lengths: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces of documents with these lengths: document, start, length, sequence, offset. All lengths are 1 or more."""
    fit, pieces, rest = BestFit(window), [], []
    for k, n in enumerate(lengths):
        for start in range(0, n - n % window, window):
            pieces.append((k, start, window, *fit.place(window)))
        if n % window:
            rest.append((k, n - n % window, n % window))
    for k, start, n in sorted(rest, key=lambda x: -x[2]):
        pieces.append((k, start, n, *fit.place(n)))
    return pieces


# How a byte-level BPE parts text before merging, and the printable characters that stand for bytes in its file.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]


def _bytes_of() -> dict[str, int]:
    other = [b for b in range(256) if b not in PRINTABLE]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(other)}


class Tokenizer:
    """The ids of a byte-level BPE file, as little-endian unsigned 32-bit bytes. The file's added tokens part a text, and where they
    stand in it are their own ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = model.get("added_tokens", [])
        if any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on what is beside them are not supported")
        self.added = {x["content"]: x["id"] for x in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.parts = re.compile(f"({'|'.join(map(re.escape, longest_first))})" if added else "(?!)")
        special, byte = set(self.added.values()), _bytes_of()
        ranks = {bytes(byte[c] for c in token): n for token, n in model["model"]["vocab"].items() if n not in special}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        found = []
        for k, part in enumerate(self.parts.split(text)):  # every other part is an added token
            found += [self.added[part]] if k % 2 else self.encoding.encode_ordinary(part)
        return np.array(found, "<u4").tobytes()


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a worker, which is made once."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
SCHEMA = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in NAMES])
#: Sequences of the second round are told apart by this bit.
AGAIN = 1 << 61


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 4096):
        some = rows[at : at + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, group_tokens: int = 1 << 22, enough: float = 0.99) -> DataFrame:
    """One row per piece: the document's id, start (its ids before the piece), length, ids (little-endian, 32 bits each),
    doc_tokens (with the end id), sequence_id (unique) and offset (in the sequence). tokenizer_path is that of a file that
    every worker has."""
    end = np.array([end_id], "<u4").tobytes()
    first_schema = SCHEMA.append(pa.field("settled", pa.bool_()))

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, first = tokenizer(tokenizer_path).ids, TaskContext.get().partitionId() << 32
        keys: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first, size
            lengths = [len(x) // 4 for x in texts]
            pieces = pack(lengths, window)
            used = [0] * (1 + max((x[3] for x in pieces), default=-1))
            for _, _, n, at, _ in pieces:
                used[at] += n
            yield from _batches([(keys[k], s, n, texts[k][4 * s : 4 * (s + n)], lengths[k], first + at, offset, used[at] >= enough * window) for k, s, n, at, offset in pieces], first_schema)
            first += len(used)
            keys.clear()
            texts.clear()
            size = 0

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(key)
                texts.append(encode(text.as_py()) + end)
                size += len(texts[-1]) // 4
                if size >= group_tokens:
                    yield from packed()
        yield from packed()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, group, held = AGAIN + (TaskContext.get().partitionId() << 32), None, []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first
            pieces = pack([x[2] for x in held], window)
            yield from _batches([(*held[k][:5], first + at, offset) for k, _, _, at, offset in pieces], SCHEMA)
            first += 1 + max((x[3] for x in pieces), default=-1)
            held.clear()

        for batch in batches:
            for at, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != group:
                    yield from packed()
                    group = at
                held.append(row)
        yield from packed()

    own = df.select(col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    made = staged(own.mapInArrow(sequences, f"{PIECES}, settled boolean"), "pieces")
    rest = made.filter("NOT settled")
    tokens = rest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    group = F.pmod(F.xxhash64("sequence_id", "offset"), F.lit(max(1, -(-tokens // group_tokens))))
    dealt = rest.withColumn("group", group).repartition("group").sortWithinPartitions("group", "sequence_id", "offset")
    return made.filter("settled").select(*NAMES).unionByName(dealt.select("group", *NAMES[:5]).mapInArrow(again, PIECES))
