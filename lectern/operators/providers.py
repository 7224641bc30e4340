"""Interfaces for what needs a parser, model weights or a network, and how they are applied to DataFrames.

A provider is any object with the method named; it is sent to the workers, and set up there once per partition by ``open`` if it
has that. The stubs serve tests; they are not the real thing.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import tokens


class PdfParser(Protocol):
    def parse(self, content: bytes) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class LanguageModel(Protocol):
    def complete(self, prompt: str) -> str: ...


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...


def _opened(provider):
    return provider.open() or provider if hasattr(provider, "open") else provider


def parse_pdfs(df: DataFrame, parser: PdfParser, content_col: str = "content") -> DataFrame:
    """df without content, with ``text`` and ``error``: a file that cannot be parsed is a row with an error."""
    names = [c for c in df.columns if c != content_col]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names) + ", text string, error string"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _opened(parser)
        for batch in batches:
            texts, errors = [], []
            for content in batch.pop(content_col):
                try:
                    texts.append(own.parse(bytes(content)))
                    errors.append(None)
                except Exception as e:  # whatever a parser raises is that file's error
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch.assign(text=texts, error=errors)[[*names, "text", "error"]]

    return df.select(*names, content_col).mapInPandas(parse, schema)


def embed(df: DataFrame, embedder: Embedder, text_col: str = "para", out: str = "embedding", batch_size: int = 64) -> DataFrame:
    """df with an array<float> for each text; an embedder that works on DataFrames (``embedded``) does so."""
    if hasattr(embedder, "embedded"):
        return embedder.embedded(df, text_col, out)

    @F.pandas_udf("array<float>")
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _opened(embedder)
        for texts in batches:
            some = texts.fillna("").tolist()
            yield pd.Series([x for k in range(0, len(some), batch_size) for x in own.embed(some[k : k + batch_size])], dtype=object)

    return df.withColumn(out, embedded(F.col(text_col)))


def complete(df: DataFrame, model: LanguageModel, prompt_col: str = "prompt", out: str = "answer", error: str | None = None) -> DataFrame:
    """df with the model's answer to each prompt; one client per partition. With ``error``, the name of a column, a call that fails is a row with a null
    answer and its error; without, it fails the job. Prompts hold whole texts, so they go to Python a hundred at a
    time, not in Arrow's batches of 10,000."""
    opened: list[LanguageModel] = []  # empty in each task, which unpickles its own

    def answered(prompt: str | None) -> tuple[str | None, str | None]:
        if prompt is None:
            return None, None
        if not opened:
            opened.append(_opened(model))
        try:
            return opened[0].complete(prompt), None
        except Exception as e:
            if error is None:
                raise
            return None, f"{type(e).__name__}: {e}"

    found = F.udf(answered, "struct<answer: string, error: string>", useArrow=False)(F.col(prompt_col))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), found.alias("_found"))
    return rows.select("_row.*", F.col("_found.answer").alias(out), *([F.col("_found.error").alias(error)] if error else []))


class ChatApi:
    """A chat-completions service over http. Calls that fail for a reason that passes (429, 5xx, a broken connection) are tried again, after a pause that
    doubles or that the service asks for. ``per_second`` limits one client; there is one in each partition, so a job's limit is that times
    the partitions that run at once."""

    def __init__(self, url: str, key: str, model: str, timeout: float = 60, retries: int = 5, pause: float = 1.0, per_second: float | None = None):
        self.url, self.key, self.model, self.timeout = url, key, model, timeout
        self.retries, self.pause, self.per_second, self.last = retries, pause, per_second, 0.0

    def _call(self, body: bytes) -> str:
        from urllib.request import Request, urlopen

        if self.per_second:
            time.sleep(max(0.0, self.last + 1 / self.per_second - time.monotonic()))
            self.last = time.monotonic()
        request = Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]

    def complete(self, prompt: str) -> str:
        from urllib.error import HTTPError

        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}]}).encode()
        for attempt in range(self.retries + 1):
            wait = self.pause * 2**attempt
            try:
                return self._call(body)
            except HTTPError as e:
                if attempt == self.retries or e.code != 429 and e.code < 500:
                    raise
                asked = e.headers.get("Retry-After", "")
                wait = float(asked) if asked.isdigit() else wait
            except OSError:
                if attempt == self.retries:
                    raise
            time.sleep(wait)
        raise AssertionError("unreachable")


class FileTokenizer:
    """A tokenizer from a file of the ``tokenizers`` library, which every worker has. WordPiece vocabularies, BPE and others, with their own special tokens."""

    def __init__(self, path: str, add_special_tokens: bool = True):
        self.path, self.add_special_tokens = path, add_special_tokens
        self.own = None

    def __getstate__(self):
        return {**self.__dict__, "own": None}

    def encode(self, text: str) -> list[int]:
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
        return self.own.encode(text, add_special_tokens=self.add_special_tokens).ids


class WordVectors:
    """An embedder that is trained on the corpus itself: skip-gram word vectors, and of a text the mean of its words' vectors. Words that stand in like contexts
    are near each other, so it is semantic in a small way; a sentence encoder is better where its weights are at hand."""

    def __init__(self, width: int = 64, least: int = 2, seed: int = 7, rounds: int = 1):
        self.width, self.least, self.seed, self.rounds, self.model = width, least, seed, rounds, None

    def fit(self, df: DataFrame, text_col: str = "para") -> WordVectors:
        from pyspark.ml.feature import Word2Vec

        own = Word2Vec(vectorSize=self.width, minCount=self.least, seed=self.seed, maxIter=self.rounds, inputCol="tokens", outputCol="vector")
        self.model = own.fit(df.select(tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens")))
        return self

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> WordVectors:
        from pyspark.ml.feature import Word2VecModel

        own = cls()
        own.model = Word2VecModel.load(path)
        return own

    def embedded(self, df: DataFrame, text_col: str = "para", out: str = "embedding") -> DataFrame:
        """df with an array<float> for each text, without Python."""
        from pyspark.ml.functions import vector_to_array

        rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
        return self.model.transform(rows).select("row.*", vector_to_array("vector", "float32").alias(out))


class WordPiece:
    """A WordPiece encoder over a given vocabulary: greedy longest match, Han characters one by one, [CLS] and [SEP] around."""

    def __init__(self, vocabulary: list[str], lower: bool = True):
        self.ids, self.lower = {x: k for k, x in enumerate(vocabulary)}, lower

    def _piece(self, word: str) -> list[int]:
        found, start = [], 0
        while start < len(word):
            end = next((e for e in range(len(word), start, -1) if ("##" if start else "") + word[start:e] in self.ids), None)
            if end is None:
                return [self.ids["[UNK]"]]
            found.append(self.ids[("##" if start else "") + word[start:end]])
            start = end
        return found

    def encode(self, text: str) -> list[int]:
        text = text.lower() if self.lower else text
        parts = re.findall(r"[㐀-䶿一-鿿豈-﫿]|[^\W_]+?(?=[㐀-䶿一-鿿豈-﫿]|\W|_|$)|[^\w\s]|_", text)
        return [self.ids["[CLS]"], *(x for p in parts for x in self._piece(p)), self.ids["[SEP]"]]


def encode(df: DataFrame, tokenizer: Tokenizer, text_col: str = "text", max_length: int = 128, pad_id: int = 0) -> DataFrame:
    """df with input_ids and attention_mask, cut or padded to max_length; a cut keeps the last id."""
    out = "struct<input_ids: array<int>, attention_mask: array<int>>"

    @F.pandas_udf(out)
    def encoded(texts: pd.Series) -> pd.DataFrame:
        ids = [tokenizer.encode(x or "") for x in texts]
        ids = [x if len(x) <= max_length else [*x[: max_length - 1], x[-1]] for x in ids]
        return pd.DataFrame({"input_ids": [x + [pad_id] * (max_length - len(x)) for x in ids], "attention_mask": [[1] * len(x) + [0] * (max_length - len(x)) for x in ids]})

    return df.withColumn("_encoded", encoded(F.col(text_col))).select("*", "_encoded.*").drop("_encoded")


class HashEmbedder:
    """A stub: words hashed to signs. Not semantic."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        found = []
        for text in texts:
            vector = [0.0] * self.width
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                vector[h % self.width] += 1.0 if h >> 31 else -1.0
            found.append(vector)
        return found


class EchoModel:
    """A stub: answers with the prompt's first line."""

    def complete(self, prompt: str) -> str:
        return prompt.split("\n", 1)[0]


class PlainTextParser:
    """A stub: takes bytes as UTF-8 text. ``pdf.PdfText`` is the parser."""

    def parse(self, content: bytes) -> str:
        return content.decode()
