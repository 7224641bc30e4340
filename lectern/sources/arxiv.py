"""Bulk download of papers as a Spark data source.

    spark.dataSource.register(ArxivSource)
    spark.read.format("arxiv").option("query", "all:spark").option("max_results", 500).load()

A listing is asked for page by page, with ``listings`` partitions (1, as the service asks for one connection); its papers are downloaded
by the same partition, or, as ``download(df)``, by as many tasks as there are, each of which keeps to its share of ``per_second`` requests. The network is reached through a fetcher, named by the
option ``fetcher`` as ``module:function`` of a url to bytes, so that tests need none; the default one uses urllib. It has only been
tested with a stub here, where there is no network.
"""

from __future__ import annotations

import importlib
import time
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urlencode

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

API = "http://export.arxiv.org/api/query"
ATOM = "{http://www.w3.org/2005/Atom}"


def fetch(url: str) -> bytes:
    from urllib.request import urlopen

    with urlopen(url, timeout=60) as answer:
        return answer.read()


class Page(InputPartition):
    def __init__(self, start: int, size: int):
        self.start, self.size = start, size


class Pages(InputPartition):
    def __init__(self, pages: list[Page]):
        self.pages = pages


def polite(fetcher: str, url: str, retries: int, pause: float) -> bytes:
    """What a url gives, tried again after longer and longer pauses."""
    module, _, name = fetcher.partition(":")
    get = getattr(importlib.import_module(module), name)
    for attempt in range(retries):
        try:
            return get(url)
        except OSError:
            if attempt + 1 == retries:
                raise
            time.sleep(pause * (attempt + 1))
    raise OSError("no attempt was allowed")


def download(listed: DataFrame, tasks: int = 4, per_second: float = 1.0, retries: int = 3, fetcher: str | None = None) -> DataFrame:
    """listed (paper_id, pdf_url, ...) with ``content`` and ``error``. The limit holds for all tasks together: each keeps to per_second / tasks."""
    fetcher = fetcher or f"{__name__}:fetch"
    names = [c for c in listed.columns if c not in ("content", "error")]
    step = tasks / per_second

    def rows(batches):
        last = None
        for batch in batches:
            for x in batch.to_pylist():
                content, error = None, None
                if x["pdf_url"]:
                    if last is not None:
                        time.sleep(max(0.0, last + step - time.monotonic()))
                    last = time.monotonic()
                    try:
                        content = polite(fetcher, x["pdf_url"], retries, step)
                    except OSError as e:
                        error = str(e)
                yield pa.RecordBatch.from_pylist([{**x, "content": content, "error": error}], schema=batch.schema.append(pa.field("content", pa.binary())).append(pa.field("error", pa.string())))

    schema = ", ".join(f"`{c}` {listed.schema[c].dataType.simpleString()}" for c in names) + ", content binary, error string"
    return listed.select(*names).repartition(tasks, "paper_id").mapInArrow(rows, schema)


class ArxivSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arxiv"

    def schema(self) -> str:
        return "paper_id string, title string, summary string, pdf_url string, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArxivReader(self.options)


class ArxivReader(DataSourceReader):
    def __init__(self, options):
        self.query = options.get("query", "all:*")
        self.most = int(options.get("max_results", 100))
        self.page = int(options.get("page_size", 50))
        self.retries = int(options.get("retries", 3))
        self.pause = float(options.get("pause_seconds", 3))
        self.fetcher = options.get("fetcher", f"{__name__}:fetch")
        self.contents = str(options.get("contents", "true")).lower() == "true"
        self.listings = int(options.get("listings", 1))

    def partitions(self) -> list[InputPartition]:
        pages = [Page(start, min(self.page, self.most - start)) for start in range(0, self.most, self.page)]
        return [Pages(pages[k :: self.listings]) for k in range(min(self.listings, len(pages)))]

    def _get(self, url: str) -> bytes:
        return polite(self.fetcher, url, self.retries, self.pause)

    def read(self, partition: Pages) -> Iterator[tuple]:
        for k, page in enumerate(partition.pages):
            if k:
                time.sleep(self.pause)
            yield from self._page(page)

    def _page(self, partition: Page) -> Iterator[tuple]:
        page = ET.fromstring(self._get(f"{API}?{urlencode({'search_query': self.query, 'start': partition.start, 'max_results': partition.size})}"))
        for entry in page.iter(f"{ATOM}entry"):
            said = lambda tag: " ".join((entry.findtext(ATOM + tag) or "").split())  # noqa: B023, E731
            links = [x.get("href") for x in entry.iter(f"{ATOM}link") if x.get("title") == "pdf" or x.get("type") == "application/pdf"]
            content, error = None, None
            if links and self.contents:
                try:
                    content = self._get(links[0])
                except OSError as e:
                    error = str(e)
            yield said("id").rpartition("/abs/")[2], said("title"), said("summary"), links[0] if links else None, content, error
