"""WARC archives: writing captures, and transaction assembly on reading.

Every page becomes one transaction: a response record (or, where a page with a larger id has the same payload, a revisit record
without payload that refers to it), a request and a metadata record, the last two concurrent to the first. Records are built
by built-in functions; each becomes a gzip member of its own, and Spark's text sink, whose committer survives lost tasks, writes the
members. The sink ends each of its lines with a zero byte, which is the last byte of a member: that of its size, below 2**24. Files are cut by
bytes. Reading parses each file by its Content-Length headers, never by markers in content.
Assembly brings the records of a transaction together by WARC-Concurrent-To and emits one nested row per capture, with all its records.

Archives of others can be read too: plain or gzipped files, whole or a member per record, digests in base 16 or 32, of any algorithm that hashlib has.

Defined cases: a null page counts as an empty payload, a null url as an empty one; rows that repeat a page id have record ids of
their own; of pages with equal payloads of ``least`` bytes or more that share the largest id, one is the response; records of more than
8 MiB are several members; requests or metadata whose capture is missing make a row without capture; of several captures in a transaction the one that
the others are concurrent to is the capture, else the first by id, and the rest are among the others; of a header that repeats, the first counts; an empty table makes an empty archive; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import staged, text_of

END = "\r\n"
#: How much of a record is one gzip member at most: the last byte of its size is then zero.
MEMBER_BYTES = 8 << 20
#: Members that are written as one row.
ROW_BYTES = 1 << 20
#: A reader passes its records on after so many bytes of blocks.
BATCH_BYTES = 8 << 20
HTTP = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}{END}"

RECORD = "record_id string, type string, uri string, concurrent_to string, refers_to string, payload_digest string, payload_bytes long, intact boolean, fields map<string, string>"
#: Rows that refer to the same response are spread over so many keys.
SALTS = 64


def _record(headers: list[Column], block: Column) -> Column:
    """A record without its closing CR LF CR LF. Null headers are left out."""
    return F.concat_ws(END, F.lit("WARC/1.0"), *headers, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")), F.concat(F.lit(END), block))


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def _clean(uri: Column) -> Column:
    """A header's value ends with its line, so line ends in a uri are percent-encoded."""
    return F.replace(F.replace(uri, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def transactions(pages: DataFrame, least: int = 1000, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """(record): the records of all pages. Which pages are revisits is found among (id, digest) rows; a hot payload is
    counted before it is shuffled, and what is shuffled with the pages is their own id."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), text_of("html").alias("html"))
    own = own.withColumns({"digest": F.sha1("html"), "key": F.coalesce(F.col("page_id").cast("string"), F.lit("null"))})
    keys = own.select("page_id", "key", "digest", F.octet_length("html").alias("size")).filter(F.col("size") >= least)
    shared = keys.groupBy("digest").agg(F.coalesce(F.max("page_id").cast("string"), F.lit("null")).alias("newest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    known = keys.join(shared, "digest").select("key", "digest", "newest").distinct()
    # The number tells apart rows that repeat the id and the payload; for all others it is 1. It needs no shuffle besides the
    # join's, whose keys it has.
    rows = own.join(known, ["key", "digest"], "left")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key", "digest").orderBy("url")))
    revisit = F.col("newest").isNotNull() & ((F.col("key") != F.col("newest")) | (F.col("nth") > 1))

    def urn(kind: str, key: Column, nth: Column) -> Column:
        x = F.md5(F.concat_ws("|", F.lit(kind), key, F.col("digest"), nth.cast("string")))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))

    def own_id(kind: str) -> Column:
        return urn(kind, F.col("key"), F.col("nth"))

    at, uri = F.lit(date), _clean(F.col("url"))
    capture = own_id("capture")
    common = [_header("WARC-Target-URI", uri), _header("WARC-Date", at)]
    payload_digest = _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    target = urn("capture", F.col("newest"), F.lit(1))
    response = _record([_header("WARC-Type", F.lit("response")), _header("WARC-Record-ID", capture), *common, payload_digest, _header("Content-Type", F.lit("application/http;msgtype=response"))], F.concat(F.lit(HTTP), F.col("html")))
    again = _record([_header("WARC-Type", F.lit("revisit")), _header("WARC-Record-ID", capture), *common, payload_digest, _header("WARC-Refers-To", target), _header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), _header("Content-Type", F.lit("application/http;msgtype=response"))], F.lit(HTTP))
    request = _record([_header("WARC-Type", F.lit("request")), _header("WARC-Record-ID", own_id("request")), _header("WARC-Concurrent-To", capture), *common, _header("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{END}{END}")))
    metadata = _record([_header("WARC-Type", F.lit("metadata")), _header("WARC-Record-ID", own_id("metadata")), _header("WARC-Concurrent-To", capture), *common, _header("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(END)))
    return rows.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("record"))


def gzipped(record: bytes) -> bytes:
    """A record as gzip members, each of ``MEMBER_BYTES`` at most, without the last byte, which is zero."""
    out = []
    for at in range(0, max(len(record), 1), MEMBER_BYTES):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [packer.compress(record[at : at + MEMBER_BYTES]), packer.flush()]
    return b"".join(out)[:-1]


def write(pages: DataFrame, path: str, least: int = 1000, file_bytes: int = 32 << 20) -> None:
    """Writes the pages' records to gzipped files, of ``file_bytes`` and a record at most, which bounds what a reader of one file holds."""
    end = (END * 2).encode()
    schema = pa.schema([("members", pa.binary()), ("file", pa.int32())])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, file, inside = [], 0, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"\0".join(held)], pa.binary()), pa.array([file], pa.int32())], schema=schema)

        for batch in batches:
            for record in batch.column(0):
                held.append(gzipped(record.as_buffer().to_pybytes() + end))
                size += len(held[-1]) + 1
                if size >= min(ROW_BYTES, file_bytes):
                    yield row()
                    inside += size
                    held, size = [], 0
                    if inside >= file_bytes:
                        file, inside = file + 1, 0
        if held:
            yield row()

    rows = transactions(pages, least).mapInArrow(members, "members binary, file int")
    # The bytes go through as they are: a string column holds any, and the sink copies them.
    rows.select(F.col("members").cast("string").alias("value"), "file").write.partitionBy("file").option("lineSep", "\0").text(path)


class Malformed(ValueError):
    pass


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (by lower-case name) and block of each record; one record is held at a time."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise Malformed(f"a record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode(errors="replace").partition(":")
            headers.setdefault(name.strip().lower(), value.strip())
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise Malformed("a record does not end with its block")
        yield headers, block


def _body(block: bytes) -> bytes:
    """What follows the HTTP header."""
    return block.partition(b"\r\n\r\n")[2]


def digest_of(stated: str, body: bytes | None) -> tuple[str | None, bool | None]:
    """A stated digest (algorithm, colon, base 16 or 32) in lower-case hex, and whether it is that of a body; None where it cannot be told."""
    name, _, value = stated.rpartition(":")
    name = (name or "sha1").lower().replace("-", "")
    if name not in hashlib.algorithms_guaranteed or not (size := hashlib.new(name).digest_size):
        return value.lower() or None, None
    if len(value) != 2 * size:
        try:
            value = base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
        except ValueError:
            return value.lower() or None, False
    value = value.lower()
    return value, None if body is None else hashlib.new(name, body).hexdigest() == value


def read(spark: SparkSession, path: str, with_payload: bool = True, strict: bool = True, files: str = "part-*") -> DataFrame:
    """One row per record of the files that match: its headers, the SHA-1 and size of its payload, whether that is what its stated
    digest says (null where none is), the fields of a metadata record and, if asked for, the payload. If strict, a payload that is not what its digest
    says is an error."""
    fields = [("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("intact", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string()))]
    schema = pa.schema([*fields, *([("payload", pa.binary())] if with_payload else [])])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                stream = io.BytesIO(data)
                found, held = [], 0
                for head, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=stream)) if bytes(data[:2]) == b"\x1f\x8b" else stream):
                    kind = head.get("warc-type")
                    x = {"record_id": head["warc-record-id"], "type": kind, "uri": head.get("warc-target-uri"), "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to")}
                    stated = head.get("warc-payload-digest", "")
                    if kind == "response":
                        body = _body(block)
                        x |= {"payload_digest": hashlib.sha1(body).hexdigest(), "payload_bytes": len(body)}
                        if stated:
                            x["intact"] = digest_of(stated, body)[1]
                        if strict and x.get("intact") is False:
                            raise Malformed(f"the payload of {x['record_id']} is not what its digest says")
                        x |= {"payload": bytes(body)} if with_payload else {}
                    elif kind == "revisit":
                        x["payload_digest"] = digest_of(stated, None)[0]
                    elif kind == "metadata":
                        lines = (line.partition(":") for line in bytes(block).decode(errors="replace").split("\r\n"))
                        x["fields"] = list({k.strip(): v.strip() for k, _, v in lines if k.strip()}.items())
                    found.append(x)
                    held += len(block)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist([{k: x.get(k) for k in schema.names} for x in found], schema=schema)
                        found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist([{k: x.get(k) for k in schema.names} for x in found], schema=schema)

    contents = spark.read.format("binaryFile").option("pathGlobFilter", files).option("recursiveFileLookup", True).load(path).select("content")
    return contents.mapInArrow(rows, RECORD + (", payload binary" if with_payload else ""))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, the response or revisit, and all requests, metadata and other records of the transaction, each
    in order of their ids. They meet on the id that they are concurrent to, by one shuffle; a row holds its transaction."""
    inner = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    rows = records.select(F.coalesce("concurrent_to", "record_id").alias("capture_id"), inner.alias("record"))
    place = lambda x: F.concat(F.when(x["record_id"] == F.col("capture_id"), "0").otherwise("1"), x["record_id"])
    by_id = lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0)
    rows = rows.groupBy("capture_id").agg(F.collect_list("record").alias("all")).withColumn("all", F.array_sort("all", by_id))
    of = lambda *kinds: F.filter("all", lambda x: F.coalesce(x["type"].isin(*kinds), F.lit(False)))
    captures, others = of("response", "revisit"), F.filter("all", lambda x: ~F.coalesce(x["type"].isin("response", "revisit", "request", "metadata"), F.lit(False)))
    more = F.when(F.size(captures) > 1, F.slice(captures, 2, F.greatest(F.size(captures) - 1, F.lit(1)))).otherwise(F.slice(captures, 1, 0))
    return rows.select("capture_id", F.get(captures, F.lit(0)).alias("capture"), of("request").alias("requests"), of("metadata").alias("metadata"), F.concat(more, others).alias("others"))


def field(name: str) -> Column:
    """The first value that a capture's metadata records have for a field."""
    values = F.transform("metadata", lambda x: F.try_element_at(x["fields"], F.lit(name)))
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def resolved(captures: DataFrame) -> DataFrame:
    """captures with ``original``: of a revisit, the size and page id of the response that it refers to. Only responses that are referred to
    take part; as one may be referred to by very many, both sides are spread over ``SALTS`` keys."""
    salt = F.pmod(F.xxhash64("capture_id"), F.lit(SALTS))
    asked = captures.filter("capture.refers_to IS NOT NULL").select(F.col("capture.refers_to").alias("original_id")).distinct()
    about = captures.filter("capture.type = 'response'").select(F.col("capture_id").alias("original_id"), F.struct(F.col("capture.payload_bytes").alias("payload_bytes"), field("page-id").alias("page_id")).alias("original"))
    about = about.join(asked, "original_id", "left_semi").withColumn("original_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    referring = F.when(F.col("capture.refers_to").isNull(), F.col("capture_id")).otherwise(F.col("capture.refers_to"))
    rows = captures.withColumns({"salt": salt, "at": referring})
    found = rows.join(about, (F.col("at") == F.col("original_id")) & (F.col("salt") == F.col("original_salt")) & F.col("capture.refers_to").isNotNull(), "left")
    return found.select(*captures.columns, "original")


def report(spark: SparkSession, path: str) -> DataFrame:
    """Per page, read back from the archives at ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    captures = staged(assemble(read(spark, path, with_payload=False)), "captures")
    return resolved(captures).select(
        field("page-id").try_cast("long").alias("page_id"),
        F.coalesce("capture.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.col("original.page_id").try_cast("long").alias("refers_to"),
    )
