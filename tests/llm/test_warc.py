import base64
import gzip
import hashlib
import io
import random
import zlib

import pytest
from pyspark.errors import PySparkException

from lectern.llm import warc

BIG = "<p>WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n" + "é😀" * 500


def written(spark, tmp_path, rows, **how):
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, nth int").repartition(3)
    warc.write(df, str(tmp_path / "w"), **how)
    return str(tmp_path / "w")


def test_pages_come_back(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", BIG), (2, None, BIG), (9, "http://b", BIG), (3, "http://c", None), (4, "http://c", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", "small"), (7, "u", "small"), (None, "n", "z" * 2000), (8, "n", "z" * 2000), (10, "t", "t" * 1000), (10, "t2", "t" * 1000), (11, "x", "y" * 300000)]
    path = written(spark, tmp_path, rows, file_bytes=900)
    found = [tuple(x) for x in warc.report(spark, path).collect()]
    assert len(found) == len(rows)
    by = lambda k: sorted(((x[1], x[3], x[4]) for x in found if x[0] == k), key=repr)
    size = len(BIG.encode())
    assert by(1) == by(2) == [(size, "revisit", 9)] and by(9) == [(size, "response", None)]
    assert by(3) == by(4) == [(0, "response", None)] and by(5) == [(5, "response", None)] and by(7) == [(5, "response", None)] * 2
    assert by(None) == [(2000, "revisit", 8)] and by(8) == [(2000, "response", None)]
    assert by(10) == [(1000, "response", None), (1000, "revisit", 10)] and by(11) == [(300000, "response", None)]
    files = [x.read_bytes() for x in (tmp_path / "w").rglob("part-*")]
    assert len(files) > 5 and all(len(x) < 900 + max(len(gzip.compress(t.encode())) for t in (BIG, "y" * 300000, "z" * 2000)) + 1500 for x in files)
    records = [warc.parse(io.BytesIO(x)) for data in files for x in members(data)]
    assert [sum(1 for _ in x) for x in records] == [1] * 3 * len(rows)  # a member for each record
    captures = warc.assemble(warc.read(spark, path)).collect()
    assert len(captures) == len(rows) and all(x.capture and x.capture.type in ("response", "revisit") and len(x.requests) == len(x.metadata) == 1 and not x.others for x in captures)
    assert sorted(bytes(x.capture.payload) for x in captures if x.capture.type == "response" and len(x.capture.payload) > 1000) == sorted(x.encode() for x in (BIG, "z" * 2000, "y" * 300000))


def members(data):
    while data:
        unpacker = zlib.decompressobj(31)
        yield unpacker.decompress(data)
        assert unpacker.eof
        data = unpacker.unused_data


def test_records_of_many_members():
    record = random.Random(1).randbytes(20 << 20)
    assert b"".join(members(warc.gzipped(record) + b"\0")) == record


def foreign(kind, name, body=b"", **headers):
    head = {"WARC-Type": kind, "WARC-Record-ID": name, **{k.replace("_", "-"): v for k, v in headers.items()}, "Content-Length": len(body)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    sha = hashlib.sha1(b"hello")
    sha32, md5 = base64.b32encode(sha.digest()).decode(), hashlib.md5(b"hello").hexdigest()
    records = [
        foreign("warcinfo", "<i>", b"software: x\r\n"),
        foreign("response", "<a>", body, WARC_Payload_Digest=f"sha1:{sha32}"),
        foreign("request", "<r1>", WARC_Concurrent_To="<a>"),
        foreign("request", "<r2>", WARC_Concurrent_To="<a>"),
        foreign("metadata", "<m2>", b"a: 1\r\n", WARC_Concurrent_To="<a>"),
        foreign("metadata", "<m1>", b"page-id: 7\r\n", WARC_Concurrent_To="<a>"),
        foreign("response", "<b>", body, WARC_Payload_Digest=f"MD5:{md5}"),
        foreign("response", "<b2>", body, WARC_Concurrent_To="<b>"),
        foreign("response", "<c>", body, WARC_Payload_Digest="blake9:zz"),
        foreign("revisit", "<v>", WARC_Payload_Digest=f"sha1:{sha32}", WARC_Refers_To="<a>"),
    ]
    (tmp_path / "x.warc").write_bytes(b"".join(records[:4]))
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(b"".join(records[4:6])) + gzip.compress(b"".join(records[6:])))
    found = warc.read(spark, str(tmp_path), files="*.warc*")
    rows = {x.record_id: x for x in found.collect()}
    assert len(rows) == 10 and [rows[x].intact for x in ("<a>", "<b>", "<b2>", "<c>")] == [True, True, None, None]
    assert rows["<v>"].payload_digest == rows["<a>"].payload_digest == sha.hexdigest()
    captures = {x.capture_id: x for x in warc.resolved(warc.assemble(found)).collect()}
    assert [x.record_id for x in captures["<a>"].requests] == ["<r1>", "<r2>"] and [x.record_id for x in captures["<a>"].metadata] == ["<m1>", "<m2>"]
    assert captures["<b>"].capture.record_id == "<b>" and [x.record_id for x in captures["<b>"].others] == ["<b2>"] and captures["<i>"].capture is None
    assert captures["<v>"].original.page_id == "7" and captures["<v>"].original.payload_bytes == 5 and captures["<a>"].original is None
    (tmp_path / "z.warc").write_bytes(foreign("response", "<z>", body, WARC_Payload_Digest="sha1:" + "a" * 32))
    assert warc.read(spark, str(tmp_path), strict=False, files="z*").first().intact is False


def test_empty(spark, tmp_path):
    assert warc.report(spark, written(spark, tmp_path, [])).count() == 0


def test_parts_without_a_capture(spark, tmp_path):
    path = written(spark, tmp_path, [(1, "u", "a"), (2, "u", "b")])
    records = warc.read(spark, path, with_payload=False).filter("type <> 'response'")
    assert {(x.capture, len(x.requests) == 1, len(x.metadata) == 1) for x in warc.assemble(records).collect()} == {(None, True, True)}


def test_damage_is_an_error(spark, tmp_path):
    path = tmp_path / "w"
    path.mkdir()
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Payload-Digest: sha1:00\r\nContent-Length: 5\r\n\r\n\r\n\r\nA\r\n\r\n"
    (path / "part-0.gz").write_bytes(gzip.compress(record))
    with pytest.raises(PySparkException):
        warc.read(spark, str(path)).collect()
    with pytest.raises(warc.Malformed):
        list(warc.parse(io.BytesIO(record[:-3])))
