import base64
import gzip
import hashlib
import io
from collections import Counter

import pyarrow.fs as fs
import pytest
from pyspark.sql import functions as F

from matchweave.llm import warc


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pages(spark, rows):
    full = [(*r, 1, "x", b"y") for r in rows]
    return spark.createDataFrame(full, "page_id long, url string, html string, row int, record_type string, payload binary").repartition(3)


ROWS = [
    (3, "http://a/", "same é text"),
    (1, "http://b/", "same é text"),
    (2, None, None),
    (5, "http://c/\r\nWARC-Type: evil", ""),
    (4, "http://d/", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"),
    (6, "http://e/", "z" * 5_000_000),
    (None, "http://f/", "same é text"),
    (7, "http://g/", "twice"),
    (7, "http://g/", "twice"),
    (8, "http://h/", "é" * 700_000),
]


def expected(rows):
    out = Counter()
    for html in {r[2] or "" for r in rows}:
        payload = html.encode()
        ids = sorted([r[0] for r in rows if (r[2] or "") == html], key=lambda i: (i is None, i))
        out[(ids[0], len(payload), sha(payload), "response", None)] += 1
        for i in ids[1:]:
            out[(i, len(payload), sha(payload), "revisit", ids[0])] += 1
    return out


def test_round_trip(spark):
    got = warc.round_trip(pages(spark, ROWS))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, got.collect())) == expected(ROWS)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_minimum_size_of_revisits(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]
    got = {r["page_id"]: r["record_type"] for r in warc.round_trip(pages(spark, rows), minimum=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_payloads_come_back_in_chunks(spark, tmp_path):
    folder = f"file://{tmp_path}"
    files = warc.write_archives(warc.planned(pages(spark, ROWS)), folder, file_bytes=2000)
    assert files.agg(F.sum("records")).first()[0] == len(ROWS) and files.count() > 1
    chunks = warc.read_archives(files, chunk=1000).cache()
    assert chunks.agg(F.max(F.length("chunk"))).first()[0] == 1000
    whole = {}
    for r in chunks.where("record_type = 'response'").orderBy("record_id", "chunk_no").collect():
        whole[r["record_id"]] = whole.get(r["record_id"], b"") + bytes(r["chunk"])
        assert r["bytes_so_far"] == len(whole[r["record_id"]])
        assert r["digest_so_far"] == sha(whole[r["record_id"]])
    assert sorted(whole.values()) == sorted({(r[2] or "").encode() for r in ROWS})
    assert warc.payloads(chunks).where("not whole").count() == 0


def archive(*records):
    """Plain bytes of an archive from (fields, block) pairs."""
    out = b""
    for fields, block in records:
        head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
        out += b"WARC/1.0\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return out


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
OTHERS = [
    ({"WARC-Type": "warcinfo", "WARC-Record-ID": "<i>"}, b"software: x\r\n"),
    ({"WARC-Type": "response", "WARC-Record-ID": "<a>"}, HTTP + b"hello\r\n\r\nWARC/1.0"),
    ({"warc-type": "response", "WARC-Record-ID": "<b>"}, HTTP),
    ({"WARC-Type": "request", "WARC-Record-ID": "<c>"}, b"GET / HTTP/1.1\r\n\r\n"),
]


@pytest.mark.parametrize("pack", [lambda *r: archive(*r), lambda *r: gzip.compress(archive(*r)), lambda *r: b"".join(gzip.compress(archive(x)) for x in r)])
def test_archives_of_others(pack):
    rows = list(warc.read_records(io.BytesIO(pack(*OTHERS)), chunk=4))
    bodies = {}
    for r in rows:
        bodies[r[0]] = bodies.get(r[0], b"") + r[7]
    assert bodies == {"<a>": b"hello\r\n\r\nWARC/1.0", "<b>": b""}
    assert [r[6] for r in rows if r[0] == "<a>"] == [0, 1, 2, 3, 4]


def test_record_cut_short_is_not_whole(spark):
    data = archive(*OTHERS[1:2])[:-12]
    rows = list(warc.read_records(io.BytesIO(data)))
    assert rows[0][7] == b"hello\r\n\r\nWA"[: len(rows[0][7])]
    got = warc.payloads(spark.createDataFrame(rows, warc.CHUNK_SCHEMA)).first()
    assert not got["whole"]


def test_files_are_standard(spark, tmp_path):
    files = warc.write_archives(warc.planned(pages(spark, ROWS[:3])), f"file://{tmp_path}").collect()
    for f in files:
        store, path = fs.FileSystem.from_uri(f["path"])
        with store.open_input_stream(path, compression=None) as stream:
            data = gzip.decompress(stream.read())
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")


def test_any_page_id_comes_back(spark):
    ids = ["", "a\nb", "x+y%20z", "é:1", "=", None, "plain"]
    rows = [(i, "u", "x" * 50) for i in ids]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(2)).collect()
    assert sorted(map(repr, (r["page_id"] for r in got))) == sorted(map(repr, ids))
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {""}
