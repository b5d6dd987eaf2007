"""Writing and reading web archives (WARC 1.1) with payloads as tables of chunks.

Each writing task streams its records into files in a shared folder, one gzip member per
record, and returns their names; only files that a finished task returned are read, so a
task that ran twice does no harm. Each reading task walks through its files and yields
rows of a record identifier, a chunk number and at most ``CHUNK`` bytes of the payload,
with the digest of the payload so far; no record is ever held whole.

Payloads that occur before are written as revisits, which name the record they repeat.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.llm.shared import write_stage
from matchweave.sources.store import broadcast_if_small, new_path

CHUNK = 1 << 20
# A writing task begins a new file when this many bytes are written.
FILE_BYTES = 256 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = (
    "record_id string, record_type string, refers_to string, target_uri string, header_digest string, "
    "payload_length long, chunk_no int, chunk binary, digest_so_far string, bytes_so_far long"
)


def sha1_base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page: object, row: int) -> str:
    """Identifier of a record: the page's id, percent-encoded, and the number of its row, which keeps it unique."""
    return f"<urn:page:{'' if page is None else '=' + quote(str(page), safe='')}:{row}>"


def page_of(column: str) -> Column:
    """The page id that a record identifier holds; null where the page had none."""
    found = F.regexp_extract(F.col(column), r"^<urn:page:(=?.*):\d+>$", 1)
    return F.when(F.col(column).isNotNull() & found.startswith("="), F.url_decode(F.substr(found, F.lit(2))))


def planned(pages: DataFrame, minimum: int = 0) -> DataFrame:
    """Pages as records: payload, digest key, own and referred record identifiers.

    Of equal payloads of at least ``minimum`` bytes the one with the smallest page id is a
    response, of equal ids the first row, null ids last; the others are revisits of it. The
    input is written once, so that its row numbers stay the same.
    """
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    numbered = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    numbered = numbered.withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.sha2("payload", 256))
    staged, _ = write_stage(numbered, "pages")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    first = staged.where(F.length("payload") >= minimum).groupBy("key").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("many")
    )
    # Most payloads occur once; unless very many repeat, no payload need be moved to find them.
    repeated, _ = write_stage(first.where("many > 1").select("key", "first"), "repeated")
    joined = staged.join(broadcast_if_small(repeated), "key", "left")
    repeats = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "row",
        repeats.alias("repeats"),
        F.when(repeats, F.col("first.page_id")).alias("first_page"),
        F.when(repeats, F.col("first.row")).alias("first_row"),
    )


def _head(kind: str, fields: list[tuple[str, str]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields], "", ""]
    return "\r\n".join(lines).encode()


def _one_line(text: str | None) -> str:
    return "".join(c for c in text or "" if c.isprintable()) or "urn:none"


def write_record(out: Callable[[bytes], object], page, url, payload: bytes, row: int, first: tuple | None, chunk: int = CHUNK) -> int:
    """Write one record as a gzip member, the payload chunk by chunk; return the bytes written."""
    sha = hashlib.sha1()
    view = memoryview(payload)
    for at in range(0, len(view), chunk):
        sha.update(view[at : at + chunk])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(view)}\r\n\r\n".encode()
    fields = [
        ("WARC-Record-ID", record_id(page, row)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _one_line(url)),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(sha.digest())}"),
    ]
    if first is not None:
        fields += [("WARC-Refers-To", record_id(*first)), ("WARC-Profile", REVISIT_PROFILE)]
        view = view[:0]
    fields.append(("Content-Length", str(len(http) + len(view))))
    packer = zlib.compressobj(level=6, wbits=31)
    written = 0

    def put(data) -> None:
        nonlocal written
        packed = packer.compress(data)
        written += len(packed)
        out(packed)

    put(_head("response" if first is None else "revisit", fields))
    put(http)
    for at in range(0, len(view), chunk):
        put(view[at : at + chunk])
    put(b"\r\n\r\n")
    end = packer.flush()
    out(end)
    return written + len(end)


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write `planned` records into archives below a shared folder; one row per file written.

    Columns: path, records, bytes. The files of a failed task stay unnamed and unread.
    """

    def write(batches):
        stream, path, count, size = None, "", 0, 0
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done = []
        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                page, url, payload, row, repeats, first_page, first_row = (c[i] for c in columns)
                if stream is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    stream, path, count, size = store.open_output_stream(posixpath.join(root, name), compression=None), name, 0, 0
                first = (first_page.as_py(), first_row.as_py()) if repeats.as_py() else None
                data = payload.as_buffer()
                size += write_record(stream.write, page.as_py(), url.as_py(), data, row.as_py(), first)
                count += 1
                if size >= file_bytes:
                    stream.close()
                    done.append((path, count, size))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((path, count, size))
        if done:
            names, counts, sizes = (list(x) for x in zip(*done))
            paths = [f"{folder.rstrip('/')}/{n}" for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    chosen = records.select("page_id", "url", "payload", "row", "repeats", "first_page", "first_row")
    files, _ = write_stage(chosen.mapInArrow(write, "path string, records long, bytes long"), "archives")
    return files


class Inflated:
    """Bytes of a file, gzip members or plain, read forward without holding more than a buffer."""

    def __init__(self, stream, buffer: int = 1 << 18):
        self.stream, self.buffer = stream, buffer
        self.raw = stream.read(buffer)
        self.zipped = self.raw[:2] == b"\x1f\x8b"
        self.unzip = zlib.decompressobj(wbits=31) if self.zipped else None
        self.ready = bytearray()

    def _more(self) -> bool:
        if not self.zipped:
            self.ready += self.raw
            had, self.raw = bool(self.raw), self.stream.read(self.buffer)
            return had
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.buffer)
                if not self.raw:
                    return False
            if self.unzip.eof:
                self.unzip = zlib.decompressobj(wbits=31)
            data = self.unzip.decompress(self.raw, self.buffer)
            self.raw = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            if data:
                self.ready += data
                return True

    def line(self) -> bytes | None:
        """Bytes up to and without the next line end, or None at the end of the file."""
        while (at := self.ready.find(b"\n")) < 0:
            if not self._more():
                if not self.ready:
                    return None
                at = len(self.ready)
                break
        out = bytes(self.ready[:at])
        del self.ready[: at + 1]
        return out.removesuffix(b"\r")

    def take(self, most: int) -> bytes:
        """Up to ``most`` bytes; none only at the end of the file."""
        if not self.ready:
            self._more()
        out = bytes(self.ready[:most])
        del self.ready[:most]
        return out


def read_records(stream, chunk: int = CHUNK) -> Iterator[tuple]:
    """Chunk rows (see ``CHUNK_SCHEMA``) of an archive, in order.

    Every record of an HTTP message gives at least one row, chunk 0, also when it holds no
    payload. Records of other kinds are skipped. A record cut short ends with what is there.
    """
    data = Inflated(stream)
    while (line := data.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while line := data.line():
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        left = int(fields.get("content-length", "0"))
        kind = fields.get("warc-type")
        if kind not in ("response", "revisit"):
            while left and (got := data.take(min(left, chunk))):
                left -= len(got)
            continue
        length = None
        while left and (line := data.line()) is not None:  # of the HTTP message
            left -= len(line) + 2
            if not line:
                break
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                length = int(value)
        same = (
            fields.get("warc-record-id"),
            kind,
            fields.get("warc-refers-to"),
            fields.get("warc-target-uri"),
            fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            length,
        )
        sha, total, number = hashlib.sha1(), 0, 0
        while True:
            parts, size = [], 0
            while size < min(left, chunk) and (got := data.take(min(left, chunk) - size)):
                parts.append(got)
                size += len(got)
            if not size and number:
                break
            body = b"".join(parts)
            sha.update(body)
            left, total = left - size, total + size
            yield (*same, number, body, sha1_base32(sha.copy().digest()), total)
            number += 1
            if left <= 0 or not size:
                break


def read_archives(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of archives named by a ``path`` column (see ``CHUNK_SCHEMA``)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(CHUNK_SCHEMA))

    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for row in read_records(stream, chunk):
                        rows.append(row)
                        size += len(row[7])
                        if size >= chunk or len(rows) >= 1000:
                            yield _batch(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, schema)

    # One file a task at most: each is read by a single walk.
    spread = files.select("path").repartition(max(1, files.count()), "path")
    return spread.mapInArrow(read, CHUNK_SCHEMA)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def payloads(chunks: DataFrame) -> DataFrame:
    """One row per record from its chunks: sizes and the digest after its last chunk.

    ``whole`` tells whether the chunks are gapless, have the length that the message states
    and the digest that the record states. A revisit holds no payload; it has the length and
    digest of the one it repeats.
    """
    last = F.max(F.struct("chunk_no", "digest_so_far", "bytes_so_far")).alias("last")
    of_record = chunks.drop("chunk").groupBy("record_id").agg(
        *[F.first(c).alias(c) for c in ("record_type", "refers_to", "target_uri", "header_digest", "payload_length")],
        last,
        F.count(F.lit(1)).alias("chunks"),
    )
    revisit = F.col("record_type") == "revisit"
    whole = (
        (F.col("last.bytes_so_far") == F.col("payload_length"))
        & (F.col("last.digest_so_far") == F.col("header_digest"))
        & (F.col("chunks") == F.col("last.chunk_no") + 1)
    )
    return of_record.select(
        "record_id",
        "record_type",
        "refers_to",
        "target_uri",
        "chunks",
        F.when(revisit, F.col("payload_length")).otherwise(F.col("last.bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("header_digest")).otherwise(F.col("last.digest_so_far")).alias("payload_digest"),
        (revisit | F.coalesce(whole, F.lit(False))).alias("whole"),
    )


def round_trip(pages: DataFrame, minimum: int = 0, folder: str | None = None) -> DataFrame:
    """Write all pages into archives, read them back, and return what the archives say of each.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to. A null html is an
    empty payload, a null url is written as ``urn:none``. One row per input row; no page, no row.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType
    folder = folder or _uri(new_path(spark, "warc"))
    files = write_archives(planned(pages, minimum), folder)
    return payloads(read_archives(files)).select(
        page_of("record_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of("refers_to").cast(kind).alias("refers_to"),
    )


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
