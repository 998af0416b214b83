"""WARC archives as a chunked record table (operator 10).

A record is a run of rows (record, chunk_no, data): its bytes, cut at
`chunk_bytes`, so no task ever holds an oversized record as one value.
Every row carries the SHA-256 of the payload up to its end; the writer
updates one digest as it goes, the reader another, and they must agree.
The data of a record's rows, joined in order, are the bytes of a WARC/1.1
record; `export` writes them as a .warc.gz file, `read_file` cuts such a
file into the same rows.

Records that fit one row are read back where they lie. Only the rows of
longer ones are dealt by record and sorted by chunk_no.

Deduplication: of equal payloads of at least `min_revisit` bytes, the row
with the smallest page_id is a response, the others revisit it. Payloads
are compared by their SHA-256. Digests that occur twice are broadcast, up
to `BROADCAST_DIGESTS` of them, so no payload is shuffled and copies stay
where they lie. Beyond that, the digests of many copies, whose number is
bounded, are still broadcast, and pages are dealt by digest for the rest.

After reading, every revisit is held against its response: they must have
one digest and one length.

Defined results: a null payload is empty; a null url leaves the target
header out; rows that repeat the smallest page_id with the same payload
are responses too; an empty table gives an empty archive; other columns
are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import discard, materialise, shuffle_partitions, slices

CHUNK_BYTES, MIN_REVISIT = 1 << 18, 100
#: Repeated digests are broadcast up to so many (about 100 bytes each).
BROADCAST_DIGESTS = 500_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_TABLE = "record long, chunk_no int, last boolean, data binary, payload_sha256 string"


def _urn(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{digest}'.encode()).digest()[:16])}>"


def _head(page_id, url: str | None, size: int, digest: str, refers_to) -> bytes:
    """The WARC and HTTP headers of a record; refers_to: the page that a revisit repeats, or None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in url) if url is not None else None
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {_DATE}"]
    lines += [f"WARC-Target-URI: {target}"] * (target is not None)
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Page-Id: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}", f"WARC-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + size * (refers_to is None)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def record_types(pages: DataFrame, id_col: str, payload: str, min_revisit: int = MIN_REVISIT, broadcast: int = BROADCAST_DIGESTS) -> DataFrame:
    """pages with payload (binary), digest and refers_to."""
    df = pages.withColumn("payload", F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary")))
    df = df.withColumn("digest", F.sha2("payload", 256))
    seen = df.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min(id_col).alias("kept"), F.count("*").alias("copies"))
    seen = materialise(seen.where("copies > 1"), "repeated-payloads")
    if seen.count() <= broadcast:
        out = df.join(F.broadcast(seen.drop("copies")), "digest", "left")
    else:
        # digests of over a share of all copies: at most 4 a partition
        share = seen.agg(F.sum("copies")).first()[0] // (4 * shuffle_partitions(df.sparkSession))
        hot = seen.where(F.col("copies") > share).drop("copies")
        rest = seen.where(F.col("copies") <= share).drop("copies").hint("shuffle_merge")
        out = df.join(F.broadcast(hot), "digest").unionByName(df.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest, "digest", "left"))
    return out.withColumn("refers_to", F.when(F.col(id_col).eqNullSafe(F.col("kept")), None).otherwise(F.col("kept"))).drop("kept")


def write_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk_bytes: int = CHUNK_BYTES, min_revisit: int = MIN_REVISIT, broadcast: int = BROADCAST_DIGESTS) -> DataFrame:
    """The chunked record table; record numbers are unique within it."""
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).alias("html"))
    df = record_types(df, "page_id", "html", min_revisit, broadcast).select("page_id", "url", "payload", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        record = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "payload", 8_000_000):
                rows: list = []
                held = 0
                for page, url, payload, digest, refers in zip(*(part.column(c) if c == "payload" else part.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                    body = memoryview(payload.as_buffer() or b"") if payload.is_valid else memoryview(b"")
                    size, running = len(body), hashlib.sha256()
                    record += 1
                    head = _head(page, url, size, digest, refers)
                    body = body if refers is None else body[:0]
                    room = max(1, chunk_bytes - len(head))
                    at, k = min(room, len(body)), 0
                    running.update(body[:at])
                    last = at == len(body)
                    rows.append((record, 0, last, b"".join((head, body[:at], b"\r\n\r\n" if last else b"")), running.hexdigest()))
                    while not last:
                        k, end = k + 1, min(at + chunk_bytes, len(body))
                        running.update(body[at:end])
                        last = end == len(body)
                        rows.append((record, k, last, b"".join((body[at:end], b"\r\n\r\n" if last else b"")), running.hexdigest()))
                        at = end
                        held += chunk_bytes
                        if held >= 8_000_000:
                            yield _rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return df.mapInArrow(write, _TABLE)


def _rows(rows: list) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["record", "chunk_no", "last", "data", "payload_sha256"])


class Reader:
    """Parses one record fed chunk by chunk; keeps headers and a digest, never the payload."""

    def __init__(self):
        self.pending, self.headers, self.http, self.left, self.payload = b"", None, None, 0, 0
        self.digest = hashlib.sha256()

    def feed(self, data: bytes) -> None:
        if self.http is None:
            self.pending += data
            if self.headers is None and b"\r\n\r\n" in self.pending:
                head, _, self.pending = self.pending.partition(b"\r\n\r\n")
                lines = head.decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("no WARC record here")
                self.headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
                self.left = int(self.headers["Content-Length"])
            if self.headers is None or b"\r\n\r\n" not in self.pending:
                return
            head, _, data = self.pending.partition(b"\r\n\r\n")
            self.http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            self.left -= len(head) + 4
            self.pending = b""
        part = data[: self.left]
        self.digest.update(part)
        self.payload += len(part)
        self.left -= len(part)

    def close(self) -> tuple:
        """(page_id, payload_bytes, payload_digest, record_type, refers_to); raises if the record is cut short or its digest wrong."""
        h = self.headers
        if h is None or self.http is None or self.left:
            raise ValueError("a record is cut short")
        digest, kind = h["WARC-Payload-Digest"].partition(":")[2], h["WARC-Type"]
        if kind == "response" and self.digest.hexdigest() != digest:
            raise ValueError(f"the payload digest of {h['WARC-Record-ID']} is wrong")
        refers = h.get("WARC-Refers-To-Page-Id")
        return h["WARC-Page-Id"] or None, int(self.http["Content-Length"]), digest, kind, refers


def read_records(records: DataFrame, id_type: str = "long") -> DataFrame:
    """The records of a table: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    out = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    names = [f.split()[0] for f in out.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, current, rows = None, None, []
        for batch in batches:
            for record, last, data, running in zip(*(batch.column(c).to_pylist() for c in ("record", "last", "data", "payload_sha256")), strict=True):
                if record != current:
                    if reader is not None:
                        raise ValueError("a record is cut short")
                    reader, current = Reader(), record
                reader.feed(data)
                if reader.http is not None and reader.digest.hexdigest() != running:
                    raise ValueError(f"record {record}: a chunk's running digest is wrong")
                if last:
                    rows.append(reader.close())
                    reader = current = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "payload_bytes" else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)
                rows = []

    narrow = records.where("chunk_no = 0 and last").mapInArrow(read, out)
    wide = records.where("not (chunk_no = 0 and last)").repartition(shuffle_partitions(records.sparkSession), "record").sortWithinPartitions("record", "chunk_no").mapInArrow(read, out)
    both = narrow.unionByName(wide)
    return both.select(F.col("page_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


def mismatched(records: DataFrame) -> DataFrame:
    """(refers_to, payload_digest, payload_bytes) of revisits without a response of that digest and length."""
    told = records.where("record_type = 'revisit'").select("refers_to", "payload_digest", "payload_bytes").distinct()
    held = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    return told.join(held, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write the archives to the shared folder, read them back and hold revisits against their responses."""
    kind = pages.schema[options.get("id_col", "page_id")].dataType.simpleString()
    written = materialise(write_records(pages, **options), "warc")
    records = materialise(read_records(written, kind), "warc-records")
    discard(written)
    if wrong := mismatched(records).limit(3).collect():
        raise ValueError(f"revisits without their response: {wrong}")
    return records


def export(rows, path: str) -> int:
    """Write (record, data) rows, in order, to a .warc.gz file, a gzip member per record; returns the records."""
    n, current, member = 0, None, None
    with open(path, "wb") as out:
        for record, data in rows:
            if record != current:
                if member:
                    member.close()
                n, current, member = n + 1, record, gzip.GzipFile(fileobj=out, mode="wb", mtime=0)
            member.write(data)
        if member:
            member.close()
    return n


def read_file(stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, bool, bytes, str]]:
    """Rows of the record table from an open (decompressed) WARC stream, holding one chunk at a time."""
    record, buffer = 0, b""

    def more() -> bool:
        nonlocal buffer
        got = stream.read(chunk_bytes)
        buffer += got
        return bool(got)

    while True:
        buffer = buffer.lstrip(b"\r\n")
        while b"\r\n\r\n" not in buffer:
            if not more():
                if buffer.strip():
                    raise ValueError("a record is cut short")
                return
            if not record:
                buffer = buffer.lstrip(b"\r\n")
        head, _, buffer = buffer.partition(b"\r\n\r\n")
        left = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")) + 4
        record, k, data, reader = record + 1, 0, head + b"\r\n\r\n", Reader()
        while True:
            while not buffer and left and more():
                pass
            part, buffer = buffer[:left], buffer[left:]
            if left and not part:
                raise ValueError("a record is cut short")
            left -= len(part)
            data += part
            if not left or len(data) >= chunk_bytes:
                reader.feed(data)
                yield record, k, not left, data, reader.digest.hexdigest()
                k, data = k + 1, b""
            if not left:
                break
