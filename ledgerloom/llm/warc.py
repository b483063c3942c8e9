"""WARC archives: one gzip member per record, written in parallel, read back sequentially.

The writer makes an archive for each so many bytes of a partition, in a folder that executors share. A
name is fixed by the partition and its place there and a file appears under it only when it is whole, so a
task that runs twice leaves one file. The reader feeds an archive to zlib piece by piece, restarts at each
member's end, frames the record by its Content-Length and checks both digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import new_path, saved

ARCHIVE_BYTES = 32 << 20
PIECE = 1 << 18
LEVEL = 3
#: Payloads shorter than this are always stored.
REVISIT_FROM = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def record(page_id: int | None, row: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header with the full payload's length, but no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in (url or "urn:unknown").encode()).encode("latin-1")
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": _base32(digest),
        "WARC-Block-Digest": _base32(hashlib.sha1(block).hexdigest()),
        "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        fields |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = [pack.compress(head.encode() + b"WARC-Target-URI: " + uri + f"\r\nContent-Length: {len(block)}\r\n\r\n".encode()), pack.compress(block), pack.compress(b"\r\n\r\n"), pack.flush()]
    return b"".join(out)


class _Source:
    """A stream of pieces with reads of exactly so many bytes and up to a mark."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def upto(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.more():
                raise ValueError("the archive ends within a header")
        return self.take(at + len(mark))

    def ended(self) -> bool:
        return not self.held and not self.more()


def inflated(stream) -> Iterator[bytes]:
    """The content of a file of gzip members, a piece at a time."""
    unpack = None
    while raw := stream.read(PIECE):
        while raw:
            unpack = unpack or zlib.decompressobj(31)
            if out := unpack.decompress(raw, PIECE):
                yield out
            raw = unpack.unconsumed_tail
            if unpack.eof:
                raw, unpack = unpack.unused_data, None
    if unpack is not None:
        raise ValueError("the archive ends within a gzip member")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(stream) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(WARC fields, payload length, payload) of each record in order; a wrong digest or frame raises ValueError."""
    source = _Source(inflated(stream))
    while not source.ended():
        head = source.upto(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise ValueError("a record must start with its version")
        fields = _fields(head)
        block = source.take(int(fields["content-length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("the block is longer than its Content-Length")
        if hashlib.sha1(block).hexdigest() != _hex(fields["warc-block-digest"]):
            raise ValueError("the block digest is wrong")
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(_fields(http)["content-length"])
        if fields["warc-type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != _hex(fields["warc-payload-digest"])):
            raise ValueError("the payload digest is wrong")
        yield fields, length, payload


def roles(pages: DataFrame) -> DataFrame:
    """page_id, digest, head: the rows that revisit another, and the page whose response they refer to.

    The heads are written before they are joined and repeated rows dropped before, not behind the join, so that the
    many rows of one payload can be split among tasks.
    """
    slim = pages.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes")).where(F.col("bytes") >= REVISIT_FROM)
    heads = slim.groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null").select("digest", "head")
    heads = saved(heads, "heads")
    return slim.select("page_id", "digest").distinct().join(heads, "digest").where("page_id is null or page_id < head").select("page_id", "digest", "head")


def _writer(folder: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        part, k, held, size, n = TaskContext.get().partitionId(), 0, [], 0, 0
        done: list[tuple[str, int, int]] = []

        def flush() -> None:
            nonlocal k, held, size, n
            name = f"part-{part:06d}-{k:04d}.warc.gz"
            passing = f"{root}/_{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(passing, compression=None) as out:
                for piece in held:
                    out.write(piece)
            store.move(passing, f"{root}/{name}")
            done.append((f"{root}/{name}", n, size))
            k, held, size, n = k + 1, [], 0, 0

        for b in it:
            for page_id, url, payload, digest, head in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                held.append(record(page_id, n, url, payload, digest, head))
                size, n = size + len(held[-1]), n + 1
                if size >= ARCHIVE_BYTES:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], type=pa.string()), pa.array([d[1] for d in done], type=pa.int64()), pa.array([d[2] for d in done], type=pa.int64())], names=["archive", "records", "bytes"])

    return run


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """archive, records, bytes of each archive written into ``folder`` (a URI that executors share).

    Of rows with equal payloads of at least REVISIT_FROM bytes, those with the largest page_id are responses
    and the others revisit it (all rows of that id, if it repeats; rows without an id revisit too, if any row
    has one). Null html is an empty payload; null urls are written as ``urn:unknown``. Extra columns are ignored.

    The roles come from ids and digests alone; the html is read anew beside them, and moves only if the
    revisits are too many to broadcast (then by page_id, which no hot payload skews).
    """
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    again = saved(roles(full), "revisits")
    digest = F.sha1("payload")
    joined = full.withColumn("own", digest).join(again, F.col("own").eqNullSafe(F.col("digest")) & full["page_id"].eqNullSafe(again["page_id"]), "left")
    return saved(joined.select(full["page_id"], "url", "payload", "own", "head").mapInArrow(_writer(folder), "archive string, records long, bytes long"), "archives")


def _reader(folder: str):
    def page(uri: str) -> int | None:
        number = uri.removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in it:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for f, length, payload in records(stream):
                        refers = f.get("warc-refers-to")
                        rows.append((page(f["warc-record-id"]), f["warc-target-uri"].encode("utf-8", "surrogateescape").decode("utf-8", "replace"), length, _hex(f["warc-payload-digest"]), f["warc-type"], page(refers) if refers else None, payload if f["warc-type"] == "response" else None))
                        held += len(payload)
                        if held > 4 << 20:
                            yield emit(rows)
                            rows, held = [], 0
                if rows:
                    yield emit(rows)

    return run


def read_warc(archives: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of each record (null payload: revisit).

    Archives are dealt one by one to tasks; each is read sequentially in bounded memory.
    """
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(n).mapInArrow(_reader(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from archives written and read back."""
    folder = new_path(pages.sparkSession, "warc")
    archives = write_warc(pages, folder)
    return read_warc(archives, folder).drop("payload", "url")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS head, count(*) OVER (PARTITION BY html) AS n FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id < head THEN head END AS refers_to
FROM h"""
