"""Web archives in Zstandard: one frame per record, dictionary in a leading skippable frame.

Writing: pages with equal payloads are found by digest. The one with the
smallest ``page_id`` becomes a ``response`` record, the others ``revisit`` it
and carry only their HTTP headers. Roles are found on (id, digest) rows, so
payloads are shuffled once, by page.

Reading: the dictionary comes from the skippable frame at the start (itself
plain or compressed; files without one are read too); then each frame is
located by walking its block headers, decoded alone and checked: version,
required headers, content length, end mark, block and payload digests, declared sizes.

Defined cases: a null html is an empty payload; a null ``page_id`` sorts behind all others,
so it is a response only if no page of that payload has an id; of repeated rows
of one page and payload, one is the response; line breaks in a URL are escaped, a null URL is empty. A payload of any length is one record. An empty table gives an
archive without records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import files
from tallyloom.operators.scale import cut_lineage, work_dir

SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
READ = 1 << 17


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, key: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, date: str) -> bytes:
    """One record. A revisit has the HTTP headers of the page, but not its payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers is None else refers}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(pages: DataFrame, html: str, rows: int, longest: int, size: int) -> bytes | None:
    """A dictionary from at most ``rows`` pages of at most ``longest`` characters; it only affects the files' size."""
    some = [r[0].encode() for r in pages.filter(F.length(html).between(64, longest)).select(F.substring(html, 1, longest)).limit(rows).collect()]
    if len(some) < 16:
        return None
    try:
        return zstd.train_dictionary(size, some).as_bytes()
    except zstd.ZstdError:  # too little to learn from
        return None


def archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2000-01-01T00:00:00Z",
            sample_rows: int = 256, sample_chars: int = 1 << 14, dictionary_bytes: int = 1 << 15) -> DataFrame:
    """Write a record for each page under ``folder``; returns the table of files."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    rows = rows.withColumn("key", F.coalesce("page_id", F.lit(0))).withColumn("unnamed", F.col("page_id").isNull())
    learned = trained(rows, "html", sample_rows, sample_chars, dictionary_bytes)

    keys = rows.select("key", "unnamed", "digest")
    first = keys.groupBy("digest").agg(F.min(F.when(~F.col("unnamed"), F.col("key"))).alias("first"))
    roles = keys.distinct().join(first, "digest")
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # copies of one page meet in one task, which gives the first of them the response
    together = ["key", "unnamed", "digest"]
    dealt = rows.repartition(parts, *together).join(roles, together)
    dealt = dealt.sortWithinPartitions(*together).select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstd.ZstdCompressor(level=3, dict_data=learned and zstd.ZstdCompressionDict(learned), write_checksum=True)
        count = total = 0
        before = None
        with files.new_file(folder, ".warc.zst") as (path, out):
            if learned:
                packed = zstd.ZstdCompressor(level=9).compress(learned)
                total += out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
            for batch in batches:
                for page, link, payload, digest, first in zip(*(c.to_pylist() if c.type != pa.binary() else (x.as_buffer().to_pybytes() for x in c) for c in batch.columns)):
                    kind = "response" if page == first and (page, digest) != before else "revisit"
                    before = page, digest
                    bare = base64.b32encode(bytes.fromhex(digest)).decode()
                    total += out.write(zip_.compress(record(kind, page, link, payload, bare, first, date)))
                    count += 1
        if count:
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64()), "bytes": pa.array([total or 0], pa.int64())})

    return cut_lineage(dealt.mapInArrow(write, MANIFEST), "archive-files")


class _Buffer:
    """Reads ahead in a stream without losing what was not used."""

    def __init__(self, f: BinaryIO):
        self.f, self.data, self.at = f, b"", 0

    def need(self, n: int) -> bool:
        """Whether ``n`` more bytes are there."""
        while len(self.data) - self.at < n:
            more = self.f.read(max(READ, n))
            if not more:
                return False
            self.data, self.at = self.data[self.at:] + more, 0
        return True

    def peek(self, n: int, skip: int = 0) -> bytes:
        if not self.need(skip + n):
            raise ValueError("archive ends inside a frame")
        return self.data[self.at + skip:self.at + skip + n]

    def take(self, n: int) -> bytes:
        got = self.peek(n)
        self.at += n
        return got


def frame_size(buffer: _Buffer) -> int:
    """Compressed size of the frame ahead, from its header and block headers."""
    mark = buffer.peek(6)
    flags = mark[4]
    single, id_bytes = flags >> 5 & 1, (0, 1, 2, 4)[flags & 3]
    size = 5 + (not single) + id_bytes + (single, 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        block = int.from_bytes(buffer.peek(3, size), "little")
        last, kind = bool(block & 1), block >> 1 & 3
        if kind == 3:
            raise ValueError("reserved block type")
        size += 3 + (1 if kind == 1 else block >> 3)
    return size + 4 * (flags >> 2 & 1)


def records(f: BinaryIO) -> Iterator[bytes]:
    """Decoded records of an archive, one at a time."""
    buffer = _Buffer(f)
    unzip = zstd.ZstdDecompressor()
    start = True
    while buffer.need(1):
        mark = buffer.peek(4)
        if 0x184D2A50 <= int.from_bytes(mark, "little") <= 0x184D2A5F:
            body = buffer.take(8 + int.from_bytes(buffer.peek(4, 4), "little"))[8:]
            if start and int.from_bytes(mark, "little") == SKIPPABLE:
                if body[:4] == FRAME:
                    body = zstd.ZstdDecompressor().decompress(body)
                unzip = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(body))
        elif mark == FRAME:
            frame = buffer.take(frame_size(buffer))
            declared = zstd.frame_content_size(frame)
            data = unzip.decompress(frame) if declared >= 0 else unzip.decompressobj().decompress(frame)
            if declared >= 0 and len(data) != declared:
                raise ValueError("frame has another size than it declares")
            yield data
        else:
            raise ValueError("neither a Zstandard nor a skippable frame")
        start = False


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, checked."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line {line!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"record without {name}")
    n = int(headers["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("block has another length than its header says")
    if (want := headers.get("warc-block-digest")) and want != f"sha1:{sha1_base32(block)}":
        raise ValueError("wrong block digest")
    return headers, block


def _key(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def page_row(data: bytes) -> dict:
    headers, block = parse(data)
    http, mark, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.lower().split(": ", 1) for line in http.decode().split("\r\n")[1:])
    n, kind = int(fields["content-length"]), headers["warc-type"]
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != n or sha1_base32(payload) != digest):
        raise ValueError("payload doesn't match its length or digest")
    return {"page_id": _key(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "payload_bytes": n, "payload_digest": digest, "record_type": kind,
            "refers_to": _key(headers["warc-refers-to"]) if kind == "revisit" else None}


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the listed files."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with files.stream(path) as f:
                    for data in records(f):
                        rows.append(page_row(data))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(spread).mapInArrow(read, ROWS)


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages and read them back."""
    return read_archives(archive(pages, work_dir(spark, "warc")))
