"""Token ids as length-delimited binary records with checksums and an offset index.

A record file holds frames: the payload's length (8 bytes, little-endian), the
masked CRC-32C of those 8 bytes, the payload, the masked CRC-32C of the
payload. A payload is a flag (1: the id is null), the document id (8 bytes), the number of
ids, the bytes per id (2 while the vocabulary fits, else 4) and the ids. Beside each record file lies an
index of (offset, payload length) pairs for reads in any order.

Records are in ascending ``doc_id`` order over all files (null first): texts are
dealt by ranges of the id and sorted within their range. Rows with the same id
keep the order of the input table. Null texts are empty; a text of any length is one record; extra columns are
ignored. An empty table gives no files.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm import files
from tallyloom.llm.arrow_text import raw, slices
from tallyloom.llm.bpe import CHUNK, Transducer
from tallyloom.llm.crc32c import crc32c, masked
from tallyloom.operators.scale import cut_lineage, work_dir

HEAD = "<?qIB"
MANIFEST = "part int, path string, index string, records long, ids long"
ROWS = "doc_id long, start long, n_ids long, ids binary"


class Library(Transducer):
    """The tokenizers library, asked once for every distinct piece that merges don't cross."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        own.encode_special_tokens = True  # their strings are cut out before

        def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            got = [e.ids for e in own.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.int32), np.array([len(x) for x in got], np.int64)

        super().__init__(path, encode, 1_000_000)  # asking the library again costs more than remembering


_own: dict[str, Library] = {}


def library(path: str) -> Library:
    if path not in _own:
        _own[path] = Library(path)
    return _own[path]


def frames(payloads: list[bytes]) -> list[bytes]:
    """Each payload with its lengths and checksums."""
    sizes = [struct.pack("<Q", len(p)) for p in payloads]
    heads, tails = masked(crc32c(sizes)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [b"".join((n, heads[i].tobytes(), p, tails[i].tobytes())) for i, (n, p) in enumerate(zip(sizes, payloads))]


def _check(what: str, expected: list[bytes], parts: list[bytes]) -> None:
    if np.any(np.frombuffer(b"".join(expected), "<u4") != masked(crc32c(parts))):
        raise ValueError(f"wrong checksum of a record's {what}")


def write_records(docs: DataFrame, folder: str, vocabulary: str, end: int | None = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all texts as records under ``folder``; returns the table of files.

    ``end`` is appended to the ids of each document.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = library(vocabulary)
        kind = "<u2" if max(own.merges.bytes) < 1 << 16 else "<u4"
        count = total = at = 0
        table = []
        with files.new_file(folder, ".rec") as (path, out):
            for batch in batches:
                key, column = batch.column(0), batch.column(1)
                names = key.to_pylist()
                _, offsets = raw(column)
                for lo, hi in slices(offsets, 4 * CHUNK):
                    ids, sizes = own.encode(column.slice(lo, hi - lo))
                    stops = np.cumsum(sizes)
                    payloads = []
                    for r, a, b in zip(range(lo, hi), (stops - sizes).tolist(), stops.tolist()):
                        body = ids[a:b].astype(kind).tobytes() + (b"" if end is None else np.array(end, kind).tobytes())
                        n = len(body) // int(kind[2])
                        payloads.append(struct.pack(HEAD, names[r] is None, names[r] or 0, n, int(kind[2])) + body)
                        total += n
                    for f in frames(payloads):
                        out.write(f)
                        table.append((at, len(f) - 16))
                        at += len(f)
                    count += hi - lo
            with files.new_file(folder, ".idx") as (index, side):
                side.write(np.array(table, "<u8").tobytes())
        if count:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], "index": [index], "records": [count], "ids": [total]})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("tie"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return cut_lineage(dealt.mapInArrow(write, MANIFEST), "record-files")


def _stream(path: str, index: str) -> Iterator[list[bytes]]:
    """Checked payloads of a file, some at a time; the index must agree with the frames."""
    with files.stream(index) as f:
        table = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
    with files.stream(path) as f:
        at = 0
        for lo, hi in slices(np.concatenate([[0], np.cumsum(table[:, 1].astype(np.int64))]), 1 << 20):
            heads, head_sums, payloads, sums = [], [], [], []
            for offset, size in table[lo:hi].tolist():
                head = files.exactly(f, 12)
                heads.append(head[:8])
                head_sums.append(head[8:])
                if offset != at or struct.unpack("<Q", head[:8])[0] != size:
                    raise ValueError(f"the index of {path} doesn't match its frames")
                payloads.append(files.exactly(f, size))
                sums.append(files.exactly(f, 4))
                at += size + 16
            _check("length", head_sums, heads)
            _check("payload", sums, payloads)
            yield payloads
        if f.read(1):
            raise ValueError(f"{path} goes on after its last indexed record")


def _shuffled(path: str, index: str, seed: int) -> Iterator[list[bytes]]:
    """The same payloads in an order drawn from ``seed``, through the index."""
    with files.stream(index) as f:
        table = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
    with files.seekable(path) as f:
        for k in np.random.default_rng(seed).permutation(len(table)).tolist():
            offset, size = table[k].tolist()
            f.seek(offset)
            frame = files.exactly(f, size + 16)
            _check("length", [frame[8:12]], [frame[:8]])
            _check("payload", [frame[-4:]], [frame[12:-4]])
            yield [frame[12:-4]]


def read_records(manifest: DataFrame, seed: int | None = None) -> DataFrame:
    """Documents in the files: id, number of ids before it, and its ids as unsigned 32-bit little-endian bytes.

    With a ``seed``, every file is read in random order through its index, and
    ``start`` is null. The running total is over one row per file.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["start"]
                for payloads in _stream(row["path"], row["index"]) if seed is None else _shuffled(row["path"], row["index"], seed + row["part"]):
                    out = {"doc_id": [], "start": [], "n_ids": [], "ids": []}
                    for p in payloads:
                        missing, key, n, width = struct.unpack_from(HEAD, p)
                        if len(p) != struct.calcsize(HEAD) + n * width:
                            raise ValueError(f"a record of {row['path']} has the wrong length")
                        out["doc_id"].append(None if missing else key)
                        out["start"].append(start if seed is None else None)
                        out["n_ids"].append(n)
                        out["ids"].append(np.frombuffer(p, f"<u{width}", n, struct.calcsize(HEAD)).astype("<u4").tobytes())
                        start += n
                    yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary())]))

    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    listed = manifest.withColumn("start", F.coalesce(before, F.lit(0)))
    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(spread).mapInArrow(read, ROWS)


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents and read them back."""
    return read_records(write_records(docs, work_dir(spark, "records"), vocabulary))
