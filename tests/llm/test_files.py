"""Record files and web archives: exact round trips and damaged files."""

import base64
import hashlib
import io
import zlib

import numpy as np
import pytest
import zstandard as zstd
from tokenizers import Tokenizer

from tallyloom.llm import records, warc
from tallyloom.llm.crc32c import crc32c, masked
from tallyloom.llm.queries import ORACLES, QUERIES, VOCABULARY
from tallyloom.operators.scale import work_dir
from tests.llm.conftest import SF
from tests.oracle import compare, connect


def plain_crc32c(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_crc32c():
    parts = [b"123456789", *((bytes(range(256)) * 9)[:n] for n in (4, 1023, 1024, 1025, 2300))]
    assert crc32c([b"123456789"])[0] == 0xE3069283
    assert crc32c(parts).tolist() == [plain_crc32c(p) for p in parts]
    assert crc32c([]).tolist() == [] and masked(np.zeros(1, np.uint32))[0] == 0xA282EAD8


def test_records(spark, odd, empty):
    manifest = records.write_records(odd, work_dir(spark, "t"), VOCABULARY)
    rows = sorted(records.read_records(manifest).collect(), key=lambda r: r.start)
    own = Tokenizer.from_file(VOCABULARY)
    docs = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (key, text) in zip(rows, docs, strict=True):
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_ids) == (key, start, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    shuffled = records.read_records(manifest, seed=5).collect()
    assert sorted(bytes(r.ids) for r in shuffled) == sorted(bytes(r.ids) for r in rows)
    assert records.token_files(spark, empty, VOCABULARY).count() == 0


def test_damaged_record_is_found(spark, odd):
    manifest = records.write_records(odd, work_dir(spark, "t"), VOCABULARY)
    row = manifest.first()
    path = row.path.removeprefix("file://").removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    data[30] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="checksum"):
        list(records._stream(row["path"], row["index"]))


def test_record_query(spark):
    own = Tokenizer.from_file(VOCABULARY)
    start = 0
    rows = {r.doc_id: r for r in QUERIES["op4_records"](spark, SF).collect()}
    for d in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = own.encode(d.text or "", add_special_tokens=False).ids + [0]
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_archive(spark):
    pages = spark.createDataFrame(
        [(7, "http://a/\r\nx", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (5, None, None), (2, "http://c", ""), (None, "http://d", "only"), (9, "http://e", "z" * 500_000)] + [(100 + i, f"http://f/{i}", f"<html><body>page number {i} of many pages</body></html>") for i in range(40)],
        "page_id long, url string, html string").withColumn("digest", pages_clash()).withColumn("first", pages_clash())
    rows = [tuple(r) for r in warc.archived(spark, pages).drop("url").collect()]
    want, first = [], {}
    given = pages.select("page_id", "html").collect()
    for r in given:
        body = (r.html or "").encode()
        if r.page_id is not None:
            first[body] = min(first.get(body, r.page_id), r.page_id)
    seen = set()
    for r in given:
        body = (r.html or "").encode()
        f = first.get(body)
        response = r.page_id == f and (r.page_id, body) not in seen
        seen.add((r.page_id, body))
        want.append((r.page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else f))
    key = str
    assert sorted(rows, key=key) == sorted(want, key=key)
    assert warc.archived(spark, pages.limit(0)).count() == 0


def pages_clash():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_archive_query_equals_sql(spark):
    ok, *_, detail = compare("op9_warc", QUERIES["op9_warc"](spark, SF), connect(SF), ORACLES["op9_warc"])
    assert ok, detail


def test_reader_checks_what_it_reads():
    body = warc.record("response", 1, "http://a", b"hello", warc.sha1_base32(b"hello"), None, "2000-01-01T00:00:00Z")
    dictionary = zstd.train_dictionary(4096, [b"WARC/1.1 record %d of some text that repeats" % i * 5 for i in range(200)])
    pack = zstd.ZstdCompressor(dict_data=dictionary, write_checksum=True)
    head = (warc.SKIPPABLE).to_bytes(4, "little") + len(dictionary.as_bytes()).to_bytes(4, "little") + dictionary.as_bytes()
    good = head + pack.compress(body) + pack.compress(body)
    assert list(warc.records(io.BytesIO(good))) == [body, body]
    assert list(warc.records(io.BytesIO(zstd.ZstdCompressor().compress(body)))) == [body]
    for broken in (good[:-3], good + b"junk", head + pack.compress(body)[4:]):
        with pytest.raises((ValueError, zstd.ZstdError)):
            list(warc.records(io.BytesIO(broken)))
    for wrong in (body.replace(b"hello", b"hallo"), body[:-1], body.replace(b"WARC/1.1", b"WARC/9.9"), body.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc.parse(wrong)
