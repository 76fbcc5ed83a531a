"""Encoding against the tokenizers library, and exact round trips."""

import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from public_tokenizers import PATTERN
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import bpe, pretoken
from tallyloom.llm.queries import QUERIES, VOCABULARY
from tests.llm.conftest import LONG, SF

PIECES = ["a", "aa", " ", "  ", "\n", "'", "s", "ve", "the", "ing", "é", "1", "٣", "!", "漢", "<|endoftext|>", "<|endof", "😀", "=", " ", "\x1c", "　"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def own():
    return bpe.Transducer(VOCABULARY)


def texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        kind = rng.random()
        if kind < 0.6:
            yield "".join(rng.choices(PIECES, k=rng.randint(0, 60)))
        elif kind < 0.8:
            yield "".join(rng.choices(["a", "ab", "er", "ing", "th", "s"], k=300))
        else:
            yield rng.choice([" ", "!", "é", "=-", "漢字"]) * rng.randint(1, 400) + rng.choice(["", "x", "\n"])


def test_pieces_are_those_of_the_pattern():
    pattern, rng = regex.compile(PATTERN), random.Random(1)
    for _ in range(300):
        some = ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(5)]
        points = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
        at = np.cumsum([0, *map(len, some)])
        assert pretoken.starts(points, at).tolist() == [m.start() + o for t, o in zip(some, at) for m in pattern.finditer(t)]


@pytest.mark.parametrize("chunk, carry", [(50, 20), (7, 300), (1 << 18, 1 << 14)])
def test_chunks_give_the_library_ids_and_texts(library, own, monkeypatch, chunk, carry):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "CARRY", carry)
    for t in texts(150, chunk):
        want = library.encode(t, add_special_tokens=False).ids
        ids = np.concatenate(list(own.stream(t)))
        assert ids.tolist() == want
        machine = bpe.TextMachine(own.merges)
        assert "".join(machine.feed(ids[i:i + 3]) for i in range(0, len(ids), 3)) + machine.finish() == library.decode(want, skip_special_tokens=False)


def test_boundaries_before_the_lookahead_are_final(own):
    rng, m = random.Random(3), own.merges
    assert 0 < m.lookahead < 1000
    for _ in range(200):
        data = "".join(rng.choices(["a", "s", "th", "er", "ing", "--", "=", " "], k=150)).encode()
        ids, used = m.stable(data[:-40])
        whole, ends = m.merge(data), np.cumsum([0])
        ends = np.cumsum([len(m.bytes[t]) for t in whole])
        assert used == 0 or used in ends and whole[:len(ids)] == ids


def test_carry_stays_bounded(own):
    longest = 0
    for _ in range(40):
        own.feed("x" * 50_000)
        longest = max(longest, len(own.carry))
    own.finish()
    assert longest < 2 * bpe.CARRY


def test_odd_rows(spark, odd, empty, library):
    rows = bpe.round_trip(odd, VOCABULARY).select("doc_id", "text", "ids", "decoded").collect()
    for r in rows:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert any(r.text == LONG for r in rows) and bpe.round_trip(empty, VOCABULARY).count() == 0
    again = odd.select("text", bpe.decoded(bpe.encoded(F.col("text"), VOCABULARY), VOCABULARY).alias("t")).collect()
    assert all(r.t == (r.text or "") for r in again)


def test_invalid_bytes_become_replacement_characters(own, library):
    ids = np.array([own.merges.single[b] for b in (0xE6, 0xBC, 0x41, 0xFF)], np.int32)
    assert bpe.decode_rows(bpe.TextMachine(own.merges), ids, np.array([4])) == [library.decode(ids.tolist())]


def test_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op10_bpe"](spark, SF).collect()
    assert len(rows) == len(docs) and all(r.n_tokens == len(library.encode(docs[r.doc_id], add_special_tokens=False).ids) for r in rows)


def test_arrow_slices_and_nulls(own, library):
    column = pa.array(["zero", None, "one two", "", "three"]).slice(1, 3)
    ids, sizes = own.encode(column)
    assert ids.tolist() == library.encode("one two", add_special_tokens=False).ids and sizes.tolist() == [0, 2, 0]
