"""Prefix trie against plain sets of sequences, with centroids found by rounds of joins and by single tasks."""

import hashlib
import random
import re
import zlib

from tallyloom.llm import trie
from tallyloom.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import LONG
from tests.oracle import compare, connect

SF01 = "/root/testdata/sf0.1"


def plain(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            by.setdefault(conv, []).append((turn is not None, turn or 0, sha, role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in by.items()}
    members, ending = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = turns.get(c - c % 20, [])[:h] + own[h:]
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ending.setdefault(tuple(seq), []).append(c)
    kids = {}
    for s in members:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids.get(s, [])) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        saved[s] = (len(members[s]) - 1) * words + sum(saved[k] for k in kids.get(s, []))
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else -1, len(m), len(kids.get(s, [])), leaves[s], saved[s],
                   hashlib.sha256(",".join(map(str, sorted(ending.get(s, [])))).encode()).hexdigest()) for s, m in members.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_rounds_of_joins(spark, monkeypatch):
    """Copies, shared beginnings, chains longer than a block and a wide top; every component is split by joins down to three."""
    monkeypatch.setattr(trie, "BLOCK", 16)
    rng = random.Random(2)
    rows = []
    for c in range(70):
        n = rng.choice([1, 2, 3, 5, 90 if c % 17 == 3 else 6])
        rows += [(c, i, "u", rng.choice(["a b", "a b", "c"]) if i < 4 or c % 3 == 0 else f"{c} {i}") for i in range(n)]
    rows += [(c, i, "u", f"long {i}") for c in (200, 201, 300) for i in range(60 + c % 7)]
    rows += [(c, i, "u", f"copy {i}") for c in range(400, 480) for i in range(4)]
    want = plain(rows)
    assert rows_of(trie.prefix_trie(table(spark, rows), whole=40)) == want
    assert rows_of(trie.prefix_trie(table(spark, rows))) == want


def test_single_tasks(spark, monkeypatch):
    """Many components in small batches; chains, stars and random trees."""
    monkeypatch.setattr(trie, "BATCH", 50)
    rng = random.Random(6)
    rows = [(c, i, rng.choice("ua"), rng.choice("xyz") * (i % 3)) for c in range(300) for i in range(rng.randint(1, 7))]
    assert rows_of(trie.prefix_trie(table(spark, rows), whole=900)) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "u", "late"), (1, 2, "u", "late"), (1, 2, "a", "tie"), (None, 1, "u", "nobody"), (40, 5, "u", ""), (41, None, "u", LONG), (41, None, "u", "x"), (25, 0, None, "only"), (20, 0, "u", "base of 25"), (47, 3, "u", "lone"), *((c, 0, "u", "gone") for c in range(81, 87))]
    df = table(spark, rows)
    clash = df.selectExpr("*", "7 AS depth", "'k' AS node", "1 AS conv", "2 AS n", "3 AS words", "4 AS i")
    want = plain(rows)
    assert rows_of(trie.prefix_trie(clash)) == want
    assert any(d == 0 and e != hashlib.sha256(b"").hexdigest() for _, d, *_, e in want)  # some lose all turns
    assert trie.prefix_trie(df.limit(0)).count() == 0
    assert trie.prefix_trie(df.filter("conv_id is null")).count() == 0


def test_query_equals_its_sql(spark):
    ok, n, *_, detail = compare("op11", QUERIES["op11_prefix_trie"](spark, SF01), connect(SF01), ORACLES["op11_prefix_trie"])
    assert ok and n > 1000, detail
