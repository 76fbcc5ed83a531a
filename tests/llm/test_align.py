"""Token alignment against plain pointers, document by document."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyloom.llm import align
from tallyloom.llm.bpe import byte_alphabet
from tallyloom.llm.queries import PIECES, QUERIES, VOCABULARY
from tests.llm.conftest import LONG, SF

TEXTS = ["a  b", "  lead and trail  ", "<|endoftext|> plain <s> </s>", "ünï \t\n— 漢字 😀 x y", "▁ is a blank", "x", " ", "a\x00b", "no" * 700, "it's 1234567 don't", "", None]


@pytest.fixture(scope="module")
def plain():
    own = Tokenizer.from_file(VOCABULARY)
    own.encode_special_tokens = True
    letters = byte_alphabet()
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def tokens(text):
        """Ids and ends of both sides, or None."""
        if not text:
            return None
        want = (" " + text).encode()
        a = own.encode(" " + text, add_special_tokens=False).ids
        b = pieces.encode(text)
        out_a = [bytes(letters[c] for c in own.id_to_token(i)) for i in a]
        out_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [pieces.id_to_piece(i)]]
        if b"".join(out_a) != want or b"".join(out_b) != want:
            return None
        return a, np.cumsum([len(t) for t in out_a]).tolist(), b, np.cumsum([len(t) for t in out_b]).tolist()

    def table(texts):
        rows, linked = [], []
        for t in texts:
            got = tokens(t)
            if got is None:
                rows.append((0, 0, 0, 0, ""))
                linked.append([])
                continue
            a, ends_a, b, ends_b = got
            ends = set(ends_a) & set(ends_b)
            groups, i, j = [], 0, 0
            for e in sorted(ends):
                left, right = [], []
                while i < len(a) and ends_a[i] <= e:
                    left.append(str(a[i]))
                    i += 1
                while j < len(b) and ends_b[j] <= e:
                    right.append(str(b[j]))
                    j += 1
                groups.append(",".join(left) + "|" + ",".join(right))
            place = dict(zip(ends_b, b))
            linked.append([(x, place[e]) for x, e in zip(a, ends_a) if e in place])
            rows.append((len(a), len(b), len(groups), len(linked[-1]), ";".join(groups)))
        count = Counter(p for pairs in linked for p in pairs)
        top = {}
        for (_, y), n in count.items():
            top[y] = max(top.get(y, 0), n)
        return [(n_a, n_b, n_g, n_l, sum(count[p] == top[p[1]] for p in pairs), sum(count[p] for p in pairs), g) for (n_a, n_b, n_g, n_l, g), pairs in zip(rows, linked)]

    return table


def answers(rows):
    return [(r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)) for r in rows]


def test_odd_texts(spark, plain):
    texts = TEXTS + [LONG[:150_000] + "é" * 3000 + LONG[:70_000]] + TEXTS[:3]
    rows = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, groups string")
    got = dict(answers(align.align(rows, VOCABULARY, PIECES).collect()))
    assert [got[i] for i in range(len(texts))] == plain(texts)
    assert got[4][:3] == (0, 0, 0) and got[0] == got[len(texts) - 3]


def test_ids_and_empty_table(spark, odd, empty, plain):
    rows = odd.select("doc_id", "text").collect()
    got = answers(align.align(odd.repartition(3), VOCABULARY, PIECES).collect())
    assert sorted(got, key=str) == sorted(zip([r.doc_id for r in rows], plain([r.text for r in rows])), key=str)
    assert align.align(empty, VOCABULARY, PIECES).count() == 0


def test_query(spark, plain):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    want = [(i, (*w[:-1], w[-1] and hashlib.sha256(w[-1].encode()).hexdigest())) for i, w in zip(docs.doc_id, plain(docs.text.tolist()))]
    assert answers(QUERIES["op13_align"](spark, SF).withColumnRenamed("groups_sha256", "groups").orderBy("doc_id").collect()) == want


def test_lockstep_in_lanes():
    rng = np.random.default_rng(4)
    ends = [np.unique(np.append(rng.integers(1, 20_000, n), 20_000)) for n in (6000, 900)]
    for span in (1, 7, 512, 20_000):
        x, y = align.lockstep(*ends, np.minimum(np.arange(span, 20_000 + span, span), 20_000))
        assert (ends[0][x] == ends[1][y]).all() and ends[0][x].tolist() == sorted(set(ends[0]) & set(ends[1]))


def test_every_link_is_a_possible_pair():
    own = align.aligner(VOCABULARY, PIECES)
    assert (np.diff(own.pairs) > 0).all() and len(own.pairs) < 1_000_000
    for pair in own.pairs[:: 5000].tolist():
        x, y = own.bytes[0][pair // own.n_b], own.bytes[1][pair % own.n_b]
        assert x.endswith(y) or y.endswith(x)
