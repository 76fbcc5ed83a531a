"""Alignment of the tokens of two tokenizers, by vectorised merging in lockstep.

Both tokenizers write the same bytes, so a token is known by the byte at which it ends. A link is a
pair of an A and a B token that end together; links cut the tokens into groups.

1. *Lanes.* The ends of all tokens of a batch lie on one line of bytes. It is cut at the end of every
   document and every ``SPAN`` bytes into lanes. Links look at ends only, so lanes don't depend on each
   other, and a very long document is many lanes, not many steps.
2. *Lockstep.* One state vector holds each lane's place in A and in B. A step compares the two ends
   of all lanes, emits a link and a cut where they are equal, moves on whichever end is not behind, and
   drops lanes that have reached an end.
3. *Counts.* If two tokens end together, the bytes of one are a suffix of the other's. So the pairs of
   ids that can ever be linked follow from the two vocabularies (some hundred thousand), whatever the
   size of the corpus. A document carries its distinct pairs and how often each is linked; their sums over
   all documents, bounded by that number, go to every task, which scores its documents.

A null or empty text has no tokens, nor has one whose tokens don't write " " + text (such as one with
U+2581, which B writes as a blank): its numbers are 0 and its groups empty. Repeated rows are
documents of their own and all count. A text of any length is aligned whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.arrow_text import raw, slices
from tallyloom.llm.bpe import Pieces, Transducer
from tallyloom.operators.scale import cut_lineage

SPAN = 512  # bytes of a lane
WINDOW = 1 << 20  # bytes aligned at once; a longer text is aligned alone
REMEMBERED = 1 << 22  # ids of words of B that a worker remembers


def lockstep(a: np.ndarray, b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` (ascending token ends) where both have the same end, given the lanes' ends ``cuts``."""
    low = np.append(0, cuts[:-1])
    i, i_end = np.searchsorted(a, low, "right"), np.searchsorted(a, cuts, "right")
    j, j_end = np.searchsorted(b, low, "right"), np.searchsorted(b, cuts, "right")
    links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        on = (i < i_end) & (j < j_end)
        if not on.all():
            i, i_end, j, j_end = i[on], i_end[on], j[on], j_end[on]
        if not len(i):
            break
        x, y = a[i], b[j]
        same = x == y
        links_a.append(i[same])
        links_b.append(j[same])
        i = i + (x <= y)
        j = j + (y <= x)
    return np.sort(np.concatenate(links_a)), np.sort(np.concatenate(links_b))


class Aligner:
    """The two tokenizers, their tokens' bytes, and all pairs of ids that can end together."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Transducer(a_path)
        special = self.a.merges.special
        a_bytes = {i: t for i, t in self.a.merges.bytes.items() if i not in special.values()}
        self.a.merges.special = {}  # in a text they are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        b_bytes = {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            b_bytes[i] = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
        self.blank = self.b.piece_to_id("▁")
        self.words = Pieces(self._merged)
        self.whole_words = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in b_bytes)
        self.bytes = [[table.get(i, b"") for i in range(max(table) + 1)] for table in (a_bytes, b_bytes)]
        self.sizes = [np.array([len(t) for t in table], np.int64) for table in self.bytes]
        self.n_b = len(self.bytes[1])
        shown = [[str(i).encode() for i in range(len(t))] for t in self.bytes]
        # each id with what can follow it: a comma, or the end of its half
        self.shown = [i + c for table, ends in zip(shown, (b",|", b",;")) for c in (ends[:1], ends[1:]) for i in table]
        self.pairs = self._pairs(a_bytes, b_bytes)

    def _pairs(self, a_bytes: dict[int, bytes], b_bytes: dict[int, bytes]) -> np.ndarray:
        by_bytes: list[dict[bytes, list[int]]] = [{}, {}]
        for table, ids in zip(by_bytes, (a_bytes, b_bytes)):
            for i, t in ids.items():
                table.setdefault(t, []).append(i)
        found = {i * self.n_b + j for t, ids in by_bytes[0].items() for k in range(len(t)) for j in by_bytes[1].get(t[k:], ()) for i in ids}
        found |= {i * self.n_b + j for t, ids in by_bytes[1].items() for k in range(1, len(t)) for i in by_bytes[0].get(t[k:], ()) for j in ids}
        return np.array(sorted(found), np.int64)

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of B for words that start with a blank, which B puts there itself."""
        lists = [ids or [self.blank] for ids in self.b.encode([w[1:].decode() for w in words], num_threads=1)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int32, sizes.sum()), sizes

    def _encode_b(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of B of texts that start with a blank; no token crosses from a non-blank to a blank, so words are encoded once."""
        if not self.whole_words:
            lists = self.b.encode([t[1:] for t in texts.to_pylist()], num_threads=1)
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter(chain.from_iterable(lists), np.int32, sizes.sum()), sizes
        body, at = raw(texts)
        data = body[at[0]:at[-1]]
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at - at[0]]
        start = points == 32
        start[1:] &= points[:-1] != 32
        start[ends[:-1]] = True
        first = np.flatnonzero(start)
        if self.words.used > REMEMBERED:
            self.words.clear()
        ids, n = self.words.ids(points, first)
        return ids, np.diff(np.concatenate([[0], np.cumsum(n)])[np.searchsorted(first, ends, "left")])

    def align(self, texts: pa.Array) -> Iterator[tuple]:
        """For slices of rows: rows with tokens, and of these the ids of A and B, their numbers, links' places, and numbers of links.

        Rows without tokens are left out of the arrays.
        """
        texts = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
        body, at = raw(texts)
        for lo, hi in slices(at, WINDOW):
            own = at[lo:hi + 1]
            some = np.flatnonzero(np.diff(own) > 1)
            if len(some):
                chosen = texts.slice(lo, hi - lo).take(pa.array(some))
                a, n_a = self.a.encode(chosen)
                b, n_b = self._encode_b(chosen)
                data = [body[own[r]:own[r + 1]].tobytes() for r in some.tolist()]
                keep = self._writes(0, a, n_a, data) & self._writes(1, b, n_b, data)
                a, n_a, b, n_b, some = a[np.repeat(keep, n_a)], n_a[keep], b[np.repeat(keep, n_b)], n_b[keep], some[keep]
            if not len(some):
                yield lo, hi, some, *[np.zeros(0, np.int64)] * 7
                continue
            size = np.diff(own)[some]
            ends = np.cumsum(size)
            lanes = -(-size // SPAN)
            within = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            cuts = np.minimum(np.repeat(ends - size, lanes) + (within + 1) * SPAN, np.repeat(ends, lanes))
            x, y = lockstep(np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b]), cuts)
            n_links = np.diff(np.searchsorted(x, np.append(0, np.cumsum(n_a)), "left"))
            yield lo, hi, some, a, n_a, b, n_b, x, y, n_links

    def _writes(self, side: int, ids: np.ndarray, sizes: np.ndarray, data: list[bytes]) -> np.ndarray:
        """Which texts the tokens write."""
        tokens = self.bytes[side]
        every = b"".join(map(tokens.__getitem__, ids.tolist()))
        if every == b"".join(data) and (np.add.reduceat(np.append(self.sizes[side][ids], 0), np.cumsum(sizes) - sizes) == [len(d) for d in data]).all() and (sizes > 0).all():
            return np.ones(len(data), bool)
        end = np.append(0, np.cumsum(sizes))
        flat = ids.tolist()
        return np.array([b"".join(map(tokens.__getitem__, flat[i:j])) == d for i, j, d in zip(end.tolist(), end[1:].tolist(), data)])

    def groups(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each text: ids of A and B in the groups that the links cut."""
        half_a, half_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        half_a[x], half_b[y] = 1, 1
        group_a, group_b = np.cumsum(half_a) - half_a, np.cumsum(half_b) - half_b
        # tokens of A stand behind the tokens of B of all earlier groups, those of B behind those of A of their group too
        place_a = np.arange(len(a)) + np.append(0, y + 1)[group_a]
        place_b = np.arange(len(b)) + (x + 1)[group_b]
        line = np.zeros(len(a) + len(b), np.int64)
        na, nb = len(self.bytes[0]), self.n_b
        line[place_a] = a + half_a * na
        line[place_b] = b + half_b * nb + 2 * na
        parts, shown, pos = line.tolist(), self.shown.__getitem__, 0
        for n in (n_a + n_b).tolist():
            yield b"".join(map(shown, parts[pos:pos + n]))[:-1]
            pos += n


_own: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per worker process and pair of vocabularies."""
    if (a_path, b_path) not in _own:
        _own[a_path, b_path] = Aligner(a_path, b_path)
    return _own[a_path, b_path]


def aligned(text: Column, a_path: str, b_path: str, written: bool = True) -> Column:
    """Struct of n_a, n_b, n_groups, groups (the text, or its SHA-256 if not ``written``), pairs and times.

    ``pairs`` are places in the aligner's list of possible pairs, ``times`` how often each is linked.
    """
    @F.arrow_udf("n_a long, n_b long, n_groups long, groups string, pairs array<int>, times array<int>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = aligner(a_path, b_path)
        for column in columns:
            n = len(column)
            n_a, n_b, n_groups, n_pairs = np.zeros((4, n), np.int64)
            groups, pairs, times = [""] * n, [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for lo, _, some, a, a_per, b, b_per, x, y, links in own.align(column):
                if not len(some):
                    continue
                rows = some + lo
                n_a[rows], n_b[rows], n_groups[rows] = a_per, b_per, links
                for r, g in zip(rows.tolist(), own.groups(a, a_per, b, b_per, x, y)):
                    groups[r] = g.decode() if written else hashlib.sha256(g).hexdigest()
                pair = np.searchsorted(own.pairs, a[x].astype(np.int64) * own.n_b + b[y])
                code, count = np.unique(np.repeat(np.arange(len(some)), links) * len(own.pairs) + pair, return_counts=True)
                n_pairs[rows] = np.bincount(code // len(own.pairs), minlength=len(some))
                pairs.append((code % len(own.pairs)).astype(np.int32))
                times.append(count.astype(np.int32))
            at = pa.array(np.append(0, np.cumsum(n_pairs)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(v), pa.int32())) for v in (pairs, times)]
            yield pa.StructArray.from_arrays([*map(pa.array, (n_a, n_b, n_groups)), pa.array(groups, pa.string()), *lists], ["n_a", "n_b", "n_groups", "groups", "pairs", "times"])
    return run(text.cast("string"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair and its number of links in all rows of ``aligned`` texts; never more rows than there are possible pairs."""
    return rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))


def scored(pairs: Column, times: Column, counts: pa.Table, a_path: str, b_path: str) -> Column:
    """Struct of n_links, n_best (links whose count is the highest of their B id) and count_sum."""
    place, n = (counts.column(c).to_numpy() for c in ("pair", "n"))

    @F.arrow_udf("n_links long, n_best long, count_sum long")
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = aligner(a_path, b_path)
        count = np.zeros(len(own.pairs), np.int64)
        count[place] = n
        highest = np.zeros(own.n_b, np.int64)
        np.maximum.at(highest, own.pairs % own.n_b, count)
        best = count == highest[own.pairs % own.n_b]
        for pair, often in columns:
            sizes = np.diff(pair.offsets.to_numpy())
            p, t = pair.flatten().to_numpy(zero_copy_only=False), often.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            end = np.append(0, np.cumsum(sizes))
            sums = [np.append(0, np.cumsum(v)) for v in (t, t * best[p], t * count[p])]
            yield pa.StructArray.from_arrays([pa.array(s[end[1:]] - s[end[:-1]]) for s in sums], ["n_links", "n_best", "count_sum"])
    return run(pairs, times)


def align(docs: DataFrame, a_path: str, b_path: str, written: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), aligned(F.col(text), a_path, b_path, written).alias("x"))
    rows = cut_lineage(rows.select("doc_id", "x.*"), "aligned")
    counts = pair_counts(rows).toArrow()  # as many rows as there are possible pairs, at most
    return rows.withColumn("y", scored(F.col("pairs"), F.col("times"), counts, a_path, b_path)).select("doc_id", "n_a", "n_b", "n_groups", "y.*", "groups")
