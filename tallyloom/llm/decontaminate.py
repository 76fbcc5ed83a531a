"""Benchmark passages in documents: SimHash of item-sized windows, Hamming index, exact check.

For every item length, all windows of that many words are considered. A window
and an item of n shingles each with a weighted Jaccard similarity of at least s
share shingles of weight 2s/(1+s) * n, so a window in which fewer positions
hold any shingle of the benchmark is left out at once, without loss. Of the
others a 64-bit SimHash is taken. The fingerprints of the items of that length
are indexed in blocks of bits: two fingerprints within the radius differ by at
most radius // blocks bits in one of the blocks, so looking up each block with
that many flipped bits finds all of them. At the bound of 0.8 the expected
distance is 10 of 64 bits with a deviation of 3; the default radius is 23.
What is found is confirmed by the weighted Jaccard similarity of the shingle
multisets; a shingle's weight is its number of occurrences.

The benchmark is read in blocks of a bounded number of items; each block is one
pass over the documents and no shuffle. Words are runs of characters other
than ASCII blanks and punctuation, in lower case. An item of fewer than five words is one shingle;
an item without words matches nothing, as does an empty or null text. Rows that
repeat an item id with another text are items of their own; equal rows count once. Repeated documents are
reported for each row. Documents of any length are read whole. An empty table on either side gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.arrow_text import raw, shingles, words

BITS, PARTS = 64, 8
MATCHES = "doc_id long, item_id long, start_word long, n_words long, distance int, similarity double"

APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    body, at = raw(pc.utf8_lower(column.cast(pa.large_string())))
    for lo, hi, h, row, _ in words(body, at, APART):
        yield lo, hi, h, row


def bit_matrix(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def window_simhashes(values: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """SimHash of the windows of ``size`` shingles that start at ``at``."""
    sums = np.zeros((len(values) + 1, BITS), np.int32)
    np.cumsum(bit_matrix(values), axis=0, out=sums[1:], dtype=np.int32)
    ones = sums[at + size] - sums[at]
    return np.packbits(2 * ones > size, axis=1, bitorder="little").view("<u8").ravel()


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of equal hashes."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both)


class HammingIndex:
    """All fingerprints within ``radius``, by blocks of eight bits."""

    def __init__(self, fingerprints: np.ndarray, radius: int):
        self.own, self.radius = fingerprints, radius
        flips = [sum(1 << b for b in bits) for k in range(radius // PARTS + 1) for bits in combinations(range(8), k)]
        self.lists = []
        for p in range(PARTS):
            block = (fingerprints >> np.uint64(8 * p)) & np.uint64(255)
            near: list[list[int]] = [[] for _ in range(256)]
            for i, v in enumerate(block.tolist()):
                for f in flips:
                    near[v ^ f].append(i)
            size = np.array([len(x) for x in near])
            self.lists.append((np.cumsum(size) - size, size, np.array([i for x in near for i in x], np.int64)))

    def within(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, distance) of every pair within the radius."""
        found = []
        for p, (begin, size, items) in enumerate(self.lists):
            v = ((fingerprints >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64)
            n = size[v]
            who = np.repeat(np.arange(len(v)), n)
            which = items[np.arange(n.sum()) + np.repeat(begin[v] - (np.cumsum(n) - n), n)]
            found.append(who * len(self.own) + which)
        pair = np.unique(np.concatenate(found))
        who, which = pair // len(self.own), pair % len(self.own)
        distance = np.bitwise_count(fingerprints[who] ^ self.own[which])
        near = distance <= self.radius
        return who[near], which[near], distance[near]


class Benchmark:
    """Items of one block, by shingle size and length."""

    def __init__(self, items: list[tuple[int, str]], k: int, similarity: float, radius: int):
        self.k, self.similarity = k, similarity
        groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
        for (name, _), (_, _, h, row) in zip(items, (w for _, t in items for w in word_hashes(pa.array([t], pa.string())))):
            if len(h):
                size = min(k, len(h))
                groups[size, len(h)].append((name, shingles(h, row, size)[0]))
        self.lengths = defaultdict(list)
        for (size, n), own in sorted(groups.items(), key=lambda x: x[0]):
            prints = np.concatenate([window_simhashes(s, len(s), np.zeros(1, np.int64)) for _, s in own])
            self.lengths[size].append((n, own, HammingIndex(prints, radius)))
        self.known = {size: np.unique(np.concatenate([s for _, own, _ in group for _, s in own])) for size, group in self.lengths.items()}
        self.maybe = {}
        for size, values in self.known.items():  # a small table rules most shingles out
            self.maybe[size] = np.zeros(1 << 18, bool)
            self.maybe[size][values >> np.uint64(46)] = True

    def _hits(self, s: np.ndarray, size: int) -> np.ndarray:
        hit = self.maybe[size][s >> np.uint64(46)]
        at = np.flatnonzero(hit)
        known = self.known[size]
        place = np.minimum(np.searchsorted(known, s[at]), len(known) - 1)
        hit[at] = known[place] == s[at]
        return hit

    def _document(self, s: np.ndarray, hit: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int, float]]:
        total = np.concatenate([[0], np.cumsum(hit)])
        for n, own, index in self.lengths[size]:
            width = n - size + 1
            taken = min(width, len(s))  # a shorter document is one window
            if taken < ceil(self.similarity * width - 1e-9):
                continue
            need = ceil(self.similarity / (1 + self.similarity) * (taken + width) - 1e-9)
            at = np.flatnonzero(total[taken:] - total[:-taken] >= need)
            if not len(at):
                continue
            lo, hi = int(at[0]), int(at[-1]) + taken
            # far apart windows are fingerprinted apart, so a long text needs no long table
            for some in np.split(at, np.flatnonzero(np.diff(at) > taken) + 1):
                lo, hi = int(some[0]), int(some[-1]) + taken
                who, which, distance = index.within(window_simhashes(s[lo:hi], taken, some - lo))
                best: dict[int, tuple[float, int, int]] = {}
                for w, i, d in zip(some[who].tolist(), which.tolist(), distance.tolist()):
                    same = weighted_similarity(s[w:w + taken], own[i][1])
                    if same >= self.similarity - 1e-12 and (i not in best or (-same, w) < (-best[i][0], best[i][1])):
                        best[i] = same, w, d
                for i, (same, w, d) in best.items():
                    yield own[i][0], w, taken + size - 1, d, same

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(row, item, first word, words, distance, similarity): each row's best window for each item."""
        for lo, _, h, row in word_hashes(column):
            for size in self.lengths:
                s, r = shingles(h, row, size)
                hit = self._hits(s, size)
                for one in np.unique(r[hit]).tolist():
                    i, j = np.searchsorted(r, [one, one + 1])
                    best: dict[int, tuple] = {}
                    for found in self._document(s[i:j], hit[i:j], size):
                        key = found[0]
                        if key not in best or (-found[4], found[1]) < (-best[key][4], best[key][1]):
                            best[key] = found
                    for found in best.values():
                        yield lo + one, *found


def blocks(benchmark: DataFrame, item_id: str, text: str, size: int) -> Iterator[list[tuple[int, str]]]:
    """Distinct items, about ``size`` at a time."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).filter("t is not null").distinct()
    parts = max(1, ceil(items.count() / size))
    for b in range(parts):
        some = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == b) if parts > 1 else items
        yield sorted(((r.i, r.t) for r in some.collect()), key=lambda x: (x[0] is None, x))


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 23, block_items: int = 10_000,
                          doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The best window of each document for each item that it holds."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for items in blocks(benchmark, item_id, item_text, block_items):
        def find(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            own = Benchmark(items, k, similarity, radius)
            for batch in batches:
                names, found = batch.column(0).to_pylist(), list(own.matches(batch.column(1)))
                cols = [list(x) for x in zip(*found)] or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                cols[0] = [names[i] for i in cols[0]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [c.split()[0] for c in MATCHES.split(", ")])

        part = base.mapInArrow(find, MATCHES)
        out = part if out is None else out.union(part)
    return out


def is_contaminated(text: Column, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 23, block_items: int = 10_000,
                    item_id: str = "item_id", item_text: str = "text") -> Column:
    """Whether a text holds a passage of any item."""
    def holder(items: list):
        @F.arrow_udf("boolean")
        def holds(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = Benchmark(items, k, similarity, radius)
            for column in columns:
                flags = np.zeros(len(column), bool)
                flags[[m[0] for m in own.matches(column)]] = True
                yield pa.array(flags)
        return holds

    out = F.lit(False)
    for items in blocks(benchmark, item_id, item_text, block_items):
        out = out | holder(items)(text.cast("string"))
    return out
