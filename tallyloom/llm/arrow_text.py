"""Arrow text columns as byte arrays, words and shingles as 64-bit hashes.

Everything works on slices of about ``WINDOW`` bytes, so memory follows the
longest text and not the batch. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WINDOW = 1 << 18
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of each."""
    if len(_powers["up"]) < n:
        size = max(n, WINDOW + 64)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls have no bytes."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_valid()), np.diff(at), 0)
        if lengths.sum() != at[-1] - at[0]:  # a null may still have bytes behind it
            return raw(column.fill_null(""))
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body, at


def slices(at: np.ndarray, limit: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes; a longer row comes alone."""
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values``, equal for equal content anywhere."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def word_spans(body: np.ndarray, at: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes outside ``apart``; rows of ``at`` never share a run."""
    inside = ~apart[body]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(body)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = at[1:][(at[1:] > 0)] - 1
    last[tails] = inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(body: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of rows: (first row, end row, word hashes, row of each word, byte start of each word).

    Words are lower-cased in A-Z. A row longer than the window is read in
    pieces that are cut between words, so only its word hashes are held whole.
    """
    for lo, hi in slices(at):
        base, end = int(at[lo]), int(at[hi])
        if hi - lo > 1 or end - base <= WINDOW:
            part, own = body[base:end], at[lo:hi + 1] - base
            s, e = word_spans(part, own, apart)
            h = span_hashes(BYTE_VALUE[LOWER[part]], s, e)
            yield lo, hi, h, np.searchsorted(own, s, "right") - 1, s
            continue
        hashes, places, pos = [], [], base
        while pos < end:
            stop = min(end, pos + WINDOW)
            while stop < end and not apart[body[stop]]:  # the cut falls between words
                ahead = np.flatnonzero(apart[body[stop:stop + 4096]])
                stop = stop + int(ahead[0]) if len(ahead) else min(end, stop + 4096)
            part = body[pos:stop]
            s, e = word_spans(part, np.array([0, len(part)]), apart)
            hashes.append(span_hashes(BYTE_VALUE[LOWER[part]], s, e))
            places.append(s + (pos - base))
            pos = stop
        h = np.concatenate(hashes)
        yield lo, hi, h, np.zeros(len(h), np.int64), np.concatenate(places)


def shingles(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``k`` words; shorter rows have none here."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(n, U64)
    for i in range(k):
        out = out * U64(0xC2B2AE3D27D4EB4F) + h[i:i + n]
    whole = row[:n] == row[k - 1:k - 1 + n]
    return mix(out[whole]), row[:n][whole]
