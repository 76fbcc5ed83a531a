"""Splits text into the pieces that byte-level merges never cross.

The rule is the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``,
evaluated for a whole window of texts at once from the class of each
character and of its neighbours.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
QUOTE = ord("'")


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            found = m.group()
            out[[ord(c) for c in found]] = kind
    return out


def starts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions where pieces start. ``at`` holds the ends of the texts in ``points``."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    head = np.zeros(n + 1, bool)  # first character of a text
    head[at] = True
    run = head[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    run[0] = True
    bound = np.append(np.flatnonzero(run), n)
    first, end = bound[:-1], bound[1:]
    blank = kind[first] == SPACE
    start = run
    # a blank run before more text gives its last character away
    gives = blank & ~head[end]
    last = end[gives] - 1
    start[last] = True
    joined = last[points[last] == 32] + 1
    start[joined] = False
    # contractions: a lone quote that starts a piece, and letters after it
    lone = first[(kind[first] == OTHER) & (end - first == 1) & (points[first] == QUOTE) & ~head[end]]
    lone = lone[start[lone] & (kind[np.minimum(lone + 1, n - 1)] == LETTER)]
    if len(lone):
        one = points[lone + 1]
        two = np.where((lone + 2 < n) & ~head[np.minimum(lone + 2, n)], points[np.minimum(lone + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for which, size in ((short, 2), (long, 3)):
            i = lone[which]
            start[i + 1] = False
            after = i + size
            after = after[(after < n)]
            after = after[~head[after] & (kind[after] == LETTER)]
            start[after] = True
    return np.flatnonzero(start)
