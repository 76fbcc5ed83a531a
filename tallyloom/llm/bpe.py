"""Byte-pair encoding as a streaming transducer with bounded lookahead.

**Lookahead.** Merges run in rank order. Whether the boundary behind a token
``t`` survives depends on what stands right of it only through a merge
``(t, w)``: ``w`` must have formed there, and the boundary behind ``w`` must
have survived all earlier merges, which again looks right of ``w``. Let
``reach[t]`` be the number of bytes that this chain can look at. One pass over
the merge list in rank order computes it: for ``(t, w) -> z``,
``reach[t] = max(reach[t], len(w) + reach[w])`` and ``z`` starts with the reach
of its right part (while ``z`` forms, its end is the end of ``w``). The largest
reach is the sufficient lookahead: a boundary that many bytes before the end of
what has been read is final.

**Encoding.** Text arrives in chunks. Pieces that merges never cross
(``pretoken``) are final once the next two have begun; of a piece longer than
the carry limit, the tokens before the lookahead are emitted and the rest is
carried. So memory depends on the chunk and the merge list, not on the text.

**Decoding** feeds token bytes to an incremental UTF-8 decoder that holds at
most three bytes; invalid sequences become U+FFFD, as the library writes them.

Nulls are empty texts and give no tokens. Repeated rows give equal rows. Extra
columns pass through; the result columns replace columns of the same name.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import pretoken
from tallyloom.llm.arrow_text import raw, slices, span_hashes

CHUNK = 1 << 18  # characters read at once from a long text
CARRY = 1 << 14  # characters of one piece that may wait for its end
CACHED = 250_000  # pieces remembered by a worker
SHORT = 128  # bytes of a piece up to which many are merged together
FAR = np.int32(2**31 - 1)  # rank of a pair that doesn't merge


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """A merge list over bytes: ranks, token bytes and the sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.single = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        size = {i: len(b) for i, b in self.bytes.items()}
        reach = dict.fromkeys(size, 0)
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            t, w, z = vocab[left], vocab[right], vocab[left + right]
            self.rank.setdefault((t, w), r)
            self.made.append(z)
            reach[z] = max(reach[z], reach[w])
            reach[t] = max(reach[t], size[w] + reach[w])
        self.lookahead = max(reach.values(), default=0)
        # the same ranks as sorted arrays, for many pieces at once
        pairs = np.array([(t << 32) | w for t, w in self.rank], np.int64)
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.fromiter(self.rank.values(), np.int32, len(self.rank))[order], FAR)
        self.results = np.array([*self.made, 0], np.int32)
        self.first = np.array(self.single, np.int32)

    def merge(self, data: bytes) -> list[int]:
        """Tokens of one piece."""
        ids, rank = [self.single[b] for b in data], self.rank
        costs = [rank.get(p, FAR) for p in zip(ids, ids[1:])]
        while costs and (best := min(costs)) < FAR:
            i = costs.index(best)
            ids[i:i + 2] = [self.made[best]]
            del costs[i]
            if i:
                costs[i - 1] = rank.get((ids[i - 1], ids[i]), FAR)
            if i < len(costs):
                costs[i] = rank.get((ids[i], ids[i + 1]), FAR)
        return ids

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.ranks[at], FAR)

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many pieces: each round merges the best pair of every piece that still has one."""
        size = np.array([len(p) for p in pieces], np.int64)
        long = np.flatnonzero(size > SHORT)
        apart = {int(i): self.whole(pieces[i]) for i in long}
        body = b"".join(b"" if i in apart else p for i, p in enumerate(pieces)) if apart else b"".join(pieces)
        size[long] = 0
        symbol = self.first[np.frombuffer(body, np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), size)
        done_symbol, done_piece = [], []
        cost = np.full(len(symbol), FAR, np.int32)  # of a symbol with the next one of its piece
        inner = piece[1:] == piece[:-1]
        cost[:-1][inner] = self._pair_ranks(symbol[:-1][inner], symbol[1:][inner])
        while len(symbol):
            head = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            best = np.minimum.reduceat(cost, head)
            width = np.diff(np.append(head, len(symbol)))
            over = np.repeat(best == FAR, width)
            if over.any():
                done_symbol.append(symbol[over])
                done_piece.append(piece[over])
                symbol, piece, cost = symbol[~over], piece[~over], cost[~over]
                width, best = width[best < FAR], best[best < FAR]
                if not len(symbol):
                    break
            hit = np.flatnonzero(cost == np.repeat(best, width))
            hit = hit[np.append(True, piece[hit[1:]] != piece[hit[:-1]])]  # the leftmost of each piece
            symbol[hit] = self.results[cost[hit]]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            symbol, piece, cost = symbol[stay], piece[stay], cost[stay]
            hit -= np.arange(len(hit))
            for i in (hit, hit[(hit > 0)] - 1):
                after = np.minimum(i + 1, len(symbol) - 1)
                inner = (piece[after] == piece[i]) & (after > i)
                cost[i] = np.where(inner, self._pair_ranks(symbol[i], symbol[after]), FAR)
        done_symbol += [np.array(x, np.int32) for x in apart.values()]
        done_piece += [np.full(len(x), i) for i, x in apart.items()]
        piece = np.concatenate(done_piece) if done_piece else np.zeros(0, np.int64)
        order = np.argsort(piece, kind="stable")
        return np.concatenate(done_symbol)[order] if done_symbol else np.zeros(0, np.int32), np.bincount(piece, minlength=len(pieces))

    def stable(self, data: bytes) -> tuple[list[int], int]:
        """Tokens of the start of an unfinished piece that later bytes can't change, and their bytes.

        Works through the piece in strides, so each merge run is short.
        """
        out, pos, stride = [], 0, 4 * self.lookahead + 256
        while len(data) - pos > self.lookahead + 8:
            part = data[pos:pos + stride]
            limit, used, ids = len(part) - self.lookahead, 0, []
            for t in self.merge(part):
                if used + len(self.bytes[t]) > limit:
                    break
                used += len(self.bytes[t])
                ids.append(t)
            if not used:
                break
            out += ids
            pos += used
        return out, pos

    def whole(self, data: bytes) -> list[int]:
        """Tokens of a finished piece of any length."""
        ids, used = self.stable(data) if len(data) > 4 * self.lookahead + 256 else ([], 0)
        return ids + self.merge(data[used:])




class Pieces:
    """Ids of pieces by content hash, remembered up to a bound in flat arrays."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = CACHED):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.begin, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, data: list[bytes], hashes: list[int]) -> None:
        ids, size = self.encode(data)
        n, total = len(self.known), self.used + len(ids)
        while n + len(data) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:total] = ids
        self.begin[n:n + len(data)] = self.used + np.cumsum(size) - size
        self.size[n:n + len(data)] = size
        self.known.update(zip(hashes, range(n, n + len(data))))
        self.used = total

    def ids(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces of ``points`` that start at ``first``, and the number of ids of each."""
        if not len(first):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.known) > self.most:
            self.clear()
        end = np.append(first[1:], len(points))
        code, unique = pd.factorize(span_hashes(points.astype(np.uint64) + np.uint64(1), first, end))
        hashes, known = unique.tolist(), self.known
        unseen = [i for i, h in enumerate(hashes) if h not in known]
        if unseen:
            at = np.zeros(len(unique), np.int64)
            at[code[::-1]] = np.arange(len(code))[::-1]
            text = points.tobytes().decode("utf-32-le")
            spans = zip(first[at[unseen]].tolist(), end[at[unseen]].tolist())
            self._add([text[i:j].encode() for i, j in spans], [hashes[i] for i in unseen])
        where = np.fromiter(map(known.__getitem__, hashes), np.int64, len(hashes))[code]
        n = self.size[where]
        index = np.arange(n.sum()) + np.repeat(self.begin[where] - (np.cumsum(n) - n), n)
        return self.flat[index], n


class Transducer:
    """Encoder of texts that arrive in chunks; remembers a bounded number of short pieces."""

    def __init__(self, path: str, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]] | None = None, most: int = CACHED):
        """``encode`` replaces the own merging of pieces; pieces of any length then go to it whole."""
        self.merges = Merges(path)
        self.pieces = Pieces(encode or self.merges.merge_many, most)
        self.whole_pieces = encode is not None
        self.carry = ""

    # -- many texts at once -------------------------------------------------
    def window(self, texts: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, given as UTF-8 bytes with offsets, and the ids of each text."""
        data = np.frombuffer(texts, np.uint8)
        leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        points = np.frombuffer(texts.decode().encode("utf-32-le"), np.uint32)
        ends = leads[at]
        first = pretoken.starts(points, ends)
        if not len(first):
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        ids, n = self.pieces.ids(points, first)
        total = np.concatenate([[0], np.cumsum(n)])
        per = np.diff(total[np.searchsorted(first, ends, "left")])
        return ids, per

    # -- one text in chunks ---------------------------------------------------
    def _plain(self, text: str, last: bool) -> np.ndarray:
        text = self.carry + text
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        first = pretoken.starts(points, np.array([0, len(points)]))
        keep = len(first) if last else max(0, len(first) - 2)
        cut = len(points) if keep == len(first) else int(first[keep])
        self.carry = text[cut:]
        ids = self.pieces.ids(points[:cut], first[:keep])[0]
        if not last and len(self.carry) > CARRY and not self.whole_pieces:
            ids = np.concatenate([ids, self._long()])
        return ids

    def _long(self) -> np.ndarray:
        """Stable tokens of the first carried piece, which is too long to wait for its end."""
        points = np.frombuffer(self.carry.encode("utf-32-le"), np.uint32)
        first = pretoken.starts(points, np.array([0, len(points)]))
        size = len(points) if len(first) < 2 else int(first[1])
        if size < len(points) and len(points) - size > 2:  # its end is known
            return np.zeros(0, np.int32)
        # the last characters stay, as the rule for blanks and quotes looks at them
        data = self.carry[:size - 4].encode()
        ids, used = self.merges.stable(data)
        while used < len(data) and used and data[used] & 0xC0 == 0x80:  # the carry must start with a whole character
            used -= len(self.merges.bytes[ids.pop()])
        self.carry = data[used:].decode() + self.carry[size - 4:]
        return np.array(ids, np.int32)

    def feed(self, chunk: str) -> np.ndarray:
        """Ids that became final with this chunk."""
        return self._plain(chunk, False)

    def finish(self) -> np.ndarray:
        """The rest of the ids; the transducer is ready for the next text."""
        ids = self._plain("", True)
        self.carry = ""
        return ids

    def stream(self, text: str) -> Iterator[np.ndarray]:
        """Ids of one text in chunks; strings of special tokens become their ids."""
        pos = 0
        while True:
            found = [(i, s) for s in self.merges.special if (i := text.find(s, pos)) >= 0]
            stop, name = min(found, key=lambda x: (x[0], -len(x[1])), default=(len(text), None))
            for i in range(pos, stop, CHUNK):
                yield self.feed(text[i:min(stop, i + CHUNK)])
            yield self.finish()
            if name is None:
                return
            yield np.array([self.merges.special[name]], np.int32)
            pos = stop + len(name)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the number of ids of each row."""
        body, at = raw(column)
        every, sizes = [], []
        for lo, hi in slices(at, CHUNK):
            part = body[at[lo]:at[hi]].tobytes()
            if len(part) > CHUNK or any(s.encode() in part for s in self.merges.special):
                for r in range(lo, hi):
                    got = [x for x in self.stream(body[at[r]:at[r + 1]].tobytes().decode()) if len(x)]
                    every += got
                    sizes.append(np.array([sum(map(len, got))], np.int64))
            else:
                ids, per = self.window(part, at[lo:hi + 1] - at[lo])
                every.append(ids)
                sizes.append(per)
        return (np.concatenate(every) if every else np.zeros(0, np.int32)), (np.concatenate(sizes) if sizes else np.zeros(0, np.int64))


class TextMachine:
    """Bytes of tokens to text, chunk by chunk."""

    def __init__(self, merges: Merges):
        self.bytes = merges.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        token = self.bytes
        return self.state.decode(b"".join([token.get(i, b"") for i in ids.tolist()]))

    def finish(self) -> str:
        rest = self.state.decode(b"", True)
        self.state.reset()
        return rest


_own: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One transducer per worker process and vocabulary."""
    if path not in _own:
        _own[path] = Transducer(path)
    return _own[path]


def decode_rows(machine: TextMachine, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
    out, pos = [], 0
    for n in sizes.tolist():
        parts = [machine.feed(ids[i:min(pos + n, i + CHUNK)]) for i in range(pos, pos + n, CHUNK)]
        out.append("".join([*parts, machine.finish()]))
        pos += n
    return out


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids, pa.int32()))


def encoded(text: Column, path: str) -> Column:
    """Token ids of a text column."""
    @F.arrow_udf("array<int>")
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = transducer(path)
        for column in columns:
            yield _lists(*own.encode(column))
    return encode(text.cast("string"))


def decoded(ids: Column, path: str) -> Column:
    """Text of a column of token ids; null for null, unknown ids are skipped."""
    @F.arrow_udf("string")
    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = transducer(path).merges
        for column in columns:
            sizes = np.diff(column.offsets.to_numpy())
            texts = decode_rows(TextMachine(own), column.flatten().to_numpy(zero_copy_only=False), np.where(np.asarray(column.is_valid()), sizes, 0))
            yield pa.array(texts, pa.string(), mask=np.asarray(column.is_null()))
    return decode(ids.cast("array<int>"))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", back: str = "decoded") -> DataFrame:
    """Adds the token ids of each text and the text decoded from them."""
    @F.arrow_udf("ids array<int>, back string")
    def both(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = transducer(path)
        for column in columns:
            flat, sizes = own.encode(column)
            yield pa.StructArray.from_arrays([_lists(flat, sizes), pa.array(decode_rows(TextMachine(own.merges), flat, sizes), pa.string())], ["ids", "back"])
    got = df.withColumn("__bpe", both(F.col(text).cast("string")))
    return got.withColumn(ids, F.col("__bpe.ids")).withColumn(back, F.col("__bpe.back")).drop("__bpe")
