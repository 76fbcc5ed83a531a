"""Language of a text: averaged hashed subword embeddings and a linear softmax.

Subwords are runs of 2, 3 and 4 bytes of the lower-cased text, with everything
that isn't a letter read as a blank; runs that start with two blanks say
nothing. Each is hashed into a row of an embedding table; a text is the mean
of its rows, and a linear softmax gives the probability of each language. Table
and softmax are trained together by stochastic gradient descent in numpy, on
random pieces of a bounded sample of labelled texts (pieces, so that short
texts are known too; scoring always reads whole texts). As the mean and the
softmax's inner part are both linear, scoring uses the product of the two
tables.

Calibration: on sampled texts kept out of training, a temperature is fitted to
the log loss, and the rejection threshold is the score below which only
``reject`` of the rightly named texts lie (one half at most). A text is accepted if it has a
letter and scores at least the threshold.

A null text, or one without any letter, is ``und`` with score 0. Without any
labelled text everything is ``und``. Equal texts get equal results. Other
columns pass through; a column named like the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.arrow_text import raw, slices
from tallyloom.llm.sampling import bounded_sample

ORDERS = (2, 3, 4)
BUCKET_BITS = 14
UNKNOWN = "und"

LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def subwords(body: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Bucket of the run at each byte, for each order; the last bucket means none."""
    m = LETTERS[body].astype(np.uint32)
    n, none = len(m), 1 << BUCKET_BITS
    padded = np.concatenate([m, np.full(max(ORDERS), 32, np.uint32)])
    quiet = (padded[:n] == 32) & (padded[1:n + 1] == 32)
    ends = at[1:]
    run, out = padded[:n].copy(), []
    for k in range(2, max(ORDERS) + 1):
        run = (run << np.uint32(8)) | padded[k - 1:n + k - 1]
        if k in ORDERS:
            bucket = ((run * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
            bucket[quiet] = none
            for j in range(1, k):  # runs that would reach into the next text
                last = ends - j
                bucket[last[last >= at[:-1]]] = none
            out.append(bucket)
    return out


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class LanguageModel:
    languages: list[str]
    tables: np.ndarray  # (order, language, bucket + 1), the last bucket zero
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def sums(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed rows of each text and the number of its subwords."""
        n = len(at) - 1
        total, count = np.zeros((n, len(self.languages))), np.zeros(n)
        some = np.flatnonzero(np.diff(at))
        if not len(some):
            return total, count
        buckets = subwords(body, at)
        for b in buckets:
            count[some] += np.add.reduceat((b != 1 << BUCKET_BITS).astype(np.int32), at[some])
        for c in range(len(self.languages)):
            value = sum(self.tables[o, c][b] for o, b in enumerate(buckets))
            total[some, c] = np.add.reduceat(value, at[some], dtype=np.float64)
        return total, count

    def logits(self, column: pa.Array, window: int = 1 << 19) -> np.ndarray:
        """A text longer than the window is summed piece by piece."""
        body, at = raw(column)
        out = []
        for lo, hi in slices(at, window):
            base, end = int(at[lo]), int(at[hi])
            total, count = np.zeros((hi - lo, len(self.languages))), np.zeros(hi - lo)
            if hi - lo > 1 or end - base <= window:
                total, count = self.sums(body[base:end], at[lo:hi + 1] - base)
            else:
                for p in range(base, end, window):
                    part = body[p:min(end, p + window + max(ORDERS) - 1)]
                    t, c = self.sums(part, np.array([0, len(part)]))
                    over = len(part) - window
                    if over > 0 and p + window < end:  # runs that start in the next piece count there
                        t2, c2 = self.sums(part[window:], np.array([0, over]))
                        t, c = t - t2, c - c2
                    total += t
                    count += c
            out.append(total / np.maximum(count, 1)[:, None])
        return (np.concatenate(out) if out else np.zeros((0, len(self.languages)))) + self.bias

    def probabilities(self, column: pa.Array) -> np.ndarray:
        z = self.logits(column) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _pieces(texts: list[bytes], labels: np.ndarray, per_text: int, rng: np.random.Generator) -> tuple[list[bytes], np.ndarray]:
    """Random pieces of 8 to 512 bytes."""
    out, own = [], []
    for t, y in zip(texts, labels.tolist()):
        for _ in range(per_text):
            n = min(len(t), int(np.exp(rng.uniform(np.log(8), np.log(512)))))
            i = int(rng.integers(0, len(t) - n + 1))
            out.append(t[i:i + n])
            own.append(y)
    return out, np.array(own)


def fit(texts: list[str], langs: list[str], dim: int = 16, epochs: int = 4, batch: int = 256, rate: float = 4.0, seed: int = 7,
        reject: float = 0.0005) -> LanguageModel:
    """Train on texts with known languages. One text in five only calibrates."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    size = 1 << BUCKET_BITS
    if not names:
        return LanguageModel([], np.zeros((len(ORDERS), 0, size + 1), np.float32), np.zeros(0))
    order = rng.permutation(len(texts))
    held, used = order[::5], np.setdiff1d(order, order[::5])
    if len(used) == 0:
        used = order
    table = rng.uniform(-1, 1, (len(ORDERS) * (size + 1), dim)).astype(np.float32) / dim
    weights, bias = np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    share = np.bincount(y[used], minlength=len(names)) / len(used)
    cost = 1 / np.maximum(share[y], 1e-9) / len(names)  # languages count alike
    coded = [texts[i].encode() for i in used]
    steps = 0
    pieces, labels = _pieces(coded, y[used], max(1, 16000 // len(used)), rng)
    costs = np.array([1 / share[c] / len(names) for c in labels])
    planned = epochs * -(-len(pieces) // batch)
    for _ in range(epochs):
        mixed = rng.permutation(len(pieces))
        for lo in range(0, len(mixed), batch):
            some = mixed[lo:lo + batch]
            at = np.cumsum([0, *(len(pieces[i]) for i in some)])
            grams = subwords(np.frombuffer(b"".join(pieces[i] for i in some), np.uint8), at)
            row = np.repeat(np.arange(len(some)), np.diff(at))
            index = np.concatenate([g + o * (size + 1) for o, g in enumerate(grams)])
            owner, real = np.tile(row, len(ORDERS)), np.concatenate([g != size for g in grams])
            index, owner = index[real], owner[real]
            count = np.maximum(np.bincount(owner, minlength=len(some)), 1)
            mean = np.stack([np.bincount(owner, table[index, d], minlength=len(some)) for d in range(dim)], 1) / count[:, None]
            z = mean @ weights + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            p *= (costs[some] / len(some))[:, None]
            step = rate * (1 - steps / planned)
            inner = (p @ weights.T) / count[:, None]
            weights -= step * (mean.T @ p)
            bias -= step * p.sum(0)
            distinct, code = np.unique(index, return_inverse=True)
            # a row occurs in few texts of a batch, so its step is taken per text, not per batch
            for d in range(dim):
                table[distinct, d] -= step * len(some) * np.bincount(code, inner[owner, d], minlength=len(distinct)).astype(np.float32)
            steps += 1
    product = (table @ weights).reshape(len(ORDERS), size + 1, len(names)).transpose(0, 2, 1).copy()
    product[:, :, size] = 0
    model = LanguageModel(names, np.ascontiguousarray(product, np.float32), bias.astype(float))
    return calibrated(model, [texts[i] for i in held], y[held], cost[held], reject)


def calibrated(model: LanguageModel, texts: list[str], y: np.ndarray, cost: np.ndarray, reject: float) -> LanguageModel:
    if not len(y):
        return model
    z = model.logits(pa.array(texts, pa.string()))
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.1), np.log(10), 60)):
        s = z / t
        s = s - s.max(1, keepdims=True)
        loss = float(((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]) * cost).mean())
        best = min(best, (loss, float(t)))
    model.temperature = best[1]
    p = model.probabilities(pa.array(texts, pa.string()))
    right = p[np.arange(len(y)), y][p.argmax(1) == y]
    model.threshold = float(min(0.5, np.quantile(right, reject))) if len(right) else 0.0
    return model


def train(rows: DataFrame, lang: str = "lang", text: str = "text", rows_each: int = 1200, longest: int = 20_000) -> LanguageModel:
    """Fit on at most 2 * ``rows_each`` texts of each language, of at most ``longest`` characters, chosen by a hash of the text."""
    known = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang is not null and text is not null")
    some = bounded_sample(known.filter(F.length("text").between(1, longest)), "text", rows_each, "lang").collect()
    some = sorted((r.lang, r.text) for r in some if has_letter(r.text))
    return fit([t for _, t in some], [x for x, _ in some])


def identified(text: Column, model: LanguageModel) -> Column:
    """Struct of language, score and whether it is accepted."""
    @F.arrow_udf("lang string, score double, accepted boolean")
    def identify(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            n = len(column)
            if not model.languages:
                yield pa.StructArray.from_arrays([pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n, bool))], ["lang", "score", "accepted"])
                continue
            body, at = raw(column)
            ascii_letters = np.concatenate([[0], np.cumsum((LETTERS[body[at[0]:at[-1]]] != 32) & (body[at[0]:at[-1]] < 128))])
            clear = np.diff(ascii_letters[at - at[0]]) > 0
            for i in np.flatnonzero(~clear).tolist():
                clear[i] = has_letter(body[at[i]:at[i + 1]].tobytes().decode())
            p = model.probabilities(column)
            best = p.argmax(1)
            score = np.where(clear, p[np.arange(n), best], 0.0)
            names = np.where(clear, np.array(model.languages, object)[best], UNKNOWN)
            yield pa.StructArray.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(clear & (score >= model.threshold))], ["lang", "score", "accepted"])
    return identify(text.cast("string"))


def with_language(df: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang_pred", score: str = "score", accepted: str = "accepted") -> DataFrame:
    got = df.withColumn("__lang", identified(F.col(text), model))
    return got.withColumns({lang: F.col("__lang.lang"), score: F.col("__lang.score"), accepted: F.col("__lang.accepted")}).drop("__lang")
