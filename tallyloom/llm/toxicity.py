"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult and threat (with weights), target, negation,
reported speech, clause end, filler. Small machines read the symbols of a clause:

* *negation*: a negation holds for the next three words;
* *report*: a verb of saying holds to the end of the clause;
* *target* (from the left and from the right): a person is addressed or meant in the clause.

Their product is one machine; at each insult or threat its state is the reading
of that match, such as "insult, not negated, not reported, targeted". A text's
score is a logistic function of its matches per reading, so a matched clause
counts by how it is said. Runs of filler words longer than the memory of the
machines are skipped in one step, and clauses without a match are not read.

The insult lexicon is a weighted acceptor over words and word beginnings,
learned on a bounded sample of labelled texts. What counts is the number of
distinct surroundings (word before, word behind) in toxic and in clean texts:
copies of one text add nothing, and a word that goes with toxic texts only
because it occurs in a copied one isn't learned. A word is taken if a likelihood-ratio test
is far beyond chance; a beginning, if three or more such words share it and it
passes as well. The weight is the log ratio of the two rates. General insults
and threats are known from the start, with a fixed weight where nothing better
was learned. The logistic weights of the readings are fitted on the same
sample, weighted so that the classes keep their shares, and drawn towards
fixed values for readings that the sample doesn't have.

A null or empty text has no matches and gets the score of clean texts, a
number as any other. Without labels of both classes only the general lexicon
speaks, with fixed weights. Equal texts get equal scores, repeated rows each one. Texts of any length are read whole. An empty
table gives no rows. Other columns pass through; the result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.arrow_text import BYTE_VALUE, WINDOW, mix, powers, raw, slices, word_spans
from tallyloom.llm.sampling import bounded_sample

BEGINNINGS = (4, 5, 6, 7, 8, 9, 10)
GENERAL_WEIGHT = 3.0
FILLER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
MEMORY = 3  # words that a negation reaches

GENERAL = {
    INSULT: "idiot moron stupid imbecile scum worthless pathetic loser trash disgusting clown dumb coward vermin",
    THREAT: "kill hurt destroy murder strangle stab shoot beat töte töten tuer matar",
    TARGET: "you your yours yourself he she they them him her his their du dich dir sie ihr tu te toi vous ton votre tú te ti usted ustedes",
    NEGATION: "not never no nobody nicht kein keine nie ne pas jamais nunca jamás isn't aren't don't",
    REPORT: "said says saying wrote writes quoted quoting called reported claims sagte schrieb dit écrit dijo escribió",
}

APART = np.ones(256, bool)
APART[[*range(65, 91), *range(97, 123), *range(128, 256), 39]] = False
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?;:\n\r|"]] = True


@dataclass(frozen=True)
class Machine:
    """Deterministic machine: states 0..n-1, the state after a symbol, a mark shown at matches."""

    states: int
    step: dict[tuple[int, int], int]
    mark: tuple[int, ...]

    def next(self, state: int, symbol: int) -> int:
        return self.step.get((state, symbol), self.step.get((-1, symbol), state))


def negation() -> Machine:
    step = {(-1, NEGATION): MEMORY, (-1, END): 0}
    for s in range(MEMORY + 1):
        for symbol in (FILLER, INSULT, THREAT, TARGET, REPORT):
            step[s, symbol] = max(0, s - 1)
    return Machine(MEMORY + 1, step, (0, *[1] * MEMORY))


def latch(symbol: int) -> Machine:
    """On after ``symbol``, until the clause ends."""
    return Machine(2, {(-1, symbol): 1, (-1, END): 0}, (0, 1))


def composed(*machines: Machine) -> tuple[np.ndarray, np.ndarray]:
    """Product of machines: table of (state, symbol) -> state, and marks of each state as bits."""
    index = {s: i for i, s in enumerate(product(*(range(m.states) for m in machines)))}
    table = np.zeros((len(index), END + 1), np.int64)
    for states, i in index.items():
        for symbol in range(END + 1):
            table[i, symbol] = index[tuple(m.next(s, symbol) for m, s in zip(machines, states))]
    marks = np.array([sum(m.mark[s] << k for k, (m, s) in enumerate(zip(machines, states))) for states in index])
    return table, marks


FORWARD = composed(negation(), latch(REPORT), latch(TARGET))
BACKWARD = composed(latch(TARGET))
READINGS = 16  # kind x negated x reported x targeted


def readings(symbols: np.ndarray, gaps: np.ndarray) -> list[int]:
    """Reading of each match in one clause; ``gaps``: filler words before each symbol."""
    (ahead, marks), (back, back_marks) = FORWARD, BACKWARD
    before, state = [], 0
    for symbol, gap in zip(symbols.tolist(), gaps.tolist()):
        for _ in range(min(gap, MEMORY)):
            state = ahead[state, FILLER]
        before.append(marks[state])
        state = ahead[state, symbol]
    after, state = [], 0
    for symbol in symbols[::-1].tolist():
        after.append(back_marks[state])
        state = back[state, symbol]
    return [(symbol == THREAT) * 8 + ((m & 3) | ((m >> 2 | a) & 1) << 2) for symbol, m, a in zip(symbols.tolist(), before, after[::-1]) if symbol in (INSULT, THREAT)]


def _hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(_hashes(data, np.array([0]), np.array([len(data)]))[0])


def _hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, width: int = 0) -> np.ndarray:
    """Hash of each span, or of its first ``width`` bytes; the width keeps beginnings apart from words."""
    with np.errstate(over="ignore"):
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
        stop = s + width if width else e
        return mix((sums[stop] - sums[s]) * down[s] + np.uint64(width * 2 + 1))


class Words:
    """Words of a slice of texts, with hashes of words and beginnings."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        self.s, self.e = word_spans(data, at, APART)
        self.row = np.searchsorted(at, self.s, "right") - 1

    def hashes(self) -> np.ndarray:
        return _hashes(self.data, self.s, self.e)

    def surroundings(self, own: np.ndarray) -> np.ndarray:
        """Hash of the words before and behind each word in its text."""
        same = self.row[1:] == self.row[:-1]
        before, behind = np.zeros(len(own), np.uint64), np.zeros(len(own), np.uint64)
        before[1:][same], behind[:-1][same] = own[:-1][same], own[1:][same]
        return mix(before * np.uint64(0x9E3779B97F4A7C15) + behind)

    def beginnings(self, widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(width, words, hashes of their beginnings) of the words that are longer."""
        size = self.e - self.s
        for w in widths:
            some = np.flatnonzero(size > w)
            yield w, some, _hashes(self.data, self.s[some], self.e[some], w)


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Lower-cased bytes of runs of whole rows."""
    body, at = raw(pc.utf8_lower(column.cast(pa.large_string())))
    for lo, hi in slices(at, WINDOW // 2):
        yield lo, hi, body[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]


class Lexicon:
    """Symbols and weights by hash of a word or beginning."""

    def __init__(self, entries: dict[int, tuple[int, float]], widths: list[int]):
        self.keys = np.array(sorted(entries), np.uint64)
        self.symbols = np.array([entries[k][0] for k in self.keys.tolist()], np.int8)
        self.weights = np.array([entries[k][1] for k in self.keys.tolist()])
        self.widths = widths
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.keys >> np.uint64(46)] = True

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that are entries, and the entries."""
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(46)])
        place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        real = self.keys[place] == hashes[at]
        return at[real], place[real]

    def read(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and weight of each word; a whole word goes before a beginning, a long beginning before a short one."""
        entry = np.full(len(words.s), -1, np.int64)
        for w, some, hashes in words.beginnings(self.widths):
            where, found = self.look(hashes)
            entry[some[where]] = found
        where, found = self.look(words.hashes())
        entry[where] = found
        return np.where(entry >= 0, self.symbols[entry], FILLER), np.where(entry >= 0, self.weights[entry], 0.0)


def general_lexicon() -> dict[int, tuple[int, float]]:
    return {_hash(w): (kind, GENERAL_WEIGHT) for kind in reversed(GENERAL) for w in GENERAL[kind].split()}


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def features(self, column: pa.Array) -> np.ndarray:
        """Of each text: the weight of its matches by reading, as logarithm, and the logarithm of its length in words."""
        total, length = np.zeros((len(column), READINGS)), np.zeros(len(column))
        for lo, hi, data, at in text_slices(column):
            words = Words(data, at)
            if not len(words.s):
                continue
            length[lo:hi] += np.bincount(words.row, minlength=hi - lo)
            symbol, weight = self.lexicon.read(words)
            match = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
            if not len(match):
                continue
            stops = np.flatnonzero(ENDS[data])
            clause = np.searchsorted(stops, words.s)  # a word's number of clause ends before it
            # a new row is a new clause
            group = np.cumsum(np.append(True, (clause[1:] != clause[:-1]) | (words.row[1:] != words.row[:-1])))
            for g in np.unique(group[match]).tolist():
                i, j = np.searchsorted(group, [g, g + 1])
                tell = np.flatnonzero(symbol[i:j]) + i
                gaps = np.diff(np.append(i - 1, tell)) - 1
                hits = tell[(symbol[tell] == INSULT) | (symbol[tell] == THREAT)]
                np.add.at(total[lo + words.row[i]], readings(symbol[tell], gaps), weight[hits])
        return np.hstack([np.log1p(total), np.log1p(length)[:, None]])

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(column) @ self.weights + self.bias, -50, 50)))


def surprise(t: np.ndarray, c: np.ndarray, share: float) -> np.ndarray:
    """Likelihood-ratio statistic of ``t`` toxic among t + c surroundings, where ``share`` are toxic; 0 if they are not too many."""
    n = t + c
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (t * np.log(t / (n * share)) + np.where(c > 0, c * np.log(c / (n * (1 - share))), 0))
    return np.where(t > n * share, g, 0.0)


def learned_lexicon(column: pa.Array, toxic: np.ndarray, beyond: float) -> tuple[dict[int, tuple[int, float]], list[int]]:
    own, around, bad, where = [], [], [], []
    parts = []
    for lo, _, data, at in text_slices(column):
        words = Words(data, at)
        if len(words.s):
            h = words.hashes()
            own.append(h)
            around.append(words.surroundings(h))
            bad.append(toxic[words.row + lo] == 1)
            where.append(np.stack([np.full(len(h), len(parts), np.int32), np.arange(len(h), dtype=np.int32)], 1))
            parts.append(words)
    if not own:
        return {}, []
    own, around, bad, where = (np.concatenate(x) for x in (own, around, bad, where))
    _, once = np.unique(mix(own * np.uint64(2) + bad) ^ around, return_index=True)  # each surrounding once in a class
    own, bad, where = own[once], bad[once], where[once]
    del around, once
    share = bad.mean()
    word, sample, code = np.unique(own, return_index=True, return_inverse=True)
    t = np.bincount(code, bad, minlength=len(word))
    c = np.bincount(code, minlength=len(word)) - t
    ratio = lambda t, c: np.log((t + 0.5) / share) - np.log((c + 0.5) / (1 - share))
    strong = np.flatnonzero((surprise(t, c, share) >= beyond) & (ratio(t, c) >= np.log(4)))
    entries = {int(word[i]): (INSULT, float(ratio(t[i], c[i]))) for i in strong}

    # beginnings that several strong words share
    seen: dict[tuple[int, bytes], int] = {}
    for i in strong.tolist():
        p, k = where[sample[i]].tolist()
        spelled = parts[p].data[parts[p].s[k]:parts[p].e[k]].tobytes()
        for w in BEGINNINGS:
            if len(spelled) > w:
                seen[w, spelled[:w]] = seen.get((w, spelled[:w]), 0) + 1
    widths = sorted({w for (w, _), n in seen.items() if n >= 3})
    wanted = {w: np.array(sorted(int(_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([w]), w)[0]) for (v, b), n in seen.items() if v == w and n >= 3), np.uint64) for w in widths}
    many = {w: np.zeros((len(x), 2)) for w, x in wanted.items()}
    # the beginning of a word follows from the word, so each distinct word is looked at once
    for p, words in enumerate(parts):
        mine = where[sample][:, 0] == p
        k, ids = where[sample][mine, 1], np.flatnonzero(mine)
        size = words.e - words.s
        for w in widths:
            long = size[k] > w
            h = _hashes(words.data, words.s[k[long]], words.e[k[long]], w)
            at = np.minimum(np.searchsorted(wanted[w], h), len(wanted[w]) - 1)
            real = wanted[w][at] == h
            np.add.at(many[w], at[real], np.stack([t, c], 1)[ids[long][real]])
    used = set()
    for w in widths:
        for h, (tt, cc) in zip(wanted[w].tolist(), many[w].tolist()):
            if surprise(np.array(tt), np.array(cc), share) >= beyond and ratio(tt, cc) >= np.log(4):
                entries[h] = (INSULT, float(ratio(tt, cc)))
                used.add(w)
    return entries, sorted(used)


def _logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray, prior: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, drawn towards ``prior`` where the sample says little."""
    x = np.hstack([x, np.ones((len(x), 1))])
    aim, keep = np.append(prior, 0.0), np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    loss = lambda w: float((cost * np.logaddexp(0, -(2 * y - 1) * (x @ w))).sum() + 0.5 * (keep * (w - aim) ** 2).sum())
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (cost * (p - y)) + keep * (w - aim)
        hessian = (x * (cost * p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hessian, gradient)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w - step
    return w[:-1], float(w[-1])


def untrained() -> ToxicityModel:
    weights = np.array([(3.0 - 2 * (i & 1) - 1.5 * (i >> 1 & 1) + (i >> 2 & 1)) for i in range(READINGS)] + [0.0])
    return ToxicityModel(Lexicon(general_lexicon(), []), weights, -4.0)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", toxic_rows: int = 1500, clean_rows: int = 3000,
          longest: int = 10_000, beyond: float = 20.0) -> ToxicityModel:
    """Fit on at most twice ``toxic_rows`` and ``clean_rows`` labelled texts, of at most ``longest`` characters, chosen by a hash of the id."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("__id")).agg(F.max(label).alias("__toxic"))
    shares = {r[0]: r[1] for r in known.groupBy("__toxic").agg(F.count("*")).collect()}
    some = F.broadcast(bounded_sample(known, "__id", {0: clean_rows, 1: toxic_rows}, "__toxic"))  # bounded by the two numbers
    base = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text")).filter(F.length("__text") <= longest)
    rows = sorted((r[0], r[1], r[2]) for r in base.join(some, "__id").select("__id", "__toxic", "__text").limit(2 * (toxic_rows + clean_rows)).collect())
    y = np.array([r[1] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return untrained()
    column = pa.array([r[2] for r in rows], pa.string())
    learned, widths = learned_lexicon(column, y, beyond)
    model = ToxicityModel(Lexicon(general_lexicon() | learned, widths), np.zeros(READINGS + 1), 0.0)
    cost = np.where(y == 1, shares.get(1, 1) / y.sum(), shares.get(0, 1) / (len(y) - y.sum()))
    cost *= len(y) / cost.sum()
    model.weights, model.bias = _logistic(model.features(column), y, cost, untrained().weights)
    return model


def scored(text: Column, model: ToxicityModel) -> Column:
    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(model.scores(column))
    return score(text.cast("string"))


def with_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score", predicted: str = "predicted", threshold: float = 0.7) -> DataFrame:
    got = df.withColumn(score, scored(F.col(text), model))
    return got.withColumn(predicted, (F.col(score) >= threshold).cast("int"))
