"""Mixing: targets, highest quotients, blocks and reruns."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mixing
from tallyloom.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import LONG, SF
from tests.oracle import compare, connect


def plain_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    goal, full, left = {}, set(), Fraction(3, 2) * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        rest = left - sum(2 * sizes[s] for s in full)
        goal = {s: Fraction(2 * sizes[s]) if s in full else rest * w[s] / sum(w[x] for x in open_) for s in order}
        over = {s for s in open_ if goal[s] > 2 * sizes[s]}
        if not over:
            return goal
        full |= over


@pytest.mark.parametrize("seed", (1, 3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 3, 40, 500, 9000]) for i in range(rng.randint(1, 12))} | {None: 70, "é": 80, "Z": 90}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), 1.5, 2).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(float(want[s])) for s in want)


def plain_quotas(votes, most, seats):
    offers = sorted(((-Fraction(v) / (2 * k + 1), i) for i, v in enumerate(votes) if v > 0 for k in range(most[i])))[:seats]
    return [sum(1 for _, i in offers if i == j) for j in range(len(votes))]


def test_highest_quotients(spark):
    """Equal to ranking every quotient, with ties, empty rows and one row that holds most votes."""
    rng = random.Random(8)
    rows, want = [], {}
    for part in (*"abcdefghijklmno", None):
        votes = [rng.choice([0, 1, 1, 5, 30, 100]) for _ in range(rng.randint(1, 30))] + [rng.choice([7, 2000])]
        seats = rng.randint(0, sum(votes))
        most = [2 * v + 5 for v in votes]
        rows += [(part, i, v, m, seats) for i, (v, m) in enumerate(zip(votes, most))]
        want |= {(part, i): q for i, q in enumerate(plain_quotas(votes, most, seats))}
    got = mixing.apportion(spark.createDataFrame(rows, "part string, i int, votes long, most long, seats long"), "votes", "most", "seats", [F.col("i")], ["part"])
    assert {(r.part, r.i): r.quota for r in got.collect()} == want


def test_mix(spark):
    """Targets are met within two blocks, no document is over its bound, and reruns agree."""
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([0, 1, 9, 200, 900]), "hot" if i % 3 else rng.choice(["a", "b", None])) for i in range(1500)] + [(5000, "x " * 200_000, "long"), (None, "null id", "a"), (7, "again", "hot"), (7, "again", "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs)
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    assert got != sorted(map(tuple, mixing.mix(docs, seed=13).collect()), key=str)
    assert len(got) == len(rows) and all(0 <= taken <= 2 * size for _, size, _, _, taken in got)
    taken = {}
    for _, size, whole, target, n in got:
        key = (whole, target)
        taken[key] = taken.get(key, 0) + n
    assert len(taken) == 5 and all(abs(n - target) <= 2 * mixing.BLOCK for (_, target), n in taken.items())
    assert sum(t for _, t in taken) == pytest.approx(1.5 * sum(w for w, _ in taken))


def test_odd_rows(spark, odd, empty):
    docs = odd.withColumn("source", F.lit(None).cast("string")).withColumn("size", F.lit("x")).withColumn("target", F.lit("y"))
    got = mixing.mix(docs).collect()
    words = len(LONG.split())
    assert sorted(r.size for r in got) == sorted([4, 4, 0, 0, 4, words, 1, 0]) and {r.source_size for r in got} == {words + 13}
    assert abs(sum(r.taken for r in got) - 1.5 * (words + 13)) <= 2 * mixing.BLOCK
    assert mixing.mix(empty).count() == 0
    assert {(r.size, r.target, r.taken) for r in mixing.mix(docs.filter("doc_id in (2, 3)")).collect()} == {(0, 0.0, 0)}


def test_query_equals_its_sql(spark):
    ok, n, *_, detail = compare("op12", QUERIES["op12_mixing"](spark, SF), connect(SF), ORACLES["op12_mixing"])
    assert ok and n == 200, detail
