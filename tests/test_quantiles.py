"""Exact quantiles by refinement against numpy and percentile."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.05, 0.25, 0.5, 0.8, 0.95, 1.0]


def test_small_groups_equal_numpy(spark):
    """Refined down to single rows: many rounds, ties, one value, extreme ranges, null keys and null values."""
    rng = random.Random(9)
    kinds = {"ties": lambda: float(rng.choice([1, 1, 1, 2, 7])), "one": lambda: 3.5, "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.choice([-9, 0, 5, 307]), None: rng.random, "ints": lambda: float(rng.randint(0, 90))}
    data = {k: [f() for _ in range(rng.choice([1, 2, 311, 400]))] for k, f in kinds.items()}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("ties", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.n, r.q) for r in exact_quantiles(df, "v", PROBS, ["g"], few=3, bins=16).collect()}
    assert got.keys() == data.keys()
    for k, vs in data.items():
        assert got[k][0] == len(vs) and got[k][1] == pytest.approx(np.quantile(vs, PROBS).tolist(), rel=1e-12)


def test_hot_group_with_ties(spark):
    """A million values, nine tenths of them equal: the same numbers as percentile."""
    df = spark.range(1_000_000).select(F.when(F.col("id") % 10 > 0, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / 1000.0).alias("v"))
    ps = [0.01, 0.02, 0.03, 0.5, 0.93, 0.999]
    want = df.agg(F.percentile("v", ps).alias("q")).first().q
    row = exact_quantiles(df, "v", ps).first()
    assert row.n == 1_000_000 and row.q == want
    assert exact_quantiles(df.limit(0), "v", ps).count() == 0
