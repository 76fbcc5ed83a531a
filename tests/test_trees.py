"""Forests grown level by level against trees grown one node at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import trees as G
from tallyloom.operators.backtest import FoldPlan

SHAPE = G.Shape(trees=1, depth=3, bins=8, leaf=2.0, drawn=False)


def plain_tree(x, y, depth, leaf):
    """(feature, bin, left, right) or the mean; the first best split wins."""
    best = None
    for f in range(x.shape[1]):
        for b in range(7):
            left = x[:, f] <= b
            if left.sum() >= leaf and (~left).sum() >= leaf:
                gain = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = gain, f, b, left
    if depth == 0 or best is None:
        return y.mean()
    _, f, b, left = best
    return f, b, plain_tree(x[left], y[left], depth - 1, leaf), plain_tree(x[~left], y[~left], depth - 1, leaf)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_equals_plain_trees(spark):
    """Two folds with nested training rows, all on one pass a level."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 8, (300, 4)).astype(np.uint8)
    y = x[:, 1] * 3.0 + (x[:, 3] > 4) * 7 + rng.integers(0, 5, 300)
    lo = rng.integers(0, 2, 300)
    rows = spark.createDataFrame([(bytes(r), float(v), i, int(f), 1) for i, (r, v, f) in enumerate(zip(x, y, lo))], "x binary, y double, drawn long, lo int, hi int").repartition(5)
    forest = G.grow(rows, 2, 4, SHAPE)
    asked = spark.createDataFrame([(bytes(r), f, i) for i, r in enumerate(x[:80]) for f in (0, 1)], "x binary, fold int, i int")
    got = {(r.i, r.fold): r.prediction for r in G.predicted(asked, forest, SHAPE, ["i", "fold"], 4).collect()}
    for fold in (0, 1):
        mine = lo <= fold
        tree = plain_tree(x[mine], y[mine], SHAPE.depth, SHAPE.leaf)
        assert all(got[i, fold] == pytest.approx(plain_value(tree, x[i])) for i in range(80))


def test_pooled_folds(spark):
    """No day after an origin is learned from, small pools fall back, and partitioning doesn't matter."""
    plan = FoldPlan(horizon=5, min_train=20, max_folds=3, min_folds=1)
    rng = random.Random(3)
    rows = [(k, i, float(rng.choice([0, 2, 5])), 60) for k in "abc" for i in range(60)]
    from pyspark.sql import Window

    w = Window.partitionBy("sku").orderBy("pos")
    df = spark.createDataFrame(rows, "sku string, pos int, qty double, n int").withColumn("mean_30", F.avg("qty").over(w.rowsBetween(-30, -1))).withColumn("lag_1", F.lag("qty").over(w)).withColumn("target", F.sum("qty").over(w.rowsBetween(0, 4)))
    shape = G.Shape(trees=3, depth=2, bins=8)
    run = lambda d, least=10: {(r.sku, r.fold): round(r.total, 9) for r in G.pooled_trees(d, "sku", ["mean_30", "lag_1"], plan, shape, 5, least).collect()}
    got = run(df)
    assert len(got) == 9 and got == run(df.repartition(7))
    # blank what lies behind the first origin: its forecasts stay, a later one changes
    blank = df.withColumn("target", F.when(F.col("pos") + 5 <= 45, F.col("target")).otherwise(99.0))
    after = run(blank)
    assert {k: v for k, v in got.items() if k[1] == 0} == {k: v for k, v in after.items() if k[1] == 0} and got != after
    plain = {(r.sku, f): r.mean_30 * 5 for f in range(3) for r in df.filter(F.col("pos") == 60 - 5 * (3 - f)).collect()}
    assert run(df, 10_000) == {k: pytest.approx(v) for k, v in plain.items()}
