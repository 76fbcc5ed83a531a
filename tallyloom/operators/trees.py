"""Regression forests of many folds, grown together level by level.

Features are cut into bins once, at edges from days that every fold may see. Then a level of all trees of all folds is one
aggregation: each task sums weights and targets by (fold, tree, node, feature, bin), the sums of a node meet in one
place and give its best split. What goes to the driver and back is the forest, whose size is folds x trees x nodes and doesn't
depend on the data. Trees see rows with Poisson weights drawn by a hash, so a refit gives the same forest on any partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numbers import POISSON, mixed as _mixed
from tallyloom.operators import backtest as B
from tallyloom.operators.scale import cut_lineage


@dataclass(frozen=True)
class Shape:
    trees: int = 10
    depth: int = 5
    bins: int = 32
    leaf: float = 3.0  # least weight of a leaf
    share: float = 1.0  # of the features that a node may split on
    drawn: bool = True  # weights drawn by tree; else every row counts once


class Forest:
    """Splits and leaf values of every fold and tree; node i has the children 2 i + 1 and 2 i + 2."""

    def __init__(self, folds: int, shape: Shape):
        size = (folds, shape.trees, 2 ** (shape.depth + 1) - 1)
        self.feature, self.bin = np.full(size, -1, np.int16), np.zeros(size, np.int16)
        self.value = np.zeros(size)

    def node(self, fold: int, tree: int, x: np.ndarray, levels: int) -> np.ndarray:
        """Where rows of bins stand after so many levels; rows in a leaf stay there."""
        at, feature, cut = np.zeros(len(x), np.int64), self.feature[fold, tree], self.bin[fold, tree]
        for _ in range(levels):
            f = feature[at]
            down = 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[at])
            at = np.where(f >= 0, down, at)
        return at


def _histograms(forest: Forest, shape: Shape, level: int, features: int):
    width = features * shape.bins
    first = 2**level - 1

    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.frombuffer(b"".join(pdf["x"]), np.uint8).reshape(-1, features)
            y, drawn, lo, hi = (pdf[c].to_numpy() for c in ("y", "drawn", "lo", "hi"))
            cell = x + np.arange(features) * shape.bins
            for fold in range(int(lo.min()), int(hi.max()) + 1):
                mine = np.flatnonzero((lo <= fold) & (fold <= hi))
                for tree in range(shape.trees):
                    at, weight = mine, np.ones(len(mine))
                    if shape.drawn:
                        u = (_mixed(drawn[mine], 1 + fold * shape.trees + tree) >> np.uint64(11)) / float(1 << 53)
                        weight = np.searchsorted(POISSON, u, "right").astype(float)
                        at, weight = mine[weight > 0], weight[weight > 0]
                    node = forest.node(fold, tree, x[at], level) - first
                    on = node >= 0
                    at, node, weight = at[on], node[on], weight[on]
                    index = (node[:, None] * width + cell[at]).ravel()
                    sums = held.setdefault((fold, tree), np.zeros((2, 2**level * width)))
                    sums[0] += np.bincount(index, np.repeat(weight, features), 2**level * width)
                    sums[1] += np.bincount(index, np.repeat(weight * y[at], features), 2**level * width)
        rows = [(f, t, k, s[:, k * width:(k + 1) * width].tobytes()) for (f, t), s in held.items() for k in range(2**level) if s[0, k * width:(k + 1) * width].any()]
        yield pd.DataFrame(rows, columns=["fold", "tree", "node", "sums"])

    return run


def _best(sums: np.ndarray, shape: Shape, seed: int) -> tuple[int, int, float, float, float]:
    """Feature (or -1), bin, and the means of the node and its two sides."""
    w, wy = sums[0], sums[1]
    total, whole = w[0].sum(), wy[0].sum()
    left_w, left = np.cumsum(w, 1)[:, :-1], np.cumsum(wy, 1)[:, :-1]
    right_w, right = total - left_w, whole - left
    able = (left_w >= shape.leaf) & (right_w >= shape.leaf)
    if shape.share < 1:
        order = np.argsort(_mixed(np.arange(len(w)), seed), kind="stable")
        able[order[max(1, round(shape.share * len(w))):]] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(able, left**2 / left_w + right**2 / right_w - whole**2 / total, -np.inf)
    f, b = np.unravel_index(np.argmax(gain), gain.shape) if gain.size else (0, 0)
    if not gain.size or not gain[f, b] > 1e-9 * (1 + whole**2 / total):
        return -1, 0, whole / total, 0.0, 0.0
    return int(f), int(b), whole / total, left[f, b] / left_w[f, b], right[f, b] / right_w[f, b]


def _seed(fold: int, tree: int, node: int, level: int) -> int:
    return ((fold * 1009 + tree) * 1009 + level) * 65537 + node + 1


def _splits(shape: Shape, level: int, features: int):
    """Adds up the sums of each node, which come in order, and finds its split."""

    def run(batches):
        now, held = None, None
        for pdf in batches:
            out = []
            for fold, tree, node, raw in zip(pdf["fold"].tolist(), pdf["tree"].tolist(), pdf["node"].tolist(), pdf["sums"]):
                part = np.frombuffer(raw).reshape(2, features, shape.bins)
                if (fold, tree, node) == now:
                    held += part
                    continue
                if now is not None:
                    out.append((*now, *_best(held, shape, _seed(*now, level))))
                now, held = (fold, tree, node), part.copy()
            yield pd.DataFrame(out, columns=SPLIT)
        if now is not None:
            yield pd.DataFrame([(*now, *_best(held, shape, _seed(*now, level)))], columns=SPLIT)

    return run


SPLIT = ["fold", "tree", "node", "feature", "bin", "mean", "left", "right"]


def grow(rows: DataFrame, folds: int, features: int, shape: Shape) -> Forest:
    """A forest for each fold from rows of x (bins), y, drawn (a number of the row), lo and hi (folds it trains).

    ``rows`` is read once a level.
    """
    forest = Forest(folds, shape)
    for level in range(shape.depth):
        parts = rows.mapInPandas(_histograms(forest, shape, level, features), "fold int, tree int, node int, sums binary")
        keys = ["fold", "tree", "node"]
        found = parts.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(
            _splits(shape, level, features), "fold int, tree int, node int, feature int, bin int, mean double, left double, right double").collect()
        for r in found:
            i = 2**level - 1 + r.node
            if level == 0:
                forest.value[r.fold, r.tree, i] = r["mean"]
            if r.feature >= 0:
                forest.feature[r.fold, r.tree, i], forest.bin[r.fold, r.tree, i] = r.feature, r.bin
                forest.value[r.fold, r.tree, 2 * i + 1], forest.value[r.fold, r.tree, 2 * i + 2] = r["left"], r["right"]
        if all(r.feature < 0 for r in found):
            break
    return forest


def predicted(rows: DataFrame, forest: Forest, shape: Shape, keep: list[str], features: int) -> DataFrame:
    """``keep`` and the mean of the trees of each row's ``fold``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep) + ", prediction double"

    def run(batches):
        for pdf in batches:
            x = np.frombuffer(b"".join(pdf["x"]), np.uint8).reshape(-1, features)
            fold, out = pdf["fold"].to_numpy(), np.zeros(len(pdf))
            for f in np.unique(fold):
                at = np.flatnonzero(fold == f)
                out[at] = np.mean([forest.value[f, t][forest.node(f, t, x[at], shape.depth)] for t in range(shape.trees)], axis=0)
            yield pdf[keep].assign(prediction=out)

    return rows.mapInPandas(run, schema)


def binned(df: DataFrame, cols: list[str], edges: list[list[float]]) -> DataFrame:
    """Adds ``x``: one byte a feature, the number of edges below its value (null counts as 0)."""
    schema = df.drop(*cols).schema.add("x", "binary")
    rest = [c for c in df.columns if c not in cols]

    def run(batches):
        for pdf in batches:
            x = np.stack([np.searchsorted(e, pdf[c].fillna(0.0).to_numpy(dtype=float), "left").astype(np.uint8) for c, e in zip(cols, edges)], axis=1) if len(pdf) else np.zeros((0, len(cols)), np.uint8)
            yield pdf[rest].assign(x=[r.tobytes() for r in x])

    return df.mapInPandas(run, schema)


def pooled_trees(features: DataFrame, key: str, cols: list[str], plan: B.FoldPlan, shape: Shape = Shape(share=1 / 3), min_history: int = 90, min_pooled_rows: int = 40) -> DataFrame:
    """key, fold and the total of the next ``plan.horizon`` days, by one forest for each fold on all series' causal features.

    ``features`` has pos, n, target (units of the horizon from this day on) and ``cols`` from earlier days. A day trains
    a fold if its whole horizon lies before the fold's origin. A fold with fewer than ``min_pooled_rows`` such days, and none else, forecasts
    the mean of 30 days.
    """
    n, h = F.col("n"), plan.horizon
    lo, hi = plan.fold_span(n, F.col("pos") + h - 1)
    learn = features.filter(F.col("pos") >= min_history).withColumn("lo", lo).withColumn("hi", hi).filter("lo <= hi")
    folds = int(features.agg(F.max(plan.kept(n))).first()[0] or 0)
    # edges from the first fold's days, which all folds see; as many numbers as there are bins
    probs = [i / shape.bins for i in range(1, shape.bins)]
    found = learn.filter("lo = 0").agg(*[F.percentile_approx(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), probs, 10_000).alias(c) for c in cols]).first()
    edges = [sorted(set(found[c] or [])) for c in cols]
    rows = cut_lineage(binned(learn.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col("target").cast("double").alias("y"), F.xxhash64(key, "pos").alias("drawn"), "lo", "hi"), cols, edges), "trees")
    days = rows.select(F.explode(F.sequence("lo", "hi")).alias("fold")).groupBy("fold").agg(F.count("*").alias("days"))
    forest = grow(rows, folds, len(cols), shape)
    ends = F.filter(F.sequence(F.lit(0), plan.kept(n) - 1), lambda f: plan.train_end(n, f) == F.col("pos"))
    asked = features.filter(plan.kept(n) > 0).withColumn("fold", F.explode(ends)).select(*[F.col(c).cast("double").alias(c) for c in cols], key, "fold", F.col("mean_30").alias("plain"))
    told = predicted(binned(asked, cols, edges), forest, shape, [key, "fold", "plain"], len(cols)).join(days, "fold", "left")
    enough = F.coalesce("days", F.lit(0)) >= min_pooled_rows
    return told.select(key, "fold", F.greatest(F.when(enough, F.col("prediction")).otherwise(F.coalesce("plain", F.lit(0.0)) * h), F.lit(0.0)).alias("total"))
