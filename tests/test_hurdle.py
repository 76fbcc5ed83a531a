"""Pooled sale-probability models against plain numpy fits, group by group and fold by fold."""

import datetime as dt
import random

import numpy as np
import pytest

from tallyloom.operators import hurdle as H
from tallyloom.operators.backtest import FoldPlan

PLAN = FoldPlan(horizon=10, min_train=15, max_folds=4, min_folds=1)


def design(t):
    rows, last = [], None
    for i, q in enumerate(t):
        rates = [np.mean(np.array(t[max(0, i - k):i]) > 0) if i else 0.0 for k in (7, 30)]
        rows.append([*(float(i % 7 == k) for k in range(7)), *rates, min(i - last if last is not None else 60, 60) / 60])
        if q > 0:
            last = i
    return np.array(rows)


def fit(x, y, l2):
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (y - p) - l2 * w)
        w = w + step
        if np.abs(step).max() < 1e-12:
            break
    return w


def plain(data, groups, min_train_days, min_pooled_rows):
    out = {}
    for g in set(groups.values()):
        mine = {k: t for k, t in data.items() if groups[k] == g}
        folds = {}
        for k, t in mine.items():
            room = len(t) - PLAN.horizon - PLAN.min_train
            kept = min(room // PLAN.horizon + 1, PLAN.max_folds) if room >= 0 else 0
            for f in range(kept):
                folds.setdefault(f, {})[k] = len(t) - PLAN.horizon * (kept - f)
        for f, ends in folds.items():
            able = {k: e for k, e in ends.items() if e >= min_train_days}
            x = [design(mine[k][:e]) for k, e in able.items()]
            w = None
            if sum(map(len, x)) >= min_pooled_rows and x:
                w = fit(np.vstack(x), np.concatenate([(np.array(mine[k][:e]) > 0).astype(float) for k, e in able.items()]), 1.0)
            for k, e in ends.items():
                t = np.array(mine[k][:e])
                tail = t[-90:]
                size = tail[tail > 0].mean() if (tail > 0).any() else 0.0
                for h in range(PLAN.horizon):
                    if w is None or k not in able:
                        p = (t > 0).mean()
                    else:
                        row = design(t)[-1]
                        row[:7] = [float((e + h) % 7 == j) for j in range(7)]
                        p = 1 / (1 + np.exp(-row @ w))
                    out[k, f, h] = p * size
    return out


@pytest.mark.parametrize("min_train_days, min_pooled_rows", [(21, 60), (40, 200)])
def test_equals_numpy(spark, min_train_days, min_pooled_rows):
    rng = random.Random(1)
    data = {f"s{i}": [float(rng.choice([0, 0, 0, 1, 4]) if i % 3 else rng.choice([1, 2])) for _ in range(rng.choice([26, 55, 70]))] for i in range(7)} | {"never": [0.0] * 70}
    groups = {k: "ab"[i % 2] if k != "never" else "c" for i, k in enumerate(data)}
    rows = [(k, groups[k], dt.date(2020, 1, 1), i, x, len(t)) for k, t in data.items() for i, x in enumerate(t)]
    series = spark.createDataFrame(rows, "sku string, g string, day date, pos int, qty double, n int")
    got = {(r.sku, r.fold, r.h): r.yhat for r in H.pooled_hurdle(series, "sku", "g", PLAN, min_train_days=min_train_days, min_pooled_rows=min_pooled_rows).collect()}
    want = plain(data, groups, min_train_days, min_pooled_rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-7) for k, v in want.items())


def test_flags_advance(spark):
    """A calendar flag that explains the sales carries over into the horizon."""
    rows = [("a", "g", i, 3.0 if i % 5 == 0 else 0.0, float(i % 5 == 0), 120) for i in range(120)]
    got = H.pooled_hurdle(spark.createDataFrame(rows, "sku string, g string, pos int, qty double, flag double, n int"), "sku", "g", PLAN, ["flag"], min_pooled_rows=50).collect()
    ends = {f: 120 - 10 * (4 - f) for f in range(4)}
    on = [r.yhat for r in got if (ends[r.fold] + r.h) % 5 == 0]
    off = [r.yhat for r in got if (ends[r.fold] + r.h) % 5]
    assert len(on) == 8 and min(on) > 3 * max(off)
