"""The plug-in surface: forecast methods by name, and user-written ones.

A *level* method is a Column aggregate over training rows. ``register`` adds
one; ``run`` evaluates any set of them in a single aggregation. ``custom``
takes a Python function ``f(train_array, horizon) -> array`` and is the only
place where Python runs per series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import backtest as B
from tallyloom.operators import methods as M

_EXTRA: dict[str, Callable[[], Column]] = {}


def register(name: str, build: Callable[[], Column]) -> None:
    """Add a level method; ``build`` returns its aggregate expression."""
    if name in _EXTRA or name in M.level_methods():
        raise ValueError(f"method {name!r} exists")
    _EXTRA[name] = build


def names() -> list[str]:
    return sorted([*M.level_methods(), *_EXTRA])


def run(series: DataFrame, key: str, plan: B.FoldPlan, methods: list[str]) -> DataFrame:
    menu = M.level_methods() | {k: v() for k, v in _EXTRA.items()}
    unknown = [m for m in methods if m not in menu]
    if unknown:
        raise KeyError(f"unknown methods {unknown}; known: {sorted(menu)}")
    train = B.training_rows(B.with_sale_ranks(series, key), plan)
    wide = M.levels(train, [key], {m: menu[m] for m in methods})
    return M.long_form(wide, [key], methods, plan.horizon)


def custom(series: DataFrame, key: str, plan: B.FoldPlan, fit_predict: Callable, window: int | None = None) -> DataFrame:
    """Run a user's ``f(train, horizon)`` per (series, fold) as a grouped map.

    A group holds one series' training days, at most one value per calendar
    day; ``window`` shortens it further.
    """
    horizon = plan.horizon
    train = B.training_rows(series, plan, window=window).select(key, "fold", "pos", "qty")

    def apply(pdf):
        import pandas as pd

        pdf = pdf.sort_values("pos")
        yhat = fit_predict(pdf["qty"].to_numpy(), horizon)
        return pd.DataFrame({key: pdf[key].iloc[0], "fold": pdf["fold"].iloc[0], "h": range(horizon), "yhat": [max(float(v), 0.0) for v in yhat]})

    return train.groupBy(key, "fold").applyInPandas(apply, f"{key} string, fold int, h int, yhat double")
