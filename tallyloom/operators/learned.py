"""Calendar regressions of all groups and folds from one aggregation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import backtest as B


def solve_ridge(sums: DataFrame, keys: list[str], names: list[str], ridge: float) -> DataFrame:
    """Ridge regression with a free intercept from sums and cross products, one small system per row."""
    p = len(names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in keys) + ", beta array<double>"

    def solve(batches):
        for pdf in batches:
            betas = []
            for r in pdf.to_dict("records"):
                n = r["n"]
                x, y = np.array([r[f"s_{i}"] for i in range(p)]), r["s_y"]
                xx = np.array([[r[f"c_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) - np.outer(x, x) / n
                xy = np.array([r[f"y_{i}"] for i in range(p)]) - x * y / n
                b = np.linalg.solve(xx + ridge * np.eye(p), xy)
                betas.append([float((y - b @ x) / n), *map(float, b)])
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame({"beta": betas})], axis=1)

    return sums.mapInPandas(solve, schema)


def calendar_regression(series: DataFrame, group: str, flags: list[str], plan: B.FoldPlan, ridge: float = 1.0, forward=F.log1p, back=None) -> DataFrame:
    """Weekday and calendar-flag model of transformed units per group and fold, with smearing.

    One aggregation gives every group's and fold's sums and cross products; the
    systems are solved where their rows are. A flag that never varies in a
    training slice gets the coefficient zero. ``forward`` transforms the units,
    ``back(value, mean_of)`` undoes it with the mean over the training residuals;
    the default pair is log1p with its exponential.
    """
    names = [*[f"dow_{k}" for k in range(6)], *flags]
    d = series.withColumn("label", forward(F.col("qty")))
    for k in range(6):
        d = d.withColumn(f"dow_{k}", (F.weekday("day") == k).cast("double"))
    train = B.training_rows(d, plan)
    x = [F.col(c) for c in names]
    sums = train.groupBy(group, "fold").agg(
        F.count("*").cast("double").alias("n"), F.sum("label").alias("s_y"),
        *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(x)], *[F.sum(c * F.col("label")).alias(f"y_{i}") for i, c in enumerate(x)],
        *[F.sum(x[i] * x[j]).alias(f"c_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))])
    beta = solve_ridge(sums, [group, "fold"], names, ridge)
    fitted = F.col("beta")[0]
    for i, c in enumerate(x):
        fitted = fitted + F.col("beta")[i + 1] * c
    smear = train.join(beta, [group, "fold"]).withColumn("fit", fitted).groupBy(group, "fold").agg(F.avg(F.exp(F.col("label") - F.col("fit"))).alias("smear"), F.avg(F.col("label") - F.col("fit")).alias("shift"))
    ahead = d.withColumn("fold", B.test_fold(plan)).filter("fold IS NOT NULL").join(beta, [group, "fold"]).join(smear, [group, "fold"]).withColumn("fit", fitted)
    units = F.exp("fit") * F.col("smear") - 1.0 if back is None else back(F.col("fit"), F.col("shift"))
    return ahead.select(group, "fold", "day", F.greatest(units, F.lit(0.0)).alias("yhat"))
