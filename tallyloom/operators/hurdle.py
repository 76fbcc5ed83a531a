"""Sale-probability models of many groups and folds, fitted together.

The model says how likely a series sells on a day, from its weekday, its recent sale rates and the time since its last sale; it is
pooled over all series of a group, because one series has too few sales for it. All pairs of group and fold are fitted at once by
Newton steps, and a step is one aggregation of weighted sums and cross products.

The design takes few distinct values (counts of a week and a month, a capped gap, calendar flags). Rows are counted by
design, group and the folds they train before the first step, so the steps' cost is bounded by the design and not by the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import backtest as B
from tallyloom.operators.scale import cut_lineage, discard

WEEKDAYS = [f"wd_{k}" for k in range(7)]
CLIP = 30.0


def hurdle_rows(series: DataFrame, key: str, rate_windows=(7, 30), cap: int = 60) -> DataFrame:
    """Causal design, one row per day: ``label``, trailing rates, recency, weekday and ``sold``, the sale days through the row."""
    w = Window.partitionBy(key).orderBy("pos")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    sale = (F.col("qty") > 0).cast("double")
    d = series.withColumn("label", sale).withColumn("__c", F.coalesce(F.sum(sale).over(past), F.lit(0.0)))
    d = d.withColumn("__last", F.max(F.when(F.col("qty") > 0, F.col("pos"))).over(past))
    for k in rate_windows:
        n = F.least(F.col("pos"), F.lit(k))
        d = d.withColumn(f"rate_{k}", F.when(n > 0, (F.col("__c") - F.coalesce(F.lag("__c", k).over(w), F.lit(0.0))) / n).otherwise(0.0))
    gap = F.least(F.coalesce(F.col("pos") - F.col("__last"), F.lit(cap)), F.lit(cap)) / cap
    return d.withColumn("recency", gap).withColumn("sold", F.col("__c") + F.col("label")).drop("__c", "__last")


def with_weekday(df: DataFrame, pos) -> DataFrame:
    return df.withColumns({c: (pos % 7 == k).cast("double") for k, c in enumerate(WEEKDAYS)})


def _newton(sums: DataFrame, keys: list[str], p: int, l2: float) -> DataFrame:
    """The next coefficients and the largest change, one small system per row."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in keys) + ", beta array<double>, moved double"

    def solve(batches):
        for pdf in batches:
            beta = np.array(pdf["beta"].tolist()).reshape(-1, p)
            grad = pdf[[f"g_{i}" for i in range(p)]].to_numpy() - l2 * beta
            hess = np.empty((len(pdf), p, p))
            for i in range(p):
                for j in range(i, p):
                    hess[:, i, j] = hess[:, j, i] = pdf[f"h_{i}_{j}"].to_numpy()
            step = np.linalg.solve(hess + l2 * np.eye(p), grad[..., None])[..., 0] if len(pdf) else grad
            size = np.abs(step).max(axis=1, initial=0.0)
            step *= np.minimum(1.0, 4.0 / np.maximum(size, 1e-300))[:, None]  # a far step is shortened
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame({"beta": (beta + step).tolist(), "moved": size})], axis=1)

    return sums.mapInPandas(solve, schema)


def _weighted(keys: list[str], features: list[str]):
    """Gradient and upper half of the Hessian of each key, one row for each key and task."""
    p = len(features)
    upper = np.triu_indices(p)

    def add(batches):
        held = {}
        for pdf in batches:
            x, chance = pdf[features].to_numpy(), 1 / (1 + np.exp(-pdf["z"].to_numpy()))
            rest, weight = pdf["s"].to_numpy() - pdf["n"].to_numpy() * chance, pdf["n"].to_numpy() * chance * (1 - chance)
            for key, at in pdf.groupby(keys, sort=False, dropna=False).indices.items():
                own = x[at]
                sums = np.concatenate([rest[at] @ own, ((own * weight[at, None]).T @ own)[upper]])
                held[key] = held[key] + sums if key in held else sums
        yield pd.DataFrame([(*(k if isinstance(k, tuple) else (k,)), v.tolist()) for k, v in held.items()], columns=[*keys, "m"])

    return add


def grouped_logistic(rows: DataFrame, keys: list[str], features: list[str], l2: float = 1.0, steps: int = 40, tolerance: float = 1e-8) -> DataFrame:
    """Keys and ``beta`` of a ridge-penalised logistic regression without intercept for every key.

    ``rows`` has the keys, the features, ``n`` (days) and ``s`` (sale days) of each design; it is read once a step.
    """
    p = len(features)
    betas = rows.select(*keys).distinct().withColumn("beta", F.array(*[F.lit(0.0)] * p)).withColumn("moved", F.lit(np.inf))
    betas = cut_lineage(betas, "betas")
    for _ in range(steps):
        z = sum((F.col("beta")[i] * F.col(c) for i, c in enumerate(features)), F.lit(0.0))
        r = rows.join(betas.select(*keys, "beta"), keys).select(*keys, *features, "n", "s", F.greatest(F.least(z, F.lit(CLIP)), F.lit(-CLIP)).alias("z"))
        parts = r.mapInPandas(_weighted(keys, features), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys) + ", m array<double>")
        names = [f"g_{i}" for i in range(p)] + [f"h_{i}_{j}" for i in range(p) for j in range(i, p)]
        sums = parts.groupBy(*keys).agg(*[F.sum(F.col("m")[i]).alias(c) for i, c in enumerate(names)]).join(betas.select(*keys, "beta"), keys)
        after = cut_lineage(_newton(sums, keys, p, l2), "betas")
        discard(betas)
        betas = after
        if not (betas.agg(F.max("moved")).first()[0] or 0.0) > tolerance:
            break
    return betas.select(*keys, "beta")


def pooled_hurdle(series: DataFrame, key: str, group: str, plan: B.FoldPlan, extra: list[str] | None = None, l2: float = 1.0, size_window: int = 90,
                  min_train_days: int = 21, min_pooled_rows: int = 200) -> DataFrame:
    """key, fold, h and yhat: chance of a sale from the group's model times the series' own mean size, for every fold.

    Weekday and the calendar columns ``extra`` advance over the horizon; rates and recency stay as they were on the last training
    day. Series with fewer than ``min_train_days`` train nothing. They, and all series of a pool of fewer than
    ``min_pooled_rows`` days, get their plain sale rate times size.
    """
    extra = extra or []
    features = [*WEEKDAYS, "rate_7", "rate_30", "recency", *extra]
    d = cut_lineage(hurdle_rows(series, key), "hurdle")
    n = F.col("n")
    lo, hi = plan.fold_span(n, F.col("pos"))
    trains = F.filter(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>")), lambda f: plan.train_end(n, f) >= min_train_days)
    design = with_weekday(d.withColumn("folds", trains).filter(F.size("folds") > 0), F.col("pos"))
    counted = cut_lineage(design.groupBy(group, "folds", *features).agg(F.count("*").alias("n"), F.sum("label").alias("s")), "design")
    rows = counted.withColumn("fold", F.explode("folds")).drop("folds")
    enough = rows.groupBy(group, "fold").agg(F.sum("n").alias("days")).filter(F.col("days") >= min_pooled_rows).select(group, "fold")
    betas = grouped_logistic(rows.join(enough, [group, "fold"], "left_semi"), [group, "fold"], features, l2)

    ends = F.filter(F.sequence(F.lit(0), plan.kept(n) - 1), lambda f: plan.train_end(n, f) == F.col("pos") + 1)
    state = d.filter(plan.kept(n) > 0).withColumn("fold", F.explode(ends)).select(key, "fold", "rate_7", "rate_30", "recency", (F.col("sold") / (F.col("pos") + 1)).alias("rate"), (F.col("pos") + 1).alias("train_end"))
    inside = (F.col("age") < size_window) & (F.col("qty") > 0)
    sizes = B.training_rows(d.select(key, "pos", "qty", "n"), plan, window=size_window).groupBy(key, "fold").agg(F.coalesce(F.avg(F.when(inside, F.col("qty"))), F.lit(0.0)).alias("size"))
    ahead = d.withColumn("fold", B.test_fold(plan)).filter("fold is not null").select(key, group, "fold", "pos", *extra)
    rows = with_weekday(ahead.join(state, [key, "fold"]).join(sizes, [key, "fold"]), F.col("pos")).join(betas, [group, "fold"], "left")
    z = sum((F.col("beta")[i] * F.col(c) for i, c in enumerate(features)), F.lit(0.0))
    p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(CLIP)), F.lit(-CLIP))))
    fitted = F.col("beta").isNotNull() & (F.col("train_end") >= min_train_days)
    return rows.select(key, "fold", (F.col("pos") - F.col("train_end") - plan.gap).alias("h"), (F.when(fitted, p).otherwise(F.col("rate")) * F.col("size")).alias("yhat"))
