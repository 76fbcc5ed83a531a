"""Do forecasts look ahead? Runs an operator twice, the second time with another future for every fold.

For the second run each fold of a series becomes a series of its own that ends with the fold's horizon; what lies behind the
fold's origin is replaced. All folds are one plan, and the operator knows nothing of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import backtest as B
from tallyloom.operators import policy as P
from tallyloom.operators.scale import spread

MARK = "#"


def changed_future(series: DataFrame, key: str, plan: B.FoldPlan, future: Column) -> DataFrame:
    """Every fold as a series ``key#fold`` of its own whose units are ``future`` from the origin on."""
    copies = series.withColumn("__f", F.explode(plan.folds(F.col("n")))).withColumn("__n", F.col("__f.train_end") + plan.gap + plan.horizon)
    copies = copies.filter(F.col("pos") < F.col("__n")).withColumn("qty", F.when(F.col("pos") < F.col("__f.train_end"), F.col("qty")).otherwise(future))
    return copies.withColumn(key, F.concat(F.col(key), F.lit(MARK), F.col("__f.fold"))).withColumn("n", F.col("__n")).drop("__f", "__n")


def differing(a: DataFrame, b: DataFrame, keys: list[str], value: str, by: list[str]) -> DataFrame:
    """Rows of ``by`` and the number of keys whose value is missing on one side or differs.

    The rows are those of a full join on ``keys``, told from counts: rows that are partitioned by some of the keys stay where they are.
    """
    # a key with a null meets nobody
    alone = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    sides = [d.select(*keys, F.round(value, 6).alias("v"), F.when(alone, n).alias("side"), F.lit(n).alias("x"), F.lit(1 - n).alias("y")) for n, d in ((1, a), (0, b))]
    each = sides[0].unionByName(sides[1]).groupBy(*keys, "side", "v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    met = each.groupBy(*keys, "side").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("same"))
    rows = F.when((F.col("x") > 0) & (F.col("y") > 0), F.col("x") * F.col("y")).otherwise(F.col("x") + F.col("y"))
    return met.groupBy(*by).agg(F.sum(rows).alias("rows"), F.sum(rows - F.col("same")).alias("differing_rows"))


def fold_leaks(series: DataFrame, key: str, plan: B.FoldPlan, run: Callable[[DataFrame, B.FoldPlan], DataFrame], future: Column | None = None) -> DataFrame:
    """method, fold, rows and differing_rows of ``run(series, plan)``, which gives key, method, fold and pred.

    Without a leak no row differs. The operator must not pool series, because a fold's copies would learn from each other.
    """
    future = F.col("qty") * 3 + 17 if future is None else future
    one = replace(plan, max_folds=1, min_folds=1)
    again = run(changed_future(series, key, plan, future), one)
    named = F.regexp_extract(key, f"^(.*){MARK}([0-9]+)$", 1), F.regexp_extract(key, f"^(.*){MARK}([0-9]+)$", 2).cast("int")
    again = again.select(named[0].alias(key), "method", named[1].alias("fold"), "pred")
    return differing(run(series, plan), again, [key, "method", "fold"], "pred", ["method", "fold"])


def error_leaks(days: DataFrame, items: DataFrame, n: Column, observed: DataFrame, folds: int = 12, step: int = 30) -> DataFrame:
    """fold, rows and differing_rows of the policy's errors up to ``folds`` ends, ``step`` days apart, with another future behind each end.

    Days and items move once; the copies for each end, both runs and their comparison stay in the item's partition.
    """
    cut = n - step * F.col("copy")
    other = F.when(F.col("pos") < cut, F.col("qty")).otherwise(F.col("qty") * 3 + 17)
    days, items = (spread(d, "product_id") for d in (days.select("product_id", "pos", "qty"), items))
    a, b = (P.fold_errors(days, items, n, observed, upto=cut, copies=F.sequence(F.lit(1), F.lit(folds)), qty=q).withColumnRenamed("fold", "block") for q in (None, other))
    split = lambda d: d.select(F.col("copy").alias("fold"), "product_id", "block", "error")
    return differing(split(a), split(b), ["fold", "product_id", "block"], "error", ["fold"])
