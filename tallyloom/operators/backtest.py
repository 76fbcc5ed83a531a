"""Rolling-origin folds and training rows.

All folds of a series follow from its length, so a row can tell by itself
which folds it trains and which one it tests. No join is needed, and with rows
already partitioned by series the whole back-test costs one exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FoldPlan:
    horizon: int = 30
    gap: int = 0
    min_train: int = 60
    max_folds: int = 12
    min_folds: int = 3

    def kept(self, n: Column) -> Column:
        """Number of folds kept for a series of length ``n``."""
        room = n - self.gap - self.horizon - self.min_train
        every = F.when(room >= 0, F.floor(room / self.horizon) + 1).otherwise(0)
        return F.when(every < self.min_folds, 0).otherwise(F.least(every, F.lit(self.max_folds))).cast("int")

    def folds(self, n: Column) -> Column:
        """array<struct(fold, train_end)>, oldest fold first."""
        kept = self.kept(n)
        each = F.when(kept > 0, F.transform(F.sequence(F.lit(0), F.greatest(kept - 1, F.lit(0))), lambda i: F.struct(
            i.alias("fold"),
            (n - self.gap - self.horizon * (kept - i)).cast("int").alias("train_end"))))
        return F.coalesce(each, F.array().cast("array<struct<fold:int,train_end:int>>"))


    def train_end(self, n: Column, fold: Column) -> Column:
        return (n - self.gap - self.horizon * (self.kept(n) - fold)).cast("int")

    def fold_span(self, n: Column, pos: Column, reach: int | None = None) -> tuple[Column, Column]:
        """First and last fold that train on ``pos`` (empty when lo > hi)."""
        kept = self.kept(n)
        left = n - self.gap - pos
        lo = F.greatest(kept - F.ceil(left / self.horizon) + 1, F.lit(0))
        hi = kept - 1
        if reach is not None:
            hi = F.least(hi, kept - F.ceil((left - reach) / self.horizon))
        return lo.cast("int"), hi.cast("int")


@dataclass(frozen=True)
class Deploy(FoldPlan):
    """One fold that trains on everything; its horizon lies after the series."""

    def train_end(self, n: Column, fold: Column) -> Column:
        return n.cast("int")

    def fold_span(self, n: Column, pos: Column, reach: int | None = None) -> tuple[Column, Column]:
        hi = F.lit(0) if reach is None else F.when(n - pos <= reach, 0).otherwise(-1)
        return F.when(pos < n, 0).otherwise(1), hi

    def kept(self, n: Column) -> Column:
        return F.lit(1)

    def folds(self, n: Column) -> Column:
        return F.array(F.struct(F.lit(0).alias("fold"), n.cast("int").alias("train_end")))


def fold_table(lengths: DataFrame, key: str, plan: FoldPlan) -> DataFrame:
    out = lengths.select(key, "n", F.explode(plan.folds(F.col("n"))).alias("f"))
    return out.select(key, "f.fold", "f.train_end", (F.col("f.train_end") + plan.gap).alias("test_start"),
                      (F.col("f.train_end") + plan.gap + plan.horizon).alias("test_end"))


def with_sale_ranks(series: DataFrame, key: str) -> DataFrame:
    """Sale counters for smoothing methods: ``k_pos`` sales through the row,
    ``k_all`` in the whole series, and the previous sale's position."""
    w = Window.partitionBy(key).orderBy("pos")
    sale = (F.col("qty") > 0).cast("int")
    return (series.withColumn("k_pos", F.sum(sale).over(w))
            .withColumn("k_all", F.sum(sale).over(Window.partitionBy(key)))
            .withColumn("prev_pos", F.last(F.when(F.col("qty") > 0, F.col("pos")), ignorenulls=True).over(
                w.rowsBetween(Window.unboundedPreceding, -1))))


def training_rows(series: DataFrame, plan: FoldPlan, limit: int | None = None, window: int | None = None) -> DataFrame:
    """Each row once per fold that trains on it.

    ``age`` counts back from the origin (0 is the last training day) and
    ``n_train`` is the training length, at most ``limit`` days. Give
    ``window`` when a method looks at the last ``window`` days only: older
    rows are then dropped before they are repeated per fold.
    """
    reach = min([w for w in (limit, window) if w is not None], default=None)
    n, pos = F.col("n"), F.col("pos")
    lo, hi = plan.fold_span(n, pos, reach)
    t = series.withColumn("__lo", lo).withColumn("__hi", hi).filter(F.col("__lo") <= F.col("__hi"))
    t = t.withColumn("fold", F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi")
    t = t.withColumn("train_end", plan.train_end(n, F.col("fold")))
    t = t.withColumn("age", F.col("train_end") - 1 - pos)
    return t.withColumn("n_train", F.col("train_end") if limit is None else F.least("train_end", F.lit(limit)))


def test_fold(plan: FoldPlan) -> Column:
    """The fold a row tests, NULL when it tests none."""
    kept = plan.kept(F.col("n"))
    back = F.floor((F.col("n") - 1 - F.col("pos")) / plan.horizon)
    return F.when(back < kept, kept - 1 - back).cast("int")


def actuals(series: DataFrame, key: str, plan: FoldPlan) -> DataFrame:
    t = series.withColumn("fold", test_fold(plan)).filter(F.col("fold").isNotNull())
    return t.groupBy(key, "fold").agg(F.sum("qty").alias("actual"))


def naive_scales(series: DataFrame, key: str, plan: FoldPlan) -> DataFrame:
    """Mean absolute (and squared) change of consecutive training blocks."""
    h, n = plan.horizon, F.col("n") - plan.gap
    back = F.floor((n - 1 - F.col("pos")) / h)
    blocks = (series.withColumn("back", back).filter((F.col("back") >= 0) & (F.col("back") < F.floor(n / h)))
              .groupBy(key, "n", "back").agg(F.sum("qty").alias("units")))
    w = Window.partitionBy(key).orderBy("back")
    diffs = blocks.withColumn("d", F.lead("units").over(w) - F.col("units"))
    kept = plan.kept(F.col("n"))
    lo = F.greatest(kept - F.col("back"), F.lit(0)).cast("int")
    rows = diffs.withColumn("__lo", lo).withColumn("__hi", kept - 1).filter("__lo <= __hi").select(
        key, "d", F.explode(F.sequence("__lo", "__hi")).alias("fold"))
    return rows.groupBy(key, "fold").agg(F.avg(F.abs("d")).alias("naive_scale"), F.avg(F.col("d") * F.col("d")).alias("sq_scale"))


def score(forecast: DataFrame, series: DataFrame, key: str, plan: FoldPlan) -> DataFrame:
    """Fold rows: actual, predicted, absolute error and scale per method.

    ``forecast`` has key, fold, method, pred.
    """
    truth = actuals(series, key, plan).join(naive_scales(series, key, plan), [key, "fold"], "left")
    return forecast.join(truth, [key, "fold"]).withColumn("abs_error", F.abs(F.col("actual") - F.col("pred")))
