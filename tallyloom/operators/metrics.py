"""Accuracy and service metrics over fold rows.

Fold rows have sku, fold, method, actual, pred, abs_error, naive_scale. An
undefined ratio is NULL, never NaN.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import POISSON, mixed as _mixed
from tallyloom.operators.quantiles import exact_quantiles
from tallyloom.operators.scale import cut_lineage, in_order


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def core(rows: DataFrame, keys: list[str]) -> DataFrame:
    err = F.col("actual") - F.col("pred")
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.when(F.col("actual") != 0, F.abs(err / F.col("actual")))) * 100).alias("mape"),
        F.count(F.when(F.col("actual") == 0, 1)).alias("mape_undefined"),
        F.avg("naive_scale").alias("scale"),
        F.avg(F.when(F.col("naive_scale") > 0, F.col("naive_scale"))).alias("scale_pos"),
        F.sum(F.abs(err)).alias("abs_sum"), F.sum("actual").alias("demand"), F.sum("pred").alias("pred_sum"))
    return g.select(
        *keys, "n", "mae", "rmse", "mape", "mape_undefined", _ratio(F.col("mae"), F.col("scale")).alias("mase"),
        _ratio(F.col("mae"), F.col("scale_pos")).alias("mase_published"),
        _ratio(100 * F.col("abs_sum"), F.col("demand")).alias("wape"),
        _ratio(100 * (F.col("pred_sum") - F.col("demand")), F.col("demand")).alias("bias"), "demand", "scale")


def service(rows: DataFrame, keys: list[str], supplied: str = "pred") -> DataFrame:
    got = F.greatest(F.col(supplied), F.lit(0.0))
    d = F.sum("actual")
    return rows.groupBy(*keys).agg(
        F.when(d > 0, F.sum(F.least(F.col("actual"), got)) / d).otherwise(1.0).alias("fill_rate"),
        F.avg((F.col(supplied) >= F.col("actual")).cast("double")).alias("cycle_service"))


def summary(rows: DataFrame) -> DataFrame:
    """Per series first, then over series; NULL MASE ranks last."""
    per = core(rows, ["method", "sku"])
    naive = per.filter("method = 'naive'").select("sku", F.col("mae").alias("naive_mae"))
    j = cut_lineage(per.join(naive, "sku", "left"), "per-series")
    medians = exact_quantiles(j, "mase", [0.5], ["method"]).select("method", F.col("q")[0].alias("mase_median"))
    pooled = rows.groupBy("method").agg((100 * F.sum("abs_error") / F.sum("actual")).alias("wmape"))
    g = j.groupBy("method").agg(
        F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("mase").alias("mase"),
        F.count("mase").alias("mase_n"), F.count("*").alias("n_skus"),
        F.sum("n").alias("n_folds"), F.avg((F.col("mae") < F.col("naive_mae")).cast("double")).alias("beats_naive"))
    return g.join(medians, "method", "left").join(pooled, "method")


def rank(summary_rows: DataFrame) -> DataFrame:
    """Methods are few: one small window ranks them."""
    w = Window.orderBy(F.asc_nulls_last("mase"), "mae", "method")
    return summary_rows.withColumn("place", F.row_number().over(w))


def robust(rows: DataFrame) -> DataFrame:
    err = F.col("actual") - F.col("pred")
    per = rows.groupBy("method", "sku").agg(
        F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), F.sum("actual").alias("demand"),
        F.avg("naive_scale").alias("a"), F.avg("sq_scale").alias("sq")).filter("a > 0")
    per = per.withColumn("mase", F.col("mae") / F.col("a")).withColumn(
        "rmsse", F.when(F.col("sq") > 0, F.sqrt(F.col("mse") / F.col("sq"))))
    per = cut_lineage(per, "per-series")
    b = exact_quantiles(per, "mase", [0.05, 0.95, 0.5], ["method"]).select("method", F.col("q").alias("b"))
    squared = exact_quantiles(per, "rmsse", [0.5], ["method"]).select("method", F.col("q")[0].alias("rmsse_median"))
    # the ten worst per method, kept exactly by a salted top-k
    from tallyloom.operators.ranking import top_per_group

    worst = top_per_group(per, "method", F.struct("mase", "sku"), ["sku", "mase"], 10)
    w = worst.groupBy("method").agg(F.sum("mase").alias("worst10"))
    j = per.join(F.broadcast(b), "method")
    return j.groupBy("method").agg(
        F.avg("mase").alias("mase_mean"), F.first(F.col("b")[2]).alias("mase_median"),
        F.avg(F.when(F.col("mase").between(F.col("b")[0], F.col("b")[1]), F.col("mase"))).alias("mase_trimmed"),
        (F.sum(F.col("mase") * F.col("demand")) / F.sum("demand")).alias("mase_weighted"),
        (F.sum("mae") / F.sum("a")).alias("mase_global"), F.avg("rmsse").alias("rmsse_mean"),
        F.sum("mase").alias("total"), F.count("*").alias("n_skus")
    ).join(w, "method").join(squared, "method", "left").withColumn("worst10_pct", 100 * F.col("worst10") / F.col("total"))


def scopes(rows: DataFrame, fold_break: DataFrame, threshold: float) -> DataFrame:
    """Each fold row once for 'overall' and once for its own scope.

    A fold is a break fold when strictly more than ``threshold`` of its test
    days are break days.
    """
    own = F.when(F.col("break_share") > threshold, "semestral_break").otherwise("standard_period")
    return rows.join(F.broadcast(fold_break), "fold").withColumn("scope", F.explode(F.array(F.lit("overall"), own)))


def c_index(rows: DataFrame) -> DataFrame:
    """Harrell's C from (time, observed, risk) without forming pairs.

    Equal (time, observed, risk) rows are counted first. Each counted cell is
    then offered to every earlier event time; per event time, running counts
    over the risk values give how many later rows have a lower or equal risk.
    """
    cells = rows.groupBy("time", "observed", "risk").agg(F.count("*").alias("c"))
    times = rows.filter("observed = 1").agg(F.sort_array(F.collect_set("time"))).scalar()
    later = cells.withColumn("__t", times).withColumn("t0", F.explode(F.filter("__t", lambda t: t < F.col("time")))).groupBy(
        "t0", "risk").agg(F.sum("c").alias("later"))
    events = cells.filter("observed = 1").select(F.col("time").alias("t0"), "risk", F.col("c").alias("events"))
    g = events.join(later, ["t0", "risk"], "full").fillna(0, ["events", "later"])
    # there are few event times and many risks, so the running counts go in ranges
    g = in_order(g, [F.col("risk").asc()], ["t0"], {"upto": "later"}).withColumn("lower", F.col("upto") - F.col("later")).withColumnRenamed("upto_total", "all_later")
    return g.agg(F.sum(F.col("events") * F.col("all_later")).alias("pairs"),
                 F.sum(F.col("events") * (F.col("lower") + 0.5 * F.col("later"))).alias("concordant")).withColumn(
        "c_index", F.when(F.col("pairs") > 0, F.col("concordant") / F.col("pairs")))


def cluster_bootstrap(diffs: DataFrame, key: str, value: str, weight: str, replicates: int, seed: int = 7) -> DataFrame:
    """Bootstrap over series of a ratio difference, with a 95 % interval.

    Each (series, replicate) draws a Poisson(1) weight from a hash, so the result does not depend on partitioning. A task adds the
    weighted sums of all replicates into two arrays and gives them once; no series is repeated.
    """
    rows = diffs.select(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"))

    def add(batches):
        salts = _mixed(np.arange(1, replicates + 1), 0)
        sums = np.zeros((2, replicates))
        for pdf in batches:
            h, both = pdf["h"].to_numpy(), pdf[["v", "w"]].to_numpy()
            for i in range(0, len(h), 256):
                u = (_mixed(h[i:i + 256, None].astype(np.uint64) ^ salts, 1) >> np.uint64(11)) / float(1 << 53)
                sums += both[i:i + 256].T @ np.searchsorted(POISSON, u, "right")
        yield pd.DataFrame({"v": [sums[0].tolist()], "w": [sums[1].tolist()]})

    parts = rows.mapInPandas(add, "v array<double>, w array<double>")
    each = parts.select(F.posexplode(F.arrays_zip("v", "w")).alias("rep", "s")).groupBy("rep").agg((F.sum("s.v") / F.sum("s.w")).alias("d"))
    # one number for each replicate
    return each.agg(F.percentile("d", [0.025, 0.5, 0.975]).alias("q"), F.count("d").alias("replicates")).select(
        F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"), "replicates")
