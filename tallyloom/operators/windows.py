"""Ordered computations on item-day rows.

Rows are summed to item-days first, so a window holds at most one row per
calendar day of an item, however many sales a hot item has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import half_even
from tallyloom.operators.scale import in_order

GAP_CAP_DAYS = 30
SUPPLY_WINDOW = 28


def day_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("product_id", "day").agg(F.sum("quantity_sold").alias("day_units"))


def month_running(rows: DataFrame, order: list[str]) -> DataFrame:
    """Running units per item, reset each month, in (day, order) order.

    The rows of one item, even those of one day, are cut into ranges, so a hot item is summed by several tasks.
    """
    done = in_order(rows.withColumn("__month", F.trunc("day", "month")), [F.asc("day"), *[F.asc(c) for c in order]], ["product_id", "__month"], {"cumulative_monthly_units": "quantity_sold"})
    return done.select(*rows.columns, "cumulative_monthly_units")


def depletion_rate(days: DataFrame) -> DataFrame:
    w = Window.partitionBy("product_id").orderBy("day")
    gap = F.least(F.datediff("day", F.lag("day").over(w)), F.lit(GAP_CAP_DAYS))
    return days.withColumn("depletion_rate", half_even(F.col("day_units") / gap, 4))


def stock_on_hand(days: DataFrame, counts: DataFrame) -> DataFrame:
    """The month's count less units sold earlier in the month."""
    month = F.date_format("day", "yyyy-MM")
    sold = F.coalesce(F.sum("day_units").over(
        Window.partitionBy("product_id", "month").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = days.withColumn("month", month).withColumn("sold_before", sold)
    return d.join(counts.select("product_id", "month", F.col("quantity").alias("counted")), ["product_id", "month"],
                  "left").withColumn("on_hand", F.col("counted") - F.col("sold_before"))


def stock_state(on_hand: DataFrame) -> DataFrame:
    """Censored 1 / 0 / NULL, and days of supply.

    A sale while the model says empty means an unrecorded restock: the rest of
    the month is unknown, that day included.
    """
    impossible = F.when((F.col("on_hand") <= 0) & (F.col("day_units") > 0), 1)
    broken = F.max(impossible).over(Window.partitionBy("product_id", "month").orderBy("day").rowsBetween(
        Window.unboundedPreceding, 0))
    rate = F.avg("day_units").over(Window.partitionBy("product_id").orderBy("day").rowsBetween(1 - SUPPLY_WINDOW, 0))
    d = on_hand.withColumn("broken", broken).withColumn("rate", rate)
    known = F.col("counted").isNotNull() & F.col("broken").isNull()
    return d.withColumn("is_censored", F.when(known, (F.col("on_hand") <= 0).cast("int"))).withColumn(
        "days_of_supply", F.when(known & (F.col("rate") > 0), half_even(
            F.greatest("on_hand", F.lit(0)) / F.col("rate"), 2)))


def trailing_rate(daily: DataFrame, origin, window: int, observed: DataFrame) -> DataFrame:
    """Units of the last ``window`` days before ``origin`` per observed day."""
    n_obs = observed.filter((F.col("day") < origin) & (F.col("day") >= F.date_sub(origin, window)) & (F.col("observed") == 1)).agg(
        F.count("*")).scalar()
    recent = (F.col("day") < origin) & (F.col("day") >= F.date_sub(origin, window))
    return daily.groupBy("product_id").agg(
        F.sum(F.when(recent, F.col("day_units")).otherwise(0)).alias("units"),
        F.count(F.when(recent & (F.col("day_units") > 0), 1)).alias("sale_days")).withColumn(
        "observed_days", F.when(n_obs > 0, n_obs).otherwise(window)).withColumn(
        "rate", F.col("units") / F.col("observed_days"))


def causal_features(series: DataFrame, key: str = "sku") -> DataFrame:
    """Features of each day computed from strictly earlier days.

    Window sums come from differences of running sums, so a feature costs the
    same for any window length; only the maxima need a moving frame.
    """
    w = Window.partitionBy(key).orderBy("pos")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    qty, pos = F.col("qty"), F.col("pos")
    out = (series.withColumn("__c1", F.coalesce(F.sum(qty).over(past), F.lit(0.0)))
           .withColumn("__c2", F.coalesce(F.sum(qty * qty).over(past), F.lit(0.0)))
           .withColumn("__cn", F.coalesce(F.sum((qty > 0).cast("double")).over(past), F.lit(0.0)))
           .withColumn("__last", F.last(F.when(qty > 0, pos), ignorenulls=True).over(past)))
    for k in (30, 90):
        out = out.withColumn(f"max_{k}", F.max(qty).over(w.rowsBetween(-k, -1)))
    for k in (1, 7, 14, 30):
        out = out.withColumn(f"lag_{k}", F.coalesce(F.lag("qty", k).over(w), F.lit(0.0)))
    for k in (7, 14, 30, 60, 90):
        for c in ("__c1", "__c2", "__cn"):
            if c == "__c1" or k in (30, 90):
                out = out.withColumn(f"{c}_{k}", F.col(c) - F.coalesce(F.lag(c, k).over(w), F.lit(0.0)))
    for k in (7, 14, 30, 60, 90):
        size = F.nullif(F.least(pos, F.lit(k)), F.lit(0))
        out = out.withColumn(f"mean_{k}", F.col(f"__c1_{k}") / size)
        if k in (30, 60, 90):
            out = out.withColumn(f"sum_{k}", F.col(f"__c1_{k}"))
        if k in (30, 90):
            spread = F.col(f"__c2_{k}") / size - F.pow(F.col(f"__c1_{k}") / size, F.lit(2.0))
            out = out.withColumn(f"std_{k}", F.sqrt(F.greatest(spread, F.lit(0.0))))
            out = out.withColumn(f"share_{k}", F.col(f"__cn_{k}") / size)
    out = out.withColumn("days_since", F.least(
        F.coalesce(pos - 1 - F.col("__last"), F.least(pos, F.lit(90))), F.lit(90)))
    prev = (F.col("__c1_60") - F.col("__c1_30")) / 30
    out = out.withColumn("trend", F.when(pos >= 60, F.col("mean_30") - prev))
    out = out.withColumn("ratio", F.when(F.col("mean_90") > 0, F.col("mean_30") / F.col("mean_90")).otherwise(0.0))
    return out.withColumn("weekday", pos % 7).drop(*[c for c in out.columns if c.startswith("__")])


def next_sale_weeks(series: DataFrame, max_weeks: int, key: str = "sku") -> DataFrame:
    """Weeks to the next sale from each day on, right-censored at the end."""
    # the next sale is the last one seen when days are read backwards
    w = Window.partitionBy(key).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    nxt = F.last(F.when(F.col("qty") > 0, F.col("pos")), ignorenulls=True).over(w)
    weeks = F.coalesce(F.floor((nxt - F.col("pos")) / 7) + 1, F.floor((F.col("n") - F.col("pos")) / 7))
    seen = nxt.isNotNull() & (weeks <= max_weeks)
    return series.withColumn("weeks", F.least(weeks, F.lit(max_weeks))).withColumn("observed", seen.cast("int"))


def share_of_group(daily: DataFrame, cut_day, window: int, group: str, item: str) -> DataFrame:
    """Item share of its group in a trailing window; equal split at zero."""
    recent = (F.col("day") <= cut_day) & (F.col("day") > F.date_sub(cut_day, window))
    units = daily.groupBy(group, item).agg(F.sum(F.when(recent, F.col("qty")).otherwise(0.0)).alias("units"))
    tot = units.groupBy(group).agg(F.sum("units").alias("total"), F.count("*").alias("members"))
    return units.join(tot, group).withColumn(
        "share", F.when(F.col("total") > 0, F.col("units") / F.col("total")).otherwise(1 / F.col("members")))
