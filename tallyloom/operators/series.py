"""Daily demand series.

A series has one row per key and day of the shared history, so position
``pos`` means the same day for every key; ``n`` is the history's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _key_spans(daily: DataFrame, keys: list[str]) -> DataFrame:
    return daily.groupBy(*keys).agg(
        F.min("day").alias("__a"), F.max(F.when(F.col("qty") > 0, F.col("day"))).alias("__z"))


def history(daily: DataFrame, keys: list[str]) -> DataFrame:
    """First recorded day and last day anything sold (one row)."""
    return _key_spans(daily, keys).agg(F.min("__a").alias("d0"), F.max("__z").alias("d1"))


def densify(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Every key on every day of the history, zero-filled.

    Days are exploded per key, the recorded units are unioned in, and one
    aggregation on (key, day) builds the grid; nothing is cross joined. The
    key spans and the recorded rows read the same daily aggregate, which Spark
    computes once (the exchange is reused). ``daily`` has one row per key and
    day.
    """
    bounds = history(daily, keys).select(F.struct("d0", "d1")).scalar()
    grid = _key_spans(daily, keys).withColumn("__h", bounds)
    grid = grid.select(*keys, (F.datediff("__h.d1", "__h.d0") + 1).alias("n"),
                       F.posexplode(F.sequence("__h.d0", "__h.d1")).alias("pos", "day"), F.lit(0.0).alias("qty"))
    none = F.lit(None).cast("int")
    rows = daily.select(*keys, none.alias("n"), none.alias("pos"), "day", F.col("qty").cast("double").alias("qty"))
    out = grid.unionByName(rows).groupBy(*keys, "day").agg(
        F.max("pos").alias("pos"), F.sum("qty").alias("qty"), F.max("n").alias("n"))
    # recorded days outside the history (trailing zeros) have no grid row
    return out.filter(F.col("pos").isNotNull())


def trim_to_history(series: DataFrame) -> DataFrame:
    """Days up to the last one on which anything was sold."""
    last = series.agg(F.max(F.when(F.col("qty") > 0, F.col("day"))).alias("__last"))
    # one row on the right
    return series.join(F.broadcast(last), F.col("day") <= F.col("__last")).drop("__last")


def trading_days(series: DataFrame, tally_days: DataFrame, key: str = "sku") -> DataFrame:
    """Keep tallied days only and renumber positions."""
    kept = series.join(F.broadcast(tally_days.select("day").distinct()), "day", "left_semi")
    w = Window.partitionBy(key).orderBy("day")
    return kept.withColumn("pos", F.row_number().over(w) - 1).withColumn(
        "n", F.count("*").over(Window.partitionBy(key)))


def observed_mask(calendar: DataFrame, fact: DataFrame) -> DataFrame:
    """A day is evidence when it has a fact row, is a break or is a closure."""
    seen = fact.select("day").distinct().withColumn("seen", F.lit(1))
    return calendar.join(seen, "day", "left").select(
        "day", F.greatest(F.coalesce("seen", F.lit(0)), F.coalesce("is_sem_break", F.lit(0)),
                          F.coalesce("is_store_closed", F.lit(0))).alias("observed"))


def blocks(series: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """Non-overlapping sums of ``size`` days aligned to the end of the series."""
    back = F.floor((F.col("n") - 1 - F.col("pos")) / size)
    return (series.withColumn("back", back).filter(F.col("back") < F.floor(F.col("n") / size))
            .groupBy(*keys, "back").agg(F.sum("qty").alias("units")))


def extend_history(daily: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Prepend labelled earlier history; uncovered days between are gaps.

    Both inputs have one row per key and recorded day.
    """
    edge = daily.agg(F.min("day").alias("first_real"))
    # one row on the right: a range condition against a single date
    early = extra.join(F.broadcast(edge), F.col("day") < F.col("first_real")).select(*keys, "day", "qty")
    dense = densify(early.unionByName(daily.select(*keys, "day", "qty")), keys)
    synthetic = F.col("day") < edge.scalar()
    gap = synthetic & (F.col("day") > extra.agg(F.max("day")).scalar())
    return dense.select(*keys, "day", "pos", "qty", "n", synthetic.cast("int").alias("is_synthetic"), gap.cast("int").alias("is_gap"))


def winsorise_bulk(series: DataFrame, k: float, key: str = "sku") -> DataFrame:
    """Days above ``k`` times the median selling day become that median."""
    med = series.groupBy(key).agg(F.percentile(F.when(F.col("qty") > 0, F.col("qty")), 0.5).alias("med"))
    return series.join(med, key).withColumn(
        "qty", F.when(F.col("qty") > k * F.col("med"), F.col("med")).otherwise(F.col("qty"))).drop("med")
