"""Grouped summaries of the star."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import half_even

from tallyloom.operators.filters import drop_censored


def modal_value(df: DataFrame, key: str | list[str], value: str) -> DataFrame:
    """Most frequent non-null value per key, smallest value on ties.

    Two partial aggregations: counts per (key, value), then the best count.
    """
    keys = [key] if isinstance(key, str) else key
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    top = counts.groupBy(*keys).agg(F.max("__c").alias("__m"))
    return (counts.join(top, keys).filter(F.col("__c") == F.col("__m"))
            .groupBy(*keys).agg(F.min(value).alias(value)))


def weighted_units() -> Column:
    """Imputed rows count half."""
    return F.when(F.col("imputation_flag") == 1, F.col("quantity_sold") * 0.5).otherwise(F.col("quantity_sold"))


def product_stats(sale: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return sale.groupBy(*(keys or ["product_id"])).agg(
        F.sum("quantity_sold").alias("total_units"),
        F.countDistinct("day").alias("observed_days"),
        F.countDistinct(F.when(F.col("is_censored") == 1, F.col("day"))).alias("censored_days"),
        F.sum(weighted_units()).alias("weighted_units"),
        F.min("day").alias("first_sale"), F.max("day").alias("last_sale"))


def catalog_stats(sale: DataFrame) -> DataFrame:
    s = product_stats(sale)
    active = F.col("observed_days") - F.col("censored_days")
    return s.withColumn("active_tally_dates", active).withColumn(
        "adus", F.when(active > 0, half_even(F.col("weighted_units") / active, 4)).otherwise(F.lit(0.0)))


def monthly(sale: DataFrame, keys: list[str]) -> DataFrame:
    return sale.groupBy(*keys, F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.sum("quantity_sold").alias("units"), F.countDistinct("day").alias("tally_days"))


def monthly_cv(month_units: DataFrame, keys: list[str]) -> DataFrame:
    g = month_units.groupBy(*keys).agg(F.avg("units").alias("mean_month"),
                                       F.stddev_pop("units").alias("sigma_month"))
    return g.withColumn("cv_pct", F.when(F.col("mean_month") > 0,
                                         F.col("sigma_month") / F.col("mean_month") * 100).otherwise(F.lit(0.0)))


def pesos(units: Column, price: Column, entry_units: Column, entry_php: Column) -> Column:
    """Own-priced units at their own price, the rest at the listed price.

    NULL when there is neither a listed nor an own price.
    """
    return (F.when(price.isNotNull(), (units - entry_units) * price + entry_php)
            .when(entry_units > 0, entry_php))


def own_price_totals(priced_sale: DataFrame, keys: list[str]) -> DataFrame:
    """``priced_sale`` carries ``own_price``, NULL where the sheet price holds."""
    own = F.col("own_price")
    return priced_sale.groupBy(*keys).agg(
        F.sum("quantity_sold").alias("units"),
        F.sum(F.when(own.isNotNull(), F.col("quantity_sold")).otherwise(0)).alias("entry_units"),
        F.sum(F.coalesce(F.col("quantity_sold") * own, F.lit(0.0))).alias("entry_php"),
        F.countDistinct(own).alias("entry_prices"))


def fsn_base(fact: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Inputs of the speed class per item, from all sale rows."""
    keys = keys or ["product_id"]
    kept = ~F.col("is_censored").eqNullSafe(1)
    return fact.groupBy(*keys).agg(
        F.sum(F.when(kept, weighted_units())).alias("weighted_units"),
        F.sum(F.when(kept, F.col("quantity_sold"))).alias("units"),
        F.countDistinct(F.when(kept, F.col("day"))).alias("active_tally_dates"),
        F.max(F.when(F.col("quantity_sold") > 0, F.col("day"))).alias("last_sold"))


def gini(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Gini coefficient of ``value`` per key, in closed form over ranks."""
    w = Window.partitionBy(*keys).orderBy(value)
    r = df.withColumn("__i", F.row_number().over(w))
    n, s = F.count("*"), F.sum(value)
    return r.groupBy(*keys).agg(F.when(
        s > 0, (2 * F.sum(F.col("__i") * F.col(value)) - (n + 1) * s) / (n * s)).otherwise(0.0).alias("gini"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["drop_censored"]
