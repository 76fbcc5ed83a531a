"""Row filters with the store's demand rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE_MONTHS = {"This Month": 1, "Last 3 Months": 3, "Last 6 Months": 6, "Last 12 Months": 12}
MIN_TIER_DAYS, FULL_TIER_DAYS = 30, 60
DISCONTINUED_AFTER_DAYS = 365


def is_sale() -> Column:
    return F.lower(F.coalesce(F.col("transaction_type"), F.lit("sale"))) == "sale"


def sales_only(fact: DataFrame) -> DataFrame:
    return fact.filter(is_sale())


def walk_in_only(fact: DataFrame) -> DataFrame:
    """Everyday demand; a source without order types is all walk-in."""
    if "order_type" not in fact.columns:
        return fact
    return fact.filter(F.coalesce(F.col("order_type"), F.lit("walk_in")) == "walk_in")


def drop_censored(fact: DataFrame) -> DataFrame:
    return fact.filter(~F.col("is_censored").eqNullSafe(1))


def match_catalog(products: DataFrame, supplier: str | None = None, category: str | None = None) -> DataFrame:
    if supplier and supplier != "All Suppliers":
        products = products.filter(F.col("supplier_name") == supplier)
    if category and category != "All Categories":
        products = products.filter(F.col("category") == category)
    return products


def range_cutoff(fact: DataFrame, n_months: int) -> DataFrame:
    """First month of the last ``n_months`` months that carry data (one row)."""
    months = fact.select(F.date_format("day", "yyyy-MM").alias("month")).distinct()
    # month keys are few, so sorting the distinct ones is cheap
    return months.orderBy(F.desc("month")).limit(n_months).agg(F.min("month").alias("cutoff"))


def in_range(fact: DataFrame, date_range: str, start: str | None = None, end: str | None = None) -> DataFrame:
    month = F.date_format("day", "yyyy-MM")
    if date_range == "Custom Range":
        if start and end and start > end:
            start, end = end, start
        if start:
            fact = fact.filter(month >= start)
        if end:
            fact = fact.filter(month <= end)
        return fact
    if date_range not in RANGE_MONTHS:
        return fact
    return fact.filter(month >= range_cutoff(fact, RANGE_MONTHS[date_range]).scalar())


def sufficiency_tier(n_days: Column) -> Column:
    return (F.when(n_days >= FULL_TIER_DAYS, "full").when(n_days >= MIN_TIER_DAYS, "limited")
            .otherwise("insufficient"))


def discontinued_on(last_sale: Column, ref: Column) -> Column:
    gap = F.datediff(ref, last_sale)
    return (last_sale.isNull() | (gap >= DISCONTINUED_AFTER_DAYS)).cast("int")
