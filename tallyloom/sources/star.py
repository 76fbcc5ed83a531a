"""The retail star schema, derived from the TPC-H-like input tables.

Nothing here is cached or collected: every property is a lazy DataFrame, so a
query reads only the columns and rows it needs.

* ``fact``      one row per recorded item-day line, zero rows included
* ``product``   one row per item; grows with the data, never hint-broadcast
* ``calendar``  one row per day between the first and last fact year; its size
                is bounded by the number of days, so it may be broadcast
* ``series``    dense daily units per product line (brand x type)
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.calendar import term_columns, flag_columns

# The kind of goods appended to an item's name.
GOODS = (
    "shirt", "jacket", "tote bag", "mug", "lanyard", "keychain", "ballpen", "plush toy",
    "scarf", "umbrella", "clock", "voucher", "embro shirt", "hoodie", "polo", "sticker set",
    "thing",
)


def goods_word(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(g) for g in GOODS]), (key % len(GOODS) + 1).cast("int"))


class Star:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    # ------------------------------------------------------------- facts
    @cached_property
    def fact(self) -> DataFrame:
        units = F.when(
            (F.col("l_discount") >= 0.1) | (F.col("l_partkey") % 97 == 0), F.lit(0)
        ).otherwise(F.col("l_quantity"))
        return self.table("lineitem").select(
            F.col("l_partkey").alias("product_id"),
            F.to_date("l_shipdate").alias("day"),
            units.cast("long").alias("quantity_sold"),
            F.when(F.col("l_linenumber") == 7, F.lit(None))
            .when(F.col("l_returnflag") == "R", "Damaged")
            .otherwise("SALE").alias("transaction_type"),
            F.when(F.col("l_quantity") >= 48, "bulk")
            .when(F.col("l_linenumber") == 6, "pre_order").alias("order_type"),
            (F.col("l_linenumber") % 4 == 0).cast("int").alias("imputation_flag"),
            F.when(F.col("l_orderkey") % 3 == 1, 0)
            .when(F.col("l_orderkey") % 3 == 2, 1).alias("is_censored"),
            F.when(F.col("l_linenumber") == 2, F.floor(F.col("l_extendedprice") / F.col("l_quantity")))
            .cast("double").alias("entry_price_php"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_extendedprice").alias("amount"),
        )

    @cached_property
    def sale(self) -> DataFrame:
        from tallyloom.operators.filters import sales_only

        return sales_only(self.fact)

    @cached_property
    def walkin(self) -> DataFrame:
        from tallyloom.operators.filters import walk_in_only

        return walk_in_only(self.sale)

    # -------------------------------------------------------- dimensions
    @cached_property
    def product(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("product_id"),
            F.concat_ws(" ", "p_name", goods_word(key), F.concat(F.lit("#"), key)).alias("item_name"),
            F.col("p_name").alias("base_name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            F.concat_ws("|", "p_brand", "p_type").alias("sku"),
            F.when(key % 11 != 0, F.col("p_retailprice")).alias("unit_price_php"),
            F.when(key % 13 != 0, F.element_at(
                F.array(F.lit("Paid"), F.lit("Consignment")), (F.col("p_size") % 2 + 1).cast("int"))
            ).alias("payment_status"),
            F.element_at(F.array(F.lit(14), F.lit(18), F.lit(28)), (key % 3 + 1).cast("int"))
            .alias("lead_time_days"),
            F.date_add(F.lit("1995-01-01").cast("date"), ((key * 37) % 2500).cast("int")).alias("entry_date"),
            (key % 41 == 0).cast("int").alias("discontinued"),
            (key % 59 != 0).cast("int").alias("is_active"),
        )

    @cached_property
    def product_supplier(self) -> DataFrame:
        """Most frequent supplier per item; ties go to the smallest key."""
        from tallyloom.operators.aggregates import modal_value

        modal = modal_value(self.fact, "product_id", "supplier_id")
        names = self.table("supplier").select(
            F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name"))
        return modal.join(names, "supplier_id").select("product_id", "supplier_id", "supplier_name")

    @cached_property
    def product_full(self) -> DataFrame:
        return self.product.join(self.product_supplier, "product_id", "left")

    @cached_property
    def span(self) -> DataFrame:
        return self.fact.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))

    def mark(self, name: str) -> Column:
        """A day that follows from the recorded span: first of the ``middle`` or of the ``newest`` month, or the ``first_day``."""
        half = F.floor(F.datediff("last_day", "first_day") / 2).cast("int")
        at = {"middle": F.trunc(F.date_add("first_day", half), "month"), "newest": F.trunc("last_day", "month"), "first_day": F.col("first_day")}[name]
        return self.span.select(at).scalar()

    @cached_property
    def calendar(self) -> DataFrame:
        days = self.span.select(
            F.explode(F.sequence(F.trunc("first_day", "year"),
                                 F.last_day(F.add_months(F.trunc("last_day", "year"), 11)))).alias("day"))
        return days.select("day", *flag_columns(F.col("day")), *term_columns(F.col("day")))

    @cached_property
    def calendar_ranges(self) -> DataFrame:
        """The special periods as published: name, flag, start, end, term."""
        from tallyloom.sources.published import calendar_ranges

        return calendar_ranges(self.span)

    @cached_property
    def closure_log(self) -> DataFrame:
        from tallyloom.sources.published import closure_log

        return closure_log(self.span)

    @cached_property
    def event_log(self) -> DataFrame:
        from tallyloom.sources.published import event_log

        return event_log(self.span)

    # ------------------------------------------------------ side tables
    @cached_property
    def price_change(self) -> DataFrame:
        key = F.col("product_id")
        base = self.product.filter(key % 5 == 0)
        first = base.select(
            (key * 2).alias("change_id"), "product_id",
            F.lit("1998-06-01").cast("date").alias("effective_from"),
            F.floor(F.lit(500) + key % 300).cast("double").alias("price_php"))
        second = base.filter(key % 10 == 0).select(
            (key * 2 + 1).alias("change_id"), "product_id",
            F.lit("2000-03-15").cast("date").alias("effective_from"),
            F.floor(F.lit(650) + key % 200).cast("double").alias("price_php"))
        return first.unionByName(second)

    @cached_property
    def product_months(self) -> DataFrame:
        return self.fact.select(
            "product_id", F.trunc("day", "month").alias("month_start")).distinct()

    def _counts(self) -> DataFrame:
        n = F.year("month_start") * 12 + F.month("month_start") - 1
        return self.product_months.select(
            "product_id", "month_start", n.alias("month_no"),
            ((F.col("product_id") * 7 + n * 13) % 90).cast("long").alias("quantity"))

    @cached_property
    def workbook_count(self) -> DataFrame:
        """Monthly counts from the historical sheet, not in every month."""
        return self._counts().filter((F.col("product_id") + F.col("month_no")) % 4 != 0).select(
            "product_id", F.date_format("month_start", "yyyy-MM").alias("month"), "quantity")

    @cached_property
    def staff_count(self) -> DataFrame:
        """Monthly counts typed in by staff for some items."""
        return self._counts().filter((F.col("product_id") + F.col("month_no")) % 3 == 0).select(
            "product_id", F.date_format("month_start", "yyyy-MM").alias("month"),
            (F.col("quantity") + 5).alias("quantity"))

    @cached_property
    def restock_log(self) -> DataFrame:
        o = self.table("orders")
        lag = (F.col("o_orderkey") * 31 % 23 + 5).cast("int")
        return o.select(
            (F.col("o_custkey") % 100).alias("supplier_id"),
            F.to_date("o_orderdate").alias("ordered_on"),
            F.when(F.col("o_orderkey") % 6 != 0, F.date_add(F.to_date("o_orderdate"), lag)).alias("delivered_on"))

    @cached_property
    def upcoming_order(self) -> DataFrame:
        """Orders already promised for a day soon after the history ends."""
        key = F.col("product_id")
        return self.product.select(
            "product_id", "sku", "category",
            F.date_add(self.span.select("last_day").scalar(), (key % 30 + 1).cast("int")).alias("expected_date"),
            (key % 9 + 1).cast("long").alias("quantity"))

    # ----------------------------------------------------------- series
    @cached_property
    def sku_day(self) -> DataFrame:
        """Units per product line and day, recorded days only."""
        p = self.product.select("product_id", "sku", "category")
        # item days first: a hot item joins as one row per day
        days = self.walkin.groupBy("product_id", "day").agg(F.sum("quantity_sold").alias("units"))
        return days.join(p, "product_id").groupBy("sku", "category", "day").agg(F.sum("units").cast("double").alias("qty"))

    @cached_property
    def series(self) -> DataFrame:
        from tallyloom.operators.series import densify

        return densify(self.sku_day, ["sku", "category"])

    @cached_property
    def category_series(self) -> DataFrame:
        from tallyloom.operators.series import densify

        return densify(self.sku_day.groupBy("category", "day").agg(F.sum("qty").alias("qty")), ["category"])


def month_key(day: Column | str) -> Column:
    return F.date_format(day, "yyyy-MM")


__all__ = ["Star", "month_key", "GOODS", "Window"]
