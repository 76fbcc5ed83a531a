"""Reading and cleaning tally sheets and other source files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.scale import carry_forward

DENSE_SHARE = 0.7


def string_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv_strict(spark: SparkSession, path: str, columns: list[str],
                    rename: dict[str, str] | None = None) -> DataFrame:
    """All columns as strings, with a stable ``row_order`` inside each file."""
    df = spark.read.schema(string_schema(columns)).option("enforceSchema", False).csv(path, header=True)
    df = df.withColumn("row_order", F.monotonically_increasing_id())
    return df.withColumnsRenamed(rename or {})


def norm_header(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def normalize_headers(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Match columns by letters and digits; the first non-blank alias wins."""
    by_key: dict[str, str] = {}
    for c in df.columns:
        by_key.setdefault(norm_header(c), c)
    out = []
    for target, aliases in wanted.items():
        found = [by_key[norm_header(a)] for a in aliases if norm_header(a) in by_key]
        parts = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in found]
        out.append((F.coalesce(*parts) if parts else F.lit(None).cast("string")).alias(target))
    return df.select(*out)


def optional_column(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype).alias(name)


def unpivot_tally(wide: DataFrame, ids: list[str], date_columns: list[str]) -> DataFrame:
    """Wide sheet to long rows; repeated (ids, date) cells are summed."""
    long = wide.unpivot(ids, date_columns, "date_label", "qty").filter(F.col("qty").isNotNull())
    return long.groupBy(*ids, "date_label").agg(F.sum("qty").alias("qty"))


def carry_section(rows: DataFrame, sheet: str, order: str, label: str, has_data: Column) -> DataFrame:
    """A labelled row without data is a band that names the rows below it."""
    banded = rows.withColumn("__band", F.when(~has_data & F.col(label).isNotNull(), F.col(label)))
    return carry_forward(banded, [sheet], order, "__band", "section").drop("__band").filter(has_data)


def sheet_density(cells: DataFrame, sheet: list[str], date: str = "day") -> DataFrame:
    """Tallied dates over the days of the month, per month sheet."""
    g = cells.groupBy(*sheet).agg(F.countDistinct(date).alias("n_dates"), F.max(date).alias("__d"))
    density = F.col("n_dates") / F.dayofmonth(F.last_day("__d"))
    return g.select(*sheet, "n_dates", density.alias("density"), (density >= DENSE_SHARE).cast("int").alias("is_dense"))


def zero_fill_dense(cells: DataFrame, sheet: list[str], item: str) -> DataFrame:
    """Blank cells are zero sales in dense sheets and unknown in sparse ones.

    The item x date grid is exploded from each sheet's own date list, which
    has at most 31 entries.
    """
    dense = sheet_density(cells, sheet)
    dates = cells.groupBy(*sheet).agg(F.collect_set("day").alias("__dates"))
    grid = (cells.select(*sheet, item).distinct().join(dates, sheet)
            .join(dense.filter("is_dense = 1").select(*sheet), sheet, "left_semi")
            .select(*sheet, item, F.explode("__dates").alias("day"), F.lit(None).cast("long").alias("qty")))
    both = grid.unionByName(cells.select(*sheet, item, "day", "qty"))
    return both.groupBy(*sheet, item, "day").agg(F.coalesce(F.sum("qty"), F.lit(0)).alias("qty"))


def drop_untallied_tail(cells: DataFrame, month: str, date: str, qty: str) -> DataFrame:
    """In the newest month, drop days after the last one with a filled cell."""
    newest = cells.agg(F.max(month)).scalar()
    last = cells.agg(F.max_by(F.col(month), F.col(month)), F.max(
        F.when(F.col(qty).isNotNull(), F.struct(F.col(month), F.col(date)))).alias("m")).select("m").scalar()
    last_day = F.when(last[month] == newest, last[date])
    return cells.filter((F.col(month) < newest) | last_day.isNull() | (F.col(date) <= last_day))


def newest_file_wins(found: DataFrame, month: str, path: str, modified: str) -> DataFrame:
    """The file that owns each month: most recently modified, then path."""
    return found.groupBy(month).agg(
        F.max_by(path, F.struct(modified, path)).alias(path),
        F.countDistinct(path).alias("n_files"))


def impute_dates(columns: DataFrame, sheet: list[str], order: str, date: str) -> DataFrame:
    """Give an undated column the midpoint of its neighbours, else the
    month's median day."""
    w = Window.partitionBy(*sheet).orderBy(order)
    day = F.dayofmonth(date)
    left = F.last(day, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(day, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    anchor = columns.groupBy(*sheet).agg(F.min(date).alias("__first"), F.percentile(day, 0.5).alias("__med"))
    df = columns.withColumn("__l", left).withColumn("__r", right).join(anchor, sheet)
    half_up = F.floor(F.coalesce((F.col("__l") + F.col("__r")) / 2, F.col("__med")) + 0.5)
    clamped = F.least(F.greatest(half_up, F.lit(1)), F.dayofmonth(F.last_day("__first")))
    filled = F.when(F.col(date).isNotNull(), F.col(date)).otherwise(
        F.date_add(F.trunc("__first", "month"), (clamped - 1).cast("int")))
    return df.select(*columns.columns, filled.alias("filled_date"))


def load_reason(qty: Column, name: Column, is_supplier: Column, product_id: Column, day: Column) -> Column:
    """First failing rule of a raw tally row, NULL when it loads."""
    return (F.when(qty.isNull() | (qty < 0), "invalid_or_missing_quantity")
            .when(is_supplier, "item_name_is_supplier_name")
            .when(product_id.isNull(), "item_no_match_in_dim_product")
            .when(day.isNull(), "date_no_match_in_dim_date"))


def write_with_quarantine(judged: DataFrame, path: str) -> None:
    """Write loadable and rejected rows in one pass, to ``sink=loaded`` and ``sink=held`` under ``path``; every row lands in one of them."""
    sink = F.when(F.col("reason").isNull(), "loaded").otherwise("held")
    judged.withColumn("sink", sink).write.mode("overwrite").partitionBy("sink").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def csv_safe(text: Column) -> Column:
    """Neutralise text a spreadsheet would run as a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def write_csv_report(df: DataFrame, path: str) -> None:
    safe = [csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.mode("overwrite").csv(path, header=True)
