"""Joins with the store's matching rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import fold_name
from tallyloom.operators.scale import spread

MAX_STALE_MONTHS = 1
LAST_YEAR_SEARCH_DAYS = 60


def map_names(rows: DataFrame, name: str, mapping: DataFrame) -> DataFrame:
    """Exact raw name, else its case- and space-folded form, else NULL.

    ``mapping`` has ``raw_name`` and ``canonical``. A folded key with several
    raw spellings takes the last one in raw-name order, so each input row
    keeps exactly one output row.
    """
    exact = mapping.select(F.col("raw_name").alias("__n"), F.col("canonical").alias("__exact"))
    folded = mapping.groupBy(fold_name(F.col("raw_name")).alias("__k")).agg(
        F.max_by("canonical", "raw_name").alias("__fold"))
    trimmed = F.trim(F.col(name))
    return (rows.withColumn("__n", trimmed).join(exact, "__n", "left")
            .withColumn("__k", fold_name(F.col(name))).join(folded, "__k", "left")
            .withColumn("canonical", F.coalesce("__exact", "__fold"))
            .drop("__n", "__k", "__exact", "__fold"))


def unambiguous(mapping: DataFrame, key: Column) -> DataFrame:
    """Keys that lead to exactly one canonical name."""
    return mapping.groupBy(key.alias("key")).agg(
        F.countDistinct("canonical").alias("__c"), F.min("canonical").alias("canonical")
    ).filter("__c = 1").drop("__c")


def explode_ranges(ranges: DataFrame, flags: list[str]) -> DataFrame:
    """[start, end] ranges to one row per day with OR-ed 0/1 flags.

    Ranges are short, so they are exploded to days and joined by equality.
    """
    days = ranges.select("flag", F.explode(F.sequence("start_date", "end_date")).alias("day"))
    return days.groupBy("day").agg(*[
        F.max((F.col("flag") == f).cast("int")).alias(f) for f in flags])


def term_windows(ranges: DataFrame) -> DataFrame:
    """Each term ends the day before the next one starts."""
    starts = ranges.filter(F.col("semester_id").isNotNull()).groupBy("semester_id").agg(
        F.min("start_date").alias("term_start"))
    nxt = F.lead("term_start").over(Window.orderBy("term_start"))  # a handful of terms
    return starts.withColumn("term_end", F.date_sub(nxt, 1))


def assign_terms(days: DataFrame, terms: DataFrame, last_day: Column) -> DataFrame:
    t = terms.select("semester_id", "term_start",
                     F.explode(F.sequence("term_start", F.coalesce("term_end", last_day))).alias("day"))
    return days.join(F.broadcast(t), "day", "left").withColumn(
        "semester_week", (F.floor(F.datediff("day", "term_start") / 7) + 1).cast("int"))


def price_in_force(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds ``price_in_force``: the latest change on or before the row's day.

    Changes are folded to one array of (from, id, price) per item, newest
    first, so a row needs one equality join and its row count never changes.
    The array holds one item's price history, which is a few entries.
    """
    per_item = changes.groupBy("product_id").agg(F.sort_array(F.collect_list(
        F.struct("effective_from", "change_id", "price_php")), asc=False).alias("__pc"))
    joined = rows.join(per_item, "product_id", "left")
    hit = F.filter("__pc", lambda c: c["effective_from"] <= F.col("day"))
    return joined.withColumn("price_in_force", F.get(hit, F.lit(0))["price_php"]).drop("__pc")


def with_own_price(sale: DataFrame, changes: DataFrame) -> DataFrame:
    return price_in_force(sale, changes).withColumn(
        "own_price", F.coalesce("entry_price_php", "price_in_force"))


def nearest_month_stock(asked: DataFrame, stock: DataFrame) -> DataFrame:
    """Stock of the asked month, else of the nearest month, else 0.

    ``asked``: product_id, month_no; ``stock``: product_id, month_no, quantity.
    Both sides are stacked and sorted per item; the nearest known month is the
    last one before or the first one after. An earlier month wins a tie.
    """
    both = (asked.select("product_id", "month_no", F.lit(None).cast("double").alias("q"), F.lit(1).alias("asked"))
            .unionByName(stock.select("product_id", "month_no", F.col("quantity").cast("double").alias("q"), F.lit(0).alias("asked"))))
    # the sums and both windows run in the partitions of one exchange
    day = spread(both, "product_id").groupBy("product_id", "month_no").agg(F.sum("q").alias("q"), F.max("asked").alias("asked"))
    point = F.when(F.col("q").isNotNull(), F.struct("month_no", "q"))
    w = Window.partitionBy("product_id").orderBy("month_no")
    day = day.withColumn("__p", F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ahead_w = Window.partitionBy("product_id").orderBy(F.desc("month_no"))
    day = day.withColumn("__f", F.last(point, ignorenulls=True).over(ahead_w.rowsBetween(Window.unboundedPreceding, 0)))
    back = F.col("month_no") - F.col("__p.month_no")
    ahead = F.col("__f.month_no") - F.col("month_no")
    use_back = F.col("__p").isNotNull() & (F.col("__f").isNull() | (back <= ahead))
    return day.filter("asked = 1").select(
        "product_id", "month_no",
        F.when(use_back, F.col("__p.q")).when(F.col("__f").isNotNull(), F.col("__f.q")).otherwise(0.0).alias("weight"),
        F.when(use_back & (back == 0), "exact_month")
        .when(use_back, F.concat(F.lit("nearest_month(-"), back, F.lit("mo)")))
        .when(F.col("__f").isNotNull(), F.concat(F.lit("nearest_month(+"), ahead, F.lit("mo)")))
        .otherwise("no_inventory").alias("basis"))


def opening_stock(asked: DataFrame, stock: DataFrame, max_stale: int = MAX_STALE_MONTHS) -> DataFrame:
    """Latest count at or before the month, at most ``max_stale`` months old.

    The look-back is short, so each count is offered to the months it may
    serve and the newest offer wins.
    """
    offers = stock.select("product_id", F.col("month_no").alias("count_month"), "quantity").withColumn(
        "month_no", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_stale)),
                                          lambda k: k + F.col("count_month"))))
    best = offers.groupBy("product_id", "month_no").agg(
        F.max_by("quantity", "count_month").alias("opening"), F.max("count_month").alias("count_month"))
    return asked.join(best, ["product_id", "month_no"], "left")


def latest_stock(workbook: DataFrame, staff: DataFrame) -> DataFrame:
    """Newest count per item; the staff count wins when both have that month."""
    both = workbook.select("product_id", "month", "quantity", F.lit(0).alias("pri")).unionByName(
        staff.select("product_id", "month", "quantity", F.lit(1).alias("pri")))
    best = both.groupBy("product_id").agg(
        F.max_by(F.struct("quantity", "month", "pri"), F.struct("month", "pri")).alias("b"))
    return best.select("product_id", F.col("b.quantity").alias("current_stock"), F.col("b.month").alias("stock_as_of"),
                       F.when(F.col("b.pri") == 1, "counted").otherwise("workbook").alias("stock_source"))


def stock_history(workbook: DataFrame, staff: DataFrame) -> DataFrame:
    a = workbook.select("product_id", "month", F.col("quantity").alias("wq"))
    b = staff.select("product_id", "month", F.col("quantity").alias("sq"))
    return a.join(b, ["product_id", "month"], "full").select(
        "product_id", "month", F.coalesce("sq", "wq").alias("qty"),
        F.when(F.col("sq").isNotNull(), "counted").otherwise("workbook").alias("source"))


def clip_overlaps(entries: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Entries overlapping [lo, hi], clipped to it, one per folded name."""
    clean = F.trim(F.regexp_replace("event_name", r"\(date uncertain[^)]*\)", ""))
    kept = entries.withColumn("name", clean).filter(
        (F.col("name") != "") & (F.col("start_date") <= hi) & (F.col("end_date") >= lo))
    clipped = kept.select("kind", "name", F.greatest("start_date", lo).alias("start_day"),
                          F.least("end_date", hi).alias("end_day"))
    return clipped.groupBy("start_day", "end_day", F.lower("name").alias("folded")).agg(
        F.max_by(F.struct("name", "kind"), F.struct("kind", "name")).alias("m")).select(
        "start_day", "end_day", "m.name", "m.kind")


def month_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Months in which two versions of a fact differ."""
    def m(df, name):
        return df.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("quantity_sold").alias(name))

    j = m(a, "old_units").join(m(b, "new_units"), "month", "full")
    d = F.coalesce("new_units", F.lit(0)) - F.coalesce("old_units", F.lit(0))
    return j.withColumn("delta", d).filter("delta <> 0")


def apply_corrections(rows: DataFrame, corrections: DataFrame, key: list[str], row_order: list[str]) -> DataFrame:
    """Match the n-th correction of a key to its n-th free row.

    Corrections per key are few, so rows are numbered only for keys that have
    a correction; every other row passes through untouched.
    """
    hit_keys = corrections.select(*key).distinct()
    same = [rows[k].eqNullSafe(hit_keys[k]) for k in key]
    touched = rows.join(hit_keys, same, "left_semi")
    rest = rows.join(hit_keys, same, "left_anti")
    n_row = touched.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*row_order)))
    n_cor = corrections.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy("correction_id")))
    j = n_row.join(n_cor, [*key, "__rn"], "left").filter(F.coalesce("is_deleted", F.lit(0)) == 0)
    fixed = j.select(*[
        F.coalesce("new_" + c, c).alias(c) if "new_" + c in corrections.columns else F.col(c) for c in rows.columns
    ], "correction_id")
    return rest.withColumn("correction_id", F.lit(None).cast("long")).select(*fixed.columns).unionByName(fixed)


def nearest_last_year(runs: DataFrame, windows: DataFrame, last_sale: Column) -> DataFrame:
    """The finished run that starts nearest to a year before each window.

    Candidates are found by equality on the day offset: each window is offered
    to every start day within the search distance, so nothing is cross joined.
    """
    target = F.date_sub("start_day", 365)
    offers = windows.select("*", target.alias("target")).withColumn(
        "run_start", F.explode(F.sequence(F.date_sub("target", LAST_YEAR_SEARCH_DAYS),
                                          F.date_add("target", LAST_YEAR_SEARCH_DAYS))))
    past = runs.select(F.col("kind"), F.col("run_start"), F.col("run_end")).filter(F.col("run_end") <= last_sale)
    hits = offers.join(past, ["kind", "run_start"])
    best = hits.groupBy("kind", "start_day").agg(F.min_by(
        F.struct("run_start", "run_end"), F.struct(F.abs(F.datediff("run_start", "target")), "run_start")).alias("r"))
    out = windows.join(best, ["kind", "start_day"], "left")
    s, e = F.date_sub("start_day", 364), F.date_sub("end_day", 364)
    return out.select(
        "kind", "start_day", "end_day",
        F.coalesce(F.col("r.run_start"), F.when(e <= last_sale, s)).alias("ly_start"),
        F.coalesce(F.col("r.run_end"), F.when(e <= last_sale, e)).alias("ly_end"))
