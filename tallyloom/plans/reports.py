"""Sales, stock and forecast reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numbers import half_even
from tallyloom.operators import aggregates as A
from tallyloom.operators import joins as J
from tallyloom.operators import windows as W
from tallyloom.plans import aggregates as PA
from tallyloom.plans import policy as PP
from tallyloom.plans.classify import FSN_SQL, STATS_SQL
from tallyloom.plans.joins import STOCK_SQL
from tallyloom.plans.methods import CATPUB_SQL, publish_categories
from tallyloom.plans.registry import plan
from tallyloom.plans.windows import _PHP
from tallyloom.sources.star import month_key


def supplier_lines(sale: DataFrame, products: DataFrame) -> DataFrame:
    """Item lines, supplier subtotals and the grand total in one pass.

    Sales are summed per item before the rollup, so the rollup expands one row
    per item rather than one per sale.
    """
    per_item = sale.groupBy("product_id").agg(F.sum("quantity_sold").alias("units"))
    rows = per_item.join(products, "product_id").select(
        F.coalesce("supplier_name", F.lit("Unattributed")).alias("supplier"), F.col("item_name").alias("item"),
        "units", (F.col("units") * F.col("unit_price_php")).alias("line_total"))
    out = rows.rollup("supplier", "item").agg(
        F.sum("units").alias("units"), F.sum("line_total").alias("line_total"),
        F.grouping("supplier").alias("gs"), F.grouping("item").alias("gi"))
    return out.select(
        F.when(F.col("gs") == 1, "GRAND TOTAL").when(F.col("gi") == 1, F.concat(F.lit("SUBTOTAL - "), "supplier"))
        .otherwise(F.col("supplier")).alias("supplier"), "item", "units", "line_total",
        (F.col("gs") + F.col("gi")).alias("row_kind"))


@plan("rep_catalog", "product_id:l category:s current_price:d2 total_units:l adus:d4 avg_monthly:d1 cv:d1 current_stock:l stock_source:s revenue:d2 is_active:l has_history:l", _PHP + f""",
st AS ({STATS_SQL}), mo AS (SELECT product_id, round_even(avg(u), 1) AS avg_monthly, CASE WHEN avg(u) > 0 THEN round_even(stddev_pop(u) / avg(u) * 100, 1) ELSE 0 END AS cv FROM (SELECT product_id, strftime(day, '%Y-%m') AS m, sum(quantity_sold) AS u FROM sale GROUP BY ALL) GROUP BY 1),
pc AS (SELECT product_id, arg_max(price_php, (effective_from, change_id)) AS p FROM price_change WHERE effective_from <= (SELECT last_day FROM span) GROUP BY 1)
SELECT p.product_id, category, coalesce(pc.p, unit_price_php) AS current_price, coalesce(total_units, 0) AS total_units, coalesce(adus, 0) AS adus, coalesce(avg_monthly, 0) AS avg_monthly, coalesce(cv, 0) AS cv, current_stock, stock_source, php AS revenue,
CASE WHEN discontinued = 1 THEN 0 ELSE is_active END AS is_active, CASE WHEN st.product_id IS NULL THEN 0 ELSE 1 END AS has_history FROM product p LEFT JOIN st USING (product_id) LEFT JOIN mo USING (product_id) LEFT JOIN pc USING (product_id) LEFT JOIN ip USING (product_id) LEFT JOIN ({STOCK_SQL}) k USING (product_id)""")
def catalog(s):
    today = s.span.select("last_day").scalar()
    price = s.price_change.filter(F.col("effective_from") <= today).groupBy("product_id").agg(F.max_by("price_php", F.struct("effective_from", "change_id")).alias("p"))
    cv = A.monthly_cv(A.monthly(s.sale, ["product_id"]), ["product_id"])
    stats = A.catalog_stats(s.sale).withColumn("seen", F.lit(1))
    j = s.product
    for side in (stats, cv, price, PA.item_pesos(s).select("product_id", "php"), J.latest_stock(s.workbook_count, s.staff_count)):
        j = j.join(side, "product_id", "left")
    zero = F.lit(0)
    return j.select("product_id", "category", F.coalesce("p", "unit_price_php").alias("current_price"), F.coalesce("total_units", zero).alias("total_units"),
                    F.coalesce("adus", zero).alias("adus"), F.coalesce(half_even(F.col("mean_month"), 1), zero).alias("avg_monthly"),
                    F.coalesce(half_even(F.col("cv_pct"), 1), zero).alias("cv"), "current_stock", "stock_source", F.col("php").alias("revenue"),
                    F.when(F.col("discontinued") == 1, 0).otherwise(F.col("is_active")).alias("is_active"), F.coalesce("seen", zero).alias("has_history"))


@plan("rep_meta", "first_day:D last_day:D fact_rows:l sale_rows:l units:l products:l priced_products:l unpriced_units:l", """
SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS fact_rows, count(*) FILTER (lower(coalesce(transaction_type, 'sale')) = 'sale') AS sale_rows, sum(quantity_sold) FILTER (lower(coalesce(transaction_type, 'sale')) = 'sale') AS units,
(SELECT count(*) FROM product) AS products, (SELECT count(unit_price_php) FROM product) AS priced_products, sum(CASE WHEN unit_price_php IS NULL AND entry_price_php IS NULL AND lower(coalesce(transaction_type, 'sale')) = 'sale' THEN quantity_sold ELSE 0 END) AS unpriced_units FROM fact JOIN product USING (product_id)""")
def _(s):
    from tallyloom.operators.filters import is_sale

    sale = is_sale()
    per = s.fact.groupBy("product_id").agg(
        F.min("day").alias("a"), F.max("day").alias("b"), F.count("*").alias("rows"), F.count(F.when(sale, 1)).alias("sales"),
        F.sum(F.when(sale, F.col("quantity_sold"))).alias("u"), F.sum(F.when(sale & F.col("entry_price_php").isNull(), F.col("quantity_sold"))).alias("plain"))
    j = s.product.join(per, "product_id", "left")
    return j.agg(F.min("a").alias("first_day"), F.max("b").alias("last_day"), F.sum("rows").alias("fact_rows"), F.sum("sales").alias("sale_rows"), F.sum("u").alias("units"),
                 F.count("*").alias("products"), F.count("unit_price_php").alias("priced_products"), F.sum(F.when(F.col("unit_price_php").isNull(), F.col("plain")).otherwise(0)).alias("unpriced_units"))


@plan("rep_monthly_units", "month:s category:s units:l revenue:d2 priced_units:l", """
SELECT strftime(day, '%Y-%m') AS month, category, sum(quantity_sold) AS units, sum(quantity_sold * unit_price_php) AS revenue, sum(CASE WHEN unit_price_php IS NOT NULL THEN quantity_sold ELSE 0 END) AS priced_units
FROM sale JOIN product USING (product_id) GROUP BY ALL""")
def _(s):
    per = s.sale.groupBy("product_id", month_key("day").alias("month")).agg(F.sum("quantity_sold").alias("u")).join(s.product, "product_id")
    return per.groupBy("month", "category").agg(F.sum("u").alias("units"), F.sum(F.col("u") * F.col("unit_price_php")).alias("revenue"),
                                               F.sum(F.when(F.col("unit_price_php").isNotNull(), F.col("u")).otherwise(0)).alias("priced_units"))


_PERF = PA.OWN_SQL + """,
ms AS (SELECT strftime(max(day), '%Y-%m') AS cur, strftime(date_trunc('month', max(day)) - INTERVAL 1 MONTH, '%Y-%m') AS prev, strftime(date_trunc('month', max(day)) - INTERVAL 1 YEAR, '%Y-%m') AS ly FROM sale WHERE quantity_sold > 0),
it AS (SELECT product_id, category, month, units, CASE WHEN unit_price_php IS NOT NULL THEN (units - eu) * unit_price_php + ep WHEN eu > 0 THEN ep END AS php FROM (SELECT product_id, strftime(day, '%Y-%m') AS month, sum(quantity_sold) AS units, sum(CASE WHEN own_price IS NOT NULL THEN quantity_sold ELSE 0 END) AS eu, sum(coalesce(quantity_sold * own_price, 0)) AS ep FROM own WHERE quantity_sold > 0 GROUP BY ALL) JOIN product USING (product_id))
"""


@plan("rep_performance", "section:s name:s units:l php:d2 previous_php:d2 last_year_php:d2", _PERF + """
SELECT 'category' AS section, category AS name, sum(units) FILTER (month = cur) AS units, sum(php) FILTER (month = cur) AS php, sum(php) FILTER (month = prev) AS previous_php, sum(php) FILTER (month = ly) AS last_year_php FROM it, ms WHERE month IN (cur, prev, ly) GROUP BY ALL
UNION ALL SELECT 'stopped', CAST(product_id AS VARCHAR), 0, NULL, sum(php) FILTER (month = prev), NULL FROM it, ms WHERE month IN (cur, prev) GROUP BY product_id HAVING coalesce(sum(units) FILTER (month = prev), 0) >= 50 AND coalesce(sum(units) FILTER (month = cur), 0) = 0
UNION ALL SELECT 'store', 'all', sum(units) FILTER (month = cur), sum(php) FILTER (month = cur), sum(php) FILTER (month = prev), sum(php) FILTER (month = ly) FROM it, ms WHERE month IN (cur, prev, ly)""")
def _(s):
    sold = s.sale.filter("quantity_sold > 0")
    last = sold.agg(F.trunc(F.max("day"), "month").alias("m"))
    cur, prev, ly = (last.select(month_key(F.add_months("m", k))).scalar() for k in (0, -1, -12))
    own = A.own_price_totals(J.with_own_price(sold, s.price_change).withColumn("month", month_key("day")), ["product_id", "month"])
    it = own.join(s.product, "product_id").withColumn("php", A.pesos(F.col("units"), F.col("unit_price_php"), F.col("entry_units"), F.col("entry_php")))
    it = it.withColumn("slot", F.when(F.col("month") == cur, "cur").when(F.col("month") == prev, "prev").when(F.col("month") == ly, "ly")).filter("slot IS NOT NULL")

    def at(slot, col):
        return F.sum(F.when(F.col("slot") == slot, F.col(col)))

    figures = [at("cur", "units").alias("units"), at("cur", "php").alias("php"), at("prev", "php").alias("previous_php"), at("ly", "php").alias("last_year_php")]
    cat = it.groupBy("category").agg(*figures).select(F.lit("category").alias("section"), F.col("category").alias("name"), "units", "php", "previous_php", "last_year_php")
    store = it.agg(*figures).select(F.lit("store").alias("section"), F.lit("all").alias("name"), "units", "php", "previous_php", "last_year_php")
    gone = it.groupBy("product_id").agg(at("prev", "units").alias("pu"), at("cur", "units").alias("cu"), at("prev", "php").alias("previous_php")).filter(
        (F.col("pu") >= 50) & (F.coalesce("cu", F.lit(0)) == 0))
    stopped = gone.select(F.lit("stopped").alias("section"), F.col("product_id").cast("string").alias("name"), F.lit(0).alias("units"), F.lit(None).cast("double").alias("php"),
                          "previous_php", F.lit(None).cast("double").alias("last_year_php"))
    return cat.unionByName(store).unionByName(stopped)


@plan("rep_batch_daily", "product_id:l column:s mark:s units:l", """
SELECT product_id, CAST(day AS VARCHAR) AS column, sheet_mark AS mark, sum(quantity_sold) AS units FROM sale JOIN kinds USING (day) WHERE date_trunc('month', day) = (SELECT newest FROM marks) GROUP BY ALL HAVING sum(quantity_sold) > 0
UNION ALL SELECT product_id, strftime(day, '%Y-%m'), NULL, sum(q) FROM (SELECT product_id, day, sum(quantity_sold) AS q FROM sale WHERE year(day) = (SELECT year(newest) - 1 FROM marks) GROUP BY ALL HAVING sum(quantity_sold) > 0) GROUP BY 1, 2""")
def _(s):
    from tallyloom.functions.calendar import sheet_mark

    d = W.day_totals(s.sale).filter("day_units > 0")
    marks = F.broadcast(s.calendar.select("day", sheet_mark().alias("mark")))
    newest = s.mark("newest")
    month = d.filter(F.trunc("day", "month") == newest).join(marks, "day").select("product_id", F.col("day").cast("string").alias("column"), "mark", F.col("day_units").alias("units"))
    year = d.filter(F.year("day") == F.year(newest) - 1).groupBy("product_id", month_key("day").alias("column")).agg(F.sum("day_units").alias("units"))
    return month.unionByName(year.select("product_id", "column", F.lit(None).cast("string").alias("mark"), "units"))


@plan("rep_summary", "month:s units:l php:d2 recorded_days:l last_year_php:d2 last_year_days:l comparable:l projection:d2", """
WITH it AS (SELECT CAST(date_trunc('month', day) AS DATE) AS m, day, sum(quantity_sold) AS u, sum(quantity_sold * unit_price_php) AS php FROM sale JOIN product USING (product_id) GROUP BY ALL),
mo AS (SELECT m, sum(u) AS units, sum(php) AS php, count(DISTINCT day) AS days FROM it GROUP BY 1)
SELECT strftime(a.m, '%Y-%m') AS month, a.units, a.php, a.days AS recorded_days, b.php AS last_year_php, b.days AS last_year_days, CASE WHEN b.days >= 0.8 * a.days THEN 1 ELSE 0 END AS comparable,
CASE WHEN b.days >= 0.8 * a.days THEN (sum(a.php) OVER (PARTITION BY year(a.m) ORDER BY a.m)) * (SELECT sum(php) FROM mo c WHERE year(c.m) = year(a.m) - 1) / sum(b.php) OVER (PARTITION BY year(a.m) ORDER BY a.m) END AS projection FROM mo a LEFT JOIN mo b ON b.m = a.m - INTERVAL 1 YEAR""")
def _(s):
    from pyspark.sql import Window

    per = s.sale.groupBy("product_id", "day").agg(F.sum("quantity_sold").alias("u")).join(s.product, "product_id")
    mo = per.groupBy(F.trunc("day", "month").alias("m")).agg(F.sum("u").alias("units"), F.sum(F.col("u") * F.col("unit_price_php")).alias("php"), F.countDistinct("day").alias("days"))
    ly = mo.select(F.add_months("m", 12).alias("m"), F.col("php").alias("last_year_php"), F.col("days").alias("last_year_days"))
    full = mo.groupBy((F.year("m") + 1).alias("y")).agg(F.sum("php").alias("full_php"))
    w = Window.partitionBy("y").orderBy("m")  # at most twelve rows
    j = mo.join(ly, "m", "left").withColumn("y", F.year("m")).join(full, "y", "left")
    ok = F.coalesce(F.col("last_year_days") >= 0.8 * F.col("days"), F.lit(False))
    j = j.withColumn("ytd", F.sum("php").over(w)).withColumn("ly_ytd", F.sum("last_year_php").over(w))
    return j.select(month_key("m").alias("month"), "units", "php", F.col("days").alias("recorded_days"), "last_year_php", "last_year_days", ok.cast("int").alias("comparable"),
                    F.when(ok, F.col("ytd") * F.col("full_php") / F.col("ly_ytd")).alias("projection"))


@plan("rep_movement", "product_id:l month:s units:l stock:l busy:l", """
WITH m AS (SELECT DISTINCT strftime(day, '%Y-%m') AS month FROM sale), u AS (SELECT product_id, strftime(day, '%Y-%m') AS month, sum(quantity_sold) AS u FROM sale GROUP BY ALL),
b AS (SELECT strftime(day, '%Y-%m') AS month, max(is_enrollment_period) AS busy FROM calendar GROUP BY 1), h AS (SELECT product_id, month, coalesce(s.quantity, w.quantity) AS q FROM workbook_count w FULL JOIN staff_count s USING (product_id, month))
SELECT p.product_id, m.month, coalesce(u, 0) AS units, q AS stock, busy FROM product p CROSS JOIN m LEFT JOIN u ON u.product_id = p.product_id AND u.month = m.month LEFT JOIN h ON h.product_id = p.product_id AND h.month = m.month JOIN b ON b.month = m.month""")
def _(s):
    months = s.sale.agg(F.collect_set(month_key("day"))).scalar()  # a short list
    grid = s.product.select("product_id").withColumn("month", F.explode(months))
    u = s.sale.groupBy("product_id", month_key("day").alias("month")).agg(F.sum("quantity_sold").alias("u"))
    busy = s.calendar.groupBy(month_key("day").alias("month")).agg(F.max("is_enrollment_period").alias("busy"))
    h = J.stock_history(s.workbook_count, s.staff_count).select("product_id", "month", F.col("qty").alias("stock"))
    j = grid.join(u, ["product_id", "month"], "left").join(h, ["product_id", "month"], "left").join(F.broadcast(busy), "month")
    return j.withColumn("units", F.coalesce("u", F.lit(0)))


@plan("rep_restocks", "supplier_name:s orders:l waiting:l deliveries:l median_days:l min_days:l max_days:l last_ordered:D", """
WITH d AS (SELECT *, CASE WHEN delivered_on >= ordered_on THEN date_diff('day', ordered_on, delivered_on) END AS dd FROM restock_log)
SELECT s_name AS supplier_name, count(*) AS orders, count(*) FILTER (delivered_on IS NULL) AS waiting, count(dd) AS deliveries, round_even(quantile_cont(dd, 0.5), 0) AS median_days, min(dd) AS min_days, max(dd) AS max_days, max(ordered_on) AS last_ordered FROM d JOIN supplier ON s_suppkey = supplier_id GROUP BY 1""")
def _(s):
    dd = F.when(F.col("delivered_on") >= F.col("ordered_on"), F.datediff("delivered_on", "ordered_on"))
    g = s.restock_log.groupBy("supplier_id").agg(
        F.count("*").alias("orders"), F.count(F.when(F.col("delivered_on").isNull(), 1)).alias("waiting"), F.count(dd).alias("deliveries"),
        half_even(F.percentile(dd, 0.5)).alias("median_days"), F.min(dd).alias("min_days"), F.max(dd).alias("max_days"), F.max("ordered_on").alias("last_ordered"))
    names = s.table("supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name"))
    return g.join(names, "supplier_id")


@plan("rep_decision_method", "lead_time_days:l buffer_source:s tier:s items:l", PP.PUBPOL + "\nSELECT L AS lead_time_days, buffer_source, tier, count(DISTINCT product_id) AS items FROM pol GROUP BY ALL")
def _(s):
    return PP.Ctx(s).policy().groupBy("lead_time_days", "buffer_source", "tier").agg(F.countDistinct("product_id").alias("items"))


@plan("rep_category_forecasts", "category:s total:d4 low:d4 high:d4 items:l contributors:l recent_units:l", CATPUB_SQL.rstrip() + """,
u AS (SELECT category, product_id, sum(CASE WHEN day > last_day - 180 THEN quantity_sold ELSE 0 END) AS u FROM walkin JOIN product USING (product_id), span GROUP BY ALL),
c AS (SELECT category, count(*) AS items, count(*) FILTER (u > 0) AS contributors, sum(u) AS recent_units FROM u GROUP BY 1)
SELECT ct.category, total, greatest(total - rmse, 0) AS low, total + rmse AS high, items, contributors, recent_units FROM ct JOIN rm USING (category) JOIN c USING (category)""")
def _(s):
    last = s.span.select("last_day").scalar()
    u = s.walkin.groupBy("product_id").agg(F.sum(F.when(F.col("day") > F.date_sub(last, 180), F.col("quantity_sold")).otherwise(0)).alias("u")).join(s.product, "product_id")
    c = u.groupBy("category").agg(F.count("*").alias("items"), F.count(F.when(F.col("u") > 0, 1)).alias("contributors"), F.sum("u").alias("recent_units"))
    t = publish_categories(s).groupBy("category").agg(F.first("total").alias("total"), F.first("rmse").alias("rmse"))
    return t.join(c, "category").select("category", "total", F.greatest(F.col("total") - F.col("rmse"), F.lit(0.0)).alias("low"),
                                        (F.col("total") + F.col("rmse")).alias("high"), "items", "contributors", "recent_units")
