"""Aggregations bound to the star."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import half_even

from tallyloom.functions.calendar import planning_kind
from tallyloom.operators import aggregates as A
from tallyloom.operators import calendar as C
from tallyloom.operators import joins as J
from tallyloom.plans.classify import FSN_SQL, STATS_SQL
from tallyloom.plans.registry import plan
from tallyloom.sources.star import month_key

OWN_SQL = """WITH own AS (SELECT s.*, coalesce(entry_price_php, (SELECT arg_max(price_php, (effective_from, change_id)) FROM price_change c WHERE c.product_id = s.product_id AND c.effective_from <= s.day)) AS own_price FROM sale s)
"""


@plan("agg_product_stats", "product_id:l total_units:l observed_days:l censored_days:l weighted_units:d1 first_sale:D last_sale:D active_tally_dates:l adus:d4", STATS_SQL)
def _(s):
    return A.catalog_stats(s.sale)


@plan("agg_monthly", "product_id:l month:s units:l tally_days:l",
      "SELECT product_id, strftime(day, '%Y-%m') AS month, sum(quantity_sold) AS units, count(DISTINCT day) AS tally_days FROM sale GROUP BY ALL")
def _(s):
    return A.monthly(s.sale, ["product_id"])


@plan("agg_cv_monthly", "product_id:l mean_month:d6 sigma_month:d6 cv_pct:d6", """
SELECT product_id, avg(u) AS mean_month, stddev_pop(u) AS sigma_month, CASE WHEN avg(u) > 0 THEN stddev_pop(u) / avg(u) * 100 ELSE 0 END AS cv_pct
FROM (SELECT product_id, strftime(day, '%Y-%m') AS m, sum(quantity_sold) AS u FROM sale GROUP BY ALL) GROUP BY 1""")
def _(s):
    return A.monthly_cv(A.monthly(s.sale, ["product_id"]), ["product_id"])


def item_pesos(s, sale=None):
    own = A.own_price_totals(J.with_own_price(s.sale if sale is None else sale, s.price_change), ["product_id"])
    return own.join(s.product_full, "product_id").withColumn("php", A.pesos(
        F.col("units"), F.col("unit_price_php"), F.col("entry_units"), F.col("entry_php")))


@plan("agg_revenue", "product_id:l units:l entry_units:l entry_php:d2 php:d2", OWN_SQL + """
SELECT product_id, units, entry_units, entry_php, CASE WHEN unit_price_php IS NOT NULL THEN (units - entry_units) * unit_price_php + entry_php WHEN entry_units > 0 THEN entry_php END AS php
FROM (SELECT product_id, sum(quantity_sold) AS units, sum(CASE WHEN own_price IS NOT NULL THEN quantity_sold ELSE 0 END) AS entry_units, sum(coalesce(quantity_sold * own_price, 0)) AS entry_php FROM own GROUP BY 1) JOIN product USING (product_id)""")
def _(s):
    return item_pesos(s)


BATCH_SQL = OWN_SQL + """,
tot AS (SELECT product_id, sum(quantity_sold) AS units, sum(CASE WHEN own_price IS NOT NULL THEN quantity_sold ELSE 0 END) AS entry_units, sum(coalesce(quantity_sold * own_price, 0)) AS entry_php, count(DISTINCT own_price) AS entry_prices
 FROM own WHERE date_trunc('month', day) = (SELECT newest FROM marks) GROUP BY 1),
ln AS (SELECT coalesce(supplier_name, 'Unattributed') AS supplier, t.*, p.item_name, p.unit_price_php, CASE WHEN unit_price_php IS NOT NULL THEN (units - entry_units) * unit_price_php + entry_php WHEN entry_units > 0 THEN entry_php END AS line_total,
 CASE WHEN unit_price_php IS NOT NULL THEN units ELSE entry_units END AS priced_units FROM tot t JOIN product_full p USING (product_id) WHERE units > 0)
"""


def batch_lines(s, month=None):
    """Lines of one month, given by its first day; the newest one by default."""
    month = s.mark("newest") if month is None else F.lit(month).cast("date")
    p = item_pesos(s, s.sale.filter(F.trunc("day", "month") == month)).filter("units > 0")
    return p.select(
        F.coalesce("supplier_name", F.lit("Unattributed")).alias("supplier"), "product_id", "item_name", "units",
        "entry_units", "entry_prices", "unit_price_php", F.col("php").alias("line_total"),
        F.when(F.col("unit_price_php").isNotNull(), F.col("units")).otherwise(F.col("entry_units")).alias("priced_units"))


@plan("agg_batch_report", "supplier:s product_id:l quantity:l avg_price:d2 line_total:d2 is_avg:l total_units:l subtotal:d2 unpriced_units:l", BATCH_SQL + """
SELECT supplier, product_id, units AS quantity, CASE WHEN entry_units > 0 THEN round(line_total / priced_units, 2) ELSE unit_price_php END AS avg_price, line_total,
 CASE WHEN entry_units > 0 AND (entry_units < units OR entry_prices > 1) THEN 1 ELSE 0 END AS is_avg, sum(units) OVER w AS total_units, coalesce(sum(line_total) OVER w, 0) AS subtotal,
 sum(units - CASE WHEN line_total IS NOT NULL THEN priced_units ELSE 0 END) OVER w AS unpriced_units FROM ln WINDOW w AS (PARTITION BY supplier)""")
def batch_report(s):
    lines = batch_lines(s)
    sub = lines.groupBy("supplier").agg(
        F.sum("units").alias("total_units"), F.coalesce(F.sum("line_total"), F.lit(0.0)).alias("subtotal"),
        F.sum(F.col("units") - F.when(F.col("line_total").isNotNull(), F.col("priced_units")).otherwise(0)).alias("unpriced_units"))
    mixed = F.col("entry_units") > 0
    return lines.join(sub, "supplier").select(
        "supplier", "product_id", F.col("units").alias("quantity"),
        F.when(mixed, F.col("line_total") / F.col("priced_units")).otherwise(F.col("unit_price_php")).alias("avg_price"),
        "line_total", (mixed & ((F.col("entry_units") < F.col("units")) | (F.col("entry_prices") > 1))).cast("int").alias("is_avg"),
        "total_units", "subtotal", "unpriced_units")


@plan("agg_distinct_prices", "product_id:l prices:l", OWN_SQL + "SELECT product_id, count(DISTINCT own_price) AS prices FROM own GROUP BY 1")
def _(s):
    return A.own_price_totals(J.with_own_price(s.sale, s.price_change), ["product_id"]).withColumnRenamed("entry_prices", "prices")


@plan("agg_mode", "sku:s supplier_id:l payment_status:s unit_price_php:d2", """
WITH j AS (SELECT sku, f.supplier_id, payment_status, unit_price_php FROM fact f JOIN product USING (product_id)),
a AS (SELECT sku, supplier_id, row_number() OVER (PARTITION BY sku ORDER BY c DESC, supplier_id) AS r FROM (SELECT sku, supplier_id, count(*) AS c FROM j GROUP BY ALL)),
b AS (SELECT sku, payment_status, row_number() OVER (PARTITION BY sku ORDER BY c DESC, payment_status) AS r FROM (SELECT sku, payment_status, count(*) AS c FROM j WHERE payment_status IS NOT NULL GROUP BY ALL)),
d AS (SELECT sku, unit_price_php, row_number() OVER (PARTITION BY sku ORDER BY c DESC, unit_price_php) AS r FROM (SELECT sku, unit_price_php, count(*) AS c FROM j WHERE unit_price_php IS NOT NULL GROUP BY ALL))
SELECT a.sku, a.supplier_id, b.payment_status, d.unit_price_php FROM a LEFT JOIN b ON a.sku = b.sku AND b.r = 1 LEFT JOIN d ON a.sku = d.sku AND d.r = 1 WHERE a.r = 1""")
def _(s):
    j = s.fact.select("product_id", "supplier_id").join(s.product, "product_id")
    return (A.modal_value(j, "sku", "supplier_id").join(A.modal_value(j, "sku", "payment_status"), "sku", "left")
            .join(A.modal_value(j, "sku", "unit_price_php"), "sku", "left"))


@plan("agg_modal_lead_time", "supplier_name:s lead_time_days:l", """
SELECT supplier_name, lead_time_days FROM (SELECT supplier_name, lead_time_days, row_number() OVER (PARTITION BY supplier_name ORDER BY c DESC, lead_time_days) AS rn
FROM (SELECT supplier_name, lead_time_days, count(*) AS c FROM product_full GROUP BY ALL)) WHERE rn = 1""")
def _(s):
    return A.modal_value(s.product_full, "supplier_name", "lead_time_days")


@plan("agg_price_ladder", "product_id:l price:d2 price_source:s", """
WITH o AS (SELECT product_id, floor(amount / nullif(quantity_sold, 0)) AS obs, line_no FROM fact),
m AS (SELECT product_id, line_no, obs, row_number() OVER (PARTITION BY product_id, line_no ORDER BY c DESC, obs) AS r FROM (SELECT product_id, line_no, obs, count(*) AS c FROM o WHERE obs IS NOT NULL AND line_no IN (1, 2) GROUP BY ALL))
SELECT p.product_id, coalesce(unit_price_php, a.obs, CASE WHEN p.product_id % 2 = 0 THEN p.product_id % 400 + 50 END, b.obs) AS price,
 CASE WHEN unit_price_php IS NOT NULL THEN 'inventory' WHEN a.obs IS NOT NULL THEN 'daily_report' WHEN p.product_id % 2 = 0 THEN 'name_suffix' WHEN b.obs IS NOT NULL THEN 'sheet' END AS price_source
FROM product p LEFT JOIN m a ON a.product_id = p.product_id AND a.r = 1 AND a.line_no = 1 LEFT JOIN m b ON b.product_id = p.product_id AND b.r = 1 AND b.line_no = 2""")
def _(s):
    from tallyloom.functions.text import price_suffix

    obs = s.fact.filter("quantity_sold > 0").withColumn("obs", F.floor(F.col("amount") / F.col("quantity_sold")))
    dsr = A.modal_value(obs.filter("line_no = 1"), "product_id", "obs").withColumnRenamed("obs", "dsr")
    sheet = A.modal_value(obs.filter("line_no = 2"), "product_id", "obs").withColumnRenamed("obs", "sheet")
    suffixed = F.when(F.col("product_id") % 2 == 0, F.concat("item_name", F.lit(" @"), F.col("product_id") % 400 + 50)).otherwise(F.col("item_name"))
    p = s.product.withColumn("suffix", price_suffix(suffixed)).join(dsr, "product_id", "left").join(sheet, "product_id", "left")
    steps = (("unit_price_php", "inventory"), ("dsr", "daily_report"), ("suffix", "name_suffix"), ("sheet", "sheet"))
    source = F.lit(None).cast("string")
    for col, label in reversed(steps):
        source = F.when(F.col(col).isNotNull(), label).otherwise(source)
    return p.select("product_id", F.coalesce(*[F.col(c).cast("double") for c, _ in steps]).alias("price"), source.alias("price_source"))


DELIVERY_SQL = """SELECT supplier_id, count(*) AS deliveries, round_even(quantile_cont(d, 0.5), 0) AS median_days, min(d) AS min_days, max(d) AS max_days
FROM (SELECT supplier_id, date_diff('day', ordered_on, delivered_on) AS d FROM restock_log WHERE delivered_on >= ordered_on) GROUP BY 1 HAVING count(*) >= 3"""


def delivery_medians(log):
    d = F.datediff("delivered_on", "ordered_on")
    return log.filter("delivered_on >= ordered_on").groupBy("supplier_id").agg(
        F.count("*").alias("deliveries"), half_even(F.percentile(d, 0.5), 0).alias("median_days"),
        F.min(d).alias("min_days"), F.max(d).alias("max_days")).filter("deliveries >= 3")


@plan("agg_median_deliveries", "supplier_id:l deliveries:l median_days:l min_days:l max_days:l", DELIVERY_SQL)
def _(s):
    return delivery_medians(s.restock_log)


DAYS_SQL = """WITH dt AS (SELECT k.day, k.planning_kind AS kind, k.is_store_closed AS closed, coalesce(u, 0) AS units, CASE WHEN is_store_closed = 0 AND coalesce(u, 0) > 0 THEN 1 ELSE 0 END AS recorded
 FROM kinds k LEFT JOIN (SELECT day, sum(quantity_sold) AS u FROM sale GROUP BY 1) USING (day)),
lf AS (SELECT kind, count(*) AS days, avg(units) AS units_per_day, avg(units) / (SELECT avg(units) FROM dt WHERE recorded = 1 AND kind = 'regular') AS lift FROM dt WHERE recorded = 1 GROUP BY 1)
"""


@plan("agg_lifts", "kind:s days:l units_per_day:d4 lift:d6", DAYS_SQL + "SELECT * FROM lf")
def _(s):
    return C.lifts(C.day_table(s.calendar, s.sale))


@plan("agg_decision_velocity", "product_id:l semester_id:s units:l active_days:l adus:d4", """
WITH tm AS (SELECT semester_id, min(day) AS a, max(day) AS b FROM calendar WHERE semester_id LIKE '%-T1' OR semester_id LIKE '%-T2' GROUP BY 1 HAVING max(day) <= (SELECT max(day) FROM sale) ORDER BY a DESC LIMIT 2)
SELECT product_id, semester_id, sum(quantity_sold) AS units, count(DISTINCT day) - count(DISTINCT CASE WHEN is_censored = 1 THEN day END) AS active_days,
 coalesce(round_even(sum(CASE WHEN imputation_flag = 1 THEN quantity_sold * 0.5 ELSE quantity_sold END) / nullif(count(DISTINCT day) - count(DISTINCT CASE WHEN is_censored = 1 THEN day END), 0), 4), 0) AS adus FROM sale JOIN tm ON day BETWEEN a AND b GROUP BY ALL""")
def _(s):
    from tallyloom.operators.classify import review_terms, term_velocity

    return term_velocity(s.sale, review_terms(s.calendar, s.sale.agg(F.max("day")).scalar()))


@plan("agg_inventory_totals", "name_key:s latest_month:s units:l", """
WITH c AS (SELECT lower(base_name) AS name_key, month, CASE WHEN quantity % 10 = 0 THEN NULL ELSE quantity END AS q FROM workbook_count JOIN product USING (product_id)),
g AS (SELECT name_key, month, sum(q) AS u FROM c GROUP BY ALL), l AS (SELECT max(month) AS m FROM (SELECT month, sum(u) AS t FROM g GROUP BY 1) WHERE t <> 0 AND month <= (SELECT strftime(last_day, '%Y-%m') FROM span))
SELECT name_key, month AS latest_month, u AS units FROM g WHERE month = (SELECT m FROM l)""")
def _(s):
    from tallyloom.functions.text import fold_name

    c = s.workbook_count.join(s.product, "product_id").groupBy(fold_name(F.upper("base_name")).alias("name_key"), "month").agg(
        F.sum(F.when(F.col("quantity") % 10 != 0, F.col("quantity"))).alias("units"))
    today = s.span.select(month_key("last_day")).scalar()
    counted = c.groupBy("month").agg(F.sum("units").alias("t")).filter((F.col("t") != 0) & (F.col("month") <= today))
    return c.filter(F.col("month") == counted.agg(F.max("month")).scalar()).withColumnRenamed("month", "latest_month")


@plan("agg_grouping_sets", "supplier:s item:s units:l line_total:d2 row_kind:l", """
SELECT CASE WHEN g1 = 1 THEN 'GRAND TOTAL' WHEN g2 = 1 THEN 'SUBTOTAL - ' || sup ELSE sup END AS supplier, it AS item, units, line_total, g1 + g2 AS row_kind
FROM (SELECT sup, it, grouping(sup) AS g1, grouping(it) AS g2, sum(q) AS units, sum(t) AS line_total FROM (SELECT coalesce(supplier_name, 'Unattributed') AS sup, item_name AS it, quantity_sold AS q, quantity_sold * unit_price_php AS t FROM sale JOIN product_full USING (product_id)) GROUP BY ROLLUP (sup, it))""")
def _(s):
    from tallyloom.plans.reports import supplier_lines

    return supplier_lines(s.sale, s.product_full)


@plan("agg_conditional_pivot", "category:s enrollment:l term_start:l exam:l sem_break:l event:l regular:l", """
SELECT category, """ + ", ".join(f"coalesce(sum(CASE WHEN planning_kind = '{k}' THEN quantity_sold END), 0) AS {k}" for k in ("enrollment", "term_start", "exam", "sem_break", "event", "regular")) + """
FROM sale JOIN kinds USING (day) JOIN product USING (product_id) GROUP BY 1""")
def _(s):
    kinds = ["enrollment", "term_start", "exam", "sem_break", "event", "regular"]
    days = F.broadcast(s.calendar.select("day", planning_kind().alias("kind")))
    j = s.sale.groupBy("product_id", "day").agg(F.sum("quantity_sold").alias("q")).join(days, "day").join(s.product, "product_id")
    return j.groupBy("category").pivot("kind", kinds).agg(F.sum("q")).fillna(0)


@plan("agg_having", "product_id:l day:D units:l", "SELECT product_id, day, sum(quantity_sold) AS units FROM sale GROUP BY ALL HAVING sum(quantity_sold) > 0")
def _(s):
    return s.sale.groupBy("product_id", "day").agg(F.sum("quantity_sold").alias("units")).filter("units > 0")


@plan("agg_concentration", "product_id:l sale_days:l units:l gini:d6 p90_share:d6 active_rate:d6 break_ratio:d6 exam_ratio:d6", """
WITH d AS (SELECT product_id, day, sum(quantity_sold) AS q FROM sale GROUP BY ALL HAVING sum(quantity_sold) > 0),
r AS (SELECT d.*, demand_kind, row_number() OVER (PARTITION BY product_id ORDER BY q) AS i, row_number() OVER (PARTITION BY product_id ORDER BY q DESC) AS j, count(*) OVER (PARTITION BY product_id) AS n FROM d JOIN kinds USING (day)),
o AS (SELECT count(DISTINCT day) AS n_obs FROM sale)
SELECT product_id, count(*) AS sale_days, sum(q) AS units, (2 * sum(i * q) - (count(*) + 1) * sum(q)) / (count(*) * sum(q)) AS gini, sum(CASE WHEN j <= greatest(1, ceil(0.1 * n)) THEN q END) / sum(q) AS p90_share,
 count(*) / any_value(n_obs) AS active_rate,
 least(5, greatest(0, coalesce(avg(CASE WHEN demand_kind = 'break' THEN q END) / coalesce(avg(CASE WHEN demand_kind NOT IN ('break', 'exam') THEN q END), avg(q)), 1))) AS break_ratio,
 least(5, greatest(0, coalesce(avg(CASE WHEN demand_kind = 'exam' THEN q END) / coalesce(avg(CASE WHEN demand_kind NOT IN ('break', 'exam') THEN q END), avg(q)), 1))) AS exam_ratio FROM r, o GROUP BY 1""")
def concentration(s):
    """Behaviour features per item; day totals bound every group by the calendar."""
    from tallyloom.functions.calendar import demand_kind

    days = F.broadcast(s.calendar.select("day", demand_kind().alias("kind")))
    d = s.sale.groupBy("product_id", "day").agg(F.sum("quantity_sold").alias("q")).filter("q > 0").join(days, "day")
    w = Window.partitionBy("product_id")
    r = (d.withColumn("i", F.row_number().over(w.orderBy("q"))).withColumn("n", F.count("*").over(w)))
    top = F.col("i") > F.col("n") - F.greatest(F.lit(1), F.ceil(F.lit(0.1) * F.col("n")))
    n_obs = s.sale.agg(F.countDistinct("day")).scalar()
    n, tot = F.count("*"), F.sum("q")
    term = F.coalesce(F.avg(F.when(~F.col("kind").isin("break", "exam"), F.col("q"))), F.avg("q"))

    def ratio(kind):
        raw = F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col("q"))) / term, F.lit(1.0))
        return F.least(F.lit(5.0), F.greatest(F.lit(0.0), raw))

    return r.groupBy("product_id").agg(
        n.alias("sale_days"), tot.alias("units"), ((2 * F.sum(F.col("i") * F.col("q")) - (n + 1) * tot) / (n * tot)).alias("gini"),
        (F.sum(F.when(top, F.col("q"))) / tot).alias("p90_share"), n.alias("_n"),
        ratio("break").alias("break_ratio"), ratio("exam").alias("exam_ratio"), F.avg("q").alias("mean_units"),
        F.stddev_samp("q").alias("sd")).withColumn("active_rate", F.col("_n") / n_obs)


@plan("agg_gap_summary", "gap:s products:l share:d6 units:l fast_items:l", f"""
WITH c AS ({FSN_SQL}), u AS (SELECT product_id, sum(quantity_sold) AS units FROM sale GROUP BY 1),
j AS (SELECT c.*, coalesce(u.units, 0) AS units FROM c LEFT JOIN u USING (product_id)),
g AS (SELECT unnest([{{'gap': 'price', 'm': unit_price_php IS NULL}}, {{'gap': 'payment_status', 'm': payment_status IS NULL}}, {{'gap': 'inactive', 'm': is_active = 0}}]) AS x, units, fsn_class FROM j)
SELECT x.gap AS gap, count(*) FILTER (x.m) AS products, count(*) FILTER (x.m) / count(*) AS share, coalesce(sum(units) FILTER (x.m), 0) AS units, count(*) FILTER (x.m AND fsn_class = 'F') AS fast_items FROM g GROUP BY 1""")
def _(s):
    from tallyloom.operators.classify import fsn_classify

    cls = fsn_classify(s.product, s.sale)
    u = s.sale.groupBy("product_id").agg(F.sum("quantity_sold").alias("units"))
    j = cls.join(u, "product_id", "left").fillna(0, ["units"])
    gaps = F.array(*[F.struct(F.lit(n).alias("gap"), c.cast("int").alias("m")) for n, c in (
        ("price", F.col("unit_price_php").isNull()), ("payment_status", F.col("payment_status").isNull()), ("inactive", F.col("is_active") == 0))])
    g = j.select("units", "fsn_class", F.inline(gaps))
    return g.groupBy("gap").agg(
        F.sum("m").alias("products"), (F.sum("m") / F.count("*")).alias("share"), F.sum(F.col("units") * F.col("m")).alias("units"),
        F.sum(F.col("m") * (F.col("fsn_class") == "F").cast("int")).alias("fast_items"))


@plan("agg_named_measures", "category:s units_sold:l line_total:d2 day_count:l avg_daily_units:d6 latest_sale:D unpriced_units:l fast_share:d6 vs_regular_day:d6", f"""
WITH c AS ({FSN_SQL}), j AS (SELECT s.*, c.category, c.unit_price_php, c.fsn_class, k.report_kind FROM sale s JOIN c USING (product_id) JOIN kinds k USING (day))
SELECT category, sum(quantity_sold) AS units_sold, sum(quantity_sold * unit_price_php) AS line_total, count(DISTINCT day) AS day_count, sum(quantity_sold) / count(DISTINCT day) AS avg_daily_units,
 max(CASE WHEN quantity_sold > 0 THEN day END) AS latest_sale, sum(CASE WHEN unit_price_php IS NULL THEN quantity_sold ELSE 0 END) AS unpriced_units, sum(CASE WHEN fsn_class = 'F' THEN quantity_sold ELSE 0 END) / sum(quantity_sold) AS fast_share,
 (sum(CASE WHEN report_kind = 'Enrollment' THEN quantity_sold END) / count(DISTINCT CASE WHEN report_kind = 'Enrollment' THEN day END)) / (sum(CASE WHEN report_kind = 'Regular' THEN quantity_sold END) / count(DISTINCT CASE WHEN report_kind = 'Regular' THEN day END)) AS vs_regular_day
FROM j GROUP BY 1""")
def _(s):
    from tallyloom.functions.calendar import report_kind
    from tallyloom.operators.classify import fsn_classify

    days = F.broadcast(s.calendar.select("day", report_kind().alias("kind")))
    item_day = s.sale.groupBy("product_id", "day").agg(F.sum("quantity_sold").alias("q"))
    j = item_day.join(fsn_classify(s.product, s.sale), "product_id").join(days, "day")
    q = F.col("q")

    def per_day(kind):
        on = F.col("kind") == kind
        return F.sum(F.when(on, q)) / F.countDistinct(F.when(on, F.col("day")))

    return j.groupBy("category").agg(
        F.sum(q).alias("units_sold"), F.sum(q * F.col("unit_price_php")).alias("line_total"), F.countDistinct("day").alias("day_count"),
        (F.sum(q) / F.countDistinct("day")).alias("avg_daily_units"), F.max(F.when(q > 0, F.col("day"))).alias("latest_sale"),
        F.sum(F.when(F.col("unit_price_php").isNull(), q).otherwise(0)).alias("unpriced_units"),
        (F.sum(F.when(F.col("fsn_class") == "F", q).otherwise(0)) / F.sum(q)).alias("fast_share"),
        (per_day("Enrollment") / per_day("Regular")).alias("vs_regular_day"))
