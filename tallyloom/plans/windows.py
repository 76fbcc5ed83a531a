"""Windowed computations bound to the star."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import half_even

from tallyloom.operators import calendar as C
from tallyloom.operators import series as S
from tallyloom.operators import windows as W
from tallyloom.operators.scale import ranked_running
from tallyloom.plans.aggregates import OWN_SQL, item_pesos
from tallyloom.plans.joins import RUNS_SQL, busy_runs
from tallyloom.plans.registry import plan
from tallyloom.sources.star import month_key


@plan("win_month_running", "product_id:l day:D order_id:l line_no:l quantity_sold:l cumulative_monthly_units:l",
      """SELECT product_id, day, order_id, line_no, quantity_sold, sum(quantity_sold) OVER (PARTITION BY product_id, date_trunc('month', day) ORDER BY day, order_id, line_no, amount ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_monthly_units FROM fact""")
def _(s):
    return W.month_running(s.fact, ["order_id", "line_no", "amount"])


_DAYT = "WITH d AS (SELECT product_id, day, strftime(day, '%Y-%m') AS month, sum(quantity_sold) AS day_units FROM fact GROUP BY ALL)"


@plan("win_depletion_rate", "product_id:l day:D depletion_rate:d4", _DAYT + """
SELECT product_id, day, round_even(day_units / least(date_diff('day', lag(day) OVER (PARTITION BY product_id ORDER BY day), day), 30), 4) AS depletion_rate FROM d""")
def _(s):
    return W.depletion_rate(W.day_totals(s.fact))


_HAND = _DAYT + """,
h AS (SELECT d.*, c.quantity AS counted, coalesce(sum(day_units) OVER (PARTITION BY product_id, month ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sold_before FROM d LEFT JOIN workbook_count c USING (product_id, month)),
st AS (SELECT *, counted - sold_before AS on_hand, max(CASE WHEN counted - sold_before <= 0 AND day_units > 0 THEN 1 END) OVER (PARTITION BY product_id, month ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS broken,
 avg(day_units) OVER (PARTITION BY product_id ORDER BY day ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS rate FROM h)
"""


def hand(s):
    return W.stock_on_hand(W.day_totals(s.fact), s.workbook_count)


@plan("win_stock_on_hand", "product_id:l day:D on_hand:l", _HAND + "SELECT product_id, day, on_hand FROM st")
def _(s):
    return hand(s)


@plan("win_stock_state", "product_id:l day:D is_censored:l", _HAND + """
SELECT product_id, day, CASE WHEN counted IS NOT NULL AND broken IS NULL THEN CASE WHEN on_hand <= 0 THEN 1 ELSE 0 END END AS is_censored FROM st""")
def _(s):
    return W.stock_state(hand(s))


@plan("win_days_of_supply", "product_id:l day:D days_of_supply:d2", _HAND + """
SELECT product_id, day, CASE WHEN counted IS NOT NULL AND broken IS NULL AND rate > 0 THEN round_even(greatest(on_hand, 0) / rate, 2) END AS days_of_supply FROM st""")
def _(s):
    return W.stock_state(hand(s))


_PHP = OWN_SQL + """,
ip AS (SELECT product_id, units, CASE WHEN unit_price_php IS NOT NULL THEN (units - eu) * unit_price_php + ep WHEN eu > 0 THEN ep END AS php
 FROM (SELECT product_id, sum(quantity_sold) AS units, sum(CASE WHEN own_price IS NOT NULL THEN quantity_sold ELSE 0 END) AS eu, sum(coalesce(quantity_sold * own_price, 0)) AS ep FROM own GROUP BY 1) JOIN product USING (product_id))
"""


@plan("win_cum_share", "product_id:l php:d2 rank_no:l cum_share:d8 n_for_80:l", _PHP + """,
c AS (SELECT product_id, php, row_number() OVER (ORDER BY php DESC, product_id) AS rank_no, sum(php) OVER (ORDER BY php DESC, product_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(php) OVER () AS cum_share FROM ip WHERE php IS NOT NULL)
SELECT *, (SELECT min(rank_no) FROM c WHERE cum_share >= 0.8) AS n_for_80 FROM c""")
def cum_share(s):
    ranked = ranked_running(item_pesos(s).filter("php IS NOT NULL").select("product_id", "units", "php"), "php", ["product_id"])
    ranked = ranked.withColumn("cum_share", F.col("running") / F.col("group_total"))
    return ranked.withColumn("n_for_80", ranked.agg(F.min(F.when(F.col("cum_share") >= 0.8, F.col("rank_no")))).scalar())


@plan("win_pareto_curve", "reading:s n_skus:l pct_of_skus:d1 pct_of_units:d4", """
WITH u AS (SELECT product_id, sum(quantity_sold) AS u FROM sale GROUP BY 1 HAVING sum(quantity_sold) > 0),
c AS (SELECT row_number() OVER (ORDER BY u DESC, product_id) AS rk, sum(u) OVER (ORDER BY u DESC, product_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(u) OVER () AS cum, count(*) OVER () AS n FROM u),
r AS (SELECT 'top ' || p || '%' AS reading, greatest(1, CAST(round_even((SELECT max(n) FROM c) * p / 100.0, 0) AS BIGINT)) AS k FROM (SELECT unnest([5, 10, 20, 25, 30, 40, 50]) AS p)
 UNION ALL SELECT CAST(t AS VARCHAR) || '% of units', (SELECT count(*) FROM c WHERE cum < t / 100.0) + 1 FROM (SELECT unnest([50, 80, 90, 95]) AS t))
SELECT reading, k AS n_skus, 100.0 * k / n AS pct_of_skus, 100.0 * cum AS pct_of_units FROM r JOIN c ON c.rk = r.k""")
def _(s):
    u = s.sale.groupBy("product_id").agg(F.sum("quantity_sold").alias("u")).filter("u > 0")
    c = ranked_running(u, "u", ["product_id"]).withColumn("cum", F.col("running") / F.col("group_total"))
    tops = F.array(*[F.struct(F.lit(f"top {p}%").alias("reading"), F.lit(p).alias("p"), F.lit(None).cast("double").alias("t")) for p in (5, 10, 20, 25, 30, 40, 50)],
                   *[F.struct(F.lit(f"{t}% of units").alias("reading"), F.lit(None).cast("int").alias("p"), F.lit(t / 100).alias("t")) for t in (50, 80, 90, 95)])
    # each ranked row asks whether it is the one a reading points at
    hit = F.filter(tops, lambda x: F.when(
        x["p"].isNotNull(), F.col("rank_no") == F.greatest(F.lit(1), half_even(F.col("group_rows") * x["p"] / 100, 0)))
        .otherwise((F.col("cum") >= x["t"]) & (F.col("cum") - F.col("u") / F.col("group_total") < x["t"] - 1e-12)))
    return c.withColumn("hit", F.explode(hit)).select(
        F.col("hit.reading").alias("reading"), F.col("rank_no").alias("n_skus"),
        (100.0 * F.col("rank_no") / F.col("group_rows")).alias("pct_of_skus"), (100.0 * F.col("cum")).alias("pct_of_units"))


@plan("win_gap_runs", "kind:s run_start:D run_end:D days:l units:l", RUNS_SQL + """
SELECT kind, run_start, run_end, days, coalesce(sum(quantity_sold), 0) AS units FROM runs LEFT JOIN sale ON day BETWEEN run_start AND run_end GROUP BY ALL""")
def _(s):
    d = busy_runs(s).withColumn("day", F.explode(F.sequence("run_start", "run_end")))
    units = s.sale.groupBy("day").agg(F.sum("quantity_sold").alias("u"))
    return d.join(units, "day", "left").groupBy("kind", "run_start", "run_end", "days").agg(F.coalesce(F.sum("u"), F.lit(0)).alias("units"))


@plan("win_busiest_week", "sku:s start_day:D end_day:D units:d1 share:d6", """
WITH f AS (SELECT * FROM series WHERE pos >= n - 30), w AS (SELECT sku, day, sum(qty) OVER (PARTITION BY sku ORDER BY pos ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS u, row_number() OVER (PARTITION BY sku ORDER BY pos DESC) AS back, sum(qty) OVER (PARTITION BY sku) AS tot FROM f)
SELECT sku, day AS start_day, day + 6 AS end_day, u AS units, u / tot AS share FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY u DESC, day) AS rn FROM w WHERE back >= 7 AND tot > 0) WHERE rn = 1""")
def _(s):
    f = s.series.filter(F.col("pos") >= F.col("n") - 30)
    return busiest_week(f, "sku", "day", "qty")


def busiest_week(rows, key, day, qty):
    w = Window.partitionBy(key).orderBy(day)
    r = (rows.withColumn("u", F.sum(qty).over(w.rowsBetween(0, 6))).withColumn("ahead", F.count("*").over(w.rowsBetween(0, 6)))
         .withColumn("tot", F.sum(qty).over(Window.partitionBy(key))))
    g = r.filter("ahead = 7 AND tot > 0").groupBy(key).agg(
        F.max_by(F.struct("u", "tot", F.col(day).alias("d")), F.struct(F.col("u"), -F.unix_date(day))).alias("b"))
    return g.select(key, F.col("b.d").alias("start_day"), F.date_add("b.d", 6).alias("end_day"), F.col("b.u").alias("units"),
                    (F.col("b.u") / F.col("b.tot")).alias("share"))


@plan("win_latest_row", "kind:s key:s value:d2", """
SELECT 'price' AS kind, CAST(product_id AS VARCHAR) AS key, arg_max(price_php, (effective_from, change_id)) AS value FROM price_change GROUP BY product_id
UNION ALL SELECT 'sale', CAST(product_id AS VARCHAR), arg_max(quantity_sold, (day, order_id, line_no, amount)) FROM fact GROUP BY product_id""")
def _(s):
    price = s.price_change.groupBy("product_id").agg(F.max_by("price_php", F.struct("effective_from", "change_id")).alias("value"))
    sale = s.fact.groupBy("product_id").agg(F.max_by("quantity_sold", F.struct("day", "order_id", "line_no", "amount")).cast("double").alias("value"))
    return price.select(F.lit("price").alias("kind"), F.col("product_id").alias("key"), "value").unionByName(
        sale.select(F.lit("sale").alias("kind"), F.col("product_id").alias("key"), "value"))


@plan("win_previous_month", "category:s month:s units:l previous_units:l last_year_units:l", """
WITH m AS (SELECT category, CAST(date_trunc('month', day) AS DATE) AS m, sum(quantity_sold) AS u FROM sale JOIN product USING (product_id) GROUP BY ALL)
SELECT a.category, strftime(a.m, '%Y-%m') AS month, a.u AS units, b.u AS previous_units, c.u AS last_year_units FROM m a LEFT JOIN m b ON b.category = a.category AND b.m = a.m - INTERVAL 1 MONTH LEFT JOIN m c ON c.category = a.category AND c.m = a.m - INTERVAL 1 YEAR""")
def _(s):
    own = s.sale.groupBy("product_id", F.trunc("day", "month").alias("m")).agg(F.sum("quantity_sold").alias("units"))
    m = own.join(s.product, "product_id").groupBy("category", "m").agg(F.sum("units").alias("units"))
    prev = m.select("category", F.add_months("m", 1).alias("m"), F.col("units").alias("previous_units"))
    ly = m.select("category", F.add_months("m", 12).alias("m"), F.col("units").alias("last_year_units"))
    return m.join(prev, ["category", "m"], "left").join(ly, ["category", "m"], "left").withColumn("month", month_key("m"))


@plan("win_trailing_rate", "product_id:l units:l sale_days:l observed_days:l rate:d6", """
WITH d AS (SELECT product_id, day, sum(quantity_sold) AS u FROM sale GROUP BY ALL), o AS (SELECT last_day - 90 AS org FROM span),
ob AS (SELECT count(*) AS n FROM calendar, o WHERE day < org AND day >= org - 365 AND (is_sem_break = 1 OR is_store_closed = 1 OR day IN (SELECT day FROM fact)))
SELECT product_id, sum(CASE WHEN day < org AND day >= org - 365 THEN u ELSE 0 END) AS units, count(CASE WHEN day < org AND day >= org - 365 AND u > 0 THEN 1 END) AS sale_days, any_value(n) AS observed_days,
 sum(CASE WHEN day < org AND day >= org - 365 THEN u ELSE 0 END) / any_value(n) AS rate FROM d, o, ob GROUP BY 1""")
def _(s):
    org = F.date_sub(s.span.select("last_day").scalar(), 90)
    return W.trailing_rate(W.day_totals(s.sale), org, 365, S.observed_mask(s.calendar, s.fact))


@plan("win_causal_features", "sku:s pos:l lag_1:d1 lag_30:d1 mean_7:d6 mean_90:d6 std_30:d5 max_90:d1 share_30:d6 days_since:l trend:d6 ratio:d6 weekday:l", """
WITH f AS (SELECT sku, pos, coalesce(lag(qty, 1) OVER w, 0) AS lag_1, coalesce(lag(qty, 30) OVER w, 0) AS lag_30, avg(qty) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean_7, avg(qty) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS mean_30, avg(qty) OVER (w ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS mean_90,
 stddev_pop(qty) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS std_30, max(qty) OVER (w ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS max_90, avg(CASE WHEN qty > 0 THEN 1.0 ELSE 0.0 END) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS share_30,
 least(coalesce(pos - 1 - last_value(CASE WHEN qty > 0 THEN pos END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), least(pos, 90)), 90) AS days_since, avg(qty) OVER (w ROWS BETWEEN 60 PRECEDING AND 31 PRECEDING) AS prev, pos % 7 AS weekday FROM series WINDOW w AS (PARTITION BY sku ORDER BY pos))
SELECT *, CASE WHEN pos >= 60 THEN mean_30 - prev END AS trend, CASE WHEN mean_90 > 0 THEN mean_30 / mean_90 ELSE 0 END AS ratio FROM f WHERE pos > 0""".replace("(w ROWS", "(PARTITION BY sku ORDER BY pos ROWS").replace("OVER w", "OVER (PARTITION BY sku ORDER BY pos)").replace(" WINDOW w AS (PARTITION BY sku ORDER BY pos)", ""))
def _(s):
    return W.causal_features(s.series).filter("pos > 0")


@plan("win_next_sale", "sku:s pos:l weeks:l observed:l", """
WITH f AS (SELECT sku, pos, n, first_value(CASE WHEN qty > 0 THEN pos END IGNORE NULLS) OVER (PARTITION BY sku ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM series)
SELECT sku, pos, least(coalesce((nx - pos) // 7 + 1, (n - pos) // 7), 12) AS weeks, CASE WHEN nx IS NOT NULL AND (nx - pos) // 7 + 1 <= 12 THEN 1 ELSE 0 END AS observed FROM f""")
def _(s):
    return W.next_sale_weeks(s.series, 12)


@plan("win_share_of_group", "category:s product_id:l units:d0 share:d8", """
WITH u AS (SELECT category, product_id, sum(CASE WHEN day > last_day - 30 THEN quantity_sold ELSE 0 END) AS units FROM walkin JOIN product USING (product_id), span GROUP BY ALL)
SELECT category, product_id, units, CASE WHEN sum(units) OVER (PARTITION BY category) > 0 THEN units / sum(units) OVER (PARTITION BY category) ELSE 1.0 / count(*) OVER (PARTITION BY category) END AS share FROM u""")
def _(s):
    daily = s.walkin.groupBy("product_id", "day").agg(F.sum("quantity_sold").cast("double").alias("qty")).join(s.product.select("product_id", "category"), "product_id")
    return W.share_of_group(daily, s.span.select("last_day").scalar(), 30, "category", "product_id")
