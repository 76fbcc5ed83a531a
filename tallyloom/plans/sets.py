"""Set operations bound to the star."""

from pyspark.sql import functions as F

from tallyloom.operators import aggregates as A
from tallyloom.operators.calendar import latest_closures
from tallyloom.plans.joins import _RANGES, _RAWN, raw_named, vocabulary
from tallyloom.plans.registry import plan
from tallyloom.sources.star import month_key

_CLOSED = """WITH yr AS (SELECT unnest(range(year(first_day), year(last_day) + 1)) AS y FROM span),
wb AS (SELECT day FROM days WHERE (month(day) = 2 AND isodow(day) = 7) OR (month(day) = 12 AND day(day) = 25)),
pub AS (SELECT day FROM kinds WHERE is_sem_break = 1)
"""


@plan("union_closed_days", "day:D source:s units:l", _CLOSED + """
SELECT day, CASE WHEN p AND w THEN 'both' WHEN p THEN 'calendar' ELSE 'workbook' END AS source, coalesce(u, 0) AS units FROM (
 SELECT day, bool_or(k = 'p') AS p, bool_or(k = 'w') AS w FROM (SELECT day, 'p' AS k FROM pub UNION ALL SELECT day, 'w' FROM wb) GROUP BY 1) LEFT JOIN (SELECT day, sum(quantity_sold) AS u FROM sale GROUP BY 1) USING (day)""")
def _(s):
    closed = latest_closures(s.closure_log).filter("is_closed = 1").select(F.col("closure_date").alias("day"), F.lit(0).alias("p"), F.lit(1).alias("w"))
    breaks = s.calendar.filter("is_sem_break = 1").select("day", F.lit(1).alias("p"), F.lit(0).alias("w"))
    both = closed.unionByName(breaks).groupBy("day").agg(F.max("p").alias("p"), F.max("w").alias("w"))
    units = s.sale.groupBy("day").agg(F.sum("quantity_sold").alias("u"))
    return both.join(units, "day", "left").select(
        "day", F.when((F.col("p") == 1) & (F.col("w") == 1), "both").when(F.col("p") == 1, "calendar").otherwise("workbook").alias("source"),
        F.coalesce("u", F.lit(0)).alias("units"))


@plan("union_calendar_supplement", "day:D evidence:s units:l", """
WITH c AS (SELECT day, sum(quantity_sold) AS u FROM fact WHERE line_no <> 1 GROUP BY 1)
SELECT day, 'colour' AS evidence, u AS units FROM c UNION ALL SELECT day, 'calendar', 0 FROM kinds WHERE (is_enrollment_period = 1 OR is_exam_week = 1 OR is_sem_break = 1) AND day NOT IN (SELECT day FROM c)""")
def _(s):
    seen = s.fact.filter("line_no <> 1").groupBy("day").agg(F.sum("quantity_sold").alias("units")).withColumn("evidence", F.lit("colour"))
    extra = s.calendar.filter("is_enrollment_period = 1 OR is_exam_week = 1 OR is_sem_break = 1").join(seen, "day", "left_anti")
    return seen.unionByName(extra.select("day", F.lit(0).alias("units"), F.lit("calendar").alias("evidence")))


@plan("union_events", "name:s day:D units:l", _RANGES + """,
u AS (SELECT trim(regexp_replace(event_name, '\\(date uncertain[^)]*\\)', '')) AS name, start_date AS d FROM ranges WHERE flag = 'is_event_day' UNION ALL SELECT event_name, d FROM evl),
b AS (SELECT name, d, row_number() OVER (PARTITION BY lower(name) ORDER BY d DESC, name) AS rn FROM u)
SELECT name, d AS day, coalesce(sum(quantity_sold), 0) AS units FROM b LEFT JOIN sale ON day = d WHERE rn = 1 GROUP BY ALL""")
def _(s):
    pub = s.calendar_ranges.filter("flag = 'is_event_day'").select(
        F.trim(F.regexp_replace("event_name", r"\(date uncertain[^)]*\)", "")).alias("name"), F.col("start_date").alias("day"))
    every = pub.unionByName(s.event_log.select(F.col("event_name").alias("name"), F.col("event_date").alias("day")))
    newest = every.groupBy(F.lower("name").alias("k")).agg(F.max("day").alias("d"))
    best = every.join(newest, (F.lower("name") == newest["k"]) & (F.col("day") == newest["d"])).groupBy("k", "day").agg(F.min("name").alias("name"))
    units = s.sale.groupBy("day").agg(F.sum("quantity_sold").alias("u"))
    return best.join(units, "day", "left").select("name", "day", F.coalesce("u", F.lit(0)).alias("units"))


@plan("except_distinct", "name:s", _RAWN + "SELECT raw_name AS name FROM vocab EXCEPT SELECT trim(raw_item) FROM rawn")
def _(s):
    return vocabulary(s).select(F.col("raw_name").alias("name")).subtract(raw_named(s).select(F.trim("raw_item").alias("name")))


@plan("intersect_months", "base_name:s shared_months:l clean_handover:l", """
WITH m AS (SELECT base_name, CASE WHEN p.product_id % 2 = 0 THEN 'old' ELSE 'new' END AS side, strftime(day, '%Y-%m') AS month FROM sale JOIN product p USING (product_id), marks
 WHERE (p.product_id % 2 = 0 AND day < middle) OR (p.product_id % 2 = 1 AND day >= CASE WHEN base_name LIKE 'r%' THEN CAST(middle - INTERVAL 2 MONTH AS DATE) ELSE middle END) GROUP BY ALL),
g AS (SELECT base_name, list(DISTINCT month) FILTER (side = 'old') AS o, list(DISTINCT month) FILTER (side = 'new') AS n FROM m GROUP BY 1)
SELECT base_name, len(list_intersect(o, n)) AS shared_months, CASE WHEN len(list_intersect(o, n)) = 0 AND date_diff('month', CAST(list_max(o) || '-01' AS DATE), CAST(list_min(n) || '-01' AS DATE)) BETWEEN 1 AND 2 THEN 1 ELSE 0 END AS clean_handover FROM g WHERE o IS NOT NULL AND n IS NOT NULL""")
def _(s):
    from tallyloom.operators.entity import handover

    k = F.col("product_id") % 2
    # the range of an item changes hands in the middle of the recorded span
    middle = s.mark("middle")
    start = F.when(F.col("base_name").startswith("r"), F.add_months(middle, -2)).otherwise(middle)
    rows = s.sale.groupBy("product_id", month_key("day").alias("month"), "day").agg(F.count("*").alias("c")).join(s.product, "product_id").filter(
        ((k == 0) & (F.col("day") < middle)) | ((k == 1) & (F.col("day") >= start)))
    g = rows.groupBy("base_name").agg(F.collect_set(F.when(k == 0, F.col("month"))).alias("o"), F.collect_set(F.when(k == 1, F.col("month"))).alias("n"))
    return g.filter((F.size("o") > 0) & (F.size("n") > 0)).select(
        "base_name", F.size(F.array_intersect("o", "n")).alias("shared_months"), handover(F.col("o"), F.col("n")).cast("int").alias("clean_handover"))


@plan("union_price_sources", "product_id:l price:d2", """
WITH u AS (SELECT product_id, floor(amount / nullif(quantity_sold, 0)) AS price FROM fact UNION ALL SELECT product_id, floor(unit_price_php) FROM product UNION ALL SELECT product_id, price_php FROM price_change),
c AS (SELECT product_id, price, count(*) AS c FROM u WHERE price IS NOT NULL GROUP BY ALL)
SELECT product_id, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY c DESC, price) AS rn FROM c) WHERE rn = 1""")
def _(s):
    a = s.fact.filter("quantity_sold > 0").select("product_id", F.floor(F.col("amount") / F.col("quantity_sold")).cast("double").alias("price"))
    b = s.product.select("product_id", F.floor("unit_price_php").cast("double").alias("price"))
    c = s.price_change.select("product_id", F.col("price_php").alias("price"))
    return A.modal_value(a.unionByName(b).unionByName(c), "product_id", "price")
