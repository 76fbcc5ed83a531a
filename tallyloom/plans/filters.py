"""Filters and predicates."""

from pyspark.sql import functions as F

from tallyloom.operators import filters as O
from tallyloom.plans.registry import plan


def _totals(df, *keys):
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("quantity_sold").alias("units"))


@plan("filter_sales_only", "product_id:l rows:l units:l",
      "SELECT product_id, count(*) AS rows, sum(quantity_sold) AS units FROM sale GROUP BY 1")
def _(s):
    return _totals(O.sales_only(s.fact), "product_id")


@plan("filter_walk_in", "product_id:l rows:l units:l",
      "SELECT product_id, count(*) AS rows, sum(quantity_sold) AS units FROM walkin GROUP BY 1")
def _(s):
    return _totals(O.walk_in_only(s.sale), "product_id")


@plan("filter_catalog", "product_id:l item_name:s",
      "SELECT product_id, item_name FROM product_full WHERE category = 'PROMO' AND supplier_name = 'Supplier#000000003'")
def _(s):
    return O.match_catalog(O.match_catalog(s.product_full, "All Suppliers", "PROMO"), "Supplier#000000003", "All Categories")


@plan("range_bounds", "scope:s month:s units:l", """
WITH m AS (SELECT DISTINCT strftime(day, '%Y-%m') AS month FROM sale),
c AS (SELECT min(month) AS cut FROM (SELECT month FROM m ORDER BY month DESC LIMIT 3))
SELECT 'last3' AS scope, strftime(day, '%Y-%m') AS month, sum(quantity_sold) AS units FROM sale WHERE strftime(day, '%Y-%m') >= (SELECT cut FROM c) GROUP BY ALL
UNION ALL SELECT 'custom', strftime(day, '%Y-%m'), sum(quantity_sold) FROM sale WHERE strftime(day, '%Y-%m') BETWEEN '1997-02' AND '1998-05' GROUP BY ALL
UNION ALL SELECT 'all', strftime(day, '%Y-%m'), sum(quantity_sold) FROM sale GROUP BY ALL""")
def _(s):
    out = None
    for scope, args in (("last3", ("Last 3 Months",)), ("custom", ("Custom Range", "1998-05", "1997-02")), ("all", ("All Time",))):
        part = O.in_range(s.sale, *args).groupBy(F.lit(scope).alias("scope"), F.date_format("day", "yyyy-MM").alias("month")).agg(
            F.sum("quantity_sold").alias("units"))
        out = part if out is None else out.unionByName(part)
    return out


@plan("drop_censored", "product_id:l rows:l units:l",
      "SELECT product_id, count(*) AS rows, sum(quantity_sold) AS units FROM sale WHERE is_censored IS DISTINCT FROM 1 GROUP BY 1")
def _(s):
    return _totals(O.drop_censored(s.sale), "product_id")


@plan("eligible_population", "product_id:l fsn_class:s units:l", """
WITH u AS (SELECT product_id, sum(quantity_sold) AS units FROM sale GROUP BY 1)
SELECT product_id, fsn_class, units FROM ({FSN}) JOIN u USING (product_id) WHERE fsn_class IN ('F', 'S') AND units > 0"""
      .replace("{FSN}", __import__("tallyloom.plans.classify", fromlist=["FSN_SQL"]).FSN_SQL))
def _(s):
    from tallyloom.operators.classify import fsn_classify

    units = s.sale.groupBy("product_id").agg(F.sum("quantity_sold").alias("units"))
    return fsn_classify(s.product, s.sale).filter(F.col("fsn_class").isin("F", "S")).select(
        "product_id", "fsn_class").join(units.filter("units > 0"), "product_id")


@plan("sufficiency_tier", "tier:s items:l", """
SELECT tier, count(*) AS items FROM (SELECT product_id, CASE WHEN n >= 60 THEN 'full' WHEN n >= 30 THEN 'limited' ELSE 'insufficient' END AS tier
 FROM (SELECT product_id, count(DISTINCT CASE WHEN quantity_sold > 0 THEN day END) AS n FROM walkin GROUP BY 1)) GROUP BY 1""")
def _(s):
    n = s.walkin.groupBy("product_id").agg(F.countDistinct(F.when(F.col("quantity_sold") > 0, F.col("day"))).alias("n"))
    return n.groupBy(O.sufficiency_tier(F.col("n")).alias("tier")).agg(F.count("*").alias("items"))


@plan("discontinued_flag", "product_id:l discontinued:l", """
SELECT p.product_id, CASE WHEN last IS NULL OR date_diff('day', last, (SELECT last_day FROM span)) >= 365 THEN 1 ELSE 0 END AS discontinued
FROM product p LEFT JOIN (SELECT product_id, max(day) AS last FROM sale WHERE quantity_sold > 0 GROUP BY 1) USING (product_id)""")
def _(s):
    last = s.sale.filter("quantity_sold > 0").groupBy("product_id").agg(F.max("day").alias("last"))
    return s.product.join(last, "product_id", "left").select(
        "product_id", O.discontinued_on(F.col("last"), s.span.select("last_day").scalar()).alias("discontinued"))


@plan("listed_90_days", "product_id:l entry_date:D",
      "SELECT product_id, entry_date FROM product WHERE entry_date <= (SELECT last_day FROM span) - 90")
def _(s):
    return s.product.filter(F.col("entry_date") <= F.date_sub(s.span.select("last_day").scalar(), 90))
