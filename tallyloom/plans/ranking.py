"""Sorted and top-k reports, bound to the star."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import joins as J
from tallyloom.operators import windows as W
from tallyloom.operators.ranking import top_per_group
from tallyloom.plans.aggregates import item_pesos
from tallyloom.plans.joins import STOCK_SQL
from tallyloom.plans.registry import plan
from tallyloom.plans.windows import _HAND, _PHP, hand
from tallyloom.sources.star import month_key


@plan("topk_sellers", "product_id:l units:l php:d2 share:d6", _PHP + """
SELECT product_id, units, php, php / (SELECT sum(php) FROM ip) AS share FROM ip ORDER BY coalesce(php, 0) DESC, units DESC, product_id LIMIT 10""")
def _(s):
    ip = item_pesos(s)
    total = ip.agg(F.sum("php")).scalar()
    return ip.orderBy(F.desc(F.coalesce("php", F.lit(0.0))), F.desc("units"), "product_id").limit(10).withColumn("share", F.col("php") / total)


_DRIVE = """WITH m AS (SELECT product_id, category, strftime(day, '%Y-%m') AS month, sum(quantity_sold) AS u, sum(quantity_sold) * any_value(coalesce(unit_price_php, 0)) AS php FROM sale JOIN product USING (product_id) WHERE strftime(day, '%Y-%m') IN (SELECT DISTINCT strftime(day, '%Y-%m') FROM sale ORDER BY 1 DESC LIMIT 2) GROUP BY ALL),
d AS (SELECT product_id, category, sum(CASE WHEN month = (SELECT max(month) FROM m) THEN php ELSE -php END) AS diff FROM m GROUP BY ALL),
c AS (SELECT category, sum(diff) AS cdiff FROM d GROUP BY 1)
"""


@plan("topk_per_group", "category:s product_id:l diff:d2 rank_no:l", _DRIVE + """
SELECT * FROM (SELECT d.category, product_id, diff, row_number() OVER (PARTITION BY d.category ORDER BY abs(diff) DESC, product_id) AS rank_no FROM d JOIN c USING (category) WHERE diff * cdiff > 0) WHERE rank_no <= 2""")
def drivers(s):
    """The two items that moved each category most, the way it moved.

    The salted top-k keeps a hot category from being sorted in one task.
    """
    # per item and month the whole fact is a small table; the two newest months with data are compared
    months = s.sale.groupBy("product_id", month_key("day").alias("month")).agg(F.sum("quantity_sold").alias("u"))
    newest = months.select("month").distinct().orderBy(F.desc("month")).limit(2).agg(F.max("month").alias("new"), F.min("month").alias("old"))
    m = months.join(F.broadcast(newest), F.col("month").isin(F.col("new"), F.col("old"))).join(s.product, "product_id")
    php = F.col("u") * F.coalesce("unit_price_php", F.lit(0.0))
    d = m.groupBy("product_id", "category").agg(F.sum(F.when(F.col("month") == F.col("new"), php).otherwise(-php)).alias("diff"))
    c = d.groupBy("category").agg(F.sum("diff").alias("cdiff"))
    moved = d.join(F.broadcast(c), "category").filter(F.col("diff") * F.col("cdiff") > 0)
    return top_per_group(moved, "category", F.struct(F.abs("diff").alias("a"), (-F.col("product_id")).alias("b")),
                         ["product_id", "diff"], 2)


@plan("sort_nulls_last", "product_id:l days_of_supply:d2 stock:l", _HAND.rstrip() + f""",
l AS (SELECT product_id, arg_max(ds, day) AS days_of_supply FROM (SELECT product_id, day, CASE WHEN counted IS NOT NULL AND broken IS NULL AND rate > 0 THEN round_even(greatest(on_hand, 0) / rate, 2) END AS ds FROM st) WHERE ds IS NOT NULL GROUP BY 1)
SELECT p.product_id, days_of_supply, k.current_stock AS stock FROM product p LEFT JOIN l USING (product_id) LEFT JOIN ({STOCK_SQL}) k USING (product_id)""")
def _(s):
    dos = W.stock_state(hand(s)).filter("days_of_supply IS NOT NULL").groupBy("product_id").agg(
        F.max_by("days_of_supply", "day").alias("days_of_supply"))
    stock = J.latest_stock(s.workbook_count, s.staff_count)
    return s.product.join(dos, "product_id", "left").join(stock, "product_id", "left").select(
        "product_id", "days_of_supply", F.col("current_stock").alias("stock")).orderBy(
        F.asc_nulls_last("days_of_supply"), F.desc_nulls_last("stock"), "product_id")


@plan("topk_recent", "product_id:l item_name:s day:D order_id:l line_no:l quantity_sold:l", """
SELECT product_id, item_name, day, order_id, line_no, quantity_sold FROM fact JOIN product USING (product_id) ORDER BY day DESC, order_id DESC, line_no DESC, amount DESC LIMIT 20""")
def _(s):
    last = s.fact.orderBy(F.desc("day"), F.desc("order_id"), F.desc("line_no"), F.desc("amount")).limit(20)
    return last.join(s.product, "product_id")


STATUS_RANK = ("rush_now", "rush_by", "reorder", "uncounted", "covered")


@plan("sort_status_rank", "product_id:l status:s status_rank:l place:l", f"""
WITH r AS (SELECT p.product_id, item_name, coalesce(u, 0) AS u, CASE WHEN k.current_stock IS NULL THEN 'uncounted' WHEN k.current_stock < 10 THEN 'rush_now' WHEN k.current_stock < 20 THEN 'rush_by' WHEN k.current_stock < 40 THEN 'reorder' ELSE 'covered' END AS status
 FROM product p LEFT JOIN ({STOCK_SQL}) k USING (product_id) LEFT JOIN (SELECT product_id, sum(quantity_sold) AS u FROM sale GROUP BY 1) USING (product_id)),
o AS (SELECT *, CASE status WHEN 'rush_now' THEN 0 WHEN 'rush_by' THEN 1 WHEN 'reorder' THEN 2 WHEN 'uncounted' THEN 3 ELSE 4 END AS status_rank FROM r)
SELECT product_id, status, status_rank, row_number() OVER (ORDER BY status_rank, u DESC, item_name) AS place FROM o""")
def _(s):
    from tallyloom.operators.scale import ranked_running

    stock = J.latest_stock(s.workbook_count, s.staff_count)
    u = s.sale.groupBy("product_id").agg(F.sum("quantity_sold").alias("u"))
    q = F.col("current_stock")
    status = (F.when(q.isNull(), "uncounted").when(q < 10, "rush_now").when(q < 20, "rush_by").when(q < 40, "reorder").otherwise("covered"))
    r = s.product.join(stock, "product_id", "left").join(u, "product_id", "left").withColumn("status", status)
    rank = F.array_position(F.array(*[F.lit(x) for x in STATUS_RANK]), F.col("status")) - 1
    r = r.withColumn("status_rank", rank).withColumn("u", F.coalesce("u", F.lit(0)))
    # one sortable number: better status first, then more units
    big = F.lit(1 << 40)
    key = (F.lit(len(STATUS_RANK)) - F.col("status_rank")) * big + F.col("u")
    return ranked_running(r.withColumn("key", key), "key", ["item_name"]).withColumnRenamed("rank_no", "place")
