"""Streaming jobs over the events table, read back for checking."""

from pyspark.sql import functions as F

from tallyloom.plans.registry import plan
from tallyloom.streaming import live as L

_EV = "WITH ev AS (SELECT event_id, user_id AS product_id, ts, CAST(ts AS DATE) AS day, event_type AS kind, CAST(floor(value) AS BIGINT) AS quantity FROM events)\n"


def live_days(s):
    return L.live_days(L.tally_stream(s.spark, s.path))


@plan("st_ingest_validate", "status:s product_id:l rows:l units:l", _EV + """
SELECT CASE WHEN quantity < 0 OR kind = 'error' THEN 'quarantine' WHEN product_id % 7 = 0 THEN 'held' ELSE 'valid' END AS status, product_id, count(*) AS rows, sum(quantity) AS units FROM ev GROUP BY ALL""")
def _(s):
    known = s.table("events").select(F.col("user_id").alias("product_id")).distinct().filter(F.col("product_id") % 7 != 0)
    path = L.ingest(L.tally_stream(s.spark, s.path), known)
    rows = s.spark.read.option("basePath", path).parquet(path)
    return rows.groupBy("status", "product_id").agg(F.count("*").alias("rows"), F.sum("quantity").alias("units"))


@plan("st_daily_units", "product_id:l day:D units:l", _EV + "SELECT product_id, day, sum(quantity) AS units FROM ev GROUP BY ALL")
def _(s):
    return L.daily_units(live_days(s))


@plan("st_sliding_rate", "product_id:l from_day:D units:l", _EV + """
SELECT product_id, day - CAST(k AS INT) AS from_day, sum(quantity) AS units FROM ev, (SELECT unnest(range(28)) AS k) GROUP BY ALL""")
def _(s):
    return L.sliding_units(live_days(s))


@plan("st_session_runs", "product_id:l run_start:D run_end:D rows:l", _EV + """,
d AS (SELECT product_id, day, count(*) AS c FROM ev GROUP BY ALL),
g AS (SELECT *, sum(b) OVER (PARTITION BY product_id ORDER BY day) AS r FROM (SELECT *, CASE WHEN date_diff('day', lag(day) OVER (PARTITION BY product_id ORDER BY day), day) <= 3 THEN 0 ELSE 1 END AS b FROM d))
SELECT product_id, min(day) AS run_start, max(day) AS run_end, sum(c) AS rows FROM g GROUP BY product_id, r""")
def _(s):
    return L.session_runs(live_days(s))


@plan("st_dedup_latest", "product_id:l kind:s quantity:l event_id:l", _EV + """
SELECT product_id, kind, arg_max(quantity, (ts, event_id)) AS quantity, arg_max(event_id, (ts, event_id)) AS event_id FROM ev GROUP BY ALL""")
def _(s):
    return L.latest_per_key(L.tally_stream(s.spark, s.path)).select("product_id", "kind", "quantity", "event_id")


@plan("st_stock_state", "product_id:l day:D on_hand:l is_censored:l", _EV + """,
d AS (SELECT product_id, day, strftime(day, '%Y-%m') AS month, sum(quantity) AS u FROM ev WHERE kind <> 'error' GROUP BY ALL),
h AS (SELECT *, CASE WHEN product_id % 5 <> 0 THEN product_id * 37 % 900 + 100 END - coalesce(sum(u) OVER (PARTITION BY product_id, month ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS on_hand FROM d),
b AS (SELECT *, max(CASE WHEN on_hand <= 0 AND u > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY product_id, month ORDER BY day) AS br FROM h)
SELECT product_id, day, on_hand, CASE WHEN on_hand IS NOT NULL AND br = 0 THEN CASE WHEN on_hand <= 0 THEN 1 ELSE 0 END END AS is_censored FROM b""")
def _(s):
    k = F.col("product_id")
    counts = s.table("events").select(F.col("user_id").alias("product_id"), F.date_format("ts", "yyyy-MM").alias("month")).distinct().filter(k % 5 != 0).select(
        "product_id", "month", (k * 37 % 900 + 100).alias("counted"))
    return L.stock_state(live_days(s), counts)


@plan("st_pending_since_run", "kind:s pending:l newest_id:l", _EV + """
SELECT kind, count(*) FILTER (event_id > m) AS pending, max(event_id) AS newest_id FROM ev, (SELECT max(event_id) * 6 // 10 AS m FROM ev) GROUP BY 1""")
def _(s):
    ev = L.as_tally(s.table("events"))
    run_log = ev.agg(F.floor(F.max("event_id") * 6 / 10).alias("mark"))
    return ev.withColumn("mark", run_log.scalar()).groupBy("kind").agg(
        F.count(F.when(F.col("event_id") > F.col("mark"), 1)).alias("pending"), F.max("event_id").alias("newest_id"))
