"""Calendar outlook and season planning bound to the star."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import calendar as C
from tallyloom.operators import joins as J
from tallyloom.operators import season as N
from tallyloom.operators.scale import cut_lineage
from tallyloom.plans import policy as PP
from tallyloom.plans.aggregates import DAYS_SQL
from tallyloom.plans.joins import FLAGS, RUNS_SQL, _RANGES, busy_runs
from tallyloom.plans.registry import plan


@plan("cal_build", "day:D semester_id:s semester_week:l is_enrollment_period:l is_exam_week:l is_event_day:l is_sem_break:l is_store_closed:l is_tally_date:l is_tally_date_positive:l", """
SELECT day, semester_id, semester_week, is_enrollment_period, is_exam_week, CASE WHEN month(day) * 100 + day(day) IN (425, 1003) THEN 1 ELSE is_event_day END AS is_event_day, is_sem_break, is_store_closed,
CASE WHEN t.q IS NOT NULL THEN 1 ELSE 0 END AS is_tally_date, CASE WHEN t.q > 0 THEN 1 ELSE 0 END AS is_tally_date_positive FROM calendar LEFT JOIN (SELECT day, sum(quantity_sold) AS q FROM fact GROUP BY 1) t USING (day)""")
def _(s):
    tally = s.fact.groupBy("day").agg(F.sum("quantity_sold").alias("q")).select(
        "day", F.lit(1).alias("is_tally_date"), (F.col("q") > 0).cast("int").alias("is_tally_date_positive"))
    return C.build_calendar(s.calendar.select("day"), s.calendar_ranges, s.closure_log, s.event_log, tally, FLAGS)


@plan("cal_day_table", "day:D kind:s closed:l units:d0 recorded:l", DAYS_SQL + "SELECT * FROM dt")
def _(s):
    return C.day_table(s.calendar, s.sale)


_BASE = DAYS_SQL + """,
rg AS (SELECT * FROM dt WHERE recorded = 1 AND kind = 'regular'), lr AS (SELECT max(day) AS d FROM dt WHERE recorded = 1),
us AS (SELECT * FROM rg WHERE (SELECT count(*) FROM rg, lr WHERE day > d - 90) < 10 OR day > (SELECT d FROM lr) - 90),
bs AS (SELECT avg(units) AS per_day, count(*) AS days, min(day) AS from_day, max(day) AS to_day FROM us)
"""


@plan("cal_baseline", "per_day:d6 days:l from_day:D to_day:D", _BASE + "SELECT * FROM bs")
def _(s):
    return C.baseline(C.day_table(s.calendar, s.sale))


@plan("cal_expected", "start_day:D end_day:D kind:s past_days:l lift:d6 per_day:d4", _BASE.rstrip() + "," + RUNS_SQL[5:] + """,
x AS (SELECT run_start, run_end, coalesce(dt.kind, 'regular') AS kind FROM runs JOIN days ON day BETWEEN run_start AND run_end LEFT JOIN dt USING (day)),
k AS (SELECT run_start, run_end, x.kind, lf.days AS past_days, count(*) AS c, sum(coalesce(lift, 1)) AS ls FROM x LEFT JOIN lf ON lf.kind = x.kind GROUP BY ALL)
SELECT run_start AS start_day, run_end AS end_day, arg_min(kind, (-c, kind)) AS kind, arg_min(past_days, (-c, kind)) AS past_days, sum(ls) / sum(c) AS lift, sum(ls) / sum(c) * (SELECT per_day FROM bs) AS per_day FROM k GROUP BY ALL""")
def _(s):
    days = C.day_table(s.calendar, s.sale)
    windows = busy_runs(s).select(F.col("run_start").alias("start_day"), F.col("run_end").alias("end_day"))
    return C.expected(windows, days, C.lifts(days))


@plan("cal_last_year_series", "start_day:D day:D kind:s closed:l units:d0 in_window:l", DAYS_SQL.rstrip() + "," + RUNS_SQL[5:] + """
SELECT run_start AS start_day, dt.day, dt.kind, closed, CASE WHEN recorded = 1 THEN units END AS units, CASE WHEN dt.day BETWEEN run_start AND run_end THEN 1 ELSE 0 END AS in_window FROM runs JOIN dt ON dt.day BETWEEN run_start - 7 AND run_end + 7""")
def _(s):
    runs = busy_runs(s).select(F.col("run_start").alias("start_day"), F.col("run_end").alias("end_day"))
    return C.last_year_series(runs, C.day_table(s.calendar, s.sale))


_WIN = DAYS_SQL.rstrip() + "," + RUNS_SQL[5:] + """,
td AS (SELECT last_day AS t, (SELECT max(day) FROM days) AS pe FROM span),
wn AS (SELECT kind, run_start AS a, run_end AS b, 0 AS estimated FROM runs, td WHERE run_end >= t AND run_start <= t + 365
 UNION ALL SELECT kind, CAST(run_start + INTERVAL 1 YEAR AS DATE), CAST(run_end + INTERVAL 1 YEAR AS DATE), 1 FROM runs, td WHERE run_start >= t - 365 AND run_start < t AND run_start + INTERVAL 1 YEAR > pe AND run_start + INTERVAL 1 YEAR <= t + 365 AND run_end + INTERVAL 1 YEAR >= t)
"""


def windows(s):
    days = C.day_table(s.calendar, s.sale)
    pe = s.calendar.filter("semester_id IS NOT NULL").agg(F.max("day")).scalar()
    return C.upcoming_windows(busy_runs(s), C.lifts(days), s.span.select("last_day").scalar(), pe)


@plan("cal_busy_windows", "kind:s start_day:D end_day:D estimated:l days:l lift:d6", _WIN + "SELECT kind, a AS start_day, b AS end_day, estimated, date_diff('day', a, b) + 1 AS days, coalesce(lift, 1) AS lift FROM wn LEFT JOIN lf USING (kind)")
def _(s):
    return windows(s)


@plan("cal_event_effect", "event:s event_day:D years:l lift:d6 past_days:l tag:s", DAYS_SQL.rstrip() + "," + _RANGES[5:].rstrip() + """,
ev AS (SELECT DISTINCT CASE WHEN lower(event_name) LIKE 'foundation week%' THEN 'foundation' WHEN event_name LIKE 'Paskuhan%' THEN 'paskuhan' ELSE 'alumni' END AS fam, event_name AS name, a, b FROM (SELECT event_name, start_date AS a, end_date AS b FROM ranges WHERE flag = 'is_event_day' UNION ALL SELECT event_name, d, d FROM evl)),
tt AS (SELECT last_day - 365 AS t FROM span),
p AS (SELECT e.name AS event, e.a AS event_day, year(q.a) AS y, arg_min(q.a, (q.a, q.b, q.name)) AS a, arg_min(q.b, (q.a, q.b, q.name)) AS b FROM ev e JOIN ev q ON q.fam = e.fam, tt WHERE e.a >= t AND q.a < t AND abs(date_diff('day', make_date(year(e.a), month(q.a), day(q.a)), e.a)) <= 10 GROUP BY ALL),
x AS (SELECT event, event_day, y, avg(units) / (SELECT avg(units) FROM dt WHERE recorded = 1 AND kind = 'regular') AS ef, count(units) AS c FROM p LEFT JOIN dt ON dt.day BETWEEN p.a - 1 AND p.b AND recorded = 1 GROUP BY ALL)
SELECT event, event_day, count(ef) AS years, avg(ef) AS lift, sum(c) AS past_days, CASE WHEN count(ef) = 0 THEN 'unknown' WHEN count(ef) >= 2 AND min(ef) >= 1.5 THEN 'rush' WHEN max(ef) < 1 THEN 'quieter' ELSE 'mixed' END AS tag FROM x GROUP BY ALL""")
def _(s):
    ev = s.calendar_ranges.filter("flag = 'is_event_day'").select(F.col("event_name").alias("name"), F.col("start_date").alias("start_day"), F.col("end_date").alias("end_day"))
    ev = ev.unionByName(s.event_log.select(F.col("event_name").alias("name"), F.col("event_date").alias("start_day"), F.col("event_date").alias("end_day")))
    return N.event_effects(ev, C.day_table(s.calendar, s.sale), F.date_sub(s.span.select("last_day").scalar(), 365))


@plan("season_plan", "product_id:l kind:s start_day:D order_by:D window_need:d1 rush_extra:d1 stock_at_start:d1 to_order:l status:s", PP.PRE + PP.SET_SQL + "," + _WIN[5:].rstrip() + """,
nd AS (SELECT ro.*, wn.kind, a, t, coalesce(lift, 1) AS lf, date_diff('day', greatest(a, t), b) + 1 AS ds, st - rate * greatest(date_diff('day', t, a), 0) AS at0 FROM ro JOIN wn ON rate > 0 AND rop IS NOT NULL LEFT JOIN lf USING (kind), td),
sh AS (SELECT *, greatest(ceil(rate * lf * ds + ss2 - at0), 0) AS short FROM nd)
SELECT product_id, kind, a AS start_day, greatest(a - CAST(L2 AS INT), t) AS order_by, round_even(rate * lf * ds + ss2, 1) AS window_need, round_even(rate * (lf - 1) * ds, 1) AS rush_extra, round_even(at0, 1) AS stock_at_start,
CASE WHEN st IS NOT NULL THEN short END AS to_order, CASE WHEN st IS NULL THEN 'uncounted' WHEN short <= 0 THEN 'covered' WHEN a - CAST(L2 AS INT) <= t THEN 'order_now' ELSE 'order_by' END AS status FROM sh""")
def plan_rows(s):
    return N.season_needs(PP.status(s), windows(s), s.span.select("last_day").scalar())


def event_items(events, items, today):
    """One row for each coming event and fast item, and the units expected in 30 days."""
    ahead = events.filter(F.col("event_date") >= today).agg(F.collect_set(F.struct("event_name", "event_date"))).scalar()  # bounded by the calendar
    return items.withColumn("e", F.explode(ahead)).select(
        F.lit("event").alias("topic"), F.concat_ws(" ", "e.event_name", F.col("e.event_date").cast("string")).alias("title"),
        F.lit(1).alias("sev"), "product_id", (F.col("rate") * 30).alias("weight"))


@plan("advisories", "topic:s title:s severity:s n_items:l product_id:l weight:d4")
def _(s):
    """One row per advisory and item it concerns. Advisories: busy windows, coming
    events, decision rules, items to reorder and the forecast of fast items."""
    from tallyloom.operators.classify import fsn_classify
    from tallyloom.plans.classify import decisions

    today = s.span.select("last_day").scalar()
    # classified once for the policy, the decisions and the fast items
    classes = cut_lineage(fsn_classify(s.product, s.sale), "classes")
    items = cut_lineage(PP.status(s, PP.Ctx(s, classes)), "status")
    plans = N.season_needs(items, windows(s), today).filter(F.col("status").isin("order_now", "order_by"))
    a = plans.select(F.lit("season").alias("topic"), F.concat_ws(" ", "kind", F.col("start_day").cast("string")).alias("title"),
                     F.when(F.col("status") == "order_now", 2).otherwise(1).alias("sev"), "product_id", F.col("to_order").cast("double").alias("weight"))
    d = decisions(s, classes).filter(F.col("action").isin("review_discontinuation", "clear_out", "promote"))
    b = d.select(F.lit("decision").alias("topic"), F.col("action").alias("title"), F.lit(1).alias("sev"), "product_id", (-F.col("product_id")).cast("double").alias("weight"))
    st = items.filter("needs_reorder = 1")
    c = st.select(F.lit("stock").alias("topic"), F.lit("reorder now").alias("title"), F.lit(2).alias("sev"), "product_id", F.col("order_qty").cast("double").alias("weight"))
    fast = classes.filter("fsn_class = 'F'").select("product_id").join(items.select("product_id", "rate"), "product_id", "left")
    e = event_items(s.event_log, fast, today)
    f = fast.filter("rate IS NOT NULL").select(F.lit("forecast").alias("topic"), F.lit("most expected in 30 days").alias("title"), F.lit(2).alias("sev"), "product_id", (F.col("rate") * 30).alias("weight"))
    rows = cut_lineage(a.unionByName(b).unionByName(c).unionByName(e).unionByName(f), "advisories")
    head = rows.groupBy("topic", "title").agg(F.max("sev").alias("sev"), F.count("*").alias("n_items"))
    return rows.drop("sev").join(head, ["topic", "title"]).withColumn("severity", F.when(F.col("sev") == 2, "act").otherwise("watch"))


_GUIDE = PP.PRE + PP.SET_SQL + """,
g AS (SELECT ro.*, rate * 30 AS total, rate * 30 + sigma * sqrt(30) AS high FROM ro WHERE rate IS NOT NULL)
SELECT product_id, total, high, CASE WHEN total >= 0.5 AND st IS NOT NULL THEN greatest(0, ceil(total - st)) END AS to_cover, CASE WHEN total >= 0.5 AND st > rop THEN (SELECT d1 FROM hb) + CAST(floor((st - rop) / rate) AS INT) END AS order_by,
CASE WHEN total < 0.5 THEN 'no_demand' WHEN st IS NULL THEN 'count_stock' WHEN st <= rop THEN 'reorder_now' WHEN floor((st - rop) / rate) <= 29 THEN 'order_by' WHEN total - st > 0 THEN 'short' WHEN high - st > 0 THEN 'watch' ELSE 'covered' END AS action FROM g"""


@plan("forecast_guidance", "product_id:l total:d4 high:d4 to_cover:l order_by:D action:s", _GUIDE)
def _(s):
    c = PP.Ctx(s)
    g = PP.status(s, c).filter("rate IS NOT NULL")
    st, rop, rate = F.col("current_stock"), F.col("reorder_point"), F.col("rate")
    total, high = rate * 30, rate * 30 + F.col("sigma") * F.sqrt(F.lit(30.0))
    wait = F.floor((st - rop) / rate).cast("int")
    action = (F.when(total < 0.5, "no_demand").when(st.isNull(), "count_stock").when(st <= rop, "reorder_now").when(wait <= 29, "order_by")
              .when(total - st > 0, "short").when(high - st > 0, "watch").otherwise("covered"))
    return g.select("product_id", total.alias("total"), high.alias("high"),
                    F.when((total >= 0.5) & st.isNotNull(), F.greatest(F.lit(0), F.ceil(total - st))).alias("to_cover"),
                    F.when((total >= 0.5) & (st > rop), F.date_add(c.d1, wait)).alias("order_by"), action.alias("action"))


@plan("sold_since_forecast", "product_id:l day:D sold:l", """
WITH t AS (SELECT DISTINCT day FROM sale, span WHERE day > last_day - 30), p AS (SELECT DISTINCT product_id FROM walkin), w AS (SELECT product_id, day, sum(quantity_sold) AS u FROM walkin GROUP BY ALL)
SELECT p.product_id, t.day, coalesce(u, 0) AS sold FROM p CROSS JOIN t LEFT JOIN w ON w.product_id = p.product_id AND w.day = t.day""")
def _(s):
    days = s.sale.filter(F.col("day") > F.date_sub(s.span.select("last_day").scalar(), 30)).agg(F.collect_set("day")).scalar()  # at most 30
    grid = s.walkin.select("product_id").distinct().withColumn("day", F.explode(days))
    w = s.walkin.groupBy("product_id", "day").agg(F.sum("quantity_sold").alias("u"))
    return grid.join(w, ["product_id", "day"], "left").withColumn("sold", F.coalesce("u", F.lit(0)))


@plan("history_per_tally_day", "category:s month:s units:l tally_days:l", """
WITH t AS (SELECT DISTINCT day FROM sale), m AS (SELECT category, day, sum(quantity_sold) AS u FROM sale JOIN product USING (product_id) GROUP BY ALL), f AS (SELECT category, min(day) AS first FROM m WHERE u > 0 GROUP BY 1)
SELECT f.category, strftime(t.day, '%Y-%m') AS month, sum(coalesce(u, 0)) AS units, count(*) AS tally_days FROM f JOIN t ON t.day >= f.first LEFT JOIN m ON m.category = f.category AND m.day = t.day GROUP BY ALL""")
def _(s):
    own = s.sale.groupBy("product_id", "day").agg(F.sum("quantity_sold").alias("u"))
    m = own.join(s.product, "product_id").groupBy("category", "day").agg(F.sum("u").alias("u"))
    first = m.filter("u > 0").groupBy("category").agg(F.min("day").alias("first"))
    tally = s.sale.agg(F.collect_set("day")).scalar()  # bounded by the calendar
    grid = first.withColumn("day", F.explode(tally)).filter("day >= first")
    j = grid.join(m, ["category", "day"], "left")
    return j.groupBy("category", F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum(F.coalesce("u", F.lit(0))).alias("units"), F.count("*").alias("tally_days"))
