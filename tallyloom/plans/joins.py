"""Joins bound to the star."""

from pyspark.sql import functions as F

from tallyloom.functions.text import fold_name, order_type
from tallyloom.operators import aggregates as A
from tallyloom.operators import joins as J
from tallyloom.operators import series as S
from tallyloom.operators.calendar import gap_runs
from tallyloom.plans.registry import plan

FLAGS = ["is_enrollment_period", "is_exam_week", "is_event_day", "is_sem_break"]


@plan("join_star", "category:s planning_month:s is_exam_week:l units:l", """
SELECT category, strftime(day, '%Y-%m') AS planning_month, is_exam_week, sum(quantity_sold) AS units
FROM sale JOIN calendar USING (day) JOIN product USING (product_id) GROUP BY ALL""")
def _(s):
    # sums per item, month and flag first: a hot item joins as a few dozen rows
    j = s.sale.join(F.broadcast(s.calendar), "day").groupBy("product_id", F.date_format("day", "yyyy-MM").alias("planning_month"), "is_exam_week").agg(F.sum("quantity_sold").alias("units"))
    return j.join(s.product, "product_id").groupBy("category", "planning_month", "is_exam_week").agg(F.sum("units").alias("units"))


@plan("join_left_stats", "product_id:l units:l observed_days:l", """
SELECT p.product_id, coalesce(sum(quantity_sold), 0) AS units, count(DISTINCT day) AS observed_days
FROM product p LEFT JOIN sale f USING (product_id) GROUP BY 1""")
def _(s):
    return s.product.join(A.product_stats(s.sale), "product_id", "left").select(
        "product_id", F.coalesce("total_units", F.lit(0)).alias("units"),
        F.coalesce("observed_days", F.lit(0)).alias("observed_days"))


# raw spellings of item names: every third item is written upper-case with
# doubled spaces, every seventh has no entry in the vocabulary
def raw_named(s):
    return raw_spelled(s.fact, s)


def raw_spelled(rows, s):
    """Adds the raw spelling to rows with product_id."""
    k = F.col("product_id")
    name = F.when(k % 3 == 0, F.concat(F.lit("  "), F.upper(F.regexp_replace("item_name", " ", "  ")), F.lit(" "))).otherwise(F.col("item_name"))
    return rows.join(s.product, "product_id").withColumn("raw_item", name)


def vocabulary(s):
    return s.product.filter(F.col("product_id") % 7 != 0).select(
        F.col("item_name").alias("raw_name"), F.concat(F.lit("C:"), "item_name").alias("canonical"))


_RAWN = """WITH rawn AS (SELECT f.*, CASE WHEN product_id % 3 = 0 THEN '  ' || upper(replace(item_name, ' ', '  ')) || ' ' ELSE item_name END AS raw_item, item_name FROM fact f JOIN product USING (product_id)),
vocab AS (SELECT item_name AS raw_name, 'C:' || item_name AS canonical FROM product WHERE product_id % 7 <> 0)
"""


@plan("map_with_folded_fallback", "raw_item:s canonical:s rows:l units:l", _RAWN + """
SELECT raw_item, coalesce(e.canonical, k.canonical) AS canonical, count(*) AS rows, sum(quantity_sold) AS units FROM rawn
LEFT JOIN vocab e ON e.raw_name = trim(raw_item) LEFT JOIN vocab k ON lower(k.raw_name) = regexp_replace(lower(trim(raw_item)), '\\s+', ' ', 'g') GROUP BY ALL""")
def _(s):
    own = s.fact.groupBy("product_id").agg(F.count("*").alias("rows"), F.sum("quantity_sold").alias("units"))
    names = raw_spelled(own, s).groupBy("raw_item").agg(F.sum("rows").alias("rows"), F.sum("units").alias("units"))
    return J.map_names(names, "raw_item", vocabulary(s))


@plan("map_unambiguous_key", "base_name:s match_type:s canonical:s units:l", """
WITH v AS (SELECT base_name AS key, count(DISTINCT category) AS c, min(category) AS canonical FROM product WHERE product_id % 7 = 0 GROUP BY 1)
SELECT p.base_name, CASE WHEN v.c = 1 THEN 'mapping' WHEN p.base_name LIKE 'old%' THEN 'category_only' ELSE 'unmapped' END AS match_type,
 CASE WHEN v.c = 1 THEN v.canonical END AS canonical, sum(quantity_sold) AS units FROM fact JOIN product p USING (product_id) LEFT JOIN v ON v.key = p.base_name GROUP BY ALL""")
def _(s):
    vocab = s.product.filter(F.col("product_id") % 7 == 0).select("base_name", F.col("category").alias("canonical"))
    keys = J.unambiguous(vocab, fold_name(F.col("base_name")))
    per_item = s.fact.groupBy("product_id").agg(F.sum("quantity_sold").alias("units")).join(s.product, "product_id")
    names = per_item.groupBy("base_name").agg(F.sum("units").alias("units"))
    return names.join(keys, fold_name(F.col("base_name")) == keys["key"], "left").withColumn(
        "match_type", F.when(F.col("canonical").isNotNull(), "mapping")
        .when(F.col("base_name").startswith("old"), "category_only").otherwise("unmapped"))


@plan("apply_confirmed_orders", "product_id:l day:D order_type:s units:l", """
WITH c AS (SELECT DISTINCT product_id, day, CASE WHEN product_id % 4 = 0 THEN 'bulk' WHEN product_id % 4 = 1 THEN 'pre_order' END AS ot FROM fact WHERE order_id % 40 = 0)
SELECT product_id, day, ot AS order_type, sum(quantity_sold) AS units FROM fact LEFT JOIN (SELECT * FROM c WHERE ot IS NOT NULL) USING (product_id, day) GROUP BY ALL""")
def _(s):
    answers = s.fact.filter(F.col("order_id") % 40 == 0).select("product_id", "day").distinct().withColumn(
        "answer", F.element_at(F.array(F.lit("Bulk order"), F.lit("Pre-Order"), F.lit("Walk-in"), F.lit("???")), (F.col("product_id") % 4 + 1).cast("int")))
    read = answers.withColumn("order_type", order_type(F.col("answer"), None)).filter(F.col("order_type").isin("bulk", "pre_order"))
    daily = s.fact.groupBy("product_id", "day").agg(F.sum("quantity_sold").alias("units"))
    return daily.join(read, ["product_id", "day"], "left")


@plan("provisional_names", "item:s units:l", _RAWN + """
SELECT coalesce(e.canonical, trim(raw_item)) AS item, sum(quantity_sold) AS units FROM rawn LEFT JOIN vocab e ON e.raw_name = trim(raw_item) GROUP BY 1""")
def _(s):
    v = vocabulary(s).withColumnRenamed("raw_name", "n")
    names = raw_named(s).groupBy(F.trim("raw_item").alias("n")).agg(F.sum("quantity_sold").alias("units"))
    return names.join(v, "n", "left").groupBy(F.coalesce("canonical", "n").alias("item")).agg(F.sum("units").alias("units"))


@plan("supplier_map", "supplier_name:s payment_status:s rows:l", """
SELECT s_name AS supplier_name, CASE WHEN s_suppkey % 5 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'PAID' ELSE 'CONSIGNMENT' END WHEN s_suppkey % 5 = 1 THEN 'UNKNOWN' ELSE 'Mapped' END AS payment_status, count(*) AS rows
FROM fact JOIN supplier ON s_suppkey = supplier_id GROUP BY ALL""")
def _(s):
    k = F.col("s_suppkey")
    raw = F.when(k % 5 == 0, F.concat("s_name", F.when(k % 2 == 0, " (Paid)").otherwise(" (Consignment)"))).otherwise(F.col("s_name"))
    sup = s.table("supplier").withColumn("raw_supplier", raw)
    known = sup.filter(k % 5 >= 2).select("raw_supplier", F.col("s_name").alias("known"), F.lit("Mapped").alias("status"))
    pat = r"\s*\((consignment|paid)\)\s*$"
    low = F.lower("raw_supplier")
    j = sup.join(known, "raw_supplier", "left").select(
        F.col("s_suppkey").alias("supplier_id"),
        F.coalesce("known", F.regexp_replace("raw_supplier", "(?i)" + pat, "")).alias("supplier_name"),
        F.coalesce("status", F.when(low.rlike(pat), F.upper(F.regexp_extract(low, pat, 1))).otherwise("UNKNOWN")).alias("payment_status"))
    counts = s.fact.groupBy("supplier_id").agg(F.count("*").alias("rows"))
    return counts.join(j, "supplier_id").groupBy("supplier_name", "payment_status").agg(F.sum("rows").alias("rows"))


@plan("anti_join_unmapped", "raw_item:s rows:l", _RAWN + """
SELECT raw_item, count(*) AS rows FROM rawn WHERE trim(raw_item) NOT IN (SELECT raw_name FROM vocab) GROUP BY 1""")
def _(s):
    names = raw_named(s).groupBy("raw_item").agg(F.count("*").alias("rows"))
    v = vocabulary(s)
    return names.join(v, F.trim("raw_item") == v["raw_name"], "left_anti")


@plan("semi_join_months", "product_id:l units:l", """
SELECT product_id, sum(quantity_sold) AS units FROM fact WHERE supplier_id IN (SELECT supplier_id FROM fact GROUP BY 1 HAVING count(*) >= 100) GROUP BY 1""")
def _(s):
    busy = s.fact.groupBy("supplier_id").agg(F.count("*").alias("c")).filter("c >= 100")
    return s.fact.join(busy, "supplier_id", "left_semi").groupBy("product_id").agg(F.sum("quantity_sold").alias("units"))


@plan("range_join_calendar", "day:D is_enrollment_period:l is_exam_week:l is_event_day:l is_sem_break:l units:l", """
SELECT day, is_enrollment_period, is_exam_week, is_event_day, is_sem_break, sum(quantity_sold) AS units FROM sale JOIN calendar USING (day) GROUP BY ALL""")
def _(s):
    flags = J.explode_ranges(s.calendar_ranges.filter("flag <> 'term'"), FLAGS)
    units = s.sale.groupBy("day").agg(F.sum("quantity_sold").alias("units"))
    return units.join(F.broadcast(flags), "day", "left").fillna(0, FLAGS)


@plan("term_windows", "semester_id:s semester_week:l days:l units:l", """
SELECT semester_id, semester_week, count(DISTINCT day) AS days, sum(quantity_sold) AS units FROM sale JOIN calendar USING (day) GROUP BY ALL""")
def _(s):
    units = s.sale.groupBy("day").agg(F.sum("quantity_sold").alias("units"))
    j = J.assign_terms(units, J.term_windows(s.calendar_ranges), s.span.select("last_day").scalar())
    return j.groupBy("semester_id", "semester_week").agg(F.count("*").alias("days"), F.sum("units").alias("units"))


@plan("asof_price_in_force", "product_id:l price_in_force:d2 rows:l units:l", """
SELECT product_id, (SELECT arg_max(price_php, (effective_from, change_id)) FROM price_change c WHERE c.product_id = f.product_id AND c.effective_from <= f.day) AS price_in_force, count(*) AS rows, sum(quantity_sold) AS units
FROM fact f GROUP BY ALL""")
def _(s):
    return J.price_in_force(s.fact, s.price_change).groupBy("product_id", "price_in_force").agg(
        F.count("*").alias("rows"), F.sum("quantity_sold").alias("units"))


def numbered(counts):
    y, m = F.substring("month", 1, 4).cast("int"), F.substring("month", 6, 2).cast("int")
    return counts.withColumn("month_no", y * 12 + m - 1)


def asked_months(s):
    return s.product_months.select("product_id", (F.year("month_start") * 12 + F.month("month_start") - 1).alias("month_no"))


@plan("nearest_month_stock", "product_id:l month_no:l weight:d2 basis:s", """
WITH st AS (SELECT product_id, CAST(month[1:4] AS INT) * 12 + CAST(month[6:7] AS INT) - 1 AS m, quantity FROM workbook_count),
r AS (SELECT a.product_id, a.month_no, st.m, st.quantity, row_number() OVER (PARTITION BY a.product_id, a.month_no ORDER BY abs(st.m - a.month_no), CASE WHEN st.m < a.month_no THEN 0 ELSE 1 END, st.m DESC) AS rn
 FROM counts a LEFT JOIN st USING (product_id))
SELECT product_id, month_no, coalesce(quantity, 0) AS weight, CASE WHEN m IS NULL THEN 'no_inventory' WHEN m = month_no THEN 'exact_month' WHEN m < month_no THEN 'nearest_month(-' || (month_no - m) || 'mo)' ELSE 'nearest_month(+' || (m - month_no) || 'mo)' END AS basis FROM r WHERE rn = 1""")
def _(s):
    return J.nearest_month_stock(asked_months(s), numbered(s.workbook_count))


@plan("asof_opening_stock", "product_id:l month_no:l opening:l count_month:l", """
WITH st AS (SELECT product_id, CAST(month[1:4] AS INT) * 12 + CAST(month[6:7] AS INT) - 1 AS m, quantity FROM workbook_count)
SELECT a.product_id, a.month_no, arg_max(st.quantity, m) AS opening, max(m) AS count_month FROM counts a LEFT JOIN st ON st.product_id = a.product_id AND st.m BETWEEN a.month_no - 1 AND a.month_no GROUP BY ALL""")
def _(s):
    return J.opening_stock(asked_months(s), numbered(s.workbook_count))


STOCK_SQL = """SELECT product_id, arg_max(quantity, (month, pri)) AS current_stock, max(month) AS stock_as_of, CASE WHEN arg_max(pri, (month, pri)) = 1 THEN 'counted' ELSE 'workbook' END AS stock_source
FROM (SELECT *, 0 AS pri FROM workbook_count UNION ALL SELECT *, 1 FROM staff_count) GROUP BY 1"""


@plan("latest_of_two_sources", "product_id:l current_stock:l stock_as_of:s stock_source:s", STOCK_SQL)
def _(s):
    return J.latest_stock(s.workbook_count, s.staff_count)


@plan("full_outer_stock_history", "product_id:l month:s qty:l source:s", """
SELECT product_id, month, coalesce(s.quantity, w.quantity) AS qty, CASE WHEN s.quantity IS NOT NULL THEN 'counted' ELSE 'workbook' END AS source
FROM workbook_count w FULL JOIN staff_count s USING (product_id, month)""")
def _(s):
    return J.stock_history(s.workbook_count, s.staff_count)


_RANGES = """WITH yrs AS (SELECT unnest(range(year(first_day), year(last_day) + 1)) AS y FROM span),
per AS (SELECT * FROM (VALUES ('Enrollment second term', 'is_enrollment_period', 101, 114), ('Enrollment summer', 'is_enrollment_period', 601, 614), ('Final exams May', 'is_exam_week', 515, 520),
 ('Final exams December', 'is_exam_week', 1215, 1220), ('Foundation Week', 'is_event_day', 424, 428), ('Paskuhan (date uncertain - verify)', 'is_event_day', 1210, 1212), ('Christmas break', 'is_sem_break', 1222, 1231)) v(event_name, flag, a, b)),
ranges AS (SELECT event_name, flag, make_date(y, a // 100, a % 100) AS start_date, make_date(y, b // 100, b % 100) AS end_date FROM yrs, per),
evl AS (SELECT make_date(y, 4, 25) AS d, 'foundation week' AS event_name FROM yrs UNION ALL SELECT make_date(y, 10, 3), 'Alumni Homecoming' FROM yrs)
"""


@plan("interval_overlap_clip", "start_day:D end_day:D name:s kind:s units:l", _RANGES + """
SELECT start_day, end_day, name, kind, coalesce(sum(quantity_sold), 0) AS units FROM (
 SELECT DISTINCT greatest(start_date, lo) AS start_day, least(end_date, hi) AS end_day, trim(regexp_replace(event_name, '\\(date uncertain[^)]*\\)', '')) AS name, flag AS kind
 FROM (SELECT * FROM ranges UNION ALL SELECT event_name, 'event', d, d FROM evl), (SELECT last_day - 300 AS lo, last_day - 3 AS hi FROM span) WHERE start_date <= hi AND end_date >= lo)
LEFT JOIN sale ON day BETWEEN start_day AND end_day GROUP BY ALL""")
def _(s):
    last = s.span.select("last_day").scalar()
    entries = s.calendar_ranges.filter("flag <> 'term'").select("event_name", F.col("flag").alias("kind"), "start_date", "end_date")
    entries = entries.unionByName(s.event_log.select("event_name", F.lit("event").alias("kind"), F.col("event_date").alias("start_date"), F.col("event_date").alias("end_date")))
    clipped = J.clip_overlaps(entries, F.date_sub(last, 300), F.date_sub(last, 3))
    days = clipped.withColumn("day", F.explode(F.sequence("start_day", "end_day")))
    units = s.sale.groupBy("day").agg(F.sum("quantity_sold").alias("u"))
    return days.join(units, "day", "left").groupBy("start_day", "end_day", "name", "kind").agg(F.coalesce(F.sum("u"), F.lit(0)).alias("units"))


def busy_runs(s):
    from tallyloom.functions.calendar import planning_kind

    days = s.calendar.withColumn("kind", planning_kind()).filter(F.col("kind").isin("enrollment", "term_start"))
    return gap_runs(days, ["kind"], "day", 3)


@plan("interval_containment", "event_name:s event_date:D part_of:s", _RANGES + """
SELECT event_name, d AS event_date, flag AS part_of FROM evl LEFT JOIN ranges r ON d BETWEEN start_date AND end_date AND r.event_name = 'Foundation Week'""".replace("SELECT event_name, d", "SELECT evl.event_name, d"))
def _(s):
    hosts = s.calendar_ranges.filter("event_name = 'Foundation Week'").select(
        F.explode(F.sequence("start_date", "end_date")).alias("event_date"), F.col("flag").alias("part_of"))
    return s.event_log.join(F.broadcast(hosts), "event_date", "left")


RUNS_SQL = """WITH b AS (SELECT planning_kind AS kind, day FROM kinds WHERE planning_kind IN ('enrollment', 'term_start')),
g AS (SELECT *, sum(brk) OVER (PARTITION BY kind ORDER BY day) AS run FROM (SELECT *, CASE WHEN date_diff('day', lag(day) OVER (PARTITION BY kind ORDER BY day), day) <= 3 THEN 0 ELSE 1 END AS brk FROM b)),
runs AS (SELECT kind, min(day) AS run_start, max(day) AS run_end, count(*) AS days FROM g GROUP BY kind, run)
"""


@plan("nearest_last_year", "kind:s start_day:D end_day:D ly_start:D ly_end:D ly_units:l", RUNS_SQL.rstrip() + """,
ls AS (SELECT max(day) AS d FROM sale WHERE quantity_sold > 0),
c AS (SELECT w.kind, w.run_start AS start_day, w.run_end AS end_day, r.run_start AS rs, r.run_end AS re, row_number() OVER (PARTITION BY w.kind, w.run_start ORDER BY abs(date_diff('day', r.run_start, w.run_start - 365)), r.run_start) AS rn
 FROM runs w LEFT JOIN runs r ON r.kind = w.kind AND r.run_end <= (SELECT d FROM ls) AND abs(date_diff('day', r.run_start, w.run_start - 365)) <= 60),
p AS (SELECT kind, start_day, end_day, coalesce(rs, CASE WHEN end_day - 364 <= (SELECT d FROM ls) THEN start_day - 364 END) AS ly_start, coalesce(re, CASE WHEN end_day - 364 <= (SELECT d FROM ls) THEN end_day - 364 END) AS ly_end FROM c WHERE rn = 1)
SELECT kind, start_day, end_day, ly_start, ly_end, sum(quantity_sold) AS ly_units FROM p LEFT JOIN sale ON day BETWEEN ly_start AND ly_end GROUP BY ALL""")
def _(s):
    last = s.sale.filter("quantity_sold > 0").agg(F.max("day")).scalar()
    runs = busy_runs(s)
    windows = runs.select("kind", F.col("run_start").alias("start_day"), F.col("run_end").alias("end_day"))
    picked = J.nearest_last_year(runs, windows, last)
    days = picked.withColumn("day", F.explode_outer(F.sequence("ly_start", "ly_end")))
    units = s.sale.groupBy("day").agg(F.sum("quantity_sold").alias("u"))
    return days.join(units, "day", "left").groupBy("kind", "start_day", "end_day", "ly_start", "ly_end").agg(F.sum("u").alias("ly_units"))


@plan("full_outer_month_delta", "month:s old_units:l new_units:l delta:l", """
SELECT coalesce(a.month, b.month) AS month, a.u AS old_units, b.u AS new_units, coalesce(b.u, 0) - coalesce(a.u, 0) AS delta
FROM (SELECT strftime(day, '%Y-%m') AS month, sum(quantity_sold) AS u FROM fact WHERE day < (SELECT newest FROM marks) GROUP BY 1) a
FULL JOIN (SELECT strftime(day, '%Y-%m') AS month, sum(quantity_sold) AS u FROM sale WHERE day >= (SELECT date_trunc('month', first_day) + INTERVAL 2 MONTH FROM marks) GROUP BY 1) b ON a.month = b.month WHERE coalesce(b.u, 0) <> coalesce(a.u, 0)""")
def _(s):
    """An older load without the newest month against a newer one without the first two."""
    start = F.add_months(F.trunc(s.mark("first_day"), "month"), 2)
    return J.month_delta(s.fact.filter(F.col("day") < s.mark("newest")), s.sale.filter(F.col("day") >= start))


@plan("cross_densify", "sku:s category:s day:D pos:l qty:d0", "SELECT sku, category, day, pos, qty FROM series")
def _(s):
    return S.densify(s.sku_day, ["sku", "category"])


@plan("blocked_pair_join", "supplier_id:l product_id:l other_id:l shared_base:l", """
SELECT a.supplier_id, a.product_id, b.product_id AS other_id, CAST(a.base_name = b.base_name AS INTEGER) AS shared_base
FROM product_full a JOIN product_full b ON a.supplier_id = b.supplier_id AND a.category = b.category AND a.brand = b.brand AND a.product_id < b.product_id""")
def _(s):
    # the candidate pairs are the feature; the block is supplier, category and brand
    block = ["supplier_id", "category", "brand"]
    n = s.product_full.select(*block, "product_id", "base_name")
    other = n.select(*block, F.col("product_id").alias("other_id"), F.col("base_name").alias("other_base"))
    return n.join(other, block).filter("product_id < other_id").select(
        "supplier_id", "product_id", "other_id", (F.col("base_name") == F.col("other_base")).cast("int").alias("shared_base"))


@plan("correction_apply", "product_id:l day:D quantity_sold:l imputation_flag:l correction_id:l rows:l", """
WITH k AS (SELECT product_id, day, quantity_sold, imputation_flag, count(*) AS c FROM fact GROUP BY ALL),
cor AS (SELECT product_id, day, quantity_sold, imputation_flag, product_id * 10000 + date_diff('day', DATE '1990-01-01', day) AS correction_id,
  CASE WHEN day(day) % 2 = 0 THEN 1 ELSE 0 END AS is_deleted, quantity_sold + 1 AS new_q, row_number() OVER (PARTITION BY product_id, day ORDER BY quantity_sold, imputation_flag) AS pick FROM k),
cr AS (SELECT *, 1 AS rn FROM cor WHERE pick = 1 AND product_id % 10 = 3),
f AS (SELECT product_id, day, quantity_sold, imputation_flag, row_number() OVER (PARTITION BY product_id, day, quantity_sold, imputation_flag ORDER BY order_id, line_no) AS rn FROM fact)
SELECT product_id, day, coalesce(new_q, quantity_sold) AS quantity_sold, imputation_flag, correction_id, count(*) AS rows FROM f LEFT JOIN cr USING (product_id, day, quantity_sold, imputation_flag, rn) WHERE coalesce(is_deleted, 0) = 0 GROUP BY ALL""")
def _(s):
    per_day = s.fact.filter(F.col("product_id") % 10 == 3).groupBy("product_id", "day").agg(
        F.min(F.struct("quantity_sold", "imputation_flag")).alias("m"))
    cor = per_day.select(
        "product_id", "day", "m.quantity_sold", "m.imputation_flag",
        (F.col("product_id") * 10000 + F.datediff("day", F.lit("1990-01-01").cast("date"))).alias("correction_id"),
        (F.dayofmonth("day") % 2 == 0).cast("int").alias("is_deleted"),
        (F.col("m.quantity_sold") + 1).alias("new_quantity_sold"))
    rows = s.fact.select("product_id", "day", "quantity_sold", "imputation_flag", "order_id", "line_no")
    out = J.apply_corrections(rows, cor, ["product_id", "day", "quantity_sold", "imputation_flag"], ["order_id", "line_no"])
    return out.groupBy("product_id", "day", "quantity_sold", "imputation_flag", "correction_id").agg(F.count("*").alias("rows"))
