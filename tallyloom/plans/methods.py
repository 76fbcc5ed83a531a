"""Series and forecast methods bound to the star.

The series is one per product line (brand x type): the whole fact is summed
into it, whatever its size, and the dense grid is bounded by lines x days.
"""

from pyspark.sql import functions as F

from tallyloom.functions import calendar as C
from tallyloom.operators import backtest as B
from tallyloom.operators import methods as M
from tallyloom.operators import series as S
from tallyloom.plans.registry import plan

PLAN = B.FoldPlan()
DEPLOY = B.Deploy()

TRAIN = """WITH fold AS (SELECT 11 - j AS fold, n - 30 * (j + 1) AS train_end, n FROM (SELECT max(n) AS n FROM series), (SELECT unnest(range(12)) AS j)),
train AS (SELECT s.sku, s.category, s.day, s.pos, s.qty, fold, train_end, train_end - 1 - pos AS age FROM series s JOIN fold ON s.pos < train_end),
ctrain AS (SELECT s.category, s.day, s.pos, s.qty, fold, train_end, train_end - 1 - pos AS age FROM category_series s JOIN fold ON s.pos < train_end),
kd AS (SELECT date_diff('day', d0, k.day) AS pos, k.* FROM kinds k, hist),
ahead AS (SELECT fold, kd.pos - train_end AS h, kd.* FROM kd JOIN fold ON kd.pos >= train_end AND kd.pos < train_end + 30),
sl AS (SELECT *, row_number() OVER (PARTITION BY sku, fold ORDER BY pos DESC) - 1 AS sage, pos - coalesce(lag(pos) OVER (PARTITION BY sku, fold ORDER BY pos), -1) AS gap, count(*) OVER (PARTITION BY sku, fold) AS k FROM train WHERE qty > 0)
"""
CROSTON_SQL = """SELECT sku, fold, sum(0.1 * pow(0.9, sage) * qty) + pow(0.9, any_value(k)) * avg(qty) AS z, sum(0.1 * pow(0.9, sage) * gap) + pow(0.9, any_value(k)) * avg(gap) AS p,
 sum(CASE WHEN sage = k - 1 THEN 1.0 ELSE 0.1 END * pow(0.9, sage) * qty) / sum(CASE WHEN sage = k - 1 THEN 1.0 ELSE 0.1 END * pow(0.9, sage) * gap) AS first_init FROM sl GROUP BY ALL"""


def tsb_sql(a, b):
    return f"""SELECT t.sku, t.fold, coalesce((pb + pow(1 - {b}, n) * k / n) * (z + pow(1 - {a}, k) * m), 0) AS level FROM
 (SELECT sku, fold, any_value(train_end) AS n, sum(CASE WHEN qty > 0 THEN {b} * pow(1 - {b}, age) END) AS pb FROM train GROUP BY ALL) t
 LEFT JOIN (SELECT sku, fold, sum({a} * pow(1 - {a}, sage) * qty) AS z, avg(qty) AS m, any_value(k) AS k FROM sl GROUP BY ALL) q ON q.sku = t.sku AND q.fold = t.fold"""


def train(s, plan_=PLAN, limit=None):
    """Full-history training rows, with sale ranks for the smoothing methods."""
    return B.training_rows(B.with_sale_ranks(s.series, "sku"), plan_, limit)


def recent(s, window, plan_=PLAN):
    """Training rows of the last ``window`` days of each fold."""
    return B.training_rows(s.series, plan_, window=window)


def one_level(s, window=None, **methods):
    return M.levels(recent(s, window) if window else train(s), ["sku"], methods)


def day_rows(s, plan_=PLAN):
    """Calendar days with kind, closure and position on the history."""
    h = S.history(s.sku_day, ["sku", "category"])
    d0, n = h.select("d0").scalar(), h.select(F.datediff("d1", "d0") + 1).scalar()
    cal = s.calendar.select("day", C.demand_kind().alias("kind"), C.planning_kind().alias("planning"),
                            F.col("is_store_closed").alias("closed"), "semester_week", "is_sem_break",
                            "is_enrollment_period", "is_exam_week", "is_event_day")
    return M.day_frame(cal, d0, n, plan_)


def cat_train(s, plan_=PLAN):
    cal = day_rows(s, plan_).select("day", "kind", "closed", "semester_week")
    return B.training_rows(s.category_series.join(F.broadcast(cal), "day"), plan_)


# ------------------------------------------------------------------ series
@plan("series_daily", "sku:s pos:l day:D qty:d0", "SELECT sku, pos, day, qty FROM series")
def _(s):
    return s.series


@plan("series_category", "category:s pos:l day:D qty:d0", "SELECT category, pos, day, qty FROM category_series")
def _(s):
    return s.category_series


@plan("series_trim", "sku:s day:D qty:d0", "SELECT sku, day, qty FROM series WHERE day <= (SELECT max(day) FROM series WHERE qty > 0)")
def _(s):
    return S.trim_to_history(s.series)


@plan("series_trading_days", "sku:s day:D pos:l qty:d0", """
SELECT sku, day, row_number() OVER (PARTITION BY sku ORDER BY day) - 1 AS pos, qty FROM series WHERE day IN (SELECT day FROM fact WHERE line_no = 2)""")
def _(s):
    return S.trading_days(s.series, s.fact.filter("line_no = 2").select("day"))


@plan("series_observed_mask", "day:D observed:l", """
SELECT day, CASE WHEN is_sem_break = 1 OR is_store_closed = 1 OR day IN (SELECT day FROM fact WHERE line_no = 2) THEN 1 ELSE 0 END AS observed FROM calendar""")
def _(s):
    return S.observed_mask(s.calendar, s.fact.filter("line_no = 2"))


@plan("series_blocks", "sku:s back:l units:d0", "SELECT sku, (n - 1 - pos) // 30 AS back, sum(qty) AS units FROM series WHERE (n - 1 - pos) // 30 < n // 30 GROUP BY ALL")
def _(s):
    return S.blocks(s.series, 30, ["sku"])


@plan("series_extend_synthetic", "category:s day:D pos:l qty:d0 is_synthetic:l is_gap:l", """
WITH x AS (SELECT category, CAST(day - INTERVAL 1 YEAR AS DATE) AS day, sum(qty) AS qty FROM category_series, marks WHERE day < date_trunc('month', first_day) + INTERVAL 10 MONTH GROUP BY ALL),
d AS (SELECT category, day, qty FROM x WHERE day < (SELECT d0 FROM hist) UNION ALL SELECT category, day, qty FROM category_series),
b AS (SELECT min(day) AS a, max(CASE WHEN qty > 0 THEN day END) AS z FROM d), g AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day, a FROM b)
SELECT k.category, g.day, date_diff('day', g.a, g.day) AS pos, coalesce(d.qty, 0) AS qty, CASE WHEN g.day < (SELECT d0 FROM hist) THEN 1 ELSE 0 END AS is_synthetic,
CASE WHEN g.day < (SELECT d0 FROM hist) AND g.day > (SELECT max(day) FROM x) THEN 1 ELSE 0 END AS is_gap FROM (SELECT DISTINCT category FROM product) k CROSS JOIN g LEFT JOIN d ON d.category = k.category AND d.day = g.day""")
def _(s):
    daily = s.sku_day.groupBy("category", "day").agg(F.sum("qty").alias("qty"))
    # the first ten months stand for those of the year before
    extra = daily.filter(F.col("day") < F.add_months(F.trunc(s.mark("first_day"), "month"), 10)).groupBy("category", F.add_months("day", -12).alias("day")).agg(F.sum("qty").alias("qty"))
    return S.extend_history(daily, extra, ["category"])


@plan("series_winsor_bulk", "sku:s pos:l qty:d1", """
SELECT sku, pos, CASE WHEN qty > 3 * med THEN med ELSE qty END AS qty FROM series JOIN (SELECT sku, quantile_cont(qty, 0.5) FILTER (qty > 0) AS med FROM series GROUP BY 1) USING (sku)""")
def _(s):
    return S.winsorise_bulk(s.series, 3.0)


# ----------------------------------------------------------- level methods
def _level_sql(**exprs):
    return TRAIN + "SELECT sku, fold, " + ", ".join(f"{e} AS {k}" for k, e in exprs.items()) + " FROM train GROUP BY ALL"


@plan("fc_naive", "sku:s fold:l level:d6", _level_sql(level="arg_max(qty, pos)"))
def _(s):
    return one_level(s, 1, level=M.naive())


@plan("fc_rolling_mean", "sku:s fold:l mean_7:d6 mean_30:d6 mean_90:d6", _level_sql(**{f"mean_{w}": f"avg(qty) FILTER (age < {w})" for w in (7, 30, 90)}))
def _(s):
    return one_level(s, 90, **{f"mean_{w}": M.rolling_mean(w) for w in (7, 30, 90)})


@plan("fc_rolling_median", "sku:s fold:l level:d6", _level_sql(level="quantile_cont(qty, 0.5) FILTER (age < 30)"))
def _(s):
    return one_level(s, 30, level=M.rolling_quantile(30))


@plan("fc_rolling_quantile", "sku:s fold:l q75:d6 q90:d6", _level_sql(q75="quantile_cont(qty, 0.75) FILTER (age < 30)", q90="quantile_cont(qty, 0.9) FILTER (age < 60)"))
def _(s):
    return one_level(s, 60, q75=M.rolling_quantile(30, 0.75), q90=M.rolling_quantile(60, 0.9))


@plan("fc_ewma", "sku:s fold:l level:d6", _level_sql(level="sum(CASE WHEN pos = 0 THEN pow(0.7, age) ELSE 0.3 * pow(0.7, age) END * qty)"))
def _(s):
    return one_level(s, level=M.ewma(0.3))


@plan("fc_croston", "sku:s fold:l level:d6 first_init:d6", TRAIN + f"SELECT sku, fold, coalesce(z / p, 0) AS level, coalesce(first_init, 0) AS first_init FROM (SELECT DISTINCT sku, fold FROM train) LEFT JOIN ({CROSTON_SQL}) USING (sku, fold)")
def _(s):
    return one_level(s, level=M.croston(0.1), first_init=M.croston(0.1, "first"))


@plan("fc_sba", "sku:s fold:l level:d6", TRAIN + f"SELECT sku, fold, coalesce(z / p * 0.95, 0) AS level FROM (SELECT DISTINCT sku, fold FROM train) LEFT JOIN ({CROSTON_SQL}) USING (sku, fold)")
def _(s):
    return one_level(s, level=M.croston(0.1, sba=True))


@plan("fc_tsb", "sku:s fold:l level:d6", TRAIN + tsb_sql(0.1, 0.1))
def _(s):
    return one_level(s, level=M.tsb(0.1, 0.1))


@plan("fc_weekly_hurdle", "sku:s fold:l level:d6", TRAIN + """
SELECT sku, fold, avg(CASE WHEN w > 0 THEN 1.0 ELSE 0.0 END) * coalesce(avg(CASE WHEN w > 0 THEN w END), 0) / 7 AS level FROM (SELECT sku, fold, age // 7 AS wk, sum(qty) AS w FROM train WHERE age // 7 < least(train_end // 7, 12) GROUP BY ALL) GROUP BY ALL""")
def _(s):
    return one_level(s, 84, level=M.weekly_hurdle())


@plan("fc_winsor_mean", "sku:s fold:l level:d6", TRAIN + """,
c AS (SELECT sku, fold, quantile_cont(qty, 0.95) AS cap FROM train WHERE age < 180 GROUP BY ALL) SELECT sku, fold, avg(least(qty, cap)) AS level FROM train JOIN c USING (sku, fold) WHERE age < 180 GROUP BY ALL""".replace(" SELECT sku, fold, avg(least", "\nSELECT sku, fold, avg(least"))
def _(s):
    return M.winsor_mean(recent(s, 180), ["sku"], 180, 0.95)


@plan("fc_block_stat", "sku:s fold:l median:d6 trimmed:d6", TRAIN + """,
b AS (SELECT sku, fold, age // 30 AS i, sum(qty) AS u FROM train WHERE age < 180 GROUP BY ALL)
SELECT sku, fold, quantile_cont(u, 0.5) / 30 AS median, (sum(u) - min(u) - max(u)) / 4 / 30 AS trimmed FROM b GROUP BY ALL""")
def _(s):
    return one_level(s, 180, median=M.block_stat("median"), trimmed=M.block_stat("trimmed"))


@plan("fc_limit_history", "sku:s fold:l ewma_365:d6 tsb_365:d6", TRAIN + """,
l AS (SELECT * FROM train WHERE age < 365),
q AS (SELECT *, row_number() OVER (PARTITION BY sku, fold ORDER BY pos DESC) - 1 AS sage, count(*) OVER (PARTITION BY sku, fold) AS k FROM l WHERE qty > 0),
z AS (SELECT sku, fold, sum(0.1 * pow(0.9, sage) * qty) + pow(0.9, any_value(k)) * avg(qty) AS z, any_value(k) AS k FROM q GROUP BY ALL)
SELECT l.sku, l.fold, sum(CASE WHEN age = 364 THEN 1.0 ELSE 0.3 END * pow(0.7, age) * qty) AS ewma_365, coalesce((sum(CASE WHEN qty > 0 THEN 0.1 * pow(0.9, age) END) + pow(0.9, 365) * any_value(z.k) / 365) * any_value(z.z), 0) AS tsb_365
FROM l LEFT JOIN z ON z.sku = l.sku AND z.fold = l.fold GROUP BY ALL""")
def _(s):
    return M.levels(train(s, limit=365), ["sku"], {"ewma_365": M.ewma(0.3), "tsb_365": M.tsb(0.1, 0.1)})


# -------------------------------------------------------- category methods
GRP = TRAIN + """,
o AS (SELECT sku, category, fold, any_value(train_end) AS train_end, """ + ", ".join(f"sum(CASE WHEN age < {w} THEN qty ELSE 0 END) AS o{w}" for w in (30, 90, 180, 365)) + """, sum(CASE WHEN pos >= train_end - 365 AND pos < train_end - 335 THEN qty ELSE 0 END) AS oly FROM train GROUP BY ALL),
g AS (SELECT category, fold, """ + ", ".join(f"sum(o{w}) AS g{w}" for w in (30, 90, 180, 365)) + """, sum(oly) AS gly FROM o GROUP BY ALL),
og AS (SELECT * FROM o JOIN g USING (category, fold))
"""
TD_SQL = "g180 / 180 * CASE WHEN g30 > 0 THEN o30 / g30 ELSE 0 END"


def sums(s, plan_=PLAN, with_tsb=False):
    """Trailing sums of each line and of its category, per fold."""
    t = train(s, plan_) if with_tsb else recent(s, 365, plan_)
    extra = [M.tsb(0.05, 0.05).alias("tsb")] if with_tsb else []
    own = t.groupBy("sku", "category", "fold", "train_end").agg(
        *[F.sum(F.when(F.col("age") < w, F.col("qty")).otherwise(0.0)).alias(f"own_{w}") for w in (30, 90, 180, 365)],
        F.sum(F.when(F.col("age").between(335, 364), F.col("qty")).otherwise(0.0)).alias("own_ly"), *extra)
    whole = own.groupBy("category", "fold").agg(*[F.sum(f"own_{w}").alias(f"grp_{w}") for w in (30, 90, 180, 365)], F.sum("own_ly").alias("grp_ly"))
    return own.join(whole, ["category", "fold"])


@plan("fc_topdown_share", "sku:s fold:l level:d6", GRP + f"SELECT sku, fold, {TD_SQL} AS level FROM og")
def _(s):
    t = M.group_sums(recent(s, 180), "sku", "category", (30, 180))
    return t.withColumn("level", M.topdown_share(t))


@plan("fc_blend", "sku:s fold:l level:d6", TRAIN + f"SELECT r.sku, r.fold, 0.3 * m30 + 0.2 * m90 + 0.5 * t.level AS level FROM (SELECT sku, fold, avg(qty) FILTER (age < 30) AS m30, avg(qty) FILTER (age < 90) AS m90 FROM train GROUP BY ALL) r JOIN ({tsb_sql(0.1, 0.1)}) t ON t.sku = r.sku AND t.fold = r.fold".replace("SELECT r.sku", "\nSELECT r.sku"))
def _(s):
    recipe = {"rolling_mean_30": 0.3, "rolling_mean_90": 0.2, "tsb": 0.5}
    menu = M.level_methods()
    wide = M.levels(train(s), ["sku"], {m: menu[m] for m in recipe})
    return wide.withColumn("level", sum((F.col(m) * w for m, w in recipe.items()), F.lit(0.0)))


TDTSB = GRP + f""",
base AS (SELECT og.sku, og.category, og.fold, og.train_end, 0.5 * {TD_SQL} + 0.5 * t.level AS level FROM og JOIN ({tsb_sql(0.05, 0.05)}) t ON t.sku = og.sku AND t.fold = og.fold)
"""


def topdown_tsb(s, plan_=PLAN):
    t = sums(s, plan_, with_tsb=True)
    return t.withColumn("level", F.greatest(0.5 * M.topdown_share(t) + 0.5 * F.col("tsb"), F.lit(0.0)))


@plan("fc_topdown_tsb", "sku:s fold:l level:d6", TDTSB + "SELECT sku, fold, level FROM base")
def _(s):
    return topdown_tsb(s)


def mult_sql(window):
    inside = "true" if window is None else f"age < {window}"
    return f""",
ck AS (SELECT c.*, k.demand_kind AS kind FROM ctrain c JOIN kinds k ON k.day = c.day),
tm AS (SELECT category, fold, avg(qty) FILTER ({inside}) AS m FROM ck GROUP BY ALL),
ty AS (SELECT category, fold, t.kind, coalesce(n, 0) AS n, raw, coalesce(l, 0) AS l, coalesce(hh, 0) AS hh FROM (SELECT DISTINCT category, fold FROM ck) x CROSS JOIN (SELECT unnest(['enrol', 'break', 'exam', 'normal']) AS kind) t
 LEFT JOIN (SELECT category, fold, kind, count(*) FILTER ({inside}) AS n, avg(qty) FILTER ({inside}) AS raw, count(*) FILTER (age < 180) AS l FROM ck GROUP BY ALL) r USING (category, fold, kind)
 LEFT JOIN (SELECT fold, demand_kind AS kind, count(*) AS hh FROM ahead GROUP BY ALL) q USING (fold, kind)),
mu AS (SELECT category, fold, least(1, (sum(hh * r) / sum(hh)) / (sum(l * r) / sum(l))) AS mult FROM (SELECT ty.*, (n * coalesce(raw / m, 1) + 10) / (n + 10) AS r FROM ty JOIN tm USING (category, fold)) GROUP BY ALL)
"""


def multiplier(s, plan_=PLAN, ratio_window=365):
    days = day_rows(s, plan_)
    return M.calendar_multiplier(cat_train(s, plan_), "category", M.horizon_days(days, plan_), ratio_window)


@plan("fc_calendar_cap", "sku:s fold:l level:d6 mult:d6", TDTSB.rstrip() + mult_sql(365) + "SELECT sku, fold, level * mult AS level, mult FROM base JOIN mu USING (category, fold)")
def _(s):
    j = topdown_tsb(s).join(F.broadcast(multiplier(s)), ["category", "fold"])
    return j.withColumn("level", F.col("level") * F.col("mult"))


@plan("fc_calendar_all_history", "category:s fold:l mult:d6", TRAIN.rstrip() + mult_sql(None) + "SELECT category, fold, mult FROM mu")
def _(s):
    return multiplier(s, ratio_window=None)


@plan("fc_closure_scale", "sku:s fold:l level:d6", TRAIN + """,
c AS (SELECT f.fold, (SELECT avg(1 - is_store_closed) FROM ahead a WHERE a.fold = f.fold) / (SELECT avg(1 - is_store_closed) FROM kd WHERE pos < train_end AND pos >= train_end - 180) AS mult FROM fold f)
SELECT sku, fold, avg(qty) FILTER (age < 30) * any_value(mult) AS level FROM train JOIN c USING (fold) GROUP BY ALL""")
def _(s):
    days = day_rows(s)
    past = B.training_rows(days.filter("pos >= 0 AND pos < n"), PLAN)
    scale = M.closure_scale(past, M.horizon_days(days, PLAN))
    return one_level(s, 30, base=M.rolling_mean(30)).join(F.broadcast(scale), "fold").withColumn("level", F.col("base") * F.col("mult"))


@plan("fc_observed_rate", "sku:s fold:l level:d6", TRAIN + """,
t AS (SELECT train.*, is_store_closed AS c, CASE WHEN is_store_closed = 0 THEN row_number() OVER (PARTITION BY sku, fold, is_store_closed ORDER BY train.pos DESC) END AS r FROM train JOIN kd ON kd.pos = train.pos)
SELECT sku, fold, avg(qty) FILTER (r <= 30) * greatest(30 * (avg(1 - c) FILTER (age < 90)), 1) / 30 AS level FROM t GROUP BY ALL""")
def _(s):
    from pyspark.sql import Window

    days = day_rows(s).filter("pos >= 0 AND pos < n")
    traded = (1 - F.col("closed"))
    # the traded-day counter is the same for every series: one row per day
    days = days.withColumn("traded", traded).withColumn("t_pos", F.sum(traded).over(Window.partitionBy("n").orderBy("pos")))
    t = B.training_rows(s.series.join(F.broadcast(days.select("day", "traded", "t_pos")), "day"), PLAN)
    return M.observed_rate(t, ["sku"], 30)


@plan("fc_seasonal_naive", "sku:s fold:l h:l yhat:d6", TRAIN + """
SELECT sku, fold, h, qty AS yhat FROM train JOIN (SELECT unnest(range(30)) AS h) ON pos = train_end - 7 + h % 7""")
def _(s):
    return M.seasonal_naive(recent(s, 7), ["sku"], PLAN)


@plan("fc_seasonal_365", "sku:s fold:l h:l yhat:d6", TRAIN + "SELECT sku, fold, pos - (train_end - 365) AS h, qty AS yhat FROM train WHERE pos - (train_end - 365) BETWEEN 0 AND 29")
def _(s):
    return M.last_year_days(recent(s, 365), ["sku"], PLAN)


@plan("fc_seasonal_index", "sku:s fold:l h:l yhat:d6", TRAIN + """,
l AS (SELECT sku, fold, avg(qty) FILTER (age < 90) AS r, avg(qty) FILTER (age BETWEEN 365 AND 454) AS p, avg(qty) FILTER (age < 30) AS f FROM train GROUP BY ALL)
SELECT sku, fold, pos - (train_end - 365) AS h, CASE WHEN p > 0 THEN qty * least(greatest(r / p, 0.25), 4.0) ELSE f END AS yhat FROM train JOIN l USING (sku, fold) WHERE pos - (train_end - 365) BETWEEN 0 AND 29""")
def _(s):
    return M.seasonal_index(recent(s, 455), ["sku"], PLAN)


@plan("fc_semester_week", "sku:s fold:l h:l yhat:d6", TRAIN + """,
w AS (SELECT sku, fold, semester_week AS wk, avg(qty) AS a, count(*) AS c FROM train JOIN kd ON kd.pos = train.pos GROUP BY ALL), l AS (SELECT sku, fold, avg(qty) FILTER (age < 30) AS f FROM train GROUP BY ALL)
SELECT l.sku, l.fold, h, CASE WHEN c >= 3 THEN a ELSE f END AS yhat FROM l JOIN ahead ON ahead.fold = l.fold LEFT JOIN w ON w.sku = l.sku AND w.fold = l.fold AND w.wk = ahead.semester_week""")
def _(s):
    days = day_rows(s)
    t = B.training_rows(s.series.join(F.broadcast(days.select("day", "semester_week")), "day"), PLAN)
    return M.semester_week_mean(t, ["sku"], M.horizon_days(days, PLAN).select("fold", "h", "semester_week"))


def _clip_ratio(side):
    return f"o180 / 180 * CASE WHEN {side}365 > 0 THEN least(greatest({side}ly / ({side}365 / (365 / 30.0)), 0.5), 2.0) ELSE 1 END"


@plan("fc_seasonal_ratio", "sku:s fold:l item:d6 category:d6", GRP + f"SELECT sku, fold, {_clip_ratio('o')} AS item, {_clip_ratio('g')} AS category FROM og")
def _(s):
    t = sums(s).withColumnRenamed("category", "cat")
    return t.select("sku", "fold", M.seasonal_ratio(t, "own").alias("item"), M.seasonal_ratio(t, "grp").alias("category"))


@plan("fc_momentum", "sku:s fold:l level:d6", GRP + "SELECT sku, fold, o90 / 90 * CASE WHEN g365 > 0 THEN least(greatest((g90 / 90) / (g365 / 365), 0.5), 2.0) ELSE 0 END AS level FROM og")
def _(s):
    return sums(s).withColumn("level", M.momentum(90, 90, 365))


@plan("fc_dow_rate", "category:s fold:l h:l yhat:d6", TRAIN + """,
r AS (SELECT c.category, c.fold, isodow(c.day) AS dow, CASE WHEN qty > 0 THEN 1.0 ELSE 0.0 END AS t FROM ctrain c JOIN kinds k ON k.day = c.day WHERE age < 365 AND is_store_closed = 0),
d AS (SELECT category, fold, dow, avg(t) AS rate FROM r GROUP BY ALL), a AS (SELECT category, fold, avg(t) AS o FROM r GROUP BY ALL), b AS (SELECT category, fold, avg(qty) FILTER (age < 30) AS level FROM ctrain GROUP BY ALL)
SELECT b.category, b.fold, h, CASE WHEN is_store_closed = 1 THEN 0 ELSE level * coalesce(rate, o) END AS yhat FROM b JOIN a USING (category, fold) JOIN ahead ON ahead.fold = b.fold LEFT JOIN d ON d.category = b.category AND d.fold = b.fold AND d.dow = isodow(ahead.day)""")
def _(s):
    t = cat_train(s)
    level = t.groupBy("category", "fold").agg(F.avg(F.when(F.col("age") < 30, F.col("qty"))).alias("level"))
    ahead = M.horizon_days(day_rows(s), PLAN).select("fold", "h", "closed", F.weekday("day").alias("dow"))
    j = level.join(F.broadcast(ahead), "fold").join(F.broadcast(M.trade_rate(t, "category")), ["category", "fold", "dow"])
    return j.withColumn("yhat", F.when(F.col("closed") == 1, 0.0).otherwise(F.col("level") * F.col("rate")))


@plan("fc_plausibility_cap", "sku:s fold:l cap:d2 capped:d4", TRAIN + """,
b AS (SELECT sku, pos, sum(qty) OVER (PARTITION BY sku ORDER BY pos ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS t FROM series),
c AS (SELECT sku, fold, 3 * greatest(max(t), 1) AS cap FROM b JOIN fold ON pos < train_end AND pos >= 29 GROUP BY ALL)
SELECT sku, fold, any_value(cap) AS cap, least(30 * quantile_cont(qty, 0.9), any_value(cap)) AS capped FROM train JOIN c USING (sku, fold) WHERE age < 30 GROUP BY ALL""")
def _(s):
    cap = M.plausibility_cap(s.series, "sku", PLAN)
    wild = one_level(s, 30, base=M.rolling_quantile(30, 0.9))
    return wild.join(cap, ["sku", "fold"]).withColumn("capped", F.least(F.col("base") * 30, F.col("cap")))


@plan("fc_holt_winters", "sku:s fold:l h:l yhat:d6")
def _(s):
    grid = [(0.3, 0.05, 0.1, 0.95), (0.1, 0.05, 0.1, 0.95), (0.1, 0.01, 0.05, 0.9)]
    return M.holt_winters(s.series, "sku", PLAN, grid)


# ----------------------------------------------------- shapes and publishing
SHAPE_SQL = """,
dl AS (SELECT c.*, isodow(c.day) AS dow, k.is_store_closed AS closed FROM category_series c JOIN kinds k ON k.day = c.day WHERE c.pos >= c.n - 365),
pr AS (SELECT category, dow, avg(qty) FILTER (closed = 0) AS p FROM dl GROUP BY ALL), al AS (SELECT category, avg(qty) AS m FROM dl GROUP BY 1),
fd AS (SELECT kd.pos - n AS h, kd.day, isodow(kd.day) AS dow, is_store_closed AS closed FROM kd, (SELECT max(n) AS n FROM series) WHERE kd.pos >= n AND kd.pos < n + 30),
sw AS (SELECT al.category, h, fd.day, greatest(coalesce(p, m) * (1 - closed), 0) AS w FROM al CROSS JOIN fd LEFT JOIN pr ON pr.category = al.category AND pr.dow = fd.dow),
shape AS (SELECT category, h, day, CASE WHEN sum(w) OVER (PARTITION BY category) > 0 THEN w / sum(w) OVER (PARTITION BY category) ELSE 1.0 / count(*) OVER (PARTITION BY category) END AS weight FROM sw)
"""


def shape(s):
    days = day_rows(s, DEPLOY)
    return M.weekday_shape(cat_train(s, DEPLOY), "category", M.horizon_days(days, DEPLOY))


@plan("fc_shape_weekday", "category:s h:l day:D weight:d8", TRAIN.rstrip() + SHAPE_SQL + "SELECT * FROM shape")
def _(s):
    return shape(s)


PUB_SQL = TRAIN.rstrip() + SHAPE_SQL.rstrip() + """,
it AS (SELECT sku, category, avg(qty) FILTER (pos >= n - 30) AS level, stddev_samp(qty) FILTER (pos >= n - 90) AS sd, count(*) FILTER (qty > 0) AS sale_days FROM series GROUP BY ALL),
ko AS (SELECT sku, expected_date AS day, sum(quantity) AS extra FROM upcoming_order GROUP BY ALL)
"""


def publish_items(s):
    """Level x weekday shape, with a one-deviation band clipped at zero."""
    n = F.col("n")
    it = s.series.groupBy("sku", "category").agg(
        F.avg(F.when(F.col("pos") >= n - 30, F.col("qty"))).alias("level"),
        F.stddev_samp(F.when(F.col("pos") >= n - 90, F.col("qty"))).alias("sd"), F.count(F.when(F.col("qty") > 0, 1)).alias("sale_days"))
    f = it.join(F.broadcast(shape(s)), "category")
    yhat = F.col("level") * 30 * F.col("weight")
    return f.select("sku", "category", "day", "h", yhat.alias("yhat"), F.greatest(yhat - F.col("sd"), F.lit(0.0)).alias("yhat_lower"),
                    (yhat + F.col("sd")).alias("yhat_upper"), (F.col("sale_days") < 60).cast("int").alias("is_heuristic"))


@plan("fc_publish_items", "sku:s day:D yhat:d6 yhat_lower:d6 yhat_upper:d6 is_heuristic:l", PUB_SQL + """
SELECT sku, day, level * 30 * weight AS yhat, greatest(level * 30 * weight - sd, 0) AS yhat_lower, level * 30 * weight + sd AS yhat_upper, CASE WHEN sale_days < 60 THEN 1 ELSE 0 END AS is_heuristic FROM it JOIN shape USING (category)""")
def _(s):
    return publish_items(s)


@plan("fc_known_orders", "sku:s day:D yhat:d6 yhat_upper:d6", PUB_SQL + """
SELECT sku, day, level * 30 * weight + coalesce(extra, 0) AS yhat, level * 30 * weight + sd + coalesce(extra, 0) AS yhat_upper FROM it JOIN shape USING (category) LEFT JOIN ko USING (sku, day)""")
def _(s):
    return add_known_orders(publish_items(s), s.upcoming_order.withColumnRenamed("expected_date", "day"), "sku")


def add_known_orders(forecast, orders, key):
    extra = orders.groupBy(key, "day").agg(F.sum("quantity").alias("extra"))
    out = forecast.join(extra, [key, "day"], "left")
    for c in ("yhat", "yhat_lower", "yhat_upper"):
        out = out.withColumn(c, F.col(c) + F.coalesce("extra", F.lit(0)))
    return out


CATPUB_SQL = TRAIN.rstrip() + SHAPE_SQL.rstrip() + """,
ct AS (SELECT category, sum(qty) FILTER (pos >= n - 180) / 180 * 30 AS total FROM category_series GROUP BY 1),
ca AS (SELECT category, fold, 30 * avg(qty) FILTER (age < 180) AS pred FROM ctrain GROUP BY ALL),
cb AS (SELECT category, fold, sum(qty) AS actual FROM category_series JOIN fold ON pos >= train_end AND pos < train_end + 30 GROUP BY ALL),
rm AS (SELECT category, sqrt(avg(pow(actual - pred, 2))) AS rmse FROM ca JOIN cb USING (category, fold) GROUP BY 1)
"""


def category_scores(s):
    pred = M.levels(cat_train(s), ["category"], {"level": M.rolling_mean(180)}).withColumn("pred", F.col("level") * 30)
    return pred.join(B.actuals(s.category_series, "category", PLAN), ["category", "fold"])


def publish_categories(s):
    total = s.category_series.groupBy("category").agg((F.avg(F.when(F.col("pos") >= F.col("n") - 180, F.col("qty"))) * 30).alias("total"))
    rmse = category_scores(s).groupBy("category").agg(F.sqrt(F.avg(F.pow(F.col("actual") - F.col("pred"), F.lit(2.0)))).alias("rmse"))
    f = total.join(rmse, "category").join(shape(s), "category")
    y, sp = F.col("total") * F.col("weight"), F.col("rmse") * F.col("weight")
    return f.select("category", "day", y.alias("yhat"), F.greatest(y - sp, F.lit(0.0)).alias("yhat_lower"), (y + sp).alias("yhat_upper"), "total", "rmse")


@plan("fc_publish_categories", "category:s day:D yhat:d6 yhat_lower:d6 yhat_upper:d6", CATPUB_SQL + """
SELECT category, day, total * weight AS yhat, greatest(total * weight - rmse * weight, 0) AS yhat_lower, total * weight + rmse * weight AS yhat_upper FROM ct JOIN rm USING (category) JOIN shape USING (category)""")
def _(s):
    return publish_categories(s)


@plan("fc_topdown_allocate", "category:s product_id:l day:D yhat:d6", CATPUB_SQL.rstrip() + """,
u AS (SELECT category, product_id, sum(CASE WHEN day > last_day - 180 THEN quantity_sold ELSE 0 END) AS units FROM walkin JOIN product USING (product_id), span GROUP BY ALL),
sh AS (SELECT category, product_id, CASE WHEN sum(units) OVER (PARTITION BY category) > 0 THEN units / sum(units) OVER (PARTITION BY category) ELSE 1.0 / count(*) OVER (PARTITION BY category) END AS share FROM u)
SELECT category, product_id, day, total * weight * share AS yhat FROM ct JOIN shape USING (category) JOIN sh USING (category)""")
def _(s):
    from tallyloom.operators.windows import share_of_group

    daily = s.walkin.groupBy("product_id", "day").agg(F.sum("quantity_sold").cast("double").alias("qty")).join(s.product.select("product_id", "category"), "product_id")
    share = share_of_group(daily, s.span.select("last_day").scalar(), 180, "category", "product_id")
    # 30 days per category: small, fixed by categories x horizon
    return share.join(F.broadcast(publish_categories(s).select("category", "day", "yhat")), "category").withColumn("yhat", F.col("yhat") * F.col("share"))


@plan("fc_sum_of_items", "category:s day:D yhat:d6", PUB_SQL + "SELECT category, day, sum(level * 30 * weight) AS yhat FROM it JOIN shape USING (category) GROUP BY ALL")
def _(s):
    return publish_items(s).groupBy("category", "day").agg(F.sum("yhat").alias("yhat"))
