"""Back-tests and metrics bound to the star."""

from pyspark.sql import functions as F

from tallyloom.functions.calendar import planning_kind
from tallyloom.operators import backtest as B
from tallyloom.operators import calendar as CAL
from tallyloom.operators import classify as C
from tallyloom.operators import methods as M
from tallyloom.operators import metrics as X
from tallyloom.operators.scale import cut_lineage
from tallyloom.plans import methods as P
from tallyloom.plans.methods import PLAN, TDTSB, TRAIN, tsb_sql
from tallyloom.plans.registry import plan

METHODS = ("naive", "rolling_mean_30", "rolling_mean_90")
SC = TRAIN + """,
lv AS (SELECT sku, fold, arg_max(qty, pos) AS naive, avg(qty) FILTER (age < 30) AS rolling_mean_30, avg(qty) FILTER (age < 90) AS rolling_mean_90 FROM train GROUP BY ALL),
ac AS (SELECT sku, fold, sum(qty) AS actual FROM series JOIN fold ON pos >= train_end AND pos < train_end + 30 GROUP BY ALL),
bl AS (SELECT sku, (n - 1 - pos) // 30 AS back, sum(qty) AS u FROM series WHERE (n - 1 - pos) // 30 < n // 30 GROUP BY ALL),
df AS (SELECT sku, back, lead(u) OVER (PARTITION BY sku ORDER BY back) - u AS d FROM bl),
ns AS (SELECT sku, fold, avg(abs(d)) AS naive_scale, avg(d * d) AS sq_scale FROM df JOIN fold ON 11 - fold < back GROUP BY ALL),
fr AS (SELECT sku, fold, method, level * 30 AS pred, actual, abs(actual - level * 30) AS abs_error, naive_scale, sq_scale FROM
 (SELECT sku, fold, unnest(['naive', 'rolling_mean_30', 'rolling_mean_90']) AS method, unnest([naive, rolling_mean_30, rolling_mean_90]) AS level FROM lv) JOIN ac USING (sku, fold) LEFT JOIN ns USING (sku, fold))
"""
CORE_SQL = """count(*) AS n, avg(abs_error) AS mae, sqrt(avg(abs_error * abs_error)) AS rmse, avg(CASE WHEN actual <> 0 THEN abs_error / actual END) * 100 AS mape, count(*) FILTER (actual = 0) AS mape_undefined,
 avg(abs_error) / nullif(avg(naive_scale), 0) AS mase, avg(abs_error) / avg(naive_scale) FILTER (naive_scale > 0) AS mase_published, 100 * sum(abs_error) / nullif(sum(actual), 0) AS wape, 100 * (sum(pred) - sum(actual)) / nullif(sum(actual), 0) AS bias"""


def scored(s, plan_=PLAN, methods=METHODS, series=None):
    """Fold rows of the named methods; one pass over the training tail."""
    series = s.series if series is None else series
    menu = M.level_methods()
    wide = M.levels(B.training_rows(series, plan_, window=90), ["sku"], {m: menu[m] for m in methods})
    return B.score(M.long_form(wide, ["sku"], list(methods), plan_.horizon), series, "sku", plan_)


@plan("folds_rolling", "product_id:l fold:l train_end:l test_start:l test_end:l", """
WITH l AS (SELECT product_id, count(DISTINCT day) AS n FROM sale GROUP BY 1), o AS (SELECT product_id, n, unnest(range(CASE WHEN n - 2 - 4 - 8 >= 0 THEN (n - 14) // 4 + 1 ELSE 0 END)) AS j FROM l),
k AS (SELECT *, n - 6 - 4 * j AS train_end, count(*) OVER (PARTITION BY product_id) AS c FROM o WHERE j < 5)
SELECT product_id, c - 1 - j AS fold, train_end, train_end + 2 AS test_start, train_end + 6 AS test_end FROM k WHERE c >= 3""")
def _(s):
    lengths = s.sale.groupBy("product_id").agg(F.countDistinct("day").alias("n"))
    return B.fold_table(lengths, "product_id", B.FoldPlan(horizon=4, gap=2, min_train=8, max_folds=5, min_folds=3))


@plan("walk_forward", "sku:s method:s fold:l actual:d2 pred:d6 abs_error:d6 naive_scale:d6", SC + "SELECT * FROM fr")
def _(s):
    return scored(s)


@plan("holdout_8020", "sku:s block:l actual:d2 pred:d6 scale:d6", """
WITH c AS (SELECT *, CAST(floor(n * 0.8) AS BIGINT) AS cut FROM series),
l AS (SELECT sku, avg(qty) FILTER (pos >= cut - 30 AND pos < cut) * 30 AS pred FROM c GROUP BY 1),
b AS (SELECT sku, (cut - 1 - pos) // 30 AS back, sum(qty) AS u FROM c WHERE pos < cut AND (cut - 1 - pos) // 30 < cut // 30 GROUP BY ALL),
sc AS (SELECT sku, avg(abs(d)) AS scale FROM (SELECT sku, u - lag(u) OVER (PARTITION BY sku ORDER BY back) AS d FROM b) GROUP BY 1)
SELECT c.sku, (pos - cut) // 30 AS block, sum(qty) AS actual, any_value(pred) AS pred, any_value(scale) AS scale FROM c JOIN l ON l.sku = c.sku JOIN sc ON sc.sku = c.sku WHERE pos >= cut AND (pos - cut) // 30 < (n - cut) // 30 GROUP BY ALL""")
def _(s):
    cut = F.floor(F.col("n") * 0.8)
    c = s.series.withColumn("cut", cut)
    level = c.groupBy("sku").agg((F.avg(F.when(F.col("pos").between(F.col("cut") - 30, F.col("cut") - 1), F.col("qty"))) * 30).alias("pred"))
    train = c.filter("pos < cut").withColumn("n", F.col("cut"))
    from pyspark.sql import Window

    from tallyloom.operators.series import blocks

    b = blocks(train, 30, ["sku"]).withColumn("d", F.lead("units").over(Window.partitionBy("sku").orderBy("back")) - F.col("units"))
    scale = b.groupBy("sku").agg(F.avg(F.abs("d")).alias("scale"))
    block = F.floor((F.col("pos") - F.col("cut")) / 30)
    test = c.filter("pos >= cut").withColumn("block", block).filter(F.col("block") < F.floor((F.col("n") - F.col("cut")) / 30))
    return test.groupBy("sku", "block").agg(F.sum("qty").alias("actual")).join(level, "sku").join(scale, "sku")


@plan("score_pooled", "sku:s fold:l speed:s pred:d6", TRAIN + """,
a AS (SELECT sku, fold, sum(qty) / nullif(count(*) FILTER (qty > 0), 0) AS adus FROM train GROUP BY ALL),
cu AS (SELECT fold, quantile_cont(coalesce(adus, 0), 0.8) AS cut FROM a GROUP BY 1),
lb AS (SELECT sku, a.fold, CASE WHEN coalesce(adus, 0) >= cut THEN 'fast' ELSE 'slow' END AS speed FROM a JOIN cu ON cu.fold = a.fold),
pp AS (SELECT speed, t.fold, avg(CASE WHEN qty > 0 THEN 1.0 ELSE 0 END) FILTER (age < 30) AS p FROM train t JOIN lb ON lb.sku = t.sku AND lb.fold = t.fold GROUP BY ALL),
sz AS (SELECT sku, fold, coalesce(avg(qty) FILTER (age < 90 AND qty > 0), 0) AS size FROM train GROUP BY ALL)
SELECT lb.sku, lb.fold, lb.speed, 30 * p * size AS pred FROM lb JOIN pp ON pp.speed = lb.speed AND pp.fold = lb.fold JOIN sz ON sz.sku = lb.sku AND sz.fold = lb.fold""")
def _(s):
    t = P.train(s)
    g = t.groupBy("sku", "fold").agg(
        F.sum("qty").alias("units"), F.count(F.when(F.col("qty") > 0, 1)).alias("sale_days"),
        F.count(F.when((F.col("age") < 30) & (F.col("qty") > 0), 1)).alias("sold30"), F.count(F.when(F.col("age") < 30, 1)).alias("days30"),
        F.coalesce(F.avg(F.when((F.col("age") < 90) & (F.col("qty") > 0), F.col("qty"))), F.lit(0.0)).alias("size"))
    g = cut_lineage(g, "fold-totals")
    lab = g.join(C.fold_speed(None, g), ["sku", "fold"])
    pooled = lab.groupBy("speed", "fold").agg((F.sum("sold30") / F.sum("days30")).alias("p"))
    return lab.join(F.broadcast(pooled), ["speed", "fold"]).withColumn("pred", 30 * F.col("p") * F.col("size"))


@plan("metric_core", "method:s sku:s n:l mae:d6 rmse:d6 mape:d6 mape_undefined:l mase:d6 mase_published:d6 wape:d6 bias:d6", SC + f"SELECT method, sku, {CORE_SQL} FROM fr GROUP BY ALL")
def _(s):
    return X.core(scored(s), ["method", "sku"])


@plan("metric_naive_scale", "sku:s fold:l naive_scale:d6 sq_scale:d4", SC + "SELECT * FROM ns")
def _(s):
    return B.naive_scales(s.series, "sku", PLAN)


@plan("metric_service", "method:s fill_rate:d6 cycle_service:d6", SC + """
SELECT method, sum(least(actual, greatest(pred, 0))) / sum(actual) AS fill_rate, avg(CASE WHEN pred >= actual THEN 1.0 ELSE 0 END) AS cycle_service FROM fr GROUP BY 1""")
def _(s):
    return X.service(scored(s), ["method"])


@plan("metric_by_scope", "method:s scope:s n:l mae:d6 rmse:d6 mape:d6 mase_published:d6", SC + f""",
br AS (SELECT fold, avg(is_sem_break) AS b FROM ahead GROUP BY 1),
sc AS (SELECT fr.*, unnest(['overall', CASE WHEN b > 0.25 THEN 'semestral_break' ELSE 'standard_period' END]) AS scope FROM fr JOIN br USING (fold))
SELECT method, scope, {CORE_SQL} FROM sc GROUP BY ALL""")
def _(s):
    br = M.horizon_days(P.day_rows(s), PLAN).groupBy("fold").agg(F.avg("is_sem_break").alias("break_share"))
    return X.core(X.scopes(scored(s), br, 0.25), ["method", "scope"])


SUM_SQL = SC + """,
ps AS (SELECT method, sku, avg(abs_error) AS mae, sqrt(avg(abs_error * abs_error)) AS rmse, avg(abs_error) / nullif(avg(naive_scale), 0) AS mase, count(*) AS n FROM fr GROUP BY ALL),
sm AS (SELECT p.method, avg(p.mae) AS mae, avg(p.rmse) AS rmse, avg(p.mase) AS mase, median(p.mase) AS mase_median, count(*) AS n_skus, sum(p.n) AS n_folds, avg(CASE WHEN p.mae < q.mae THEN 1.0 ELSE 0 END) AS beats_naive FROM ps p JOIN ps q ON q.sku = p.sku AND q.method = 'naive' GROUP BY 1)
"""


@plan("metric_summary", "method:s mae:d6 rmse:d6 mase:d6 mase_median:d6 wmape:d6 beats_naive:d6 n_skus:l n_folds:l", SUM_SQL + "SELECT * FROM sm JOIN (SELECT method, 100 * sum(abs_error) / sum(actual) AS wmape FROM fr GROUP BY 1) USING (method)")
def _(s):
    return X.summary(scored(s))


@plan("rank_methods", "method:s mase:d6 mae:d6 place:l", SUM_SQL + "SELECT method, mase, mae, row_number() OVER (ORDER BY mase NULLS LAST, mae, method) AS place FROM sm")
def _(s):
    return X.rank(X.summary(scored(s)))


@plan("metric_robust", "method:s mase_mean:d6 mase_median:d6 mase_trimmed:d6 mase_weighted:d6 mase_global:d6 rmsse_mean:d6 rmsse_median:d6 worst10_pct:d6 n_skus:l", SC + """,
p AS (SELECT method, sku, avg(abs_error) AS mae, avg(abs_error * abs_error) AS mse, sum(actual) AS d, avg(naive_scale) AS a, avg(sq_scale) AS sq FROM fr GROUP BY ALL HAVING avg(naive_scale) > 0),
m AS (SELECT *, mae / a AS mase, sqrt(mse / sq) AS rmsse, row_number() OVER (PARTITION BY method ORDER BY mae / a DESC, sku DESC) AS rn FROM p), b AS (SELECT method, quantile_cont(mase, [0.05, 0.95]) AS b FROM m GROUP BY 1)
SELECT method, avg(mase) AS mase_mean, median(mase) AS mase_median, avg(mase) FILTER (mase BETWEEN b[1] AND b[2]) AS mase_trimmed, sum(mase * d) / sum(d) AS mase_weighted, sum(mae) / sum(a) AS mase_global, avg(rmsse) AS rmsse_mean, median(rmsse) AS rmsse_median,
 100 * sum(CASE WHEN rn <= 10 THEN mase END) / sum(mase) AS worst10_pct, count(*) AS n_skus FROM m JOIN b USING (method) GROUP BY 1""")
def _(s):
    return X.robust(scored(s))


@plan("metric_beats_naive", "method:s beats_naive:d6", SUM_SQL + "SELECT method, beats_naive FROM sm")
def _(s):
    return X.summary(scored(s))


@plan("metric_skus_priced", "method:s skus_ever:l per_fold:d6", SC + """
SELECT method, count(DISTINCT CASE WHEN pred > 0 THEN sku END) AS skus_ever, count(*) FILTER (pred > 0) / count(DISTINCT fold) AS per_fold FROM fr GROUP BY 1""")
def _(s):
    return scored(s).groupBy("method").agg(
        F.countDistinct(F.when(F.col("pred") > 0, F.col("sku"))).alias("skus_ever"),
        (F.count(F.when(F.col("pred") > 0, 1)) / F.countDistinct("fold")).alias("per_fold"))


@plan("metric_checks", "fold:l from_day:D to_day:D forecast:d4 naive:d4 sold:d2 wape:d6", SC + """
SELECT fr.fold, d0 + CAST(any_value(train_end) AS INT) AS from_day, d0 + CAST(any_value(train_end) + 29 AS INT) AS to_day, sum(pred) FILTER (method = 'rolling_mean_30') AS forecast, sum(pred) FILTER (method = 'naive') AS naive,
 sum(actual) FILTER (method = 'naive') AS sold, 100 * (sum(abs_error) FILTER (method = 'rolling_mean_30')) / (sum(actual) FILTER (method = 'naive')) AS wape FROM fr JOIN fold ON fold.fold = fr.fold, hist GROUP BY fr.fold, d0""")
def _(s):
    days = M.horizon_days(P.day_rows(s), PLAN).groupBy("fold").agg(F.min("day").alias("from_day"), F.max("day").alias("to_day"))
    r = F.col("method") == "rolling_mean_30"
    nv = F.col("method") == "naive"
    g = scored(s).groupBy("fold").agg(
        F.sum(F.when(r, F.col("pred"))).alias("forecast"), F.sum(F.when(nv, F.col("pred"))).alias("naive"), F.sum(F.when(nv, F.col("actual"))).alias("sold"),
        (100 * F.sum(F.when(r, F.col("abs_error"))) / F.sum(F.when(nv, F.col("actual")))).alias("wape"))
    return g.join(days, "fold")


@plan("metric_daily_known_days", "category:s fold:l h:l forecast:d6 known:d6 actual:d2", TRAIN + """,
f AS (SELECT category, fold, avg(qty) FILTER (age < 30) AS level FROM ctrain GROUP BY ALL),
d AS (SELECT f.category, f.fold, h, level AS forecast, coalesce(c.qty, 0) AS actual, CASE WHEN is_store_closed = 0 AND is_event_day = 0 THEN 1 ELSE 0 END AS rec FROM f JOIN ahead ON ahead.fold = f.fold LEFT JOIN category_series c ON c.category = f.category AND c.day = ahead.day)
SELECT category, fold, h, forecast, actual, CASE WHEN rec = 0 THEN 0 ELSE forecast * sum(forecast) OVER (PARTITION BY category, fold) / sum(forecast * rec) OVER (PARTITION BY category, fold) END AS known FROM d""")
def _(s):
    level = M.levels(B.training_rows(s.category_series, PLAN, window=30), ["category"], {"forecast": M.rolling_mean(30)})
    ahead = M.horizon_days(P.day_rows(s), PLAN).select("fold", "h", "day", ((F.col("closed") == 0) & (F.col("is_event_day") == 0)).cast("int").alias("rec"))
    d = level.join(F.broadcast(ahead), "fold").join(s.category_series.select("category", "day", F.col("qty").alias("actual")), ["category", "day"], "left")
    return known_days(d.fillna(0, ["actual"]))


def known_days(d):
    """Move each window's total onto the days actually traded."""
    t = d.groupBy("category", "fold").agg(F.sum("forecast").alias("tot"), F.sum(F.col("forecast") * F.col("rec")).alias("on"))
    j = d.join(F.broadcast(t), ["category", "fold"])
    return j.withColumn("known", F.when(F.col("on") > 0, F.col("forecast") * F.col("rec") * F.col("tot") / F.col("on")).otherwise(F.col("forecast")))


@plan("metric_density_levels", "level:s bucket:s n:l wape:d6", SC + """,
dn AS (SELECT sku, category, CASE WHEN avg(CASE WHEN qty > 0 THEN 1.0 ELSE 0 END) >= 0.15 THEN 'dense' ELSE 'sparse' END AS b FROM series GROUP BY ALL),
r AS (SELECT fr.*, category, b FROM fr JOIN dn USING (sku) WHERE method = 'rolling_mean_30'),
x AS (SELECT 'sku' AS level, b AS bucket, pred, actual FROM r UNION ALL SELECT 'category', 'all', sum(pred), sum(actual) FROM r GROUP BY category, fold UNION ALL SELECT 'store', 'all', sum(pred), sum(actual) FROM r GROUP BY fold)
SELECT level, bucket, count(*) AS n, 100 * sum(abs(pred - actual)) / sum(actual) AS wape FROM x GROUP BY ALL""")
def _(s):
    dens = s.series.groupBy("sku", "category").agg(F.avg((F.col("qty") > 0).cast("double")).alias("d")).select(
        "sku", "category", F.when(F.col("d") >= 0.15, "dense").otherwise("sparse").alias("bucket"))
    r = scored(s, methods=("rolling_mean_30",)).join(dens, "sku")
    both = [F.sum("pred").alias("pred"), F.sum("actual").alias("actual")]
    cat = r.groupBy("category", "fold").agg(*both)
    parts = (r.select(F.lit("sku").alias("level"), "bucket", "pred", "actual")
             .unionByName(cat.select(F.lit("category").alias("level"), F.lit("all").alias("bucket"), "pred", "actual"))
             .unionByName(cat.groupBy("fold").agg(*both).select(F.lit("store").alias("level"), F.lit("all").alias("bucket"), "pred", "actual")))
    return parts.groupBy("level", "bucket").agg(F.count("*").alias("n"), (100 * F.sum(F.abs(F.col("pred") - F.col("actual"))) / F.sum("actual")).alias("wape"))


@plan("metric_lead_gap", "sku:s fold:l actual:d2 pred:d6", """
WITH fold AS (SELECT 11 - j AS fold, n - 14 - 30 * (j + 1) AS train_end FROM (SELECT max(n) AS n FROM series), (SELECT unnest(range(12)) AS j))
SELECT sku, fold, sum(qty) FILTER (pos >= train_end + 14 AND pos < train_end + 44) AS actual, 30 * avg(qty) FILTER (pos < train_end AND pos >= train_end - 30) AS pred FROM series CROSS JOIN fold GROUP BY ALL""")
def _(s):
    return scored(s, B.FoldPlan(gap=14), ("rolling_mean_30",))


@plan("metric_cindex", "pairs:l concordant:d1 c_index:d8", """
WITH o AS (SELECT last_day - 90 AS t FROM span),
r AS (SELECT product_id, max(CASE WHEN day < t AND quantity_sold > 0 THEN day END) AS lastd, min(CASE WHEN day >= t AND quantity_sold > 0 THEN day END) AS nxt, any_value(t) AS t FROM sale, o GROUP BY 1),
x AS (SELECT least(coalesce(date_diff('day', t, nxt) // 7 + 1, 12), 12) AS time, CASE WHEN nxt IS NOT NULL AND date_diff('day', t, nxt) // 7 + 1 <= 12 THEN 1 ELSE 0 END AS observed, -date_diff('day', lastd, t) AS risk FROM r WHERE lastd IS NOT NULL)
SELECT count(*) AS pairs, sum(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END) AS concordant, sum(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END) / count(*) AS c_index FROM x a JOIN x b ON a.observed = 1 AND b.time > a.time""")
def _(s):
    t = F.date_sub(s.span.select("last_day").scalar(), 90)
    sold = s.sale.filter("quantity_sold > 0").withColumn("t", t)
    r = sold.groupBy("product_id", "t").agg(F.max(F.when(F.col("day") < F.col("t"), F.col("day"))).alias("lastd"),
                                            F.min(F.when(F.col("day") >= F.col("t"), F.col("day"))).alias("nxt")).filter("lastd IS NOT NULL")
    weeks = F.floor(F.datediff("nxt", "t") / 7) + 1
    x = r.select(F.least(F.coalesce(weeks, F.lit(12)), F.lit(12)).alias("time"), F.coalesce((weeks <= 12).cast("int"), F.lit(0)).alias("observed"),
                 (-F.datediff("t", "lastd")).alias("risk"))
    return X.c_index(x)


@plan("paired_cleaning", "sku:s state:s raw_units:d0 clean_units:d0 moved:d0", """
WITH a AS (SELECT sku, day, sum(quantity_sold) AS u FROM fact JOIN product USING (product_id) GROUP BY ALL), b AS (SELECT sku, day, qty AS u FROM sku_day),
j AS (SELECT coalesce(a.sku, b.sku) AS sku, coalesce(a.u, 0) AS x, coalesce(b.u, 0) AS y FROM a FULL JOIN b ON a.sku = b.sku AND a.day = b.day)
SELECT sku, CASE WHEN sum(abs(x - y)) = 0 THEN 'identical' ELSE 'changed' END AS state, sum(x) AS raw_units, sum(y) AS clean_units, sum(abs(x - y)) AS moved FROM j GROUP BY 1""")
def _(s):
    raw = s.fact.groupBy("product_id", "day").agg(F.sum("quantity_sold").alias("q")).join(s.product, "product_id").groupBy("sku", "day").agg(F.sum("q").cast("double").alias("x"))
    j = raw.join(s.sku_day.select("sku", "day", F.col("qty").alias("y")), ["sku", "day"], "full").fillna(0, ["x", "y"])
    moved = F.sum(F.abs(F.col("x") - F.col("y")))
    return j.groupBy("sku").agg(F.when(moved == 0, "identical").otherwise("changed").alias("state"), F.sum("x").alias("raw_units"), F.sum("y").alias("clean_units"), moved.alias("moved"))


@plan("metric_param_grid", "method:s macro_mase:d6 below_one:l beats_repeat:l", TRAIN + """,
lv AS (SELECT category, fold, unnest(['mean_30', 'mean_90', 'mean_180', 'tsb_0.05', 'tsb_0.1']) AS method, unnest([m30, m90, m180, t05, t10]) AS level FROM (
 SELECT c.category, c.fold, avg(qty) FILTER (age < 30) AS m30, avg(qty) FILTER (age < 90) AS m90, avg(qty) FILTER (age < 180) AS m180, any_value(a.level) AS t05, any_value(b.level) AS t10 FROM ctrain c
 JOIN (@T05@) a ON a.category = c.category AND a.fold = c.fold JOIN (@T10@) b ON b.category = c.category AND b.fold = c.fold GROUP BY ALL)),
ac AS (SELECT category, fold, sum(qty) AS actual FROM category_series JOIN fold ON pos >= train_end AND pos < train_end + 30 GROUP BY ALL),
bl AS (SELECT category, (n - 1 - pos) // 30 AS back, sum(qty) AS u FROM category_series WHERE (n - 1 - pos) // 30 < n // 30 GROUP BY ALL),
ns AS (SELECT category, fold, avg(abs(d)) AS sc FROM (SELECT category, back, lead(u) OVER (PARTITION BY category ORDER BY back) - u AS d FROM bl) JOIN fold ON 11 - fold < back GROUP BY ALL),
pc AS (SELECT method, category, avg(abs(actual - 30 * level)) AS mae, avg(abs(actual - 30 * level)) / avg(sc) AS mase FROM lv JOIN ac USING (category, fold) JOIN ns USING (category, fold) GROUP BY ALL)
SELECT p.method, avg(p.mase) AS macro_mase, count(*) FILTER (p.mase < 1) AS below_one, count(*) FILTER (p.mae < r.mae) AS beats_repeat FROM pc p JOIN pc r ON r.category = p.category AND r.method = 'mean_30' GROUP BY 1"""
      .replace("@T05@", tsb_sql(0.05, 0.05).replace("FROM train", "FROM ctrain").replace("FROM sl", "FROM csl").replace("sku", "category"))
      .replace("@T10@", tsb_sql(0.1, 0.1).replace("FROM train", "FROM ctrain").replace("FROM sl", "FROM csl").replace("sku", "category"))
      .replace("\nlv AS", "\ncsl AS (SELECT *, row_number() OVER (PARTITION BY category, fold ORDER BY pos DESC) - 1 AS sage, count(*) OVER (PARTITION BY category, fold) AS k FROM ctrain WHERE qty > 0),\nlv AS"))
def _(s):
    c = s.category_series.withColumnRenamed("category", "sku")
    t = B.training_rows(B.with_sale_ranks(c, "sku"), PLAN)
    menu = {f"mean_{w}": M.rolling_mean(w) for w in (30, 90, 180)} | {f"tsb_{a}": M.tsb(a, a) for a in (0.05, 0.1)}
    names = {m.replace(".", "_"): e for m, e in menu.items()}
    wide = M.levels(t, ["sku"], names).withColumnsRenamed({m.replace(".", "_"): m for m in menu})
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"`{m}`").alias("level")) for m in menu])
    rows = B.score(wide.select("sku", "fold", F.inline(pairs)).withColumn("pred", F.col("level") * 30), c, "sku", PLAN)
    per = X.core(rows, ["method", "sku"])
    base = per.filter("method = 'mean_30'").select("sku", F.col("mae").alias("base"))
    return per.join(base, "sku").groupBy("method").agg(
        F.avg("mase").alias("macro_mase"), F.count(F.when(F.col("mase") < 1, 1)).alias("below_one"), F.count(F.when(F.col("mae") < F.col("base"), 1)).alias("beats_repeat"))


@plan("fsn_fold_scoped", "sku:s fold:l speed:s speed3:s", TRAIN + """,
a AS (SELECT sku, fold, sum(qty) / nullif(count(*) FILTER (qty > 0), 0) AS adus FROM train GROUP BY ALL), c AS (SELECT fold, quantile_cont(coalesce(adus, 0), 0.8) AS x, quantile_cont(adus, 0.8) AS y FROM a GROUP BY 1)
SELECT sku, a.fold, CASE WHEN coalesce(adus, 0) >= x THEN 'fast' ELSE 'slow' END AS speed, CASE WHEN adus IS NULL THEN 'nonmoving' WHEN adus >= y THEN 'fast' ELSE 'slow' END AS speed3 FROM a JOIN c ON c.fold = a.fold""")
def _(s):
    return C.fold_speed(None, fold_totals(s))


def fold_totals(s):
    return B.training_rows(s.series, PLAN).groupBy("sku", "fold").agg(F.sum("qty").alias("units"), F.count(F.when(F.col("qty") > 0, 1)).alias("sale_days"))


@plan("service_metrics", "method:s fill_rate:d6 cycle_service:d6 mean_stock:d4", SC + """,
a AS (SELECT sku, fold, stddev_samp(qty) AS sd, sum(qty) / nullif(count(*) FILTER (qty > 0), 0) AS adus FROM train GROUP BY ALL), c AS (SELECT fold, quantile_cont(coalesce(adus, 0), 0.8) AS x FROM a GROUP BY 1),
k AS (SELECT fr.*, greatest(pred + CASE WHEN coalesce(adus, 0) >= x THEN 1.65 ELSE 1.04 END * sd * sqrt(37), 0) AS stock FROM fr JOIN a USING (sku, fold) JOIN c USING (fold))
SELECT method, sum(least(actual, stock)) / sum(actual) AS fill_rate, avg(CASE WHEN stock >= actual THEN 1.0 ELSE 0 END) AS cycle_service, avg(stock) AS mean_stock FROM k GROUP BY 1""")
def service_rows(s):
    t = B.training_rows(s.series, PLAN).groupBy("sku", "fold").agg(
        F.stddev_samp("qty").alias("sd"), F.sum("qty").alias("units"), F.count(F.when(F.col("qty") > 0, 1)).alias("sale_days"))
    z = C.fold_speed(None, t).select("sku", "fold", F.when(F.col("speed") == "fast", 1.65).otherwise(1.04).alias("z"))
    k = scored(s).join(t, ["sku", "fold"]).join(z, ["sku", "fold"]).withColumn(
        "stock", F.greatest(F.col("pred") + F.col("z") * F.col("sd") * F.sqrt(F.lit(37.0)), F.lit(0.0)))
    return X.service(k, ["method"], "stock").join(k.groupBy("method").agg(F.avg("stock").alias("mean_stock")), "method")


FRONT_SQL = SC + """,
e AS (SELECT method, sku, fold, pred, actual, unnest([0.5, 0.75, 0.8, 0.85, 0.9, 0.95]) AS q, unnest(quantile_cont(actual - pred, [0.5, 0.75, 0.8, 0.85, 0.9, 0.95]) OVER (PARTITION BY method, sku ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS b FROM fr),
st AS (SELECT method, q, actual, greatest(pred + greatest(coalesce(b, 0), 0), 0) AS stock FROM e),
fq AS (SELECT method, q, sum(least(actual, stock)) AS served, sum(greatest(actual - stock, 0)) AS short, sum(greatest(stock - actual, 0)) AS held, sum(actual) AS demand FROM st GROUP BY ALL),
fm AS (SELECT *, served / demand AS fill, (held - lag(held) OVER w) / nullif(served - lag(served) OVER w, 0) AS held_per_extra FROM fq WINDOW w AS (PARTITION BY method ORDER BY q))
"""
QUANTILES = (0.5, 0.75, 0.8, 0.85, 0.9, 0.95)


def frontier(rows, quantiles=QUANTILES):
    """Service and holding when each fold adds the q-quantile of its own
    earlier errors; the first fold has none and holds no buffer."""
    from pyspark.sql import Window

    prior = Window.partitionBy("method", "sku").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    e = rows.withColumn("b", F.percentile(F.col("actual") - F.col("pred"), list(quantiles)).over(prior))
    grid = F.arrays_zip(F.array(*[F.lit(q) for q in quantiles]).alias("q"), F.coalesce("b", F.array(*[F.lit(0.0) for _ in quantiles])).alias("b"))
    e = e.withColumn("g", F.explode(grid)).withColumn("stock", F.greatest(F.col("pred") + F.greatest(F.col("g.b"), F.lit(0.0)), F.lit(0.0)))
    g = e.groupBy("method", F.col("g.q").alias("q")).agg(
        F.sum(F.least("actual", "stock")).alias("served"), F.sum(F.greatest(F.col("actual") - F.col("stock"), F.lit(0.0))).alias("short"),
        F.sum(F.greatest(F.col("stock") - F.col("actual"), F.lit(0.0))).alias("held"), F.sum("actual").alias("demand"))
    w = Window.partitionBy("method").orderBy("q")
    extra = F.col("served") - F.lag("served").over(w)
    return g.withColumn("fill", F.col("served") / F.col("demand")).withColumn(
        "held_per_extra", F.when(extra != 0, (F.col("held") - F.lag("held").over(w)) / extra))


@plan("frontier_empirical", "method:s q:d2 fill:d6 short:d4 held:d4 held_per_extra:d5", FRONT_SQL + "SELECT * FROM fm")
def _(s):
    return frontier(scored(s))


@plan("frontier_knee", "method:s ref_cost:d5 cmp_cost:d5 knee:d2", FRONT_SQL + """
SELECT method, max(held_per_extra) FILTER (q = 0.8) AS ref_cost, max(held_per_extra) FILTER (q = 0.95) AS cmp_cost, CASE WHEN max(held_per_extra) FILTER (q = 0.95) > 2 * max(held_per_extra) FILTER (q = 0.8) THEN 0.8 END AS knee FROM fm GROUP BY 1""")
def _(s):
    g = frontier(scored(s)).groupBy("method").agg(F.max(F.when(F.col("q") == 0.8, F.col("held_per_extra"))).alias("ref_cost"),
                                                  F.max(F.when(F.col("q") == 0.95, F.col("held_per_extra"))).alias("cmp_cost"))
    return g.withColumn("knee", F.when(F.col("cmp_cost") > 2 * F.col("ref_cost"), 0.8))


@plan("metric_objective_table", "tag:s fill:d6 short:d4 held:d4 held_per_unit:d6 skus_per_fold:d6", FRONT_SQL + """,
sp AS (SELECT method, count(*) FILTER (pred > 0) / count(DISTINCT fold) AS skus FROM fr GROUP BY 1)
SELECT 'base:' || method AS tag, fill, short, held, held / served AS held_per_unit, skus AS skus_per_fold FROM fm JOIN sp USING (method) WHERE q = 0.8""")
def _(s):
    runs = scored(s)
    front = frontier(runs).filter("q = 0.8")
    per = runs.groupBy("method").agg((F.count(F.when(F.col("pred") > 0, 1)) / F.countDistinct("fold")).alias("skus_per_fold"))
    return front.join(per, "method").select(F.concat(F.lit("base:"), "method").alias("tag"), "fill", "short", "held", (F.col("held") / F.col("served")).alias("held_per_unit"), "skus_per_fold")


@plan("check_no_leakage", "check:s fold:l rows:l differing_rows:l")
def _(s):
    """Nothing may change when all that lies behind an origin does: every registered method on every fold, the policy's
    errors up to every fold's end, and the rates of donors at three splits."""
    from copy import copy

    from tallyloom.operators import leakage as K
    from tallyloom.operators import registry as R
    from tallyloom.plans import policy as PP

    series = cut_lineage(s.series, "series")
    levels = K.fold_leaks(series, "sku", PLAN, lambda d, plan: R.run(d, "sku", plan, R.names()))
    out = levels.select(F.concat(F.lit("method:"), "method").alias("check"), "fold", "rows", "differing_rows")
    c = PP.Ctx(s)
    errors = K.error_leaks(c.days, c.items.select("product_id", "lead_time_days"), c.n, c.observed)
    out = out.unionByName(errors.select(F.lit("policy_errors").alias("check"), "fold", "rows", "differing_rows"))
    for i, split in enumerate((200, 400, 800)):
        other = copy(c)
        other.days = c.days.withColumn("qty", F.when(F.col("pos") < split, F.col("qty")).otherwise(F.col("qty") * 3 + 17))
        a, b = (PP.donor_rates(x, F.lit(split))[1] for x in (c, other))
        same = K.differing(a.withColumn("fold", F.lit(i)), b.withColumn("fold", F.lit(i)), ["fold", "rule", "grp"], "r", ["fold"])
        out = out.unionByName(same.select(F.lit("donor_rates").alias("check"), "fold", "rows", "differing_rows"))
    return out


@plan("bootstrap_paired", "low:d6 median:d6 high:d6 replicates:l")
def _(s):
    rows = scored(s).groupBy("sku").pivot("method", list(METHODS)).agg(F.sum("abs_error"))
    demand = B.actuals(s.series, "sku", PLAN).groupBy("sku").agg(F.sum("actual").alias("demand"))
    d = rows.join(demand, "sku").withColumn("diff", F.col("rolling_mean_30") - F.col("rolling_mean_90"))
    return X.cluster_bootstrap(d, "sku", "diff", "demand", 1000)


@plan("grouping_search_score", "grouping:s split:s mase:d6", TRAIN + """,
g AS (SELECT 'brand' AS grouping, split_part(sku, '|', 1) AS grp, pos, n, sum(qty) AS qty FROM series GROUP BY ALL UNION ALL SELECT 'type', category, pos, n, sum(qty) FROM series GROUP BY ALL),
ft AS (SELECT grouping, grp, fold, 30 * avg(qty) FILTER (pos < train_end AND pos >= train_end - 180) AS pred, sum(qty) FILTER (pos >= train_end AND pos < train_end + 30) AS actual FROM g JOIN fold ON true GROUP BY ALL),
bl AS (SELECT grouping, grp, (n - 1 - pos) // 30 AS back, sum(qty) AS u FROM g WHERE (n - 1 - pos) // 30 < n // 30 GROUP BY ALL),
ns AS (SELECT grouping, grp, fold, avg(abs(d)) AS sc FROM (SELECT grouping, grp, back, lead(u) OVER (PARTITION BY grouping, grp ORDER BY back) - u AS d FROM bl) JOIN fold ON 11 - fold < back GROUP BY ALL),
m AS (SELECT grouping, grp, CASE WHEN fold < 6 THEN 'selection' ELSE 'test' END AS split, avg(abs(actual - pred)) / avg(sc) AS mase FROM ft JOIN ns USING (grouping, grp, fold) GROUP BY ALL)
SELECT grouping, split, avg(mase) AS mase FROM m GROUP BY ALL""")
def _(s):
    """Candidate groupings of the lines, scored on selection and test folds."""
    labels = F.array(F.struct(F.lit("brand").alias("grouping"), F.split("sku", r"\|")[0].alias("grp")),
                     F.struct(F.lit("type").alias("grouping"), F.col("category").alias("grp")))
    g = s.series.withColumn("l", F.explode(labels)).groupBy(
        F.concat_ws("~", "l.grouping", "l.grp").alias("sku"), "pos", "n").agg(F.sum("qty").alias("qty"))
    wide = M.levels(B.training_rows(g, PLAN, window=180), ["sku"], {"m": M.rolling_mean(180)})
    rows = B.score(M.long_form(wide, ["sku"], ["m"], 30), g, "sku", PLAN)
    per = X.core(rows.withColumn("split", F.when(F.col("fold") < 6, "selection").otherwise("test")), ["sku", "split"])
    return per.groupBy(F.split("sku", "~")[0].alias("grouping"), "split").agg(F.avg("mase").alias("mase"))
