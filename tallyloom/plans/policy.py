"""Stock policy bound to the star, for every fast or slow item."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import calendar as CAL
from tallyloom.operators import joins as J
from tallyloom.operators import policy as P
from tallyloom.operators import series as S
from tallyloom.operators.classify import fsn_classify
from tallyloom.operators.quantiles import exact_quantiles
from tallyloom.operators.scale import cut_lineage, spread
from tallyloom.plans.aggregates import DAYS_SQL
from tallyloom.plans.classify import FSN_SQL
from tallyloom.plans.joins import STOCK_SQL
from tallyloom.plans.registry import plan

QS = "[0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99]"


def base_sql(split="n", name=""):
    """Items, their folds and errors as seen at position ``split``."""
    return f""",
cfg{name} AS (SELECT {split} AS e FROM hb),
rt{name} AS (SELECT it.product_id, coalesce(sum(CASE WHEN pos < e AND pos >= e - 365 THEN qty END), 0) AS units, count(CASE WHEN pos < e AND pos >= e - 365 AND qty > 0 THEN 1 END) AS sale_days,
  (SELECT count(*) FROM ob, cfg{name} WHERE observed = 1 AND pos < e AND pos >= greatest(e - 365, 0)) AS nobs FROM it LEFT JOIN pd USING (product_id), cfg{name} GROUP BY 1),
rate{name} AS (SELECT *, units / nobs AS own_rate, CASE WHEN units > 0 THEN units / nobs END AS rate, CASE WHEN units > 0 THEN 'observed' ELSE 'insufficient_data' END AS rate_source FROM rt{name}),
fo{name} AS (SELECT product_id, L, kept, fold, e - L * (kept - fold) AS origin FROM (SELECT product_id, L, e, kept, unnest(range(kept)) AS fold FROM (SELECT product_id, lead_time_days AS L, e, CASE WHEN e - lead_time_days >= 60 THEN least((e - lead_time_days - 60) // lead_time_days + 1, 12) ELSE 0 END AS kept FROM it, cfg{name}) WHERE kept >= 3)),
ea{name} AS (SELECT f.product_id, f.L, f.fold, f.origin, coalesce(sum(CASE WHEN pos >= origin AND pos < origin + L THEN qty END), 0) AS actual,
  coalesce(sum(CASE WHEN pos < origin AND pos >= origin - 365 THEN qty END), 0) AS tr FROM fo{name} f LEFT JOIN pd ON pd.product_id = f.product_id GROUP BY f.product_id, f.L, f.fold, f.origin),
er{name} AS (SELECT *, actual - pred AS error FROM (SELECT ea{name}.*, tr * L / (o1.seen - coalesce(o0.seen, 0)) AS pred FROM ea{name} JOIN ob o1 ON o1.pos = origin LEFT JOIN ob o0 ON o0.pos = origin - 365)),
cv{name} AS (SELECT product_id, q, sum(least(actual, c)) AS served, sum(greatest(c - actual, 0)) AS held, sum(actual) AS demand FROM (SELECT product_id, actual, q, greatest(pred + greatest(coalesce(b, 0), 0), 0) AS c FROM (
  SELECT product_id, actual, pred, unnest({QS}) AS q, unnest(quantile_cont(error, {QS}) OVER (PARTITION BY product_id ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS b FROM er{name})) GROUP BY ALL HAVING sum(actual) > 0),
cw{name} AS (SELECT *, served / demand AS fill, CASE WHEN held > 0 THEN served / held END AS eff, CASE WHEN lag(q) OVER w IS NOT NULL AND (q > 0.95 OR (held - lag(held) OVER w > 0 AND (served - lag(served) OVER w) / (held - lag(held) OVER w) < 0.1)) THEN q END AS stop_q FROM cv{name} WINDOW w AS (PARTITION BY product_id ORDER BY q)),
tg{name} AS (SELECT product_id, max(fill) AS best_fill, min(CASE WHEN q <= 0.95 AND fill >= 0.9 THEN q END) AS q_serv, max(eff) AS best_eff, count(*) FILTER (eff IS NULL) AS free, min(stop_q) AS q_stop FROM cw{name} GROUP BY 1),
tw{name} AS (SELECT c.product_id, max(q) FILTER (q_stop IS NULL OR q < q_stop) AS q_walk FROM cw{name} c JOIN tg{name} USING (product_id) GROUP BY 1),
tier{name} AS (SELECT it.product_id, best_fill, CASE WHEN q_serv IS NOT NULL THEN 'servable' WHEN free = 0 AND best_eff < 0.1 THEN 'not_stockable' ELSE 'partial' END AS tier,
  CASE WHEN best_fill IS NULL THEN 0.8 WHEN q_serv IS NOT NULL THEN q_serv WHEN free = 0 AND best_eff < 0.1 THEN NULL ELSE q_walk END AS q FROM it LEFT JOIN tg{name} USING (product_id) LEFT JOIN tw{name} USING (product_id)),
eb{name} AS (SELECT product_id, list_sort(list(error)) AS e FROM er{name} GROUP BY 1),
bu{name} AS (SELECT t.*, CASE WHEN tier = 'not_stockable' THEN 0 WHEN e IS NOT NULL THEN greatest(0, e[CAST(floor((len(e) - 1) * q) + 1 AS INT)] + (coalesce(e[CAST(floor((len(e) - 1) * q) + 2 AS INT)], e[CAST(floor((len(e) - 1) * q) + 1 AS INT)]) - e[CAST(floor((len(e) - 1) * q) + 1 AS INT)]) * ((len(e) - 1) * q - floor((len(e) - 1) * q))) END AS buffer,
  CASE WHEN tier = 'not_stockable' THEN 'not_stocked' WHEN e IS NOT NULL THEN 'empirical' ELSE 'normal_fallback' END AS buffer_source FROM tier{name} t LEFT JOIN eb{name} USING (product_id))"""


HEAD = f"""WITH hb AS (SELECT min(day) AS d0, max(CASE WHEN quantity_sold > 0 THEN day END) AS d1, date_diff('day', min(day), max(CASE WHEN quantity_sold > 0 THEN day END)) + 1 AS n FROM sale),
pd AS (SELECT product_id, day, CAST(sum(quantity_sold) AS DOUBLE) AS qty, date_diff('day', d0, day) AS pos FROM sale, hb GROUP BY ALL),
ob AS (SELECT pos, observed, coalesce(sum(observed) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM (SELECT date_diff('day', d0, c.day) AS pos, CASE WHEN is_sem_break = 1 OR is_store_closed = 1 OR c.day IN (SELECT day FROM fact) THEN 1 ELSE 0 END AS observed FROM calendar c, hb WHERE c.day >= d0)),
it AS (SELECT product_id, fsn_class, lead_time_days, unit_price_php, category FROM ({FSN_SQL}) WHERE fsn_class IN ('F', 'S') AND product_id IN (SELECT product_id FROM pd GROUP BY 1 HAVING sum(qty) > 0))"""
POL = HEAD + base_sql()


class Ctx:
    """The inputs of the policy at one position of the history."""

    def __init__(self, s, classes=None):
        # item days are written once: the span, rates, errors and deviations all read them
        per = s.sale.groupBy("product_id", "day").agg(F.sum("quantity_sold").cast("double").alias("qty"), F.max(F.col("quantity_sold") > 0).alias("sold"))
        per = cut_lineage(per, "item-days")
        # one row with two dates: literals let Spark prune and fold the plan
        b = per.agg(F.min("day").alias("d0"), F.max(F.when(F.col("sold"), F.col("day"))).alias("d1")).first()
        self.d0, self.d1 = F.lit(b.d0), F.lit(b.d1)
        self.n = F.lit((b.d1 - b.d0).days + 1)
        self.days = per.select("product_id", "day", "qty", F.datediff("day", self.d0).alias("pos"))
        cls = (fsn_classify(s.product, s.sale) if classes is None else classes).filter(F.col("fsn_class").isin("F", "S"))
        # read by every later step: classified once, then read back
        self.items = cut_lineage(cls.select("product_id", "fsn_class", "lead_time_days", "unit_price_php", "category", "item_name"), "items")
        mask = S.observed_mask(s.calendar, s.fact).withColumn("pos", F.datediff("day", self.d0)).filter("pos >= 0")
        # one row per calendar day
        self.observed = mask.withColumn("seen", F.coalesce(F.sum("observed").over(
            Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def n_obs(self, end):
        o = self.observed.filter((F.col("pos") < end) & (F.col("pos") >= end - 365) & (F.col("observed") == 1))
        return o.agg(F.count("*")).scalar()

    def rates(self, end=None, labels=None):
        end = self.n if end is None else end
        r = P.rates(self.days.filter(F.col("pos") < end), end, self.n_obs(end), labels)
        out = self.items.join(r, "product_id", "left")
        return out.withColumn("rate_source", F.coalesce("rate_source", F.lit("insufficient_data"))).fillna(0, ["units", "sale_days"])

    def errors(self, end=None):
        return P.fold_errors(self.days, self.items.select("product_id", "lead_time_days"), self.n, self.observed, upto=end)

    def policy(self, end=None):
        errors = cut_lineage(self.errors(end), "errors")
        tiers = P.service_tier(P.tier_curve(errors), self.items)
        return self.rates(end).join(P.committed(errors, tiers), "product_id")


@plan("policy_rate", "product_id:l units:d0 sale_days:l own_rate:d8 rate:d8 rate_source:s", HEAD + base_sql() + """,
lb AS (SELECT product_id, category AS cl FROM it),
oth AS (SELECT a.product_id, median(b.own_rate) AS om FROM rate a JOIN lb x ON x.product_id = a.product_id JOIN lb y ON y.cl = x.cl AND y.product_id <> x.product_id JOIN rate b ON b.product_id = y.product_id AND b.own_rate > 0 GROUP BY 1)
SELECT r.product_id, units, sale_days, own_rate, CASE WHEN units <= 0 THEN NULL WHEN sale_days < 10 AND om IS NOT NULL THEN sale_days / 10 * own_rate + (1 - sale_days / 10) * om ELSE own_rate END AS rate,
CASE WHEN units <= 0 THEN 'insufficient_data' WHEN sale_days < 10 AND om IS NOT NULL THEN 'cluster_pooled' ELSE 'observed' END AS rate_source FROM rate r LEFT JOIN oth USING (product_id)""")
def _(s):
    c = Ctx(s)
    return c.rates(labels=c.items.select("product_id", F.col("category").alias("cluster"))).fillna(0.0, ["own_rate"])


@plan("policy_errors", "product_id:l fold:l origin:l actual:d1 pred:d6 error:d6", POL + "\nSELECT * FROM er")
def _(s):
    return Ctx(s).errors()


@plan("policy_buffer", "product_id:l buffer:d6 folds:l", POL + "\nSELECT product_id, greatest(quantile_cont(error, 0.8), 0) AS buffer, count(*) AS folds FROM er GROUP BY 1")
def _(s):
    return P.buffers(Ctx(s).errors())


@plan("policy_tier_curve", "product_id:l q:d2 served:d6 held:d6 demand:d1 fill:d6 efficiency:d6", POL + "\nSELECT product_id, q, served, held, demand, fill, eff AS efficiency FROM cw")
def _(s):
    return P.tier_curve(Ctx(s).errors())


@plan("policy_tier", "product_id:l tier:s q:d2 best_fill:d6", POL + "\nSELECT product_id, tier, q, best_fill FROM tier")
def _(s):
    c = Ctx(s)
    return P.service_tier(P.tier_curve(c.errors()), c.items)


PUBPOL = POL + """,
pol AS (SELECT it.product_id, fsn_class, lead_time_days AS L, unit_price_php, rate, rate_source, buffer, buffer_source, tier FROM it JOIN rate USING (product_id) JOIN bu USING (product_id))"""


@plan("policy_publish", "product_id:l forecast_date:D yhat:d8 yhat_lower:d6 yhat_upper:d6 rate_source:s", PUBPOL + """
SELECT product_id, d1 + CAST(k AS INT) AS forecast_date, rate AS yhat, CASE WHEN rate IS NOT NULL THEN greatest(rate - buffer / L, 0) END AS yhat_lower, CASE WHEN rate IS NOT NULL THEN rate + buffer / L END AS yhat_upper, rate_source
FROM (SELECT *, unnest(range(1, CASE WHEN rate IS NOT NULL THEN L ELSE 1 END + 1)) AS k FROM pol), hb""")
def _(s):
    c = Ctx(s)
    return P.publish(c.policy(), c.d1)


PRE = PUBPOL + """,
sg AS (SELECT product_id, count(*) FILTER (qty > 0) AS sd, sqrt((sum(qty * qty) - sum(qty) * sum(qty) / any_value(n)) / (any_value(n) - 1)) AS sg FROM pd, hb GROUP BY 1),
p2 AS (SELECT pol.*, sd, sg, sd >= 10 AND sg > 0 AND rate IS NOT NULL AS ok FROM pol JOIN sg USING (product_id)),
cm AS (SELECT fsn_class, quantile_cont(sg / rate, 0.5) AS cvm FROM p2 WHERE ok GROUP BY 1),
p3 AS (SELECT p2.*, CASE WHEN ok THEN sg ELSE rate * coalesce(cvm, 1) END AS sigma, CASE WHEN rate IS NULL THEN 'insufficient_data' WHEN ok THEN 'observed' ELSE 'cv_fallback' END AS sigma_source FROM p2 LEFT JOIN cm USING (fsn_class)),
p4 AS (SELECT *, CASE WHEN fsn_class = 'F' THEN 1.65 ELSE 1.04 END * sigma * sqrt(L) AS ss_normal FROM p3),
pre AS (SELECT *, CASE WHEN rate IS NOT NULL THEN CASE WHEN buffer_source = 'normal_fallback' THEN ss_normal ELSE buffer END END AS safety_stock, 0.25 * 210000.0 / 36051.0 AS H, rate * 365.0 AS D FROM p4)"""


def prescription(s, c=None):
    c = c or Ctx(s)
    n = F.col("n")
    sums = c.days.withColumn("n", c.n).groupBy("product_id", "n").agg(
        F.count(F.when(F.col("qty") > 0, 1)).alias("sale_days_all"), F.sum("qty").alias("s1"), F.sum(F.col("qty") * F.col("qty")).alias("s2"))
    # sample deviation over the whole history, zero days included
    sigma = sums.select("product_id", "sale_days_all", F.sqrt((F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1)).alias("sigma_obs"))
    return P.prescribe(c.policy(), sigma)


@plan("policy_prescribe", "product_id:l scenario:s sigma:d6 sigma_source:s safety_stock:d5 reorder_point:d5 eoq:d4 cost_at_eoq:d2 cost_at_half:d2 cost_at_double:d2", PRE + """
SELECT product_id, sc AS scenario, sigma, sigma_source, safety_stock, rate * L + safety_stock AS reorder_point, sqrt(2 * D * S / H) AS eoq, sqrt(2 * D * S * H) AS cost_at_eoq, 1.25 * sqrt(2 * D * S * H) AS cost_at_half, 1.25 * sqrt(2 * D * S * H) AS cost_at_double
FROM pre JOIN (VALUES ('low_admin_cost', 1250.0), ('high_goods_value', 200000.0)) v(sc, S) ON rate IS NOT NULL UNION ALL SELECT product_id, 'not_priced', sigma, sigma_source, NULL, NULL, NULL, NULL, NULL, NULL FROM pre WHERE rate IS NULL""".replace("UNION ALL SELECT", "UNION ALL SELECT"))
def _(s):
    return prescription(s)


def items_priced(s, c=None):
    return prescription(s, c).filter(F.col("scenario").isin("low_admin_cost", "not_priced"))


SET_SQL = """,
its AS (SELECT pre.*, CASE WHEN product_id % 10 = 1 THEN 21 ELSE L END AS L2, CASE WHEN product_id % 20 = 1 THEN 5.0 ELSE safety_stock * sqrt(CASE WHEN product_id % 10 = 1 THEN 21 ELSE L END / L) END AS ss2 FROM pre),
ro AS (SELECT i.*, k.current_stock AS st, rate * L2 + ss2 AS rop, rate * L2 + ss2 + 30 * rate AS target FROM its i LEFT JOIN (""" + STOCK_SQL + """) k USING (product_id))"""


def settings(s):
    k = F.col("product_id")
    return s.product.filter(k % 10 == 1).select("product_id", F.lit(21).alias("set_lead_time"), F.when(k % 20 == 1, 5.0).alias("set_safety_stock"))


def status(s, c=None):
    items = P.apply_settings(items_priced(s, c), settings(s))
    items = items.withColumn("reorder_point", F.when(F.col("rate").isNotNull(), F.col("reorder_point")))
    return P.reorder_status(items, J.latest_stock(s.workbook_count, s.staff_count))


@plan("policy_reorder_status", "product_id:l reorder_point:d5 current_stock:l days_cover:d1 needs_reorder:l approaching:l order_up_to:d1 order_qty:l order_min:l", PRE + SET_SQL + """
SELECT product_id, rop AS reorder_point, st AS current_stock, CASE WHEN rate > 0 THEN round_even(st / rate, 1) END AS days_cover, CASE WHEN rop IS NOT NULL THEN CASE WHEN st <= rop THEN 1 ELSE 0 END END AS needs_reorder,
CASE WHEN rop IS NOT NULL THEN CASE WHEN st > rop AND st <= rop * 1.2 THEN 1 ELSE 0 END END AS approaching, round_even(target, 1) AS order_up_to, CASE WHEN rop IS NOT NULL THEN CASE WHEN st <= rop THEN greatest(0, round_even(target - st, 0)) ELSE 0 END END AS order_qty,
CASE WHEN rop IS NOT NULL THEN CASE WHEN st <= rop THEN least(greatest(0, round_even(target - st, 0)), greatest(0, round_even(target - ss2 - st, 0))) ELSE 0 END END AS order_min FROM ro""")
def _(s):
    return status(s)


@plan("policy_what_if", "product_id:l scenario:s extra_units:d4 reorder_point:d4 needs_reorder:l order_qty:l units_short:d4", DAYS_SQL.rstrip() + "," + PRE[5:] + f""",
w AS (SELECT pre.*, k.current_stock AS st, sc, lt, coalesce(x.lift, 1) AS lift, dd, bulk FROM pre LEFT JOIN ({STOCK_SQL}) k USING (product_id) JOIN (VALUES ('as_is', 0, NULL, 0, 0), ('longer_lead', 10, NULL, 0, 0), ('enrollment', 0, 'enrollment', 14, 0), ('term_start', 0, 'term_start', 14, 0), ('bulk', 0, NULL, 0, 50)) v(sc, lt, kd, dd, bulk) ON rate IS NOT NULL LEFT JOIN lf x ON x.kind = v.kd),
f AS (SELECT *, safety_stock * sqrt((L + lt) / L) AS ss, rate * greatest(0, lift - 1) * least(dd, L + lt) + bulk AS extra FROM w),
g AS (SELECT *, rate * (L + lt) + ss + extra AS rop FROM f)
SELECT product_id, sc AS scenario, extra AS extra_units, rop AS reorder_point, CASE WHEN st <= rop THEN 1 WHEN st > rop THEN 0 END AS needs_reorder, CASE WHEN st <= rop THEN greatest(0, round_even(rop + 30 * rate - st, 0)) WHEN st > rop THEN 0 END AS order_qty, greatest(0, rate * (L + lt) + extra - st) AS units_short FROM g""")
def _(s):
    items = items_priced(s).filter("rate IS NOT NULL").join(J.latest_stock(s.workbook_count, s.staff_count), "product_id", "left")
    lift = CAL.lifts(CAL.day_table(s.calendar, s.sale)).agg(F.map_from_entries(F.collect_list(F.struct("kind", "lift")))).scalar()
    fields = ("scenario", "more_days", "kind", "busy_days", "bulk")
    menu = [("as_is", 0, None, 0, 0), ("longer_lead", 10, None, 0, 0), ("enrollment", 0, "enrollment", 14, 0), ("term_start", 0, "term_start", 14, 0), ("bulk", 0, None, 0, 50)]
    return what_if(items.drop("scenario"), menu, fields, lift)


def what_if(items, menu, fields, lift):
    """Each item's figures under each scenario of a short menu."""
    rows = F.array(*[F.struct(*[F.lit(v).cast("string" if f in ("scenario", "kind") else "int").alias(f) for f, v in zip(fields, m)]) for m in menu])
    w = items.withColumn("lifts", lift).withColumn("m", F.explode(rows))
    L = F.col("lead_time_days") + F.col("m.more_days")
    ss = F.col("safety_stock") * F.sqrt(L / F.col("lead_time_days"))
    up = F.greatest(F.coalesce(F.element_at("lifts", F.coalesce(F.col("m.kind"), F.lit("regular"))), F.lit(1.0)) - 1, F.lit(0.0))
    extra = F.col("rate") * F.when(F.col("m.kind").isNotNull(), up).otherwise(0.0) * F.least(F.col("m.busy_days"), L) + F.col("m.bulk")
    w = w.withColumn("extra_units", extra).withColumn("demand", F.col("rate") * L)
    w = w.withColumn("reorder_point", F.col("demand") + ss + F.col("extra_units"))
    st = F.col("current_stock")
    from tallyloom.functions.numbers import half_even

    needs = st <= F.col("reorder_point")
    order = F.greatest(F.lit(0.0), half_even(F.col("reorder_point") + 30 * F.col("rate") - st))
    return w.select("product_id", F.col("m.scenario").alias("scenario"), "extra_units", "reorder_point", needs.cast("int").alias("needs_reorder"),
                    F.when(needs, order).when(~needs, 0).alias("order_qty"), F.greatest(F.lit(0.0), F.col("demand") + F.col("extra_units") - st).alias("units_short"))


HOLD = HEAD + base_sql("n - 180", "h") + """,
com AS (SELECT it.product_id, lead_time_days AS L, tier, rate * lead_time_days + buffer AS committed FROM it JOIN rateh USING (product_id) JOIN buh USING (product_id) WHERE rate IS NOT NULL AND buffer IS NOT NULL),
nv AS (SELECT c.product_id, coalesce(sum(qty) FILTER (pos >= e - L AND pos < e), 0) AS naive FROM com c LEFT JOIN pd USING (product_id), cfgh GROUP BY 1),
wb AS (SELECT product_id, max(u) AS worst FROM (SELECT c.product_id, pos // L AS b, sum(qty) AS u FROM com c JOIN pd USING (product_id), cfgh WHERE pos // L < e // L GROUP BY ALL) GROUP BY 1),
bk AS (SELECT c.product_id, tier, committed, L, b AS block, naive, coalesce(worst, 0) AS worst, coalesce((SELECT sum(qty) FROM pd, cfgh WHERE pd.product_id = c.product_id AND pos >= e + b * L AND pos < e + (b + 1) * L), 0) AS actual FROM (SELECT *, unnest(range(90 // L)) AS b FROM com) c JOIN nv USING (product_id) LEFT JOIN wb USING (product_id))"""


def commitments(s, c, end):
    p = c.policy(end).filter("rate IS NOT NULL AND buffer IS NOT NULL")
    base = p.select("product_id", "lead_time_days", "tier", (F.col("rate") * F.col("lead_time_days") + F.col("buffer")).alias("committed"))
    before = c.days.join(base.select("product_id", F.col("lead_time_days").alias("L")), "product_id").filter(F.col("pos") < end)
    naive = before.filter(F.col("pos") >= end - F.col("L")).groupBy("product_id").agg(F.sum("qty").alias("naive"))
    worst = before.withColumn("b", F.floor(F.col("pos") / F.col("L"))).filter(F.col("b") < F.floor(end / F.col("L"))).groupBy(
        "product_id", "b").agg(F.sum("qty").alias("u")).groupBy("product_id").agg(F.max("u").alias("worst"))
    return base.join(naive, "product_id", "left").join(worst, "product_id", "left").fillna(0.0, ["naive", "worst"])


def stocked(base):
    """The policy beside its two reference rules."""
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(v).alias("committed")) for r, v in (("policy", "committed"), ("naive", "naive"), ("worst_block", "worst"))])
    return base.select("product_id", "lead_time_days", "tier", F.inline(rules))


@plan("policy_holdout", "rule:s tier:s n_skus:l n_blocks:l demand:d1 fill_rate:d6 short:d4 held:d4", HOLD + """,
rl AS (SELECT bk.*, unnest(['policy', 'naive', 'worst_block']) AS rule, unnest([committed, naive, worst]) AS c FROM bk)
SELECT rule, tier, count(DISTINCT product_id) AS n_skus, count(*) AS n_blocks, sum(actual) AS demand, sum(least(actual, c)) / nullif(sum(actual), 0) AS fill_rate, sum(greatest(actual - c, 0)) AS short, sum(greatest(c - actual, 0)) AS held FROM rl GROUP BY ALL""")
def holdout(s):
    c = Ctx(s)
    end = c.n - 180
    b = P.holdout_blocks(c.days, stocked(commitments(s, c, end)), end, F.lit(90))
    return P.summarise_blocks(b, ["rule", "tier"])


@plan("policy_budget", "q:d2 items:l")
def _(s):
    curve = P.tier_curve(Ctx(s).errors())
    base = curve.filter("q = 0.5").agg(F.sum("held") * 1.05).scalar()
    return P.allocate_budget(curve, base).groupBy("q").agg(F.count("*").alias("items"))


def donor_rates(c, split):
    """Items with their groups, and the median rate of each group from sales before ``split``."""
    r = c.rates(split)
    r = cut_lineage(r, "rates")
    edges = exact_quantiles(r, "unit_price_php", [0.25, 0.5, 0.75]).select("q").scalar()
    price = F.col("unit_price_php")
    r = r.withColumn("edges", edges).withColumn("band", F.when(price.isNull(), "unpriced").otherwise(
        F.concat(F.lit("band"), F.size(F.filter("edges", lambda e: price > e)))))
    labels = F.array(F.struct(F.lit("all").alias("rule"), F.lit("all").alias("grp")), F.struct(F.lit("category").alias("rule"), F.col("category").alias("grp")),
                     F.struct(F.lit("price_band").alias("rule"), F.col("band").alias("grp")))
    lab = r.select("product_id", "lead_time_days", "rate", F.inline(labels))
    donors = exact_quantiles(lab, "rate", [0.5], ["rule", "grp"]).select("rule", "grp", F.col("q")[0].alias("r"))
    return lab, donors


@plan("cold_start_donor", "rule:s n_skus:l n_blocks:l demand:d1 fill_rate:d6 held:d4", HEAD + base_sql("400", "h") + """,
ed AS (SELECT quantile_cont(unit_price_php, [0.25, 0.5, 0.75]) AS e FROM it WHERE unit_price_php IS NOT NULL),
lab AS (SELECT it.product_id, lead_time_days AS L, rate, unnest(['all', 'category', 'price_band']) AS rule, unnest(['all', category, CASE WHEN unit_price_php IS NULL THEN 'unpriced' ELSE 'band' || (CASE WHEN unit_price_php > ed.e[1] THEN 1 ELSE 0 END + CASE WHEN unit_price_php > ed.e[2] THEN 1 ELSE 0 END + CASE WHEN unit_price_php > ed.e[3] THEN 1 ELSE 0 END) END]) AS grp FROM it JOIN rateh USING (product_id), ed),
dn AS (SELECT rule, grp, median(rate) AS r FROM lab WHERE rate IS NOT NULL GROUP BY ALL),
cold AS (SELECT product_id FROM it WHERE product_id NOT IN (SELECT product_id FROM pd WHERE pos < 400 AND qty > 0)),
bk AS (SELECT l.rule, l.product_id, L, r * L AS c, unnest(range(90 // L)) AS b FROM lab l JOIN cold USING (product_id) JOIN dn ON dn.rule = l.rule AND dn.grp = l.grp),
sc AS (SELECT bk.*, coalesce((SELECT sum(qty) FROM pd WHERE pd.product_id = bk.product_id AND pos >= 400 + b * L AND pos < 400 + (b + 1) * L), 0) AS actual FROM bk)
SELECT rule, count(DISTINCT product_id) AS n_skus, count(*) AS n_blocks, sum(actual) AS demand, sum(least(actual, c)) / nullif(sum(actual), 0) AS fill_rate, sum(greatest(c - actual, 0)) AS held FROM sc GROUP BY 1""")
def _(s):
    c = Ctx(s)
    split = F.lit(400)
    lab, donors = donor_rates(c, split)
    sold = c.days.filter((F.col("pos") < split) & (F.col("qty") > 0)).select("product_id").distinct()
    cold = lab.join(sold, "product_id", "left_anti").join(F.broadcast(donors), ["rule", "grp"])
    com = cold.select("product_id", "lead_time_days", "rule", (F.col("r") * F.col("lead_time_days")).alias("committed"))
    # the same item is committed once per rule: score each rule's rows
    sold_after = c.days.filter(F.col("pos") >= split)
    grid = com.withColumn("block", F.explode(F.sequence(F.lit(0), (F.floor(F.lit(90) / F.col("lead_time_days")) - 1).cast("int"))))
    L = F.col("lead_time_days")
    units = (sold_after.join(c.items.select("product_id", "lead_time_days"), "product_id").withColumn("block", F.floor((F.col("pos") - split) / L).cast("int"))
             .groupBy("product_id", "block").agg(F.sum("qty").alias("actual")))
    b = grid.join(units, ["product_id", "block"], "left").fillna(0.0, ["actual"])
    k, a = F.col("committed"), F.col("actual")
    b = b.withColumn("served", F.least(a, k)).withColumn("short", F.greatest(a - k, F.lit(0.0))).withColumn("held", F.greatest(k - a, F.lit(0.0)))
    return P.summarise_blocks(b, ["rule"])


def anchor_basis(days):
    """Per month end: items with units in the last 30 and 365 days, and the units of 30 days.

    ``days``: product_id, day, q, z (the last day of all, where the last month ends), partitioned by item. A day counts from its own month's end up to the last
    month end it is near enough to, so it is one step up and two steps down in its item's units, however many month
    ends it reaches. Between two steps an item counts or doesn't, which is a step up and a step down in the number of items.
    """
    month = lambda d: F.year(d) * 12 + F.month(d) - 1
    last = month(F.col("z"))

    def beyond(window):  # the first month end that lies too far behind the day
        reach = F.date_add("day", window - 1)
        return F.when(F.col("z") <= reach, last + 1).otherwise(month(F.date_add("day", window)))

    own, no = month(F.col("day")), F.lit(0).cast("long")
    none = F.col("q") * 0  # an unknown quantity stays unknown
    near = beyond(30) > own
    steps = F.array(F.struct(own.alias("k"), F.col("q").alias("d365"), F.when(near, F.col("q")).otherwise(none).alias("d30"), F.lit(1).alias("rows")),
                    F.struct(F.greatest(beyond(30), own).alias("k"), none.alias("d365"), F.when(near, -F.col("q")).otherwise(none).alias("d30"), F.lit(0).alias("rows")),
                    F.struct(beyond(365).alias("k"), (-F.col("q")).alias("d365"), none.alias("d30"), F.lit(-1).alias("rows")))
    g = days.select("product_id", F.inline(steps)).groupBy("product_id", "k").agg(F.sum("d365").alias("d365"), F.sum("d30").alias("d30"), F.sum("rows").alias("rows"))
    w = Window.partitionBy("product_id").orderBy("k")
    counts = lambda c: F.coalesce((F.sum(c).over(w) > 0).cast("int"), F.lit(0))
    g = g.withColumns({"p365": counts("d365"), "p30": counts("d30"), "next": F.lead("k").over(w)})
    turns = F.array(F.struct("k", "p365", "p30", F.coalesce("d30", no).alias("d30"), "rows"),
                    F.struct(F.col("next").alias("k"), (-F.col("p365")).alias("p365"), (-F.col("p30")).alias("p30"), no.alias("d30"), no.alias("rows")))
    total = g.select(F.inline(turns)).groupBy("k").agg(*[F.sum(c).alias(c) for c in ("p365", "p30", "d30", "rows")])
    # one row per month from here on
    run = Window.orderBy("k")
    total = total.filter("k IS NOT NULL").select("k", F.coalesce(F.lead("k").over(run) - 1, F.col("k")).alias("until"), *[F.sum(c).over(run).alias(c) for c in ("p365", "p30", "d30", "rows")])
    total = total.withColumn("k", F.explode(F.sequence("k", "until")))
    m = F.make_date(F.floor(F.col("k") / 12).cast("int"), (F.col("k") % 12 + 1).cast("int"), F.lit(1))
    return total.filter("rows > 0").select(m.alias("m"), F.col("p30").alias("positive_30"), F.col("p365").alias("positive_365"), F.col("d30").alias("units_30"))


@plan("demand_basis_by_anchor", "anchor:s term_tag:s positive_30:l positive_365:l units_30:l", """
WITH m AS (SELECT CAST(date_trunc('month', day) AS DATE) AS m, least(last_day(any_value(day)), (SELECT max(day) FROM sale)) AS z FROM sale GROUP BY 1),
a AS (SELECT m, product_id, sum(CASE WHEN day > z - 30 THEN quantity_sold ELSE 0 END) AS u30, sum(quantity_sold) AS u365 FROM m JOIN sale ON day <= z AND day > z - 365 GROUP BY ALL),
t AS (SELECT CAST(date_trunc('month', day) AS DATE) AS m, semester_id, count(*) AS c FROM calendar WHERE day BETWEEN (SELECT min(day) FROM sale) AND (SELECT max(day) FROM sale) GROUP BY ALL),
tt AS (SELECT m, arg_max(semester_id, (c, semester_id)) AS tag, count(*) AS k FROM t GROUP BY 1)
SELECT strftime(a.m, '%Y-%m') AS anchor, any_value(tag || CASE WHEN k > 1 THEN '*' ELSE '' END) AS term_tag, count(*) FILTER (u30 > 0) AS positive_30, count(*) FILTER (u365 > 0) AS positive_365, sum(u30) AS units_30 FROM a JOIN tt ON tt.m = a.m GROUP BY a.m""")
def _(s):
    bounds = s.sale.agg(F.min("day").alias("a"), F.max("day").alias("z"))
    a, z = bounds.select("a").scalar(), bounds.select("z").scalar()
    days = s.sale.groupBy("product_id", "day").agg(F.sum("quantity_sold").alias("q")).filter("day IS NOT NULL")
    per = anchor_basis(spread(days.withColumn("z", z), "product_id"))
    t = s.calendar.filter(F.col("day").between(a, z)).groupBy(F.trunc("day", "month").alias("m"), "semester_id").agg(F.count("*").alias("c"))
    tag = t.groupBy("m").agg(F.max_by("semester_id", F.struct("c", "semester_id")).alias("t"), F.count("*").alias("k"))
    return per.join(F.broadcast(tag), "m").withColumn("anchor", F.date_format("m", "yyyy-MM")).withColumn(
        "term_tag", F.concat("t", F.when(F.col("k") > 1, "*").otherwise("")))


@plan("acceptance_checks", "check:s actual:d6 ok:l", HOLD + """,
t AS (SELECT sum(actual) AS d, sum(least(actual, committed)) AS sp, sum(greatest(committed - actual, 0)) AS hp, sum(least(actual, naive)) AS sn, sum(greatest(naive - actual, 0)) AS hn FROM bk),
o AS (SELECT avg(observed) AS s FROM ob, cfgh WHERE pos < e AND pos >= e - 365), z AS (SELECT count(*) FILTER (rate = 0) AS z, count(*) AS n, count(*) FILTER (rate_source IN ('observed', 'insufficient_data')) AS k FROM rateh)
SELECT 'states_cover_all' AS check, k / n AS actual, CASE WHEN k = n THEN 1 ELSE 0 END AS ok FROM z UNION ALL SELECT 'no_silent_zero', z, CASE WHEN z = 0 THEN 1 ELSE 0 END FROM z
UNION ALL SELECT 'beats_naive_fill', (sp - sn) / d, CASE WHEN sp > sn THEN 1 ELSE 0 END FROM t UNION ALL SELECT 'not_dominated_by_naive', (hn - hp) / d, CASE WHEN NOT (sn >= sp AND hn <= hp) THEN 1 ELSE 0 END FROM t
UNION ALL SELECT 'observed_share', s, CASE WHEN s >= 0.9 THEN 1 ELSE 0 END FROM o""".replace("\nSELECT 'states", "\nSELECT 'states").replace("FROM z UNION", "FROM z UNION"))
def _(s):
    c = Ctx(s)
    end = c.n - 180
    b = P.holdout_blocks(c.days, commitments(s, c, end), end, F.lit(90))
    t = b.agg(F.sum("actual").alias("d"), F.sum("served").alias("sp"), F.sum("held").alias("hp"), F.sum(F.least("actual", "naive")).alias("sn"),
              F.sum(F.greatest(F.col("naive") - F.col("actual"), F.lit(0.0))).alias("hn"))
    r = c.rates(end).agg(F.count(F.when(F.col("rate") == 0, 1)).alias("z"), F.count("*").alias("n"), F.count(F.when(F.col("rate_source").isin("observed", "insufficient_data"), 1)).alias("k"))
    o = c.observed.filter((F.col("pos") < end) & (F.col("pos") >= end - 365)).agg(F.avg("observed").alias("s"))

    def line(df, *checks):
        rows = F.array(*[F.struct(F.lit(n).alias("check"), v.cast("double").alias("actual"), k.cast("int").alias("ok")) for n, v, k in checks])
        return df.select(F.inline(rows))

    z, n, k, sp, sn, hp, hn, d = (F.col(x) for x in ("z", "n", "k", "sp", "sn", "hp", "hn", "d"))
    return (line(r, ("states_cover_all", k / n, k == n), ("no_silent_zero", z, z == 0))
            .unionByName(line(t, ("beats_naive_fill", (sp - sn) / d, sp > sn), ("not_dominated_by_naive", (hn - hp) / d, ~((sn >= sp) & (hn <= hp)))))
            .unionByName(line(o, ("observed_share", F.col("s"), F.col("s") >= 0.9))))
