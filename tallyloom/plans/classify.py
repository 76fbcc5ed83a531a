"""Speed classes and decision rules."""

from pyspark.sql import functions as F

from tallyloom.operators import aggregates as A
from tallyloom.operators import classify as C
from tallyloom.plans.registry import plan

FSN_SQL = """SELECT p.*, coalesce(b.days, 0) AS active_tally_dates, coalesce(b.adus, 0.0) AS adus,
 CASE WHEN coalesce(units, 0) <= 0 THEN 'N' WHEN b.adus >= c[2] AND NOT (last_sold IS NULL OR date_diff('day', last_sold, ref) >= 90) THEN 'F' ELSE 'S' END AS fsn_class,
 CASE WHEN coalesce(units, 0) > 0 AND b.adus >= c[1] AND date_diff('day', last_sold, ref) < 90 THEN 1 ELSE 0 END AS f75,
 CASE WHEN coalesce(units, 0) > 0 AND b.adus >= c[2] AND date_diff('day', last_sold, ref) < 90 THEN 1 ELSE 0 END AS f80,
 CASE WHEN coalesce(units, 0) > 0 AND b.adus >= c[3] AND date_diff('day', last_sold, ref) < 90 THEN 1 ELSE 0 END AS f85
 FROM product p LEFT JOIN (SELECT *, CASE WHEN days > 0 THEN wu / days ELSE 0.0 END AS adus FROM (
   SELECT product_id, sum(CASE WHEN is_censored IS DISTINCT FROM 1 THEN CASE WHEN imputation_flag = 1 THEN quantity_sold * 0.5 ELSE quantity_sold END END) AS wu,
    sum(CASE WHEN is_censored IS DISTINCT FROM 1 THEN quantity_sold END) AS units,
    count(DISTINCT CASE WHEN is_censored IS DISTINCT FROM 1 THEN day END) AS days,
    max(CASE WHEN quantity_sold > 0 THEN day END) AS last_sold FROM sale GROUP BY 1)) b USING (product_id),
 (SELECT quantile_cont(CASE WHEN days > 0 THEN wu / days ELSE 0.0 END, [0.75, 0.8, 0.85]) AS c FROM (
   SELECT product_id, sum(CASE WHEN imputation_flag = 1 THEN quantity_sold * 0.5 ELSE quantity_sold END) AS wu, count(DISTINCT day) AS days
   FROM sale WHERE is_censored IS DISTINCT FROM 1 GROUP BY 1)) q,
 (SELECT max(day) AS ref FROM sale WHERE quantity_sold > 0) r"""

STATS_SQL = """SELECT product_id, sum(quantity_sold) AS total_units, count(DISTINCT day) AS observed_days,
 count(DISTINCT CASE WHEN is_censored = 1 THEN day END) AS censored_days,
 sum(CASE WHEN imputation_flag = 1 THEN quantity_sold * 0.5 ELSE quantity_sold END) AS weighted_units,
 min(day) AS first_sale, max(day) AS last_sale,
 count(DISTINCT day) - count(DISTINCT CASE WHEN is_censored = 1 THEN day END) AS active_tally_dates,
 CASE WHEN count(DISTINCT day) - count(DISTINCT CASE WHEN is_censored = 1 THEN day END) > 0
  THEN round_even(sum(CASE WHEN imputation_flag = 1 THEN quantity_sold * 0.5 ELSE quantity_sold END) / (count(DISTINCT day) - count(DISTINCT CASE WHEN is_censored = 1 THEN day END)), 4) ELSE 0 END AS adus
 FROM sale GROUP BY 1"""


@plan("fsn_classify", "product_id:l item_name:s active_tally_dates:l adus:d6 fsn_class:s is_hvl:l borderline:l",
      f"""SELECT *, CASE WHEN fsn_class = 'F' AND active_tally_dates < 30 THEN 1 ELSE 0 END AS is_hvl,
      CASE WHEN f75 <> f80 OR f80 <> f85 THEN 1 ELSE 0 END AS borderline FROM ({FSN_SQL})""")
def fsn(s):
    return C.fsn_classify(s.product, s.sale)


@plan("fsn_sensitivity", "threshold:l F:l S:l N:l cutoff:d4",
      f"""WITH st AS ({STATS_SQL}), mv AS (SELECT adus FROM st WHERE active_tally_dates > 0),
t AS (SELECT threshold, quantile_cont(adus, threshold / 100.0) AS cutoff FROM mv, (SELECT unnest([75, 80, 85]) AS threshold) GROUP BY 1) 
SELECT threshold, count(*) FILTER (adus >= cutoff) AS F, count(*) FILTER (adus < cutoff) AS S, (SELECT count(*) FROM product) - count(*) AS N, round_even(any_value(cutoff), 4) AS cutoff FROM mv, t GROUP BY threshold"""
      .replace("SELECT threshold, quantile_cont(adus, threshold / 100.0) AS cutoff FROM mv, (SELECT unnest([75, 80, 85]) AS threshold) GROUP BY 1",
               "SELECT unnest([75, 80, 85]) AS threshold, unnest(quantile_cont(adus, [0.75, 0.8, 0.85])) AS cutoff FROM mv"))
def _(s):
    return C.fsn_sensitivity(s.product, A.catalog_stats(s.sale))


def past_months(s, n=12):
    last = s.sale.filter("quantity_sold > 0").agg(F.trunc(F.max("day"), "month").alias("m"))
    return last.select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.add_months("m", -k)).alias("os"))


@plan("fsn_as_of", "origin:D rule:s fast:l dead:l coverage:d6", """
WITH o AS (SELECT CAST(date_trunc('month', m) AS DATE) - to_months(CAST(k AS INT)) AS origin FROM (SELECT max(day) AS m FROM sale WHERE quantity_sold > 0), (SELECT unnest(range(12)) AS k)),
x AS (SELECT CAST(origin AS DATE) AS origin, s.* FROM o JOIN sale s ON s.day < CAST(origin AS DATE) + 30),
g AS (SELECT origin, product_id,
 sum(CASE WHEN day < origin AND is_censored IS DISTINCT FROM 1 THEN CASE WHEN imputation_flag = 1 THEN 0.5 ELSE 1.0 END * quantity_sold END) AS wu,
 sum(CASE WHEN day < origin AND is_censored IS DISTINCT FROM 1 THEN quantity_sold END) AS units,
 count(DISTINCT CASE WHEN day < origin AND is_censored IS DISTINCT FROM 1 THEN day END) AS days,
 max(CASE WHEN day < origin AND quantity_sold > 0 THEN day END) AS last_sold,
 sum(CASE WHEN day >= origin THEN quantity_sold ELSE 0 END) AS ahead FROM x GROUP BY ALL),
h AS (SELECT *, CASE WHEN days > 0 THEN wu / days END AS adus FROM g),
p AS (SELECT origin, quantile_cont(adus, 0.8) AS cut, max(last_sold) AS ref, sum(ahead) AS total FROM h GROUP BY 1),
f AS (SELECT origin, rule, ahead, total, CASE WHEN units > 0 AND adus >= cut AND date_diff('day', last_sold, ref) < stale THEN 1 ELSE 0 END AS fast FROM h JOIN p USING (origin), (VALUES ('none', 100000), ('90 days', 90), ('180 days', 180)) r(rule, stale))
SELECT origin, rule, sum(fast) AS fast, sum(CASE WHEN fast = 1 AND ahead <= 0 THEN 1 ELSE 0 END) AS dead, sum(fast * ahead) / any_value(total) AS coverage FROM f GROUP BY ALL""")
def _(s):
    return C.fsn_as_of(s.sale, past_months(s), {"none": 100000, "90 days": 90, "180 days": 180})


DECISION_SQL = f"""WITH cls AS ({FSN_SQL}),
tm AS (SELECT semester_id, min(day) AS a, max(day) AS b FROM calendar WHERE semester_id LIKE '%-T1' OR semester_id LIKE '%-T2' GROUP BY 1 HAVING max(day) <= (SELECT max(day) FROM sale) ORDER BY a DESC LIMIT 2),
v AS (SELECT product_id, semester_id, count(DISTINCT day) - count(DISTINCT CASE WHEN is_censored = 1 THEN day END) AS act,
 sum(CASE WHEN imputation_flag = 1 THEN quantity_sold * 0.5 ELSE quantity_sold END) AS wu FROM sale JOIN tm ON day BETWEEN a AND b GROUP BY ALL),
seen AS (SELECT product_id, min(day) AS first_day FROM sale GROUP BY 1),
r AS (SELECT c.product_id, c.fsn_class, c.discontinued, CASE WHEN coalesce(act, 0) > 0 THEN 1 ELSE 0 END AS on_sheet,
 CASE WHEN coalesce(act, 0) > 0 THEN CASE WHEN round_even(wu / act, 4) < 0.1 THEN 1 ELSE 0 END WHEN first_day < tm.a THEN 1 ELSE 0 END AS slow
 FROM cls c CROSS JOIN tm LEFT JOIN v ON v.product_id = c.product_id AND v.semester_id = tm.semester_id LEFT JOIN seen ON seen.product_id = c.product_id)
"""


@plan("decision_rules", "product_id:l fsn_class:s terms_on_sheet:l action:s", DECISION_SQL + """
SELECT product_id, fsn_class, sum(on_sheet) AS terms_on_sheet, CASE WHEN discontinued = 1 THEN 'discontinued' WHEN fsn_class = 'F' THEN 'keep_stocked' WHEN fsn_class = 'N' THEN 'clear_out'
 WHEN sum(slow) >= 2 THEN 'review_discontinuation' ELSE 'promote' END AS action FROM r GROUP BY product_id, fsn_class, discontinued""")
def decisions(s, classes=None):
    return C.decision_rules(C.fsn_classify(s.product, s.sale) if classes is None else classes, s.sale, s.calendar)
