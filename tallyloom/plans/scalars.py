"""Scalar functions bound to the star."""

from pyspark.sql import functions as F

from tallyloom.functions import calendar as C
from tallyloom.functions import numbers as N
from tallyloom.functions import text as T
from tallyloom.plans.registry import plan


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(rules, col, default, value=_q):
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, {_q(p)}) THEN {value(v)}" for v, p in rules) + f" ELSE {default} END"


def _units(s, *cols):
    """Item rows with their units, so labels are weighed by the whole fact."""
    return s.sale.groupBy("product_id").agg(F.sum("quantity_sold").alias("units")).join(s.product, "product_id")


_U = "WITH u AS (SELECT p.*, q.units FROM (SELECT product_id, sum(quantity_sold) AS units FROM sale GROUP BY 1) q JOIN product p USING (product_id))\n"


@plan("fn_category_rules", "item_name:s label:s units:l", _U + f"SELECT item_name, {_case(T.CATEGORY_RULES, 'lower(item_name)', _q(T.RESIDUE))} AS label, units FROM u")
def _(s):
    return _units(s).withColumn("label", T.category_of(F.col("item_name")))


@plan("fn_rules_with_override", "item_name:s section:s basis:s units:l", _U + f"""
SELECT item_name, CASE WHEN product_id % 19 = 0 THEN 'Premium' ELSE {_case([(a, p) for a, _, p in T.SECTION_RULES], 'lower(item_name)', _q(T.SECTION_RESIDUE))} END AS section,
CASE WHEN product_id % 19 = 0 THEN 'override' ELSE {_case([(b, p) for _, b, p in T.SECTION_RULES], 'lower(item_name)', "'none'")} END AS basis, units FROM u""")
def _(s):
    over = s.product.filter(F.col("product_id") % 19 == 0).select("product_id", F.lit("Premium").alias("override"))
    return _units(s).join(over, "product_id", "left").withColumn("r", T.section_of(F.col("item_name"), F.col("override"))).select("item_name", "r.section", "r.basis", "units")


_TAG = "CASE WHEN product_id % 5 = 0 THEN 'APPAREL' WHEN product_id % 5 = 1 THEN 'MAIN STORAGE' END"


def _tag():
    k = F.col("product_id") % 5
    return F.when(k == 0, "APPAREL").when(k == 1, "MAIN STORAGE")


_APP = f"(regexp_matches(lower(item_name), {_q('|'.join(T.APPAREL_PARTS))}) OR regexp_matches(lower(item_name), {_q(chr(92) + 'b(' + '|'.join(T.APPAREL_WORDS) + ')' + chr(92) + 'b')}))"


@plan("fn_apparel_class", "product_id:l cls:s units:l", _U + f"SELECT product_id, CASE WHEN {_TAG} = 'APPAREL' THEN 'apparel' WHEN {_TAG} = 'MAIN STORAGE' THEN 'non-apparel' WHEN {_APP} THEN 'apparel' ELSE 'non-apparel' END AS cls, units FROM u")
def _(s):
    return _units(s).withColumn("cls", T.apparel_class(F.col("item_name"), _tag()))


@plan("fn_product_type", "product_id:l kind:s units:l", _U + f"SELECT product_id, CASE WHEN coalesce({_TAG} = 'APPAREL', false) OR {_APP} THEN 'clothes' ELSE {_case(T.TYPE_RULES, 'lower(item_name)', _q('misc'))} END AS kind, units FROM u")
def _(s):
    return _units(s).withColumn("kind", T.product_type(F.col("item_name"), _tag()))


_LEAD = [("28", "jacket|windbreaker"), ("18", "embro"), ("14", r"shirt|jersey|polo|\btee\b")]


@plan("fn_lead_time", "product_id:l days:l label:s", """
WITH md AS (SELECT supplier_id, count(*) AS n, round_even(quantile_cont(d, 0.5), 0) AS med FROM (SELECT supplier_id, date_diff('day', ordered_on, delivered_on) AS d FROM restock_log WHERE delivered_on >= ordered_on) GROUP BY 1 HAVING count(*) >= 3)
SELECT product_id, coalesce(med, """ + _case(_LEAD, "lower(item_name)", "18", str) + """) AS days, CASE WHEN med IS NOT NULL THEN 'measured (' || n || ' deliveries)' ELSE """
      + _case([("jacket", "jacket|windbreaker"), ("embroidered_shirt", "embro"), ("simple_dtf_puff_shirt", r"shirt|jersey|polo|\btee\b")], "lower(item_name)", "'default (uncategorized)'") + " END AS label FROM product_full LEFT JOIN md USING (supplier_id)")
def lead_times(s):
    from tallyloom.plans.aggregates import delivery_medians

    md = delivery_medians(s.restock_log)
    p = s.product_full.join(md, "supplier_id", "left").withColumn("lt", T.lead_time(F.col("item_name"), F.lit(None).cast("string")))
    measured = F.concat(F.lit("measured ("), F.col("deliveries"), F.lit(" deliveries)"))
    return p.select("product_id", F.coalesce(F.col("median_days").cast("long"), F.col("lt.days")).alias("days"),
                    F.when(F.col("median_days").isNotNull(), measured).otherwise(F.col("lt.label")).alias("label"))


_ORD = ["Walk-in", "BULK order!", "pre-order", "Reserved", "yes", "", "what?"]


@plan("fn_order_type", "raw:s order_type:s rows:l units:l", f"""
WITH r AS (SELECT ({[x for x in _ORD]})[CAST(order_id % 7 + 1 AS INT)] AS raw, quantity_sold FROM fact), k AS (SELECT raw, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS key, quantity_sold FROM r)
SELECT raw, CASE WHEN key = '' THEN 'walk_in' WHEN key IN ('walkin', 'walk', 'counter', 'regular', 'no', 'n', 'false', '0') THEN 'walk_in' WHEN key IN ('bulk', 'bulkorder', 'yes', 'y', 'true', '1', 'org') THEN 'bulk' WHEN key IN ('preorder', 'pre', 'reservation', 'reserved') THEN 'pre_order' END AS order_type,
count(*) AS rows, sum(quantity_sold) AS units FROM k GROUP BY ALL""")
def _(s):
    raw = F.element_at(F.array(*[F.lit(x) for x in _ORD]), (F.col("order_id") % 7 + 1).cast("int"))
    return s.fact.groupBy(raw.alias("raw"), T.order_type(raw).alias("order_type")).agg(F.count("*").alias("rows"), F.sum("quantity_sold").alias("units"))


_LABELS = ["USTET selling", "Preparation for USTET selling", "HOLIDAY (Day of Valor)", "No class - typhoon", "", "Curated day", "odd colour"]


@plan("fn_day_status", "label:s status:s rows:l units:l", f"""
WITH r AS (SELECT ({_LABELS})[CAST(date_diff('day', DATE '1990-01-01', day) % 7 + 1 AS INT)] AS label, quantity_sold FROM fact)
SELECT label, CASE label WHEN 'USTET selling' THEN 'SELLING_SPECIAL' WHEN 'Preparation for USTET selling' THEN 'OPS_NONSELLING' WHEN 'HOLIDAY (Day of Valor)' THEN 'CLOSED' WHEN 'No class - typhoon' THEN 'SUSPENSION' WHEN '' THEN 'NORMAL' WHEN 'Curated day' THEN 'CLOSED' ELSE 'UNKNOWN' END AS status, count(*) AS rows, sum(quantity_sold) AS units FROM r GROUP BY ALL""")
def _(s):
    n = F.datediff("day", F.lit("1990-01-01").cast("date")) % 7 + 1
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), n.cast("int"))
    per = s.fact.groupBy(label.alias("label")).agg(F.count("*").alias("rows"), F.sum("quantity_sold").alias("units"))
    curated = F.when(F.upper(F.trim("label")) == "CURATED DAY", "CLOSED")
    return per.withColumn("status", T.day_status(F.col("label"), curated))


@plan("fn_day_kind", "planning:s demand:s mark:s report:s days:l units:l", """
SELECT planning_kind AS planning, demand_kind AS demand, sheet_mark AS mark, report_kind AS report, count(DISTINCT day) AS days, sum(quantity_sold) AS units FROM sale JOIN kinds USING (day) GROUP BY ALL""")
def _(s):
    k = s.calendar.select("day", C.planning_kind().alias("planning"), C.demand_kind().alias("demand"), C.sheet_mark().alias("mark"), C.report_kind().alias("report"))
    u = s.sale.groupBy("day").agg(F.sum("quantity_sold").alias("u"))
    return u.join(F.broadcast(k), "day").groupBy("planning", "demand", "mark", "report").agg(F.count("*").alias("days"), F.sum("u").alias("units"))


_NAMED = "'NEW ' || upper(item_name) || CASE WHEN product_id % 3 = 0 THEN ' @' || (product_id % 300 + 50) WHEN product_id % 3 = 1 THEN ' w/ Scarves & Bodies' ELSE ' dress designs' END"


def _named():
    k = F.col("product_id")
    return F.concat(F.lit("NEW "), F.upper("item_name"), F.when(k % 3 == 0, F.concat(F.lit(" @"), k % 300 + 50))
                    .when(k % 3 == 1, " w/ Scarves & Bodies").otherwise(" dress designs"))


@plan("fn_name_tokens", "product_id:l tokens:s", f"""
WITH n AS (SELECT product_id, regexp_replace(regexp_replace(lower({_NAMED}), '@\\s*(\\d+(?:\\.\\d+)?)', ' ', 'g'), '\\bw/\\s*', ' with ', 'g') AS t FROM product),
w AS (SELECT product_id, list_filter(regexp_split_to_array(t, '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM n),
st AS (SELECT product_id, list_transform(ws, lambda x: CASE WHEN len(x) > 4 AND x LIKE '%ves' THEN x[:-4] || 'f' WHEN len(x) > 4 AND x LIKE '%ies' THEN x[:-4] || 'y' WHEN len(x) > 3 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN x[:-2] ELSE x END) AS ts FROM w)
SELECT product_id, array_to_string(list_filter(ts, lambda x: x NOT IN ('ust', 'print', 'with', 'the', 'of', 'and', 'new', 'design', 'designs', 'assorted', 'all')), ' ') AS tokens FROM st""")
def _(s):
    return s.product.select("product_id", F.array_join(T.name_tokens(_named()), " ").alias("tokens"))


@plan("fn_price_suffix", "product_id:l suffix:d2 base:s", f"""
SELECT product_id, CASE WHEN product_id % 3 = 0 THEN product_id % 300 + 50 END AS suffix, trim(regexp_replace({_NAMED}, '\\s*@\\s*(\\d+(?:\\.\\d+)?)', '', 'g')) AS base FROM product""")
def _(s):
    n = s.product.withColumn("name", _named())
    return n.select("product_id", T.price_suffix(F.col("name")).alias("suffix"), T.without_price_suffix(F.col("name")).alias("base"))


_DT = "CASE order_id % 5 WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN strftime(day, '%d/%m/%Y') WHEN 2 THEN strftime(day, '%Y-%m') || '-31' WHEN 3 THEN '' ELSE strftime(day, '%Y-%-m-%-d') END"


@plan("fn_strict_date", "valid:l parsed:D rows:l", f"""
WITH r AS (SELECT {_DT} AS t FROM fact), p AS (SELECT CASE WHEN regexp_full_match(t, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(t AS DATE) END AS parsed FROM r)
SELECT CASE WHEN parsed IS NULL THEN 0 ELSE 1 END AS valid, parsed, count(*) AS rows FROM p GROUP BY ALL""")
def _(s):
    k = F.col("order_id") % 5
    raw = (F.when(k == 0, F.date_format("day", "yyyy-MM-dd")).when(k == 1, F.date_format("day", "dd/MM/yyyy"))
           .when(k == 2, F.concat(F.date_format("day", "yyyy-MM"), F.lit("-31"))).when(k == 3, "").otherwise(F.date_format("day", "yyyy-M-d")))
    d = T.strict_date(raw)
    return s.fact.groupBy(d.alias("parsed"), d.isNotNull().cast("int").alias("valid")).agg(F.count("*").alias("rows"))


@plan("fn_parse_number", "kind:l parsed:l rows:l", """
SELECT order_id % 4 AS kind, CASE order_id % 4 WHEN 0 THEN CAST(amount AS BIGINT) * 0 + floor(amount) WHEN 1 THEN quantity_sold WHEN 2 THEN NULL ELSE NULL END AS parsed, count(*) AS rows FROM fact GROUP BY ALL""")
def _(s):
    k = F.col("order_id") % 4
    raw = (F.when(k == 0, F.concat(F.format_number(F.floor("amount"), 0), F.lit(" pcs.")))
           .when(k == 1, F.concat(F.col("quantity_sold").cast("string"), F.lit(".0")))
           .when(k == 2, F.concat(F.col("quantity_sold").cast("string"), F.lit(".5"))).otherwise("none"))
    return s.fact.groupBy(k.alias("kind"), T.parse_int(raw).alias("parsed")).agg(F.count("*").alias("rows"))


@plan("fn_academic_periods", "academic_year:l semester_id:s quarter_key:s quarter_end:D units:l", """
SELECT CASE WHEN month(day) >= 8 THEN year(day) ELSE year(day) - 1 END AS academic_year, semester_id, year(day) || '-Q' || quarter(day) AS quarter_key,
CAST(date_trunc('quarter', day) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end, sum(quantity_sold) AS units FROM sale JOIN calendar USING (day) GROUP BY ALL""")
def _(s):
    d = F.col("day")
    u = s.sale.groupBy("day").agg(F.sum("quantity_sold").alias("u")).join(F.broadcast(s.calendar.select("day", "semester_id")), "day")
    return u.groupBy(
        F.when(F.month(d) >= 8, F.year(d)).otherwise(F.year(d) - 1).alias("academic_year"), "semester_id",
        F.concat(F.year(d), F.lit("-Q"), F.quarter(d)).alias("quarter_key"),
        F.last_day(F.make_date(F.year(d), F.quarter(d) * 3, F.lit(1))).alias("quarter_end")).agg(F.sum("u").alias("units"))


@plan("fn_year_shift", "day:D last_year:D next_year:D gap:l units:l", """
SELECT day, CAST(day - INTERVAL 1 YEAR AS DATE) AS last_year, CAST(day + INTERVAL 1 YEAR AS DATE) AS next_year,
least(abs(date_diff('day', DATE '2000-03-01', CAST(day + to_years(CAST(2000 - year(day) AS INT)) AS DATE))), 365 - abs(date_diff('day', DATE '2000-03-01', CAST(day + to_years(CAST(2000 - year(day) AS INT)) AS DATE)))) AS gap, sum(quantity_sold) AS units FROM sale GROUP BY ALL""")
def _(s):
    u = s.sale.groupBy("day").agg(F.sum("quantity_sold").alias("units"))
    d = F.col("day")
    return u.select("day", C.year_shift(d, -1).alias("last_year"), C.year_shift(d, 1).alias("next_year"),
                    C.yearly_gap(d, F.lit("2000-03-01").cast("date")).alias("gap"), "units")


@plan("fn_eoq_cost", "product_id:l eoq:d4 cost:d2 half_cost:d2", _U + """
SELECT product_id, CASE WHEN units > 0 AND unit_price_php > 0 THEN sqrt(2 * units * 1250.0 / (unit_price_php * 0.25)) ELSE 0 END AS eoq,
CASE WHEN units > 0 AND unit_price_php > 0 THEN sqrt(2 * units * 1250.0 * unit_price_php * 0.25) END AS cost, CASE WHEN units > 0 AND unit_price_php > 0 THEN 1.25 * sqrt(2 * units * 1250.0 * unit_price_php * 0.25) END AS half_cost FROM u""")
def _(s):
    d, o, h = F.col("units"), F.lit(1250.0), F.col("unit_price_php") * 0.25
    q = N.eoq(d, o, h)
    return _units(s).select("product_id", q.alias("eoq"), N.total_cost(d, o, h, q).alias("cost"), N.total_cost(d, o, h, q / 2).alias("half_cost"))


@plan("fn_transforms", "product_id:l log_units:d6 root_units:d6 yj:d6 back:d4", _U + """
SELECT product_id, ln(1 + units) AS log_units, sqrt(units) AS root_units, (pow(units + 1, 0.3) - 1) / 0.3 AS yj, units AS back FROM u""")
def _(s):
    u = F.col("units").cast("double")
    yj = N.yeo_johnson(u, 0.3)
    return _units(s).select("product_id", F.log1p(u).alias("log_units"), F.sqrt(u).alias("root_units"), yj.alias("yj"),
                            F.greatest(N.yeo_johnson_inverse(yj, 0.3), F.lit(0.0)).alias("back"))


@plan("fn_array_months", "base_name:s months:l first_month:s last_month:s shared_with_damaged:l", """
WITH g AS (SELECT base_name, list(DISTINCT strftime(day, '%Y-%m')) FILTER (lower(coalesce(transaction_type, 'sale')) = 'sale') AS a, list(DISTINCT strftime(day, '%Y-%m')) FILTER (transaction_type = 'Damaged') AS b FROM fact JOIN product USING (product_id) GROUP BY 1)
SELECT base_name, len(a) AS months, list_min(a) AS first_month, list_max(a) AS last_month, len(list_intersect(a, b)) AS shared_with_damaged FROM g""")
def _(s):
    from tallyloom.operators.filters import is_sale

    m = F.date_format("day", "yyyy-MM")
    own = s.fact.select("product_id", m.alias("month"), is_sale().alias("sold"), (F.col("transaction_type") == "Damaged").alias("damaged")).distinct()
    g = own.join(s.product, "product_id").groupBy("base_name").agg(
        F.collect_set(F.when(F.col("sold"), F.col("month"))).alias("a"), F.collect_set(F.when(F.col("damaged"), F.col("month"))).alias("b"))
    return g.select("base_name", F.size("a").alias("months"), F.array_min("a").alias("first_month"), F.array_max("a").alias("last_month"),
                    F.size(F.array_intersect("a", "b")).alias("shared_with_damaged"))


@plan("fn_json_shape", "product_id:l doc:s")
def _(s):
    scen = F.map_from_entries(F.array(*[F.struct(F.lit(n), F.struct(
        F.lit(c).alias("ordering_cost"), F.round(N.eoq(F.col("units"), F.lit(c), F.lit(1.46)), 2).alias("eoq"))) for n, c in (("low_admin_cost", 1250.0), ("high_goods_value", 200000.0))]))
    return _units(s).select("product_id", F.to_json(F.struct(
        "item_name", "units", F.struct("entry_date", "lead_time_days").alias("calendar"), scen.alias("scenarios"))).alias("doc"))
