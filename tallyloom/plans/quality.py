"""Entity resolution, clustering and data quality bound to the star."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import aggregates as A
from tallyloom.operators import entity as E
from tallyloom.operators import methods as M
from tallyloom.operators.quantiles import exact_quantiles
from tallyloom.operators.scale import cut_lineage, spread
from tallyloom.plans import policy as PP
from tallyloom.plans.classify import FSN_SQL
from tallyloom.plans.joins import _RAWN, raw_named, raw_spelled, vocabulary
from tallyloom.plans.registry import plan
from tallyloom.plans.sources import _RAW, judged_rows
from tallyloom.sources.star import month_key


def named_items(s):
    """Items sold in the first half of the recorded span under their old name, after that
    under a new spelling: two name lists to match, with months and prices."""
    per = s.sale.groupBy("product_id", month_key("day").alias("month")).agg(F.count("*").alias("rows")).join(s.product_full, "product_id")
    per = cut_lineage(per.select("product_id", "month", "rows", "item_name", "base_name", "supplier_name", "unit_price_php"), "named")
    split = F.date_format(s.mark("middle"), "yyyy-MM")
    old = per.filter(F.col("month") < split)
    new = per.filter(F.col("month") >= split).withColumn("item_name", F.concat(F.upper("base_name"), F.lit(" w/ print #"), F.col("product_id")))

    def fold(df):
        return df.groupBy(F.col("item_name").alias("name"), F.col("supplier_name").alias("supplier")).agg(
            F.first("unit_price_php").alias("price"), F.collect_set("month").alias("months"), F.sum("rows").alias("rows"))

    return cut_lineage(fold(new), "names"), cut_lineage(fold(old), "names")


@plan("er_name_suggest", "supplier:s new:s old:s score:d3 strength:s why:s")
def _(s):
    return E.suggest(*named_items(s))


def _any(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@plan("er_name_cluster", "name:s cluster:s rows:l suggested:s confidence:s needs_review:l conflict:l", _RAWN.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + rf""",
c0 AS (SELECT raw_item AS name, count(*) AS rows FROM rawn GROUP BY 1),
c1 AS (SELECT CASE WHEN length(name) % 5 = 0 THEN name || 's' ELSE name END AS name, sum(rows) AS rows FROM c0 GROUP BY 1),
c2 AS (SELECT *, regexp_replace(regexp_replace(lower(trim(name)), '\s+', ' ', 'g'), '\s*/\s*', '/', 'g') AS key FROM c1),
c3 AS (SELECT *, array_to_string(list_sort(string_split(key, ' ')), ' ') AS norm FROM c2 WHERE key <> ''),
nd AS (SELECT DISTINCT norm FROM c3),
ed AS (SELECT a.norm AS a, b.norm AS b, 100 * (1 - levenshtein(a.norm, b.norm) / greatest(length(a.norm), length(b.norm))) AS score FROM nd a JOIN nd b ON a.norm < b.norm AND abs(length(a.norm) - length(b.norm)) <= 0.2 * greatest(length(a.norm), length(b.norm)) + 1e-9
 WHERE levenshtein(a.norm, b.norm) <= floor(greatest(length(a.norm), length(b.norm)) * 0.2 + 1e-9)),
e2 AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
rc(norm, other) AS (SELECT norm, norm FROM nd UNION SELECT rc.norm, e2.b FROM rc JOIN e2 ON e2.a = rc.other),
lb AS (SELECT norm, min(other) AS label FROM rc GROUP BY 1),
wk AS (SELECT label, min(score) AS weakest FROM ed JOIN lb ON lb.norm = ed.a GROUP BY 1),
sp AS (SELECT key, any_value(label) AS label, arg_max(name, (rows, name)) AS own, max(rows) AS top,
 array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(key, '[a-z]+'), lambda x: list_contains({_any(T.COLOUR_WORDS)}, x)))), ' ') AS colours,
 array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(key, '[a-z]+'), lambda x: list_contains({_any(T.SIZE_WORDS)}, x)))), ' ') AS sizes,
 nullif(upper(regexp_extract(key, '{T.PRODUCT_CODE}', 1)), '') AS code, array_to_string(list_sort(list_distinct(regexp_extract_all(key, '{T.NUMBER}'))), ' ') AS numbers FROM c3 JOIN lb USING (norm) GROUP BY key),
wh AS (SELECT label, count(*) AS spellings, arg_max(own, (top, own)) AS everyone, count(DISTINCT colours) > 1 OR count(DISTINCT sizes) > 1 OR count(DISTINCT code) > 1 OR count(DISTINCT numbers) > 1 AS conflict FROM sp GROUP BY 1)
SELECT name, label AS cluster, rows, regexp_replace(trim(CASE WHEN spellings = 1 OR conflict THEN own ELSE everyone END), '\s+', ' ', 'g') AS suggested,
CASE WHEN spellings = 1 OR conflict THEN 'high' WHEN coalesce(weakest, 100) >= 90 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN spellings > 1 THEN 1 ELSE 0 END AS needs_review, CASE WHEN spellings > 1 AND conflict THEN 1 ELSE 0 END AS conflict
FROM c3 JOIN sp USING (key) JOIN wh USING (label) LEFT JOIN wk USING (label)""")
def _(s):
    own = s.fact.groupBy("product_id").agg(F.count("*").alias("rows"))
    rows = raw_spelled(own, s).groupBy(F.col("raw_item").alias("name")).agg(F.sum("rows").alias("rows"))
    typo = rows.withColumn("name", F.when(F.length("name") % 5 == 0, F.concat("name", F.lit("s"))).otherwise(F.col("name")))
    return E.name_clusters(typo.groupBy("name").agg(F.sum("rows").alias("rows")))


@plan("er_name_review", "raw_item:s first_day:D last_day:D rows:l units:l supplier_id:l latest_price:d2", _RAWN + """,
u AS (SELECT * FROM rawn WHERE trim(raw_item) NOT IN (SELECT raw_name FROM vocab)), m AS (SELECT raw_item, supplier_id, row_number() OVER (PARTITION BY raw_item ORDER BY c DESC, supplier_id) AS r FROM (SELECT raw_item, supplier_id, count(*) AS c FROM u GROUP BY ALL))
SELECT u.raw_item, min(day) AS first_day, max(day) AS last_day, count(*) AS rows, sum(quantity_sold) AS units, any_value(m.supplier_id) AS supplier_id, arg_max(amount, (day, order_id, line_no, amount)) AS latest_price FROM u JOIN m ON m.raw_item = u.raw_item AND r = 1 GROUP BY u.raw_item""")
def _(s):
    v = vocabulary(s)
    u = raw_named(s).join(v, F.trim("raw_item") == v["raw_name"], "left_anti")
    g = u.groupBy("raw_item").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("rows"), F.sum("quantity_sold").alias("units"),
                                  F.max_by("amount", F.struct("day", "order_id", "line_no", "amount")).alias("latest_price"))
    return g.join(A.modal_value(u, "raw_item", "supplier_id"), "raw_item")


@plan("er_review_queue", "name:s source:s held_rows:l sheet_rows:l", _RAW.rstrip() + "," + _RAWN[5:] + """,
a AS (SELECT raw_item AS name, count(*) AS held_rows FROM judged WHERE reason = 'item_no_match_in_dim_product' GROUP BY 1), b AS (SELECT trim(raw_item) AS name, count(*) AS sheet_rows FROM rawn WHERE trim(raw_item) NOT IN (SELECT raw_name FROM vocab) GROUP BY 1)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'sheet' WHEN b.name IS NULL THEN 'import' ELSE 'both' END AS source, coalesce(held_rows, 0) AS held_rows, coalesce(sheet_rows, 0) AS sheet_rows FROM a FULL JOIN b ON a.name = b.name""")
def _(s):
    held = judged_rows(s).filter(F.col("reason") == "item_no_match_in_dim_product").groupBy(F.col("raw_item").alias("name")).agg(F.count("*").alias("held_rows"))
    v = vocabulary(s)
    sheet = raw_named(s).groupBy(F.trim("raw_item").alias("name")).agg(F.count("*").alias("sheet_rows")).join(v, F.col("name") == v["raw_name"], "left_anti")
    source = F.when(F.col("held_rows").isNull(), "sheet").when(F.col("sheet_rows").isNull(), "import").otherwise("both")
    return held.join(sheet, "name", "full").withColumn("source", source).fillna(0, ["held_rows", "sheet_rows"])


@plan("er_stable_ids", "item_name:s product_id:l is_new:l", """
WITH o AS (SELECT item_name, product_id FROM product WHERE product_id % 5 <> 0), t AS (SELECT max(product_id) AS m FROM o)
SELECT item_name, product_id, 0 AS is_new FROM o UNION ALL SELECT item_name, m + row_number() OVER (ORDER BY item_name), 1 FROM product, t WHERE product_id % 5 = 0""")
def _(s):
    return E.stable_ids(s.product.select("item_name"), s.product.filter(F.col("product_id") % 5 != 0).select("item_name", "product_id"))


CL_SQL = """WITH d AS (SELECT product_id, day, sum(quantity_sold) AS q FROM sale GROUP BY ALL), nn AS (SELECT date_diff('day', min(day), max(CASE WHEN q > 0 THEN day END)) + 1 AS n FROM d), mp AS (SELECT median(unit_price_php) AS m FROM product)
"""


def features(s):
    """Behaviour features per item; days without a row count as zero days."""
    d = s.sale.groupBy("product_id", "day").agg(F.sum("quantity_sold").alias("q"))
    n = d.agg(F.datediff(F.max(F.when(F.col("q") > 0, F.col("day"))), F.min("day")) + 1).scalar()
    nz = F.when(F.col("q") > 0, F.col("q"))
    med = exact_quantiles(s.product, "unit_price_php", [0.5]).select(F.col("q")[0]).scalar()
    g = d.groupBy("product_id").agg(F.count(nz).alias("k"), F.avg(nz).alias("m"), F.stddev_pop(nz).alias("sd"), F.sum("q").alias("total"))
    return g.join(s.product, "product_id").select(
        "product_id", (F.col("k") / n).alias("density"), F.coalesce("m", F.lit(0.0)).alias("mean_nz"),
        F.when((F.col("k") > 1) & (F.col("m") > 0), F.col("sd") / F.col("m")).otherwise(0.0).alias("cv_nz"), F.log1p("total").alias("log_total"),
        F.log(F.coalesce("unit_price_php", med)).alias("log_price"))


@plan("cl_features", "product_id:l density:d6 mean_nz:d6 cv_nz:d6 log_total:d6 log_price:d6", CL_SQL + """
SELECT product_id, count(*) FILTER (q > 0) / any_value(n) AS density, coalesce(avg(q) FILTER (q > 0), 0) AS mean_nz, CASE WHEN count(*) FILTER (q > 0) > 1 THEN (stddev_pop(q) FILTER (q > 0)) / (avg(q) FILTER (q > 0)) ELSE 0 END AS cv_nz, ln(1 + sum(q)) AS log_total, ln(coalesce(any_value(unit_price_php), any_value(m))) AS log_price FROM d JOIN product USING (product_id), nn, mp GROUP BY 1""")
def _(s):
    return features(s)


FEATURES = ["density", "mean_nz", "cv_nz", "log_total", "log_price"]


def kmeans(df, k, seed=0, reference=None):
    """Labels, centres in units, and silhouette; labels are kept stable by
    matching centres to ``reference`` centres (mutual best, at most k rows)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    x = VectorAssembler(inputCols=FEATURES, outputCol="raw").transform(df)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(x)
    x = scaler.transform(x)
    model = KMeans(k=k, seed=seed, maxIter=40).fit(x)
    out = model.transform(x)
    centres = [[c * s + m for c, s, m in zip(v, scaler.std, scaler.mean)] for v in model.clusterCenters()]
    label = match_centres(centres, reference) if reference else {i: i for i in range(k)}
    sil = ClusteringEvaluator(predictionCol="prediction", featuresCol="features").evaluate(out)
    mapped = F.element_at(F.create_map(*[F.lit(v) for kv in label.items() for v in kv]), F.col("prediction"))
    return out.withColumn("cluster", mapped).drop("raw", "features", "prediction"), [centres[i] for i in sorted(label, key=label.get)], sil


def match_centres(centres, reference):
    """One-to-one labels by repeatedly taking the closest free pair."""
    free = sorted((sum((a - b) ** 2 for a, b in zip(c, r)), i, j) for i, c in enumerate(centres) for j, r in enumerate(reference))
    out, used = {}, set()
    for _, i, j in free:
        if i not in out and j not in used:
            out[i] = j
            used.add(j)
    return out


@plan("cl_kmeans", "cluster:l items:l mean_density:d4 mean_units:d3 silhouette:d4")
def _(s):
    df = cut_lineage(features(s), "features")
    first, centres, _ = kmeans(df, 4)
    again, _, sil = kmeans(df, 4, seed=1, reference=centres)
    return again.groupBy("cluster").agg(F.count("*").alias("items"), F.avg("density").alias("mean_density"), F.avg("mean_nz").alias("mean_units")).withColumn("silhouette", F.lit(sil))


@plan("cl_profile_name", "profile:s items:l", """
WITH d AS (SELECT product_id, day, sum(quantity_sold) AS q FROM sale GROUP BY ALL HAVING sum(quantity_sold) > 0),
r AS (SELECT d.*, demand_kind AS k, row_number() OVER (PARTITION BY product_id ORDER BY q DESC) AS j, count(*) OVER (PARTITION BY product_id) AS n FROM d JOIN kinds USING (day)),
f AS (SELECT product_id, avg(q) AS m, coalesce(stddev_samp(q), 0) / avg(q) AS cv, sum(CASE WHEN j <= greatest(1, ceil(0.1 * n)) THEN q END) / sum(q) AS p90, least(5, greatest(0, coalesce(avg(q) FILTER (k = 'break') / coalesce(avg(q) FILTER (k NOT IN ('break', 'exam')), avg(q)), 1))) AS br,
 least(5, greatest(0, coalesce(avg(q) FILTER (k = 'exam') / coalesce(avg(q) FILTER (k NOT IN ('break', 'exam')), avg(q)), 1))) AS ex FROM r GROUP BY 1)
SELECT CASE WHEN m >= 8 THEN 'fast' WHEN m >= 2.5 THEN 'steady' ELSE 'slow' END || '-' || CASE WHEN cv >= 1.3 OR p90 >= 0.55 THEN 'bursty' ELSE 'even' END || '-' || CASE WHEN coalesce(unit_price_php, 0) >= 700 THEN 'premium' WHEN coalesce(unit_price_php, 0) >= 200 THEN 'mid' ELSE 'budget' END ||
 CASE WHEN br >= 2 THEN '-breakpeak' WHEN ex >= 2 THEN '-exampeak' WHEN br <= 0.75 THEN '-termonly' ELSE '' END AS profile, count(*) AS items FROM f JOIN product USING (product_id) GROUP BY 1""")
def _(s):
    from tallyloom.plans.aggregates import concentration

    f = concentration(s).join(s.product, "product_id").withColumn("cv", F.coalesce(F.col("sd") / F.col("mean_units"), F.lit(0.0)))
    return f.groupBy(profile_name().alias("profile")).agg(F.count("*").alias("items"))


def profile_name():
    price = F.coalesce("unit_price_php", F.lit(0.0))
    return F.concat(
        F.when(F.col("mean_units") >= 8, "fast").when(F.col("mean_units") >= 2.5, "steady").otherwise("slow"), F.lit("-"),
        F.when((F.col("cv") >= 1.3) | (F.col("p90_share") >= 0.55), "bursty").otherwise("even"), F.lit("-"),
        F.when(price >= 700, "premium").when(price >= 200, "mid").otherwise("budget"),
        F.when(F.col("break_ratio") >= 2, "-breakpeak").when(F.col("exam_ratio") >= 2, "-exampeak").when(F.col("break_ratio") <= 0.75, "-termonly").otherwise(""))


@plan("dq_iso_dates", "shape:s rows:l", _RAW + """
SELECT CASE WHEN NOT regexp_full_match(raw_date, '\\d{4}-\\d{2}-\\d{2}') THEN 'bad_shape' WHEN try_cast(raw_date AS DATE) IS NULL THEN 'impossible' ELSE 'ok' END AS shape, count(*) AS rows FROM raw GROUP BY 1""")
def _(s):
    from tallyloom.plans.sources import raw_rows

    d = F.col("raw_date")
    shape = F.when(~d.rlike(r"^\d{4}-\d{2}-\d{2}$"), "bad_shape").when(T.strict_date(d).isNull(), "impossible").otherwise("ok")
    return raw_rows(s).groupBy(shape.alias("shape")).agg(F.count("*").alias("rows"))


@plan("dq_ranges", "check:s bad:l total:l", """
SELECT 'delivered_before_ordered' AS check, count(*) FILTER (delivered_on < ordered_on) AS bad, count(*) AS total FROM restock_log
UNION ALL SELECT 'sold_before_listed', count(*) FILTER (day < entry_date), count(*) FROM fact JOIN product USING (product_id)""")
def _(s):
    a = s.restock_log.agg(F.count(F.when(F.col("delivered_on") < F.col("ordered_on"), 1)).alias("bad"), F.count("*").alias("total"))
    b = s.fact.join(s.product, "product_id").agg(F.count(F.when(F.col("day") < F.col("entry_date"), 1)).alias("bad"), F.count("*").alias("total"))
    return a.withColumn("check", F.lit("delivered_before_ordered")).unionByName(b.withColumn("check", F.lit("sold_before_listed")))


@plan("dq_conservation", "stage:s units:d0 negatives:l", """
SELECT 'fact' AS stage, sum(quantity_sold) AS units, count(*) FILTER (quantity_sold < 0) AS negatives FROM walkin UNION ALL SELECT 'series', sum(qty), count(*) FILTER (qty < 0) FROM series UNION ALL SELECT 'category', sum(qty), count(*) FILTER (qty < 0) FROM category_series""")
def _(s):
    def line(name, df, col):
        return df.agg(F.sum(col).cast("double").alias("units"), F.count(F.when(F.col(col) < 0, 1)).alias("negatives")).withColumn("stage", F.lit(name))

    return line("fact", s.walkin, "quantity_sold").unionByName(line("series", s.series, "qty")).unionByName(line("category", s.category_series, "qty"))


@plan("dq_invariants", "check:s actual:l", f"""
SELECT 'fact_rows' AS check, count(*) AS actual FROM fact UNION ALL SELECT 'orphan_items', count(*) FROM fact WHERE product_id NOT IN (SELECT product_id FROM product) UNION ALL SELECT 'orphan_days', count(*) FROM fact WHERE day NOT IN (SELECT day FROM calendar)
UNION ALL SELECT 'span_days', date_diff('day', first_day, last_day) + 1 FROM span UNION ALL SELECT 'class_' || fsn_class, count(*) FROM ({FSN_SQL}) GROUP BY fsn_class""")
def _(s):
    from tallyloom.operators.classify import fsn_classify

    def one(name, df):
        return df.select(F.lit(name).alias("check"), F.col("actual").cast("long").alias("actual"))

    n = F.count("*").alias("actual")
    orphan = s.fact.groupBy("product_id").agg(F.count("*").alias("c")).join(s.product, "product_id", "left_anti").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("actual"))
    days = s.fact.groupBy("day").agg(F.count("*").alias("c")).join(F.broadcast(s.calendar), "day", "left_anti").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("actual"))
    out = one("fact_rows", s.fact.agg(n)).unionByName(one("orphan_items", orphan)).unionByName(one("orphan_days", days))
    out = out.unionByName(one("span_days", s.span.select((F.datediff("last_day", "first_day") + 1).alias("actual"))))
    cls = fsn_classify(s.product, s.sale).groupBy("fsn_class").agg(n)
    return out.unionByName(cls.select(F.concat(F.lit("class_"), "fsn_class").alias("check"), "actual"))


@plan("dq_gates", "check:s actual:d4 expected:d4 ok:l", PP.PRE + """,
g AS (SELECT count(*) FILTER (rate IS NOT NULL) AS priced, count(*) FILTER (rate IS NULL) AS flagged, count(*) AS n, count(*) FILTER (rate IS NULL AND safety_stock IS NOT NULL) AS lied, count(*) FILTER (rate * L + safety_stock < safety_stock - 1e-9) AS low FROM pre)
SELECT 'rows' AS check, priced * 2 + flagged AS actual, priced * 2 + flagged AS expected, 1 AS ok FROM g UNION ALL SELECT 'cost_not_minimal', 0, 0, 1 UNION ALL SELECT 'half_cost_ratio', 1.25, 1.25, 1 UNION ALL SELECT 'double_cost_ratio', 1.25, 1.25, 1
UNION ALL SELECT 'rop_below_buffer', low, 0, CASE WHEN low = 0 THEN 1 ELSE 0 END FROM g UNION ALL SELECT 'flagged_with_values', lied, 0, CASE WHEN lied = 0 THEN 1 ELSE 0 END FROM g UNION ALL SELECT 'priced_share', priced / n, 0.5, CASE WHEN priced / n >= 0.5 THEN 1 ELSE 0 END FROM g""")
def gates(s, table=None):
    """Gates over the stock table; a broken table must fail them."""
    t = PP.prescription(s) if table is None else table
    priced = F.col("rate").isNotNull()
    g = t.agg(
        F.count("*").alias("rows"), F.countDistinct(F.when(priced, F.col("product_id"))).alias("priced"), F.count(F.when(~priced, 1)).alias("flagged"),
        F.count(F.when((F.col("cost_at_eoq") >= F.col("cost_at_half")) | (F.col("cost_at_eoq") >= F.col("cost_at_double")), 1)).alias("notmin"),
        F.avg(F.col("cost_at_half") / F.col("cost_at_eoq")).alias("half"), F.avg(F.col("cost_at_double") / F.col("cost_at_eoq")).alias("double"),
        F.count(F.when(F.col("reorder_point") < F.col("safety_stock") - 1e-9, 1)).alias("low"),
        F.count(F.when(~priced & (F.col("safety_stock").isNotNull() | F.col("eoq").isNotNull()), 1)).alias("lied"))
    c = {n: F.col(n) for n in g.columns}
    share = c["priced"] / (c["priced"] + c["flagged"])

    def gate(name, actual, expected, ok=None):
        a, e = actual.cast("double"), expected.cast("double")
        return F.struct(F.lit(name).alias("check"), a.alias("actual"), e.alias("expected"), F.coalesce(ok if ok is not None else F.abs(a - e) < 5e-5, F.lit(False)).cast("int").alias("ok"))

    zero = F.lit(0)
    return g.select(F.inline(F.array(
        gate("rows", c["rows"], c["priced"] * 2 + c["flagged"]), gate("cost_not_minimal", c["notmin"], zero), gate("half_cost_ratio", c["half"], F.lit(1.25)),
        gate("double_cost_ratio", c["double"], F.lit(1.25)), gate("rop_below_buffer", c["low"], zero), gate("flagged_with_values", c["lied"], zero),
        gate("priced_share", share, F.lit(0.5), share >= 0.5))))


@plan("dq_validate_entry", "errors:s rows:l", _RAW + """,
e AS (SELECT concat_ws('|', CASE WHEN p.product_id IS NULL THEN 'Select an item.' END, CASE WHEN try_cast(raw_qty AS DOUBLE) IS NULL THEN 'Quantity must be a number.' WHEN try_cast(raw_qty AS DOUBLE) <= 0 THEN 'Quantity must be greater than zero.' END,
 CASE WHEN NOT regexp_full_match(raw_date, '\\d{4}-\\d{2}-\\d{2}') OR try_cast(raw_date AS DATE) IS NULL THEN 'Date must be YYYY-MM-DD.' END) AS errors FROM raw LEFT JOIN product p ON p.item_name = raw_item)
SELECT errors, count(*) AS rows FROM e GROUP BY 1""")
def _(s):
    from tallyloom.plans.sources import raw_rows

    names = s.product.select(F.col("item_name").alias("raw_item"), "product_id")
    j = raw_rows(s).join(names, "raw_item", "left")
    q = F.col("raw_qty").try_cast("double")
    errors = F.array_compact(F.array(
        F.when(F.col("product_id").isNull(), "Select an item."),
        F.when(q.isNull(), "Quantity must be a number.").when(q != F.floor(q), "Quantity must be a whole number.").when(q <= 0, "Quantity must be greater than zero."),
        F.when(T.strict_date(F.col("raw_date")).isNull(), "Date must be YYYY-MM-DD.")))
    return j.groupBy(F.array_join(errors, "|").alias("errors")).agg(F.count("*").alias("rows"))


@plan("dq_price_suffix_audit", "product_id:l suffix:d2 has_twin:l units:l", """
WITH n AS (SELECT product_id, CASE WHEN product_id % 4 = 0 THEN base_name || ' @' || (product_id % 300 + 50) ELSE base_name END AS name, product_id % 300 + 50 AS sfx FROM product),
b AS (SELECT DISTINCT name FROM n WHERE product_id % 4 <> 0), u AS (SELECT product_id, sum(quantity_sold) AS u FROM sale GROUP BY 1)
SELECT n.product_id, sfx AS suffix, CASE WHEN b.name IS NULL THEN 0 ELSE 1 END AS has_twin, coalesce(u, 0) AS units FROM n LEFT JOIN b ON b.name = regexp_replace(n.name, '\\s*@.*', '') LEFT JOIN u USING (product_id) WHERE n.product_id % 4 = 0""")
def _(s):
    k = F.col("product_id")
    n = s.product.select("product_id", F.when(k % 4 == 0, F.concat("base_name", F.lit(" @"), k % 300 + 50)).otherwise(F.col("base_name")).alias("name"))
    n = n.withColumn("suffix", T.price_suffix(F.col("name")))
    twins = n.filter("suffix IS NULL").select(F.col("name").alias("base")).distinct().withColumn("twin", F.lit(1))
    u = s.sale.groupBy("product_id").agg(F.sum("quantity_sold").alias("u"))
    a = n.filter("suffix IS NOT NULL").withColumn("base", T.without_price_suffix(F.col("name")))
    return a.join(twins, "base", "left").join(u, "product_id", "left").select(
        "product_id", "suffix", F.coalesce("twin", F.lit(0)).alias("has_twin"), F.coalesce("u", F.lit(0)).alias("units"))


# --------------------------------------------------------- splits and fills
@plan("split_largest_remainder", "product_id:l day:D variant:l allocated:l", """
WITH g AS (SELECT product_id, day, sum(quantity_sold) AS q FROM sale GROUP BY ALL), m AS (SELECT *, unnest(range(1, 5)) AS variant FROM g), w AS (SELECT *, (product_id * variant + day(day)) % 7 AS wt FROM m),
r AS (SELECT *, CASE WHEN sum(wt) OVER p > 0 THEN q * wt / sum(wt) OVER p ELSE q / 4 END AS raw FROM w WINDOW p AS (PARTITION BY product_id, day)),
f AS (SELECT *, floor(raw) AS fl, q - sum(floor(raw)) OVER (PARTITION BY product_id, day) AS l FROM r)
SELECT product_id, day, variant, fl + CASE WHEN row_number() OVER (PARTITION BY product_id, day ORDER BY raw - fl DESC, variant) <= l THEN 1 ELSE 0 END AS allocated FROM f""")
def _(s):
    g = s.sale.groupBy("product_id", "day").agg(F.sum("quantity_sold").alias("q"))
    # the windows run in these partitions, on four times the rows
    v = spread(g, "product_id").withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("w", (F.col("product_id") * F.col("variant") + F.dayofmonth("day")) % 7)
    return M.split_largest_remainder(v, ["product_id", "day"], "q", "w", "variant")


@plan("split_batch_to_days", "sku:s month:D day:D allocated:l", """
WITH b AS (SELECT sku, CAST(date_trunc('month', day) AS DATE) AS month, CAST(sum(qty) AS BIGINT) AS q FROM sku_day GROUP BY ALL),
dw AS (SELECT isodow(day) AS dow, avg(u) / (SELECT avg(u) FROM (SELECT sum(qty) AS u FROM sku_day GROUP BY day)) AS w FROM (SELECT day, sum(qty) AS u FROM sku_day GROUP BY 1) GROUP BY 1),
d AS (SELECT c.day, CAST(date_trunc('month', c.day) AS DATE) AS month, dw.w FROM calendar c JOIN dw ON dw.dow = isodow(c.day) WHERE is_store_closed = 0),
x AS (SELECT b.sku, b.month, day, q, q * w / sum(w) OVER (PARTITION BY b.sku, b.month) AS raw FROM b JOIN d USING (month)),
f AS (SELECT *, floor(raw) AS fl, q - sum(floor(raw)) OVER (PARTITION BY sku, month) AS l FROM x)
SELECT sku, month, day, fl + CASE WHEN row_number() OVER (PARTITION BY sku, month ORDER BY round(raw - fl, 9) DESC, day) <= l THEN 1 ELSE 0 END AS allocated FROM f""")
def _(s):
    month = F.trunc("day", "month")
    b = s.sku_day.groupBy("sku", month.alias("month")).agg(F.sum("qty").cast("long").alias("q"))
    day_units = s.sku_day.groupBy("day").agg(F.sum("qty").alias("u"))
    overall = day_units.agg(F.avg("u")).scalar()
    w = day_units.groupBy(F.weekday("day").alias("dow")).agg((F.avg("u") / overall).alias("w"))
    d = s.calendar.filter("is_store_closed = 0").select("day", month.alias("month"), F.weekday("day").alias("dow")).join(F.broadcast(w), "dow")
    rows = b.join(F.broadcast(d), "month")
    return M.split_largest_remainder(rows, ["sku", "month"], "q", "w", "day", places=9)


@plan("synth_stratified", "day:D source_day:D level:s units:d0", """
WITH r AS (SELECT k.*, u FROM kinds k JOIN (SELECT day, sum(quantity_sold) AS u FROM sale GROUP BY 1) USING (day) WHERE is_store_closed = 0 AND day(day) % 5 <> 0),
t AS (SELECT day, month(day) AS m, isodow(day) AS w, demand_kind AS k, date_diff('day', DATE '1990-01-01', day) * 7919 + 13 AS h FROM kinds, span WHERE day(day) % 5 = 0 AND is_store_closed = 0 AND day BETWEEN first_day AND last_day),
l1 AS (SELECT month(day) AS m, isodow(day) AS w, demand_kind AS k, list_sort(list(day)) AS ds FROM r GROUP BY ALL HAVING count(*) >= 3), l2 AS (SELECT isodow(day) AS w, demand_kind AS k, list_sort(list(day)) AS ds FROM r GROUP BY ALL HAVING count(*) >= 3), l3 AS (SELECT isodow(day) AS w, list_sort(list(day)) AS ds FROM r GROUP BY 1),
p AS (SELECT t.day, h, coalesce(l1.ds, l2.ds, l3.ds) AS ds, CASE WHEN l1.ds IS NOT NULL THEN 'month+weekday+kind' WHEN l2.ds IS NOT NULL THEN 'weekday+kind' ELSE 'weekday' END AS level FROM t LEFT JOIN l1 USING (m, w, k) LEFT JOIN l2 ON l2.w = t.w AND l2.k = t.k LEFT JOIN l3 ON l3.w = t.w)
SELECT p.day, ds[h % len(ds) + 1] AS source_day, level, u AS units FROM p JOIN r ON r.day = ds[h % len(ds) + 1]""")
def _(s):
    from tallyloom.functions.calendar import demand_kind

    u = s.sale.groupBy("day").agg(F.sum("quantity_sold").cast("double").alias("units"))
    missing = F.dayofmonth("day") % 5 == 0
    cal = s.calendar.filter("is_store_closed = 0").select("day", F.month("day").alias("m"), F.weekday("day").alias("w"), demand_kind().alias("k"))
    real = cal.filter(~missing).join(u, "day")
    span = s.span.select(F.struct("first_day", "last_day")).scalar()
    gaps = cal.filter(missing).withColumn("__s", span).filter(F.col("day").between(F.col("__s.first_day"), F.col("__s.last_day"))).drop("__s")
    return stratified_fill(gaps, real)


def stratified_fill(gaps, real, min_bucket=3, seed=13):
    """Fill a missing day with a real day from the finest bucket that has
    enough; the draw is a fixed function of the date. Buckets hold days, so
    they are bounded by the calendar."""
    days = F.sort_array(F.collect_list("day"))
    ladder = ((["m", "w", "k"], "month+weekday+kind", min_bucket), (["w", "k"], "weekday+kind", min_bucket), (["w"], "weekday", 1))
    g, pool, level = gaps, [], None
    for i, (keys, name, least) in enumerate(ladder):
        b = real.groupBy(*keys).agg(days.alias(f"d{i}")).filter(F.size(f"d{i}") >= least)
        g = g.join(F.broadcast(b), keys, "left")
        pool.append(F.col(f"d{i}"))
        level = F.when(F.col(f"d{i}").isNotNull(), name) if level is None else level.when(F.col(f"d{i}").isNotNull(), name)
    chosen = F.coalesce(*pool)
    h = F.datediff("day", F.lit("1990-01-01").cast("date")) * 7919 + seed
    g = g.select("day", F.get(chosen, h % F.size(chosen)).alias("source_day"), level.alias("level"))
    return g.join(F.broadcast(real.select(F.col("day").alias("source_day"), "units")), "source_day")
