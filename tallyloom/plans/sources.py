"""Scans, sheet cleaning and sinks, bound to the star."""

from pyspark.sql import functions as F

from tallyloom.operators.scale import work_dir
from tallyloom.plans.registry import plan
from tallyloom.sources import readers as R


@plan("scan_star", "product_id:l day:D quantity_sold:l",
      "SELECT product_id, day, quantity_sold FROM fact")
def scan_star(s):
    return s.fact.select("product_id", "day", "quantity_sold")


@plan("scan_csv_strict", "product_id:l quantity:l amount:d2 bad_rows:l",
      """SELECT product_id, sum(quantity_sold) AS quantity, sum(amount) AS amount,
       count(*) FILTER (line_no = 5) AS bad_rows FROM
       (SELECT product_id, line_no, amount, CASE WHEN line_no = 5 THEN NULL ELSE quantity_sold END AS quantity_sold FROM fact) GROUP BY 1""")
def scan_csv_strict(s):
    path = work_dir(s.spark, "tally-csv")
    s.fact.select(F.col("product_id").alias("item"), F.when(F.col("line_no") == 5, "n/a").otherwise(F.col("quantity_sold").cast("string")).alias("qty"), "amount").write.option("header", True).csv(path)
    fields = R.read_csv_strict(s.spark, path, ["item", "qty", "amount"])
    qty = F.col("qty").try_cast("long")
    return fields.groupBy(F.col("item").try_cast("long").alias("product_id")).agg(
        F.sum(qty).alias("quantity"), F.sum(F.col("amount").try_cast("double")).alias("amount"),
        F.sum(F.when(qty.isNull(), 1).otherwise(0)).alias("bad_rows"))


@plan("normalize_headers", "item:s qty:l",
      """SELECT coalesce(nullif(trim(CASE WHEN product_id % 3 = 0 THEN ' ' ELSE item_name END), ''), base_name) AS item,
       sum(quantity_sold) AS qty FROM fact JOIN product USING (product_id) GROUP BY 1""")
def normalize_headers(s):
    # one row per item: a hot item joins once
    totals = s.fact.groupBy("product_id").agg(F.sum("quantity_sold").alias("units"))
    messy = totals.join(s.product, "product_id").select(
        F.when(F.col("product_id") % 3 == 0, " ").otherwise(F.col("item_name")).alias("Item  Name"),
        F.col("base_name").alias("DESCRIPTION."), F.col("units").alias("Total_QTY"))
    clean = R.normalize_headers(messy, {"item": ["item name", "description"], "qty": ["quantity", "total qty"]})
    return clean.groupBy("item").agg(F.sum(F.col("qty").try_cast("long")).alias("qty"))


@plan("unpivot_wide_tally", "sku:s month:s day_no:l qty:d0",
      """SELECT sku, strftime(day, '%Y-%m') AS month, day(day) AS day_no, sum(qty) AS qty FROM sku_day GROUP BY ALL""")
def unpivot_wide_tally(s):
    labels = [str(d) for d in range(1, 32)]
    wide = (s.sku_day.withColumn("dom", F.dayofmonth("day").cast("string"))
            .groupBy("sku", F.date_format("day", "yyyy-MM").alias("month")).pivot("dom", labels).agg(F.sum("qty")))
    long = R.unpivot_tally(wide, ["sku", "month"], labels)
    return long.withColumn("day_no", F.col("date_label").cast("int"))


_SHEET = """WITH sheet AS (
 SELECT category, brand AS label, NULL AS product_id, product_order FROM (
   SELECT category, brand, min(product_id) * 2 AS product_order FROM product GROUP BY ALL)
 UNION ALL SELECT category, item_name, product_id, product_id * 2 + 1 FROM product)
"""


@plan("section_carry_forward", "category:s item_name:s section:s",
      _SHEET + """SELECT category, label AS item_name, section FROM (SELECT *, last_value(CASE WHEN product_id IS NULL THEN label END IGNORE NULLS)
      OVER (PARTITION BY category ORDER BY product_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM sheet) WHERE product_id IS NOT NULL""")
def section_carry_forward(s):
    bands = s.product.groupBy("category", "brand").agg(F.min("product_id").alias("product_id")).select(
        "category", F.col("brand").alias("label"), F.lit(None).cast("long").alias("units"),
        (F.col("product_id") * 2).alias("row_no"))
    items = s.product.select("category", F.col("item_name").alias("label"), F.col("product_id").alias("units"),
                             (F.col("product_id") * 2 + 1).alias("row_no"))
    out = R.carry_section(bands.unionByName(items), "category", "row_no", "label", F.col("units").isNotNull())
    return out.withColumnRenamed("label", "item_name")


_CELLS = """WITH cells AS (SELECT brand, strftime(day, '%Y-%m') AS month, p.category AS item, day, sum(quantity_sold) AS qty
 FROM walkin JOIN product p USING (product_id) GROUP BY ALL),
dens AS (SELECT brand, month, count(DISTINCT day) / day(last_day(max(day))) AS density FROM cells GROUP BY ALL)
"""


def _cells(s):
    return s.walkin.join(s.product, "product_id").groupBy(
        "brand", F.date_format("day", "yyyy-MM").alias("month"), F.col("category").alias("item"), "day").agg(
        F.sum("quantity_sold").alias("qty"))


@plan("density_zero_fill", "brand:s month:s item:s day:D qty:l",
      _CELLS + """SELECT brand, month, item, day, coalesce(qty, 0) AS qty FROM (
       SELECT i.brand, i.month, i.item, d.day FROM (SELECT DISTINCT brand, month, item FROM cells) i
       JOIN (SELECT DISTINCT brand, month, day FROM cells) d USING (brand, month) JOIN dens USING (brand, month) WHERE density >= 0.7
       UNION SELECT brand, month, item, day FROM cells) g LEFT JOIN cells USING (brand, month, item, day)""")
def density_zero_fill(s):
    return R.zero_fill_dense(_cells(s), ["brand", "month"], "item")


@plan("drop_untallied_tail", "month:s day:D qty:l",
      """WITH m AS (SELECT strftime(day, '%Y-%m') AS month, day, CASE WHEN day > last_day - 2 THEN NULL ELSE quantity_sold END AS q FROM fact, span),
x AS (SELECT month, day, sum(q) AS qty FROM m GROUP BY ALL)
SELECT * FROM x WHERE month < (SELECT max(month) FROM x) OR day <= coalesce((SELECT max(day) FROM x WHERE qty IS NOT NULL AND month = (SELECT max(month) FROM x)), DATE '9999-01-01')""")
def drop_untallied_tail(s):
    last = s.span.select("last_day").scalar()
    cells = s.fact.withColumn("q", F.when(F.col("day") <= F.date_sub(last, 2), F.col("quantity_sold"))).groupBy(
        F.date_format("day", "yyyy-MM").alias("month"), "day").agg(F.sum("q").alias("qty"))
    return R.drop_untallied_tail(cells, "month", "day", "qty")


@plan("newest_file_wins", "month:s path:s n_files:l units:l",
      """WITH f AS (SELECT strftime(day, '%Y-%m') AS month, 'book' || supplier_id % 7 AS path, quantity_sold, day FROM fact),
stamp AS (SELECT path, max(day) AS modified FROM f GROUP BY 1),
own AS (SELECT month, arg_max(path, (modified, path)) AS path, count(DISTINCT path) AS n_files FROM (SELECT DISTINCT month, path FROM f) JOIN stamp USING (path) GROUP BY 1)
SELECT month, path, n_files, sum(quantity_sold) AS units FROM f JOIN own USING (month, path) GROUP BY ALL""")
def newest_file_wins(s):
    f = s.fact.select(F.date_format("day", "yyyy-MM").alias("month"), "day", "quantity_sold",
                      F.concat(F.lit("book"), F.col("supplier_id") % 7).alias("path"))
    stamp = f.groupBy("path").agg(F.max("day").alias("modified"))
    found = f.groupBy("month", "path").agg(F.sum("quantity_sold").alias("units")).join(stamp, "path")
    owner = R.newest_file_wins(found, "month", "path", "modified")
    return found.join(owner, ["month", "path"])


@plan("impute_missing_date", "brand:s month:s col_no:l filled_date:D",
      """WITH c AS (SELECT *, row_number() OVER (PARTITION BY brand, month ORDER BY day) AS col_no FROM (SELECT DISTINCT brand, strftime(day, '%Y-%m') AS month, day FROM walkin JOIN product USING (product_id))),
h AS (SELECT brand, month, col_no, CASE WHEN day(day) % 7 <> 3 THEN day END AS d FROM c),
a AS (SELECT brand, month, min(d) AS first, quantile_cont(day(d), 0.5) AS med FROM h GROUP BY ALL),
n AS (SELECT h.*, first, med, last_value(day(d) IGNORE NULLS) OVER (PARTITION BY brand, month ORDER BY col_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
 first_value(day(d) IGNORE NULLS) OVER (PARTITION BY brand, month ORDER BY col_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM h JOIN a USING (brand, month))
SELECT brand, month, col_no, coalesce(d, CAST(date_trunc('month', first) AS DATE) + CAST(least(greatest(floor(coalesce((l + r) / 2.0, med) + 0.5), 1), day(last_day(first))) - 1 AS INT)) AS filled_date FROM n""")
def impute_missing_date(s):
    from pyspark.sql import Window

    # a recorded item day is one row before it meets its brand
    cols = s.walkin.select("product_id", "day").distinct().join(s.product, "product_id").select(
        "brand", F.date_format("day", "yyyy-MM").alias("month"), "day").distinct()
    # a month sheet has at most 31 columns
    cols = cols.withColumn("col_no", F.row_number().over(Window.partitionBy("brand", "month").orderBy("day")))
    cols = cols.withColumn("day", F.when(F.dayofmonth("day") % 7 != 3, F.col("day")))
    return R.impute_dates(cols, ["brand", "month"], "col_no", "day")


_RAW = """WITH raw AS (SELECT CASE WHEN line_no = 5 THEN 'n/a' WHEN line_no = 3 THEN '-4' ELSE quantity_sold::VARCHAR END AS raw_qty,
  CASE WHEN order_id % 50 = 1 THEN s_name WHEN order_id % 50 = 2 THEN 'mystery ' || product_id ELSE item_name END AS raw_item,
  CASE WHEN order_id % 50 = 3 THEN strftime(day, '%d/%m/%Y') ELSE strftime(day, '%Y-%m-%d') END AS raw_date
  FROM fact JOIN product p USING (product_id) JOIN supplier ON s_suppkey = fact.supplier_id),
judged AS (SELECT raw.*, p.product_id, CASE WHEN try_cast(raw_qty AS BIGINT) IS NULL OR try_cast(raw_qty AS BIGINT) < 0 THEN 'invalid_or_missing_quantity'
  WHEN lower(raw_item) IN (SELECT lower(s_name) FROM supplier) THEN 'item_name_is_supplier_name'
  WHEN p.product_id IS NULL THEN 'item_no_match_in_dim_product'
  WHEN try_strptime(raw_date, '%Y-%m-%d') IS NULL THEN 'date_no_match_in_dim_date' END AS reason
  FROM raw LEFT JOIN product p ON p.item_name = raw_item)
"""


def raw_rows(s):
    o = F.col("order_id") % 50
    sup = s.table("supplier").select(F.col("s_suppkey").alias("supplier_id"), "s_name")
    return s.fact.join(s.product, "product_id").join(sup, "supplier_id").select(
        F.when(F.col("line_no") == 5, "n/a").when(F.col("line_no") == 3, "-4")
        .otherwise(F.col("quantity_sold").cast("string")).alias("raw_qty"),
        F.when(o == 1, F.col("s_name")).when(o == 2, F.concat(F.lit("mystery "), "product_id"))
        .otherwise(F.col("item_name")).alias("raw_item"),
        F.when(o == 3, F.date_format("day", "dd/MM/yyyy")).otherwise(F.date_format("day", "yyyy-MM-dd")).alias("raw_date"))


def judged_rows(s):
    from tallyloom.functions.text import strict_date

    names = s.product.select(F.col("item_name").alias("raw_item"), "product_id")
    sup = s.table("supplier").select(F.lower("s_name").alias("folded")).distinct().withColumn("is_supplier", F.lit(True))
    qty, day = F.col("raw_qty").try_cast("long"), strict_date(F.col("raw_date"))
    return (raw_rows(s).join(names, "raw_item", "left").withColumn("folded", F.lower("raw_item")).join(sup, "folded", "left")
            .withColumn("quantity", qty).withColumn("day", day)
            .withColumn("reason", R.load_reason(qty, F.col("raw_item"), F.coalesce("is_supplier", F.lit(False)),
                                                F.col("product_id"), F.col("day"))))


@plan("quarantine_sink", "reason:s raw_item:s raw_qty:s raw_date:s rows_held:l",
      _RAW + """SELECT coalesce(reason, 'loaded') AS reason, raw_item, raw_qty, raw_date, count(*) AS rows_held FROM judged GROUP BY ALL""")
def quarantine_sink(s):
    path = work_dir(s.spark, "tally-load")
    R.write_with_quarantine(judged_rows(s).select("raw_item", "raw_qty", "raw_date", "reason"), path)
    return s.spark.read.parquet(path).groupBy(F.coalesce("reason", "sink").alias("reason"), "raw_item", "raw_qty", "raw_date").agg(F.count("*").alias("rows_held"))


@plan("held_rows", "raw_item:s released:l rows_held:l",
      _RAW + """SELECT raw_item, CASE WHEN CAST(regexp_extract(raw_item, '(\\d+)', 1) AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END AS released, count(*) AS rows_held
      FROM judged WHERE reason = 'item_no_match_in_dim_product' GROUP BY ALL""")
def held_rows(s):
    # half of the unknown names have been mapped since: their rows are released
    rows = judged_rows(s).filter(F.col("reason") == "item_no_match_in_dim_product").select("raw_item")
    mapped = s.product.filter(F.col("product_id") % 2 == 0).select(
        F.concat(F.lit("mystery "), "product_id").alias("raw_item"), F.lit(1).alias("released"))
    return rows.groupBy("raw_item").agg(F.count("*").alias("rows_held")).join(mapped, "raw_item", "left").withColumn(
        "released", F.coalesce("released", F.lit(0)))


@plan("replace_partition_sink", "scope:s model:s sku:s score:d4",
      """SELECT 'item' AS scope, 'old' AS model, sku, sum(qty) AS score FROM sku_day GROUP BY sku
      UNION ALL SELECT 'item', 'new', sku, avg(qty) * 2 FROM sku_day GROUP BY sku""")
def replace_partition_sink(s):
    path = work_dir(s.spark, "scores")
    per_sku = s.sku_day.groupBy("sku")
    first = per_sku.agg(F.sum("qty").alias("score")).select(F.lit("item").alias("scope"), F.lit("old").alias("model"), "sku", "score")
    stale = per_sku.agg(F.avg("qty").alias("score")).select(F.lit("item").alias("scope"), F.lit("new").alias("model"), "sku", "score")
    R.replace_partitions(first.unionByName(stale), path, ["scope", "model"])
    R.replace_partitions(stale.withColumn("score", F.col("score") * 2), path, ["scope", "model"])
    return s.spark.read.parquet(path)


@plan("export_csv", "supplier:s item:s units:l line_total:d2 row_kind:l",
      """SELECT CASE WHEN g1 = 1 THEN 'GRAND TOTAL' WHEN g2 = 1 THEN 'SUBTOTAL - ' || sup ELSE sup END AS supplier,
      CASE WHEN it LIKE '=%' THEN '''' || it ELSE it END AS item, units, line_total, g1 + g2 AS row_kind
      FROM (SELECT sup, it, grouping(sup) AS g1, grouping(it) AS g2, sum(quantity_sold) AS units, sum(quantity_sold * unit_price_php) AS line_total
      FROM (SELECT coalesce(supplier_name, 'Unattributed') AS sup, CASE WHEN product_id % 9 = 0 THEN '=' || item_name ELSE item_name END AS it, quantity_sold, unit_price_php
       FROM sale JOIN product_full USING (product_id)) GROUP BY ROLLUP (sup, it))""")
def export_csv(s):
    from tallyloom.plans.reports import supplier_lines

    lines = supplier_lines(s.sale, s.product_full.withColumn("item_name", F.when(
        F.col("product_id") % 9 == 0, F.concat(F.lit("="), "item_name")).otherwise(F.col("item_name"))))
    path = work_dir(s.spark, "report-csv")
    R.write_csv_report(lines.select("supplier", "item", "units", "line_total", "row_kind"), path)
    return s.spark.read.schema("supplier string, item string, units long, line_total double, row_kind int").option("header", True).csv(path)
