"""Speed classes and the decision rules built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numbers import half_even

from tallyloom.operators.aggregates import fsn_base, product_stats
from tallyloom.operators.quantiles import exact_quantiles
from tallyloom.operators.scale import cut_lineage, spread

THRESHOLDS = (0.75, 0.80, 0.85)
STALE_DAYS = 90
HVL_MIN_DATES = 30
REVIEW_THRESHOLD = 0.1


def fsn_classify(products: DataFrame, sale: DataFrame, stale_days: int = STALE_DAYS) -> DataFrame:
    """Fast / Slow / Non-moving per item.

    The cutoffs are exact interpolated percentiles over items with rows. An
    item at or above the 80th is fast unless its last sale is ``stale_days``
    old when anything was last sold.
    """
    base = cut_lineage(fsn_base(sale).withColumn("adus", F.when(
        F.col("active_tally_dates") > 0, F.col("weighted_units") / F.col("active_tally_dates")).otherwise(0.0)), "speed")
    cut = exact_quantiles(base.filter("active_tally_dates > 0"), "adus", list(THRESHOLDS)).select("q").scalar()
    ref = base.agg(F.max("last_sold")).scalar()
    df = products.join(base, "product_id", "left").withColumn("__c", cut)
    gap = F.datediff(ref, "last_sold")
    stale = F.col("last_sold").isNull() | (gap >= stale_days)
    moving = F.coalesce("units", F.lit(0)) > 0

    def label(i: int) -> Column:
        return F.when((F.col("adus") >= F.get("__c", F.lit(i))) & ~stale, "F").otherwise("S")

    main = F.when(moving, label(1)).otherwise("N")
    return df.select(
        *products.columns,
        F.coalesce("active_tally_dates", F.lit(0)).alias("active_tally_dates"),
        F.coalesce("adus", F.lit(0.0)).alias("adus"),
        main.alias("fsn_class"),
        ((main == "F") & (F.col("active_tally_dates") < HVL_MIN_DATES)).cast("int").alias("is_hvl"),
        (moving & ((label(0) != label(1)) | (label(1) != label(2)))).cast("int").alias("borderline"))


def fsn_sensitivity(products: DataFrame, stats: DataFrame, thresholds=(75, 80, 85)) -> DataFrame:
    """Class counts per cutoff; no recency rule here, N means no active date."""
    moving = cut_lineage(stats.filter("active_tally_dates > 0").select("product_id", "adus"), "moving")
    cuts = exact_quantiles(moving, "adus", [t / 100 for t in thresholds]).select(F.col("q").alias("c"), F.col("n").alias("n_moving"))
    labelled = cuts.select("n_moving", F.posexplode("c").alias("i", "cutoff"))
    n_products = products.agg(F.count("*")).scalar()
    cut_array = cuts.select("c").scalar()
    hits = moving.withColumn("__c", cut_array).select(
        F.posexplode(F.transform("__c", lambda c: (F.col("adus") >= c).cast("int"))).alias("i", "fast"))
    fast = hits.groupBy("i").agg(F.sum("fast").alias("F"))
    return labelled.join(fast, "i").select(
        F.element_at(F.array(*[F.lit(t) for t in thresholds]), F.col("i") + 1).alias("threshold"), "F",
        (F.col("n_moving") - F.col("F")).alias("S"), (n_products - F.col("n_moving")).alias("N"),
        half_even(F.col("cutoff"), 4).alias("cutoff"))


def fsn_as_of(sale: DataFrame, origins: DataFrame, rules: dict[str, int], horizon: int = 30) -> DataFrame:
    """Rebuild the fast list at each past month for each recency rule.

    ``origins`` holds a few month starts as one array column ``os``. An item's
    day is sent to the origins after it (history) or to the one whose next
    ``horizon`` days hold it; everything is then grouped by (origin, item), in
    the partitions that hold the items' days.
    """
    os = origins.select("os").scalar()
    kept = ~F.col("is_censored").eqNullSafe(1)
    w = F.when(F.col("imputation_flag") == 1, 0.5).otherwise(1.0) * F.col("quantity_sold")
    per_day = sale.groupBy("product_id", "day").agg(
        F.sum(F.when(kept, w)).alias("wu"), F.sum(F.when(kept, F.col("quantity_sold"))).alias("units"), F.max(kept).alias("kept"),
        F.max(F.col("quantity_sold") > 0).alias("sold"), F.sum("quantity_sold").alias("q"))
    rows = spread(per_day, "product_id").withColumn("__o", os).withColumn("origin", F.explode(F.filter(
        "__o", lambda o: F.col("day") < F.date_add(o, horizon)))).drop("__o")
    hist = F.col("day") < F.col("origin")
    g = rows.groupBy("origin", "product_id").agg(
        F.sum(F.when(hist, F.col("wu"))).alias("wu"), F.sum(F.when(hist, F.col("units"))).alias("units"),
        F.count(F.when(hist & F.col("kept"), 1)).alias("days"),
        F.max(F.when(hist & F.col("sold"), F.col("day"))).alias("last_sold"),
        F.sum(F.when(~hist, F.col("q")).otherwise(0)).alias("ahead"))
    g = cut_lineage(g.withColumn("adus", F.when(F.col("days") > 0, F.coalesce("wu", F.lit(0.0)) / F.col("days"))), "as-of")
    cuts = exact_quantiles(g, "adus", [0.8], ["origin"]).select("origin", F.col("q")[0].alias("cut"))
    per_origin = g.groupBy("origin").agg(F.max("last_sold").alias("ref"), F.sum("ahead").alias("total_ahead")).join(cuts, "origin", "left")
    rule_rows = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(v).alias("stale")) for k, v in rules.items()]))
    j = g.join(F.broadcast(per_origin), "origin").withColumn("r", rule_rows)
    fast = (F.col("units") > 0) & (F.col("adus") >= F.col("cut")) & (F.datediff("ref", "last_sold") < F.col("r.stale"))
    return j.groupBy("origin", F.col("r.rule").alias("rule")).agg(
        F.sum(fast.cast("int")).alias("fast"),
        F.sum((fast & (F.col("ahead") <= 0)).cast("int")).alias("dead"),
        (F.sum(F.when(fast, F.col("ahead")).otherwise(0)) / F.first("total_ahead")).alias("coverage"))


def fold_speed(series: DataFrame, fold_rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Speed class from data before each origin only.

    ``fold_rows`` has sku, fold, units, sale_days before the origin.
    """
    adus = fold_rows.withColumn("adus", F.when(F.col("sale_days") > 0, F.col("units") / F.col("sale_days"))).withColumn("__all", F.coalesce("adus", F.lit(0.0)))
    adus = cut_lineage(adus.select("sku", "fold", "adus", "__all"), "fold-speed")
    cut = exact_quantiles(adus, "__all", [threshold], ["fold"]).select("fold", F.col("q")[0].alias("cut_all")).join(
        exact_quantiles(adus, "adus", [threshold], ["fold"]).select("fold", F.col("q")[0].alias("cut_moving")), "fold", "left")
    j = adus.join(F.broadcast(cut), "fold")
    return j.select(
        "sku", "fold", "adus",
        F.when(F.coalesce("adus", F.lit(0.0)) >= F.col("cut_all"), "fast").otherwise("slow").alias("speed"),
        F.when(F.col("adus").isNull(), "nonmoving").when(F.col("adus") >= F.col("cut_moving"), "fast")
        .otherwise("slow").alias("speed3"))


def review_terms(calendar: DataFrame, last_day: Column, n: int = 2) -> DataFrame:
    """The last ``n`` regular terms that ended by the last recorded day."""
    terms = calendar.filter(F.col("semester_id").rlike("-T[12]$")).groupBy("semester_id").agg(
        F.min("day").alias("term_start"), F.max("day").alias("term_end"))
    return terms.filter(F.col("term_end") <= last_day).orderBy(F.desc("term_start")).limit(n)


def term_velocity(sale: DataFrame, terms: DataFrame) -> DataFrame:
    days = terms.select("semester_id", F.explode(F.sequence("term_start", "term_end")).alias("day"))
    s = product_stats(sale.join(F.broadcast(days), "day"), ["product_id", "semester_id"])
    active = F.col("observed_days") - F.col("censored_days")
    return s.select("product_id", "semester_id", F.col("total_units").alias("units"), active.alias("active_days"),
                    F.when(active > 0, half_even(F.col("weighted_units") / active, 4)).otherwise(0.0).alias("adus"))


def decision_rules(classes: DataFrame, sale: DataFrame, calendar: DataFrame, threshold: float = REVIEW_THRESHOLD,
                   n: int = 2) -> DataFrame:
    """keep / promote / review / clear out / discontinued per item."""
    last_day = sale.agg(F.max("day")).scalar()
    terms = review_terms(calendar, last_day, n)
    term_list = terms.agg(F.collect_list(F.struct("semester_id", "term_start"))).scalar()
    velocity = term_velocity(sale, terms)
    seen = sale.groupBy("product_id").agg(F.min("day").alias("first_day"))
    readings = (classes.select("product_id", "fsn_class", "discontinued").withColumn("__t", term_list)
                .withColumn("t", F.explode_outer("__t")).drop("__t")
                .withColumn("semester_id", F.col("t.semester_id"))
                .join(velocity, ["product_id", "semester_id"], "left").join(seen, "product_id", "left"))
    on_sheet = F.coalesce(F.col("active_days") > 0, F.lit(False))
    measurable = on_sheet | F.coalesce(F.col("first_day") < F.col("t.term_start"), F.lit(False))
    slow = measurable & (F.when(on_sheet, F.col("adus")).otherwise(0.0) < threshold)
    g = readings.groupBy("product_id", "fsn_class", "discontinued").agg(
        F.sum((F.col("semester_id").isNotNull() & slow).cast("int")).alias("n_slow"),
        F.sum(on_sheet.cast("int")).alias("terms_on_sheet"))
    action = (F.when(F.col("discontinued") == 1, "discontinued").when(F.col("fsn_class") == "F", "keep_stocked")
              .when(F.col("fsn_class") == "N", "clear_out")
              .when(F.col("fsn_class") == "S", F.when(F.col("n_slow") >= n, "review_discontinuation").otherwise("promote")))
    return g.select("product_id", "fsn_class", "terms_on_sheet", action.alias("action"))
