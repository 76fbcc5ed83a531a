"""Stock policy: rates, buffers, service tiers, reorder points.

Everything runs on sale days plus the length of the history; the daily grid is
never built. A sale row finds the folds it belongs to by arithmetic, so hot
items are pre-aggregated to (item, day) and then to at most a dozen folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import eoq, half_even, total_cost
from tallyloom.operators.quantiles import exact_quantiles
from tallyloom.operators.scale import cut_lineage, spread

WINDOW, MIN_SALE_DAYS, MAX_FOLDS, MIN_FOLDS, MIN_TRAIN = 365, 10, 12, 3, 60
TIER_QUANTILES = (0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 0.98, 0.99)
TARGET, MIN_EFFICIENCY, MAX_Q, DEFAULT_Q = 0.90, 0.10, 0.95, 0.80
Z_BY_CLASS = {"F": 1.65, "S": 1.04}
HOLDING = 0.25 * 210_000.0 / 36_051.0
ORDERING = {"low_admin_cost": 1250.0, "high_goods_value": 200_000.0}
REVIEW_DAYS = 30


def rates(days: DataFrame, n: Column, observed: Column, labels: DataFrame | None = None, window: int = WINDOW) -> DataFrame:
    """Trailing rate per observed day and where it comes from.

    ``labels`` (product_id, cluster) turns on shrinking of thin items towards
    the median rate of the other live members of their cluster.
    """
    inside = F.col("pos") >= n - window
    g = days.groupBy("product_id").agg(
        F.sum(F.when(inside, F.col("qty")).otherwise(0.0)).alias("units"),
        F.count(F.when(inside & (F.col("qty") > 0), 1)).alias("sale_days"))
    g = g.withColumn("own_rate", F.col("units") / observed)
    if labels is None:
        return g.withColumn("rate", F.when(F.col("units") > 0, F.col("own_rate"))).withColumn(
            "rate_source", F.when(F.col("units") > 0, "observed").otherwise("insufficient_data"))
    pooled = leave_one_out_median(g.join(labels, "product_id"), "cluster", "product_id", "own_rate")
    j = g.join(labels, "product_id", "left").join(pooled, "product_id", "left")
    thin = (F.col("units") > 0) & (F.col("sale_days") < MIN_SALE_DAYS) & F.col("others_median").isNotNull()
    w = F.col("sale_days") / MIN_SALE_DAYS
    return j.withColumn("rate", F.when(thin, w * F.col("own_rate") + (1 - w) * F.col("others_median"))
                        .when(F.col("units") > 0, F.col("own_rate"))).withColumn(
        "rate_source", F.when(thin, "cluster_pooled").when(F.col("units") > 0, "observed").otherwise("insufficient_data"))


def leave_one_out_median(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """Median of the other positive members of each row's group.

    Removing one member only shifts the middle by a place, so the answer is
    one of a few order statistics around it. Ranks come from the blocked
    running rank; no member list is collected and no pairs are formed.
    """
    from tallyloom.operators.scale import ranked_running

    live = df.filter(F.col(value) > 0).select(group, key, F.col(value).alias("v"))
    r = ranked_running(live.withColumn("one", F.lit(1)), "v", [key], [group], "one").withColumn(
        "r", F.col("group_rows") - F.col("rank_no"))  # 0-based ascending rank
    m = F.col("group_rows")
    lo, hi = F.floor((m - 2) / 2), F.floor((m - 1) / 2)  # middle ranks among m - 1 values
    mid = r.filter(F.col("r").between(lo, hi + 1)).groupBy(group).agg(
        F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("at"), F.first("group_rows").alias("m"))
    base = df.select(group, key).join(r.select(key, "r"), key, "left").join(F.broadcast(mid), group, "left")

    def pick(rank):  # the rank-th of the others: skip own place
        return F.try_element_at("at", rank + F.when(F.col("r") <= rank, 1).otherwise(0))

    mm = F.col("m")
    out = (pick(F.floor((mm - 2) / 2)) + pick(F.floor((mm - 1) / 2))) / 2
    whole = F.when(F.col("r").isNull(), (F.try_element_at("at", F.floor((mm - 1) / 2)) + F.try_element_at("at", F.floor(mm / 2))) / 2)
    return base.select(key, F.when(F.col("r").isNull(), whole).when(mm > 1, out).alias("others_median"))


def fold_errors(days: DataFrame, items: DataFrame, n: Column, observed: DataFrame, window: int = WINDOW,
                upto: Column | None = None, copies: Column | None = None, qty: Column | None = None) -> DataFrame:
    """Actual minus predicted over each item's lead time, per fold.

    ``items``: product_id, lead_time_days. ``observed``: pos, seen (running
    count of observed days before pos), one row per calendar day. ``copies``, an array, gives one result for each
    of its values, named ``copy``, on which ``upto`` and ``qty`` (the units used instead) may depend: an item's days are
    copied where they have met the item, and all folds of a copy are summed in one row, so copies don't move.
    """
    end = n if upto is None else upto
    keys = ["product_id"] if copies is None else ["product_id", "copy"]
    L = F.col("lead_time_days")
    kept = F.when(end - L >= MIN_TRAIN, F.least(F.floor((end - L - MIN_TRAIN) / L) + 1, F.lit(MAX_FOLDS))).otherwise(0)

    def kept_items(df):
        df = df if copies is None else df.withColumn("copy", F.explode(copies))
        return df.withColumn("end", end).withColumn("kept", kept).filter(F.col("kept") >= MIN_FOLDS)

    it = kept_items(items)
    # merged, not broadcast: Spark sizes copies as if they were the items alone
    d = kept_items(days.join(items.hint("merge") if copies is not None else items, "product_id")).filter(F.col("pos") < F.col("end"))
    back = F.floor((F.col("end") - 1 - F.col("pos")) / L)
    test = F.when(back < F.col("kept"), (F.col("kept") - 1 - back).cast("int"))
    # folds whose training window holds the day: origin - window <= pos < origin
    left = F.col("end") - F.col("pos")
    lo = F.greatest(F.col("kept") - F.ceil(left / L) + 1, F.lit(0)).cast("int")
    hi = F.least(F.col("kept") - 1, F.col("kept") - F.ceil((left - window) / L)).cast("int")
    rows = d.select(*keys, test.alias("test"), lo.alias("lo"), hi.alias("hi"), (F.col("qty") if qty is None else qty).alias("qty"))
    rows = rows.filter(F.col("test").isNotNull() | (F.col("lo") <= F.col("hi")))
    sums = rows.groupBy(*keys).agg(
        F.array(*[F.sum(F.when(F.col("test") == f, F.col("qty"))) for f in range(MAX_FOLDS)]).alias("actuals"),
        F.array(*[F.sum(F.when(F.lit(f).between(F.col("lo"), F.col("hi")), F.col("qty"))) for f in range(MAX_FOLDS)]).alias("trained"))
    if copies is None:
        f = it.join(sums, "product_id", "left")
    else:  # a second equality would be a key of the join and move both sides; this one only picks among an item's copies
        sums = sums.hint("merge").select(F.col("product_id").alias("__p"), F.col("copy").alias("__c"), "actuals", "trained")
        f = it.join(sums, (it["product_id"] == sums["__p"]) & (it["copy"] - sums["__c"] == 0), "left")
    f = f.withColumn("fold", F.explode(F.sequence(F.lit(0), (F.col("kept") - 1).cast("int"))))
    f = f.withColumns({name: F.coalesce(F.get(c, F.col("fold")), F.lit(0.0)) for name, c in (("actual", "actuals"), ("train_units", "trained"))})
    f = f.withColumn("origin", (F.col("end") - L * (F.col("kept") - F.col("fold"))).cast("int"))
    o = F.broadcast(observed.select(F.col("pos").alias("origin"), F.col("seen").alias("s1")))
    o0 = F.broadcast(observed.select((F.col("pos") + window).alias("origin"), F.col("seen").alias("s0")))
    f = f.join(o, "origin", "left").join(o0, "origin", "left")
    n_obs = F.coalesce("s1", F.lit(0)) - F.coalesce("s0", F.lit(0))
    rate = F.col("train_units") / F.when(n_obs > 0, n_obs).otherwise(window)
    return f.select(*keys, "lead_time_days", "fold", "origin", "actual", (rate * L).alias("pred"),
                    (F.col("actual") - rate * L).alias("error"))


def buffers(errors: DataFrame, q: float = DEFAULT_Q) -> DataFrame:
    return errors.groupBy("product_id").agg(F.greatest(F.percentile("error", q), F.lit(0.0)).alias("buffer"), F.count("*").alias("folds"))


def tier_curve(errors: DataFrame, quantiles=TIER_QUANTILES) -> DataFrame:
    """Served, held and demand per quantile; each fold's buffer comes from the
    item's earlier folds only. No rows for an item without demand. The window,
    the sums over its tenfold rows and the windows of ``service_tier`` run in the
    partitions of one exchange."""
    prior = Window.partitionBy("product_id").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    qs = F.array(*[F.lit(q) for q in quantiles])
    e = spread(errors, "product_id").withColumn("b", F.percentile("error", list(quantiles)).over(prior))
    zeros = F.array(*[F.lit(0.0) for _ in quantiles])
    e = e.withColumn("g", F.explode(F.arrays_zip(qs.alias("q"), F.coalesce("b", zeros).alias("b"))))
    c = F.greatest(F.col("pred") + F.greatest(F.col("g.b"), F.lit(0.0)), F.lit(0.0))
    g = e.withColumn("c", c).groupBy("product_id", F.col("g.q").alias("q")).agg(
        F.sum(F.least("actual", "c")).alias("served"), F.sum(F.greatest(F.col("c") - F.col("actual"), F.lit(0.0))).alias("held"),
        F.sum("actual").alias("demand"))
    return g.filter("demand > 0").withColumn("fill", F.col("served") / F.col("demand")).withColumn(
        "efficiency", F.when(F.col("held") > 0, F.col("served") / F.col("held")))


def service_tier(curve: DataFrame, items: DataFrame) -> DataFrame:
    """servable / partial / not_stockable and the quantile each settles at.

    An efficiency of NULL stands for nothing held (unbounded).
    """
    w = Window.partitionBy("product_id").orderBy("q")
    # a step of rounding noise is no step
    d_s, d_h = (F.round(F.col(c) - F.lag(c).over(w), 9) for c in ("served", "held"))
    stop = F.lag("q").over(w).isNotNull() & ((F.col("q") > MAX_Q) | ((d_h > 0) & (d_s / d_h < MIN_EFFICIENCY)))
    # windows and the grouping share one partitioning by item
    whole = Window.partitionBy("product_id")
    c = curve.withColumn("stop", stop).withColumn("q_stop", F.min(F.when(F.col("stop"), F.col("q"))).over(whole))
    g = c.groupBy("product_id").agg(
        F.max("fill").alias("best_fill"), F.min(F.when((F.col("q") <= MAX_Q) & (F.col("fill") >= TARGET), F.col("q"))).alias("q_serv"),
        F.max("efficiency").alias("best_eff"), F.count(F.when(F.col("efficiency").isNull(), 1)).alias("free"),
        F.max(F.when(F.col("q_stop").isNull() | (F.col("q") < F.col("q_stop")), F.col("q"))).alias("q_walk"))
    t = items.select("product_id").join(g, "product_id", "left")
    dead = (F.col("free") == 0) & (F.col("best_eff") < MIN_EFFICIENCY)
    return t.select(
        "product_id", "best_fill",
        F.when(F.col("q_serv").isNotNull(), "servable").when(F.coalesce(dead, F.lit(False)), "not_stockable").otherwise("partial").alias("tier"),
        F.when(F.col("best_fill").isNull(), DEFAULT_Q).when(F.col("q_serv").isNotNull(), F.col("q_serv"))
        .when(F.coalesce(dead, F.lit(False)), F.lit(None)).otherwise(F.col("q_walk")).alias("q"))


def committed(errors: DataFrame, tiers: DataFrame) -> DataFrame:
    """Buffer at each item's own quantile; none for a not-stockable item."""
    values = errors.groupBy("product_id").agg(F.sort_array(F.collect_list("error")).alias("e"))  # at most 12
    from tallyloom.functions.numbers import quantile_of

    j = tiers.join(values, "product_id", "left")
    return j.select("product_id", "tier", "q", "best_fill", F.when(F.col("tier") == "not_stockable", 0.0).when(
        F.col("e").isNotNull(), F.greatest(quantile_of(F.col("e"), F.col("q")), F.lit(0.0))).alias("buffer"),
        F.when(F.col("tier") == "not_stockable", "not_stocked").when(F.col("e").isNotNull(), "empirical")
        .otherwise("normal_fallback").alias("buffer_source"))


def publish(policy: DataFrame, last_day: Column) -> DataFrame:
    """One row per day of lead time; a flagged item is one all-NULL row."""
    L = F.col("lead_time_days")
    days = F.when(F.col("rate").isNotNull(), F.sequence(F.lit(1), L)).otherwise(F.array(F.lit(1)))
    p = policy.withColumn("k", F.explode(days))
    band = F.col("buffer") / L
    return p.select("product_id", F.date_add(last_day, F.col("k")).alias("forecast_date"), F.col("rate").alias("yhat"),
                    F.when(F.col("rate").isNotNull(), F.greatest(F.col("rate") - band, F.lit(0.0))).alias("yhat_lower"),
                    F.when(F.col("rate").isNotNull(), F.col("rate") + band).alias("yhat_upper"), "rate_source")


def prescribe(policy: DataFrame, sigma: DataFrame) -> DataFrame:
    """Reorder points, order quantities and their costs per scenario.

    ``policy``: product_id, fsn_class, lead_time_days, rate, buffer,
    buffer_source; ``sigma``: product_id, sigma_obs, sale_days_all.
    """
    j = policy.join(sigma, "product_id", "left")
    usable = (F.col("sale_days_all") >= MIN_SALE_DAYS) & (F.col("sigma_obs") > 0) & F.col("rate").isNotNull()
    j = cut_lineage(j, "spread-of-demand")
    cv = exact_quantiles(j.filter(usable).withColumn("__cv", F.col("sigma_obs") / F.col("rate")), "__cv", [0.5], ["fsn_class"]).select("fsn_class", F.col("q")[0].alias("cv_median"))
    j = j.join(F.broadcast(cv), "fsn_class", "left")
    s = F.when(usable, F.col("sigma_obs")).otherwise(F.col("rate") * F.coalesce("cv_median", F.lit(1.0)))
    z = F.when(F.col("fsn_class") == "F", Z_BY_CLASS["F"]).otherwise(Z_BY_CLASS["S"])
    L = F.col("lead_time_days")
    j = j.withColumn("sigma", s).withColumn("sigma_source", F.when(F.col("rate").isNull(), "insufficient_data").when(usable, "observed").otherwise("cv_fallback"))
    j = j.withColumn("ss_normal", z * F.col("sigma") * F.sqrt(L))
    ss = F.when(F.col("buffer_source") == "normal_fallback", F.col("ss_normal")).otherwise(F.col("buffer"))
    j = j.withColumn("safety_stock", F.when(F.col("rate").isNotNull(), ss))
    j = j.withColumn("reorder_point", F.col("rate") * L + F.col("safety_stock"))
    scen = F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(v).alias("ordering_cost")) for k, v in ORDERING.items()])
    flagged = F.array(F.struct(F.lit("not_priced").alias("scenario"), F.lit(0.0).alias("ordering_cost")))
    j = j.withColumn("s", F.explode(F.when(F.col("rate").isNotNull(), scen).otherwise(flagged)))
    annual, S, H = F.col("rate") * 365.0, F.col("s.ordering_cost"), F.lit(HOLDING)
    q = F.when(F.col("rate").isNotNull(), eoq(annual, S, H))
    return j.select("product_id", "fsn_class", "lead_time_days", F.col("s.scenario").alias("scenario"), S.alias("ordering_cost"), "rate",
                    annual.alias("annual_demand"), "sigma", "sigma_source", "ss_normal", "safety_stock", "reorder_point", q.alias("eoq"),
                    total_cost(annual, S, H, q).alias("cost_at_eoq"), total_cost(annual, S, H, q / 2).alias("cost_at_half"),
                    total_cost(annual, S, H, q * 2).alias("cost_at_double"), "buffer_source")


def reorder_status(items: DataFrame, stock: DataFrame) -> DataFrame:
    """Cover, reorder flags and the suggested order. Flagged items stay NULL."""
    j = items.join(stock, "product_id", "left")
    st, rop, rate = F.col("current_stock"), F.col("reorder_point"), F.col("rate")
    ok = rop.isNotNull()
    needs = F.when(ok, F.coalesce(st <= rop, F.lit(False)))
    target = rop + REVIEW_DAYS * rate
    order = F.greatest(F.lit(0.0), half_even(target - st))
    least = F.greatest(F.lit(0.0), half_even(target - F.col("safety_stock") - st))
    return j.withColumn("days_cover", F.when(ok & (rate > 0), half_even(st / rate, 1))).withColumn("needs_reorder", needs.cast("int")).withColumn(
        "approaching", F.when(ok, F.coalesce((st > rop) & (st <= rop * 1.2), F.lit(False))).cast("int")).withColumn(
        "order_up_to", half_even(target, 1)).withColumn("order_qty", F.when(ok, F.when(needs, order).otherwise(0))).withColumn(
        "order_min", F.when(ok, F.when(needs, F.least(order, least)).otherwise(0)))


def apply_settings(items: DataFrame, settings: DataFrame) -> DataFrame:
    """Saved lead times and buffers override; a changed lead time rescales the
    buffer by its square root when no buffer was saved."""
    j = items.join(settings, "product_id", "left")
    lt = F.coalesce("set_lead_time", "lead_time_days")
    ss = F.coalesce(F.col("set_safety_stock"), F.col("safety_stock") * F.sqrt(lt / F.col("lead_time_days")))
    return j.withColumn("safety_stock", ss).withColumn("lead_time_days", lt).withColumn(
        "reorder_point", F.col("rate") * F.col("lead_time_days") + F.col("safety_stock")).drop("set_lead_time", "set_safety_stock")


def holdout_blocks(days: DataFrame, commitments: DataFrame, split: Column, horizon: Column) -> DataFrame:
    """Served, short and held per lead-time block after the split.

    ``commitments``: product_id, lead_time_days, committed, plus label columns.
    Blocks without sales are kept: every item spans horizon // L blocks.
    """
    L = F.col("lead_time_days")
    b = F.floor((F.col("pos") - split) / L)
    sold = (days.filter((F.col("pos") >= split) & (F.col("pos") < split + horizon)).join(commitments.select("product_id", "lead_time_days").distinct(), "product_id")
            .withColumn("block", b).groupBy("product_id", "block").agg(F.sum("qty").alias("actual")))
    n_blocks = F.floor(horizon / L).cast("int")
    grid = commitments.withColumn("nb", n_blocks).filter("nb > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb").cast("long") - 1)))
    r = grid.join(sold, ["product_id", "block"], "left").fillna(0.0, ["actual"])
    c, a = F.col("committed"), F.col("actual")
    return r.withColumn("served", F.least(a, c)).withColumn("short", F.greatest(a - c, F.lit(0.0))).withColumn("held", F.greatest(c - a, F.lit(0.0)))


def summarise_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    d, s, h = F.sum("actual"), F.sum("served"), F.sum("held")
    return blocks.groupBy(*keys).agg(F.countDistinct("product_id").alias("n_skus"), F.count("*").alias("n_blocks"), d.alias("demand"),
                                     F.when(d > 0, s / d).alias("fill_rate"), F.sum("short").alias("short"), h.alias("held"),
                                     F.when(h > 0, s / h).alias("served_per_held"))


def allocate_budget(curve: DataFrame, budget: Column) -> DataFrame:
    """Buy quantile steps by served-per-held until the budget is reached.

    Each item's steps are made non-increasing in ratio (running minimum), so
    taking all steps in one global ratio order equals the greedy choice. The
    order runs through the blocked running sum, not through one task.
    """
    from tallyloom.operators.scale import ranked_running

    w = Window.partitionBy("product_id").orderBy("q")
    d_h, d_s = F.col("held") - F.lag("held").over(w), F.col("served") - F.lag("served").over(w)
    c = curve.withColumn("dh", d_h).withColumn("ds", d_s).withColumn("step", F.row_number().over(w) - 1)
    bad = F.max(F.when((F.col("step") > 0) & (F.col("ds") <= 0), 1)).over(w)
    c = c.withColumn("bad", bad)
    start = c.filter("step = 0")
    raw = F.when(F.col("dh") > 0, F.col("ds") / F.col("dh")).otherwise(1e12)
    steps = c.filter("step > 0 AND bad IS NULL").withColumn("raw", raw)
    steps = steps.withColumn("ratio", F.min("raw").over(w)).withColumn("cost", F.greatest("dh", F.lit(0.0)))
    base = start.agg(F.sum("held")).scalar()
    run = ranked_running(steps.select("product_id", "step", "q", "ratio", "cost"), "ratio", ["product_id", "step"], None, "cost")
    over = run.withColumn("spent", F.col("running") + base).withColumn("budget", budget)
    stop = over.filter("spent > budget").agg(F.min("rank_no")).scalar()
    bought = over.filter(F.col("rank_no") < F.coalesce(stop, F.lit(1 << 60)))
    best = bought.groupBy("product_id").agg(F.max("q").alias("q_bought"))
    return start.select("product_id", F.col("q").alias("q0")).join(best, "product_id", "left").select(
        "product_id", F.coalesce("q_bought", "q0").alias("q"))
