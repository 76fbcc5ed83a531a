"""Forecast methods.

A *level* method is an aggregate over the training rows of a (series, fold)
that gives the expected units per day. Any number of them is evaluated in one
aggregation. Methods whose days differ return one row per day ahead.

Training rows come from :func:`tallyloom.operators.backtest.training_rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.backtest import FoldPlan
from tallyloom.operators.scale import spread

DAY_TYPES = ("enrol", "break", "exam", "normal")


def _tail(window: int, value: str = "qty") -> Column:
    return F.when(F.col("age") < window, F.col(value))


def _decay(rate: float, exponent: Column) -> Column:
    return F.pow(F.lit(1.0 - rate), exponent)


# ------------------------------------------------------------ level methods
def naive() -> Column:
    return F.max_by("qty", "pos")


def rolling_mean(window: int) -> Column:
    return F.avg(_tail(window))


def rolling_quantile(window: int, q: float = 0.5) -> Column:
    return F.percentile(_tail(window), q)


def ewma(alpha: float) -> Column:
    """Smoothed level started at the first value, in closed form."""
    first = F.col("age") == F.col("n_train") - 1
    weight = F.when(first, 1.0).otherwise(alpha) * _decay(alpha, F.col("age"))
    return F.sum(weight * F.col("qty"))


def _smoothed(value: Column, alpha: float, init: str) -> Column:
    """Exponential smoothing over sale days only.

    Weights are taken relative to the series' last sale and rescaled to the
    fold's own last sale, so no per-fold pass over the rows is needed.
    """
    sale = F.col("qty") > 0
    k_end = F.max(F.when(sale, F.col("k_pos")))
    k_first = F.min(F.when(sale, F.col("k_pos")))
    after = F.col("k_all") - F.col("k_pos")
    rescale = _decay(alpha, -(F.max("k_all") - k_end))
    k = k_end - k_first + 1
    body = F.sum(F.when(sale, alpha * _decay(alpha, after) * value)) * rescale
    if init == "mean":
        return body + _decay(alpha, k) * F.avg(F.when(sale, value))
    start = F.min_by(value, F.when(sale, F.col("pos")))
    return body + (1.0 - alpha) * _decay(alpha, k - 1) * start


def croston(alpha: float = 0.1, init: str = "mean", sba: bool = False) -> Column:
    size = _smoothed(F.col("qty"), alpha, init)
    gap = _smoothed((F.col("pos") - F.coalesce("prev_pos", F.lit(-1))).cast("double"), alpha, init)
    return F.coalesce(size / gap * (1.0 - alpha / 2.0 if sba else 1.0), F.lit(0.0))


def tsb(alpha: float | Column = 0.1, beta: float | Column = 0.1) -> Column:
    """Sale probability decays every day, size changes on sale days only."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    b = F.lit(beta) if isinstance(beta, float) else beta
    sale = F.col("qty") > 0
    k, n = F.count(F.when(sale, 1)), F.max("n_train")
    k_end = F.max(F.when(sale, F.col("k_pos")))
    after = F.col("k_all") - F.col("k_pos")
    size = (F.sum(F.when(sale, a * F.pow(1 - a, after) * F.col("qty"))) * F.pow(1 - F.max(a), -(F.max("k_all") - k_end))
            + F.pow(1 - F.max(a), k) * F.avg(F.when(sale, F.col("qty"))))
    p = F.sum(F.when(sale, b * F.pow(1 - b, F.col("age")))) + F.pow(1 - F.max(b), n) * (k / n)
    return F.coalesce(p * size, F.lit(0.0))


def weekly_hurdle(weeks: int = 12, week: int = 7) -> Column:
    """Share of weeks with sales times the mean non-zero week.

    That product equals the mean weekly total, so whole weeks counted back
    from the origin give it in one sum.
    """
    whole = F.least(F.floor(F.col("n_train") / week), F.lit(weeks))
    inside = F.floor(F.col("age") / week) < whole
    return F.coalesce(F.sum(F.when(inside, F.col("qty"))) / (F.max(whole) * week), F.lit(0.0))


def winsor_mean(train: DataFrame, keys: list[str], window: int, q: float) -> DataFrame:
    """Mean with values capped at the window's own quantile."""
    from tallyloom.functions.numbers import quantile_of

    values = train.groupBy(*keys, "fold").agg(F.sort_array(F.collect_list(_tail(window))).alias("v"))  # <= window values
    capped = values.withColumn("cap", quantile_of(F.col("v"), q))
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + F.least(x, F.col("cap")))
    return capped.select(*keys, "fold", (total / F.size("v")).alias("level"))


def block_stat(kind: str, blocks: int = 6, size: int = 30) -> Column:
    """Median or trimmed mean of the last six 30-day totals."""
    totals = [F.sum(F.when(F.floor(F.col("age") / size) == i, F.col("qty")).otherwise(0.0)) for i in range(blocks)]
    n = F.least(F.floor(F.max("n_train") / size), F.lit(blocks))
    arr = F.sort_array(F.slice(F.array(*totals), F.lit(1), F.greatest(n, F.lit(1)).cast("int")))
    from tallyloom.functions.numbers import quantile_of

    if kind == "median":
        value = quantile_of(arr, 0.5)
    else:
        inner = F.slice(arr, F.lit(2), F.greatest(F.size(arr) - 2, F.lit(0)))
        value = F.aggregate(inner, F.lit(0.0), lambda a, x: a + x) / F.size(inner)
    return F.when(n < 3, F.avg("qty")).otherwise(value / size)


def level_methods() -> dict[str, Column]:
    """The named closed-form methods and their aggregates."""
    return {
        "naive": naive(), "rolling_mean_7": rolling_mean(7), "rolling_mean_30": rolling_mean(30),
        "rolling_mean_90": rolling_mean(90), "rolling_mean_180": rolling_mean(180),
        "rolling_median_30": rolling_quantile(30), "rolling_q75_30": rolling_quantile(30, 0.75),
        "ewma_03": ewma(0.3), "croston": croston(), "sba": croston(sba=True), "tsb": tsb(), "tsb_05": tsb(0.05, 0.05),
        "weekly_hurdle": weekly_hurdle(), "block_median": block_stat("median"),
        "block_trimmed": block_stat("trimmed"),
    }


def levels(train: DataFrame, keys: list[str], methods: dict[str, Column]) -> DataFrame:
    """One row per (series, fold), one column per method."""
    return train.groupBy(*keys, "fold").agg(*[F.greatest(c, F.lit(0.0)).alias(m) for m, c in methods.items()])


def long_form(wide: DataFrame, keys: list[str], methods: list[str], horizon: int) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("level")) for m in methods])
    out = wide.select(*keys, "fold", F.inline(pairs))
    return out.withColumn("pred", F.col("level") * horizon)


# --------------------------------------------------------- category methods
def group_sums(train: DataFrame, key: str, group: str, windows: tuple[int, ...]) -> DataFrame:
    """Trailing sums of each series and of its group, per fold."""
    own = train.groupBy(key, group, "fold", "train_end").agg(
        *[F.sum(F.when(F.col("age") < w, F.col("qty")).otherwise(0.0)).alias(f"own_{w}") for w in windows])
    whole = own.groupBy(group, "fold").agg(*[F.sum(f"own_{w}").alias(f"grp_{w}") for w in windows])
    return own.join(whole, [group, "fold"])


def topdown_share(sums: DataFrame, level_window: int = 180, share_window: int = 30) -> Column:
    """Group mean times the series' share of its group."""
    share = F.when(F.col(f"grp_{share_window}") > 0, F.col(f"own_{share_window}") / F.col(f"grp_{share_window}")).otherwise(0.0)
    return F.col(f"grp_{level_window}") / F.least(F.col("train_end"), F.lit(level_window)) * share


def momentum(item_window: int, short: int, long: int) -> Column:
    base = F.col(f"grp_{long}") / F.least("train_end", F.lit(long))
    ratio = F.when(base > 0, F.least(F.greatest(F.col(f"grp_{short}") / F.least("train_end", F.lit(short)) / base, F.lit(0.5)), F.lit(2.0))).otherwise(0.0)
    return F.col(f"own_{item_window}") / F.least("train_end", F.lit(item_window)) * ratio


def seasonal_ratio(sums: DataFrame, side: str) -> Column:
    """Half-year mean scaled by last year's window over last year's mean block."""
    ly, year = F.col(f"{side}_ly"), F.col(f"{side}_365") / (365 / 30.0)
    s = F.when(year > 0, F.least(F.greatest(ly / year, F.lit(0.5)), F.lit(2.0))).otherwise(1.0)
    base = F.col("own_180") / F.least("train_end", F.lit(180))
    return F.when(F.col("train_end") < 395, base).otherwise(base * s)


# ------------------------------------------------------- day-by-day methods
def seasonal_naive(train: DataFrame, keys: list[str], plan: FoldPlan, season: int = 7) -> DataFrame:
    """The last ``season`` days tiled; the mean when history is shorter."""
    g = train.filter(F.col("age") < season).groupBy(*keys, "fold", "train_end").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "qty"))), lambda x: x["qty"]).alias("last"),
        F.avg("qty").alias("mean"))
    d = g.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(plan.horizon - 1))))
    return d.select(*keys, "fold", "h", F.when(
        F.size("last") < season, F.col("mean")).otherwise(F.get("last", F.col("h") % season)).alias("yhat"))


def last_year_days(train: DataFrame, keys: list[str], plan: FoldPlan, year: int = 365) -> DataFrame:
    """Days of the window one year before each horizon, with their step h."""
    h = F.col("pos") - (F.col("train_end") - year)
    return train.withColumn("h", h).filter((F.col("h") >= 0) & (F.col("h") < plan.horizon)).select(
        *keys, "fold", "h", F.col("qty").alias("yhat"))


def seasonal_index(train: DataFrame, keys: list[str], plan: FoldPlan, year: int = 365, window: int = 90, cap: float = 4.0) -> DataFrame:
    """Last year's window scaled by how the level moved, at most ``cap`` times."""
    recent, past = F.avg(_tail(window)), F.avg(F.when(F.col("age").between(year, year + window - 1), F.col("qty")))
    lvl = train.groupBy(*keys, "fold", "train_end").agg(recent.alias("recent"), past.alias("past"), F.avg(_tail(30)).alias("flat"))
    days = last_year_days(train, keys, plan, year)
    ratio = F.least(F.greatest(F.col("recent") / F.col("past"), F.lit(1.0 / cap)), F.lit(cap))
    usable = (F.col("train_end") >= year + window) & (F.col("past") > 0)
    grid = lvl.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(plan.horizon - 1))))
    return grid.join(days, [*keys, "fold", "h"], "left").select(
        *keys, "fold", "h", F.when(usable, F.col("yhat") * ratio).otherwise(F.col("flat")).alias("yhat"))


def semester_week_mean(train: DataFrame, keys: list[str], horizon_weeks: DataFrame, min_obs: int = 3) -> DataFrame:
    """Mean of the same term week before, 30-day mean where it was seen less
    than ``min_obs`` times. ``horizon_weeks``: fold, h, semester_week."""
    wanted = F.broadcast(horizon_weeks.select("fold", "semester_week").distinct())
    seen = train.join(wanted, ["fold", "semester_week"]).groupBy(*keys, "fold", "semester_week").agg(
        F.avg("qty").alias("mean"), F.count("*").alias("c"))
    flat = train.groupBy(*keys, "fold").agg(F.avg(_tail(30)).alias("flat"))
    grid = flat.join(F.broadcast(horizon_weeks), "fold")
    return grid.join(seen, [*keys, "fold", "semester_week"], "left").select(
        *keys, "fold", "h", F.when(F.col("c") >= min_obs, F.col("mean")).otherwise(F.col("flat")).alias("yhat"))


def day_frame(calendar: DataFrame, start_day: Column, n: Column, plan: FoldPlan) -> DataFrame:
    """Calendar days with their position on the shared history."""
    return calendar.withColumn("pos", F.datediff("day", start_day)).withColumn("n", n)


def horizon_days(days: DataFrame, plan: FoldPlan) -> DataFrame:
    """Calendar rows of each fold's horizon, with step ``h``. Tiny."""
    f = days.withColumn("__f", F.explode(plan.folds(F.col("n"))))
    f = f.withColumn("fold", F.col("__f.fold")).withColumn("h", F.col("pos") - F.col("__f.train_end") - plan.gap).drop("__f")
    return f.filter((F.col("h") >= 0) & (F.col("h") < plan.horizon))


def calendar_multiplier(train: DataFrame, group: str, horizon: DataFrame, ratio_window: int | None = 365,
                        level_window: int = 180, k: int = 10, cap: bool = True) -> DataFrame:
    """Mean day-type ratio ahead over that of the recent level, per (group, fold).

    ``train`` has the group's rows with ``kind``; ``horizon`` the kinds ahead.
    """
    inside = F.lit(True) if ratio_window is None else F.col("age") < ratio_window
    aggs = [F.avg(F.when(inside, F.col("qty"))).alias("m")]
    for t in DAY_TYPES:
        on = F.col("kind") == t
        aggs += [F.count(F.when(inside & on, 1)).alias(f"n_{t}"), F.avg(F.when(inside & on, F.col("qty"))).alias(f"a_{t}"),
                 F.count(F.when((F.col("age") < level_window) & on, 1)).alias(f"l_{t}")]
    g = train.groupBy(group, "fold").agg(*aggs)
    ahead = horizon.groupBy("fold").agg(*[F.count(F.when(F.col("kind") == t, 1)).alias(f"h_{t}") for t in DAY_TYPES])
    j = g.join(F.broadcast(ahead), "fold")

    def r(t):
        raw = F.coalesce(F.col(f"a_{t}") / F.col("m"), F.lit(1.0))
        return (F.col(f"n_{t}") * raw + k) / (F.col(f"n_{t}") + k)

    def mean(prefix):
        return (sum((F.col(f"{prefix}_{t}") * r(t) for t in DAY_TYPES), F.lit(0.0))
                / sum((F.col(f"{prefix}_{t}") for t in DAY_TYPES), F.lit(0)))

    base = mean("l")
    mult = F.when((F.col("m") > 0) & (base > 0), mean("h") / base).otherwise(1.0)
    return j.select(group, "fold", (F.least(F.lit(1.0), mult) if cap else mult).alias("mult"))


def closure_scale(train_days: DataFrame, horizon: DataFrame, level_window: int = 180) -> DataFrame:
    """Share of open days ahead over the share open lately, per fold."""
    lately = train_days.filter(F.col("age") < level_window).groupBy("fold").agg(F.avg(1 - F.col("closed")).alias("open_past"))
    ahead = horizon.groupBy("fold").agg(F.avg(1 - F.col("closed")).alias("open_ahead"))
    return lately.join(ahead, "fold").select("fold", F.coalesce(F.col("open_ahead") / F.nullif("open_past", F.lit(0.0)), F.lit(1.0)).alias("mult"))


def observed_rate(train: DataFrame, keys: list[str], horizon: int, window: int = 30, density_window: int = 90,
                  min_observed: int = 20) -> DataFrame:
    """Mean of the last traded days times the expected number of traded days.

    Needs ``traded`` (0/1) and ``t_pos``, the traded days through the row, so
    the last ``window`` traded days of a fold are found without another pass.
    They are looked for in the whole history: long closures only make the
    search longer. Each one is a running number, so no day list is gathered.
    """
    # one row per fold and training length: the traded days of a fold are the same for every series
    ends = train.filter("traded = 1").groupBy("fold", "train_end").agg(F.max("t_pos").alias("t_end"))
    late = (F.col("traded") == 1) & (F.col("t_pos") > F.col("t_end") - window)
    g = train.join(F.broadcast(ends), ["fold", "train_end"], "left").groupBy(*keys, "fold").agg(
        F.max("t_end").alias("t_end"), F.avg(F.when(F.col("age") < density_window, F.col("traded"))).alias("density"),
        F.avg(_tail(window)).alias("base"), F.avg(F.when(late, F.col("qty"))).alias("rate"))
    rate = F.coalesce("rate", F.lit(0.0))
    total = rate * F.greatest(horizon * F.col("density"), F.lit(1.0))
    return g.select(*keys, "fold", F.when(F.coalesce("t_end", F.lit(0)) < min_observed, F.col("base")).otherwise(total / horizon).alias("level"))


def holt_winters(series: DataFrame, key: str, plan: FoldPlan, grid: list[tuple], season: int = 7) -> DataFrame:
    """Damped additive trend with an additive weekly season.

    The recursion runs over one array per series (one value per calendar day).
    Parameters come from a small grid, the set with the least squared
    one-step error wins. ``grid`` holds (alpha, beta, gamma, phi).
    """
    arrays = series.groupBy(key, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "qty"))), lambda x: x["qty"]).alias("y"))
    rows = arrays.withColumn("ends", F.transform(plan.folds(F.col("n")), lambda f: f["train_end"]))
    rows = rows.withColumn("p", F.explode(F.array(*[F.struct(
        F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(g).alias("g"), F.lit(d).alias("d")) for a, b, g, d in grid])))
    # every (series, parameters) pair is an independent row: spread the recursions
    rows = spread(rows, key, "p")
    m = season

    def mean_of(arr):
        return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x) / F.size(arr)

    s1, s2 = F.slice("y", 1, m), F.slice("y", m + 1, m)
    level0 = mean_of(s1)
    snap_type = "array<struct<l:double,b:double,s:array<double>,sse:double,t:int>>"
    init = F.struct(level0.alias("l"), ((mean_of(s2) - level0) / m).alias("b"), F.transform(s1, lambda x: x - level0).alias("s"),
                    F.lit(0.0).alias("sse"), F.lit(0).alias("t"), F.array().cast(snap_type).alias("snaps"))

    def step(acc, y):
        # season entries rotate: the first one is always the next day's
        old = F.get(acc["s"], F.lit(0))
        damped = F.col("p.d") * acc["b"]
        err = y - (acc["l"] + damped + old)
        lvl = F.col("p.a") * (y - old) + (1 - F.col("p.a")) * (acc["l"] + damped)
        trend = F.col("p.b") * (lvl - acc["l"]) + (1 - F.col("p.b")) * damped
        new = F.col("p.g") * (y - acc["l"] - damped) + (1 - F.col("p.g")) * old
        state = [lvl.alias("l"), trend.alias("b"), F.concat(F.slice(acc["s"], 2, m - 1), F.array(new)).alias("s"),
                 (acc["sse"] + err * err).alias("sse"), (acc["t"] + 1).alias("t")]
        # keep the state at each fold's origin; a dozen per series
        snaps = F.when(F.array_contains("ends", acc["t"] + 1), F.concat(acc["snaps"], F.array(F.struct(*state)))).otherwise(acc["snaps"])
        return F.struct(*state, snaps.alias("snaps"))

    fitted = rows.select(key, "p", "y", F.posexplode(F.aggregate("y", init, step)["snaps"]).alias("fold", "st"))
    best = fitted.groupBy(key, "fold").agg(F.min_by(F.struct("st", "p"), F.struct("st.sse", "p")).alias("b"), F.first("y").alias("y"))
    best = best.withColumn("train_end", F.col("b.st.t"))
    steps = best.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(plan.horizon - 1))))
    damp = F.aggregate(F.sequence(F.lit(1), F.col("h") + 1), F.lit(0.0), lambda acc, i: acc + F.pow(F.col("b.p.d"), i))
    yhat = F.col("b.st.l") + damp * F.col("b.st.b") + F.get(F.col("b.st.s"), F.col("h") % m)
    flat = mean_of(F.slice("y", F.lit(1), F.col("train_end")))
    return steps.select(key, "fold", "h", F.greatest(F.when(F.col("train_end") < 2 * m, flat).otherwise(yhat), F.lit(0.0)).alias("yhat"))


def weekday_shape(train: DataFrame, group: str, horizon: DataFrame, window: int = 365) -> DataFrame:
    """Weights over the days ahead from weekday means, closures out; sum to 1."""
    recent = train.filter(F.col("age") < window)
    every = recent.groupBy(group, "fold").agg(F.avg("qty").alias("mean"))
    dow = recent.filter("closed = 0").groupBy(group, "fold", F.weekday("day").alias("dow")).agg(F.avg("qty").alias("profile"))
    grid = every.join(F.broadcast(horizon.select("fold", "h", "day", "closed", F.weekday("day").alias("dow"))), "fold")
    d = grid.join(dow, [group, "fold", "dow"], "left").withColumn(
        "p", F.greatest(F.coalesce("profile", "mean") * (1 - F.col("closed")), F.lit(0.0)))
    tot = d.groupBy(group, "fold").agg(F.sum("p").alias("tot"), F.count("*").alias("days"))
    return d.join(tot, [group, "fold"]).select(group, "fold", "h", "day", F.when(
        F.col("tot") > 0, F.col("p") / F.col("tot")).otherwise(1.0 / F.col("days")).alias("weight"))


def trade_rate(train: DataFrame, group: str, window: int = 365) -> DataFrame:
    """Chance of trading per weekday; the overall chance where a day is missing."""
    r = train.filter((F.col("age") < window) & (F.col("closed") == 0)).withColumn("dow", F.weekday("day"))
    per = r.groupBy(group, "fold", "dow").agg(F.avg((F.col("qty") > 0).cast("double")).alias("rate"))
    every = r.groupBy(group, "fold").agg(F.avg((F.col("qty") > 0).cast("double")).alias("overall"))
    grid = every.withColumn("dow", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return grid.join(per, [group, "fold", "dow"], "left").select(group, "fold", "dow", F.coalesce("rate", "overall").alias("rate"))


def plausibility_cap(series: DataFrame, key: str, plan: FoldPlan, window: int = 30, factor: float = 3.0) -> DataFrame:
    """Three times the largest 30-day total of the training days, at least 1."""
    from pyspark.sql import Window

    run = F.sum("qty").over(Window.partitionBy(key).orderBy("pos"))
    c = series.withColumn("__c", run)
    tot = F.col("__c") - F.coalesce(F.lag("__c", window).over(Window.partitionBy(key).orderBy("pos")), F.lit(0.0))
    from tallyloom.operators.backtest import training_rows

    t = training_rows(c.withColumn("tot", F.when(F.col("pos") >= window - 1, tot)), plan)
    g = t.groupBy(key, "fold").agg(F.max("tot").alias("m"), F.sum("qty").alias("s"))
    return g.select(key, "fold", (factor * F.greatest(F.coalesce("m", "s"), F.lit(1.0))).alias("cap"))


def split_largest_remainder(rows: DataFrame, group: list[str], quantity: str, weight: str, order: str,
                            places: int | None = None) -> DataFrame:
    """Split a whole quantity by weights with an exact sum.

    The units left after flooring go to the largest fractions, then in group
    order; equal weights when all are zero. A group is one sale's short list
    of variants, numbered by one window that is partitioned per sale.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*group)
    df = rows.withColumn("__tot", F.sum(weight).over(w)).withColumn("__n", F.count("*").over(w))
    raw = F.when(F.col("__tot") > 0, F.col(quantity) * F.col(weight) / F.col("__tot")).otherwise(F.col(quantity) / F.col("__n"))
    df = df.withColumn("__raw", raw).withColumn("__floor", F.floor("__raw")).withColumn("__left", F.col(quantity) - F.sum("__floor").over(w))
    part = F.col("__raw") - F.col("__floor")
    rank = F.row_number().over(w.orderBy(F.desc(part if places is None else F.round(part, places)), order))
    return df.withColumn("allocated", F.col("__floor") + (rank <= F.col("__left")).cast("long")).drop("__tot", "__n", "__raw", "__floor", "__left")
