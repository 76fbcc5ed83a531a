"""Calendar tables, runs of days, lifts and outlooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.calendar import planning_kind
from tallyloom.operators.joins import assign_terms, explode_ranges, term_windows

BASELINE_DAYS, MIN_BASELINE_DAYS = 90, 10


def gap_runs(days: DataFrame, keys: list[str], day: str, gap: int) -> DataFrame:
    """Dates at most ``gap`` days apart form one run. One row per date in."""
    w = Window.partitionBy(*keys).orderBy(day)
    new = F.coalesce(F.datediff(day, F.lag(day).over(w)) > gap, F.lit(True)).cast("int")
    marked = days.select(*keys, day).distinct().withColumn("__new", new)
    numbered = marked.withColumn("__run", F.sum("__new").over(w))
    return numbered.groupBy(*keys, "__run").agg(
        F.min(day).alias("run_start"), F.max(day).alias("run_end"), F.count("*").alias("days")).drop("__run")


def latest_closures(log: DataFrame) -> DataFrame:
    """Last row per date wins."""
    return log.groupBy("closure_date").agg(F.max_by("is_closed", "closure_id").alias("is_closed"))


def build_calendar(days: DataFrame, ranges: DataFrame, closures: DataFrame, events: DataFrame, tally: DataFrame,
                   flags: list[str]) -> DataFrame:
    """Date dimension from published ranges, term windows and the two logs."""
    last = days.agg(F.max("day")).scalar()
    flag_days = explode_ranges(ranges.filter("flag <> 'term'"), flags)
    closed = latest_closures(closures).select(F.col("closure_date").alias("day"), F.col("is_closed").alias("is_store_closed"))
    logged = events.select(F.col("event_date").alias("day"), F.lit(1).alias("logged")).distinct()
    out = assign_terms(days, term_windows(ranges), last)
    for side in (flag_days, closed, logged, tally):
        out = out.join(F.broadcast(side), "day", "left")
    out = out.fillna(0, [*flags, "is_store_closed", "logged", "is_tally_date", "is_tally_date_positive"])
    return out.withColumn("is_event_day", F.greatest("is_event_day", "logged")).drop("logged", "term_start")


def day_table(calendar: DataFrame, sale: DataFrame) -> DataFrame:
    """Per date: kind, closed, store units, recorded."""
    units = sale.groupBy("day").agg(F.sum("quantity_sold").cast("double").alias("units"))
    closed = F.coalesce("is_store_closed", F.lit(0)) == 1
    return calendar.join(units, "day", "left").select(
        "day", planning_kind().alias("kind"), closed.cast("int").alias("closed"),
        F.coalesce("units", F.lit(0.0)).alias("units"),
        (~closed & (F.coalesce("units", F.lit(0.0)) > 0)).cast("int").alias("recorded"))


def lifts(days: DataFrame) -> DataFrame:
    """Mean units per recorded day of each kind over a regular day."""
    rec = days.filter("recorded = 1")
    base = rec.filter("kind = 'regular'").agg(F.avg("units")).scalar()
    g = rec.groupBy("kind").agg(F.count("*").alias("days"), F.avg("units").alias("units_per_day"))
    return g.withColumn("lift", F.col("units_per_day") / F.nullif(base, F.lit(0.0)))


def baseline(days: DataFrame) -> DataFrame:
    """Mean regular recorded day of the last 90 days, or of all when too few."""
    last = days.filter("recorded = 1").agg(F.max("day")).scalar()
    rec = days.filter("recorded = 1 AND kind = 'regular'")
    recent = F.col("day") > F.date_sub(last, BASELINE_DAYS)

    def both(fn, name):
        return fn(F.when(recent, F.col(name)), ), fn(F.col(name))

    g = rec.agg(
        F.count(F.when(recent, 1)).alias("n_recent"), F.count("*").alias("n_all"),
        F.avg(F.when(recent, F.col("units"))).alias("a_recent"), F.avg("units").alias("a_all"),
        F.min(F.when(recent, F.col("day"))).alias("f_recent"), F.min("day").alias("f_all"), F.max("day").alias("to_day"))
    use = F.col("n_recent") >= MIN_BASELINE_DAYS
    return g.select(F.when(use, F.col("a_recent")).otherwise(F.col("a_all")).alias("per_day"),
                    F.when(use, F.col("n_recent")).otherwise(F.col("n_all")).alias("days"),
                    F.when(use, F.col("f_recent")).otherwise(F.col("f_all")).alias("from_day"), "to_day")


def expected(windows: DataFrame, days: DataFrame, lift_table: DataFrame) -> DataFrame:
    """Baseline times the mean lift of a window's days, with its main kind."""
    base = baseline(days).select("per_day").scalar()
    d = windows.withColumn("day", F.explode(F.sequence("start_day", "end_day")))
    j = (d.join(F.broadcast(days.select("day", "kind")), "day", "left")
         .withColumn("kind", F.coalesce("kind", F.lit("regular")))
         .join(F.broadcast(lift_table.select("kind", "lift", F.col("days").alias("past_days"))), "kind", "left"))
    per_kind = j.groupBy("start_day", "end_day", "kind", "past_days").agg(
        F.count("*").alias("c"), F.sum(F.coalesce("lift", F.lit(1.0))).alias("ls"))
    g = per_kind.groupBy("start_day", "end_day").agg(
        F.min_by("kind", F.struct(-F.col("c"), F.col("kind"))).alias("kind"),
        F.min_by("past_days", F.struct(-F.col("c"), F.col("kind"))).alias("past_days"),
        (F.sum("ls") / F.sum("c")).alias("lift"))
    return g.withColumn("per_day", F.col("lift") * base)


def last_year_series(runs: DataFrame, days: DataFrame, context: int = 7) -> DataFrame:
    """Each run's days with ``context`` days on both sides, and its daily rate."""
    d = runs.withColumn("day", F.explode(F.sequence(F.date_sub("start_day", context), F.date_add("end_day", context))))
    return d.join(F.broadcast(days), "day").select(
        "start_day", "end_day", "day", "kind", "closed",
        F.when(F.col("recorded") == 1, F.col("units")).alias("units"),
        F.col("day").between(F.col("start_day"), F.col("end_day")).cast("int").alias("in_window"))


def upcoming_windows(runs: DataFrame, lift_table: DataFrame, today: Column, published_end: Column,
                     horizon: int = 365) -> DataFrame:
    """Published windows ahead, plus last year's moved on past the calendar."""
    last = F.date_add(today, horizon)
    ahead = runs.filter((F.col("run_end") >= today) & (F.col("run_start") <= last)).select(
        "kind", F.col("run_start").alias("start_day"), F.col("run_end").alias("end_day"), F.lit(0).alias("estimated"))
    ns, ne = F.add_months("run_start", 12), F.add_months("run_end", 12)
    moved = runs.filter((F.col("run_start") >= F.date_sub(today, 365)) & (F.col("run_start") < today)
                        & (ns > published_end) & (ns <= last) & (ne >= today)).select(
        "kind", ns.alias("start_day"), ne.alias("end_day"), F.lit(1).alias("estimated"))
    return ahead.unionByName(moved).join(F.broadcast(lift_table), "kind", "left").select(
        "kind", "start_day", "end_day", "estimated", (F.datediff("end_day", "start_day") + 1).alias("days"),
        F.coalesce("lift", F.lit(1.0)).alias("lift"))
