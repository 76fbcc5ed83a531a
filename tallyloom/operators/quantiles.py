"""Exact quantiles of all groups at once, without sorting a group in one task.

``F.percentile`` keeps every distinct value of a group in one buffer. Here a group only ever sends counts:
its value range is cut into bins, the bin that holds the wanted rank becomes the new range, and so on until
at most ``few`` rows or one single value are left. Those rows are fetched and the quantile is interpolated between the two
neighbouring order statistics, as ``percentile`` does. Bins keep their least and greatest value, so a range shrinks
in every round, and ties cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.scale import cut_lineage, discard

BINS = 1024
FEW = 4096
GROUPS_SENT = 20_000  # groups up to which their ranges are sent to all tasks


def _bin(bins: int) -> Column:
    # halved, so that the width of a range can't overflow
    share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")


def exact_quantiles(df: DataFrame, value: str, probs: list[float], keys: list[str] | None = None, few: int = FEW, bins: int = BINS) -> DataFrame:
    """Keys, ``n`` (values) and ``q`` (array, in the order of ``probs``) for each group that has values.

    Nulls don't count; values must be finite. Null keys are a group. ``df`` is read once a round, so it should be a table or
    cheap; a group of at most ``few`` values needs no round.
    """
    keys = keys or []
    rows = df.filter(F.col(value).isNotNull()).select(F.struct(*[F.col(k) for k in keys], F.lit(0).alias("__0")).alias("k"), F.col(value).cast("double").alias("v"))
    spans = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    goals = spans.withColumn("w", wanted).withColumn("at", F.col("w.p") * (F.col("n") - 1))
    goals = goals.select("k", F.col("w.i").alias("i"), "n", "at", F.floor("at").alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"))
    goals = cut_lineage(goals, "ranges")
    waiting = (F.col("inside") > few) & (F.col("lo") < F.col("hi"))
    groups, open_ = goals.agg(F.count("*"), F.count(F.when(waiting, 1))).first()

    def near(ranges: DataFrame) -> DataFrame:
        return F.broadcast(ranges) if groups <= GROUPS_SENT else ranges

    while open_:
        met = rows.join(near(goals.filter(waiting)), "k").filter(F.col("v").between(F.col("lo"), F.col("hi")))
        counts = met.groupBy("k", "i", _bin(bins).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        until = Window.partitionBy("k", "i").orderBy("bin")
        held = counts.withColumn("upto", F.sum("c").over(until)).join(goals.select("k", "i", "n", "at", "rank", "before"), ["k", "i"])
        held = held.filter((F.col("before") + F.col("upto") > F.col("rank")) & (F.col("before") + F.col("upto") - F.col("c") <= F.col("rank")))
        held = held.select("k", "i", "n", "at", "rank", "lo", "hi", (F.col("before") + F.col("upto") - F.col("c")).alias("before"), F.col("c").alias("inside"))
        narrower = cut_lineage(goals.filter(~waiting).union(held), "ranges")
        discard(goals)
        goals = narrower
        open_ = goals.filter(waiting).count()

    met = rows.join(near(goals.select("k", "i", "lo", "hi")), "k").filter(F.col("v") >= F.col("lo"))
    inner = F.when((F.col("v") <= F.col("hi")) & (F.col("lo") < F.col("hi")), F.col("v"))
    found = met.groupBy("k", "i").agg(F.array_sort(F.collect_list(inner)).alias("own"), F.min(F.when(F.col("v") > F.col("hi"), F.col("v"))).alias("next"))
    found = found.join(goals, ["k", "i"])

    def ranked(rank: Column) -> Column:
        at = (rank - F.col("before")).cast("int")
        return F.when(at >= F.col("inside"), F.col("next")).when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.get("own", at))

    low, high = ranked(F.col("rank")), ranked(F.col("rank") + 1)
    up = F.col("rank") + 1
    q = F.when((F.col("at") == F.col("rank")) | (low == high), low).otherwise((up - F.col("at")) * low + (F.col("at") - F.col("rank")) * high)
    done = found.select("k", "n", F.struct("i", q.alias("q")).alias("q")).groupBy("k", "n").agg(F.transform(F.array_sort(F.collect_list("q")), lambda x: x["q"]).alias("q"))
    return done.select(*[F.col("k")[key].alias(key) for key in keys], "n", "q")
