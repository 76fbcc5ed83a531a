"""The leak check finds what it is for, and nothing else."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyloom.operators import leakage as K
from tallyloom.operators import registry as R
from tallyloom.operators.backtest import FoldPlan
from tallyloom.plans import load_all

PLAN = FoldPlan(horizon=10, min_train=20, max_folds=4, min_folds=1)


def series(spark):
    rng = random.Random(5)
    rows = [(k, dt.date(2020, 1, 1), i, float(rng.choice([0, 0, 3])), n) for k, n in (("a", 90), ("b#1", 55), ("c", 31)) for i in range(n)]
    return spark.createDataFrame(rows, "sku string, day date, pos int, qty double, n int")


def test_registered_methods_are_clean(spark):
    got = K.fold_leaks(series(spark), "sku", PLAN, lambda d, plan: R.run(d, "sku", plan, ["naive", "rolling_mean_30", "tsb", "croston"])).collect()
    assert {r.method for r in got} == {"naive", "rolling_mean_30", "tsb", "croston"} and {r.fold for r in got} == {0, 1, 2, 3}
    assert sum(r.rows for r in got) == 4 * (4 + 3 + 1) and all(r.differing_rows == 0 for r in got)


def test_a_planted_leak_is_found(spark):
    def peeks(d, plan):
        """Scales a clean level by the mean of the whole series."""
        whole = d.groupBy("sku").agg(F.avg("qty").alias("m"))
        clean = R.run(d, "sku", plan, ["rolling_mean_30"])
        return clean.join(whole, "sku").withColumn("pred", F.col("pred") * F.col("m"))

    got = K.fold_leaks(series(spark), "sku", PLAN, peeks).collect()
    assert len(got) == 4 and all(r.differing_rows > 0 for r in got)


def test_query(spark):
    rows = load_all().QUERIES["check_no_leakage"](spark, "/root/testdata/sf0.001").collect()
    assert {r.check.split(":")[0] for r in rows} == {"method", "policy_errors", "donor_rates"}
    assert all(r.differing_rows == 0 and r.rows > 0 for r in rows)


def test_copies_of_items_are_not_broadcast(spark):
    days = spark.createDataFrame([(i, p, float((i * p) % 3)) for i in range(1, 6) for p in range(500)], "product_id long, pos int, qty double")
    items = spark.createDataFrame([(i, 14) for i in range(1, 6)], "product_id long, lead_time_days int")
    seen = spark.createDataFrame([(p, p) for p in range(501)], "pos int, seen int")
    found = K.error_leaks(days, items, F.lit(500), seen)
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x]
    assert joins and not any("product_id" in x for x in joins)  # the calendar's rows are broadcast, the items' are not
    got = found.collect()
    assert len(got) == 12 and all(r.differing_rows == 0 and r.rows > 0 for r in got)


def test_copies_of_days_do_not_move(spark):
    days = spark.createDataFrame([(i, p, float((i * p) % 3)) for i in range(1, 6) for p in range(500)], "product_id long, pos int, qty double")
    items = spark.createDataFrame([(i, 14) for i in range(1, 6)], "product_id long, lead_time_days int")
    seen = spark.createDataFrame([(p, p) for p in range(501)], "pos int, seen int")
    plan = K.error_leaks(days, items, F.lit(500), seen)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    # days and items by item, then one row a fold from each partition
    assert len([x for x in moved if "REPARTITION_BY_NUM" not in x]) == 1 and all("hashpartitioning(product_id" in x for x in moved if "REPARTITION_BY_NUM" in x)


def test_differing_counts_as_a_full_join(spark):
    rng = random.Random(3)
    a, b = (spark.createDataFrame([(rng.choice([1, 2, 3, 4, 5, None]), rng.choice(["x", "y"]), rng.choice([0.0, 1.0, None])) for _ in range(12)], "k int, g string, v double").cache() for _ in range(2))
    left, right = a.select("k", "g", F.struct("v").alias("p")), b.select("k", "g", F.struct("v").alias("q"))
    want = left.join(right, ["k", "g"], "full").groupBy("g").agg(F.count("*").alias("rows"), F.count(F.when(~F.col("p").eqNullSafe(F.col("q")), 1)).alias("differing_rows"))
    assert sorted(K.differing(a, b, ["k", "g"], "v", ["g"]).collect()) == sorted(want.collect())
