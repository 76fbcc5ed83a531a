"""Steps that must not grow with what Spark happens to put into one partition, and the plainer results they replace."""

import datetime as dt
import random

import pytest

from tallyloom.operators import joins as J
from tallyloom.operators import metrics as X
from tallyloom.operators import policy as P
from tallyloom.plans import load_all
from tallyloom.plans.policy import anchor_basis

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_anchor_basis_equals_every_month_end(spark):
    rng = random.Random(3)
    first, last = dt.date(2019, 11, 5), dt.date(2022, 3, 17)
    days = [(i, first + dt.timedelta(rng.randrange((last - first).days + 1)), rng.choice([-2, 0, 1, 4])) for i in [1, 2, 3, None] for _ in range(12)]
    days = list({(i, d): (i, d, q) for i, d, q in [*days, (9, last, 1), (9, dt.date(2020, 2, 29), 2)]}.values())
    got = {(r.m.year, r.m.month): (r.positive_30, r.positive_365, r.units_30) for r in anchor_basis(spark.createDataFrame([(*x, last) for x in days], "product_id long, day date, q long, z date")).collect()}
    want = {}
    for k in range(2019 * 12 + 10, 2022 * 12 + 3):
        y, m = divmod(k, 12)
        end = min(last, dt.date((k + 1) // 12, (k + 1) % 12 + 1, 1) - dt.timedelta(1))
        sums = {}
        for i, d, q in days:
            if d <= end and (end - d).days < 365:
                u = sums.setdefault(i, [0, 0])
                u[0] += q * ((end - d).days < 30)
                u[1] += q
        if sums:
            want[y, m + 1] = (sum(a > 0 for a, _ in sums.values()), sum(b > 0 for _, b in sums.values()), sum(a for a, _ in sums.values()))
    assert got == want


@pytest.mark.parametrize("name", ["split_largest_remainder", "nearest_month_stock", "demand_basis_by_anchor"])
def test_windows_by_item_run_in_spread_partitions(spark, name):
    found = exchanges(load_all().QUERIES[name](spark, SF))
    assert any("product_id" in x and "REPARTITION_BY_NUM" in x for x in found)
    # the rows are not moved again after that
    assert "REPARTITION_BY_NUM" in next(x for x in found if "product_id" in x)


def test_tier_curve_moves_errors_once(spark):
    errors = spark.createDataFrame([(i, f, float(i + f), float(f), float(i)) for i in range(5) for f in range(4)], "product_id long, fold int, actual double, pred double, error double")
    items = spark.createDataFrame([(i,) for i in range(5)], "product_id long")
    found = exchanges(P.tier_curve(errors))
    assert len(found) == 1 and "REPARTITION_BY_NUM" in found[0]
    assert P.service_tier(P.tier_curve(errors), items).count() == 5


def test_nearest_month_takes_sums_of_repeated_counts(spark):
    asked = spark.createDataFrame([(1, 5), (1, 5), (1, 9), (2, 3), (None, 1)], "product_id long, month_no int")
    stock = spark.createDataFrame([(1, 4, 2), (1, 4, 3), (1, 6, 7), (1, 9, None)], "product_id long, month_no int, quantity long")
    got = {(r.product_id, r.month_no, r.weight, r.basis) for r in J.nearest_month_stock(asked, stock).collect()}
    assert got == {(1, 5, 5.0, "nearest_month(-1mo)"), (1, 9, 7.0, "nearest_month(-3mo)"), (2, 3, 0.0, "no_inventory"), (None, 1, 0.0, "no_inventory")}


def test_risks_of_one_event_time_are_ranged(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(1, 4), rng.randrange(2), rng.choice([0.5, 1.5, rng.random()])) for _ in range(300)]
    found = X.c_index(spark.createDataFrame(rows, "time int, observed int, risk double"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # a window over all risks of an event time is one task; the running counts go by event time and range
    assert all("__" in x for x in plan.splitlines() if "Window [" in x)
    pairs = [(a, b) for a in rows if a[1] for b in rows if b[0] > a[0]]
    want = sum(1.0 if a[2] > b[2] else 0.5 if a[2] == b[2] else 0.0 for a, b in pairs) / len(pairs)
    assert abs(found.first().c_index - want) < 1e-9


def test_speed_at_past_origins_moves_item_days_once(spark):
    from tallyloom.operators import classify as C

    rows = [(p, dt.date(2020, 1, 1) + dt.timedelta(d), (p * d) % 4, d % 3 if d % 5 else None, d % 2) for p in range(6) for d in range(90)]
    rows += rows[:40]
    sale = spark.createDataFrame(rows, "product_id long, day date, quantity_sold long, is_censored int, imputation_flag int")
    origins = [dt.date(2020, 2, 1), dt.date(2020, 3, 1)]
    got = {(r.origin, r.rule): (r.fast, r.dead) for r in C.fsn_as_of(sale, spark.createDataFrame([(origins,)], "os array<date>"), {"any": 10**6}).collect()}
    for o in origins:
        adus, ahead = {}, {}
        for p in range(6):
            past = [r for r in rows if r[0] == p and r[1] < o and r[3] != 1]
            adus[p] = (sum(r[2] * (0.5 if r[4] else 1) for r in past) / len({r[1] for r in past}), sum(r[2] for r in past))
            ahead[p] = sum(r[2] for r in rows if r[0] == p and o <= r[1] < o + dt.timedelta(30))
        v = sorted(a for a, _ in adus.values())
        cut = v[4]  # 0.8 * 5
        fast = [p for p in adus if adus[p][1] > 0 and adus[p][0] >= cut]
        assert got[o, "any"] == (len(fast), sum(ahead[p] <= 0 for p in fast))
