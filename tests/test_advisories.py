"""Advisories name every item they count."""

from collections import Counter
from datetime import date

from pyspark.sql import functions as F

from tallyloom.plans import load_all
from tallyloom.plans.outlook import event_items


def test_every_item_is_named(spark):
    rows = load_all().QUERIES["advisories"](spark, "/root/testdata/sf0.001").collect()
    assert len({(r.topic, r.title, r.product_id) for r in rows}) == len(rows)
    named = Counter((r.topic, r.title) for r in rows)
    assert all(named[r.topic, r.title] == r.n_items for r in rows) and max(named.values()) > 5
    assert "forecast" in {r.topic for r in rows}


def test_coming_events_name_all_fast_items(spark):
    events = spark.createDataFrame([("fair", date(2024, 5, 2)), ("past", date(2024, 4, 1))], "event_name string, event_date date")
    items = spark.createDataFrame([(i, None if i == 3 else i / 10) for i in range(9)], "product_id long, rate double")
    rows = event_items(events, items, F.lit(date(2024, 5, 1))).collect()
    assert {(r.topic, r.title, r.product_id) for r in rows} == {("event", "fair 2024-05-02", i) for i in range(9)}
