"""Readers, sinks and streams on real files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import readers as R
from tallyloom.streaming import live as L
from tallyloom.streaming.leveled import Leveled


def test_csv_strict_and_quarantine(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Date,Item,Qty\n2001-01-01,a,3\nbad,a,1\n2001-01-02,zz,2\n2001-01-03,a,x\n")
    df = R.read_csv_strict(spark, str(tmp_path / "in.csv"), ["Date", "Item", "Qty"], {"Qty": "Quantity"})
    assert [r.Quantity for r in df.orderBy("row_order").collect()] == ["3", "1", "2", "x"]
    from tallyloom.functions.text import strict_date

    pid = F.when(F.col("Item") == "a", 1)
    judged = df.withColumn("reason", R.load_reason(F.col("Quantity").try_cast("long"), F.col("Item"), F.lit(False), pid, strict_date(F.col("Date"))))
    R.write_with_quarantine(judged, str(tmp_path / "sinks"))
    assert spark.read.parquet(str(tmp_path / "sinks" / "sink=loaded")).count() == 1
    assert sorted(r.reason for r in spark.read.parquet(str(tmp_path / "sinks" / "sink=held")).collect()) == [
        "date_no_match_in_dim_date", "invalid_or_missing_quantity", "item_no_match_in_dim_product"]


def test_replace_partitions_keeps_the_rest(spark, tmp_path):
    p = str(tmp_path / "t")
    R.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "model string, v int"), p, ["model"])
    R.replace_partitions(spark.createDataFrame([("b", 9)], "model string, v int"), p, ["model"])
    assert {(r.model, r.v) for r in spark.read.parquet(p).collect()} == {("a", 1), ("b", 9)}


def test_csv_report_is_formula_safe(spark, tmp_path):
    R.write_csv_report(spark.createDataFrame([("=1+1", 2), ("ok", 3)], "item string, n int"), str(tmp_path / "r"))
    assert {r.item for r in spark.read.csv(str(tmp_path / "r"), header=True).collect()} == {"'=1+1", "ok"}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    """The events table as shuffled files that arrive one per batch, so that most rows are late."""
    folder = tmp_path_factory.mktemp("arriving")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(5, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    return L.tally_stream(spark, str(folder), files_per_batch=1), L.as_tally(events)


def test_tally_stream_reads_a_folder_of_files(spark, arriving):
    stream, batch = arriving
    table = L.write_batches(stream, "t", lambda b: b)
    assert rows(table.rows()) == rows(batch)
    # five batches: four folded into one folder, and the last
    assert table.manifest().last == 4 and [level for level, _ in table.manifest().folders] == [1, 0]


def test_live_tables_equal_the_batch_result(spark, arriving):
    stream, batch = arriving
    days, whole = L.live_days(stream, "t"), L.day_totals(batch)
    for view in (L.daily_units, L.sliding_units, L.session_runs):
        assert rows(view(days)) == rows(view(whole))
    counts = batch.select("product_id", F.date_format("ts", "yyyy-MM").alias("month")).distinct().withColumn("counted", F.lit(150))
    stock = L.stock_state(days, counts)
    assert rows(stock) == rows(L.stock_state(whole, counts))
    assert stock.count() == stock.select("product_id", "day").distinct().count()


def test_latest_per_key_equals_batch(spark, arriving):
    stream, batch = arriving
    assert rows(L.latest_per_key(stream, "t")) == rows(L.newest_rows(batch))


def sums(rows):
    return rows.groupBy("k").agg(F.sum("v").alias("v"))


def test_leveled_table(spark, tmp_path):
    """Many batches are read from few folders, a batch counts once, and only committed batches count."""
    table = Leveled(spark, str(tmp_path / "t"), sums)
    with pytest.raises(FileNotFoundError):
        table.rows()
    want = {}
    for b in range(23):
        own = {k: b * 10 + k for k in range(b % 3, 6)}
        table.append(spark.createDataFrame(list(own.items()), "k int, v long"), b)
        want = {k: want.get(k, 0) + own.get(k, 0) for k in range(6)}
        if b % 7 == 0:  # given again after the commit
            table.append(spark.createDataFrame([(1, 999)], "k int, v long"), b)
        assert len(table.manifest().folders) <= 3 * 3
    assert {r.k: r.v for r in table.rows().collect()} == want
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) <= 9 + 4  # and what the last commit replaced


def test_crash_before_the_commit(spark, tmp_path, monkeypatch):
    table = Leveled(spark, str(tmp_path / "t"), sums)
    for b in range(3):
        table.append(spark.createDataFrame([(1, 1)], "k int, v long"), b)

    def dies(m):
        raise RuntimeError("killed")

    with monkeypatch.context() as broken:
        broken.setattr(table, "_commit", dies)
        with pytest.raises(RuntimeError):
            table.append(spark.createDataFrame([(1, 5)], "k int, v long"), 3)
    again = Leveled(spark, str(tmp_path / "t"), sums)
    assert again.rows().first().v == 3
    again.append(spark.createDataFrame([(1, 5)], "k int, v long"), 3)
    assert again.rows().first().v == 8 and [level for level, _ in again.manifest().folders] == [1]


def test_stock_state_by_hand(spark):
    t = dt.datetime(2024, 1, 1)
    sold = [(0, 4), (1, 4), (2, 4), (3, 4), (4, 0), (32, 1)]
    events = spark.createDataFrame([(i, 1, t + dt.timedelta(days=d), "click", q) for i, (d, q) in enumerate(sold)], "event_id long, product_id long, ts timestamp, kind string, quantity long")
    counts = spark.createDataFrame([(1, "2024-01", 10), (1, "2024-02", 5)], "product_id long, month string, counted int")
    got = {r.day.isoformat(): (r.on_hand, r.is_censored) for r in L.stock_state(L.day_totals(events), counts).collect()}
    assert got == {"2024-01-01": (10, 0), "2024-01-02": (6, 0), "2024-01-03": (2, 0), "2024-01-04": (-2, None),
                   "2024-01-05": (-6, None), "2024-02-02": (5, 0)}


def test_session_gap_of_exactly_three_days_merges(spark):
    d = [dt.date(2024, 1, 1), dt.date(2024, 1, 4), dt.date(2024, 1, 8)]
    df = spark.createDataFrame([(1, x, "click", 1, 1) for x in d], "product_id long, day date, kind string, units long, rows long")
    assert {(r.run_start.day, r.run_end.day) for r in L.session_runs(df).collect()} == {(1, 4), (8, 8)}
