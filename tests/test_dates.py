"""No query depends on the years of its tables."""

import datetime as dt

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from tallyloom.plans import load_all

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "orders", "part", "supplier", "customer", "nation", "region")


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """The tables with every date 28 years earlier or later, when weekdays and leap years are the same."""
    folder = tmp_path_factory.mktemp("shifted")
    for name in TABLES:
        t = pq.read_table(f"{SF}/{name}.parquet")
        for i, f in enumerate(t.schema):
            if pa.types.is_date(f.type) or pa.types.is_timestamp(f.type):
                moved = pc.add(t[f.name].cast(pa.timestamp("us")), pa.scalar(dt.timedelta(days=10227), pa.duration("us")))
                t = t.set_column(i, f.name, moved.cast(f.type))
        pq.write_table(t, folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ("intersect_months", "series_extend_synthetic", "full_outer_month_delta", "agg_batch_report", "rep_batch_daily", "er_name_suggest"))
def test_same_rows_in_other_years(spark, shifted, name):
    run = load_all().QUERIES[name]
    n = run(spark, SF).count()
    assert n > 0 and run(spark, shifted).count() == n
