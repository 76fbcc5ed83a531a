"""Calendar tables as a store publishes them, for the years the facts cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (event name, flag, first month-day, last month-day).
PERIODS = (
    ("Enrollment second term", "is_enrollment_period", "01-01", "01-14"),
    ("Enrollment summer", "is_enrollment_period", "06-01", "06-14"),
    ("Final exams May", "is_exam_week", "05-15", "05-20"),
    ("Final exams December", "is_exam_week", "12-15", "12-20"),
    ("Foundation Week", "is_event_day", "04-24", "04-28"),
    ("Paskuhan (date uncertain - verify)", "is_event_day", "12-10", "12-12"),
    ("Christmas break", "is_sem_break", "12-22", "12-31"),
)
# Fixed values: (term suffix, first month-day, first calendar year offset).
TERMS = (("T1", "08-05", 0), ("T2", "01-05", 1), ("ST", "06-10", 1))


def _years(span: DataFrame) -> DataFrame:
    return span.select(F.explode(F.sequence(F.year("first_day"), F.year("last_day"))).alias("y"))


def _iso(year, md: str):
    return F.to_date(F.concat_ws("-", year.cast("string"), F.lit(md)))


def calendar_ranges(span: DataFrame) -> DataFrame:
    y = F.col("y")
    rows = [
        F.struct(F.lit(name).alias("event_name"), F.lit(flag).alias("flag"),
                 _iso(y, a).alias("start_date"), _iso(y, b).alias("end_date"),
                 F.lit(None).cast("string").alias("semester_id"))
        for name, flag, a, b in PERIODS
    ]
    years = _years(span)
    special = years.select(F.inline(F.array(*rows)))
    terms = []
    for suffix, md, offset in TERMS:
        first = y - offset
        sid = F.concat(F.lit("AY"), F.lpad((first % 100).cast("string"), 2, "0"),
                       F.lpad(((first + 1) % 100).cast("string"), 2, "0"), F.lit("-" + suffix))
        terms.append(F.struct(
            F.lit("Start of classes").alias("event_name"), F.lit("term").alias("flag"),
            _iso(y, md).alias("start_date"), F.date_add(_iso(y, md), 4).alias("end_date"),
            sid.alias("semester_id")))
    # the year before the first one supplies the term in progress on 1 January
    earlier = span.select(F.explode(F.sequence(F.year("first_day") - 1, F.year("last_day"))).alias("y"))
    return special.unionByName(earlier.select(F.inline(F.array(*terms))))


def closure_log(span: DataFrame) -> DataFrame:
    """Append-only closure toggles: Christmas, February Sundays, and one day
    closed and then reopened each year."""
    y = F.col("y")
    years = _years(span)
    christmas = years.select(
        (y * 1000).alias("closure_id"), _iso(y, "12-25").alias("closure_date"), F.lit(1).alias("is_closed"))
    february = years.select(
        y, F.explode(F.sequence(_iso(y, "02-01"), F.last_day(_iso(y, "02-01")))).alias("closure_date")
    ).filter(F.weekday("closure_date") == 6).select(
        (y * 1000 + 100 + F.dayofmonth("closure_date")).alias("closure_id"), "closure_date",
        F.lit(1).alias("is_closed"))
    shut = years.select((y * 1000 + 1).alias("closure_id"), _iso(y, "07-04").alias("closure_date"),
                        F.lit(1).alias("is_closed"))
    reopened = years.select((y * 1000 + 2).alias("closure_id"), _iso(y, "07-04").alias("closure_date"),
                            F.lit(0).alias("is_closed"))
    return christmas.unionByName(february).unionByName(shut).unionByName(reopened)


def event_log(span: DataFrame) -> DataFrame:
    """Events logged by staff on top of the published ones."""
    y = F.col("y")
    return _years(span).select(F.inline(F.array(
        F.struct((y * 10).alias("event_id"), _iso(y, "04-25").alias("event_date"),
                 F.lit("foundation week").alias("event_name")),
        F.struct((y * 10 + 1).alias("event_id"), _iso(y, "10-03").alias("event_date"),
                 F.lit("Alumni Homecoming").alias("event_name")),
    )))
