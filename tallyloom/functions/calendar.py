"""Day-level calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _md(day: Column) -> Column:
    return F.month(day) * 100 + F.dayofmonth(day)


def flag_columns(day: Column) -> list[Column]:
    """The published special periods, evaluated on a date."""
    md = _md(day)
    return [
        (md.between(101, 114) | md.between(601, 614)).cast("int").alias("is_enrollment_period"),
        (md.between(515, 520) | md.between(1215, 1220)).cast("int").alias("is_exam_week"),
        (md.between(424, 428) | md.between(1210, 1212)).cast("int").alias("is_event_day"),
        (md.between(1222, 1231)).cast("int").alias("is_sem_break"),
        ((md == 1225) | ((F.month(day) == 2) & (F.weekday(day) == 6))).cast("int").alias("is_store_closed"),
    ]


def term_columns(day: Column) -> list[Column]:
    """Term id and week. T1 runs from 5 August, T2 from 5 January, ST from 10 June."""
    md, y = _md(day), F.year(day)
    t1 = (md >= 805) | (md < 105)
    st = md.between(610, 804)
    first_year = F.when(md >= 805, y).otherwise(y - 1)
    start = (
        F.when(md >= 805, F.make_date(y, F.lit(8), F.lit(5)))
        .when(md < 105, F.make_date(y - 1, F.lit(8), F.lit(5)))
        .when(st, F.make_date(y, F.lit(6), F.lit(10)))
        .otherwise(F.make_date(y, F.lit(1), F.lit(5))))
    label = F.when(t1, "T1").when(st, "ST").otherwise("T2")
    return [
        F.concat(F.lit("AY"), F.lpad((first_year % 100).cast("string"), 2, "0"),
                 F.lpad(((first_year + 1) % 100).cast("string"), 2, "0"),
                 F.lit("-"), label).alias("semester_id"),
        (F.floor(F.datediff(day, start) / 7) + 1).cast("int").alias("semester_week"),
    ]


def _on(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) == 1


def term_start_day() -> Column:
    """Within the first two weeks of a first term."""
    return F.coalesce(F.col("semester_id").endswith("-T1") & F.col("semester_week").between(1, 2), F.lit(False))


def planning_kind() -> Column:
    """enrollment > term_start > exam > sem_break > event > regular"""
    return (
        F.when(_on("is_enrollment_period"), "enrollment").when(term_start_day(), "term_start")
        .when(_on("is_exam_week"), "exam").when(_on("is_sem_break"), "sem_break")
        .when(_on("is_event_day"), "event").otherwise("regular"))


def demand_kind() -> Column:
    """enrol > break > exam > normal"""
    return (
        F.when(_on("is_enrollment_period"), "enrol").when(_on("is_sem_break"), "break")
        .when(_on("is_exam_week"), "exam").otherwise("normal"))


def sheet_mark() -> Column:
    """closed > event > enrollment > exam > break, NULL on a plain day"""
    return (
        F.when(_on("is_store_closed"), "closed").when(_on("is_event_day"), "event")
        .when(_on("is_enrollment_period"), "enrollment").when(_on("is_exam_week"), "exam")
        .when(_on("is_sem_break"), "break"))


def report_kind() -> Column:
    """closed > sem break > enrollment > exam > event > regular"""
    return (
        F.when(_on("is_store_closed"), "Closed").when(_on("is_sem_break"), "Sem break")
        .when(_on("is_enrollment_period"), "Enrollment").when(_on("is_exam_week"), "Exam week")
        .when(_on("is_event_day"), "Event").otherwise("Regular"))


def year_shift(day: Column, years: int) -> Column:
    """Same day in another year; 29 February becomes the 28th."""
    return F.add_months(day, 12 * years)


def yearly_gap(a: Column, b: Column) -> Column:
    """Days between two dates ignoring the year, the short way round."""
    shifted = F.add_months(a, (F.year(b) - F.year(a)) * 12)
    gap = F.abs(F.datediff(shifted, b))
    return F.least(gap, F.lit(365) - gap)
