"""Matches of patterns with their places, as column expressions.

Spark gives all matches of a pattern and the text between them; the places
follow from their lengths. Offsets count characters (code points), the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AROUND = 24  # characters of context on each side


def hits(text: Column, pattern: str) -> Column:
    """All leftmost matches that don't overlap."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def placed(text: Column, found: Column, pattern: str) -> Column:
    """Structs of start, end, hit and the text before and behind, for matches found by ``hits``."""
    between = F.split(text, pattern, -1)
    parts = F.transform(found, lambda h, i: F.struct(
        h.alias("hit"), F.char_length(between[i]).alias("gap"), F.right(between[i], F.lit(AROUND)).alias("before"), F.left(between[i + 1], F.lit(AROUND)).alias("behind")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int, hit: string, before: string, behind: string>>)").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        end = begin + F.char_length(p["hit"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end"), p["hit"].alias("hit"), p["before"].alias("before"), p["behind"].alias("behind"))).alias("out"))

    none = F.expr("cast(array() as array<struct<start: int, end: int, hit: string, before: string, behind: string>>)")
    return F.when(F.size(found) > 0, F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(none)


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: Column) -> Column:
    return F.sha2(written(spans).cast("binary"), 256)


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
