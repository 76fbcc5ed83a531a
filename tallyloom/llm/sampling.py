"""Bounded samples of labelled rows, by hash, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAIN = 1 << 30


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def bounded_sample(rows: DataFrame, key: str, rows_at_most: int | dict, by: str) -> DataFrame:
    """About ``rows_at_most`` rows for each value of ``by``, drawn by a hash of ``key``; all values together never more than twice that.

    The shares come from one count per value, and one scan draws all values.
    """
    counts = {r[0]: r[1] for r in rows.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*")).collect()}
    place = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(GRAIN))
    most = {v: rows_at_most if isinstance(rows_at_most, int) else rows_at_most[v] for v in sorted(counts)}
    share = F.lit(0)
    for v, m in most.items():
        share = F.when(F.col(by) == v, int(GRAIN * min(1.0, m / counts[v]))).otherwise(share)
    return rows.filter(place < share).limit(2 * max(1, sum(most.values())))
