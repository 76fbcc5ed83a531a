"""Registry of named queries and the SQL each one is checked against.

A query is registered with an output spec such as ``"sku:s units:l rate:d6"``.
The spec pins column order, type and rounding on both sides, so a query and
its SQL twin cannot drift apart in names or types.

Type codes: ``l`` long, ``dN`` double rounded to N places, ``s`` string,
``D`` date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.scale import package_on_workers
from tallyloom.plans.prelude import PRELUDE
from tallyloom.sources.star import Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.rsplit(":", 1)) for part in spec.split()]


def conform(df: DataFrame, spec: str) -> DataFrame:
    """Select the spec's columns with the spec's types."""
    out = []
    for name, code in _columns(spec):
        col = F.col(f"`{name}`")
        if code == "l":
            col = col.cast("long")
        elif code == "D":
            col = col.cast("date")
        elif code == "s":
            col = col.cast("string")
        else:
            # + 0.0 turns a negative zero into zero
            col = F.round(col.cast("double"), int(code[1:])) + F.lit(0.0)
        out.append(col.alias(name))
    return df.select(*out)


def conform_sql(body: str, spec: str) -> str:
    out = []
    for name, code in _columns(spec):
        if code == "l":
            expr = f'CAST("{name}" AS BIGINT)'
        elif code == "D":
            expr = f'CAST("{name}" AS DATE)'
        elif code == "s":
            expr = f'CAST("{name}" AS VARCHAR)'
        else:
            expr = f'round(CAST("{name}" AS DOUBLE), {int(code[1:])}) + 0.0'
        out.append(f'{expr} AS "{name}"')
    body = body.strip().rstrip(";")
    # a body that starts with WITH contributes its own CTEs after the prelude
    if body[:5].upper() == "WITH ":
        loops = body.startswith("WITH RECURSIVE ")
        ctes = (PRELUDE.replace("WITH ", "WITH RECURSIVE ", 1) if loops else PRELUDE) + ",\n" + body[15 if loops else 5:]
        cut = ctes.rfind("\nSELECT")
        ctes, final = ctes[:cut], ctes[cut:]
        return f"{ctes},\n__q AS ({final})\nSELECT {', '.join(out)} FROM __q"
    return f"{PRELUDE},\n__q AS ({body})\nSELECT {', '.join(out)} FROM __q"


def plan(name: str, spec: str, sql: str | None = None):
    """Register ``fn(star) -> DataFrame`` as query ``name``."""

    def wrap(fn: Callable[[Star], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            package_on_workers(spark)
            return conform(fn(Star(spark, sf_dir)), spec)

        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = conform_sql(sql, spec)
        return fn

    return wrap
