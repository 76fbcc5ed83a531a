"""Building blocks that keep ordered work off a single task.

A window without a partition key, or with one that a third of the rows share,
is sorted by one task. These helpers split the order into blocks first: each
block is scanned in parallel and only one short row per block crosses blocks.
The results equal the plain window exactly.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, part: list[str], order: str, value: str, out: str,
                  block_rows: int = 4096) -> DataFrame:
    """Last non-null ``value`` at or before each row, within ``part``."""
    df = df.withColumn("__b", F.floor(F.col(order) / block_rows))
    last = df.groupBy(*part, "__b").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("__last"))
    before = last.select(*part, "__b", F.last("__last", ignorenulls=True).over(
        Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inside = F.last(value, ignorenulls=True).over(
        Window.partitionBy(*part, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return (df.withColumn("__in", inside).join(before, [*part, "__b"])
            .withColumn(out, F.coalesce("__in", "__before")).drop("__b", "__in", "__before"))


def in_order(df: DataFrame, order: list[Column], part: list[str] | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """Adds ``rank_no`` in ``order`` within ``part``, running sums ``sums`` (new name -> column), ``group_rows``, and the total of each sum as ``<name>_total``.

    The whole order is cut into ranges by sampled bounds. A bound is a row, not a value, so equal
    leading values are split wherever the later columns of ``order`` differ. Rows that are equal in all of ``order`` keep
    together. Each range is scanned by one task; one short row for each range and group crosses ranges.
    """
    part, sums = part or [], sums or {}
    keys = [F.col(p).asc_nulls_first() for p in part] + order
    # written, because the bounds are sampled anew each time a plan is run
    placed = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    # a struct is equal to itself where it holds nulls, as groups are
    placed = placed.withColumn("__b", F.shiftright("__at", 33)).withColumn("__k", F.struct(*part) if part else F.lit(0))
    totals = placed.groupBy("__k", "__b").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    whole = Window.partitionBy("__k")
    prior = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__k", "__b", F.coalesce(F.sum("__n").over(prior), F.lit(0)).alias("__n0"), F.sum("__n").over(whole).alias("group_rows"),
        *[F.coalesce(F.sum(f"__t_{n}").over(prior), F.lit(0)).alias(f"__s_{n}") for n in sums], *[F.sum(f"__t_{n}").over(whole).alias(f"{n}_total") for n in sums])
    inside = Window.partitionBy("__k", "__b").orderBy("__at")
    until = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.select("*", F.row_number().over(inside).alias("__rn"), *[F.sum(c).over(until).alias(f"__r_{n}") for n, c in sums.items()]).join(offsets, ["__k", "__b"])
    done = rows.withColumn("rank_no", F.col("__rn") + F.col("__n0")).withColumns({n: F.coalesce(F.col(f"__r_{n}"), F.lit(0)) + F.col(f"__s_{n}") for n in sums})
    return done.drop("__at", "__b", "__k", "__rn", "__n0", *[f"__{k}_{n}" for n in sums for k in "rs"])


def ranked_running(df: DataFrame, value: str, ties: list[str], part: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Rank by ``value`` descending (then ``ties`` ascending) with running sums, equal values split by ``ties``.

    Adds ``rank_no``, ``running`` (of ``weight``, by default ``value``), ``group_rows`` and ``group_total``.
    """
    done = in_order(df, [F.desc(value), *[F.asc(t) for t in ties]], part, {"running": weight or value})
    return done.withColumnRenamed("running_total", "group_total")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables, in the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is missing, a session in local mode, which has one
    machine, gets a folder of its own for all its tables.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def package_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed (else it comes with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write and read back, so later steps survive lost executors cheaply."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut_lineage`` that no frame still to be run reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give rows that are small but slow to compute to every core.

    Adaptive execution sizes partitions by bytes; a year-long walk per row is
    a few bytes and much work, so the number of partitions is set here.
    """
    spark = df.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)
