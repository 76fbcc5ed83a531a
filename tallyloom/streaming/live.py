"""The live tally path as Structured Streaming jobs.

Every job reads files, runs to the end of what is there (``availableNow``) or
keeps running, and leaves Parquet behind. A batch is reduced to one row per key
and added to a leveled table, in which a replayed batch counts once. There
is no watermark: a late row only adds to its key, whenever it comes. What is kept
between batches is that table, which folds its batches by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators.scale import work_dir
from tallyloom.streaming.leveled import Leveled

DAY = ["product_id", "day", "kind"]


def tally_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Tally rows of the arriving files of ``events.parquet``, which is a file or a folder of files."""
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    # a path with a glob may name a file as well as a folder
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}/events.parque[t]")
    return as_tally(raw)


def as_tally(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("user_id").alias("product_id"), F.col("ts").cast("timestamp").alias("ts"),
                         F.col("event_type").alias("kind"), F.floor("value").cast("long").alias("quantity"))


def write_batches(stream: DataFrame, name: str, reduced) -> Leveled:
    """Run the stream to the end; returns the table of ``reduced(batch)`` of every batch."""
    out = work_dir(stream.sparkSession, name)
    table = Leveled(stream.sparkSession, f"{out}/data", reduced)
    run(stream, table.append, f"{out}/checkpoint")
    return table


def run(stream: DataFrame, sink, checkpoint: str) -> None:
    q = stream.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def day_totals(rows: DataFrame) -> DataFrame:
    """Units and rows per product, day and kind; of rows, or of totals of several batches."""
    if "units" not in rows.columns:
        rows = rows.select("product_id", F.to_date("ts").alias("day"), "kind", F.col("quantity").alias("units"), F.lit(1).cast("long").alias("rows"))
    return rows.groupBy(*DAY).agg(F.sum("units").alias("units"), F.sum("rows").alias("rows"))


def live_days(stream: DataFrame, name: str = "days") -> DataFrame:
    """Day totals of everything that has arrived, late rows included."""
    return write_batches(stream, name, day_totals).rows()


def daily_units(days: DataFrame) -> DataFrame:
    return days.groupBy("product_id", "day").agg(F.sum("units").alias("units"))


def sliding_units(days: DataFrame, length: int = 28) -> DataFrame:
    """Units of every window of ``length`` days, by first day; works on one row per product and day."""
    daily = daily_units(days).withColumn("from_day", F.explode(F.sequence(F.date_sub("day", length - 1), "day")))
    return daily.groupBy("product_id", "from_day").agg(F.sum("units").alias("units"))


def session_runs(days: DataFrame, gap: str = "3 days") -> DataFrame:
    """Runs of active days; exactly ``gap`` apart still merges."""
    w = F.session_window(F.col("day").cast("timestamp"), gap)
    d = days.groupBy("product_id", "day").agg(F.sum("rows").alias("rows"))
    return d.groupBy("product_id", w.alias("w")).agg(F.min("day").alias("run_start"), F.max("day").alias("run_end"), F.sum("rows").alias("rows")).drop("w")


def newest_rows(rows: DataFrame) -> DataFrame:
    """Newest row per (product, kind); of rows, or of the newest rows of several batches."""
    return rows.groupBy("product_id", "kind").agg(F.max_by(F.struct("quantity", "event_id", "ts"), F.struct("ts", "event_id")).alias("l")).select("product_id", "kind", "l.*")


def latest_per_key(stream: DataFrame, name: str = "latest") -> DataFrame:
    return write_batches(stream, name, newest_rows).rows()


def ingest(stream: DataFrame, known: DataFrame, name: str = "ingest") -> str:
    """Split arriving rows into valid, quarantine and held sinks."""
    out = work_dir(stream.sparkSession, name)

    def sink(batch: DataFrame, batch_id: int) -> None:
        status = (F.when((F.col("quantity") < 0) | F.col("quantity").isNull() | (F.col("kind") == "error"), "quarantine")
                  .when(F.col("known").isNull(), "held").otherwise("valid"))
        judged = batch.join(known.select("product_id", F.lit(1).alias("known")), "product_id", "left").withColumn("status", status).drop("known")
        judged.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").partitionBy("status").parquet(f"{out}/rows/b={batch_id:09d}")

    run(stream, sink, f"{out}/checkpoint")
    return f"{out}/rows"


def stock_state(days: DataFrame, counts: DataFrame) -> DataFrame:
    """On-hand per product falls with sales and restarts with each month's
    count; a sale with nothing on hand marks the rest of the month unknown.

    One row per product and day, from the day totals of all batches. A hot
    product costs a window over a month's days, not over its rows.
    """
    d = days.filter("kind <> 'error'").groupBy("product_id", "day").agg(F.sum("units").alias("units")).withColumn("month", F.date_format("day", "yyyy-MM"))
    s = d.join(counts, ["product_id", "month"], "left")
    w = Window.partitionBy("product_id", "month").orderBy("day")
    s = s.withColumn("on_hand", F.col("counted") - F.coalesce(F.sum("units").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    broken = F.coalesce(F.max(((F.col("on_hand") <= 0) & (F.col("units") > 0)).cast("int")).over(w), F.lit(0))
    s = s.withColumn("broken", broken)
    return s.select("product_id", "month", "day", "on_hand", F.when(F.col("counted").isNotNull() & (F.col("broken") == 0), (F.col("on_hand") <= 0).cast("int")).alias("is_censored"))
