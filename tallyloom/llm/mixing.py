"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. *Targets.* Sources, by code point and null last, weigh 3, 1, 2 and so on in
   turn, and share ``epochs`` times all words. A target stops at ``repeats`` times its source's
   size; the excess goes to the others by weight. With sources ordered by the
   level at which they fill up, running sums give the filled ones in one pass.
2. *Seats.* The words to take make a number of seats, one for each block of
   ``BLOCK`` words. They go to the highest quotients target / (2 k + 1), k = 0, 1, ... of
   all sources. Between the divisors words / (seats + n / 2) and words / (seats - n / 2), for n sources,
   lie all quotients that are in doubt, about two a source: the seats above are
   given at once, and only those in doubt are ranked. A source never gets more seats than
   ``repeats`` times its blocks; where that binds, some seats stay empty, less than one a source.
3. *Shards.* A source's documents lie on a line of words in an order drawn from ``seed``;
   ``BLOCKS`` blocks are a shard. A source's seats go to its shards by the same rule, with blocks
   as votes, which gives each shard an integer quota.
4. *Blocks.* Within a shard all blocks are taken quota // blocks times and the rest of the
   quota once more, by drawn order. What a document has taken are its words
   under taken blocks, so never more than ``repeats`` times its size.

Only DataFrame and SQL functions are used. A shard holds a bounded number of words, and a source's
line is summed in 1,024 buckets, so a source with most of the rows is spread. Runs with one seed
agree; a document's place depends on its id and the seed only.

A null text has size 0, as has an empty one; documents without words take nothing. A null source is a
source, the last one. Rows with the same id and size are interchangeable, others with the same id are
ordered by size. A text of any length spans as many shards as it needs. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.scale import cut_lineage, in_order, spread

WEIGHTS = (3, 1, 2)
BLOCK = 32  # words
BLOCKS = 1024  # in a shard
BUCKET_BITS = 10
WORD = r"[^\x20\x09-\x0D]+"


def drawn(*parts: Column | str) -> Column:
    """A number of 60 bits drawn from the given values."""
    text = F.concat_ws(":", *[F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size and drawn place of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                       F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return rows.withColumn("place", drawn(str(seed), F.col("doc_id")))


def targets(sources: DataFrame, epochs: float, repeats: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to rows of source and source_size."""
    turn = F.array(*map(F.lit, weights))[((F.col("rank_no") - 1) % len(weights)).cast("int")]
    weighed = in_order(sources, [F.asc_nulls_last("source")]).withColumn("weight", turn).select("source", "source_size", "weight")
    level = weighed.withColumn("cap", repeats * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    run = in_order(level, [F.asc("level"), F.asc_nulls_last("source")], sums={"caps": "cap", "weights": "weight", "sizes": "source_size"})
    # words and weights that are left to this source and those that fill up at a higher level
    words = epochs * F.col("sizes_total") - (F.col("caps") - F.col("cap"))
    run = run.withColumn("full", words >= F.col("level") * (F.col("weights_total") - F.col("weights") + F.col("weight"))).withColumn("__part", F.lit(0))
    taken = run.groupBy("__part").agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0)).alias("__caps"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("__rest"))
    share = (epochs * F.col("sizes_total") - F.col("__caps")) * F.col("weight") / F.col("__rest")
    return spread_join(run, taken, "__part").select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def apportion(rows: DataFrame, votes: str, most: str, seats: str, order: list[Column], part: list[str] | None = None) -> DataFrame:
    """Adds ``quota``: ``seats`` of each ``part`` given to its rows by the highest quotients votes / (2 k + 1), ties by ``order``.

    ``seats`` is the same on all rows of a part; ``most`` bounds the seats of a row.
    """
    part = part or []
    rows = rows.withColumn("__part", F.struct(*part) if part else F.lit(0))
    sums = rows.filter(F.col(votes) > 0).groupBy("__part").agg(F.sum(votes).alias("__votes"), F.count("*").alias("__n"))
    known = spread_join(rows, sums, "__part")

    def rounded(divisor: Column) -> Column:
        # quotients of at least 1 / 2 of the divisor: votes / (2 k + 1) >= divisor / 2
        return F.least(F.floor(F.col(votes) / divisor + 0.5), F.col(most)).cast("long")

    most_sure = F.col(seats) - F.col("__n") / 2
    sure = F.when((most_sure > 0) & (F.col(votes) > 0), rounded(F.col("__votes") / most_sure)).otherwise(0)
    doubt = F.when((F.col(seats) > 0) & (F.col(votes) > 0), rounded(F.col("__votes") / (F.col(seats) + F.col("__n") / 2))).otherwise(0)
    # one more on each side, as divisions are rounded
    known = known.withColumn("__sure", F.greatest(F.coalesce(sure, F.lit(0)) - 1, F.lit(0))).withColumn("__upto", F.least(F.coalesce(doubt, F.lit(0)) + 1, F.col(most)))
    known = cut_lineage(known.withColumn("__row", F.monotonically_increasing_id()).drop("__votes", "__n"), "apportion")
    given = known.groupBy("__part").agg(F.sum("__sure").alias("__given"))
    names = [f"__o{i}" for i in range(len(order))]
    offers = known.filter("__upto > __sure").select("__part", "__row", F.col(seats).alias("__seats"), F.col(votes).alias("__v"), *[c.alias(n) for c, n in zip(order, names)], F.explode(F.sequence("__sure", F.col("__upto") - 1)).alias("__k"))
    ranked = in_order(offers.withColumn("__q", F.col("__v") / (2 * F.col("__k") + 1)), [F.desc("__q"), *[F.asc_nulls_last(n) for n in names]], ["__part"])
    won = spread_join(ranked, given, "__part").filter(F.col("rank_no") <= F.col("__seats") - F.col("__given")).groupBy("__row").agg(F.count("*").alias("__won"))
    return known.join(won, "__row", "left").withColumn("quota", F.col("__sure") + F.coalesce("__won", F.lit(0))).drop("__row", "__sure", "__upto", "__won", "__part")


def spread_join(rows: DataFrame, groups: DataFrame, key: str, slices: int = 64) -> DataFrame:
    """Left join of rows with the one row of their group, over so many tasks for each group."""
    copies = groups.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    sliced = rows.withColumn("__slice", F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(slices)).cast("int"))
    return sliced.join(copies, [key, "__slice"], "left").drop("__slice")


def _planned(shards: DataFrame, seed: int) -> DataFrame:
    """Adds ``times``: how often each block of a shard is taken."""
    each, once_more = F.floor(F.col("quota") / F.col("m")).cast("int"), (F.col("quota") % F.col("m")).cast("int")
    draws = F.transform(F.sequence(F.lit(0), F.col("m").cast("int") - 1), lambda j: F.struct(drawn(str(seed), F.col("source"), F.col("shard"), j).alias("draw"), j.alias("j")))
    # variables of lambdas are computed once, columns wherever they are used
    last = F.transform(F.array(draws), lambda d: F.struct(d.alias("draws"), F.when(once_more > 0, F.get(F.array_sort(d), once_more - 1)).alias("last")))
    times = F.transform(last, lambda x: F.transform(x["draws"], lambda d: each + F.coalesce(d <= x["last"], F.lit(False)).cast("int")).cast("array<tinyint>"))
    return spread(shards, "source", "shard").withColumn("times", F.get(times, F.lit(0)))


def mix(docs: DataFrame, epochs: float = 1.5, repeats: int = 2, seed: int = 12, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every row."""
    # a struct is equal to itself where it holds null
    rows = cut_lineage(sized(docs, seed), "sized").select("doc_id", "size", "place", F.struct("source").alias("s"), F.shiftright("place", 60 - BUCKET_BITS).cast("int").alias("bucket"))
    buckets = rows.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
    sources = buckets.groupBy("s").agg(F.sum("words").alias("source_size")).select("s.source", "source_size")
    goal = targets(sources, epochs, repeats, weights).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long")).withColumn("most", repeats * F.col("blocks")).withColumn("__part", F.lit(0))
    seats = goal.groupBy("__part").agg(F.floor(F.sum("target") / BLOCK + 0.5).cast("long").alias("seats"))
    goal = apportion(spread_join(goal, seats, "__part"), "target", "most", "seats", [F.col("source")])
    goal = cut_lineage(goal.select(F.struct("source").alias("s"), "source_size", "target", "blocks", F.col("quota").alias("seats")), "goal")

    parts = goal.filter("blocks > 0").select("s.source", "seats", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / BLOCKS).cast("long"))).alias("shard"))
    parts = parts.withColumn("m", F.least(F.lit(BLOCKS), F.col("blocks") - F.col("shard") * BLOCKS)).withColumn("most", repeats * F.col("m"))
    quotas = apportion(parts, "m", "most", "seats", [drawn(str(seed), F.col("source"), F.col("shard")), F.col("shard")], ["source"])
    plan = _planned(quotas, seed).select(F.struct("source").alias("s"), "shard", "times")

    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(goal.select("s", "source_size", "target"), "s")
    inside = Window.partitionBy("s", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    lines = rows.withColumn("until", F.sum("size").over(inside)).join(starts, ["s", "bucket"]).withColumn("end", F.col("before") + F.col("until"))
    lines = cut_lineage(lines.select("doc_id", "size", "source_size", "target", "s", (F.col("end") - F.col("size")).alias("start"), "end"), "lines")

    span = BLOCK * BLOCKS
    first, last = F.floor(F.col("start") / span), F.floor((F.col("end") - 1) / span)
    held = lines.filter("size > 0").withColumn("shard", F.explode(F.sequence(first, last))).withColumn("alone", first == last).join(plan.hint("merge"), ["s", "shard"])
    lo, hi = F.greatest("start", F.col("shard") * span) - F.col("shard") * span, F.least("end", (F.col("shard") + 1) * span) - F.col("shard") * span
    held = held.withColumn("lo", lo).withColumn("hi", hi)
    blocks = F.sequence(F.floor(F.col("lo") / BLOCK).cast("int"), F.floor((F.col("hi") - 1) / BLOCK).cast("int"))
    taken = F.aggregate(blocks, F.lit(0).cast("long"), lambda n, j: n + F.get(F.col("times"), j) * (F.least(F.col("hi"), (j + 1) * BLOCK) - F.greatest(F.col("lo"), j * BLOCK)))
    names = ["doc_id", "size", "source_size", "target"]
    held = held.select(*names, "s", "start", "alone", taken.alias("taken"))
    # only documents that cross shards are put together; a place on the line is one document's
    crossing = held.filter("not alone").groupBy("s", "start", *names).agg(F.sum("taken").alias("taken"))
    wordless = lines.filter("size = 0").select(*names, F.lit(0).cast("long").alias("taken"))
    return held.filter("alone").select(*names, "taken").union(crossing.select(*names, "taken")).union(wordless)
