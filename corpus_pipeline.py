"""From raw documents to token ids, in five stages.

Each stage works on all that its predecessor kept. Stages take and return the
columns of ``documents``, but for the last one, which returns token ids.

1. ``language_id`` drops documents whose language is rejected.
2. ``near_dedup`` keeps one document of each group of near copies (five-word
   shingles, similarity 0.8): the one with the smallest id. Rows with the same id and text are one document.
3. ``decontaminate`` drops documents that hold a passage of ``benchmark``.
4. ``redact`` replaces personal data by its kind, such as [EMAIL], and updates ``n_chars``.
5. ``tokenize`` encodes the texts and decodes them again.

A null or empty text has no language, so the first stage drops it; later stages keep it. Texts of any length are worked on whole. A null id is
an id of its own. Extra columns pass through all stages but the last. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, decontaminate, langid, minhash, pii
from tallyloom.llm.queries import VOCABULARY, on_workers, table
from tallyloom.llm.sampling import id_remainder
from tallyloom.operators.scale import work_dir


def begin(spark: SparkSession) -> None:
    """Prepare the workers, and free what the stages before hold.

    Spark deletes shuffle files, broadcasts and compiled plans once the driver's
    garbage is collected, and plans live as long as Python refers to them.
    """
    on_workers(spark)
    gc.collect()
    spark._jvm.System.gc()


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    model = langid.train(docs.filter(id_remainder(F.col("doc_id"), 5) != 0))
    return docs.filter(langid.identified(F.col("text"), model)["accepted"]).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    near = minhash.near_duplicates(docs)
    kept = near.filter("kept").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__rows"))
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__id")))
    once = rows.filter("__rows = 1")
    if near.filter("kept").groupBy("doc_id").count().filter("count > 1").head(1):
        once = once.union(rows.filter("__rows > 1").dropDuplicates(["doc_id", "text"]))
    return once.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    return docs.filter(~decontaminate.is_contaminated(F.col("text"), table(spark, sf_dir, "benchmark"))).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    found = pii.with_spans(docs, pii.train(docs), spans="__spans", base="__base")
    clean = found.withColumn("text", pii.redacted(F.col("text"), F.col("__spans")))
    return clean.withColumn("n_chars", F.when(F.size("__spans") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    rows = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), VOCABULARY)
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"), "ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("redact", redact), ("tokenize", tokenize)]

#: The stages learn models and hash signatures, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
