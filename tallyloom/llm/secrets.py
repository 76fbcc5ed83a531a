"""Secrets in every version of every document, through an incremental ledger of blobs.

A version of a document is addressed by the SHA-256 of its text. The ledger, a
folder of Parquet tables, remembers which (blob, rule, version) were scanned
and what was found. A scan takes each distinct text once, leaves out the rules
that the ledger has for it, appends the findings, and joins them back to all
paths that hold the blob. A rule is scanned anew under a new version only.

Base rules, each leftmost and without overlap: ``assign`` (a key word, = or :,
a value of six or more characters), ``access`` (AKIA and 16 or more capitals or
digits), ``hex`` (24 or more hexadecimal digits). Added rules: ``pem`` (head of
a private key) and ``jwt`` (three-part token).

Only DataFrame and SQL functions are used. A null text is an empty blob; a text
without secrets has empty spans. Texts of any length are scanned whole; an empty table gives no rows. Repeated rows share a blob and each get its
findings. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.spans import counted, digest, hits, placed, written


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    base: bool = True
    value_at_least: int = 0  # characters of the last group

    @property
    def label(self) -> str:
        return f"{self.name}@{self.version}"


# fixed values
RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", value_at_least=6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", base=False),
    Rule("jwt", 2, r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", base=False),
)

LEDGER = "blob string, rules array<string>, found array<struct<rule: string, kind: string, start: int, end: int>>"


def _known(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A table of the ledger, if it has been written."""
    fs = spark._jvm.org.apache.hadoop.fs
    where = fs.Path(path)
    return spark.read.schema(schema).parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def _spans(rule: Rule) -> Column:
    """Findings of a rule in column ``text``, whose matches are in column ``h_`` and its name."""
    spans = placed(F.col("text"), F.col(f"h_{rule.name}"), rule.pattern)
    if rule.value_at_least:
        spans = F.filter(spans, lambda s: F.char_length(F.regexp_extract(s["hit"], rule.pattern, 1)) >= rule.value_at_least)
    return F.transform(spans, lambda s: F.struct(F.lit(rule.label).alias("rule"), F.lit(rule.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
    """Scan what the ledger doesn't have yet, and append it: a row per blob with the rules that were run and their findings.

    Spark commits the rows of a scan together, so after a failure nothing of it is there and it can run again.
    """
    rows = versions.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    blobs = rows.withColumn("blob", blob_id(F.col("text"))).dropDuplicates(["blob"])
    every = F.array(*[F.lit(r.label) for r in rules])
    if (done := _known(versions.sparkSession, ledger, LEDGER)) is not None:
        seen = done.select("blob", F.explode("rules").alias("r")).groupBy("blob").agg(F.collect_set("r").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("todo") > 0)
    else:
        blobs = blobs.withColumn("todo", every)
    none = F.array().cast("array<string>")
    matched = blobs.select("blob", "todo", "text", *[F.when(F.array_contains("todo", r.label), hits(F.col("text"), r.pattern)).otherwise(none).alias(f"h_{r.name}") for r in rules])
    matched.select("blob", F.col("todo").alias("rules"), F.concat(*map(_spans, rules)).alias("found")).write.mode("append").parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans, base): findings of the given rule versions, by start and rule order, for blobs that have any."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.label), F.lit(i))])
    wanted = F.array(*[F.lit(r.label) for r in rules])
    base = F.array(*[F.lit(r.label) for r in rules if r.base])
    rows = spark.read.schema(LEDGER).parquet(ledger).filter(F.size("found") > 0)
    # a blob has a row for each scan that added a rule
    whole = rows.groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))
    keyed = F.transform(F.filter("found", lambda s: F.array_contains(wanted, s["rule"])), lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["rule"]).alias("no"), s["end"].alias("end"), s["kind"].alias("kind"), F.array_contains(base, s["rule"]).alias("base")))
    return whole.select("blob", F.array_sort(F.array_distinct(keyed)).alias("spans")).withColumn("base", F.filter("spans", lambda s: s["base"]))


def secrets_of(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, blob, spans and base spans of every row, after scanning what is new."""
    scan(docs, ledger, rules, text)
    paths = docs.select(F.col(doc_id).cast("long").alias("doc_id"), blob_id(F.col(text)).alias("blob"))
    return paths.join(findings(docs.sparkSession, ledger, rules), "blob", "left")


def report(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, digest of the base spans and all spans as text."""
    none = F.expr("cast(array() as array<struct<start: int, no: int, end: int, kind: string, base: boolean>>)")
    out = found.withColumn("spans", F.coalesce("spans", none)).withColumn("base", F.coalesce("base", none))
    counts = [counted(F.col("base"), k).alias(f"n_{k}") for k in kinds]
    return out.select("doc_id", *counts, digest(F.col("base")).alias("base_sha256"), written(F.col("spans")).alias("spans"))
