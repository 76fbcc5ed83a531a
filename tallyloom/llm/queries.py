"""One query for each operator, over its whole table."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import wraps
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import align, ann, bpe, decontaminate, langid, minhash, mixing, pii, records, secrets, toxicity, trie, warc
from tallyloom.llm.sampling import id_remainder
from tallyloom.llm.spans import counted, digest, written
from tallyloom.operators.scale import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed (else it comes with --py-files), and keep Arrow batches of texts small."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))):
        spark.conf.set(key, value)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        on_workers(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = table(spark, sf_dir, "labels").filter(id_remainder(F.col("doc_id"), 3) != 1)
    model = toxicity.train(docs, learn)
    held = docs.withColumn("held_out", id_remainder(F.col("doc_id"), 3) == 1)
    return toxicity.with_toxicity(held, model).select("doc_id", "held_out", "score", "predicted")


@query
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"))
    model = langid.train(docs.filter("not held_out"))
    return langid.with_language(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


@query
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that are near copies, on three-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


ORACLES["op3_minhash"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM sets),
e AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, edges.b FROM reach r JOIN edges ON edges.a = r.other)
SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach JOIN n USING (doc_id) GROUP BY doc_id"""


@query
def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as record files and read back."""
    rows = records.token_files(spark, table(spark, sf_dir, "documents"), VOCABULARY)
    # Spark's crc32 is unsigned, of the bytes as they are
    return rows.select("doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, with a new ledger."""
    found = secrets.secrets_of(table(spark, sf_dir, "documents"), work_dir(spark, "ledger"))
    return secrets.report(found, ("assign", "access", "hex"))


def _either_case(pattern: str) -> str:
    """Letters of a case-blind group as ASCII classes; the engine's own folding also takes a long s and the Kelvin sign."""
    return re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", pattern)


def _spans_sql(kind: str, no: int, pattern: str, base: bool, where: str = "true") -> str:
    quoted = _either_case(pattern).replace("'", "''")
    return f"""
SELECT doc_id, '{kind}' AS kind, {no} AS no, {base} AS base, hit, CAST(sum(gap + before) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS start, length(hit) AS n
FROM (SELECT doc_id, i, hits[i] AS hit, length(gaps[i]) AS gap, CASE WHEN i > 1 THEN length(hits[i - 1]) ELSE 0 END AS before
      FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
            FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS hits, string_split_regex(text, '{quoted}') AS gaps FROM d)))
QUALIFY {where}"""


ORACLES["op5_secrets"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_spans_sql(r.name, i, r.pattern, r.base, f"length(regexp_extract(hit, '{_either_case(r.pattern).replace(chr(39), chr(39) * 2)}', 1)) >= {r.value_at_least}" if r.value_at_least else "true") for i, r in enumerate(secrets.RULES))}),
s AS (SELECT *, kind || ':' || start || ':' || (start + n) AS w FROM f)
SELECT d.doc_id, CAST(count(*) FILTER (kind = 'assign') AS BIGINT) AS n_assign, CAST(count(*) FILTER (kind = 'access') AS BIGINT) AS n_access, CAST(count(*) FILTER (kind = 'hex') AS BIGINT) AS n_hex,
       sha256(coalesce(string_agg(w, ',' ORDER BY start, no) FILTER (base), '')) AS base_sha256, coalesce(string_agg(w, ',' ORDER BY start, no), '') AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""


@query
def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage: one row per document and item."""
    return decontaminate.contaminated_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_spans(docs, pii.train(docs))
    return found.select("doc_id", *[counted(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS], digest(F.col("base")).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an archive record, read back."""
    return warc.archived(spark, table(spark, sf_dir, "pages")).drop("url")


ORACLES["op9_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first FROM h GROUP BY hex),
bits AS (SELECT hex, list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', hex[i]) - 1), 4, '0')), lambda a, c: a || c) AS b FROM f)
SELECT h.page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
           list_reduce(list_transform(range(1, 6), lambda j: CAST(b[5 * i + j] AS INTEGER)), lambda x, y: 2 * x + y) + 1]), lambda x, y: x || y) AS payload_digest,
       CASE WHEN h.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN h.page_id = f.first THEN NULL ELSE f.first END AS refers_to
FROM h JOIN f USING (hex) JOIN bits USING (hex)"""


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the text decoded from them."""
    rows = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct beginnings of the rebuilt conversations, with sums over what continues them."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


# crc32 bit by bit: each byte is followed by eight shifts
ORACLES["op11_prefix_trie"] = r"""
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER w - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM (SELECT *, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS sha FROM conversations WHERE conv_id IS NOT NULL)
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
             xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                 lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, i, 0 AS own, role, text FROM c JOIN t ON t.conv_id = base AND i < h UNION ALL SELECT c.conv_id, i, 1, role, text FROM c JOIN t USING (conv_id) WHERE i >= h),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth, [role, text] AS said, text FROM r),
l AS (SELECT conv_id, coalesce(max(depth), 0) AS len FROM c LEFT JOIN n USING (conv_id) GROUP BY conv_id),
k AS (SELECT conv_id, depth, text, list(said) OVER (PARTITION BY conv_id ORDER BY depth) AS seq FROM n UNION ALL SELECT conv_id, 0, '', [] FROM c),
m AS (SELECT conv_id, depth, text, min(conv_id) OVER (PARTITION BY depth, seq) AS node FROM k),
v AS (SELECT node, depth, count(*) AS n, any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS words, count(*) FILTER (depth = len) AS ends,
             coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = len), '') AS who FROM m JOIN l USING (conv_id) GROUP BY node, depth),
p AS (SELECT DISTINCT a.node, a.depth, b.node AS parent FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth = a.depth - 1),
s AS (SELECT node, depth, sum(leaf) AS n_leaves, sum(saved) AS saved FROM (
        SELECT DISTINCT a.node, a.depth, b.node AS below, b.depth AS at, CASE WHEN v.n = v.ends THEN 1 ELSE 0 END AS leaf, (v.n - 1) * v.words AS saved
        FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth >= a.depth JOIN v ON v.node = b.node AND v.depth = b.depth) GROUP BY node, depth)
SELECT v.node AS conv_id, CAST(v.depth AS BIGINT) AS depth, p.parent AS parent_conv_id, n AS n_convs, (SELECT count(*) FROM p q WHERE q.parent = v.node AND q.depth = v.depth + 1) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(who) AS ends_sha256
FROM v LEFT JOIN p ON p.node = v.node AND p.depth = v.depth JOIN s ON s.node = v.node AND s.depth = v.depth"""


@query
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' weights: 150 % of all words, nothing more than twice."""
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLES["op12_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5('12:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place FROM documents),
n AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w FROM d GROUP BY source),
l AS (SELECT *, 2 * source_size AS cap, 2 * source_size / w AS level FROM n),
r AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             >= level * sum(w) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled, sum(source_size) OVER () AS every FROM l),
g AS (SELECT source, source_size, CASE WHEN filled THEN CAST(cap AS DOUBLE) ELSE (1.5::DOUBLE * every - coalesce(sum(cap) FILTER (filled) OVER (), 0)) * w / (sum(w) FILTER (NOT filled) OVER ()) END AS target,
             CAST((source_size + 31) // 32 AS BIGINT) AS blocks FROM r),
q AS (SELECT source, target / (2 * k + 1) AS quotient FROM (SELECT source, target, unnest(range(0, 2 * blocks)) AS k FROM g WHERE target > 0)),
won AS (SELECT source, count(*) AS seats FROM (SELECT source FROM q ORDER BY quotient DESC, source NULLS LAST LIMIT (SELECT CAST(floor(sum(target) / 32 + 0.5) AS BIGINT) FROM g)) GROUP BY source),
h AS (SELECT source, seats, shard, least(1024, blocks - 1024 * shard) AS m,
             CAST('0x' || substr(md5('12:' || coalesce(source, '') || ':' || shard), 1, 15) AS BIGINT) AS draw
      FROM (SELECT g.source, coalesce(seats, 0) AS seats, blocks, unnest(range(0, (blocks + 1023) // 1024)) AS shard FROM g LEFT JOIN won ON won.source IS NOT DISTINCT FROM g.source)),
hq AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY m / (2 * k + 1) DESC, draw, shard) <= seats AS got FROM (SELECT *, unnest(range(0, 2 * m)) AS k FROM h)),
quota AS (SELECT source, shard, any_value(m) AS m, count(*) FILTER (got) AS quota FROM hq GROUP BY source, shard),
b AS (SELECT source, 1024 * shard + j AS block,
             quota // m + CASE WHEN row_number() OVER (PARTITION BY source, shard ORDER BY CAST('0x' || substr(md5('12:' || coalesce(source, '') || ':' || shard || ':' || j), 1, 15) AS BIGINT), j) <= quota % m THEN 1 ELSE 0 END AS times
      FROM (SELECT *, unnest(range(0, m)) AS j FROM quota)),
line AS (SELECT *, until - size AS start FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS until FROM d)),
t AS (SELECT line.source, line.start, CAST(sum(times * (least(until, 32 * block + 32) - greatest(start, 32 * block))) AS BIGINT) AS taken
      FROM (SELECT *, unnest(range(start // 32, (until + 31) // 32)) AS block FROM line WHERE size > 0) line JOIN b USING (block) WHERE line.source IS NOT DISTINCT FROM b.source GROUP BY ALL)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN taken ELSE 0 END AS taken
FROM line JOIN g ON g.source IS NOT DISTINCT FROM line.source LEFT JOIN t ON t.source IS NOT DISTINCT FROM line.source AND t.start = line.start AND line.size > 0"""


@query
def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of a byte-level and a piece vocabulary in every document."""
    rows = align.align(table(spark, sf_dir, "documents"), VOCABULARY, PIECES, written=False)
    return rows.withColumnRenamed("groups", "groups_sha256")
