"""Approximate nearest neighbours by a permutation index.

*Index.* A bounded number of pivots is drawn from the vectors. A vector is
represented by the order of all pivots by distance, one byte per pivot, and is
posted in the inverted files of its ``posted`` nearest pivots. The files are a
table dealt by (pivot, part), so that a pivot with many vectors is split.

*Search.* Queries are taken in blocks of bounded size. A query reads the files
of its ``probed`` nearest pivots; a vector that it meets in several is taken in the
first. Vectors are ranked by footrule distance, the sum of differences of
pivot places. A first pass counts them by footrule; the place where ``share`` of the indexed
vectors, and at least ``reranked``, are reached is the query's bound. A second pass takes all within the bound and
ranks them by exact Euclidean distance in double precision. Each task keeps the k nearest of
each query, so nothing larger is shuffled. Queries that meet fewer vectors than
they should rerank read all files, so small tables are searched whole.

Rows that are null, zero, or hold null or non-finite components take no part,
nor do vectors of another length than most. Of equal vectors, the k + 1 with the smallest ids are
indexed, as no query can return more of them; all can be queries. Equal rows
count once. Fewer candidates than k are all returned. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.scale import cut_lineage

PIVOTS = 128
BIN = 16  # width of the footrule counts
FOUND = "query_id long, vec_id long, score double"


def places(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Place of each pivot in each vector's order; equal distances go by pivot number."""
    far = (pivots * pivots).sum(1)[None] - 2 * vectors @ pivots.T
    order = np.argsort(far, axis=1, kind="stable")
    out = np.empty(order.shape, np.uint8)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(len(pivots), dtype=np.uint8), order.shape), 1)
    return out


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Distinct (vec_id, v) rows that take part."""
    v = F.col(embedding).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & good).distinct()
    size = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (size[0].n if size else 0))


def build(rows: DataFrame, k: int, posted: int, kind: str, parts: int = 8) -> tuple[DataFrame, np.ndarray, int]:
    """The inverted files, the pivots and the number of indexed vectors. ``kind``: numpy type that holds the components exactly."""
    same = Window.partitionBy("v").orderBy("vec_id")
    kept = cut_lineage(rows.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1), "vectors")
    drawn = kept.filter("n = 1").orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(PIVOTS).collect()
    pivots = np.array([r.v for r in drawn], np.float64)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = matrix(batch.column(1))
            own = places(vectors, pivots)
            row, pivot = np.nonzero(own < posted)
            yield pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), batch.column(0).take(pa.array(row)),
                                              pa.array([own[r].tobytes() for r in row.tolist()], pa.binary()), pa.array([vectors[r].astype(kind).tobytes() for r in row.tolist()], pa.binary())], ["pivot", "vec_id", "places", "vector"])

    files = kept.select("vec_id", "v").mapInArrow(post, "pivot int, vec_id long, places binary, vector binary") if len(pivots) else \
        kept.select(F.lit(0).alias("pivot"), "vec_id", F.lit(b"").alias("places"), F.lit(b"").alias("vector")).limit(0)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = files.repartition(n, "pivot", F.pmod(F.xxhash64("vec_id"), F.lit(parts))).sortWithinPartitions("pivot")
    return cut_lineage(files, "inverted-files"), pivots, kept.count()


class Block:
    """Some queries, and how they read a batch of the inverted files."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, posted: int, probed: int, kind: str):
        self.ids, self.vectors, self.posted, self.kind = ids, vectors, posted, kind
        self.places = places(vectors, pivots)
        self.probes = np.argsort(self.places, axis=1)[:, :probed]
        self.readers: list[list[tuple[int, int]]] = [[] for _ in range(len(pivots))]
        for q, own in enumerate(self.probes.tolist()):
            for j, p in enumerate(own):
                self.readers[p].append((q, j))

    def read(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(query, rows of the batch, their footrule distances) for every list in the batch."""
        pivot = batch.column(0).to_numpy()
        ids = batch.column(1).to_numpy()
        own = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
        wide = own.astype(np.int16)
        for p in np.unique(pivot).tolist():
            rows = np.flatnonzero(pivot == p)
            for q, j in self.readers[p]:
                some = rows[ids[rows] != self.ids[q]]
                if j:  # met before in the file of a nearer pivot
                    some = some[~(own[np.ix_(some, self.probes[q, :j])] < self.posted).any(axis=1)]
                if len(some):
                    yield q, some, np.abs(wide[some] - self.places[q]).sum(axis=1, dtype=np.int32)


def _search(files: DataFrame, block: Block, k: int, reranked: int) -> tuple[DataFrame, np.ndarray]:
    """Nearest rows by task for each query of the block, and how many vectors each query met."""
    n_bins = PIVOTS * PIVOTS // 2 // BIN + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(block.ids), n_bins), np.int64)
        for batch in batches:
            if len(batch):
                for q, _, footrule in block.read(batch):
                    total[q] += np.bincount(footrule // BIN, minlength=n_bins)
        q, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(total[q, b])], ["q", "b", "n"])

    met = np.zeros((len(block.ids), n_bins), np.int64)
    # bounded by the block: one row per query and footrule step
    for r in files.mapInArrow(count, "q long, b long, n long").groupBy("q", "b").agg(F.sum("n").alias("n")).collect():
        met[r.q, r.b] = r.n
    bound = (np.cumsum(met, axis=1) < reranked).sum(axis=1)  # the step in which enough are reached

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column(1).to_numpy()
            vectors = np.frombuffer(b"".join(batch.column(3).to_pylist()), block.kind).reshape(len(ids), -1)
            for q, rows, footrule in block.read(batch):
                rows = rows[footrule // BIN <= bound[q]]
                if len(rows):
                    d = np.sqrt(((vectors[rows].astype(np.float64) - block.vectors[q]) ** 2).sum(axis=1))
                    names = ids[rows]
                    if q in best:
                        d, names = np.concatenate([best[q][0], d]), np.concatenate([best[q][1], names])
                    order = np.lexsort((names, d))[:k]
                    best[q] = d[order], names[order]
        if best:
            own = [np.full(len(d), block.ids[q]) for q, (d, _) in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.concatenate([x[1] for x in best.values()])), pa.array(np.concatenate([x[0] for x in best.values()]))], ["query_id", "vec_id", "score"])

    return files.mapInArrow(rerank, FOUND), met.sum(axis=1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, posted: int = 6, probed: int = 24, reranked: int = 1500, block: int = 1024,
            share: float = 0.03, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the nearest found of each query; ``queries`` are rows of the same form."""
    rows = usable(vectors, vec_id, embedding)
    kind = "<f4" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "<f8"
    files, pivots, size = build(rows, k, posted, kind)
    reranked = max(reranked, ceil(share * size))
    asked = cut_lineage(usable(queries, vec_id, embedding), "queries")
    total = asked.count()
    out = vectors.sparkSession.createDataFrame([], FOUND)
    blocks = max(1, -(-total // block))
    for b in range(blocks if len(pivots) else 0):
        some = sorted((r.vec_id, r.v) for r in asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect())
        some = [x for x in some if len(x[1]) == pivots.shape[1]]
        todo, reach = np.arange(len(some)), probed
        while len(todo):
            own = Block(np.array([some[i][0] for i in todo]), np.array([some[i][1] for i in todo], np.float64), pivots, posted, reach, kind)
            found, met = _search(files, own, k, reranked)
            short = met < min(reranked, size - 1)
            if reach >= len(pivots) or not short.any():
                short[:] = False
            ready = [int(x) for x in own.ids[~short]]
            out = out.union(found if not short.any() else found.filter(F.col("query_id").isin(ready)))
            todo, reach = todo[short], len(pivots)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
