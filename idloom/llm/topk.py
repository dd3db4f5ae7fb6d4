"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped into buckets by length, longest first. For a query with the k-th best score theta so far,
a bucket whose longest vector is l can only matter if the cosine of a candidate reaches
theta / (|q| l), the bucket's local threshold. Above 1 the bucket is pruned by length; at a low threshold, where
hardly anything can be pruned, its candidates are cut by their own lengths; else by coordinates: on the query's
largest coordinates the partial product plus the product of the two remainders' lengths bounds the score. What remains is
verified by exact integer products.

Queries are dealt to blocks of bounded size. Blocks are collected and broadcast one after the other; each is matched against all
candidates, where they lie, and every task returns the k best of its candidates at most. A first bucket, the longest candidates,
gives a block's queries a threshold that all tasks start from. So the driver holds one block and that bucket, both of fixed bounds,
and plans don't grow with the number of queries.

Defined results: components x become floor(64 * x). Vectors that are null, or hold a null or non-finite component, and
rows with a null id take no part. Vectors of different lengths are compared as if filled up with zeros; an empty vector is
zero. A query isn't matched with rows of its own id. Ties go to the smaller id. Repeated rows are candidates, and
queries, of their own. Scores beyond the range of a long are clamped to it. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idloom.llm.common import table, written, written_all

K, SCALE = 20, 64
#: Queries of a block, candidates of the first bucket, candidates of a bucket in a task.
BLOCK, FIRST, BUCKET = 4096, 1024, 1024
#: Coordinates that a coordinate bound looks at, and the local threshold from which it is used.
FOCUS, COSINE = 16, 0.35
_EXACT = float(1 << 53)


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))


def usable(vector: Column) -> Column:
    """Neither null nor with a null, infinite or undefined component."""
    bad = F.exists(vector, lambda x: F.coalesce(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")), F.lit(True)))
    return F.coalesce(~bad, F.lit(False))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows filled up with zeros, or cut where the other side has only zeros, to width."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[at < width], at[at < width]] = values[at < width]
    return out


def products(queries: np.ndarray, candidates: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products; bound: the largest product of lengths."""
    if bound < _EXACT:
        return (queries @ candidates.T).astype(np.int64)
    q, c = ([[int(x) for x in row] for row in m] for m in (queries, candidates))
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([[max(low, min(high, sum(a * b for a, b in zip(x, y, strict=True)))) for y in c] for x in q], np.int64).reshape(len(q), len(c))


class Best:
    """The k best (score, id) of every query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * n
        self.ids = [np.zeros(0, np.int64)] * n

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.scores[q], scores)), np.concatenate((self.ids[q], ids))
        at = np.lexsort((i, -s.astype(np.float64) if len(s) and np.abs(s).max() < _EXACT else ~s))[: self.k]
        self.scores[q], self.ids[q] = s[at], i[at]

    def least(self, floor: np.ndarray) -> np.ndarray:
        own = np.array([float(s[-1]) if len(s) == self.k else -np.inf for s in self.scores])
        return np.maximum(own, floor)


def retrieve(q_ids: np.ndarray, queries: np.ndarray, c_ids: np.ndarray, candidates: np.ndarray, k: int, floor: np.ndarray | None = None) -> Best:
    """The k best candidates of every query that reach its floor; there may be fewer."""
    best = Best(len(q_ids), k)
    floor = np.full(len(q_ids), -np.inf) if floor is None else floor
    lengths = np.sqrt((candidates * candidates).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    c_ids, candidates, lengths = c_ids[order], candidates[order], lengths[order]
    q_lengths = np.sqrt((queries * queries).sum(axis=1))
    slack = 1 + 1e-9  # of the bounds, which are rounded
    for at in range(0, len(c_ids), BUCKET):
        c, ids, l = candidates[at : at + BUCKET], c_ids[at : at + BUCKET], lengths[at : at + BUCKET]
        theta = best.least(floor)
        with np.errstate(invalid="ignore", divide="ignore"):
            local = theta / (q_lengths * l[0])
        live = np.flatnonzero((theta <= 0) | (q_lengths * l[0] * slack >= theta))  # the others: pruned by length
        if not len(live):
            continue
        for coordinate in (False, True):
            some = live[(local[live] >= COSINE) == coordinate] if queries.shape[1] > FOCUS else live[:0] if coordinate else live
            for qs in (some[i : i + 256] for i in range(0, len(some), 256)):
                q, t = queries[qs], theta[qs]
                if coordinate:
                    # the coordinates on which this group of queries is largest
                    focus = np.argsort(-np.abs(q).sum(axis=0), kind="stable")[:FOCUS]
                    part = q[:, focus] @ c[:, focus].T
                    rest_q = np.sqrt(np.maximum(0, q_lengths[qs] ** 2 - (q[:, focus] ** 2).sum(axis=1)))
                    rest_c = np.sqrt(np.maximum(0, l**2 - (c[:, focus] ** 2).sum(axis=1)))
                    may = part + np.outer(rest_q, rest_c) * slack + 1e-6 >= t[:, None]
                    bucket = np.flatnonzero(may.any(axis=0))
                else:
                    bucket = np.flatnonzero((t.min() <= 0) | (l * q_lengths[qs].max() * slack >= t.min()))
                if not len(bucket):
                    continue
                got = products(q, c[bucket], float(q_lengths[qs].max() * l[0]))
                fits = (got >= t[:, None]) & (q_ids[qs][:, None] != ids[bucket][None, :])
                for row in np.flatnonzero(fits.any(axis=1)):
                    hit = np.flatnonzero(fits[row])
                    if len(hit) > 4 * k:  # enough to bound what the rest must reach, ties included
                        cut = np.partition(got[row][hit], len(hit) - k)[len(hit) - k]
                        hit = hit[got[row][hit] >= cut]
                    best.add(int(qs[row]), got[row][hit], ids[bucket][hit])
    return best


def top_k(rows: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row that is a query."""
    spark = rows.sparkSession
    kept = rows.filter(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("id"), integers(F.col(vector)).alias("v"), is_query.alias("q"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    kept = kept.withColumn("length", length)
    first = kept.orderBy(F.desc("length"), "id").limit(FIRST).select("id", "v").toArrow()
    asked = kept.filter("q").select("id", "v")
    blocks = -(-asked.count() // block)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = written(asked.withColumn("b", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int")).repartition("b"), "b")

    def parts() -> Iterator[DataFrame]:
        for b in range(blocks):
            own = asked.filter(F.col("b") == b).select("id", "v").toArrow()
            if own.num_rows:
                found, shared = _block(kept, own, first, k)
                # a row of the result for each query row: copies of a query have a number of their own, and a block has all of them
                best = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
                yield found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
                shared.unpersist()

    return next(parts()) if blocks == 1 else written_all(parts())


def _block(kept: DataFrame, own: pa.Table, first: pa.Table, k: int) -> tuple[DataFrame, Broadcast]:
    """The k best of each task's candidates for the queries of a block."""
    q_ids = own["id"].to_numpy()
    width = max([1, *own["v"].combine_chunks().value_lengths().to_pylist()])
    queries = matrix(own["v"], width)
    seed = retrieve(q_ids, queries, first["id"].to_numpy(), matrix(first["v"], width), k)
    floor = seed.least(np.full(len(q_ids), -np.inf))
    _, copy = np.unique(q_ids, return_inverse=True)
    copy = np.arange(len(q_ids)) - np.unique(copy, return_index=True)[1][copy]
    shared = kept.sparkSession.sparkContext.broadcast((q_ids, copy, queries, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, copy, queries, floor = shared.value
        held, rows = [], 0
        best = Best(len(q_ids), k)

        def settle() -> None:
            t = pa.Table.from_batches(held)
            got = retrieve(q_ids, queries, t["id"].to_numpy(), matrix(t["v"], queries.shape[1]), k, best.least(floor))
            for i, (s, v) in enumerate(zip(got.scores, got.ids, strict=True)):
                if len(s):
                    best.add(i, s, v)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 16 * BUCKET:
                settle()
                held, rows = [], 0
        if rows:
            settle()
        sizes = [len(s) for s in best.scores]
        at = np.repeat(np.arange(len(q_ids)), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(copy[at].astype(np.int32)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], names=["query_id", "copy", "vec_id", "score"])

    return kept.select("id", "v").mapInArrow(run, "query_id long, copy int, vec_id long, score long"), shared


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: 20 rows for each vec_id divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


QUERIES = {"op5_top_k": op5}
SQL = {
    "op5_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
}
