"""Exact top-k search by distributed histogram selection.

Everything is scored, block by block, against a broadcast block of queries of bounded size. Two rounds of global score
histograms locate each query's kth value: the first over the whole possible range, the second inside the bin that holds
it, until bins are one score wide (scores are integers). A last pass keeps scores above the kth value and, of those equal
to it, each task's smallest ids; ties go to the smaller id.

A task's own kth bin is a lower bound of the global one, so bins below it are not sent: at most about k rows a query
leave a task, and nothing is lost. Queries that exceed a block are handled block after block.

Defined results: vectors that are null, hold null or non-finite components, or have a null id or another length than
most take no part; ids name rows: of rows with one id the least vector asks, and rows of the query's own id are not its
candidates; for other queries repeated rows are candidates of their own; an empty table gives no rows. Scores must stay
below 2^63, as products are added in 64 bits where doubles would round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut

BINS = 256
QUERY_BLOCK = 4096
ROWS = 1024


def usable(vectors: DataFrame, id: str, vector: str, scale: float) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of rows whose components are all finite; decided in the JVM."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id).isNotNull() & F.col(vector).isNotNull() & fine & (F.size(vector) > 0)).select(
        F.col(id).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")
    )


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the right length as a matrix, and which they are."""
    n = np.asarray(pc.list_value_length(column))
    ok = np.flatnonzero(n == dim)
    return np.asarray(column.take(pa.array(ok)).flatten(), dtype=np.float64).reshape(len(ok), dim), ok


def _scores(q: np.ndarray, c: np.ndarray, exact: float) -> np.ndarray:
    """Integer inner products: float32 or float64 where every sum is exact, else 64-bit integers."""
    if exact < 2**24:
        return (q.astype(np.float32) @ c.T.astype(np.float32)).astype(np.int64)
    if exact < 2**53:
        return (q @ c.T).astype(np.int64)
    return (q.astype(np.int64) @ c.T.astype(np.int64)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            m, ok = _matrix(part.column("v"), dim)
            if len(ok):
                yield np.asarray(part.column("vec_id"), dtype=np.int64)[ok], m


def _histogram(shared, dim: int, k: int, exact: float):
    """Per task: (query, bin, n) of the bins from the highest down to the one with the task's own kth score."""

    def run(batches):
        ids, q, low, width = shared.value
        counts = np.zeros((len(q), BINS + 1), dtype=np.int64)
        floor = np.zeros(len(q), dtype=np.int64)
        seen = False
        for vec, m in _blocks(batches, dim):
            seen = True
            s = (_scores(q, m, exact) - low[:, None]) // width[:, None]
            np.clip(s, -1, BINS, out=s)  # the last bin counts what lies above the range
            s[ids[:, None] == vec[None, :]] = -1
            i, j = np.nonzero(s >= floor[:, None])
            counts += np.bincount(i * (BINS + 1) + s[i, j], minlength=counts.size).reshape(counts.shape)
            reached = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] >= k
            floor = np.where(reached.any(axis=1), BINS - np.argmax(reached[:, ::-1], axis=1), 0)
        if seen:
            i, b = np.nonzero((counts > 0) & (np.arange(BINS + 1)[None, :] >= floor[:, None]))
            for a in range(0, max(1, len(i)), 100_000):
                yield pa.record_batch({"q": pa.array(i[a : a + 100_000], pa.int32()), "bin": pa.array(b[a : a + 100_000], pa.int32()), "n": pa.array(counts[i, b][a : a + 100_000], pa.int64())})

    return run


def _select(shared, dim: int, k: int, exact: float):
    """Per task: all scores above each query's kth value and the task's k smallest ids among those equal to it."""

    def run(batches):
        ids, q, kth = shared.value
        tie_q, tie_v = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(i, v, s):
            return pa.record_batch({"query_id": pa.array(ids[i], pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})

        for vec, m in _blocks(batches, dim):
            s = _scores(q, m, exact)
            own = ids[:, None] == vec[None, :]
            i, j = np.nonzero((s > kth[:, None]) & ~own)
            if len(i):
                yield out(i, vec[j], s[i, j])
            i, j = np.nonzero((s == kth[:, None]) & ~own)
            if len(i):
                tie_q, tie_v = np.r_[tie_q, i], np.r_[tie_v, vec[j]]
                order = np.lexsort((tie_v, tie_q))
                tie_q, tie_v = tie_q[order], tie_v[order]
                first = np.searchsorted(tie_q, tie_q)
                keep = np.arange(len(tie_q)) - first < k
                tie_q, tie_v = tie_q[keep], tie_v[keep]
        if len(tie_q):
            yield out(tie_q, tie_v, kth[tie_q])

    return run


def _kth(histogram: DataFrame, n: int, k: int) -> np.ndarray:
    """Of each query the bin that holds its kth score, -1 if it has fewer; a row for each query of the block reaches the driver."""
    total = histogram.groupBy("q", "bin").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy("q").orderBy(F.desc("bin")))
    found = total.withColumn("upto", upto).where((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k))
    bins = np.full(n, -1, dtype=np.int64)
    for r in found.select("q", "bin").collect():
        bins[r.q] = r.bin
    return bins


def top_k(vectors: DataFrame, is_query, k: int = 20, id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which is_query holds, against all rows."""
    spark = vectors.sparkSession
    all_rows = cut(usable(vectors, id, vector, scale), "vectors")
    lengths = all_rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if lengths is None:
        return empty
    dim = lengths.d
    all_rows = all_rows.where(F.size("v") == dim)
    norm = all_rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 0.0
    queries = all_rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_blocks = max(1, -(-queries.count() // block))
    kept = None
    for b in range(n_blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).orderBy("vec_id").toArrow()  # about `block` rows
        if not mine.num_rows:
            continue
        ids = np.asarray(mine["vec_id"], dtype=np.int64)
        q = np.asarray(mine["v"].combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), dim)
        part = _block_top_k(all_rows, ids, q, k, dim, float(norm))
        if n_blocks > 1:  # a block's result is written, so that the plan does not grow with the queries
            part = cut(part, "top-k")
        kept = part if kept is None else kept.unionByName(part)
    if kept is None:
        return empty
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _block_top_k(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, dim: int, norm: float) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    own = np.sqrt((q * q).sum(axis=1))
    exact = float(own.max() * norm) * 1.001 + 1
    bound = np.ceil(own * norm * (1 + 1e-9)).astype(np.int64) + 1
    low, size = -bound, 2 * bound + 1
    few = np.zeros(len(ids), dtype=bool)
    while (size > 1).any():
        width = -(-size // BINS)
        shared = sc.broadcast((ids, q, low, width))
        bins = _kth(rows.mapInArrow(_histogram(shared, dim, k, exact), "q int, bin int, n long"), len(ids), k)
        few |= bins < 0  # fewer candidates than k: all of them are taken
        low, size = np.where(few, low, low + bins * width), np.where(few, 1, width)
    shared = sc.broadcast((ids, q, np.where(few, -bound - 1, low)))
    return rows.mapInArrow(_select(shared, dim, k, exact), "query_id long, vec_id long, score long")
