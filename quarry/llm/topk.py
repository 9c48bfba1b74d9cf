"""Exact top-k search by exhaustive term-at-a-time accumulation.

The rows are cut into blocks and the queries into blocks; each pair of blocks is one task group.
In it, every row block has one postings list for each component (term), and each query, a sparse
row of (component, weight), scatters weight times posting into a dense array of scores, one term
at a time.  A partition selection keeps the k best of the block for each query, and the blocks'
winners are merged.  Every row meets every query, in groups of bounded bytes and work, whatever the vectors' length.

Scores are integer inner products of floor(scale * x); missing components count as 0.  Ties go to
the smaller vec_id.

Edge cases: vectors that are null, or hold a null or non-finite component, take no part as query or
candidate, as do those without a vec_id; a query has no candidate with its own vec_id, so repeated
rows of a query don't find each other, while repeated candidates are listed each; a repeated query
is answered once, for the least of its vectors; components so large that a score could need more than 63 bits raise
an OverflowError; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Components of a block of rows, at most about (64 MB as 64-bit numbers), and products of a pair of blocks.  Rows are copied once
#: for each block of queries, so blocks are large; both are counted in components, so long vectors make blocks of fewer rows.
BLOCK_COMPONENTS = 1 << 23
BLOCK_PRODUCTS = 1 << 36


def quantised(vectors: DataFrame, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and weights (array<long>) of the rows that take part."""
    value = F.col(embedding).cast("array<double>")
    fit = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.where(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull())
        .where(fit)
        .select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(value, lambda x: F.floor(x * float(scale))).alias("weights"))
    )


def _accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of all queries and rows: for each term, weights times postings are added up."""
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if bound >= 1 << 63:
        raise OverflowError("scores need more than 63 bits")
    kind = np.int32 if bound < 1 << 31 else np.int64
    queries = queries.astype(kind)
    scores = np.zeros((len(queries), len(rows)), dtype=kind)
    scratch = np.empty(len(rows), dtype=kind)
    postings = []
    for term in range(rows.shape[1]):
        where = np.flatnonzero(rows[:, term])
        dense = 2 * len(where) > len(rows)
        postings.append((None if dense else where, rows[:, term].astype(kind) if dense else rows[where, term].astype(kind)))
    for q, weights in enumerate(queries):
        acc = scores[q]
        for term in np.flatnonzero(weights).tolist():
            where, values = postings[term]
            if where is None:
                np.multiply(values, weights[term], out=scratch)
                np.add(acc, scratch, out=acc)
            else:
                acc[where] += values * weights[term]
    return scores


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id; ids ascend."""
    if own is not None:
        allowed = np.flatnonzero(ids != own)
    else:
        allowed = np.arange(len(ids))
    found = scores[allowed]
    if len(found) > k:
        least = np.partition(found, len(found) - k)[len(found) - k]
        above = np.flatnonzero(found > least)
        level = np.flatnonzero(found == least)[: k - len(above)]
        chosen = allowed[np.concatenate((above, level))]
    else:
        chosen = allowed
    return chosen[np.lexsort((ids[chosen], -scores[chosen].astype(np.int64)))]


def _dense(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix, filled up with zeros."""
    lists = pa.concat_arrays(column.chunks)
    ends = lists.offsets.to_numpy()
    values, lengths = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.diff(ends)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = values  # row by row, as the values are
    return out


def blocks(rows: int, queries: int, width: int, row_block: int | None = None, query_block: int | None = None) -> tuple[int, int]:
    """How many blocks of rows and of queries there are, for vectors of at most width components."""
    row_block = row_block or max(1, BLOCK_COMPONENTS // max(1, width))
    query_block = query_block or max(1, BLOCK_PRODUCTS // (max(1, width) * row_block))
    query_block = min(query_block, max(1, BLOCK_COMPONENTS // max(1, width)))
    return max(1, -(-rows // row_block)), max(1, -(-queries // query_block))


def search(rows: DataFrame, queries: DataFrame, k: int = 20, row_block: int | None = None, query_block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score; rows and queries have vec_id and weights.

    row_block and query_block are rows of a block; left out, they follow from the vectors' lengths.
    """
    queries = queries.groupBy("vec_id").agg(F.min("weights").alias("weights"))
    sizes = [df.agg(F.count("*"), F.coalesce(F.max(F.size("weights")), F.lit(0))).first() for df in (rows, queries)]
    n_rows, n_queries = blocks(sizes[0][0], sizes[1][0], max(sizes[0][1], sizes[1][1]), row_block, query_block)
    # as many groups as there are shuffle partitions at least, by smaller blocks of rows
    n_rows = max(n_rows, -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n_queries))
    # each row goes to its block of every query block, each query to its block of every row block
    left = rows.select("vec_id", "weights", F.pmod(F.xxhash64("vec_id"), F.lit(n_rows)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("qb"))
    right = queries.select("vec_id", "weights", F.pmod(F.xxhash64("vec_id"), F.lit(n_queries)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("rb"))

    def block(key, found: pa.Table, asked: pa.Table) -> pa.Table:
        query_ids, vec_ids, kept = [], [], []
        if found.num_rows and asked.num_rows:
            width = max(1, *(int(np.diff(pa.concat_arrays(t["weights"].chunks).offsets.to_numpy()).max()) for t in (found, asked)))
            ids = found["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, matrix = ids[order], _dense(found["weights"], width)[order]
            own, weights = asked["vec_id"].to_numpy(), _dense(asked["weights"], width)
            step = max(1, min(64, BLOCK_COMPONENTS // len(ids)))  # so that the scores stay small
            for at in range(0, len(own), step):
                for q, scores in zip(own[at : at + step].tolist(), _accumulate(weights[at : at + step], matrix)):
                    best = _best(scores, ids, q, k)
                    query_ids.append(np.full(len(best), q, dtype=np.int64))
                    vec_ids.append(ids[best])
                    kept.append(scores[best].astype(np.int64))
        joined = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64())
        return pa.table({"query_id": joined(query_ids), "vec_id": joined(vec_ids), "score": joined(kept)})

    winners = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(block, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return winners.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
