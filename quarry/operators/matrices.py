"""Small matrices as rows (i, j, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.settle import settled


def sinkhorn(matrix: DataFrame, rounds: int = 5, eps: float = 1e-6) -> DataFrame:
    """exp of the entries, then rows and columns divided by their sums in turn: nearly doubly stochastic."""
    out = matrix.select("i", "j", F.exp("v").alias("v"))
    for _ in range(rounds):
        for side in ("i", "j"):
            out = out.withColumn("v", F.col("v") / (F.sum("v").over(Window.partitionBy(side)) + eps))
    return out


def stochastic_error(matrix: DataFrame) -> DataFrame:
    """row_error and column_error (largest distance of a sum from 1) and the smallest entry."""
    worst = lambda side: matrix.groupBy(side).agg(F.sum("v").alias("s")).agg(F.max(F.abs(F.col("s") - 1.0)).alias(f"{'row' if side == 'i' else 'column'}_error"))
    return worst("i").crossJoin(F.broadcast(worst("j"))).crossJoin(F.broadcast(matrix.agg(F.min("v").alias("least"))))  # one row each


def apply(matrix: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """y = x + H r for vectors in rows (key, i, x, r): a join and a sum."""
    moved = vectors.select(key, F.col("i").alias("j"), "r").join(F.broadcast(matrix), "j").groupBy(key, "i").agg(F.sum(F.col("v") * F.col("r")).alias("h"))
    return vectors.join(moved, [key, "i"]).select(key, "i", (F.col("x") + F.col("h")).alias("y"))


def spectral_norm(matrix: DataFrame, steps: int = 60) -> DataFrame:
    """norm: the length of the product of a matrix in rows (i, j, v) with the vector of `steps` power iterations; a zero matrix has 0.

    It nears the largest singular value from below.  The steps are products by the matrix and by its transpose in turn, from equal
    components; each is a join and a sum over the entries.  The vector is kept in the shared folder after each two and has length 1 then.
    """
    entries = settled(matrix.select("i", "j", F.col("v").cast("double").alias("v")).where("v <> 0"))

    def product(x: DataFrame, to: str) -> DataFrame:
        """The matrix times x, whose components stand by j, or its transpose times x, by i."""
        return entries.join(x, "j" if to == "i" else "i").groupBy(to).agg(F.sum(F.col("v") * F.col("x")).alias("x"))

    def length(x: DataFrame) -> float:
        return x.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 0.0

    x, to = entries.select("j").distinct().withColumn("x", F.lit(1.0)), "i"
    size = length(x)
    for step in range(steps + 1):
        if size == 0:
            break
        x, to = product(x.withColumn("x", F.col("x") / size) if size != 1 else x, to), "j" if to == "i" else "i"
        size = 1.0
        if step % 2 or step == steps:
            x = settled(x)
            size = length(x)
    return matrix.sparkSession.range(1).select(F.lit(size).alias("norm"))
