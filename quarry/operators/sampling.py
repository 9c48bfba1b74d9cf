"""Sampling whose draws are hashes: any partitioning gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import draw


def _ranked(points: DataFrame, seed: int, scene: str, point: str, *first: Column) -> DataFrame:
    order = Window.partitionBy(scene).orderBy(*first, "__draw", point)
    return points.withColumn("__draw", draw(seed, F.col(scene), F.col(point))).withColumn("__rank", F.row_number().over(order))


def uniform(points: DataFrame, n: int, seed: int = 42, scene: str = "scene_id", point: str = "point_id") -> DataFrame:
    """n points of each scene without replacement (all, if fewer)."""
    return _ranked(points, seed, scene, point).where(F.col("__rank") <= n).drop("__rank", "__draw")


def damage_first(points: DataFrame, n: int, seed: int = 42, label: str = "label", scene: str = "scene_id", point: str = "point_id") -> DataFrame:
    """n points of each scene: damaged ones first, then background; each kind at random."""
    return _ranked(points, seed, scene, point, (F.col(label) == 0).cast("int")).where(F.col("__rank") <= n).drop("__rank", "__draw")


def protected(points: DataFrame, n: int, target: Column, share: float = 0.1, seed: int = 42, label: str = "label", scene: str = "scene_id", point: str = "point_id") -> DataFrame:
    """n points of each scene, of which the target label keeps share * n (rounded up, one at least) if it has so many.

    Its other points stay out as long as the rest of the scene fills the n places; else all that is left is drawn from alike.
    """
    quota = max(1, math.ceil(share * n))
    own = F.coalesce(F.col(label) == target, F.lit(False))
    inner = Window.partitionBy(scene, "__own").orderBy("__draw", point)
    whole = Window.partitionBy(scene)
    out = points.withColumn("__own", own.cast("int")).withColumn("__draw", draw(seed, F.col(scene), F.col(point)))
    out = out.withColumn("__place", F.row_number().over(inner)).withColumns({"__mine": F.sum("__own").over(whole), "__others": F.sum(1 - F.col("__own")).over(whole)})
    enough = F.col("__others") >= n - F.least(F.col("__mine"), F.lit(quota))
    late = F.when((F.col("__own") == 1) & (F.col("__place") <= quota), 0).when((F.col("__own") == 1) & enough, 2).otherwise(1)
    order = Window.partitionBy(scene).orderBy("__late", "__draw", point)
    return out.withColumn("__late", late).withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n).select(*points.columns)


def fill_up(points: DataFrame, n: int, seed: int = 42, scene: str = "scene_id", point: str = "point_id") -> DataFrame:
    """Adds copy: scenes with fewer than n points get drawn points again until they have n."""
    numbered = points.withColumn("__k", (F.row_number().over(Window.partitionBy(scene).orderBy(point)) - 1).cast("long"))
    sizes = numbered.groupBy(scene).agg(F.count("*").alias("__n")).where(F.col("__n") < n)
    again = sizes.select(scene, "__n", F.explode(F.sequence(F.lit(1), F.lit(n) - F.col("__n"))).alias("copy")).withColumn("__k", draw(seed, F.col(scene), F.col("copy")) % F.col("__n"))
    more = again.join(numbered, [scene, "__k"]).select(*points.columns, F.col("copy").cast("int").alias("copy"))
    return points.withColumn("copy", F.lit(0)).unionByName(more)


def weighted_order(rows: DataFrame, weight: str, seed: int, by: str, key: str) -> DataFrame:
    """Adds place: a weighted draw without replacement within each group (the smallest -ln(u) / w first)."""
    u = (draw(seed, F.col(by), F.col(key)) + 0.5) / float(1 << 32)
    order = Window.partitionBy(by).orderBy(-F.log(u) / F.col(weight), key)
    return rows.withColumn("place", F.row_number().over(order))
