"""Class counts, weights, coverage of label quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..labels import STAGE_SIZE, lut_column, normalize_stage


def class_counts(points: DataFrame, stage: str, label: str = "label") -> DataFrame:
    """class and n for every class of a stage; a label outside 0 to 37 raises."""
    size = STAGE_SIZE[normalize_stage(stage)]
    ok = F.when(F.col(label).between(0, 37), lut_column(F.col(label), stage)).otherwise(F.raise_error(F.concat(F.lit("label out of range: "), F.col(label).cast("string"))).cast("int"))
    found = points.select(ok.alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    grid = points.sparkSession.range(size).select(F.col("id").cast("int").alias("class"))
    return grid.join(F.broadcast(found), "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def effective_weights(counts: DataFrame, beta: float = 0.999999, cap: float = 5.0) -> DataFrame:
    """Adds weight: (1 - beta) / (1 - beta**n), mean 1 over classes with points, capped, then mean 1 again.

    Because of the last step a weight may exceed the cap.  Classes without points weigh 0.
    """
    if not (0 <= beta < 1 and cap > 0):
        raise ValueError("beta must be in [0, 1) and cap positive")
    n = F.col("n")
    raw = F.when(n > 0, F.lit(1.0) if beta == 0 else (1.0 - beta) / -F.expm1(n * F.log(F.lit(beta))))
    out = counts.withColumn("raw", raw)
    first = out.agg(F.avg("raw").alias("m1"))
    out = out.crossJoin(F.broadcast(first)).withColumn("capped", F.when(F.col("raw").isNotNull(), F.least(F.col("raw") / F.col("m1"), F.lit(cap))))
    second = out.agg(F.avg("capped").alias("m2"))
    return out.crossJoin(F.broadcast(second)).select(*counts.columns, F.coalesce(F.col("capped") / F.col("m2"), F.lit(0.0)).alias("weight"))


def summary(weighted: DataFrame) -> DataFrame:
    """One row: counts and weights in order of the classes, supported classes and all points."""
    ordered = F.array_sort(F.collect_list(F.struct("class", "n", "weight")))
    return weighted.agg(ordered.alias("v")).select(
        F.transform("v", lambda x: x["n"]).alias("counts"), F.transform("v", lambda x: x["weight"]).alias("weights"),
        F.transform(F.filter("v", lambda x: x["n"] > 0), lambda x: x["class"]).alias("supported_classes"), F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("total_points"),
    )


def scene_distribution(points: DataFrame, scene: str = "scene_id", label: str = "label") -> DataFrame:
    """label, scenes that hold it, and their percentage."""
    present = points.select(scene, label).distinct()
    total = present.agg(F.countDistinct(scene).alias("total"))
    found = present.groupBy(label).agg(F.count("*").alias("scenes"))
    return found.crossJoin(F.broadcast(total)).select(label, "scenes", (100.0 * F.col("scenes") / F.col("total")).alias("percent"))


def coverage(points: DataFrame, scenes: DataFrame, scene: str = "scene_id") -> DataFrame:
    """label, scene_count, instance_count and point_count of the scenes made for their label and holding it."""
    per = points.groupBy(F.col(scene), F.col("label")).agg(F.count("*").alias("n"))
    own = per.join(scenes.select(scene, "target_label"), scene).where(F.col("label") == F.col("target_label"))
    return own.groupBy("label").agg(F.count("*").alias("scene_count"), F.count("*").alias("instance_count"), F.sum("n").alias("point_count"))


def unmet(covered: DataFrame, labels: list[int], scenes: int, points: int) -> DataFrame:
    """The labels whose scenes or points are too few, with what they have."""
    wanted = covered.sparkSession.createDataFrame([(k,) for k in labels], "label int")
    have = wanted.join(covered, "label", "left").na.fill(0, ["scene_count", "instance_count", "point_count"])
    return have.where((F.col("scene_count") < scenes) | (F.col("point_count") < points)).select("label", "scene_count", "point_count")


def new_scenes(wanted: DataFrame, existing: DataFrame, keys: tuple[str, ...] = ("split", "scene_id")) -> DataFrame:
    """What is still to be made: wanted scenes that don't exist."""
    return wanted.join(existing.select(*keys), list(keys), "left_anti")


def next_id(existing: DataFrame, by: str = "split") -> DataFrame:
    """The id after the highest of each split; holes stay."""
    return existing.groupBy(by).agg((F.max("scene_id") + 1).alias("next_id"))
