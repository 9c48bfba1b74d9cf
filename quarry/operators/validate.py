"""Checks of scenes and points; what is wrong comes back as rows, not as an exception."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_finite, norm

FEATURE_SCHEMA = "observable_features.v1"
REQUIRED = ("x", "y", "z", "label", "intensity_n", "curvature", "residual", "nx", "ny", "nz")


def validate_scenes(points: DataFrame, scenes: DataFrame, scene: str = "scene_id", tolerance: float = 1e-6) -> DataFrame:
    """scene, errors (sorted array), warnings and valid of every registered scene.

    One aggregate over the points; the register has scene, feature_schema and target_label.
    """
    bad = lambda c: F.sum(F.when(c, 1).otherwise(0))
    missing = [c for c in REQUIRED if c not in points.columns]
    have = [c for c in REQUIRED if c not in missing]
    checks = [("points not finite", ~(is_finite("x") & is_finite("y") & is_finite("z")))]
    if "label" in have:
        checks.append(("label out of range", ~F.coalesce(F.col("label").between(0, 37), F.lit(False))))
    for c, low, high in (("intensity_n", 0.0, 1.0), ("curvature", 0.0, 1.0), ("residual", -3.0, 3.0)):
        if c in have:
            checks.append((f"{c} out of range", ~F.coalesce(is_finite(c) & F.col(c).between(low - tolerance, high + tolerance), F.lit(False))))
    aggregates = [F.count("*").alias("n")] + [bad(c).alias(f"e{k}") for k, (_, c) in enumerate(checks)]
    if {"nx", "ny", "nz"} <= set(have):
        aggregates.append(F.percentile(F.abs(norm("nx", "ny", "nz") - 1.0), 0.95).alias("normal_gap"))
    if "label" in have:
        aggregates.append(F.collect_set("label").alias("labels"))  # at most 38 values
    found = scenes.select(scene, "feature_schema", "target_label").join(points.groupBy(scene).agg(*aggregates), scene, "left")
    errors = [F.when(F.col("n").isNull(), "no points"), F.when(~F.col("feature_schema").eqNullSafe(FEATURE_SCHEMA), "feature schema missing or different")]
    errors += [F.lit(f"missing {c}") for c in missing]
    errors += [F.when(F.col(f"e{k}") > 0, F.lit(text)) for k, (text, _) in enumerate(checks)]
    if "label" in have:
        errors.append(F.when((F.col("target_label") >= 1) & ~F.coalesce(F.array_contains("labels", F.col("target_label")), F.lit(False)), "target label absent"))
    warnings = [F.when(F.col("normal_gap") > 5e-3, "normals not of length 1")] if "normal_gap" in found.columns else []
    out = found.select(scene, F.array_sort(F.array_compact(F.array(*errors))).alias("errors"), F.array_compact(F.array(*warnings, F.lit(None).cast("string"))).alias("warnings"))
    return out.withColumn("valid", F.size("errors") == 0)


def report(validated: DataFrame, most: int = 50, scene: str = "scene_id") -> DataFrame:
    """One row: scenes, error_count, the first errors by scene, and whether the dataset is valid."""
    sums = validated.agg(F.count("*").alias("scenes"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("error_count"))
    first = validated.select(scene, F.explode("errors").alias("error")).orderBy(scene, "error").limit(most)
    first = first.agg(F.transform(F.array_sort(F.collect_list(F.struct(scene, "error"))), lambda x: F.concat(x[scene].cast("string"), F.lit(": "), x["error"])).alias("errors"))
    return sums.crossJoin(F.broadcast(first)).withColumn("valid", (F.col("error_count") == 0) & (F.col("scenes") > 0))


def contract_errors(scenes: DataFrame, points: DataFrame | None = None, scene: str = "scene_id", features: tuple[str, ...] = ("intensity_n", "curvature", "residual")) -> DataFrame:
    """Registered scenes whose features can't be used as they are: another schema, another width, or values that aren't finite."""
    wrong = ~F.col("feature_schema").eqNullSafe(FEATURE_SCHEMA) | ~F.col("feature_width").eqNullSafe(3)
    out = scenes.where(wrong).select(scene, F.lit("feature schema or shape missing or different").alias("error"))
    if points is None:
        return out
    fine = F.coalesce(is_finite(features[0]), F.lit(False))
    for c in features[1:]:
        fine = fine & F.coalesce(is_finite(c), F.lit(False))
    odd = points.where(~fine).select(scene).distinct()
    return out.union(scenes.where(~wrong).join(odd, scene, "left_semi").select(scene, F.lit("features not finite").alias("error")))


def reconstruction_errors(points: DataFrame, expected: DataFrame, scene: str = "scene_id", point: str = "point_id", features: tuple[str, ...] = ("intensity_n", "curvature", "residual"), relative: float = 3e-5, absolute: float = 3e-6) -> DataFrame:
    """scene and max_abs of the scenes with a feature that differs from what is computed anew (expected) by more than the tolerance.

    Points that either side lacks count as infinitely far.
    """
    both = points.select(scene, point, *features).join(expected.select(scene, point, *(F.col(c).alias(f"__{c}") for c in features)), [scene, point], "full")
    gap = [F.abs(F.col(c) - F.col(f"__{c}")).cast("double") for c in features]
    gap = F.greatest(F.lit(-1.0), *(F.when(g.isNull() | F.isnan(g), float("inf")).otherwise(g - absolute - relative * F.abs(F.col(f"__{c}"))) for g, c in zip(gap, features))), F.greatest(F.lit(0.0), *(F.coalesce(g, F.lit(float("inf"))) for g in gap))
    return both.select(scene, gap[0].alias("over"), gap[1].alias("gap")).groupBy(scene).agg(F.max("over").alias("over"), F.max("gap").alias("max_abs")).where("over > 0").select(scene, "max_abs")


def quarantine(points: DataFrame, rule, reason: str) -> tuple[DataFrame, DataFrame]:
    """The points that a rule accepts, and the others with the reason."""
    ok = F.coalesce(rule, F.lit(False))
    return points.where(ok), points.where(~ok).withColumn("reason", F.lit(reason))
