"""How far two samples of a descriptor are apart: summaries, Wasserstein, energy distance, kernel discrepancy."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import draw, is_finite
from ..functions.settle import kept as stored


#: Parts of a descriptor's range.
PARTS = 64
#: How many times as many rows as asked for are looked at for the lowest draws, at first.
MARGIN = 4


def summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """count, mean, std (of all), q05, q50 and q95 of the finite values of each group; rows without a group take no part.

    Quantiles are exact, interpolated between neighbouring ranks.  Values are counted first; of the parts of a group's range, only
    those that hold a rank asked for are put in order, so no task gets all values of a group.
    """
    rows = rows.where(is_finite(value) & F.col(by).isNotNull())
    figures = stored(rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")))
    counts = stored(rows.groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c")))
    edges = counts.groupBy(by).agg(F.array_distinct(F.percentile_approx("v", [k / PARTS for k in range(1, PARTS)], 10_000)).alias("edges"))  # a row a group
    placed = counts.join(edges, by).withColumn("part", F.size(F.filter("edges", lambda e: e <= F.col("v")))).drop("edges")
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(by, "part").agg(F.sum("c").alias("all")).select(by, "part", "all", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("first"))  # PARTS rows a group
    quantiles = (("q05", 0.05), ("q50", 0.5), ("q95", 0.95))
    places = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("n") - 1)).alias("at")) for name, q in quantiles))
    asked = figures.select(by, F.explode(places).alias("p")).select(by, "p.*").withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    asked = asked.join(sums, by).where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("all")))
    wanted = placed.join(asked.select(by, "part", "first").distinct(), [by, "part"])
    past = F.col("first") + F.sum("c").over(Window.partitionBy(by, "part").orderBy("v"))
    wanted = wanted.select(by, "part", "v", "c", past.alias("past")).join(asked.select(by, "part", "name", "at", "rank"), [by, "part"])
    wanted = wanted.where((F.col("rank") < F.col("past")) & (F.col("rank") >= F.col("past") - F.col("c")))
    share = F.when(F.col("rank") == F.floor("at"), 1.0 - (F.col("at") - F.floor("at"))).otherwise(F.col("at") - F.floor("at"))
    found = wanted.groupBy(by).agg(*(F.sum(F.when(F.col("name") == name, F.col("v") * share)).alias(name) for name, _ in quantiles))
    return figures.join(found, by).select(by, "n", "mean", "std", *(name for name, _ in quantiles))


def distances(rows: DataFrame, value: str, side: str = "side", by: str = "descriptor") -> DataFrame:
    """wasserstein and energy distance of side `a` and `b` for each descriptor.

    Values are counted first, so the running distribution has a row for each different value.  It runs within
    parts of a descriptor's range that hold about as many values each; sums of the parts before, a
    row each, are added.
    """
    kept = rows.where(is_finite(value) & F.col(side).isin("a", "b"))
    n = kept.groupBy(by).agg(*(F.sum((F.col(side) == s).cast("long")).alias(f"n_{s}") for s in "ab"))
    counts = kept.groupBy(by, F.col(value).alias("v")).agg(*(F.sum((F.col(side) == s).cast("long")).alias(s) for s in "ab"))
    edges = counts.groupBy(by).agg(F.array_distinct(F.percentile_approx("v", [k / PARTS for k in range(1, PARTS)], 10_000)).alias("edges"))  # a row a descriptor
    placed = counts.join(F.broadcast(edges), by).withColumn("part", F.size(F.filter("edges", lambda e: e <= F.col("v"))))
    parts, before = Window.partitionBy(by).orderBy("part"), Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(by, "part").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.min("v").alias("v"))
    sums = sums.select(by, "part", F.coalesce(F.sum("a").over(before), F.lit(0)).alias("a0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.lead("v").over(parts).alias("after"))
    order = Window.partitionBy(by, "part").orderBy("v")
    run = placed.join(F.broadcast(sums), [by, "part"])  # PARTS rows a descriptor
    run = run.select(by, "v", (F.col("a0") + F.sum("a").over(order)).alias("a"), (F.col("b0") + F.sum("b").over(order)).alias("b"), (F.coalesce(F.lead("v").over(order), "after") - F.col("v")).alias("w"))
    gap = F.col("a") / F.col("n_a") - F.col("b") / F.col("n_b")
    out = run.join(F.broadcast(n), by).where("w is not null and n_a > 0 and n_b > 0")
    return out.groupBy(by).agg(F.sum(F.abs(gap) * F.col("w")).alias("wasserstein"), F.sqrt(2.0 * F.sum(gap * gap * F.col("w"))).alias("energy"))


def first_draws(rows: DataFrame, n: int, key: str, side: str, seed: int, sizes: dict | None = None, entire: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows whose draws are low, n or more of each side (all, if it has fewer): the n lowest draws are among them.

    Draws are even, so MARGIN times n rows of a side lie under a limit for its size; where fewer than n do, the limit is raised, up to the whole
    side.  sizes gives each side's number of rows, if it is known; `entire` makes what is to be counted from the rows.
    """
    drawn = rows.withColumn("__draw", draw(seed, F.col(side), F.col(key)))
    counted = lambda df: {r[0]: r[1] for r in df.groupBy(side).count().collect()}  # noqa: E731  (a row a side)
    limits = {s: (MARGIN * n + 64) / size for s, size in (counted(rows) if sizes is None else sizes).items()}
    while True:
        low = reduce(Column.__or__, [F.col(side).eqNullSafe(F.lit(s)) & (F.col("__draw") <= min(1 << 32, int(share * (1 << 32)))) for s, share in limits.items()], F.lit(False))
        found = stored(drawn.where(low).drop("__draw"))
        have = counted(entire(found) if entire else found)
        few = [s for s, share in limits.items() if have.get(s, 0) < n and share < 1]
        if not few:
            return found
        limits |= {s: limits[s] * 8 for s in few}


def capped(rows: DataFrame, n: int, key: str, side: str = "side", seed: int = 42) -> DataFrame:
    """n rows of each side, drawn by hash; the all-pairs step needs such a bound.  Only rows of low draws are put in order."""
    order = Window.partitionBy(side).orderBy(draw(seed, F.col(side), F.col(key)), key)
    return first_draws(rows, n, key, side, seed).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def kernel_discrepancy(rows: DataFrame, values: tuple[str, ...], key: str, n: int = 512, side: str = "side", seed: int = 42) -> DataFrame:
    """mmd (biased, Gaussian kernel) of sides `a` and `b`, over at most n rows of each.

    Columns are scaled by their joint mean and deviation; the squared bandwidth is the median of the
    squared distances of all ordered pairs that aren't 0.
    """
    kept = rows
    for v in values:
        kept = kept.where(is_finite(v))
    kept = capped(kept, n, key, side, seed)
    stats = kept.agg(*(f(v).alias(f"{p}{v}") for v in values for p, f in (("m_", F.avg), ("s_", F.stddev_pop))))
    scaled = kept.crossJoin(F.broadcast(stats)).select(side, *(((F.col(v) - F.col(f"m_{v}")) / F.greatest(F.col(f"s_{v}"), F.lit(1e-8))).alias(v) for v in values))
    other = scaled.select(F.col(side).alias("__o"), *(F.col(v).alias(f"o_{v}") for v in values))
    d2 = sum(((F.col(v) - F.col(f"o_{v}")) * (F.col(v) - F.col(f"o_{v}")) for v in values), F.lit(0.0))
    pairs = scaled.crossJoin(F.broadcast(other)).select(side, "__o", d2.alias("d2"))  # at most (2 n)**2 rows
    width = pairs.agg(F.greatest(F.coalesce(F.percentile(F.when(F.col("d2") > 0, F.col("d2")), 0.5), F.lit(1.0)), F.lit(1e-8)).alias("bw"))
    k = F.exp(-F.col("d2") / (2.0 * F.col("bw")))
    same = lambda s: F.avg(F.when((F.col(side) == s) & (F.col("__o") == s), k))
    return pairs.crossJoin(F.broadcast(width)).agg((same("a") + same("b") - 2.0 * F.avg(F.when((F.col(side) == "a") & (F.col("__o") == "b"), k))).alias("mmd"))


def descriptors(geometry: DataFrame, scene: str = "scene_id", point: str = "point_id", limit: float = 3.0) -> DataFrame:
    """scene, point, descriptor and value: what a sensor can observe of each point, from local_geometry joined with intensity."""
    scaled = F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col("residual") / F.greatest("radius", F.lit(1e-6))))
    kinds = {
        "density_per_m2": F.col("density"), "normal_tilt_rad": F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("nz")))), "pca_curvature": F.col("curvature"), "height_residual_m": F.abs("residual"),
        "signed_height_residual_over_radius": scaled,
    }
    if "intensity" in geometry.columns:
        kinds["intensity"] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("intensity")))
    each = F.array(*(F.struct(F.lit(name).alias("descriptor"), value.cast("double").alias("v")) for name, value in kinds.items()))
    return geometry.select(scene, point, F.explode(each).alias("x")).select(scene, point, "x.*").where(is_finite("v"))


def compare(rows: DataFrame, names: tuple[str, ...], key: str, n: int = 512, side: str = "side", by: str = "descriptor", value: str = "v", seed: int = 42) -> DataFrame:
    """The domain report: for each descriptor available, a row's summaries of both sides, wasserstein, energy and mmd; and joint.

    rows is long (side `a` or `b`, key of a point, descriptor, value).  A descriptor that a side lacks has summaries of 0 there and null
    distances.  The row `joint` has the kernel discrepancy over all available descriptors at once.
    """
    spark = rows.sparkSession
    rows = rows.where(is_finite(value) & F.col(side).isin("a", "b") & F.col(by).isin(*names))
    found = stored(summary(rows.withColumn("__sample", F.struct(by, side)), "__sample", value))
    figures = ("n", "mean", "std", "q05", "q50", "q95")
    out = spark.createDataFrame([(name,) for name in names], f"{by} string")
    for s in "ab":
        one = found.where(F.col(f"__sample.{side}") == s).select(F.col(f"__sample.{by}").alias(by), *(F.col(c).alias(f"{s}_{c}") for c in figures))
        out = out.join(F.broadcast(one), by, "left").na.fill(0, [f"{s}_{c}" for c in figures])  # a row a descriptor
    sizes = {(r[0], r[1]): r[2] for r in found.select(f"__sample.{by}", f"__sample.{side}", "n").collect()}  # two rows a descriptor
    common = [name for name in names if (name, "a") in sizes and (name, "b") in sizes]
    apart = distances(rows, value, side, by)
    # the kernels look at n points of each side: these are among the points of low draws that have all descriptors
    least = {s: min(sizes[name, s] for name in common) for s in "ab"} if common else {}
    whole = lambda found: found.groupBy(side, key).agg(F.countDistinct(by).alias("k")).where(F.col("k") == len(common))
    low = first_draws(rows.where(F.col(by).isin(*common)), n, key, side, seed, least, whole) if common else None
    kernels = [kernel_discrepancy(low.where(F.col(by) == name), (value,), key, n, side, seed).select(F.lit(name).alias(by), "mmd") for name in common]
    for frame in (apart, reduce(DataFrame.union, kernels) if kernels else spark.createDataFrame([], f"{by} string, mmd double")):
        out = out.join(F.broadcast(frame), by, "left")
    out = out.select(by, F.col(by).isin(*common).alias("available") if common else F.lit(False).alias("available"), *(f"{s}_{c}" for s in "ab" for c in figures), "wasserstein", "energy", "mmd")
    if not common:
        return out
    wide = low.groupBy(side, key).pivot(by, common).agg(F.first(value))
    joint = kernel_discrepancy(wide, tuple(common), key, n, side, seed).select(F.lit("joint").alias(by), F.lit(True).alias("available"), "mmd")
    return out.unionByName(joint, allowMissingColumns=True)
