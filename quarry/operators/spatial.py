"""Neighbours, local geometry, transfer, voxels and rasters.

Pairs are only formed between points whose cells of a grid touch.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, draw, is_finite, norm
from ..functions.settle import kept
from .tiles import local_geometry, surface_arrays  # noqa: F401


#: Points of a task where a step deals them out, and points of the largest scene that goes to one task.
ROWS, LARGE = 200_000, 1_000_000
#: Halvings of a scene's box at most.
DEPTH = 20


def neighbours(points: DataFrame, sources: DataFrame, k: int, scene: str, point: str, source: str, dims: tuple[str, ...], prefix: str, others_only: bool = False) -> DataFrame:
    """The points' scene, point and dims with source, its dims (prefixed), d2 and rank of the k nearest sources of the scene (ties to the smaller id).

    The box of a scene's sources is halved along each axis again and again, and a point takes the smallest cell around it that
    still holds k sources.  The k-th distance in this cell is a bound, and the point meets the sources of all cells that the bound reaches,
    cells no narrower than the bound, so at most three along an axis.  Cells follow the density, so no scene is ever compared with
    itself as a whole, but by points that stand far outside.  Of sources at one place only the k + 1 with the smallest ids can be neighbours, so
    copies don't fill a cell.  Points and sources with a null or non-finite coordinate take no part.
    """
    own = [scene, point, *dims]
    whole = reduce(Column.__and__, [is_finite(d) for d in dims])
    need = k + int(others_only)
    sources = sources.select(scene, F.col(source).alias("__s"), *dims).where(whole)
    place = F.row_number().over(Window.partitionBy(scene, *dims).orderBy("__s"))
    sources = kept(sources.withColumn("__r", place).where(F.col("__r") <= k + 1).drop("__r"))
    extent = F.greatest(*(F.max(d) - F.min(d) for d in dims), F.lit(1e-9))
    # scenes that are spread along a line at least reach cells of k sources
    deep = F.least(F.lit(DEPTH), F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / float(k))) + 1)).cast("int")
    box = kept(sources.groupBy(scene).agg(*(F.min(d).alias(f"__lo{d}") for d in dims), extent.alias("__span"), deep.alias("__deep")))

    def cell(value: Column, d: str, depth: Column) -> Column:
        """The cell of a coordinate at a depth; what is outside the box goes to its edge."""
        n = F.pow(F.lit(2.0), depth)
        return F.greatest(F.lit(0.0), F.least(n - 1.0, F.floor((value - F.col(f"__lo{d}")) / F.col("__span") * n))).cast("int")

    at = [f"__c{d}" for d in dims]
    depths = F.explode(F.sequence(F.lit(0), F.col("__deep"))).alias("__depth")
    there = sources.join(box, scene).select("*", depths).withColumns({f"__c{d}": cell(F.col(d), d, F.col("__depth")) for d in dims})
    there = there.select(scene, "__depth", *at, "__s", *(F.col(d).alias(f"{prefix}{d}") for d in dims))
    full = there.groupBy(scene, "__depth", *at).agg(F.count("*").alias("__n")).where((F.col("__n") >= need) | (F.col("__depth") == 0)).drop("__n")
    here = points.select(*own).where(whole).join(box, scene).select("*", depths).withColumns({f"__c{d}": cell(F.col(d), d, F.col("__depth")) for d in dims})
    placed = here.select(*own, "__depth", *at).join(full, [scene, "__depth", *at])
    placed = kept(placed.groupBy(scene, point).agg(F.max(F.struct("__depth", *at, *dims)).alias("__m")).select(scene, point, "__m.*"))
    d2 = sum(((F.col(d) - F.col(f"{prefix}{d}")) * (F.col(d) - F.col(f"{prefix}{d}")) for d in dims), F.lit(0.0))
    order = Window.partitionBy(scene, point).orderBy("d2", "__s")

    def best(asked: DataFrame) -> DataFrame:
        pairs = asked.join(there, [scene, "__depth", *at]).withColumn("d2", d2)
        if others_only:
            pairs = pairs.where(F.col(point) != F.col("__s"))
        pairs = pairs.where(F.col("d2") <= F.col("__last")) if "__last" in asked.columns else pairs
        return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # what found fewer stands in the box as a whole, which has no more
    last = F.when(F.count("*") == k, F.max("d2")).otherwise(float("inf"))
    bound = best(placed).groupBy(*own).agg(last.alias("__last"), F.max("__depth").alias("__depth"))
    reach = F.sqrt("__last") * (1 + 1e-9) + F.col("__span") * 1e-9
    reaching = kept(bound).join(box, scene).withColumn("__reach", reach)
    reaching = reaching.withColumn("__depth", F.greatest(F.lit(0), F.least("__depth", F.floor(F.log2(F.col("__span") / F.col("__reach"))))).cast("int"))
    for d in dims:
        ends = (cell(F.col(d) + sign * F.col("__reach"), d, F.col("__depth")) for sign in (-1, 1))
        reaching = reaching.withColumn(f"__c{d}", F.explode(F.sequence(*ends)))
    # a cell that the ball around the point doesn't touch has nothing for it; cells at the box's edge aren't judged by that side
    width = F.col("__span") / F.pow(F.lit(2.0), F.col("__depth"))
    gap = lambda d: F.greatest(F.lit(0.0), F.col(f"__lo{d}") + F.col(f"__c{d}") * width - F.col(d), F.col(d) - F.col(f"__lo{d}") - (F.col(f"__c{d}") + 1) * width)
    away = sum((gap(d) * gap(d) for d in dims), F.lit(0.0))
    reaching = reaching.where(away <= F.col("__reach") * F.col("__reach")).select(*own, "__last", "__depth", *at)
    found = best(reaching)
    return found.select(*own, F.col("__s").alias(source), *(f"{prefix}{d}" for d in dims), "d2", F.col("rank").cast("int").alias("rank"))


def knn(points: DataFrame, k: int = 16, scene: str = "scene_id", point: str = "point_id", dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """scene, point, neighbour, rank and d2 of the k nearest other points of the scene (ties to the smaller id)."""
    return neighbours(points, points.withColumnRenamed(point, "neighbour"), k, scene, point, "neighbour", dims, "n_", others_only=True)


def smallest_eigen_share(a, b, c, d, e, f) -> Column:
    """Smallest eigenvalue over the trace of the symmetric matrix [[a, d, e], [d, b, f], [e, f, c]], in closed form."""
    q = (a + b + c) / 3.0
    p = F.sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2.0 * (d * d + e * e + f * f)) / 6.0)
    det = (a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)
    angle = F.acos(clip(F.try_divide(det, 2.0 * p * p * p), -1, 1)) / 3.0
    trace = a + b + c
    share = F.try_divide(q + 2.0 * p * F.cos(angle + F.lit(2.0 * math.pi / 3.0)), F.greatest(trace, F.lit(1e-12)))
    return F.when(p == 0, F.when(trace > 0, 1.0 / 3.0).otherwise(0.0)).otherwise(clip(share, 0, 1))


def curvature(points: DataFrame, k: int = 16, scene: str = "scene_id", point: str = "point_id") -> DataFrame:
    """curvature, radius and density of each point from the covariance of its k nearest neighbours."""
    near = knn(points, k, scene, point).groupBy(scene, point).agg(
        *(F.covar_samp(f"n_{u}", f"n_{v}").alias(u + v) for u, v in ("xx", "yy", "zz", "xy", "xz", "yz")), F.greatest(F.sqrt(F.max("d2")), F.lit(1e-6)).alias("radius"), F.count("*").alias("n")
    )
    share = smallest_eigen_share(*(F.col(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz")))
    return near.select(scene, point, share.alias("curvature"), "radius", (F.col("n") / (F.lit(math.pi) * F.col("radius") * F.col("radius"))).alias("density"))


def observable_features(geometry: DataFrame, limit: float = 3.0) -> DataFrame:
    """intensity_n, curvature and the residual in units of the radius within +-limit, as float."""
    return geometry.withColumns({"residual": clip(F.col("residual") / F.col("radius"), -limit, limit).cast("float"), "curvature": F.col("curvature").cast("float"), "intensity_n": F.col("intensity_n").cast("float")})


def cells(points: DataFrame, size: float, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Adds the grid cell of each point: c_x, c_y, ..."""
    return points.withColumns({f"c_{d}": F.floor(F.col(d) / size).cast("long") for d in dims})


def nearest_within(points: DataFrame, sources: DataFrame, radius: float, scene: str = "scene_id", dims: tuple[str, ...] = ("x", "y"), point: str = "point_id", source: str = "source_id") -> DataFrame:
    """scene, point, the nearest source within radius (ties to the smaller id) and its distance."""
    found = neighbours(points, sources, 1, scene, point, source, dims, "s_").where(F.col("d2") <= radius * radius)
    return found.select(scene, point, source, F.sqrt("d2").alias("distance"))


def nearest(points: DataFrame, sources: DataFrame, scene: str = "scene_id", point: str = "point_id", source: str = "source_id", dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """scene, point, the nearest source of the scene (ties to the smaller id) and its distance."""
    return neighbours(points, sources, 1, scene, point, source, dims, "s_").select(scene, point, source, F.sqrt("d2").alias("distance"))


def ridges(points: DataFrame, seeds: DataFrame, scene: str = "scene_id", point: str = "point_id", seed: str = "seed_id", k: int = 16) -> DataFrame:
    """scene, point, its nearest seed (in x and y, ties to the smaller id) and the distance to the boundary of that seed's Voronoi cell.

    The boundary to a seed at distance d is no nearer than (d - r) / 2, where r is the distance of the point's own seed.  So the least
    distance to a boundary among the k nearest seeds tells how far other seeds can matter; if that is farther than the last of the k, the
    point meets all seeds of the cells that are so near, and only the least is kept.  Of seeds at one place two are enough, for between
    them there is no boundary.
    """
    copy = F.row_number().over(Window.partitionBy(scene, "x", "y").orderBy(seed))
    seeds = kept(seeds.select(scene, seed, "x", "y").where(is_finite("x") & is_finite("y")).withColumn("__r", copy).where(F.col("__r") <= 2).drop("__r"))
    near = neighbours(points, seeds, k, scene, point, seed, ("x", "y"), "s_")
    near = near.groupBy(scene, point, "x", "y").agg(F.array_sort(F.collect_list(F.struct("d2", seed, "s_x", "s_y"))).alias("__near"))  # k
    ridge = lambda d2, x, y, f: F.try_divide(d2 - f["d2"], 2.0 * F.sqrt((x - f["s_x"]) ** 2 + (y - f["s_y"]) ** 2))
    near = near.withColumn("__f", F.get("__near", F.lit(0)))
    near = near.withColumn("ridge", F.array_min(F.transform("__near", lambda s: ridge(s["d2"], s["s_x"], s["s_y"], F.col("__f")))))
    near = near.withColumn("__reach", (F.sqrt("__f.d2") + 2.0 * F.col("ridge")) * (1 + 1e-9))
    sure = (F.size("__near") < k) | F.coalesce(F.sqrt(F.element_at("__near", -1)["d2"]) >= F.col("__reach"), F.lit(False))
    found = kept(near.where(F.size("__near") > 1).select(scene, point, "x", "y", "__f", "ridge", "__reach", sure.alias("__sure")))
    extent = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9))
    deep = F.least(F.lit(DEPTH), F.ceil(F.log2(F.count("*") + 1.0))).cast("int")
    box = kept(seeds.groupBy(scene).agg(F.min("x").alias("__lox"), F.min("y").alias("__loy"), extent.alias("__span"), deep.alias("__deep")))
    at = lambda value, d: F.floor((value - F.col(f"__lo{d}")) / F.col("__span") * F.pow(F.lit(2.0), F.col("__depth")))
    there = seeds.join(box, scene).withColumn("__depth", F.explode(F.sequence(F.lit(0), F.col("__deep"))))
    there = there.select(scene, "__depth", *(at(F.col(d), d).alias(f"__c{d}") for d in "xy"), F.col(seed).alias("__s"), F.col("x").alias("s_x"), F.col("y").alias("s_y"))
    here = found.where("not __sure").join(box, scene)
    here = here.withColumn("__depth", F.greatest(F.lit(0), F.least("__deep", F.floor(F.log2(F.col("__span") / F.greatest("__reach", F.col("__span") * 1e-9))))).cast("int"))
    for d in "xy":
        # seeds stand in the box and at its upper edge
        last = F.pow(F.lit(2.0), F.col("__depth")).cast("long")
        ends = (F.greatest(F.lit(0), F.least(last, at(F.col(d) + sign * F.col("__reach"), d))) for sign in (-1, 1))
        here = here.withColumn(f"__c{d}", F.explode(F.sequence(*ends)))
    pairs = here.join(there, [scene, "__depth", "__cx", "__cy"])
    pairs = pairs.where(F.col("__s") != F.col(f"__f.{seed}")).withColumn("d2", (F.col("x") - F.col("s_x")) * (F.col("x") - F.col("s_x")) + (F.col("y") - F.col("s_y")) * (F.col("y") - F.col("s_y")))
    more = pairs.groupBy(scene, point).agg(F.first(f"__f.{seed}").alias(seed), F.min(ridge(F.col("d2"), F.col("s_x"), F.col("s_y"), F.col("__f"))).alias("ridge"))
    return found.where("__sure").select(scene, point, f"__f.{seed}", "ridge").union(more)


def voxels(points: DataFrame, size: float, scene: str = "scene_id", point: str = "point_id", values: tuple[str, ...] = ("x", "y", "z", "intensity"), label: str = "label") -> DataFrame:
    """One row for each occupied xy-voxel of a scene: means, the most frequent label (ties to the lowest) and n."""
    placed = cells(points, size)
    keys = [scene, "c_x", "c_y"]
    return placed.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values), F.mode(label, True).alias(label), F.count("*").alias("n"))


def dealt(points: DataFrame, scene: str) -> tuple[DataFrame, int]:
    """The points dealt out by scene to as many partitions as their number asks for, so that a task doesn't grow with the input, and 0.

    If a scene has more than LARGE points, the points stay where they are, and the number of partitions comes with them.
    """
    n, most = points.groupBy(scene).count().agg(F.sum("count"), F.max("count")).first()
    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), (n or 0) // ROWS + 1)
    return (points.repartition(parts, scene), 0) if (most or 0) <= LARGE else (points, parts)


def _gridded(points: DataFrame, value: str, scene: str, place, *made: Column) -> DataFrame:
    """scene, row, col and the aggregates of v, a value, by the cells that place (row and col from the box's columns) gives."""
    points, parts = dealt(points.select(scene, "x", "y", F.col(value).alias("v")), scene)
    box = points.groupBy(F.col(scene).alias("__s")).agg(*(f(a).alias(f"__{n}{a}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    row, col = place
    placed = points.join(box, F.col(scene) == F.col("__s")).select(scene, row.alias("row"), col.alias("col"), "v")
    if parts:
        placed = placed.repartition(parts, scene, "row", "col")
    return placed.groupBy(scene, "row", "col").agg(*made)


def raster(points: DataFrame, value: str, size: int, scene: str = "scene_id") -> DataFrame:
    """scene, row, col, mean and max of a value on a size x size grid over the scene's xy-box; row 0 is on top."""
    at = lambda a: F.least(F.floor((F.col(a) - F.col(f"__lo{a}")) / (F.col(f"__hi{a}") - F.col(f"__lo{a}") + 1e-9) * size).cast("int"), F.lit(size - 1))
    return _gridded(points, value, scene, (F.lit(size - 1) - at("y"), at("x")), F.avg("v").alias("mean"), F.max("v").alias("max"))


def bev(points: DataFrame, value: str, size: int = 200, scene: str = "scene_id") -> DataFrame:
    """scene, row, col and mean of a value on a grid that keeps the aspect; the longer side has `size` cells."""
    span = F.greatest(F.greatest(F.col("__hix") - F.col("__lox"), F.col("__hiy") - F.col("__loy")), F.lit(1e-6))
    at = lambda a: F.floor((F.col(a) - F.col(f"__lo{a}")) / span * (size - 1)).cast("int")
    return _gridded(points, value, scene, (at("y"), at("x")), F.avg("v").alias("mean"))


def _shifted(grid: DataFrame, reach: int, value: str, keys: list[str]) -> DataFrame:
    """Each cell's value sent to the cells around it, with where it came from (dr, dc)."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    sent = grid.select(*keys, "row", "col", F.col(value).alias("v"), F.explode(steps).alias("dr")).withColumn("dc", F.explode(steps))
    return sent.select(*keys, (F.col("row") - F.col("dr")).alias("row"), (F.col("col") - F.col("dc")).alias("col"), "dr", "dc", "v")


def _own() -> Column:
    """Whether a cell that _shifted has sent to is one of the grid's own: it has then sent to itself."""
    return F.max((F.col("dr") == 0) & (F.col("dc") == 0))


def sobel(grid: DataFrame, value: str = "mean", scene: str = "scene_id") -> DataFrame:
    """scene, row, col and edge (gradient size) of the grid's own cells; cells that are missing count as 0."""
    gx = F.col("dc") * (F.lit(2) - F.abs("dr")) * F.col("v")
    gy = F.col("dr") * (F.lit(2) - F.abs("dc")) * F.col("v")
    sums = _shifted(grid, 1, value, [scene]).groupBy(scene, "row", "col").agg(F.sum(gx).alias("gx"), F.sum(gy).alias("gy"), _own().alias("__own"))
    return sums.where("__own").select(scene, "row", "col", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + 1e-8).alias("edge"))


def dilate(grid: DataFrame, flag: str, reach: int = 2, scene: str = "scene_id") -> DataFrame:
    """The grid's cells with flag set where any cell within reach has it."""
    near = _shifted(grid, reach, flag, [scene]).groupBy(scene, "row", "col").agg(F.max("v").alias(flag), _own().alias("__own"))
    return near.where("__own").drop("__own")


def fit_plane(points: DataFrame, scene: str = "scene_id") -> DataFrame:
    """scene, a, b and c of the least-squares plane z = a x + b y + c, from nine sums (Cramer's rule)."""
    m = points.groupBy(scene).agg(*(F.avg(v).alias(f"m{v}") for v in "xyz"), F.covar_pop("x", "x").alias("xx"), F.covar_pop("y", "y").alias("yy"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    a = F.try_divide(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy"), det)
    b = F.try_divide(F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy"), det)
    return m.select(scene, a.alias("a"), b.alias("b"), (F.col("mz") - a * F.col("mx") - b * F.col("my")).alias("c"))


def ground(points: DataFrame, limit: float = 0.15, scene: str = "scene_id") -> DataFrame:
    """The points within limit of their scene's plane, with the distance (signed, along the plane's normal)."""
    plane = fit_plane(points, scene)
    size = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + 1.0)
    out = points.join(plane, scene).withColumn("plane_distance", (F.col("z") - F.col("a") * F.col("x") - F.col("b") * F.col("y") - F.col("c")) / size)
    return out.where(F.abs("plane_distance") <= limit).drop("a", "b", "c")


def ransac_planes(points: DataFrame, limit: float = 0.15, tries: int = 64, least_nz: float = 0.7, seed: int = 42, scene: str = "scene_id", point: str = "point_id") -> DataFrame:
    """scene, nx, ny, nz, d and retained of the plane with most points within limit, by seeded RANSAC.

    The scene's first `tries` points in the order of a hash are drawn, each with the two after it (in a circle) gives a plane, and one
    aggregate counts the points within limit of all these planes at once, so that a scene is never in one task.  The first plane with
    the most points wins.  Scenes without a plane that is flat enough (abs(nz) >= least_nz) and holds four points have no row.
    """
    rank = F.row_number().over(Window.partitionBy(scene).orderBy(draw(seed, F.col(scene), F.col(point)), point))
    drawn = points.select(scene, point, "x", "y", "z").withColumn("__r", rank).where(F.col("__r") <= tries)
    pool = drawn.groupBy(scene).agg(F.array_sort(F.collect_list(F.struct("__r", "x", "y", "z"))).alias("__p")).where(F.size("__p") >= 4)
    n = F.size("__p")
    at = lambda k: F.get("__p", (k % n).cast("int"))
    less = lambda p, q: F.struct(*((p[a] - q[a]).alias(a) for a in "xyz"))
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("k"), at(k).alias("o"), less(at(k + 1), at(k)).alias("u"), less(at(k + 2), at(k)).alias("v")))
    minor = lambda s, a, b: s["u"][a] * s["v"][b] - s["u"][b] * s["v"][a]
    crossed = F.transform("__s", lambda s: F.struct(s["k"].alias("k"), s["o"].alias("o"), minor(s, "y", "z").alias("x"), minor(s, "z", "x").alias("y"), minor(s, "x", "y").alias("z")))
    length = lambda s: F.sqrt(s["x"] * s["x"] + s["y"] * s["y"] + s["z"] * s["z"])
    upward = lambda s, a: s[a] / length(s) * F.when(s["z"] < 0, -1.0).otherwise(1.0)
    normals = F.transform(F.filter("__c", lambda s: length(s) >= 1e-12), lambda s: F.struct(s["k"].alias("k"), s["o"].alias("o"), *(upward(s, a).alias(a) for a in "xyz")))
    planes = F.transform(F.filter("__n", lambda s: s["z"] >= least_nz), lambda s: F.struct(s["x"].alias("nx"), s["y"].alias("ny"), s["z"].alias("nz"), (-(s["o"]["x"] * s["x"] + s["o"]["y"] * s["y"] + s["o"]["z"] * s["z"])).alias("d")))
    planes = pool.withColumn("__s", sides).withColumn("__c", crossed).withColumn("__n", normals).select(scene, planes.alias("__h")).where(F.size("__h") > 0)
    h = lambda k: F.get("__h", F.lit(k))
    inside = lambda k: F.abs(F.col("x") * h(k)["nx"] + F.col("y") * h(k)["ny"] + F.col("z") * h(k)["nz"] + h(k)["d"]) <= limit
    counts = points.join(planes, scene).groupBy(scene).agg(F.count("*").alias("__all"), F.array(*(F.sum(F.when(inside(k), 1).otherwise(0)) for k in range(tries))).alias("__in"))
    best = F.array_max(F.transform("__h", lambda p, k: F.struct(F.get("__in", k).alias("n"), (-k).alias("first"), p.alias("p"))))
    found = counts.join(planes, scene).select(scene, "__all", best.alias("b")).where("b.n >= 4")
    return found.select(scene, "b.p.nx", "b.p.ny", "b.p.nz", "b.p.d", (F.col("b.n") / F.col("__all")).alias("retained"))


def chamfer(a: DataFrame, b: DataFrame, scene: str = "scene_id", point: str = "point_id") -> DataFrame:
    """scene and the two-way mean distance of each cloud's points to the other's nearest."""
    go = nearest(a, b.withColumnRenamed(point, "source_id"), scene, point)
    back = nearest(b, a.withColumnRenamed(point, "source_id"), scene, point)
    return go.groupBy(scene).agg(F.avg("distance").alias("there")).join(back.groupBy(scene).agg(F.avg("distance").alias("back")), scene).select(scene, "there", "back", (F.col("there") + F.col("back")).alias("chamfer"))


def edge_features(points: DataFrame, k: int, scene: str = "scene_id", point: str = "point_id") -> DataFrame:
    """For each point the largest difference to its neighbours along each axis."""
    near = knn(points, k, scene, point)
    return near.groupBy(scene, point).agg(*(F.max(F.col(f"n_{a}") - F.col(a)).alias(f"e{a}") for a in "xyz"))


def window_pairs(points: DataFrame, scene: str = "scene_id", point: str = "point_id") -> DataFrame:
    """All ordered pairs of points in one window; a window has a bounded number of points."""
    other = points.select(scene, "window_id", F.col(point).alias("other_id"))
    return points.select(scene, "window_id", point).join(other, [scene, "window_id"])


def grid_normals(grid: DataFrame, value: str, step: float, scene: str = "scene_id") -> DataFrame:
    """Normals of a height grid by finite differences: central inside, one-sided at the edges."""

    def slope(along, across):
        w = Window.partitionBy(scene, across).orderBy(along)
        after, before = F.lead(value).over(w), F.lag(value).over(w)
        return F.coalesce((after - before) / (2 * step), (after - F.col(value)) / step, (F.col(value) - before) / step, F.lit(0.0))

    sx, sy = slope("col", "row"), slope("row", "col")
    out = grid.withColumns({"sx": sx, "sy": sy})
    size = norm("sx", "sy", F.lit(1.0))
    return out.select(*grid.columns, (-F.col("sx") / size).alias("nx"), (-F.col("sy") / size).alias("ny"), (1.0 / size).alias("nz"))


def bilinear(points: DataFrame, grid: DataFrame, value: str = "v", point: str = "point_id") -> DataFrame:
    """point and the grid's value at x and y, interpolated between the four corners at whole numbers; 0 outside.

    A join by corner: each point asks for four cells.
    """
    fx, fy = F.floor("x").cast("int"), F.floor("y").cast("int")
    corners = F.explode(F.array(*(F.struct((fx + i).alias("gx"), (fy + j).alias("gy"), ((F.lit(1 - i) + (2 * i - 1) * (F.col("x") - fx)) * (F.lit(1 - j) + (2 * j - 1) * (F.col("y") - fy))).alias("w")) for i in (0, 1) for j in (0, 1))))
    asked = points.select(point, corners.alias("c")).select(point, "c.*")
    found = asked.join(grid.select("gx", "gy", value), ["gx", "gy"], "left").groupBy(point).agg(F.sum(F.col("w") * F.col(value)).alias("s"), F.count(value).alias("n"))
    return found.select(point, F.when(F.col("n") == 4, F.col("s")).otherwise(0.0).alias(value))


def nearest_raster(points: DataFrame, value: str, size: int, scene: str = "scene_id", point: str = "point_id") -> DataFrame:
    """scene, row, col and the value of the point nearest to each cell's centre; row 0 is on top."""
    box = points.groupBy(scene).agg(*(f(a).alias(f"{n}{a}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    grid = box.withColumn("row", F.explode(steps)).withColumn("col", F.explode(steps))
    centre = lambda a, k: F.col(f"lo{a}") + (k + 0.5) / size * (F.col(f"hi{a}") - F.col(f"lo{a}"))
    cells_ = grid.select(scene, (F.col("row") * size + F.col("col")).cast("long").alias("cell"), centre("x", F.col("col")).alias("x"), centre("y", size - 1 - F.col("row")).alias("y"))
    near = nearest(cells_, points.select(scene, F.col(point).alias("source_id"), "x", "y"), scene, "cell", dims=("x", "y"))
    out = near.join(points.select(scene, F.col(point).alias("source_id"), F.col(value).alias("value")), [scene, "source_id"])
    return out.select(scene, F.floor(F.col("cell") / size).cast("int").alias("row"), (F.col("cell") % size).cast("int").alias("col"), "value")


def hard_core(points: DataFrame, radius: float, mark: str, scene: str = "scene_id", point: str = "point_id") -> DataFrame:
    """The points that no point of a lower mark stands nearer to than radius (Matérn's second process); a range join by cells."""
    other = cells(points.select(scene, F.col(point).alias("__p"), "x", "y", F.col(mark).alias("__m")), radius)
    for d in ("x", "y"):
        other = other.withColumn(f"c_{d}", F.explode(F.array(*(F.col(f"c_{d}") + k for k in (-1, 0, 1)))))
    other = other.select(F.col(scene).alias("__s"), "__p", F.col("x").alias("__x"), F.col("y").alias("__y"), "__m", F.col("c_x").alias("__cx"), F.col("c_y").alias("__cy"))
    apart = (F.col("x") - F.col("__x")) ** 2 + (F.col("y") - F.col("__y")) ** 2
    lower = (F.col("__m") < F.col(mark)) | ((F.col("__m") == F.col(mark)) & (F.col("__p") < F.col(point)))
    on = (F.col(scene) == F.col("__s")) & (F.col("c_x") == F.col("__cx")) & (F.col("c_y") == F.col("__cy")) & lower & (apart < radius * radius)
    return cells(points, radius).join(other, on, "left_anti").select(*points.columns)


def mix_edges(points: DataFrame, chosen: Column, k: int = 5, scene: str = "scene_id", point: str = "point_id") -> DataFrame:
    """x, y and z of the chosen points become the mean of their k nearest neighbours; others stay."""
    means = knn(points, k, scene, point).groupBy(scene, point).agg(*(F.avg(f"n_{a}").alias(f"__{a}") for a in "xyz"))
    out = points.withColumn("__chosen", chosen).join(means, [scene, point], "left")
    return out.withColumns({a: F.when(F.col("__chosen") & F.col(f"__{a}").isNotNull(), F.col(f"__{a}")).otherwise(F.col(a)) for a in "xyz"}).drop("__chosen", "__x", "__y", "__z")
