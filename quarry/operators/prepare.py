"""Row-wise preparation of points, and quantities of a scene put beside its points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, col, draw, is_finite, norm
from ..functions.settle import settled

# Metres in a unit, and the full scale of stored intensities.
UNITS = {"m": 1.0, "cm": 0.01, "mm": 0.001}
FULL_SCALE = {"normalized": 1.0, "uint8": 255.0, "uint16": 65535.0}


def to_metres(value: Column, units: Column) -> Column:
    """value in metres; an unknown unit raises."""
    out = F.raise_error(F.concat(F.lit("unknown unit "), units)).cast("double")
    for name, size in UNITS.items():
        out = F.when(units == name, value * size).otherwise(out)
    return out


def normalize_intensity(value: Column, scale: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Intensity from 0 to 1 by its scale: normalized, uint8, uint16, or range (between low and high)."""
    out = F.lit(None).cast("double")
    for name, full in FULL_SCALE.items():
        out = F.when(scale == name, value / full).otherwise(out)
    if low is not None:
        out = F.when(scale == "range", F.try_divide(value - low, high - low)).otherwise(out)
    return clip(out, 0, 1)


def inferred_scale(path: Column, top: Column) -> Column:
    """The intensity scale that a file's ending and its highest intensity imply."""
    low = F.lower(path)
    return F.when(low.rlike(r"\.la[sz]$"), "uint16").when(low.rlike(r"\.pcd$") & (top > 1), "uint8").otherwise("normalized")


def guard_intensity(rows: DataFrame, value: str = "intensity", scene: str = "scene_id", into: str = "intensity_n") -> DataFrame:
    """Null intensities become 0; non-finite ones the scene's median of finite ones, or 0; then clipped to 0..1.

    The medians are an aggregate of a row for each scene that joins back, so a large scene isn't
    gathered in one task.
    """
    finite = F.when(is_finite(value), F.col(value))
    medians = rows.groupBy(F.col(scene).alias("__s")).agg(F.percentile(finite, 0.5).alias("__m"))
    out = rows.join(medians, rows[scene].eqNullSafe(medians["__s"]), "left")
    clean = F.when(F.col(value).isNull(), 0.0).otherwise(F.coalesce(finite, "__m", F.lit(0.0)))
    return out.withColumn(into, clip(clean, 0, 1)).drop("__s", "__m")


def unit_ball(rows: DataFrame, scene: str = "scene_id") -> DataFrame:
    """x, y, z relative to the scene's centroid in units of its largest radius; adds cx, cy, cz and scale.

    A scene of one place has scale 1.
    """
    centre = rows.groupBy(F.col(scene).alias("__s")).agg(*(F.avg(a).alias(f"c{a}") for a in "xyz"))
    moved = rows.join(centre, F.col(scene) == F.col("__s")).drop("__s")
    radius = moved.groupBy(F.col(scene).alias("__s")).agg(F.max(norm(*(F.col(a) - F.col(f"c{a}") for a in "xyz"))).alias("scale"))
    out = moved.join(radius, F.col(scene) == F.col("__s")).drop("__s").withColumn("scale", F.when(F.col("scale") <= 1e-12, 1.0).otherwise(F.col("scale")))
    return out.withColumns({a: (F.col(a) - F.col(f"c{a}")) / F.col("scale") for a in "xyz"})


def from_unit_ball(rows: DataFrame) -> DataFrame:
    """The inverse of unit_ball, for rows that carry cx, cy, cz and scale; others stay as they are."""
    known = F.col("scale").isNotNull() & F.col("cx").isNotNull()
    return rows.withColumns({a: F.when(known, F.col(a) * F.col("scale") + F.col(f"c{a}")).otherwise(F.col(a)) for a in "xyz"})


def unit_normals(rows: DataFrame, names: tuple[str, str, str] = ("nx", "ny", "nz")) -> DataFrame:
    """Normals of length 1; those shorter than 1e-12 become zero, missing ones stay null."""
    size = norm(*names)
    return rows.withColumns({n: F.when(size > 1e-12, F.col(n) / size).when(size.isNotNull(), 0.0) for n in names})


def upward(rows: DataFrame, names: tuple[str, str, str] = ("nx", "ny", "nz")) -> DataFrame:
    """Normals turned so that they don't point down."""
    sign = F.when(F.col(names[2]) < 0, -1.0).otherwise(1.0)
    return rows.withColumns({n: F.col(n) * sign for n in names})


def supplied_or(rows: DataFrame, supplied: tuple[str, str, str], other: tuple[str, str, str]) -> DataFrame:
    """The supplied normals where they are longer than 1e-8, else the other ones, in the other's columns."""
    use = F.coalesce(norm(*supplied) > 1e-8, F.lit(False))
    return rows.withColumns({o: F.when(use, F.col(s) / norm(*supplied)).otherwise(F.col(o)) for s, o in zip(supplied, other)})


def tilt(nz: Column | str) -> Column:
    return F.acos(clip(nz, -1, 1))


def real_points(rows: DataFrame) -> DataFrame:
    """Rows with finite coordinates that aren't the zero return of a scanner."""
    return rows.where(is_finite("x") & is_finite("y") & is_finite("z")).where(norm("x", "y", "z") > 1e-8)


def spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Range, azimuth and elevation."""
    r = F.sqrt(x * x + y * y + z * z) + 1e-12
    return r, F.atan2(y, x), F.asin(clip(z / r, -1, 1))


def cartesian(r: Column, azimuth: Column, elevation: Column) -> tuple[Column, Column, Column]:
    return r * F.cos(elevation) * F.cos(azimuth), r * F.cos(elevation) * F.sin(azimuth), r * F.sin(elevation)


def morton(rows: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Adds morton: ten bits an axis of the place within the scene's box, x lowest."""
    box = rows.groupBy(F.col(scene).alias("__s")).agg(*(f(a).alias(f"__{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    out = rows.join(box, F.col(scene) == F.col("__s"))

    def spread(a):
        size = F.col(f"__hi{a}") - F.col(f"__lo{a}")
        v = F.floor((F.col(a) - F.col(f"__lo{a}")) / F.when(size < 1e-6, 1.0).otherwise(size) * 1023).cast("long")
        for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    code = spread("x").bitwiseOR(F.shiftleft(spread("y"), 1)).bitwiseOR(F.shiftleft(spread("z"), 2))
    return out.withColumn("morton", code).drop("__s", *(f"__{n}{a}" for a in "xyz" for n in ("lo", "hi")))


def windows3d(rows: DataFrame, size: int = 32, shifted: bool = False, scene: str = "scene_id") -> DataFrame:
    """Adds window_id: the cell of a grid with about `size` points a cell; shifted moves it by half a cell."""
    box = rows.groupBy(F.col(scene).alias("__s")).agg(F.count("*").alias("__n"), *(f(a).alias(f"__{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    out = rows.join(box, F.col(scene) == F.col("__s"))
    grid = F.greatest(F.lit(1), F.bround(F.cbrt(F.col("__n") / size)).cast("int"))

    def cell(a):
        span = F.col(f"__hi{a}") - F.col(f"__lo{a}")
        v = (F.col(a) - F.col(f"__lo{a}")) / F.when(span < 1e-6, 1.0).otherwise(span)
        if shifted:
            v = (v + 0.5 / grid) % 1.0
        return F.least(F.floor(v * grid).cast("int"), grid - 1)

    code = (cell("x") * grid + cell("y")) * grid + cell("z")
    return out.withColumn("window_id", code).drop("__s", "__n", *(f"__{n}{a}" for a in "xyz" for n in ("lo", "hi")))


def point_segment(px, py, ax, ay, bx, by) -> tuple[Column, Column]:
    """Distance of a point to a segment, and where on it the nearest place is (0 to 1)."""
    px, py, ax, ay, bx, by = map(col, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size < 1e-12, 0.0).otherwise(clip(F.try_divide((px - ax) * dx + (py - ay) * dy, size), 0, 1))
    return norm(px - (ax + t * dx), py - (ay + t * dy)), t


def rounded_rectangle(x, y, cx, cy, half_w, half_l, radius, angle) -> Column:
    """Signed distance to a turned rectangle with round corners; negative inside."""
    x, y = col(x) - cx, col(y) - cy
    u, v = x * F.cos(F.lit(angle)) + y * F.sin(F.lit(angle)), -x * F.sin(F.lit(angle)) + y * F.cos(F.lit(angle))
    qx, qy = F.abs(u) - half_w + radius, F.abs(v) - half_l + radius
    zero = F.lit(0.0)
    return norm(F.greatest(qx, zero), F.greatest(qy, zero)) + F.least(F.greatest(qx, qy), zero) - radius


def smoothstep(t: Column) -> Column:
    t = clip(t, 0, 1)
    return t * t * (3.0 - 2.0 * t)


def bezier(p0, p1, p2, p3, t: Column) -> Column:
    """Cubic Bézier curve, one coordinate."""
    s = 1.0 - t
    return s * s * s * p0 + 3.0 * s * s * t * p1 + 3.0 * s * t * t * p2 + t * t * t * p3


def unit_grid(rows: DataFrame, value: str) -> DataFrame:
    """A grid's values from 0 to 1; missing ones 0; a constant grid is all 0."""
    span = rows.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    out = rows.crossJoin(F.broadcast(span))  # one row
    size = F.col("__hi") - F.col("__lo")
    return out.withColumn(value, F.coalesce(F.when(size >= 1e-12, (F.col(value) - F.col("__lo")) / size), F.lit(0.0))).drop("__lo", "__hi")


def conv3(rows: DataFrame, value: str, weights: tuple[float, float, float], order: str, scene: str = "scene_id") -> DataFrame:
    """Adds conv: a kernel of three along the order of a scene, with zeros beyond its ends."""
    w = Window.partitionBy(scene).orderBy(order)
    a, b, c = weights
    return rows.withColumn("conv", F.coalesce(F.lag(value).over(w), F.lit(0.0)) * a + F.col(value) * b + F.coalesce(F.lead(value).over(w), F.lit(0.0)) * c)


def decay_scan(rows: DataFrame, value: str, order: str, alpha: float, scene: str = "scene_id", block: int = 64, levels: int = 2) -> DataFrame:
    """scene, order and state: s[t] = x[t] + alpha s[t-1] along the order, as an associative scan.

    Places are numbered, and blocks of `block` places are folded each by itself from 0.  What the blocks end with is a scan again, with
    alpha ** block, and tells what each of them begins with; after `levels` such steps the few numbers left of a scene are one fold.
    So arrays hold a block's rows, never a scene's.  A row's state is its own one and its block's beginning, decayed to its place.
    """
    at = F.row_number().over(Window.partitionBy(scene).orderBy(order)) - 1
    placed = rows.select(scene, at.cast("long").alias("__at"), F.col(order).alias("__o"), F.col(value).cast("double").alias("__x"))
    return _scanned(placed, float(alpha), scene, block, levels).select(scene, F.col("__o").alias(order), F.col("__s").alias("state"))


def _scanned(placed: DataFrame, alpha: float, scene: str, block: int, levels: int) -> DataFrame:
    """scene, __at, __o and the state __s of rows (scene, __at, __o, __x)."""
    size = block if levels else 1 << 62
    blocks = placed.groupBy(scene, F.floor(F.col("__at") / size).cast("long").alias("__b")).agg(F.array_sort(F.collect_list(F.struct("__at", "__o", "__x"))).alias("__v"))
    states = F.aggregate("__v", F.expr("cast(array() as array<double>)"), lambda all_, v: F.concat(all_, F.array(v["__x"] + alpha * F.coalesce(F.get(all_, F.size(all_) - 1), F.lit(0.0)))))
    blocks = blocks.withColumn("__t", states)
    if not levels:
        return blocks.select(scene, F.explode(F.arrays_zip("__v", "__t")).alias("r")).select(scene, "r.__v.__at", "r.__v.__o", F.col("r.__t").alias("__s"))
    blocks = settled(blocks)
    ends = blocks.select(scene, F.col("__b").alias("__at"), F.lit(None).cast("long").alias("__o"), F.element_at("__t", -1).alias("__x"))
    before = _scanned(ends, alpha**block, scene, block, levels - 1).select(scene, (F.col("__at") + 1).alias("__b"), F.col("__s").alias("__begin"))
    out = blocks.join(before, [scene, "__b"], "left").select(scene, "__begin", F.posexplode(F.arrays_zip("__v", "__t")).alias("__k", "r"))
    begin = F.coalesce("__begin", F.lit(0.0)) * F.pow(F.lit(alpha), F.col("__k") + 1)
    return out.select(scene, "r.__v.__at", "r.__v.__o", (F.col("r.__t") + begin).alias("__s"))


def augment(points: DataFrame, seed: int = 42, scene: str = "scene_id") -> DataFrame:
    """Each scene turned about z, scaled by 0.8 to 1.2 and moved (deviation 0.2 an axis); normals are only turned."""
    s = F.col(scene)
    part = lambda name: (draw(seed, F.lit(name), s) + 0.5) / float(1 << 32)
    angle, size = 2.0 * math.pi * part("angle"), 0.8 + 0.4 * part("scale")
    shift = {a: 0.2 * F.sqrt(-2.0 * F.log(part(f"{a}1"))) * F.cos(2.0 * math.pi * part(f"{a}2")) for a in "xyz"}
    c, n = F.cos(angle), F.sin(angle)
    x, y, nx, ny = (F.col(v) for v in ("x", "y", "nx", "ny"))
    return points.withColumns({
        "x": (c * x - n * y) * size + shift["x"], "y": (n * x + c * y) * size + shift["y"], "z": F.col("z") * size + shift["z"], "nx": c * nx - n * ny, "ny": n * nx + c * ny,
    })
