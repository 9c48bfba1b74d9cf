"""Cracks along curves: lattice noise, curves as tables of segments, and the points within a curve's reach.

A curve is a cubic Bézier curve sampled at evenly spaced knots, which lattice noise moves a little; each knot has a
width of its own, and the width between knots is interpolated along the curve's parameter.  Points and segments
meet by an equi-join of grid cells: a segment is copied to the cells that its box, widened by half the curve's greatest
width, touches, so each point within reach of a curve is found, and a point meets nothing else but segments near it.
The pairs, of which there are as many as points times curves that reach them, aren't shuffled, and cells are parted by the pairs
that they hold, so that a task puts its pairs in order in its memory.

Edge cases: points and curves with a null coordinate, width, scene or id take no part; a curve without length is
a point; repeated points are kept apart by their ids; of segments that are equally near the first counts; empty tables give an empty one;
further columns of points and curves are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, draw
from ..functions.settle import kept
from .prepare import bezier, point_segment
from .shapes import crack_profile

#: Corners of the noise lattice along each axis.
LATTICE = 8
#: Pairs of points and segments of a cell's block (as many of the ones as of the others) and, on average, of a task.
PAIRS = 1_000_000
#: The longest segment of a scene is as long as so many cells.
LONGEST = 8


def value_noise(x: Column | str, y: Column | str, seed: int | Column = 0, octaves: int = 4, lacunarity: float = 2.0, persistence: float = 0.5, scale: float = 1.0) -> Column:
    """A sum of octaves of lattice noise: corners of a repeating lattice are drawn in [-1, 1) by hash, places between are blended bilinearly.

    Each octave has `lacunarity` times the frequency and `persistence` times the height of the one before.
    """
    x, y = col(x), col(y)
    # the coordinates stay out of the lambdas: in there a name can mean another column of the same select
    levels = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(persistence**k).alias("h"), (x * (lacunarity**k / scale)).alias("u"), (y * (lacunarity**k / scale)).alias("v")) for k in range(octaves)))
    part = lambda c: (c - F.floor(c)) * float(LATTICE - 1)
    places = F.transform(levels, lambda o: F.struct(o["k"].alias("k"), o["h"].alias("h"), part(o["u"]).alias("u"), part(o["v"]).alias("v")))
    low = lambda c: F.least(F.floor(c), F.lit(LATTICE - 2))
    cells = F.transform(places, lambda p: F.struct(p["k"].alias("k"), p["h"].alias("h"), low(p["u"]).alias("i"), low(p["v"]).alias("j"), (p["u"] - low(p["u"])).alias("fu"), (p["v"] - low(p["v"])).alias("fv")))

    def blended(c: Column) -> Column:
        corner = lambda a, b: draw(seed, "noise", c["k"], c["i"] + a, c["j"] + b) / 2147483648.0 - 1.0
        below = (1.0 - c["fu"]) * corner(0, 0) + c["fu"] * corner(1, 0)
        above = (1.0 - c["fu"]) * corner(0, 1) + c["fu"] * corner(1, 1)
        return c["h"] * ((1.0 - c["fv"]) * below + c["fv"] * above)

    return F.aggregate(cells, F.lit(0.0), lambda total, c: total + blended(c))


def segments(curves: DataFrame, samples: int = 100, width_mean: float = 0.005, width_std: float = 0.3, sway: float = 0.02, seed: int = 42, scene: str = "scene_id", curve: str = "curve_id") -> DataFrame:
    """scene, curve, k and each segment's ends (ax, ay, bx, by) and widths there (aw, bw); curves have the control points' columns x0..x3 and y0..y3.

    Knots are moved by up to `sway` times lattice noise; widths are log-normal draws.
    """
    step = 1.0 / samples
    # a curve's knots are drawn where they are put together
    curves = curves.repartition(int(curves.sparkSession.conf.get("spark.sql.shuffle.partitions")), scene, curve)
    knots = curves.select(scene, curve, *(f"{a}{n}" for a in "xy" for n in range(4)), F.explode(F.sequence(F.lit(0), F.lit(samples))).alias("k"))
    at = {a: bezier(*(F.col(f"{a}{n}") for n in range(4)), F.col("k") * step) for a in "xy"}
    knots = knots.select(scene, curve, "k", at["x"].alias("x"), at["y"].alias("y"))
    knots = knots.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in (scene, curve, "x", "y")]))
    part = lambda name: (draw(seed, name, F.col(scene), F.col(curve), F.col("k")) + 0.5) / 4294967296.0
    normal = F.sqrt(-2.0 * F.log(part("w1"))) * F.cos(2.0 * F.pi() * part("w2"))
    moved = {a: F.col(a) + sway * value_noise("x", "y", f"{seed}{a}") for a in "xy"}
    knots = knots.select(scene, curve, "k", moved["x"].alias("x"), moved["y"].alias("y"), (width_mean * F.exp(width_std * normal)).alias("w"))
    row = F.struct("k", "x", "y", "w")
    held = knots.groupBy(scene, curve).agg(F.array_sort(F.collect_list(row)).alias("p"))  # samples + 1 a curve
    pairs = F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("a"), F.slice("p", 2, F.size("p") - 1).alias("b"))
    each = held.select(scene, curve, F.explode(pairs).alias("s"))
    return each.select(scene, curve, F.col("s.a.k").alias("k"), *(F.col(f"s.{e}.{c}").alias(f"{e}{c}") for e in "ab" for c in "xyw"))


def along(points: DataFrame, lines: DataFrame, label_width: float = 0.0, scene: str = "scene_id", point: str = "point_id", curve: str = "curve_id") -> DataFrame:
    """scene, point, curve, distance, k and t (the nearest segment and the place on it) and width of each point that a curve reaches.

    A curve reaches as far as half its greatest width, or half the label's least width.
    """
    lines = kept(lines)  # knots are costly to draw
    reach = F.greatest(F.max(F.greatest("aw", "bw")), F.lit(float(label_width))) / 2.0 * (1 + 1e-9)
    reaches = lines.groupBy(scene, curve).agg(reach.alias("__r"))
    wide = lines.join(reaches, [scene, curve])
    extent = F.greatest(F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by")))
    span = extent + 2.0 * F.col("__r")
    size = wide.groupBy(scene).agg(F.greatest(F.max(span) / LONGEST, F.avg(span) / 2.0, F.lit(1e-9)).alias("__size"))
    wide = wide.join(size, scene)
    for a in "xy":
        low, high = F.least(f"a{a}", f"b{a}") - F.col("__r"), F.greatest(f"a{a}", f"b{a}") + F.col("__r")
        wide = wide.withColumn(f"__c{a}", F.explode(F.sequence(F.floor(low / F.col("__size")), F.floor(high / F.col("__size")))))
    placed = points.select(scene, point, "x", "y").where(F.col(scene).isNotNull() & F.col(point).isNotNull()).join(size, scene)
    placed = placed.withColumns({f"__c{a}": F.floor(F.col(a) / F.col("__size")) for a in "xy"}).drop("__size")
    distance, t = point_segment("x", "y", "ax", "ay", "bx", "by")
    # a cell is cut into blocks: a share of its points meets a share of its curves, so the pairs of a point and a curve are reduced where they are made
    spot, side = [scene, "__cx", "__cy"], math.isqrt(PAIRS)
    load = placed.groupBy(*spot).agg(F.count("*").alias("__n")).join(wide.groupBy(*spot).agg(F.count("*").alias("__m")), spot)
    load = kept(load)
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((load.agg(F.sum(F.col("__n") * F.col("__m"))).first()[0] or 0) / PAIRS))
    shares = load.select(*spot, *(F.ceil(F.col(n) / side).alias(share) for n, share in (("__n", "__points"), ("__m", "__curves"))))
    own = lambda key, n: F.pmod(F.xxhash64(key), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    placed = placed.join(shares, spot).withColumn("__p", own(point, "__points")).withColumn("__c", each("__curves")).drop("__points", "__curves")
    wide = wide.join(shares, spot).withColumn("__c", own(curve, "__curves")).withColumn("__p", each("__points")).drop("__points", "__curves", "__size")
    cell = [*spot, "__p", "__c"]
    placed, wide = (df.repartition(parts, *cell) for df in (placed, wide))
    near = placed.join(wide.hint("merge"), cell).withColumns({"distance": distance, "t": t}).where(F.col("distance") <= F.col("__r"))
    width = F.col("aw") + F.col("t") * (F.col("bw") - F.col("aw"))
    best = near.groupBy(*cell, point, curve).agg(F.min(F.struct("distance", "k", "t", width.alias("width"))).alias("m"))
    return best.select(scene, point, curve, "m.distance", "m.k", "m.t", "m.width")


def crack(points: DataFrame, lines: DataFrame, depth: float, label_width: float = 0.0, scene: str = "scene_id", point: str = "point_id", curve: str = "curve_id") -> DataFrame:
    """`along` with dz, the groove's height at the point, and labelled; only points that a curve moves or labels have a row."""
    found = along(points, lines, label_width, scene, point, curve)
    dz, labelled = crack_profile("distance", F.col("width"), depth, label_width)
    return found.withColumns({"dz": dz, "labelled": labelled}).where("labelled")
