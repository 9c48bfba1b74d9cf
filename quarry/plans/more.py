"""Queries over augmentation, interpolation, seeds and text reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import draw
from ..operators import cracks as C
from ..operators import metrics as M
from ..operators import prepare as P
from ..operators import spatial as S
from .evaluation import PER, counts
from .preparation import SMALL, _draw, rounded, small
from . import views as V
from .registry import query
from .registry import r6 as q6
from .space import KNN


def _part(name):
    return f"(({_draw(42, repr(name), 'scene_id')} + 0.5) / 4294967296.0)"


def _shift(a):
    return f"0.2 * sqrt(-2 * ln({_part(a + '1')})) * cos(2 * pi() * {_part(a + '2')})"


@query(f"""WITH {SMALL}, p AS (SELECT *, 2 * pi() * {_part('angle')} AS a, 0.8 + 0.4 * {_part('scale')} AS s, {_shift('x')} AS tx, {_shift('y')} AS ty, {_shift('z')} AS tz FROM cloud_s)
  SELECT point_id, {q6('(cos(a)*x - sin(a)*y)*s + tx')} AS x, {q6('(sin(a)*x + cos(a)*y)*s + ty')} AS y, {q6('z*s + tz')} AS z, {q6('cos(a)*nx - sin(a)*ny')} AS nx, {q6('sin(a)*nx + cos(a)*ny')} AS ny, {q6('nz')} AS nz FROM p""")
def augmented_points(spark, folder):
    return rounded(P.augment(small(spark, folder)).select("point_id", "x", "y", "z", "nx", "ny", "nz"), "x", "y", "z", "nx", "ny", "nz")


@query(f"""WITH {SMALL}, g AS (SELECT CAST(i AS INTEGER) AS gx, CAST(j AS INTEGER) AS gy, sin(i) * cos(j) AS v FROM range(10) a(i), range(10) b(j)), p AS (SELECT point_id, abs(x) * 5 AS x, abs(y) * 5 AS y FROM cloud_s), q AS (SELECT *, CAST(floor(x) AS INTEGER) AS fx, CAST(floor(y) AS INTEGER) AS fy FROM p)
  SELECT point_id, {q6("coalesce((1-(x-fx))*(1-(y-fy))*a.v + (x-fx)*(1-(y-fy))*b.v + (1-(x-fx))*(y-fy)*c.v + (x-fx)*(y-fy)*d.v, 0)")} AS v FROM q LEFT JOIN g a ON a.gx = fx AND a.gy = fy LEFT JOIN g b ON b.gx = fx + 1 AND b.gy = fy LEFT JOIN g c ON c.gx = fx AND c.gy = fy + 1 LEFT JOIN g d ON d.gx = fx + 1 AND d.gy = fy + 1""")
def bilinear_values(spark, folder):
    k = F.col("id")
    grid = spark.range(100).select(F.floor(k / 10).cast("int").alias("gx"), (k % 10).cast("int").alias("gy"), (F.sin(F.floor(k / 10)) * F.cos(k % 10)).alias("v"))
    points = small(spark, folder).select("point_id", (F.abs("x") * 5).alias("x"), (F.abs("y") * 5).alias("y"))
    return rounded(S.bilinear(points, grid), "v")


@query(f"""WITH {SMALL}, b AS (SELECT scene_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM cloud_s GROUP BY 1), c AS (SELECT scene_id, r, k, lx + (k + 0.5) / 8 * (hx - lx) AS cx, ly + (7 - r + 0.5) / 8 * (hy - ly) AS cy FROM b, range(8) a(r), range(8) d(k))
  SELECT c.scene_id, CAST(r AS INTEGER) AS "row", CAST(k AS INTEGER) AS col, {q6("min_by(z, struct_pack(d := (x-cx)*(x-cx)+(y-cy)*(y-cy), i := point_id))")} AS value FROM c JOIN cloud_s USING (scene_id) GROUP BY ALL""")
def interpolated_raster(spark, folder):
    return rounded(S.nearest_raster(small(spark, folder), "z", 8), "value")


@query(f"""WITH {SMALL}, m AS (SELECT *, {_draw(5, 'scene_id', 'point_id')} AS mark FROM cloud_s)
  SELECT scene_id, point_id FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE a.scene_id = b.scene_id AND (b.mark < a.mark OR (b.mark = a.mark AND b.point_id < a.point_id)) AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) < 0.3 * 0.3)""")
def hard_core_seeds(spark, folder):
    marked = small(spark, folder).withColumn("mark", draw(5, F.col("scene_id"), F.col("point_id")))
    return S.hard_core(marked, 0.3, "mark").select("scene_id", "point_id")


@query(f"WITH {PER} SELECT label, printf('%3d | %8d | %8d', label, support, predicted_support) AS line FROM per")
def report_lines(spark, folder):
    return M.per_class(counts(spark, folder), 10).select("label", F.format_string("%3d | %8d | %8d", "label", "support", "predicted_support").alias("line"))


@query(f"WITH {KNN}, m AS (SELECT scene_id, point_id, avg(n_x) AS mx, avg(n_y) AS my, avg(n_z) AS mz FROM knn WHERE rank <= 5 GROUP BY ALL) SELECT c.scene_id, c.point_id, {q6('CASE WHEN abs(c.intensity) > 0.5 THEN mx ELSE c.x END')} AS x, {q6('CASE WHEN abs(c.intensity) > 0.5 THEN my ELSE c.y END')} AS y, {q6('CASE WHEN abs(c.intensity) > 0.5 THEN mz ELSE c.z END')} AS z FROM cloud_s c JOIN m USING (scene_id, point_id)")
def mixed_edges(spark, folder):
    return rounded(S.mix_edges(small(spark, folder), F.abs("intensity") > 0.5).select("scene_id", "point_id", "x", "y", "z"), "x", "y", "z")


def _noise(x, y, seed, scale=1.0):
    """Lattice noise as SQL, octave by octave."""
    parts = []
    for octave in range(4):
        f = 2.0**octave / scale
        u, v = (f"(({c}) * {f}::DOUBLE - floor(({c}) * {f}::DOUBLE)) * 7.0::DOUBLE" for c in (x, y))
        i, j = (f"least(floor({c}), 6)" for c in (u, v))
        corner = lambda a, b: f"({_draw(seed, repr('noise'), repr(str(octave)), f'CAST({i} + {a} AS BIGINT)', f'CAST({j} + {b} AS BIGINT)')} / 2147483648.0::DOUBLE - 1)"  # noqa: B023, E731
        fu, fv = f"({u} - {i})", f"({v} - {j})"
        parts.append(f"{0.5**octave} * ((1-{fu})*(1-{fv})*{corner(0, 0)} + {fu}*(1-{fv})*{corner(1, 0)} + (1-{fu})*{fv}*{corner(0, 1)} + {fu}*{fv}*{corner(1, 1)})")
    return " + ".join(parts)


@query(f"WITH {SMALL} SELECT scene_id, point_id, {q6(_noise('x', 'y', 11, 0.5))} AS noise FROM cloud_s")
def lattice_noise(spark, folder):
    """Four octaves of lattice noise at each point."""
    return rounded(small(spark, folder).select("scene_id", "point_id", C.value_noise("x", "y", 11, scale=0.5).alias("noise")), "noise")


def _width(name):
    return f"(({_draw(42, repr(name), 'scene_id', 'curve_id', 'k')} + 0.5) / 4294967296.0::DOUBLE)"


CONTROL = {f"{a}{n}": first + n for a, first in (("x", 1), ("y", 5)) for n in range(4)}
CRACKS = SMALL + f""", curves AS (SELECT CAST(label AS BIGINT) AS scene_id, vec_id AS curve_id, {", ".join(f"CAST(embedding[{k}] AS DOUBLE) AS {c}" for c, k in CONTROL.items())} FROM embeddings WHERE vec_id % 7 = 0),
  bez AS (SELECT scene_id, curve_id, k, {", ".join(f"pow(1-t,3)*{a}0 + 3*pow(1-t,2)*t*{a}1 + 3*(1-t)*t*t*{a}2 + t*t*t*{a}3 AS {a}" for a in "xy")} FROM (SELECT *, k / 24.0::DOUBLE AS t FROM curves, range(25) r(k))),
  knots AS (SELECT scene_id, curve_id, k, mx AS x, my AS y, w FROM (SELECT scene_id, curve_id, k, x + 0.02 * ({_noise("x", "y", "42x")}) AS mx, y + 0.02 * ({_noise("x", "y", "42y")}) AS my, 0.05 * exp(0.3 * sqrt(-2 * ln({_width("w1")})) * cos(2 * pi() * {_width("w2")})) AS w FROM bez)),
  lines AS (SELECT a.scene_id, a.curve_id, a.k, a.x AS ax, a.y AS ay, a.w AS aw, b.x AS bx, b.y AS by_, b.w AS bw FROM knots a JOIN knots b ON a.scene_id = b.scene_id AND a.curve_id = b.curve_id AND b.k = a.k + 1),
  meet AS (SELECT scene_id, point_id, curve_id, k, x, y, ax, ay, aw, bx, by_, bw, least(greatest(((x-ax)*(bx-ax)+(y-ay)*(by_-ay)) / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)), 0), 1) AS t FROM cloud_s JOIN lines USING (scene_id)),
  far AS (SELECT *, sqrt(pow(x-(ax+t*(bx-ax)),2)+pow(y-(ay+t*(by_-ay)),2)) AS distance FROM meet),
  least_ AS (SELECT scene_id, point_id, curve_id, min_by(struct_pack(distance := distance, t := (k + t) / 24.0::DOUBLE, width := aw + t * (bw - aw)), struct_pack(d := distance, k := k)) AS m FROM far GROUP BY ALL), best AS (SELECT scene_id, point_id, curve_id, m.distance AS distance, m.t AS t, m.width AS width FROM least_)"""


@query(f"""WITH {CRACKS} SELECT scene_id, point_id, curve_id, {q6("distance")} AS distance, {q6("t")} AS t, {q6("width")} AS width, {q6("CASE WHEN distance <= width / 2 THEN -0.03 * exp(-pow(distance / (width / 4), 2)) ELSE 0 END")} AS dz FROM best WHERE distance <= greatest(width, 0.06) / 2""")
def crack_points(spark, folder):
    """Cracks along curves whose control points are components of embeddings: the points each one moves or labels."""
    e = F.col("embedding")
    curves = V.table(spark, folder, "embeddings").where("vec_id % 7 = 0").select(F.col("label").cast("long").alias("scene_id"), F.col("vec_id").alias("curve_id"), *(F.get(e, F.lit(k - 1)).cast("double").alias(c) for c, k in CONTROL.items()))
    lines = C.segments(curves, 24, width_mean=0.05)
    found = C.crack(small(spark, folder), lines, 0.03, 0.06).withColumn("t", (F.col("k") + F.col("t")) / 24.0)
    return rounded(found.select("scene_id", "point_id", "curve_id", "distance", "t", "width", "dz"), "distance", "t", "width", "dz")
