"""Queries over neighbourhoods, rasters and domain gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gap as G
from ..operators import prepare as P
from ..operators import spatial as S
from ..operators.tiles import GEOMETRY
from . import views as V
from .preparation import BOX, SMALL, _cell, _draw, rounded, small
from .registry import query
from .registry import r6 as q6

D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"
KNN = SMALL + f""", knn AS (SELECT a.scene_id, a.point_id, b.point_id AS neighbour, a.x, a.y, a.z, b.x AS n_x, b.y AS n_y, b.z AS n_z, {D2} AS d2, CAST(row_number() OVER (PARTITION BY a.scene_id, a.point_id ORDER BY {D2}, b.point_id) AS INTEGER) AS rank
  FROM cloud_s a JOIN cloud_s b ON a.scene_id = b.scene_id AND a.point_id <> b.point_id QUALIFY rank <= 16)"""


@query(f"WITH {KNN} SELECT scene_id, point_id, neighbour, rank, {q6('d2')} AS d2 FROM knn")
def nearest_neighbours(spark, folder):
    return rounded(S.knn(small(spark, folder)).select("scene_id", "point_id", "neighbour", "rank", "d2"), "d2")


EIGEN = KNN + """, cov AS (SELECT scene_id, point_id, covar_samp(n_x, n_x) AS a, covar_samp(n_y, n_y) AS b, covar_samp(n_z, n_z) AS c, covar_samp(n_x, n_y) AS d, covar_samp(n_x, n_z) AS e, covar_samp(n_y, n_z) AS f, greatest(sqrt(max(d2)), 1e-6) AS radius, count(*) AS n FROM knn GROUP BY ALL),
  eig AS (SELECT *, (a+b+c)/3 AS q FROM cov), eig2 AS (SELECT *, sqrt(((a-q)*(a-q)+(b-q)*(b-q)+(c-q)*(c-q)+2*(d*d+e*e+f*f))/6) AS p FROM eig),
  eig3 AS (SELECT *, least(greatest(((a-q)*((b-q)*(c-q)-f*f) - d*(d*(c-q)-f*e) + e*(d*f-(b-q)*e)) / (2*p*p*p), -1), 1) AS r FROM eig2)"""


@query(f"WITH {EIGEN} SELECT scene_id, point_id, {q6('least(greatest((q + 2*p*cos(acos(r)/3 + 2*pi()/3)) / (a+b+c), 0), 1)')} AS curvature, {q6('radius')} AS radius, {q6('n / (pi() * radius * radius)')} AS density FROM eig3")
def local_curvature(spark, folder):
    return rounded(S.curvature(small(spark, folder)), "curvature", "radius", "density")


def _cross(p, q):
    return f"({p[1]})*({q[2]})-({p[2]})*({q[1]})", f"({p[2]})*({q[0]})-({p[0]})*({q[2]})", f"({p[0]})*({q[1]})-({p[1]})*({q[0]})"


# the smallest eigenvalue v in closed form, made sharper by Newton's steps; its vector stands across two rows of the matrix less v
_M = (("a-v", "d", "e"), ("d", "b-v", "f"), ("e", "f", "c-v"))
_ACROSS = ", ".join("struct_pack(s := (({0})**2 + ({1})**2 + ({2})**2), x := {0}, y := {1}, z := {2})".format(*_cross(_M[i], _M[j])) for i, j in ((0, 1), (0, 2), (1, 2)))
GEOMETRY_L = V.CLOUD_L + f""", near_l AS (SELECT a.*, b.x AS n_x, b.y AS n_y, b.z AS n_z, {D2} AS d2
  FROM cloud_l a JOIN cloud_l b ON a.scene_id = b.scene_id AND a.point_id <> b.point_id QUALIFY row_number() OVER (PARTITION BY a.scene_id, a.point_id ORDER BY {D2}, b.point_id) <= 16),
  cov AS (SELECT scene_id, point_id, any_value(x) - avg(n_x) AS ox, any_value(y) - avg(n_y) AS oy, any_value(z) - avg(n_z) AS oz, any_value(intensity) AS intensity, covar_samp(n_x, n_x) AS a, covar_samp(n_y, n_y) AS b, covar_samp(n_z, n_z) AS c,
    covar_samp(n_x, n_y) AS d, covar_samp(n_x, n_z) AS e, covar_samp(n_y, n_z) AS f, greatest(sqrt(max(d2)), 1e-6) AS radius, count(*) AS n FROM near_l GROUP BY ALL),
  eig AS (SELECT *, (a+b+c)/3 AS q FROM cov), eig2 AS (SELECT *, sqrt(((a-q)*(a-q)+(b-q)*(b-q)+(c-q)*(c-q)+2*(d*d+e*e+f*f))/6) AS p FROM eig),
  eig3 AS (SELECT *, least(greatest(((a-q)*((b-q)*(c-q)-f*f) - d*(d*(c-q)-f*e) + e*(d*f-(b-q)*e)) / (2*p*p*p), -1), 1) AS r FROM eig2), root0 AS (SELECT *, q + 2*p*cos(acos(r)/3 + 2*pi()/3) AS v FROM eig3),
  {", ".join(f"root{k + 1} AS (SELECT * REPLACE (v + ((a-v)*((b-v)*(c-v)-f*f) - d*(d*(c-v)-f*e) + e*(d*f-(b-v)*e)) / ((b-v)*(c-v)-f*f + (a-v)*(c-v)-e*e + (a-v)*(b-v)-d*d) AS v) FROM root{k})" for k in range(3))},
  across AS (SELECT *, list_max([{_ACROSS}]) AS m FROM root3), upward AS (SELECT *, sqrt(m.s) * CASE WHEN m.z < 0 THEN -1 ELSE 1 END AS s FROM across),
  geometry_l AS (SELECT scene_id, point_id, least(greatest(v / greatest(a+b+c, 1e-12), 0), 1) AS curvature, m.x / s AS nx, m.y / s AS ny, m.z / s AS nz, (ox * m.x + oy * m.y + oz * m.z) / s AS residual, radius, n / (pi() * radius * radius) AS density, intensity FROM upward)"""


@query(f"WITH {GEOMETRY_L} SELECT scene_id, point_id, {', '.join(f'{q6(c)} AS {c}' for c in GEOMETRY)} FROM geometry_l")
def local_geometry(spark, folder):
    """Geometry of all points of the large cloud."""
    return rounded(S.local_geometry(V.cloud_l(spark, folder)), *GEOMETRY)


@query(f"""WITH {GEOMETRY_L} SELECT scene_id, point_id, least(greatest(intensity, 0), 1)::FLOAT AS intensity_n, curvature::FLOAT AS curvature, least(greatest(residual / radius, -3), 3)::FLOAT AS residual FROM geometry_l""")
def observable_features(spark, folder):
    cloud = V.cloud_l(spark, folder)
    return S.observable_features(S.local_geometry(P.guard_intensity(cloud), keep=("intensity_n",))).select("scene_id", "point_id", "intensity_n", "curvature", "residual")


@query(f"""WITH {SMALL}, a AS (SELECT * FROM cloud_s WHERE point_id % 5 = 0), b AS (SELECT * FROM cloud_s WHERE point_id % 5 > 0), m AS (SELECT a.scene_id, a.point_id, min_by(b.point_id, struct_pack(d := {D2}, i := b.point_id)) AS source_id, sqrt(min({D2})) AS distance FROM a JOIN b USING (scene_id) GROUP BY ALL)
  SELECT scene_id, point_id, source_id, {q6("distance")} AS distance, CAST(CASE WHEN distance > 1.2 AND source_id % 38 BETWEEN 1 AND 8 THEN 0 ELSE source_id % 38 END AS BIGINT) AS label FROM m""")
def label_transfer(spark, folder):
    """Each point takes the label of the nearest source; thin damage isn't taken from afar."""
    cloud = small(spark, folder)
    found = S.nearest(cloud.where("point_id % 5 = 0"), cloud.where("point_id % 5 > 0").withColumnRenamed("point_id", "source_id"))
    label = F.col("source_id") % 38
    return rounded(found.withColumn("label", F.when((F.col("distance") > 1.2) & label.between(1, 8), 0).otherwise(label)), "distance")


@query(f"""WITH {SMALL}, a AS (SELECT * FROM cloud_s WHERE point_id % 3 = 0), b AS (SELECT * FROM cloud_s WHERE point_id % 3 > 0)
  SELECT a.scene_id, a.point_id, min_by(b.point_id, struct_pack(d := (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), i := b.point_id)) AS source_id, {q6("sqrt(min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)))")} AS distance
  FROM a JOIN b ON a.scene_id = b.scene_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 0.5 * 0.5 GROUP BY ALL""")
def label_dilation(spark, folder):
    cloud = small(spark, folder)
    found = S.nearest_within(cloud.where("point_id % 3 = 0"), cloud.where("point_id % 3 > 0").withColumnRenamed("point_id", "source_id"), 0.5)
    return rounded(found, "distance")


@query(f"""WITH {SMALL}, s AS (SELECT scene_id, point_id AS seed, x AS sx, y AS sy FROM cloud_s WHERE point_id % 10 = 0), d AS (SELECT c.scene_id, c.point_id, seed, sx, sy, (c.x-sx)*(c.x-sx)+(c.y-sy)*(c.y-sy) AS d2 FROM cloud_s c JOIN s USING (scene_id)),
  n AS (SELECT scene_id, point_id, min_by(struct_pack(seed := seed, x := sx, y := sy, d := d2), struct_pack(d := d2, i := seed)) AS f FROM d GROUP BY ALL)
  SELECT n.scene_id, n.point_id, f.seed AS seed_id, {q6("min((d2 - f.d) / (2 * sqrt((sx-f.x)*(sx-f.x)+(sy-f.y)*(sy-f.y))))")} AS ridge FROM n JOIN d ON n.scene_id = d.scene_id AND n.point_id = d.point_id AND d.seed <> f.seed GROUP BY ALL""")
def voronoi_cells(spark, folder):
    """The cell (nearest seed) of each point and its distance to the cell's boundary."""
    cloud = small(spark, folder).select("scene_id", "point_id", "x", "y")
    out = S.ridges(cloud, cloud.where("point_id % 10 = 0").withColumnRenamed("point_id", "seed_id"))
    return rounded(out, "ridge")


@query(f"""WITH {SMALL}, seg AS (SELECT k AS seg_id, -2.0 + k AS ax, sin(-2.0 + k) AS ay, -1.0 + k AS bx, sin(-1.0 + k) AS "by" FROM range(4) t(k)),
  d AS (SELECT point_id, seg_id, x, y, ax, ay, bx, "by", least(greatest(((x-ax)*(bx-ax)+(y-ay)*("by"-ay)) / ((bx-ax)*(bx-ax)+("by"-ay)*("by"-ay)), 0), 1) AS t FROM cloud_s, seg),
  e AS (SELECT *, sqrt(pow(x-(ax+t*(bx-ax)),2)+pow(y-(ay+t*("by"-ay)),2)) AS dist FROM d) SELECT point_id, {q6("min(dist)")} AS distance, min_by(seg_id, struct_pack(d := dist, s := seg_id)) AS seg_id, {q6("min_by(t, struct_pack(d := dist, s := seg_id))")} AS t FROM e GROUP BY point_id""")
def polyline_distance(spark, folder):
    """Distance of each point to a polyline, its segment (the first at ties) and the place on it."""
    k = F.col("id")
    seg = spark.range(4).select(k.alias("seg_id"), (k - 2.0).alias("ax"), F.sin(k - 2.0).alias("ay"), (k - 1.0).alias("bx"), F.sin(k - 1.0).alias("by"))
    d, t = P.point_segment("x", "y", "ax", "ay", "bx", "by")
    pairs = small(spark, folder).crossJoin(F.broadcast(seg)).withColumns({"d": d, "t": t})  # a polyline has few segments
    out = pairs.groupBy("point_id").agg(F.min(F.struct("d", "seg_id", "t")).alias("m")).select("point_id", F.col("m.d").alias("distance"), "m.seg_id", "m.t")
    return rounded(out, "distance", "t")


@query(f"WITH {V.CLOUD_L}, p AS (SELECT *, CAST(point_id % 5 AS INTEGER) AS label FROM cloud_l) SELECT scene_id, c_x, c_y, {q6('avg(x)')} AS x, {q6('avg(y)')} AS y, {q6('avg(z)')} AS z, {q6('avg(intensity)')} AS intensity, (SELECT 0) + CAST(max(n) AS BIGINT) AS n, CAST(min(CASE WHEN rk = 1 THEN label END) AS INTEGER) AS label FROM (SELECT *, count(*) OVER (PARTITION BY scene_id, c_x, c_y) AS n, dense_rank() OVER (PARTITION BY scene_id, c_x, c_y ORDER BY nl DESC, label) AS rk FROM (SELECT *, CAST(floor(x / 2.0) AS BIGINT) AS c_x, CAST(floor(y / 2.0) AS BIGINT) AS c_y, count(*) OVER (PARTITION BY scene_id, floor(x / 2.0), floor(y / 2.0), label) AS nl FROM p)) GROUP BY ALL")
def voxel_downsample(spark, folder):
    rows = V.cloud_l(spark, folder).withColumn("label", (F.col("point_id") % 5).cast("int"))
    return rounded(S.voxels(rows, 2.0), "x", "y", "z", "intensity")


LBOX = V.CLOUD_L + ", lb AS (SELECT scene_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM cloud_l GROUP BY 1)"
RASTER = LBOX + """, ras AS (SELECT scene_id, 31 - least(CAST(floor((y-ly)/(hy-ly+1e-9)*32) AS INTEGER), 31) AS "row", least(CAST(floor((x-lx)/(hx-lx+1e-9)*32) AS INTEGER), 31) AS col, avg(z) AS mean, max(z) AS max FROM cloud_l JOIN lb USING (scene_id) GROUP BY ALL)"""


def raster_of(spark, folder):
    return S.raster(V.cloud_l(spark, folder), "z", 32)


@query(f'WITH {RASTER} SELECT scene_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, {q6("mean")} AS mean, {q6("max")} AS max FROM ras')
def raster(spark, folder):
    return rounded(raster_of(spark, folder), "mean", "max")


@query(f'WITH {LBOX} SELECT scene_id, CAST(floor((y-ly)/greatest(hx-lx, hy-ly, 1e-6)*199) AS INTEGER) AS "row", CAST(floor((x-lx)/greatest(hx-lx, hy-ly, 1e-6)*199) AS INTEGER) AS col, {q6("avg(z)")} AS mean FROM cloud_l JOIN lb USING (scene_id) GROUP BY ALL')
def birds_eye(spark, folder):
    return rounded(S.bev(V.cloud_l(spark, folder), "z"), "mean")


SOBEL = RASTER + """, sob AS (SELECT a.scene_id, a."row", a.col, sqrt(pow(sum((b.col-a.col)*(2-abs(b."row"-a."row"))*b.mean),2) + pow(sum((b."row"-a."row")*(2-abs(b.col-a.col))*b.mean),2) + 1e-8) AS edge
  FROM ras a JOIN ras b ON a.scene_id = b.scene_id AND abs(a."row"-b."row") <= 1 AND abs(a.col-b.col) <= 1 GROUP BY ALL)"""


@query(f'WITH {SOBEL} SELECT scene_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, {q6("edge")} AS edge FROM sob')
def sobel_edges(spark, folder):
    return rounded(S.sobel(raster_of(spark, folder)), "edge")


@query(f"""WITH {RASTER}, f AS (SELECT *, CAST(mean > 0.13 AS INTEGER) AS flag FROM ras) SELECT a.scene_id, CAST(a."row" AS INTEGER) AS "row", CAST(a.col AS INTEGER) AS col, max(b.flag) AS flag FROM f a JOIN f b ON a.scene_id = b.scene_id AND abs(a."row"-b."row") <= 2 AND abs(a.col-b.col) <= 2 GROUP BY ALL""")
def edge_dilation(spark, folder):
    """Many cells' means are the limit itself; the margin keeps the noise of summation order from flagging them."""
    return S.dilate(raster_of(spark, folder).select("scene_id", "row", "col", (F.col("mean") > 0.13 + 1e-9).cast("int").alias("flag")), "flag")


@query(f"""WITH {RASTER}, g AS (SELECT *, coalesce((lead(mean) OVER c - lag(mean) OVER c) / 2, lead(mean) OVER c - mean, mean - lag(mean) OVER c, 0) AS sx, coalesce((lead(mean) OVER r - lag(mean) OVER r) / 2, lead(mean) OVER r - mean, mean - lag(mean) OVER r, 0) AS sy FROM ras
  WINDOW c AS (PARTITION BY scene_id, "row" ORDER BY col), r AS (PARTITION BY scene_id, col ORDER BY "row")) SELECT scene_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, {q6("-sx/sqrt(sx*sx+sy*sy+1)")} AS nx, {q6("-sy/sqrt(sx*sx+sy*sy+1)")} AS ny, {q6("1/sqrt(sx*sx+sy*sy+1)")} AS nz FROM g""")
def grid_normals(spark, folder):
    return rounded(S.grid_normals(raster_of(spark, folder).select("scene_id", "row", "col", "mean"), "mean", 1.0).drop("mean"), "nx", "ny", "nz")


@query(f'WITH {RASTER}, s AS (SELECT min(mean) AS lo, max(mean) AS hi FROM ras) SELECT scene_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, {q6("(mean - lo) / (hi - lo)")} AS mean FROM ras, s')
def normalized_grid(spark, folder):
    return rounded(P.unit_grid(raster_of(spark, folder).drop("max"), "mean"), "mean")


PLANE = V.CLOUD_L + """, pl0 AS (SELECT scene_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x,x) AS xx, covar_pop(y,y) AS yy, covar_pop(x,y) AS xy, covar_pop(x,z) AS xz, covar_pop(y,z) AS yz FROM cloud_l GROUP BY 1),
  pl AS (SELECT scene_id, (xz*yy-yz*xy)/(xx*yy-xy*xy) AS a, (yz*xx-xz*xy)/(xx*yy-xy*xy) AS b, mz - (xz*yy-yz*xy)/(xx*yy-xy*xy)*mx - (yz*xx-xz*xy)/(xx*yy-xy*xy)*my AS c FROM pl0)"""


@query(f"WITH {PLANE} SELECT scene_id, {q6('a')} AS a, {q6('b')} AS b, {q6('c')} AS c FROM pl")
def least_squares_planes(spark, folder):
    return rounded(S.fit_plane(V.cloud_l(spark, folder)), "a", "b", "c")


@query(f"WITH {PLANE} SELECT scene_id, point_id, {q6('(z - a*x - b*y - c) / sqrt(a*a + b*b + 1)')} AS plane_distance FROM cloud_l JOIN pl USING (scene_id) WHERE abs((z - a*x - b*y - c) / sqrt(a*a + b*b + 1)) <= 0.05")
def ground_points(spark, folder):
    return rounded(S.ground(V.cloud_l(spark, folder), 0.05).select("scene_id", "point_id", "plane_distance"), "plane_distance")


#: The planes through each drawn point and the two drawn after it, with the points within 15 cm.
RANSAC = V.CLOUD_L + f""", r AS (SELECT scene_id, x, y, z, row_number() OVER (PARTITION BY scene_id ORDER BY {_draw(42, 'scene_id', 'point_id')}, point_id) - 1 AS k FROM cloud_l QUALIFY k < 64),
  m AS (SELECT scene_id, count(*) AS m FROM r GROUP BY 1 HAVING count(*) >= 4),
  s AS (SELECT o.scene_id, o.k, o.x, o.y, o.z, p.x - o.x AS ux, p.y - o.y AS uy, p.z - o.z AS uz, q.x - o.x AS vx, q.y - o.y AS vy, q.z - o.z AS vz FROM r o JOIN m USING (scene_id) JOIN r p ON p.scene_id = o.scene_id AND p.k = (o.k + 1) % m JOIN r q ON q.scene_id = o.scene_id AND q.k = (o.k + 2) % m),
  c AS (SELECT *, uy*vz - uz*vy AS cx, uz*vx - ux*vz AS cy, ux*vy - uy*vx AS cz FROM s), l AS (SELECT *, sqrt(cx*cx + cy*cy + cz*cz) AS l, CASE WHEN cz < 0 THEN -1.0 ELSE 1.0 END AS sg FROM c),
  pl AS (SELECT scene_id, k, cx/l*sg AS nx, cy/l*sg AS ny, cz/l*sg AS nz, -(x*(cx/l*sg) + y*(cy/l*sg) + z*(cz/l*sg)) AS d FROM l WHERE l >= 1e-12 AND cz/l*sg >= 0.7),
  n AS (SELECT pl.scene_id, pl.k, nx, ny, nz, d, count(*) FILTER (abs(x*nx + y*ny + z*nz + d) <= 0.15) AS n, count(*) AS total FROM pl JOIN cloud_l USING (scene_id) GROUP BY ALL)"""


@query(f"WITH {RANSAC} SELECT scene_id, {q6('nx')} AS nx, {q6('ny')} AS ny, {q6('nz')} AS nz, {q6('d')} AS d, {q6('n / total')} AS retained FROM n WHERE n >= 4 QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, k) = 1")
def ransac_planes(spark, folder):
    return rounded(S.ransac_planes(V.cloud_l(spark, folder)), "nx", "ny", "nz", "d", "retained")


@query(f"""WITH {SMALL}, a AS (SELECT * FROM cloud_s WHERE point_id % 2 = 0), b AS (SELECT * FROM cloud_s WHERE point_id % 2 = 1), go AS (SELECT scene_id, avg(d) AS there FROM (SELECT a.scene_id, sqrt(min({D2})) AS d FROM a JOIN b USING (scene_id) GROUP BY a.scene_id, a.point_id) GROUP BY 1),
  bk AS (SELECT scene_id, avg(d) AS back FROM (SELECT b.scene_id, sqrt(min({D2})) AS d FROM a JOIN b USING (scene_id) GROUP BY b.scene_id, b.point_id) GROUP BY 1) SELECT scene_id, {q6("there")} AS there, {q6("back")} AS back, {q6("there + back")} AS chamfer FROM go JOIN bk USING (scene_id)""")
def chamfer_distance(spark, folder):
    cloud = small(spark, folder)
    return rounded(S.chamfer(cloud.where("point_id % 2 = 0"), cloud.where("point_id % 2 = 1")), "there", "back", "chamfer")


@query(f"WITH {KNN} SELECT scene_id, point_id, {q6('max(n_x - x)')} AS ex, {q6('max(n_y - y)')} AS ey, {q6('max(n_z - z)')} AS ez FROM knn WHERE rank <= 5 GROUP BY ALL")
def edge_features(spark, folder):
    return rounded(S.edge_features(small(spark, folder), 5), "ex", "ey", "ez")


@query(f"""WITH {SMALL}, {BOX}, g AS (SELECT *, greatest(1, CAST(round_even(cbrt(n / 8.0), 0) AS INTEGER)) AS g FROM cloud_s JOIN box USING (scene_id)), w AS (SELECT scene_id, point_id, ({_cell("x", 0)} * g + {_cell("y", 0)}) * g + {_cell("z", 0)} AS w FROM g)
  SELECT a.scene_id, a.point_id, count(*) AS partners FROM w a JOIN w b USING (scene_id, w) GROUP BY ALL""")
def window_pairs(spark, folder):
    return S.window_pairs(P.windows3d(small(spark, folder), 8)).groupBy("scene_id", "point_id").agg(F.count("*").alias("partners"))


SIDES = """sides AS (SELECT CASE l_returnflag WHEN 'A' THEN 'a' ELSE 'b' END AS side, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key, unnest([struct_pack(d := 'discount', v := l_discount), struct_pack(d := 'price', v := l_extendedprice), struct_pack(d := 'quantity', v := l_quantity), struct_pack(d := 'tax', v := l_tax)]) AS u FROM lineitem),
  long AS (SELECT side, key, u.d AS descriptor, u.v AS v FROM sides)"""


def line_key():
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def sides(spark, folder):
    """Descriptors of all points: side a has one return flag, side b the others."""
    line = V.table(spark, folder, "lineitem")
    kinds = F.array(*(F.struct(F.lit(n).alias("descriptor"), F.col(c).alias("v")) for n, c in (("discount", "l_discount"), ("price", "l_extendedprice"), ("quantity", "l_quantity"), ("tax", "l_tax"))))
    return line.select(F.when(F.col("l_returnflag") == "A", "a").otherwise("b").alias("side"), line_key().alias("key"), F.explode(kinds).alias("u")).select("side", "key", "u.*")


@query(f"WITH {SIDES} SELECT descriptor || '/' || side AS sample, count(*) AS n, {q6('avg(v)')} AS mean, {q6('stddev_pop(v)')} AS std, {q6('quantile_cont(v, 0.05)')} AS q05, {q6('quantile_cont(v, 0.5)')} AS q50, {q6('quantile_cont(v, 0.95)')} AS q95 FROM long GROUP BY 1")
def descriptor_summaries(spark, folder):
    rows = sides(spark, folder).withColumn("sample", F.concat_ws("/", "descriptor", "side"))
    return rounded(G.summary(rows, "sample", "v"), "mean", "std", "q05", "q50", "q95")


@query(f"""WITH {SIDES}, n AS (SELECT descriptor, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM long GROUP BY 1), c AS (SELECT descriptor, v, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM long GROUP BY ALL),
  r AS (SELECT descriptor, sum(a) OVER w / na - sum(b) OVER w / nb AS g, lead(v) OVER w - v AS dx FROM c JOIN n USING (descriptor) WINDOW w AS (PARTITION BY descriptor ORDER BY v)) SELECT descriptor, {q6("sum(abs(g) * dx)")} AS wasserstein, {q6("sqrt(2 * sum(g * g * dx))")} AS energy FROM r WHERE dx IS NOT NULL GROUP BY 1""")
def domain_distances(spark, folder):
    return rounded(G.distances(sides(spark, folder), "v"), "wasserstein", "energy")


def mmd_sql(name: str, columns: tuple[str, ...], n: int = 512) -> str:
    """CTEs that end in `name` with one row, mmd, of the lineitem columns; {name}_... are steps."""
    d2 = "+".join(f"(a.{c}-b.{c})*(a.{c}-b.{c})" for c in columns)
    scaled = ", ".join(f"({c} - avg({c}) OVER ()) / greatest(stddev_pop({c}) OVER (), 1e-8) AS {c}" for c in columns)
    k = "exp(-d2/(2*bw))"
    return f"""{name}_s AS (SELECT * FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'a' ELSE 'b' END AS side, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key, {", ".join(columns)} FROM lineitem)
      QUALIFY row_number() OVER (PARTITION BY side ORDER BY CAST('0x' || substr(md5('42|' || side || '|' || key), 1, 8) AS BIGINT), key) <= {n}),
    {name}_z AS (SELECT side, {scaled} FROM {name}_s), {name}_d AS (SELECT a.side AS s1, b.side AS s2, {d2} AS d2 FROM {name}_z a, {name}_z b), {name}_w AS (SELECT greatest(quantile_cont(d2, 0.5), 1e-8) AS bw FROM {name}_d WHERE d2 > 0),
    {name} AS (SELECT avg({k}) FILTER (s1='a' AND s2='a') + avg({k}) FILTER (s1='b' AND s2='b') - 2 * avg({k}) FILTER (s1='a' AND s2='b') AS mmd FROM {name}_d, {name}_w)"""


@query(f"WITH {mmd_sql('m', ('l_quantity', 'l_extendedprice'))} SELECT {q6('mmd')} AS mmd FROM m")
def kernel_discrepancy(spark, folder):
    line = V.table(spark, folder, "lineitem")
    rows = line.select(F.when(F.col("l_returnflag") == "A", "a").otherwise("b").alias("side"), line_key().alias("key"), F.col("l_quantity").alias("u"), F.col("l_extendedprice").alias("v"))
    return rounded(G.kernel_discrepancy(rows, ("u", "v"), "key"), "mmd")


FIGURES = ("n", "mean", "std", "q05", "q50", "q95")
KINDS = {"discount": "l_discount", "price": "l_extendedprice", "quantity": "l_quantity", "tax": "l_tax"}


@query(f"""WITH {SIDES}, {", ".join(mmd_sql(f"m_{d}", (c,)) for d, c in KINDS.items())}, {mmd_sql("m_joint", tuple(KINDS.values()))},
  mm AS ({" UNION ALL ".join(f"SELECT '{d}' AS descriptor, mmd FROM m_{d}" for d in (*KINDS, "joint"))}),
  n AS (SELECT descriptor, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM long GROUP BY 1), c AS (SELECT descriptor, v, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM long GROUP BY ALL),
  r AS (SELECT descriptor, sum(a) OVER w / na - sum(b) OVER w / nb AS g, lead(v) OVER w - v AS dx FROM c JOIN n USING (descriptor) WINDOW w AS (PARTITION BY descriptor ORDER BY v)), dist AS (SELECT descriptor, sum(abs(g) * dx) AS wasserstein, sqrt(2 * sum(g * g * dx)) AS energy FROM r WHERE dx IS NOT NULL GROUP BY 1),
  f AS (SELECT descriptor, side, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.05) AS q05, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.95) AS q95 FROM long GROUP BY ALL),
  names AS (SELECT unnest(['discount', 'gradient', 'price', 'quantity', 'tax', 'joint']) AS descriptor)
  SELECT descriptor, mmd IS NOT NULL AS available, {", ".join(f"CASE WHEN descriptor <> 'joint' THEN coalesce({s}.n, 0) END AS {s}_n, " + ", ".join(f"CASE WHEN descriptor <> 'joint' THEN {q6(f'coalesce({s}.{c}, 0)')} END AS {s}_{c}" for c in FIGURES[1:]) for s in "ab")},
  {q6("wasserstein")} AS wasserstein, {q6("energy")} AS energy, {q6("mmd")} AS mmd FROM names LEFT JOIN mm USING (descriptor) LEFT JOIN dist USING (descriptor) LEFT JOIN (SELECT * FROM f WHERE side = 'a') a USING (descriptor) LEFT JOIN (SELECT * FROM f WHERE side = 'b') b USING (descriptor)""")
def domain_report(spark, folder):
    """All descriptors of both sides; one that neither side has is listed without distances."""
    out = G.compare(sides(spark, folder), ("discount", "gradient", "price", "quantity", "tax"), "key")
    return rounded(out, *(f"{s}_{c}" for s in "ab" for c in FIGURES[1:]), "wasserstein", "energy", "mmd")


@query(f"""WITH {GEOMETRY_L}, kinds AS (SELECT scene_id, unnest([struct_pack(descriptor := 'density_per_m2', v := density), struct_pack(descriptor := 'normal_tilt_rad', v := acos(least(greatest(nz, -1), 1))), struct_pack(descriptor := 'pca_curvature', v := curvature),
  struct_pack(descriptor := 'height_residual_m', v := abs(residual)), struct_pack(descriptor := 'signed_height_residual_over_radius', v := least(greatest(residual / radius, -3), 3)), struct_pack(descriptor := 'intensity', v := least(greatest(intensity, 0), 1))]) AS k FROM geometry_l)
  SELECT scene_id, k.descriptor AS descriptor, count(*) AS n, {q6("avg(k.v)")} AS mean, {q6("min(k.v)")} AS low, {q6("max(k.v)")} AS high FROM kinds GROUP BY ALL""")
def scene_descriptors(spark, folder):
    """Descriptors of all points of the large cloud, summed up by scene."""
    cloud = V.cloud_l(spark, folder)
    found = G.descriptors(S.local_geometry(cloud, keep=("intensity",))).groupBy("scene_id", "descriptor").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
    return rounded(found, "mean", "low", "high")
