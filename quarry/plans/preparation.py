"""Queries that prepare, label, balance and sample points."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import labels as L
from ..functions.columns import r6
from ..operators import balance as B
from ..operators import prepare as P
from ..operators import sampling as S
from . import views as V
from .registry import query
from .registry import r6 as q6

DIM = L.sql_values()
SMALL = V.CLOUD_S


def small(spark, folder):
    return V.cloud_s(spark, folder)


def rounded(df, *names):
    return df.withColumns({n: r6(n) for n in names})


META = """meta AS (SELECT s_suppkey AS scene_id, CASE s_nationkey % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'cm' ELSE 'mm' END AS units,
  CASE s_nationkey % 4 WHEN 0 THEN 'normalized' WHEN 1 THEN 'uint8' WHEN 2 THEN 'uint16' ELSE 'range' END AS scale, CASE s_nationkey % 3 WHEN 0 THEN 'a.las' WHEN 1 THEN 'b.PCD' ELSE 'c.npy' END AS path FROM supplier)"""


def meta(spark, folder):
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("s_nationkey") % n + 1).cast("int"))
    return V.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("scene_id"), pick(3, "m", "cm", "mm").alias("units"), pick(4, "normalized", "uint8", "uint16", "range").alias("scale"), pick(3, "a.las", "b.PCD", "c.npy").alias("path"))


@query(f"""WITH {META}, {V.CLOUD_L} SELECT scene_id, point_id, {q6("x * CASE units WHEN 'm' THEN 1.0 WHEN 'cm' THEN 0.01 ELSE 0.001 END")} AS x,
  {q6("least(greatest(CASE scale WHEN 'normalized' THEN y WHEN 'uint8' THEN y / 255.0 WHEN 'uint16' THEN y / 65535.0 ELSE (y - 5) / 40.0 END, 0), 1)")} AS intensity FROM cloud_l JOIN meta USING (scene_id)""")
def scan_units(spark, folder):
    rows = V.cloud_l(spark, folder).join(meta(spark, folder), "scene_id")
    return rows.select("scene_id", "point_id", r6(P.to_metres(F.col("x"), F.col("units"))).alias("x"), r6(P.normalize_intensity(F.col("y"), F.col("scale"), F.lit(5.0), F.lit(45.0))).alias("intensity"))


@query(f"""WITH {META}, {V.CLOUD_L}, t AS (SELECT scene_id, max(y) AS top FROM cloud_l GROUP BY 1)
  SELECT scene_id, path, CASE WHEN regexp_matches(lower(path), '\\.la[sz]$') THEN 'uint16' WHEN regexp_matches(lower(path), '\\.pcd$') AND top > 1 THEN 'uint8' ELSE 'normalized' END AS scale FROM meta JOIN t USING (scene_id)""")
def inferred_metadata(spark, folder):
    top = V.cloud_l(spark, folder).groupBy("scene_id").agg(F.max("y").alias("top"))
    return meta(spark, folder).join(top, "scene_id").select("scene_id", "path", P.inferred_scale(F.col("path"), F.col("top")).alias("scale"))


DIRTY = SMALL + ", dirty AS (SELECT scene_id, point_id, CASE WHEN point_id % 7 = 0 THEN NULL WHEN point_id % 11 = 0 THEN 'nan'::DOUBLE ELSE intensity END AS intensity FROM cloud_s)"


@query(f"""WITH {DIRTY}, m AS (SELECT scene_id, quantile_cont(intensity, 0.5) FILTER (isfinite(intensity)) AS med FROM dirty GROUP BY 1)
  SELECT scene_id, point_id, {q6("least(greatest(CASE WHEN intensity IS NULL THEN 0 WHEN isfinite(intensity) THEN intensity ELSE coalesce(med, 0) END, 0), 1)")} AS intensity_n FROM dirty JOIN m USING (scene_id)""")
def intensity_guard(spark, folder):
    p = F.col("point_id")
    dirty = small(spark, folder).withColumn("intensity", F.when(p % 7 == 0, None).when(p % 11 == 0, float("nan")).otherwise(F.col("intensity")))
    return P.guard_intensity(dirty).select("scene_id", "point_id", r6("intensity_n").alias("intensity_n"))


BALL = SMALL + """, c AS (SELECT scene_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM cloud_s GROUP BY 1), m AS (SELECT *, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)) AS r FROM cloud_s JOIN c USING (scene_id)),
  ball AS (SELECT scene_id, point_id, (x-cx)/s AS x, (y-cy)/s AS y, (z-cz)/s AS z, cx, cy, cz, s AS scale FROM m JOIN (SELECT scene_id, CASE WHEN max(r) <= 1e-12 THEN 1 ELSE max(r) END AS s FROM m GROUP BY 1) USING (scene_id))"""


@query(f"WITH {BALL} SELECT scene_id, point_id, {q6('x')} AS x, {q6('y')} AS y, {q6('z')} AS z, {q6('scale')} AS scale FROM ball")
def unit_ball(spark, folder):
    return rounded(P.unit_ball(small(spark, folder)).select("scene_id", "point_id", "x", "y", "z", "scale"), "x", "y", "z", "scale")


@query(f"WITH {SMALL} SELECT scene_id, point_id, {q6('x')} AS x, {q6('y')} AS y, {q6('z')} AS z FROM cloud_s")
def inverse_unit_ball(spark, folder):
    return rounded(P.from_unit_ball(P.unit_ball(small(spark, folder))).select("scene_id", "point_id", "x", "y", "z"), "x", "y", "z")


@query(f"""WITH {SMALL}, n AS (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS s, CASE WHEN nz < 0 THEN -1 ELSE 1 END AS d FROM cloud_s)
  SELECT point_id, {q6("CASE WHEN s > 1e-12 THEN d * nx / s ELSE 0 END")} AS nx, {q6("CASE WHEN s > 1e-12 THEN d * ny / s ELSE 0 END")} AS ny, {q6("CASE WHEN s > 1e-12 THEN d * nz / s ELSE 0 END")} AS nz,
  {q6("acos(least(greatest(CASE WHEN s > 1e-12 THEN d * nz / s ELSE 0 END, -1), 1))")} AS tilt FROM n""")
def normals(spark, folder):
    out = P.upward(P.unit_normals(small(spark, folder)))
    return rounded(out.select("point_id", "nx", "ny", "nz", P.tilt("nz").alias("tilt")), "nx", "ny", "nz", "tilt")


@query(f"""WITH {SMALL}, n AS (SELECT *, sqrt(x*x + y*y + z*z) AS s FROM cloud_s)
  SELECT point_id, {q6("CASE WHEN point_id % 3 > 0 AND s > 1e-8 THEN x / s ELSE nx END")} AS nx, {q6("CASE WHEN point_id % 3 > 0 AND s > 1e-8 THEN y / s ELSE ny END")} AS ny, {q6("CASE WHEN point_id % 3 > 0 AND s > 1e-8 THEN z / s ELSE nz END")} AS nz FROM n""")
def supplied_normals(spark, folder):
    rows = small(spark, folder).withColumns({f"s{a}": F.when(F.col("point_id") % 3 > 0, F.col(a)) for a in "xyz"})
    return rounded(P.supplied_or(rows, ("sx", "sy", "sz"), ("nx", "ny", "nz")).select("point_id", "nx", "ny", "nz"), "nx", "ny", "nz")


@query(f"WITH {SMALL} SELECT point_id, x, y, z FROM (SELECT *, CASE WHEN point_id % 5 = 0 THEN 0 WHEN point_id % 9 = 0 THEN 'inf'::DOUBLE ELSE x END AS x2 FROM cloud_s) WHERE isfinite(x2) AND NOT (point_id % 5 = 0)")
def finite_points(spark, folder):
    p = F.col("point_id")
    bad = small(spark, folder).select("point_id", *(F.when(p % 5 == 0, 0.0).when(p % 9 == 0, float("inf") if a == "x" else F.col(a)).otherwise(F.col(a)).alias(a) for a in "xyz"))
    return P.real_points(bad)


@query(f"""WITH {SMALL}, s AS (SELECT *, sqrt(x*x + y*y + z*z) + 1e-12 AS r FROM cloud_s) SELECT point_id, {q6('r')} AS r, {q6('atan2(y, x)')} AS azimuth, {q6('asin(least(greatest(z / r, -1), 1))')} AS elevation, {q6('x')} AS x, {q6('y')} AS y, {q6('z')} AS z FROM s""")
def spherical(spark, folder):
    r, a, e = P.spherical(F.col("x"), F.col("y"), F.col("z"))
    out = small(spark, folder).select("point_id", r.alias("r"), a.alias("azimuth"), e.alias("elevation"))
    x, y, z = P.cartesian(F.col("r"), F.col("azimuth"), F.col("elevation"))
    return rounded(out.withColumns({"x": x, "y": y, "z": z}), "r", "azimuth", "elevation", "x", "y", "z")


BOX = "box AS (SELECT scene_id, count(*) AS n, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM cloud_s GROUP BY 1)"


def _unit(a):
    return f"(({a} - l{a}) / CASE WHEN h{a} - l{a} < 1e-6 THEN 1 ELSE h{a} - l{a} END)"


@query(f"""WITH {SMALL}, {BOX}, q AS (SELECT scene_id, point_id, {", ".join(f"CAST(floor({_unit(a)} * 1023) AS BIGINT) AS q{a}" for a in "xyz")} FROM cloud_s JOIN box USING (scene_id))
  SELECT scene_id, point_id, CAST(list_sum(list_transform(range(10), lambda b: (((qx >> b) & 1) << (3 * b)) + (((qy >> b) & 1) << (3 * b + 1)) + (((qz >> b) & 1) << (3 * b + 2)))) AS BIGINT) AS morton FROM q""")
def morton_codes(spark, folder):
    return P.morton(small(spark, folder)).select("scene_id", "point_id", "morton")


def _cell(a, shift):
    v = f"fmod({_unit(a)} + 0.5 / g, 1.0)" if shift else _unit(a)
    return f"least(CAST(floor({v} * g) AS INTEGER), g - 1)"


@query(f"""WITH {SMALL}, {BOX}, g AS (SELECT *, greatest(1, CAST(round_even(cbrt(n / 8.0), 0) AS INTEGER)) AS g FROM cloud_s JOIN box USING (scene_id))
  SELECT scene_id, point_id, CAST(({_cell("x", 0)} * g + {_cell("y", 0)}) * g + {_cell("z", 0)} AS INTEGER) AS window_id, CAST(({_cell("x", 1)} * g + {_cell("y", 1)}) * g + {_cell("z", 1)} AS INTEGER) AS shifted_id FROM g""")
def window_ids(spark, folder):
    out = P.windows3d(small(spark, folder), 8)
    return P.windows3d(out.withColumnRenamed("window_id", "w"), 8, shifted=True).select("scene_id", "point_id", F.col("w").alias("window_id"), F.col("window_id").alias("shifted_id"))


@query(f"WITH {V.LABELLED} SELECT scene_id, order_id, line_no, labelled.label, b2, c4, c8, c38 FROM labelled JOIN {DIM} ON labelled.label = label_dim.label")
def stage_labels(spark, folder):
    names = {"b2": "binary", "c4": "four", "c8": "eight", "c38": "full38"}
    return V.labelled(spark, folder).withColumns({c: L.lut_column(F.col("label"), s) for c, s in names.items()})


@query(f"WITH {V.LABELLED} SELECT scene_id, order_id, line_no, CAST(coalesce(CASE label WHEN 1 THEN 9 WHEN 2 THEN 20 WHEN 5 THEN 37 END, 0) AS INTEGER) AS mapped FROM labelled")
def mapped_labels(spark, folder):
    rows = V.labelled(spark, folder)
    mapping = spark.createDataFrame([(1, 9), (2, 20), (5, 37)], "label int, mapped int")
    return rows.join(F.broadcast(mapping), "label", "left").select("scene_id", "order_id", "line_no", F.coalesce("mapped", F.lit(0)).alias("mapped"))


@query(f"""WITH r AS (SELECT p_partkey, CAST(1 + p_partkey % 37 AS INTEGER) AS wanted FROM part), q AS (SELECT p_partkey, pavement, coalesce(variant, disease) AS damage, severity FROM r JOIN {DIM} ON label = wanted)
  SELECT p_partkey, q.pavement, damage, q.severity, label FROM q LEFT JOIN {DIM} ON label > 0 AND q.pavement = label_dim.pavement AND damage = coalesce(variant, disease) AND (q.severity = label_dim.severity OR label_dim.severity = '-' OR disease = 'bleeding')""")
def severity_labels(spark, folder):
    dim = L.label_dim(spark)
    recipe = dim.select("label", "pavement", F.coalesce("variant", "disease").alias("damage"), "severity")
    rows = V.table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % 37 + 1).cast("int").alias("label")).join(F.broadcast(recipe), "label").drop("label")
    return L.label_for("pavement", "damage", "severity", dim, rows).select("p_partkey", "pavement", "damage", "severity", "label")


@query(f"WITH {V.LABELLED}, {V.SCENE_LOG} SELECT l.order_id, l.line_no, l.label AS old_label, target_label AS new_label, CASE WHEN a.priority > b.priority THEN l.label ELSE target_label END AS merged FROM labelled l JOIN scene_log ON scene_log.scene_id = l.order_id JOIN (SELECT label AS k, priority FROM {DIM}) a ON a.k = l.label JOIN (SELECT label AS k, priority FROM {DIM}) b ON b.k = target_label")
def priority_merge(spark, folder):
    """Where two labels meet, the one of higher priority stays; at a tie the new one."""
    rank = lambda c: F.get(F.array(*map(F.lit, L.PRIORITY)), F.col(c))
    log = V.scene_log(spark, folder).select(F.col("scene_id").alias("order_id"), F.col("target_label").alias("new_label"))
    rows = V.labelled(spark, folder).join(log, "order_id").select("order_id", "line_no", F.col("label").alias("old_label"), "new_label")
    return rows.withColumn("merged", F.when(rank("old_label") > rank("new_label"), F.col("old_label")).otherwise(F.col("new_label")))


@query(f"WITH {V.LABELLED}, c AS (SELECT c8, count(*) AS n FROM labelled JOIN {DIM} ON labelled.label = label_dim.label GROUP BY 1) SELECT CAST(k AS INTEGER) AS class, coalesce(n, 0) AS n FROM range(8) t(k) LEFT JOIN c ON c8 = k")
def class_point_counts(spark, folder):
    return B.class_counts(V.labelled(spark, folder), "eight")


WEIGHTS = f"""{V.LABELLED}, c AS (SELECT CAST(k AS INTEGER) AS class, CAST(count(label_dim.label) AS BIGINT) AS n FROM range(8) t(k) LEFT JOIN (SELECT label_dim.label, c8 FROM labelled JOIN {DIM} ON labelled.label = label_dim.label WHERE labelled.label < 21) label_dim ON c8 = k GROUP BY 1),
  w AS (SELECT *, CASE WHEN n > 0 THEN (1 - 0.999) / (1 - pow(0.999, n)) END AS raw FROM c), x AS (SELECT *, CASE WHEN raw IS NOT NULL THEN least(raw / (SELECT avg(raw) FROM w), 3.0) END AS capped FROM w), weighted AS (SELECT class, n, coalesce(capped / (SELECT avg(capped) FROM x), 0) AS weight FROM x)"""


def weighted(spark, folder):
    return B.effective_weights(B.class_counts(V.labelled(spark, folder).where("label < 21"), "eight"), beta=0.999, cap=3.0)


@query(f"WITH {WEIGHTS} SELECT class, n, {q6('weight')} AS weight FROM weighted")
def class_weights(spark, folder):
    return rounded(weighted(spark, folder), "weight")


@query(f"WITH {WEIGHTS} SELECT list(n ORDER BY class) AS counts, list({q6('weight')} ORDER BY class) AS weights, list(class ORDER BY class) FILTER (n > 0) AS supported_classes, CAST(sum(n) AS BIGINT) AS total_points FROM weighted")
def balance_summary(spark, folder):
    return B.summary(rounded(weighted(spark, folder), "weight"))


@query(f"WITH {V.LABELLED}, n AS (SELECT label, count(*) AS n FROM labelled GROUP BY 1) SELECT c4 AS class, {q6('avg(1.0 / greatest(coalesce(n, 0), 1))')} AS weight FROM {DIM} LEFT JOIN n USING (label) GROUP BY 1")
def stage_weights(spark, folder):
    """Weights of the labels (one over the points of each) averaged over the classes of a stage."""
    n = V.labelled(spark, folder).groupBy("label").agg(F.count("*").alias("n"))  # a row a label
    weight = 1.0 / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    return rounded(L.label_dim(spark).join(F.broadcast(n), "label", "left").groupBy(F.col("four").alias("class")).agg(F.avg(weight).alias("weight")), "weight")


@query(f"WITH {V.LABELLED}, p AS (SELECT DISTINCT scene_id, label FROM labelled) SELECT label, count(*) AS scenes, {q6('100.0 * count(*) / (SELECT count(DISTINCT scene_id) FROM p)')} AS percent FROM p GROUP BY label")
def scene_class_distribution(spark, folder):
    return rounded(B.scene_distribution(V.labelled(spark, folder)), "percent")


@query(f"WITH {V.SCENE_LOG} SELECT split, CAST(sum(n_points) AS BIGINT) AS total, {q6('avg(n_points)')} AS mean, min(n_points) AS least, max(n_points) AS most FROM scene_log GROUP BY split")
def point_count_stats(spark, folder):
    n = "n_points"
    return rounded(V.scene_log(spark, folder).groupBy("split").agg(F.sum(n).alias("total"), F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most")), "mean")


COVER = f"""{V.LABELLED}, {V.SCENE_LOG}, per AS (SELECT order_id AS scene_id, label, count(*) AS n FROM labelled GROUP BY ALL),
  coverage AS (SELECT label, count(*) AS scene_count, count(*) AS instance_count, CAST(sum(n) AS BIGINT) AS point_count FROM per JOIN scene_log USING (scene_id) WHERE label = target_label GROUP BY label)"""


def covered(spark, folder):
    points = V.labelled(spark, folder).select(F.col("order_id").alias("scene_id"), "label")
    return B.coverage(points, V.scene_log(spark, folder))


@query(f"WITH {COVER} SELECT * FROM coverage")
def budget_coverage(spark, folder):
    return covered(spark, folder)


@query(f"WITH {COVER} SELECT CAST(k AS INTEGER) AS label, coalesce(scene_count, 0) AS scene_count, coalesce(point_count, 0) AS point_count FROM range(1, 38) t(k) LEFT JOIN coverage ON label = k WHERE coalesce(scene_count, 0) < 40 OR coalesce(point_count, 0) < 45")
def unmet_labels(spark, folder):
    return B.unmet(covered(spark, folder), list(range(1, 38)), 40, 45)


@query(f"WITH {V.SCENE_LOG} SELECT split, scene_id, target_label FROM scene_log WHERE scene_id % 3 <> 0")
def missing_scenes(spark, folder):
    log = V.scene_log(spark, folder)
    return B.new_scenes(log, log.where("scene_id % 3 = 0")).select("split", "scene_id", "target_label")


@query(f"WITH {V.SCENE_LOG} SELECT split, max(scene_id) + 1 AS next_id FROM scene_log GROUP BY split")
def next_scene_ids(spark, folder):
    return B.next_id(V.scene_log(spark, folder))


def _draw(seed, *parts):
    return "CAST('0x' || substr(md5('" + str(seed) + "|' || " + " || '|' || ".join(parts) + "), 1, 8) AS BIGINT)"


LPOINTS = V.CLOUD_L + ", pts AS (SELECT *, CAST(CASE WHEN y > 40 THEN 1 ELSE 0 END AS INTEGER) AS label FROM cloud_l)"


def lpoints(spark, folder):
    return V.cloud_l(spark, folder).withColumn("label", (F.col("y") > 40).cast("int"))


@query(f"WITH {LPOINTS} SELECT scene_id, point_id FROM pts QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY {_draw(42, 'scene_id', 'point_id')}, point_id) <= 64")
def uniform_sample(spark, folder):
    return S.uniform(lpoints(spark, folder), 64).select("scene_id", "point_id")


@query(f"WITH {LPOINTS} SELECT scene_id, point_id, label FROM pts QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY CAST(label = 0 AS INTEGER), {_draw(42, 'scene_id', 'point_id')}, point_id) <= 128")
def damage_first_sample(spark, folder):
    return S.damage_first(lpoints(spark, folder), 128).select("scene_id", "point_id", "label")


@query(f"""WITH {LPOINTS}, r AS (SELECT *, {_draw(42, 'scene_id', 'point_id')} AS d FROM pts), k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, label = 1 ORDER BY d, point_id) AS k, count(*) FILTER (label = 1) OVER s AS mine, count(*) FILTER (label <> 1) OVER s AS others FROM r WINDOW s AS (PARTITION BY scene_id)),
  o AS (SELECT *, CASE WHEN label <> 1 THEN 1 WHEN k <= 10 THEN 0 WHEN others >= 100 - least(mine, 10) THEN 2 ELSE 1 END AS late FROM k)
  SELECT scene_id, point_id, label FROM o QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY late, d, point_id) <= 100""")
def protected_sample(spark, folder):
    return S.protected(lpoints(spark, folder), 100, F.lit(1)).select("scene_id", "point_id", "label")


@query(f"""WITH {SMALL}, k AS (SELECT scene_id, point_id, row_number() OVER (PARTITION BY scene_id ORDER BY point_id) - 1 AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM cloud_s),
  a AS (SELECT DISTINCT scene_id, n FROM k WHERE n < 60), g AS (SELECT scene_id, c AS copy, {_draw(42, 'scene_id', 'c')} % n AS k FROM a, range(1, 61) t(c) WHERE c <= 60 - n)
  SELECT scene_id, point_id, 0 AS copy FROM k UNION ALL SELECT scene_id, point_id, CAST(copy AS INTEGER) FROM g JOIN k USING (scene_id, k)""")
def filled_sample(spark, folder):
    return S.fill_up(small(spark, folder).select("scene_id", "point_id"), 60).select("scene_id", "point_id", "copy")


@query(f"WITH s AS (SELECT s_nationkey, s_suppkey, s_acctbal + 1000.5 AS w FROM supplier) SELECT s_nationkey, s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY -ln(({_draw(7, 's_nationkey', 's_suppkey')} + 0.5) / 4294967296.0) / w, s_suppkey) AS INTEGER) AS place FROM s")
def weighted_choice(spark, folder):
    rows = V.table(spark, folder, "supplier").withColumn("w", F.col("s_acctbal") + 1000.5)
    return S.weighted_order(rows, "w", 7, "s_nationkey", "s_suppkey").select("s_nationkey", "s_suppkey", "place")


@query(f"WITH {SMALL} SELECT scene_id, point_id, {q6('coalesce(lag(z) OVER w, 0) * 0.25 + z * 0.5 + coalesce(lead(z) OVER w, 0) * 0.25')} AS conv FROM cloud_s WINDOW w AS (PARTITION BY scene_id ORDER BY point_id)")
def convolution(spark, folder):
    return rounded(P.conv3(small(spark, folder), "z", (0.25, 0.5, 0.25), "point_id").select("scene_id", "point_id", "conv"), "conv")


@query(f"""WITH {SMALL}, k AS (SELECT scene_id, point_id, z, row_number() OVER (PARTITION BY scene_id ORDER BY point_id) AS k FROM cloud_s)
  SELECT a.scene_id, a.point_id, {q6('sum(b.z * pow(0.5, a.k - b.k))')} AS state FROM k a JOIN k b ON a.scene_id = b.scene_id AND b.k <= a.k GROUP BY ALL""")
def decay_scan(spark, folder):
    return rounded(P.decay_scan(small(spark, folder), "z", "point_id", 0.5), "state")


BEZIER = {a: " + ".join(f"{c} * pow(1 - t, {3 - n}) * pow(t, {n}) * CAST(embedding[{first + n}] AS DOUBLE)" for n, c in enumerate((1, 3, 3, 1))) for a, first in (("x", 1), ("y", 5))}


@query(f"WITH c AS (SELECT vec_id, embedding, k / 16.0::DOUBLE AS t FROM embeddings, range(17) r(k)) SELECT vec_id, {q6('t')} AS t, {q6(BEZIER['x'])} AS x, {q6(BEZIER['y'])} AS y FROM c")
def bezier_curve(spark, folder):
    """A cubic curve for each embedding, whose first eight components are its control points, at 17 places."""
    rows = V.table(spark, folder, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("k")).withColumn("t", F.col("k") / 16.0)
    at = lambda first: P.bezier(*(F.get("embedding", F.lit(first + n)).cast("double") for n in range(4)), F.col("t"))
    return rounded(rows.select("vec_id", "t", at(0).alias("x"), at(4).alias("y")), "t", "x", "y")


@query("WITH s AS (SELECT o_custkey % 40 AS a, o_orderkey AS k FROM orders), l AS (SELECT k, unnest(range(a, a + 3)) AS label FROM s UNION ALL SELECT k, 20 FROM s) SELECT CAST(label AS INTEGER) AS label, count(DISTINCT k) AS scenes FROM l WHERE label BETWEEN 1 AND 37 GROUP BY 1")
def parsed_labels(spark, folder):
    """Label lists such as `1-3,20` of scenes, taken apart; how many scenes ask for each label."""
    first = F.col("o_custkey") % 40
    said = V.table(spark, folder, "orders").select("o_orderkey", F.concat(first, F.lit("-"), first + 2, F.lit(",20")).alias("said"))
    ends = F.split(F.trim("p"), "-")
    listed = said.select("o_orderkey", F.explode(F.split("said", ",")).alias("p")).select("o_orderkey", F.explode(F.sequence(ends[0].cast("int"), F.element_at(ends, -1).cast("int"))).alias("label"))
    return listed.where("label between 1 and 37").distinct().groupBy("label").agg(F.count("*").alias("scenes"))


@query("SELECT page_id, CASE WHEN regexp_full_match(name, 'scene_([0-9]+)\\.npz') THEN CAST(regexp_extract(name, 'scene_([0-9]+)\\.npz', 1) AS BIGINT) END AS scene_id FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'scene_' || lpad(CAST(page_id AS VARCHAR), 6, '0') || '.npz' ELSE url END AS name FROM pages)")
def scene_ids_of_files(spark, folder):
    name = F.when(F.col("page_id") % 3 == 0, F.format_string("scene_%06d.npz", "page_id")).otherwise(F.col("url"))
    return V.table(spark, folder, "pages").select("page_id", F.nullif(F.regexp_extract(name, r"^scene_(\d+)\.npz$", 1), F.lit("")).cast("long").alias("scene_id"))


STAGES = {"binary": "b2", "four": "c4", "eight": "c8", "full38": "c38"}


@query(f"WITH {V.LABELLED}, n AS (SELECT label, count(*) AS n FROM labelled GROUP BY 1) " + " UNION ALL ".join(f"SELECT '{s}' AS s, {c} AS class, count(*) AS labels, CAST(coalesce(sum(n), 0) AS BIGINT) AS points FROM {DIM} LEFT JOIN n USING (label) GROUP BY {c}" for s, c in STAGES.items()))
def label_stages(spark, folder):
    """The labels and points of each class of every stage: a stage's classes cover each label once."""
    n = V.labelled(spark, folder).groupBy("label").agg(F.count("*").alias("n"))  # a row a label
    kinds = L.label_dim(spark).select("label", F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.col(s).alias("class")) for s in L.STAGE_SIZE))).alias("x")).select("label", "x.*")
    return kinds.join(F.broadcast(n), "label", "left").groupBy("s", "class").agg(F.count("*").alias("labels"), F.coalesce(F.sum("n"), F.lit(0)).alias("points"))
