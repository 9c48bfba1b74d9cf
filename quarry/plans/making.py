"""Queries over shapes of damage, validation, logs, matrices and sets."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import labels as L
from ..functions.columns import r6
from ..operators import matrices as X
from ..operators import scenes as Z
from ..operators import shapes as H
from ..operators import validate as C
from . import views as V
from .preparation import DIM, SMALL, _draw, rounded, small
from .registry import query
from .registry import r6 as q6


def grid(spark, folder):
    """The orders as points of a survey on a tilted plane: places 4 cm apart by customer and price."""
    x, y = (F.col("o_custkey") % 60) * 0.04, (F.floor("o_totalprice") % 60) * 0.04
    return V.table(spark, folder, "orders").select(F.col("o_orderkey").alias("point_id"), x.alias("x"), y.alias("y"), (x * 0.2 - y * 0.1).alias("z"))


GRID = "grid AS (SELECT point_id, x, y, x * 0.2::DOUBLE - y * 0.1::DOUBLE AS z FROM (SELECT o_orderkey AS point_id, (o_custkey % 60) * 0.04::DOUBLE AS x, (CAST(floor(o_totalprice) AS BIGINT) % 60) * 0.04::DOUBLE AS y FROM orders))"
R = "sqrt((x-1.2)*(x-1.2)+(y-1.1)*(y-1.1))"


def shaped(spark, folder, shape):
    height, label = shape
    return grid(spark, folder).select("point_id", r6(height).alias("dz"), label.alias("labelled"))


def _sql(height, label):
    return f"WITH {GRID} SELECT point_id, {q6(height)} AS dz, {label} AS labelled FROM grid"


@query(_sql(f"CASE WHEN {R}/0.515 <= 1 THEN -0.05 * sqrt(greatest(1 - pow({R}/0.515, 2), 0)) ELSE 0 END", f"{R}/0.515 <= 1"))
def shape_pothole(spark, folder):
    return shaped(spark, folder, H.pothole("x", "y", 1.2, 1.1, 0.515, 0.05))


@query(_sql(f"-0.03 * exp(-{R}*{R} / (2 * pow(0.9 / 3, 2)))", f"0.03 * exp(-{R}*{R} / (2 * pow(0.9 / 3, 2))) > 0.01 * 0.03"))
def shape_depression(spark, folder):
    return shaped(spark, folder, H.depression("x", "y", 1.2, 1.1, 0.9, 0.03))


RUT = "0.02 * (exp(-pow(x - (1.2 - 0.85 / 2), 2) / (2 * pow(0.6 / 3, 2))) + exp(-pow(x - (1.2 + 0.85 / 2), 2) / (2 * pow(0.6 / 3, 2)))) * (1 + 0.2 * sin(2 * pi() * y / (0.5 * 2.4)))"


@query(_sql(f"-({RUT})", f"abs({RUT}) > 0.05 * 0.02"))
def shape_rutting(spark, folder):
    return shaped(spark, folder, H.rutting("x", "y", 1.2, 0.85, 0.6, 0.02, 2.4))


WAVE = "0.02 * cos(2 * pi() * (x * cos(0.3) + y * sin(0.3)) / 0.45)"


@query(_sql(WAVE, f"abs({WAVE}) > 0.1 * 0.02"))
def shape_corrugation(spark, folder):
    return shaped(spark, folder, H.corrugation("x", "y", 0.45, 0.02, 0.3))


SC = "abs(-(x - 1.2) * sin(0.7) + (y - 1.1) * cos(0.7))"


@query(_sql(f"-0.015 * exp(-{SC} / (2 * 0.0083))", f"{SC} <= 2 * 0.0083"))
def shape_slab_crack(spark, folder):
    return shaped(spark, folder, H.slab_crack("x", "y", 1.2, 1.1, 0.7, 0.015, 0.0083))


@query(_sql("CASE WHEN abs(x - 1.19) <= 5 * 0.0213 THEN sign(x - 1.19) * 0.02 / 2 ELSE 0 END", "abs(x - 1.19) <= 5 * 0.0213"))
def shape_faulting(spark, folder):
    return shaped(spark, folder, H.faulting("x", 1.19, 0.02, 0.0213))


@query(_sql(f"CASE WHEN {R}/0.433 <= 1 THEN -0.05 * sqrt(greatest(1 - ({R}/0.433)*({R}/0.433), 0)) ELSE 0 END", f"{R}/0.433 <= 1"))
def shape_pitting(spark, folder):
    return shaped(spark, folder, H.pitting("x", "y", 1.2, 1.1, 0.433, 0.05))


BLOW = f"0.06 * pow(cos(pi() * least({R}/0.8, 1.5) / 2), 2)"


@query(_sql(BLOW, f"{BLOW} > 0.1 * 0.06"))
def shape_blow_up(spark, folder):
    return shaped(spark, folder, H.blow_up("x", "y", 1.2, 1.1, 0.8, 0.06))


CB = "((abs(x - 0.0) + abs(y - 0.0) - 0.613) / sqrt(2))"


@query(_sql(f"CASE WHEN {CB} <= 0 THEN -0.5 * 0.03 ELSE 0 END - 0.03 * exp(-abs({CB}) / (2 * 0.0083))", f"{CB} <= 0 OR abs({CB}) <= 2 * 0.0083"))
def shape_corner_break(spark, folder):
    return shaped(spark, folder, H.corner_break("x", "y", 0.0, 0.0, 0.613, 0.03, 0.0083))


@query(_sql("0.0", "x BETWEEN 0.61 AND 1.33"))
def shape_bleeding(spark, folder):
    return shaped(spark, folder, H.bleeding("x", 0.61, 1.33))


JD = "least(abs(x - floor(x / 0.77 + 0.5) * 0.77), abs(y - floor(y / 0.91 + 0.5) * 0.91))"


@query(_sql(f"CASE WHEN {JD} <= 0.043 THEN -0.01 * exp(-pow({JD} / (0.5 * 0.043), 2)) ELSE 0 END", f"{JD} <= 0.043"))
def shape_joint_damage(spark, folder):
    return shaped(spark, folder, H.joint_damage(H.joint_distance("x", "y", 0.77, 0.91), 0.01, 0.043))


@query(_sql("0.0", f"{JD} <= 8 * 0.0083"))
def shape_pumping(spark, folder):
    return shaped(spark, folder, H.pumping(H.joint_distance("x", "y", 0.77, 0.91), 0.0083))


@query(f"WITH {GRID} SELECT point_id, CAST(floor(x / 0.77) AS BIGINT) AS slab_x, CAST(floor(y / 0.91) AS BIGINT) AS slab_y, {q6(JD)} AS joint_distance FROM grid")
def slab_places(spark, folder):
    a, b = H.slab_index("x", "y", 0.77, 0.91)
    return grid(spark, folder).select("point_id", a.alias("slab_x"), b.alias("slab_y"), r6(H.joint_distance("x", "y", 0.77, 0.91)).alias("joint_distance"))


U, W = "((x-1.2)*cos(0.4)+(y-1.1)*sin(0.4))", "(-(x-1.2)*sin(0.4)+(y-1.1)*cos(0.4))"
QX, QY = f"(abs({U}) - 0.5 + 0.1)", f"(abs({W}) - 0.6 + 0.1)"
SD = f"(sqrt(pow(greatest({QX}, 0), 2) + pow(greatest({QY}, 0), 2)) + least(greatest({QX}, {QY}), 0) - 0.1)"
TT = f"least(greatest(-{SD} / 0.11, 0), 1)"


@query(_sql(f"{TT}*{TT}*(3-2*{TT}) * (0.2*x - 0.1*y + 0.01 - z)", f"{SD} <= 0"))
def shape_patch(spark, folder):
    """A repair patch: the rounded rectangle blends into the surface's plane, raised by a centimetre."""
    return shaped(spark, folder, H.patch("x", "y", "z", 1.2, 1.1, 0.5, 0.6, 0.1, 0.4, (0.2, -0.1, 0.0), 0.01, 0.11))


@query(f"WITH {GRID} SELECT point_id, {R} <= 0.515 AS disc, {R} BETWEEN 0.8 * 0.515 AND 1.2 * 0.515 AS ring, x BETWEEN 0.31 AND 1.51 AND y BETWEEN 0.31 AND 0.91 AS box FROM grid")
def region_masks(spark, folder):
    r = F.sqrt((F.col("x") - 1.2) * (F.col("x") - 1.2) + (F.col("y") - 1.1) * (F.col("y") - 1.1))
    return grid(spark, folder).select("point_id", (r <= 0.515).alias("disc"), r.between(0.8 * 0.515, 1.2 * 0.515).alias("ring"), (F.col("x").between(0.31, 1.51) & F.col("y").between(0.31, 0.91)).alias("box"))


RS = "(sqrt(x*x+y*y+z*z) / (SELECT max(sqrt(x*x+y*y+z*z)) FROM grid))"


@query(f"WITH {GRID} SELECT point_id, {q6(f'least(0.03 + 0.97 * {RS} * 0.2, 0.99)')} AS lost, {q6(f'exp(-0.5 * pow(abs(y - floor(y / 0.1 + 0.5) * 0.1) / (0.8 * 0.1), 2)) * (1 - 0.3 * {RS})')} AS seen FROM grid")
def scanner_probabilities(spark, folder):
    """Chance of a lost return, and of being seen by one of the scan lines 10 cm apart."""
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    far = grid(spark, folder).agg(F.max(size).alias("far"))
    rows = grid(spark, folder).crossJoin(F.broadcast(far)).withColumn("share", size / F.col("far")).withColumn("line", F.abs(F.col("y") - F.floor(F.col("y") / 0.1 + 0.5) * 0.1))
    return rows.select("point_id", r6(H.dropout("share")).alias("lost"), r6(H.scan_line_keep("y", "line", 0.1, "share")).alias("seen"))


SHIFT = "CASE WHEN label = 19 THEN 0.2 WHEN label IN (11, 12) THEN -0.1 WHEN label = 36 THEN -0.08 WHEN label IN (20, 37) THEN 0.15 WHEN label = 29 THEN 0.12 WHEN label = 34 THEN -0.05 WHEN label BETWEEN 1 AND 8 THEN -0.05 WHEN label IN (9, 10) THEN -0.08 ELSE 0 END"


@query(f"WITH {V.LABELLED}, r AS (SELECT label, least(greatest((line_no % 8) * 0.04::DOUBLE + ({SHIFT}), 0), 1) AS v FROM labelled) SELECT label, count(*) AS points, {q6('avg(v)')} AS reflectance FROM r GROUP BY label")
def reflectance_model(spark, folder):
    """Mean reflectance of the points of each label, by a base that changes from point to point."""
    rows = V.labelled(spark, folder).withColumn("v", H.reflectance((F.col("line_no") % 8) * 0.04, "label"))
    return rounded(rows.groupBy("label").agg(F.count("*").alias("points"), F.avg("v").alias("reflectance")), "reflectance")


PARTS = "lineitem JOIN part ON l_partkey = p_partkey"


def register(spark, folder):
    """A register of scenes and their points, with some faults."""
    line, part = V.table(spark, folder, "lineitem"), V.table(spark, folder, "part")
    s = F.col("l_suppkey")
    points = line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        s.alias("scene_id"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.when(F.col("l_linenumber") == 7, F.when(s % 11 == 0, float("nan")).otherwise(F.col("l_tax"))).otherwise(F.col("l_tax")).alias("z"),
        (F.col("p_size") % F.when(s % 13 == 0, 45).otherwise(38)).alias("label"), (F.col("l_quantity") / F.when(s % 5 == 0, 40.0).otherwise(50.0)).alias("intensity_n"), F.col("l_discount").alias("curvature"), (F.col("l_tax") * 10).alias("residual"),
        F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.when(s % 17 == 0, 0.9).otherwise(1.0).alias("nz"),
    )
    k = F.col("s_suppkey")
    scenes = V.table(spark, folder, "supplier").select(k.alias("scene_id"), F.when(k % 7 != 0, C.FEATURE_SCHEMA).alias("feature_schema"), F.when(k % 19 == 0, 40).otherwise((k % 38).cast("int")).alias("target_label"))
    return points, scenes


VALID = f"""pts AS (SELECT l_suppkey AS scene_id, CASE WHEN l_linenumber = 7 AND l_suppkey % 11 = 0 THEN 'nan'::DOUBLE ELSE l_tax END AS z, p_size % CASE WHEN l_suppkey % 13 = 0 THEN 45 ELSE 38 END AS label, l_quantity / CASE WHEN l_suppkey % 5 = 0 THEN 40.0 ELSE 50.0 END AS i FROM {PARTS}),
  agg AS (SELECT scene_id, bool_or(isnan(z)) AS e1, bool_or(label > 37) AS e2, bool_or(i > 1 + 1e-6) AS e3, list(DISTINCT label) AS labels FROM pts GROUP BY 1),
  v AS (SELECT s_suppkey AS scene_id, CASE WHEN s_suppkey % 19 = 0 THEN 40 ELSE s_suppkey % 38 END AS t, a.* EXCLUDE (scene_id) FROM supplier LEFT JOIN agg a ON a.scene_id = s_suppkey),
  validated AS (SELECT scene_id, list_filter([CASE WHEN scene_id % 7 = 0 THEN 'feature schema missing or different' END, CASE WHEN e3 THEN 'intensity_n out of range' END, CASE WHEN e2 THEN 'label out of range' END, CASE WHEN e1 IS NULL THEN 'no points' END, CASE WHEN e1 THEN 'points not finite' END,
  CASE WHEN t >= 1 AND NOT coalesce(list_contains(labels, t), false) THEN 'target label absent' END], lambda e: e IS NOT NULL) AS errors FROM v)"""


@query(f"WITH {VALID} SELECT scene_id, array_to_string(errors, '; ') AS errors, len(errors) = 0 AS valid, scene_id % 17 = 0 AS warned FROM validated")
def validated_scenes(spark, folder):
    out = C.validate_scenes(*register(spark, folder))
    return out.select("scene_id", F.array_join("errors", "; ").alias("errors"), "valid", (F.size("warnings") > 0).alias("warned"))


@query(f"WITH {VALID} SELECT (SELECT count(*) FROM validated) AS scenes, (SELECT CAST(sum(len(errors)) AS BIGINT) FROM validated) AS error_count, (SELECT string_agg(m, '; ' ORDER BY scene_id, e) FROM (SELECT scene_id, e, scene_id || ': ' || e AS m FROM (SELECT scene_id, unnest(errors) AS e FROM validated) ORDER BY scene_id, e LIMIT 50)) AS errors, false AS valid")
def validation_report(spark, folder):
    out = C.report(C.validate_scenes(*register(spark, folder)))
    return out.withColumn("errors", F.array_join("errors", "; "))


@query("""SELECT s_suppkey AS scene_id, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 3 = 0 THEN 'feature schema or shape missing or different' ELSE 'features not finite' END AS error FROM supplier
  WHERE s_suppkey % 7 = 0 OR s_suppkey % 3 = 0 OR s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey % 11 = 0 AND l_linenumber = 7)""")
def contract_errors(spark, folder):
    points, scenes = register(spark, folder)
    points = points.withColumn("residual", F.when(~F.isnan("z"), F.col("residual")))
    return C.contract_errors(scenes.withColumn("feature_width", F.when(F.col("scene_id") % 3 == 0, 2).otherwise(3)), points)


@query("""WITH p AS (SELECT l_suppkey AS scene_id, l_discount AS v, l_discount + CASE WHEN l_suppkey % 10 = 0 AND l_linenumber = 3 THEN 0.25 ELSE 0 END AS w FROM lineitem)
  SELECT scene_id, floor(max(abs(v - w)) * 1e6 + 0.500123) / 1e6 AS max_abs FROM p GROUP BY 1 HAVING max(abs(v - w) - 3e-6 - 3e-5 * abs(w)) > 0""")
def reconstruction_errors(spark, folder):
    """Scenes whose stored curvature isn't what is computed anew; here some of what is computed is off by a quarter."""
    line = V.table(spark, folder, "lineitem")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("point_id")
    off = F.when((F.col("l_suppkey") % 10 == 0) & (F.col("l_linenumber") == 3), 0.25).otherwise(0.0)
    stored = line.select(F.col("l_suppkey").alias("scene_id"), key, F.col("l_discount").alias("curvature"))
    expected = line.select(F.col("l_suppkey").alias("scene_id"), key, (F.col("l_discount") + off).alias("curvature"))
    return C.reconstruction_errors(stored, expected, features=("curvature",)).select("scene_id", r6("max_abs").alias("max_abs"))


@query(f"WITH p AS (SELECT l_suppkey AS scene_id, p_size % 45 AS label FROM {PARTS}) SELECT label <= 37 AS accepted, count(*) AS n FROM p GROUP BY 1")
def quarantined_labels(spark, folder):
    line, part = V.table(spark, folder, "lineitem"), V.table(spark, folder, "part")
    points = line.join(part, line["l_partkey"] == part["p_partkey"]).select((F.col("p_size") % 45).alias("label"))
    good, bad = C.quarantine(points, F.col("label").between(0, 37), "label")
    return good.select(F.lit(True).alias("accepted")).union(bad.select(F.lit(False))).groupBy("accepted").agg(F.count("*").alias("n"))


LOG = "log AS (SELECT o_orderkey AS row_idx, o_custkey % 10 AS run, o_totalprice AS miou FROM orders)"


@query(f"WITH {LOG} SELECT run, row_idx, miou FROM log QUALIFY row_number() OVER (PARTITION BY run ORDER BY miou DESC, row_idx) = 1")
def best_log_rows(spark, folder):
    """The row with the highest metric of each run; the first at ties."""
    log = V.table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_idx"), (F.col("o_custkey") % 10).alias("run"), F.col("o_totalprice").alias("miou"))
    return log.groupBy("run").agg(F.max_by(F.struct("row_idx", "miou"), F.struct("miou", -F.col("row_idx"))).alias("b")).select("run", "b.*")


@query("SELECT s_suppkey AS config, s_acctbal AS score FROM supplier WHERE s_nationkey % 3 = 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 1")
def best_config(spark, folder):
    status = F.element_at(F.array(F.lit("OK"), F.lit("FAILED"), F.lit("NO_METRICS")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    return V.table(spark, folder, "supplier").where(status == "OK").agg(F.max_by(F.struct(F.col("s_suppkey").alias("config"), F.col("s_acctbal").alias("score")), F.struct("s_acctbal", -F.col("s_suppkey"))).alias("b")).select("b.*")


@query("SELECT max(CAST(regexp_extract(name, 'version_([0-9]+)$', 1) AS BIGINT)) AS latest FROM (SELECT 'run/version_' || s_suppkey AS name FROM supplier)")
def latest_version(spark, folder):
    names = V.table(spark, folder, "supplier").select(F.concat(F.lit("run/version_"), F.col("s_suppkey")).alias("name"))
    return names.agg(F.max(F.regexp_extract("name", r"version_(\d+)$", 1).cast("long")).alias("latest"))


@query(f"WITH {V.SCENE_LOG} SELECT CAST(row_number() OVER (PARTITION BY split ORDER BY scene_id) AS INTEGER) AS place, split, scene_id FROM scene_log QUALIFY place <= 20")
def first_scenes(spark, folder):
    order = Window.partitionBy("split").orderBy("scene_id")
    return V.scene_log(spark, folder).withColumn("place", F.row_number().over(order)).where("place <= 20").select("place", "split", "scene_id")


NAMES = ("crack", "rutting", "unknown", "pothole", "patching", "raveling", "concrete_damage")


@query("WITH k AS (SELECT p_partkey % 50 AS scene_id, p_partkey AS id, [" + ", ".join(f"'{n}'" for n in NAMES) + "][p_size % 7 + 1] AS kind FROM part) SELECT scene_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY coalesce(o, 99), id) AS INTEGER) AS place, id, kind FROM k LEFT JOIN (VALUES " + ", ".join(f"('{k}', {v})" for k, v in L.APPLY_ORDER.items()) + ") a(name, o) ON name = kind")
def apply_order(spark, folder):
    """The damages of each scene in the order in which they are applied; unknown kinds come last, ties keep their order."""
    kind = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_size") % 7 + 1).cast("int"))
    rows = V.table(spark, folder, "part").select((F.col("p_partkey") % 50).alias("scene_id"), F.col("p_partkey").alias("id"), kind.alias("kind"))
    order = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in L.APPLY_ORDER.items() for x in kv)), F.col("kind")), F.lit(99))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("scene_id").orderBy(order, "id"))).select("scene_id", "place", "id", "kind")


@query("WITH a AS (SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45), b AS (SELECT l_partkey AS k FROM lineitem WHERE l_discount < 0.02) SELECT 'both' AS part, count(*) AS n FROM (SELECT k FROM a UNION ALL SELECT k FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'distinct', count(DISTINCT k) FROM a")
def set_operations(spark, folder):
    line = V.table(spark, folder, "lineitem")
    a, b = line.where("l_quantity > 45").select("l_partkey"), line.where("l_discount < 0.02").select("l_partkey")
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(a.unionAll(b), "both").union(count(a.distinct().join(b, "l_partkey", "left_anti"), "only_a")).union(count(a.distinct(), "distinct"))


MAT = "g AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, 20 * avg(CAST(embedding[i + 1] AS DOUBLE) * CAST(embedding[j + 1] AS DOUBLE)) AS v FROM embeddings, range(6) a(i), range(6) b(j) GROUP BY ALL), h0 AS (SELECT i, j, exp(v) AS v FROM g)"


def _sink():
    parts, last = [MAT], "h0"
    for k in range(10):
        side = "i" if k % 2 == 0 else "j"
        parts.append(f"h{k + 1} AS (SELECT i, j, v / (sum(v) OVER (PARTITION BY {side}) + 1e-6) AS v FROM {last})")
        last = f"h{k + 1}"
    return ", ".join(parts)


def products(spark, folder):
    """The mean products of the embeddings' first six components with each other, times 20."""
    e = F.transform(F.slice("embedding", 1, 6), lambda v: v.cast("double"))
    rows = V.table(spark, folder, "embeddings").select(e.alias("e")).select("e", F.posexplode("e").alias("i", "p")).select("i", "p", F.posexplode("e").alias("j", "q"))
    return rows.groupBy("i", "j").agg((20.0 * F.avg(F.col("p") * F.col("q"))).alias("v"))


def matrix(spark, folder):
    return X.sinkhorn(products(spark, folder))


@query(f"WITH {_sink()} SELECT i, j, {q6('v')} AS v FROM h10")
def sinkhorn_matrix(spark, folder):
    return rounded(matrix(spark, folder), "v")


@query(f"WITH {_sink()} SELECT (SELECT {q6('max(abs(s - 1))')} FROM (SELECT sum(v) AS s FROM h10 GROUP BY i)) AS row_error, (SELECT {q6('max(abs(s - 1))')} FROM (SELECT sum(v) AS s FROM h10 GROUP BY j)) AS column_error, (SELECT {q6('min(v)')} FROM h10) AS least")
def stochastic_error(spark, folder):
    return rounded(X.stochastic_error(matrix(spark, folder)), "row_error", "column_error", "least")


@query(f"WITH {_sink()}, x AS (SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(embedding[i + 1] AS DOUBLE) AS x, CAST(embedding[i + 11] AS DOUBLE) AS r FROM embeddings, range(6) t(i)) SELECT a.vec_id, a.i, {q6('a.x + sum(h.v * b.r)')} AS y FROM x a JOIN h10 h ON h.i = a.i JOIN x b ON b.vec_id = a.vec_id AND b.i = h.j GROUP BY a.vec_id, a.i, a.x")
def mixed_residuals(spark, folder):
    e = V.table(spark, folder, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 6)).alias("i", "x"), F.slice("embedding", 11, 6).alias("rs"))
    return rounded(X.apply(matrix(spark, folder), e.select("vec_id", "i", F.col("x").cast("double").alias("x"), F.get("rs", F.col("i")).cast("double").alias("r")), "vec_id"), "y")


@query(f"WITH {SMALL}, p AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY point_id) AS k FROM cloud_s) SELECT scene_id, {q6('avg(sqrt(x*x+y*y))')} AS mean_range, count(*) FILTER (k % 2 = 0) AS even FROM p GROUP BY 1")
def scene_means(spark, folder):
    k = F.row_number().over(Window.partitionBy("scene_id").orderBy("point_id"))
    return rounded(small(spark, folder).withColumn("k", k).groupBy("scene_id").agg(F.avg(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("mean_range"), F.sum((F.col("k") % 2 == 0).cast("long")).alias("even")), "mean_range")


PRODUCTS = MAT.split(", h0 AS")[0]
STEPS = ", ".join(f"y{k} AS (SELECT i, sum(v * x) AS y FROM g JOIN x{k} ON j = place GROUP BY i), x{k + 1} AS (SELECT i AS place, y / sqrt((SELECT sum(y * y) FROM y{k})) AS x FROM y{k})" for k in range(60))


@query(f"WITH {PRODUCTS}, x0 AS (SELECT CAST(k AS INTEGER) AS place, 1 / sqrt(6.0) AS x FROM range(6) t(k)), {STEPS} SELECT {q6('sqrt(sum(y * y))')} AS norm FROM (SELECT i, sum(v * x) AS y FROM g JOIN x60 ON j = place GROUP BY i)")
def spectral_norm(spark, folder):
    """The largest singular value of the products' matrix, which is symmetric, as 60 steps find it."""
    return rounded(X.spectral_norm(products(spark, folder)), "norm")


def scene_tasks(spark, folder):
    """A scene for each supplier; every fifth has no target."""
    target = F.when(F.col("s_suppkey") % 5 > 0, F.col("s_suppkey") % 37 + 1).cast("int")
    return V.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("scene_id"), target.alias("target_label"))


def _u(*parts):
    return f"(({_draw(42, *parts)} + 0.5) / 4294967296.0)"


PLAN = f"""t AS (SELECT s_suppkey AS scene_id, CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_suppkey % 37 + 1 AS INTEGER) END AS target FROM supplier),
  s AS (SELECT *, CASE WHEN target > 20 THEN 'concrete' WHEN target > 0 THEN 'asphalt' WHEN {_u("'pavement'", 'scene_id')} < 0.3 THEN 'concrete' ELSE 'asphalt' END AS pave FROM t),
  k AS (SELECT scene_id, target, label, disease, severity, concat_ws('/', disease, variant) AS kind, coalesce(label = target, FALSE) AS own FROM s JOIN {DIM} ON pavement = pave AND label > 0),
  f AS (SELECT *, max(CASE WHEN own THEN kind END) OVER (PARTITION BY scene_id) AS same FROM k),
  c AS (SELECT * FROM f WHERE own OR ((severity = '-' OR disease = 'bleeding' OR severity = CASE WHEN {_u("'severity'", 'scene_id', 'kind')} < 0.4 THEN 'severe' ELSE 'light' END) AND NOT coalesce(kind = same, FALSE))),
  r AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY own DESC, -ln({_u("'choice'", 'scene_id', 'kind')}), label) <= 3)"""


@query(f"WITH {PLAN} SELECT scene_id, target AS target_label, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY coalesce(o, 99), label) AS INTEGER) AS place, label, kind FROM r LEFT JOIN (VALUES " + ", ".join(f"('{k}', {v})" for k, v in L.APPLY_ORDER.items()) + ") a(name, o) ON name = disease")
def scene_plans(spark, folder):
    """The damages of each scene in the order in which they are applied."""
    rows = Z.planned(scene_tasks(spark, folder), beside=2).select("scene_id", "target_label", F.posexplode("damages").alias("p", "d"))
    return rows.select("scene_id", "target_label", (F.col("p") + 1).alias("place"), "d.label", F.concat_ws("/", "d.disease", "d.variant").alias("kind"))


@query()
def scene_synthesis(spark, folder):
    """A whole scene for each supplier: points, mean height and intensity of each of its labels."""
    made = Z.generate(scene_tasks(spark, folder), width=2.4, length=2.4, step=0.08, points=600)
    return made.groupBy("scene_id", "target_label", "label").agg(F.count("*").alias("points"), F.avg("z").alias("z"), F.avg("intensity").alias("intensity"))
