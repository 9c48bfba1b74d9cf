"""Behaviours that SQL in another engine can't check: invariants, fixtures, contracts."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import labels as L
from quarry.operators import balance, cracks, gap, matrices, metrics, prepare, sampling, scenes, spatial, synthesis, tiles, validate
from quarry.plans import views as V


def test_label_space():
    assert [L.lut("four")[k] for k in (0, 1, 9, 13, 19, 21, 27, 34, 37)] == [0, 1, 2, 3, 2, 2, 3, 2, 3]
    assert [L.lut("eight")[k] for k in (0, 1, 9, 13, 19, 21, 27, 34, 37)] == [0, 1, 2, 3, 4, 5, 6, 7, 7]
    assert L.lut(" Binary ") == [0] + [1] * 37 and L.stage_for_num_classes(8) == "eight" and set(L.RECIPES) == set(range(1, 38))
    for bad in (lambda: L.lut("nine"), lambda: L.stage_for_num_classes(5)):
        with pytest.raises(ValueError):
            bad()


def test_confusion_ignores_padding(spark):
    rows = spark.createDataFrame([(0, 0, True), (1, 1, True), (1, -1, True), (2, 1, False), (2, 2, True)], "pred int, target int, valid boolean")
    got = {(r.target, r.pred): r.n for r in metrics.dense(metrics.confusion(rows, 3, valid="valid"), 3).collect()}
    assert got == {(t, p): int(t == p) for t in range(3) for p in range(3)}


def test_absent_class(spark):
    m = [[10, 0, 0, 0], [0, 6, 4, 0], [0, 2, 8, 0], [0, 0, 0, 0]]
    counts = spark.createDataFrame([(t, p, n) for t, row in enumerate(m) for p, n in enumerate(row) if n], "target int, pred int, n long")
    assert metrics.summary(counts, 4).first().supported_miou == pytest.approx((0.5 + 8 / 14) / 2)
    assert [r.supported for r in metrics.per_class(counts, 4).orderBy("label").collect()] == [True, True, True, False]


def test_thresholds_and_bootstrap(spark):
    rows = spark.createDataFrame([(0.02, 0), (0.20, 0), (0.75, 1), (0.95, 1)], "prob double, target int")
    best = metrics.best_threshold(metrics.threshold_scan(rows, spark.createDataFrame([(t,) for t in (0.1, 0.5, 0.9)], "threshold double"))).first()
    assert (best.threshold, best.iou) == (0.5, 1.0)
    with pytest.raises(ValueError):
        metrics.thresholds(spark, 0.5, 0.1, 0.1)
    scenes = spark.createDataFrame([(k, 9 - k, 1 + k, 1 + k) for k in range(3)], "scene_id long, tp long, fp long, fn long")
    iou = F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn"))
    r = metrics.bootstrap(scenes, iou, 32, seed=7).first()
    assert r.lower <= r.mean <= r.upper
    one = metrics.bootstrap(scenes, iou, 0).first()
    assert one.lower == one.upper == pytest.approx(24 / 36)
    with pytest.raises(ValueError):
        metrics.split_leading(scenes, 3)


def test_perfect_calibration(spark):
    rows = spark.createDataFrame([([1.0, 0.0], 0), ([0.0, 1.0], 1), ([1.0, 0.0], 0)], "probs array<double>, target int")
    r = metrics.calibration_summary(rows, 10).first()
    assert max(r.ece, r.brier, r.nll) < 1e-8


def test_weights(spark):
    counts = spark.createDataFrame([(0, 10_000), (1, 100), (2, 0)], "class int, n long")
    w = [r.weight for r in balance.effective_weights(counts, 0.999, 3.0).orderBy("class").collect()]
    assert w[2] == 0 and w[1] > w[0] and w[1] <= 3 and (w[0] + w[1]) / 2 == pytest.approx(1)
    assert [r.n for r in balance.class_counts(spark.createDataFrame([(0,), (0,), (1,), (20,), (37,)], "label int"), "binary").orderBy("class").collect()] == [2, 3]
    with pytest.raises(Exception, match="out of range"):
        balance.class_counts(spark.createDataFrame([(38,)], "label int"), "four").collect()


def test_coverage(spark):
    points = spark.createDataFrame([(1, k) for k in (0, 1, 1, 20, 20, 20)] + [(2, k) for k in (0, 20, 20, 20)], "scene_id long, label int")
    scenes = spark.createDataFrame([(1, 1), (2, 20)], "scene_id long, target_label int")
    got = sorted(map(tuple, balance.coverage(points, scenes).collect()))
    assert got == [(1, 1, 1, 2), (20, 1, 1, 3)]


def surface():
    a = np.linspace(-1, 1, 9)
    x, y = (g.ravel() for g in np.meshgrid(a, a))
    return np.column_stack((x, y, 0.08 * x**2 - 0.04 * y + 0.015 * np.sin(3 * x)))


def test_geometry_is_invariant_and_equals_sql(spark):
    base = surface() + np.random.default_rng(0).normal(0, 1e-3, (81, 3))
    first, moved = spatial.surface_arrays(base), spatial.surface_arrays(base * 4.5 + [3, -2, 7])
    for c in ("curvature", "nz"):
        assert np.allclose(first[c], moved[c], rtol=2e-5, atol=2e-6)
    assert np.allclose(first["residual"] / first["radius"], moved["residual"] / moved["radius"], rtol=2e-5, atol=2e-6)
    df = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(base)], "scene_id long, point_id long, x double, y double, z double")
    sql = spatial.curvature(df).orderBy("point_id").toPandas()
    udf = spatial.local_geometry(df).orderBy("point_id").toPandas()
    for c in ("curvature", "radius", "density"):
        assert np.allclose(sql[c], udf[c], atol=1e-6), c
    assert spatial.surface_arrays(base[:3])["nz"].tolist() == [1, 1, 1]


def test_large_cloud_geometry(spark, data):
    got = spatial.local_geometry(V.cloud_l(spark, data))
    r = got.agg(F.count("*").alias("n"), F.min("curvature").alias("lo"), F.max("curvature").alias("hi"), F.min("nz").alias("nz"), F.max(F.abs(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2) - 1)).alias("gap")).first()
    assert r.n == spark.read.parquet(f"{data}/lineitem.parquet").count() and 0 <= r.lo <= r.hi <= 1 and r.nz >= 0 and r.gap < 1e-9


def test_gap_of_a_sample_with_itself(spark):
    rows = spark.range(200).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side"), (F.sin("id") * 3).alias("v"), F.lit("d").alias("descriptor"), F.col("id").alias("key"))
    r = gap.distances(rows, "v").first()
    assert r.wasserstein == 0 and r.energy == 0
    assert abs(gap.kernel_discrepancy(rows, ("v",), "key", 500).first().mmd) < 1e-12
    two = spark.createDataFrame([("a", 0.0, "d"), ("a", 1.0, "d"), ("b", 2.0, "d"), ("b", 3.0, "d")], "side string, v double, descriptor string")
    assert gap.distances(two, "v").first().wasserstein == pytest.approx(2)


def test_plane_keeps_its_points(spark):
    rows = [(0, k, (k % 16) / 8, (k // 16) / 8, 0.01 * (k % 16) / 8 + 0.02 * (k // 16) / 8) for k in range(256)]
    df = spark.createDataFrame(rows + [(0, 900 + k, 1.0, 1.0, 3.0 + k) for k in range(5)], "scene_id long, point_id long, x double, y double, z double")
    r = spatial.ransac_planes(df).first()
    assert r.retained > 0.97 and abs(r.nz) > 0.99
    assert spatial.ground(df.where("point_id < 900")).count() == 256
    p = spatial.fit_plane(df.where("point_id < 900")).first()
    assert (p.a, p.b, p.c) == pytest.approx((0.01, 0.02, 0), abs=1e-9)


def test_sampling_policy(spark):
    df = spark.range(100).select(F.lit(1).cast("long").alias("scene_id"), F.col("id").alias("point_id"), (F.col("id") < 20).cast("int").alias("label"))
    assert sampling.damage_first(df, 10).agg(F.sum("label")).first()[0] == 10
    a = sorted(r.point_id for r in sampling.uniform(df, 10).collect())
    assert a == sorted(r.point_id for r in sampling.uniform(df.repartition(7), 10).collect()) and len(a) == 10
    assert sampling.uniform(df, 10).agg(F.sum("label")).first()[0] < 10
    assert sampling.protected(df, 20, F.lit(1)).agg(F.sum("label")).first()[0] >= 2
    assert sampling.fill_up(df, 130).count() == 130


def test_nearest_within_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((80, 2)) * 3, rng.random((60, 2)) * 3
    left = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(a)], "scene_id long, point_id long, x double, y double")
    right = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(b)], "scene_id long, source_id long, x double, y double")
    got = {r.point_id: r.source_id for r in spatial.nearest_within(left, right, 0.2).collect()}
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    assert got == {k: int(d[k].argmin()) for k in range(80) if d[k].min() <= 0.2}


def test_validation_contract(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 3, 0.5, 0.1, 0.0, 0.0, 0.0, 1.0)], "scene_id long, x double, y double, z double, label int, intensity_n double, curvature double, residual double, nx double, ny double, nz double")
    scenes = spark.createDataFrame([(1, validate.FEATURE_SCHEMA, -1), (2, None, -1)], "scene_id long, feature_schema string, target_label int")
    got = {r.scene_id: r for r in validate.validate_scenes(points, scenes).collect()}
    assert got[1].valid and got[2].errors == ["feature schema missing or different", "no points"]
    assert validate.validate_scenes(points.drop("nz"), scenes.where("scene_id = 1")).first().errors == ["missing nz"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("scenes") / "all")
    synthesis.generate(synthesis.tasks(spark, list(range(1, 38))), points=1024).write.parquet(folder)
    return spark.read.parquet(folder)


def test_every_label_reaches_its_scene(made):
    per = made.groupBy("scene_id", "target_label").agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("target_label")).cast("int")).alias("own"), F.countDistinct("label").alias("labels"))
    rows = per.collect()
    assert sorted(r.target_label for r in rows) == list(range(1, 38))
    assert all(r.n == 1024 and r.own > 0 and r.labels <= 2 for r in rows), [(r.target_label, r.own) for r in rows if not r.own]


def test_scene_values(made):
    r = made.agg(F.min("intensity").alias("lo"), F.max("intensity").alias("hi"), F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("far")).first()
    assert 0 <= r.lo < r.hi <= 1 and r.far == pytest.approx(1)
    back = prepare.from_unit_ball(made).agg(F.max("x").alias("x"), F.min("x").alias("lo")).first()
    assert -0.1 < back.lo and back.x < 3.1


def test_scenes_do_not_depend_on_partitions(spark):
    t = synthesis.tasks(spark, [9, 34])
    take = lambda n: sorted(map(tuple, synthesis.generate(t.repartition(n), points=50).select("scene_id", "point_id", "label", F.round("z", 9)).collect()))
    assert take(1) == take(5)


def test_rough_surface(spark):
    t = synthesis.tasks(spark, [1])
    smooth, rough = (synthesis.surface(t, 4, 4, 0.1, c).agg(F.stddev_pop("z")).first()[0] for c in "AC")
    assert 0 < smooth < rough and rough / smooth == pytest.approx(4)


def test_quota(spark, tmp_path):
    folder = f"{tmp_path}/q"
    got = synthesis.fill_quota(spark, folder, [9, 20], scenes=2, min_points=5, wave=1, points=200, step=0.1)
    assert {r.label for r in got.collect() if r.scene_count >= 2 and r.point_count >= 5} == {9, 20}
    n = spark.read.parquet(folder).select("scene_id").distinct().count()
    synthesis.fill_quota(spark, folder, [9, 20], scenes=2, min_points=5, points=200, step=0.1)
    assert spark.read.parquet(folder).select("scene_id").distinct().count() == n == 4


def test_intensity_scales(spark):
    row = spark.range(1).select(P := prepare.normalize_intensity(F.lit(25.0), F.lit("uint8")), prepare.to_metres(F.lit(3.0), F.lit("mm"))).first()
    assert row[0] == pytest.approx(25 / 255) and row[1] == pytest.approx(0.003) and P is not None
    with pytest.raises(Exception, match="unknown unit"):
        spark.range(1).select(prepare.to_metres(F.lit(3.0), F.lit("yd"))).collect()
    assert math.isclose(spark.range(1).select(prepare.tilt(F.lit(1.0))).first()[0], 0.0)


def test_missing_probabilities_reach_no_threshold(spark):
    rows = spark.createDataFrame([(0.9, 1), (None, 0), (float("nan"), 0), (0.1, 0), (None, 1), (0.6, 0)], "prob double, target int")
    scan = {round(r.threshold, 1): (r.tp, r.fp, r.fn) for r in metrics.threshold_scan(rows, metrics.thresholds(spark, 0.5, 0.9, 0.1)).collect()}
    assert scan == {0.5: (1, 1, 1), 0.6: (1, 1, 1), 0.7: (1, 0, 1), 0.8: (1, 0, 1), 0.9: (1, 0, 1)}


def test_neighbours_with_stray_points(spark):
    """Strays far away, equal places and a scene of few points change nothing: brute force says the same."""
    rng = np.random.default_rng(4)
    xyz = np.vstack([rng.normal(size=(300, 3)), [[1500.0, 0, 0], [0, -900.0, 3]], np.zeros((4, 3))])
    rows = [(0, k, *map(float, p)) for k, p in enumerate(xyz)] + [(1, k, float(k), 0.0, 0.0) for k in range(3)]
    df = spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double, z double")
    got = {(r.scene_id, r.point_id, r["rank"]): r.neighbour for r in spatial.knn(df, 5).collect()}
    want = {}
    for scene, n in ((0, len(xyz)), (1, 3)):
        own = np.array([r[2:] for r in rows if r[0] == scene])
        for k in range(n):
            order = sorted((j for j in range(n) if j != k), key=lambda j: (((own[k] - own[j]) ** 2).sum(), j))
            want |= {(scene, k, at + 1): j for at, j in enumerate(order[:5])}
    assert got == want


def test_decay_scan_over_blocks(spark):
    values = np.random.default_rng(1).normal(size=500)
    df = spark.createDataFrame([(s, k * 3, float(v)) for s in (1, 2) for k, v in enumerate(values[: 500 if s == 1 else 5])], "scene_id long, place long, v double")
    for alpha in (0.5, 0.95):
        got = {(r.scene_id, r.place): r.state for r in prepare.decay_scan(df, "v", "place", alpha, block=4, levels=3).collect()}
        state, want = 0.0, {}
        for k, v in enumerate(values):
            state = v + alpha * state
            want[1, k * 3] = state
            if k < 5:
                want[2, k * 3] = state
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_spectral_norm(spark):
    a = np.random.default_rng(2).normal(size=(7, 4))
    df = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(7) for j in range(4)], "i int, j int, v double")
    assert abs(matrices.spectral_norm(df).first().norm - np.linalg.norm(a, 2)) < 1e-6
    assert matrices.spectral_norm(df.withColumn("v", F.lit(0.0))).first().norm == 0


# --- whole scenes -----------------------------------------------------------------------------

SIDE = {"width": 2.4, "length": 2.4, "step": 0.08}


@pytest.fixture(scope="module")
def whole(spark):
    tasks = synthesis.tasks(spark, list(range(1, 38))).unionAll(spark.createDataFrame([(100 + k, None) for k in range(4)], "scene_id long, target_label int"))
    return scenes.generate(tasks, points=500, **SIDE).cache()


def test_whole_scenes_hold_their_labels(spark, whole):
    plan = {r.scene_id: r for r in scenes.planned(synthesis.tasks(spark, list(range(1, 38))), 2.4, 2.4).collect()}
    rows = whole.groupBy("scene_id", "target_label").agg(F.collect_set("label").alias("labels"), F.count("*").alias("n")).collect()
    assert len(rows) == 41
    for r in rows:
        if r.target_label:
            assert r.target_label in r.labels and set(r.labels) <= {0, *(d.label for d in plan[r.scene_id].damages)}, r
    assert all(0 < r.n <= 500 for r in rows) and all(len(r.labels) > 1 for r in rows if r.target_label is None)


def test_plans_are_in_order(spark):
    for r in scenes.planned(synthesis.tasks(spark, list(range(1, 38))), beside=3).collect():
        assert len(r.damages) == 4 and sum(d.label == r.target_label for d in r.damages) == 1
        assert [d.order for d in r.damages] == sorted(d.order for d in r.damages)
        assert len({(d.disease, d.variant) for d in r.damages}) == 4 and {L.RECIPES[d.label][0] for d in r.damages} == {r.pavement}


def test_fold_is_one_damage_after_the_other(spark):
    """Folding over three damages equals three folds over one each, which carry height, label and gone."""
    plan = scenes.planned(synthesis.tasks(spark, [10, 12, 22, 37, 20]), 2.4, 2.4, beside=2)
    points = synthesis.surface(plan, 2.4, 2.4, 0.08).cache()
    args = (2.4, 2.4, 0.08)
    at_once = scenes.applied(points, *args)
    rows = points
    for k in range(3):
        one = F.expr(f"slice(everything, {k + 1}, 1)")
        rows = scenes.applied((rows if k else rows.withColumn("everything", F.col("damages"))).withColumn("damages", one), *args).cache()
    take = lambda df: {(r.scene_id, r.point_id): (round(r.z, 9), r.label, r.gone) for r in df.collect()}
    whole = take(at_once)
    assert whole == take(rows) and len({v[1] for v in whole.values()}) > 5


def test_ravelled_points_go_and_their_label_spreads(spark):
    plan = scenes.planned(synthesis.tasks(spark, [12]), 2.4, 2.4)
    hit = scenes.applied(synthesis.surface(plan, 2.4, 2.4, 0.08), 2.4, 2.4, 0.08).cache()
    gone, n = hit.where("gone").count(), hit.where("x between 0.24 and 2.16 and y between 0.24 and 2.16").count()
    assert 0.2 < gone / n < 0.4
    labelled = lambda df: df.where("label = 12 and not gone").count()
    assert labelled(scenes.spread_ravelling(hit, 0.24)) > labelled(hit) > 0


def test_labels_are_carried_from_the_nearest_point(spark):
    kind = "scene_id long, point_id long, x double, y double, z double, label int, intensity double"
    before = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 2, 0.1), (1, 1, 1.0, 0.0, 0.0, 10, 0.2), (1, 2, 2.0, 0.0, 0.0, 0, 0.3), (1, 3, 3.0, 0.0, 0.0, 5, 0.4)], kind)
    noisy = spark.createDataFrame([(1, 0, 0.9, 0.0, 0.0, 2, 0.1), (1, 1, 0.05, 0.0, 0.0, 10, 0.2), (1, 2, 2.0, 0.0, 0.0, 0, 0.3), (1, 3, 3.0, 0.004, 0.0, 5, 0.4)], kind)
    got = {r.point_id: (r.label, r.intensity) for r in scenes.carried_labels(noisy, before, 0.002).collect()}
    # a pothole's label goes with the nearest point however far it is, a crack's only within three deviations
    assert got == {0: (10, 0.2), 1: (0, 0.1), 2: (0, 0.3), 3: (5, 0.4)}


def test_scan_lines_thin_out_but_leave_small_scenes(spark):
    points = synthesis.surface(synthesis.tasks(spark, [1]), 2.4, 2.4, 0.08)
    n = scenes.scan_lines(points, 0.4).count()
    assert 10 < n < 0.9 * points.count()
    assert scenes.scan_lines(points.where("point_id < 8"), 0.4).count() == 8


def test_scenes_by_voxels(spark):
    found = scenes.generate(synthesis.tasks(spark, [9, 33]), density=30.0, mixing=0.0, **SIDE)
    n = found.groupBy("scene_id").count().collect()
    assert len(n) == 2 and all(50 < r["count"] <= (2.4 / (1 / 30) ** 0.5 + 2) ** 2 for r in n)


def test_scenes_as_a_whole_equal_those_by_joins(spark, monkeypatch):
    """Scenes of a tile's size are made without joins of points: the same points, labels and intensities, one shuffle before the sample."""
    tasks = synthesis.tasks(spark, [12, 34])
    found = scenes.generate(tasks, points=200, mixing=0.5, **SIDE)
    take = lambda df: sorted((r.scene_id, r.point_id, r.label, *(round(r[c], 8) for c in ("x", "y", "z", "intensity"))) for r in df.collect())
    whole = take(found)
    made = tiles.dealt(scenes.planned(tasks, 2.4, 2.4), 1800, "scene_id")
    plan = scenes._whole(synthesis.surface(made, 2.4, 2.4, 0.08), 2.4, 2.4, 0.08, 0.002, 0.02, 0.03, 0.1, 0.05, 42)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.index("Exchange") > plan.rindex("Generate")
    monkeypatch.setattr(tiles, "TILE", 0)
    monkeypatch.setattr(scenes.tiles, "TILE", 0)
    assert take(scenes.generate(tasks, points=200, mixing=0.5, **SIDE)) == whole and len(whole) == 400


def geometry_by_force(rows, k=16):
    """Geometry of a scene's (point, x, y, z), a point at a time."""
    rows = sorted(rows)
    out = {}
    for p, *at in rows:
        if len(rows) < 4:
            out[p] = (0, 0, 0, 1, 0, 1e-6, 0)
            continue
        near = sorted((sum((a - b) ** 2 for a, b in zip(at, other)), q, other) for q, *other in rows if q != p)[:k]
        places = np.array([x for _, _, x in near])
        values, vectors = np.linalg.eigh(np.cov(places.T))
        normal = vectors[:, 0] * (-1 if vectors[2, 0] < 0 else 1)
        radius = max(near[-1][0] ** 0.5, 1e-6)
        curvature = min(max(values[0] / max(values.sum(), 1e-12), 0), 1)
        out[p] = (curvature, *normal, float((np.array(at) - places.mean(axis=0)) @ normal), radius, len(near) / (np.pi * radius**2))
    return out


@pytest.mark.parametrize("tile", [24, 2048])
def test_geometry_by_tiles_equals_brute_force(spark, tile):
    """Scenes of one tile and of many, a stray return, ties, a place with more points than a tile, scenes with few points."""
    rng = np.random.default_rng(7)
    flat = np.column_stack((rng.uniform(0, 20, (300, 2)), rng.normal(0, 0.01, 300)))
    lattice = np.array([(x / 2, y / 2, (x * y % 3) / 8) for x in range(12) for y in range(12)], float)
    clusters = np.vstack((rng.normal(0, 1e-3, (120, 3)), rng.normal(0, 1, (20, 3)) ** 3 + 8, np.repeat([[1.0, 2.0, 3.0]], 40, axis=0), np.repeat([[-1.0, 2.0, 3.0]], 6, axis=0)))
    scenes = {1: np.vstack((flat, [[1500.0, 3.0, 1.0]])), 2: lattice, 3: clusters, 4: flat[:3], 5: flat[:9], 6: np.zeros((30, 3)), 7: flat[:1]}
    rows = [(s, (37 * k) % len(xyz) if len(xyz) % 37 else k, *map(float, p), "extra") for s, xyz in scenes.items() for k, p in enumerate(xyz)]
    odd = [(1, 9001, None, 0.0, 0.0, ""), (1, 9002, float("nan"), 0.0, 0.0, ""), (1, 9003, float("inf"), 0.0, 0.0, ""), (None, 5, 0.0, 0.0, 0.0, ""), (1, None, 0.0, 0.0, 0.0, "")]
    df = spark.createDataFrame(rows + odd, "scene_id long, point_id long, x double, y double, z double, c_x string")
    got = {(r[0], r[1]): r[2:] for r in map(tuple, tiles.local_geometry(df, tile=tile).collect())}
    want = {(s, p): v for s in scenes for p, v in geometry_by_force([r[1:5] for r in rows if r[0] == s]).items()}
    assert got.keys() == want.keys()
    settled_normal = [key for key in want if want[key][0] > 1e-9 or key[0] == 4]  # the normal of neighbours on a line is any across it
    assert len(settled_normal) > 400
    for key in want:
        columns = range(7) if key in settled_normal else (0, 5, 6)
        assert np.allclose([got[key][c] for c in columns], [want[key][c] for c in columns], rtol=1e-7, atol=1e-7), key
    assert tiles.local_geometry(df.where("scene_id < 0"), tile=tile).count() == 0


def test_tiles_are_bounded_and_hold_each_point_once(spark):
    """All points stand in exactly one tile; tiles of the same scene don't overlap and hold at most so many points."""
    rows = spark.range(4000).selectExpr("1L as scene", "pow(rand(1), 6) * 100 x", "pow(rand(2), 6) * 100 y", "rand(3) z")
    full = float(1 << tiles.DEPTH)
    placed = rows.select("*", *(F.floor(F.col(a) / 101 * full).cast("int").alias(f"f_{a}") for a in "xyz"), F.lit(4000).alias("total"))
    found = tiles.nodes(placed, 50).collect()
    assert sum(r.n for r in found) == 4000 and max(r.n for r in found) <= 50 and len({r.depth for r in found}) > 3
    cells = {(r.depth, r.c_x, r.c_y, r.c_z) for r in found}
    assert len(cells) == len(found)
    assert not any((d - up, x >> up, y >> up, z >> up) in cells for d, x, y, z in cells for up in range(1, d + 1))


def test_lattice_noise(spark):
    """Repeats with the lattice, is bounded by the octaves' heights, meets its corners, and doesn't jump."""
    rows = spark.range(400).selectExpr("id", "id / 97.0D - 1.5 x", "id / 53.0D - 3 y")
    at = lambda dx: np.array([r.v for r in rows.select("id", cracks.value_noise(F.col("x") + dx, "y", 3).alias("v")).orderBy("id").collect()])
    first = at(0.0)
    assert np.abs(first).max() < 1.875 and first.std() > 0.1
    assert np.allclose(first, at(2.0), atol=1e-9)
    one = spark.range(50).selectExpr("id / 350.0D x").select(cracks.value_noise("x", F.lit(0.0), 3, octaves=1).alias("v"))
    v = np.array([r.v for r in one.collect()])
    assert np.allclose(np.diff(v), np.diff(v)[0], atol=1e-9)  # between two corners it's a straight line
    assert not np.allclose(first, [r.v for r in rows.select(cracks.value_noise("x", "y", 4).alias("v")).collect()])


def noise_by_force(x, y, seed):
    total = 0.0
    for k in range(4):
        u, v = ((c * 2.0**k - math.floor(c * 2.0**k)) * 7 for c in (x, y))
        i, j = min(math.floor(u), 6), min(math.floor(v), 6)
        corner = lambda a, b: int(hashlib.md5(f"{seed}|noise|{k}|{i + a}|{j + b}".encode()).hexdigest()[:8], 16) / 2**31 - 1  # noqa: B023, E731
        total += 0.5**k * sum(w * corner(a, b) for a, b, w in ((0, 0, (1 - u + i) * (1 - v + j)), (1, 0, (u - i) * (1 - v + j)), (0, 1, (1 - u + i) * (v - j)), (1, 1, (u - i) * (v - j))))
    return total


def test_noise_of_both_axes_is_of_the_place_before(spark):
    """Columns that take the names of the coordinates in the same select don't get into the noise."""
    rows = spark.range(60).selectExpr("id / 17.0D - 1 x", "cos(id) y")
    moved = rows.select(F.struct("x", "y").alias("p"), (F.col("x") + cracks.value_noise("x", "y", "ax")).alias("x"), (F.col("y") + cracks.value_noise("x", "y", "ay")).alias("y"))
    for r in moved.collect():
        x, y = r.p
        assert np.allclose((r.x, r.y), (x + noise_by_force(x, y, "ax"), y + noise_by_force(x, y, "ay")), atol=1e-9)


def test_points_within_reach_of_a_crack_equal_brute_force(spark):
    """Every point within reach of a curve is found, with the width between knots; odd rows take no part."""
    rng = np.random.default_rng(3)
    curves = [(s, c, *map(float, rng.uniform(-2, 2, 8)), "b") for s in (1, 2) for c in range(4)] + [(2, 9, *([0.5] * 8), "b"), (2, 10, None, *([0.5] * 7), "b"), (None, 11, *([0.5] * 8), "b")]
    curves = spark.createDataFrame(curves, "scene_id long, curve_id long, " + ", ".join(f"{a}{n} double" for a in "xy" for n in range(4)) + ", k string")
    lines = cracks.segments(curves, 16, width_mean=0.2)
    points = [(s, p, *map(float, rng.uniform(-2, 2, 2)), "a") for s in (1, 2, 3) for p in range(800)] + [(2, 9000, None, 0.0, "a"), (None, 1, 0.0, 0.0, "a"), (2, None, 0.0, 0.0, "a")]
    cloud = spark.createDataFrame(points, "scene_id long, point_id long, x double, y double, width string")
    got = {(r.scene_id, r.point_id, r.curve_id): (r.distance, r.k + r.t, r.width, r.dz) for r in cracks.crack(cloud, lines, 0.05, 0.3).collect()}
    want, parts = {}, {}
    for r in lines.collect():
        parts.setdefault((r.scene_id, r.curve_id), []).append(r)
    assert {key[1] for key in parts} == {0, 1, 2, 3, 9} and all(len(v) == 16 for v in parts.values())
    for s, p, x, y, _ in points[:2400]:
        for (scene, curve), held in parts.items():
            if scene == s:
                best = None
                for r in sorted(held, key=lambda r: r.k):
                    d, a = np.array([r.bx - r.ax, r.by - r.ay]), np.array([r.ax, r.ay])
                    t = float(np.clip((np.array([x, y]) - a) @ d / (d @ d), 0, 1)) if d @ d >= 1e-12 else 0.0
                    far = float(np.hypot(*(np.array([x, y]) - a - t * d)))
                    if best is None or far < best[0]:
                        best = (far, r.k + t)
                knots = [r.aw for r in sorted(held, key=lambda r: r.k)] + [max(held, key=lambda r: r.k).bw]
                width = float(np.interp(best[1], range(17), knots))
                if best[0] <= max(width, 0.3) / 2:
                    want[s, p, curve] = (*best, width, -0.05 * np.exp(-((best[0] / (width / 4)) ** 2)) if best[0] <= width / 2 else 0.0)
    assert got.keys() == want.keys() and len(want) > 300
    for key in want:
        assert np.allclose(got[key][0], want[key][0], atol=1e-9) and np.allclose(got[key][2:], want[key][2:], atol=1e-6), key
    assert cracks.crack(cloud.where("point_id < 0"), lines, 0.05).count() == 0
    assert cracks.crack(cloud, lines.where("k < 0"), 0.05).count() == 0


# --- findings of round 3 ----------------------------------------------------------------------


def test_spectral_norm_takes_as_many_steps_as_asked(spark):
    """two singular values that lie close together; the result is the one of 60 products, not of more."""
    a = np.diag([1.0, 0.995])
    x = np.ones(2)
    for _ in range(60):
        x = a @ (x / np.linalg.norm(x))
    want = np.linalg.norm(a @ (x / np.linalg.norm(x)))
    df = spark.createDataFrame([(0, 0, 1.0), (1, 1, 0.995)], "i int, j int, v double")
    assert abs(matrices.spectral_norm(df).first().norm - want) < 1e-9


def test_a_mean_at_the_limit_is_no_edge(spark, tmp_path):
    """F2: in any order of summation the mean of these three sums is a little above 0.13."""
    from quarry.plans import space

    rows = [(k, 1, 1, k, 1.0, 10000.0, d, t) for k, (d, t) in enumerate(((0.07, 0.08), (0.07, 0.02), (0.1, 0.05)))] + [(9, 1, 2, 9, 1.0, 10000.0, 0.1, 0.05)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.scene_id: r.flag for r in space.edge_dilation(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}


def most_rows(df):
    """The most rows that any step of the last job of a frame has made."""
    df.collect()

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        n = plan.metrics().get("numOutputRows")
        return max([n.get().value() if n.isDefined() else 0] + [walk(plan.children().apply(k)) for k in range(plan.children().size())])

    return walk(df._jdf.queryExecution().executedPlan())


def cloud_of(spark, xyz, first=0):
    return spark.createDataFrame([(1, first + n, *map(float, p)) for n, p in enumerate(xyz)], "scene_id long, point_id long, x double, y double, z double")


def test_neighbours_never_meet_a_whole_scene(spark):
    """The pairs grow with the points, not with their square."""
    draws = np.random.default_rng(5)
    a, b = draws.normal(size=(2000, 3)), draws.normal(size=(2000, 3))
    df = spatial.nearest(cloud_of(spark, a), cloud_of(spark, b).withColumnRenamed("point_id", "source_id"))
    assert most_rows(df) < 100 * 2000
    want = [(int(np.argmin(((p - b) ** 2).sum(axis=1))), float(np.sqrt(((p - b) ** 2).sum(axis=1).min()))) for p in a]
    got = {r.point_id: (r.source_id, r.distance) for r in df.collect()}
    assert len(got) == 2000 and all(got[n][0] == w[0] and abs(got[n][1] - w[1]) < 1e-9 for n, w in enumerate(want))


def test_neighbours_of_uneven_clouds(spark):
    """Clusters, copies of one place, points far outside the sources, and rows without a coordinate, against all pairs."""
    draws = np.random.default_rng(6)
    xyz = np.concatenate([draws.normal(size=(60, 3)), draws.normal(size=(60, 3)) * 1e-4 + 3, np.repeat([[1.0, 2.0, 3.0]], 40, axis=0), [[1e6, 0, 0], [-50, 40, 1]]])
    df = cloud_of(spark, xyz).unionAll(spark.createDataFrame([(1, 900, None, 1.0, 1.0), (1, 901, float("nan"), 1.0, 1.0), (2, 5, 1.0, 1.0, 1.0)], "scene_id long, point_id long, x double, y double, z double"))
    got = {}
    for r in spatial.knn(df, 5).collect():
        got.setdefault(r.point_id, {})[r["rank"]] = r.neighbour
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
    for n in range(len(xyz)):
        order = [int(m) for m in np.lexsort((np.arange(len(xyz)), d2[n])) if m != n][:5]
        assert [got[n][k] for k in range(1, 6)] == order
    assert len(got) == len(xyz)


def test_points_within_reach_meet_near_ones_only(spark):
    """many points closer together than the radius."""
    xyz = np.random.default_rng(7).random((1500, 3))
    b = np.random.default_rng(8).random((1500, 3))
    df = spatial.nearest_within(cloud_of(spark, xyz), cloud_of(spark, b).withColumnRenamed("point_id", "source_id"), 0.5)
    assert most_rows(df) < 100 * 1500
    assert {r.point_id: r.source_id for r in df.collect()} == {n: int(np.argmin(((p - b)[:, :2] ** 2).sum(axis=1))) for n, p in enumerate(xyz)}


def test_rasters_take_more_tasks_for_more_points(spark, monkeypatch):
    """tasks don't grow with the points, and a scene that is too large for one is parted."""
    df = cloud_of(spark, np.random.default_rng(9).random((2000, 3)))
    plain = lambda made: sorted((*r[:-1], round(r[-1], 9)) for r in map(tuple, made.collect()))
    whole, edges = plain(spatial.raster(df, "z", 8).drop("mean")), plain(spatial.sobel(spatial.raster(df, "z", 8), "max"))
    monkeypatch.setattr(spatial, "ROWS", 100)
    assert spatial.raster(df, "z", 8).rdd.getNumPartitions() == 21 and spatial.bev(df, "z", 8).rdd.getNumPartitions() == 21
    monkeypatch.setattr(spatial, "LARGE", 500)
    assert plain(spatial.raster(df, "z", 8).drop("mean")) == whole and plain(spatial.sobel(spatial.raster(df, "z", 8), "max")) == edges


def test_ridges_against_all_pairs(spark):
    """even and clustered seeds, two at one place, and points far away; the pairs don't grow with the square."""
    draws = np.random.default_rng(10)
    for seeds, limit in ((draws.random((1000, 3)), 150), (np.concatenate([draws.random((60, 3)), draws.normal(size=(60, 3)) * 1e-3 + 0.5, [[0.2, 0.2, 0.0], [0.2, 0.2, 1.0]]]), 1000)):
        points = np.concatenate([draws.random((400, 3)), [[30.0, 2.0, 0.0], [0.2, 0.2, 0.0]]])
        df = spatial.ridges(cloud_of(spark, points), cloud_of(spark, seeds).withColumnRenamed("point_id", "seed_id"))
        assert most_rows(df) < limit * len(points)
        got = {r.point_id: (r.seed_id, r.ridge) for r in df.collect()}
        assert len(got) == len(points)
        for n, p in enumerate(points):
            d2 = ((seeds[:, :2] - p[:2]) ** 2).sum(axis=1)
            own = int(np.argmin(d2))
            apart = np.sqrt(((seeds[:, :2] - seeds[own, :2]) ** 2).sum(axis=1))
            assert got[n][0] == own and abs(got[n][1] - ((d2 - d2[own])[apart > 0] / (2 * apart[apart > 0])).min()) < 1e-9


def test_quantiles_are_exact_without_a_task_for_a_group(spark):
    """F16: no aggregate holds all values of a group."""
    draws = np.random.default_rng(11)
    groups = {"a": draws.normal(size=501), "b": draws.integers(0, 5, 200).astype(float), "c": np.array([4.0])}
    df = gap.summary(spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double"), "g", "v")
    assert " percentile(" not in df._jdf.queryExecution().toString()
    for r in df.collect():
        assert r.n == len(groups[r.g]) and np.allclose([r.q05, r.q50, r.q95], np.quantile(groups[r.g], [0.05, 0.5, 0.95]), atol=1e-12)


def test_nearest_sets_equal_sorted_neighbours():
    rng = np.random.default_rng(7)
    for n, k in ((5, 4), (40, 16), (900, 16)):
        xyz = rng.integers(0, 6, (n, 3)).astype(float)  # many ties
        near, far = tiles.neighbour_arrays(xyz, k)
        got, last = tiles.nearest_sets(xyz, k)
        assert (np.sort(got) == np.sort(near)).all() and (last == far[:, -1]).all()
        assert (tiles.nearest_sets(xyz, k, np.array([n - 1, 0]))[0] == got[[n - 1, 0]]).all()


def test_small_scenes_are_looked_at_whole(spark):
    """Scenes of TILE points at most cost no tree and no group of their own; they may lie across batches, beside a large scene, and keep columns."""
    rng = np.random.default_rng(5)
    rows = [(s, k, *map(float, rng.normal(0, 1, 3)), f"{s}/{k}") for s, n in enumerate((1, 3, 4, 17, 60, 250, 33)) for k in range(n)]
    df = spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double, z double, name string").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        found = tiles.local_geometry(df, keep=("name",))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan and plan.count("Exchange") == 1
        for got in (found, tiles.local_geometry(df, tile=100, keep=("name",))):
            got = {(r.scene_id, r.point_id): r for r in got.collect()}
            assert len(got) == len(rows) and all(r.name == f"{r.scene_id}/{r.point_id}" for r in got.values())
            for s in range(7):
                want = tiles.surface_arrays(np.array([r[2:5] for r in rows if r[0] == s]))
                for c in tiles.GEOMETRY:
                    assert np.allclose([got[s, k][c] for k in range(len(want[c]))], want[c], atol=1e-9)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_first_draws_hold_the_lowest(spark, monkeypatch):
    """Few rows are put in order; a side with fewer rows than asked for is whole; a limit that was too low is raised."""
    rows = spark.range(20_000).selectExpr("id key", "if(id < 30, 'b', 'a') side", "id * 1.0D v")
    wanted = sorted((r.side, r.key) for r in rows.withColumn("d", gap.draw(42, F.col("side"), F.col("key"))).selectExpr("*", "row_number() over (partition by side order by d, key) r").where("r <= 100").collect())
    low = gap.first_draws(rows, 100, "key", "side", 42)
    assert 130 <= low.count() < 1000
    for margin in (gap.MARGIN, 0):
        monkeypatch.setattr(gap, "MARGIN", margin)
        assert sorted((r.side, r.key) for r in gap.capped(rows, 100, "key").collect()) == wanted and len(wanted) == 130
    # points that lack a descriptor don't count
    long = rows.selectExpr("side", "key", "explode(if(key % 10 = 0, array('u', 'w'), array('u'))) descriptor", "v")
    both = lambda df: df.groupBy("side", "key").count().where("count = 2")
    low = gap.first_draws(long, 100, "key", "side", 42, {"a": 19_970, "b": 30}, both)
    assert both(low).where("side = 'a'").count() >= 100 and low.count() < 10_000


def test_pairs_of_points_and_curves_are_not_shuffled(spark):
    curves = spark.range(3).selectExpr("1L scene_id", "id curve_id", *(f"{k}.0D {a}{k}" for a in "xy" for k in range(4)))
    cloud = spark.range(50).selectExpr("1L scene_id", "id point_id", "id * 0.05D x", "id * 0.05D y")
    plan = cracks.along(cloud, cracks.segments(curves, 4), 0.1)._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("SortMergeJoin")]
    assert "Aggregate" in top and "Exchange" not in top


# --- findings of round 4 ----------------------------------------------------------------------


def test_cells_of_many_pairs_are_parted(spark, monkeypatch):
    """tasks of points and curves take a bounded number of pairs; more shares and tasks give the same rows."""
    rng = np.random.default_rng(3)
    controls = [f"{a}{k}" for a in "xy" for k in range(4)]
    curves = spark.createDataFrame([(1, c, *map(float, rng.normal(0, 0.1, 8))) for c in range(30)], ["scene_id", "curve_id", *controls])
    cloud = spark.createDataFrame([(1, p, *map(float, rng.normal(0, 0.1, 2))) for p in range(200)], "scene_id long, point_id long, x double, y double")
    lines = cracks.segments(curves, 8)
    take = lambda df: sorted((r.point_id, r.curve_id, r.k, round(r.distance, 12), round(r.t, 9)) for r in df.collect())
    want = take(cracks.along(cloud, lines, 0.06))
    monkeypatch.setattr(cracks, "PAIRS", 100)
    found = cracks.along(cloud, lines, 0.06)
    assert found.rdd.getNumPartitions() > 30 and take(found) == want and len(want) > 300


def test_scenes_are_made_as_arrays(spark):
    """every damage, alone and with others, by arrays and by columns over points; no point is a row before the sample."""
    tasks = spark.createDataFrame([(k, k, ) for k in range(1, 38)] + [(10**12 + k, None) for k in range(6)], "scene_id long, target_label int")
    take = lambda df: sorted((r.scene_id, r.point_id, r.target_label or 0, r.pavement, r.label, *(round(r[c], 8) for c in ("x", "y", "z", "intensity"))) for r in df.collect())
    for beside in (0, 2):
        started = tiles.dealt(scenes.planned(tasks, 2.4, 2.4, beside=beside), 43 * 900, "scene_id").cache()
        maker = lambda: scenes.scene_arrays.Scenes(2.4, 2.4, 0.08, None, 0.002, 0.02, 0.03, 0.5, "B", 42, 0.05, scenes.RAVELLED, scenes.CRACKS)
        made = synthesis.micro_texture(synthesis.surface(started, 2.4, 2.4, 0.08, "B"))
        want = take(scenes._whole(made, 2.4, 2.4, 0.08, 0.002, 0.02, 0.03, 0.5, 0.05, 42))
        assert take(scenes._made(started, maker, False)) == want and len({r[4] for r in want}) == 38 and len(want) > 30_000
    plan = scenes.generate(tasks, points=500, **SIDE)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Exchange" not in plan[: plan.index("MapInArrow")]
