"""Synthetic road scenes as Spark plans.

A scene is a row of a task table (scene_id, target_label).  Its points are exploded from a grid; the
surface, the damage, the reflectance and the scanner are column expressions over them, with
parameters drawn by hashes of the scene.  So a scene is the same however it is partitioned, nothing
is gathered in one task, and only the sampling of points shuffles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..labels import PRIORITY, label_dim
from ..functions.columns import draw
from . import balance, prepare, sampling, shapes

# Roughness classes by their displacement density at n0 = 0.1 / m, times 1e-6 m**3; exponent 2.
ROUGHNESS = {"A": 16.0, "B": 64.0, "C": 256.0, "D": 1024.0, "E": 4096.0}
WAVES = 24


def uniform(name: str, low: float, high: float, seed: int, *keys: Column) -> Column:
    """A number between low and high that the keys and a name determine."""
    return low + (high - low) * (draw(seed, F.lit(name), *keys) + 0.5) / float(1 << 32)


def normal(name: str, seed: int, *keys: Column) -> Column:
    """A standard normal number (Box and Muller)."""
    a, b = uniform(name + "a", 0, 1, seed, *keys), uniform(name + "b", 0, 1, seed, *keys)
    return F.sqrt(-2.0 * F.log(a)) * F.cos(2.0 * math.pi * b)


def tasks(spark: SparkSession, labels: list[int], per_label: int = 1, first_id: int = 0) -> DataFrame:
    n = len(labels)
    listed = F.array(*map(F.lit, labels))
    return spark.range(n * per_label).select((F.col("id") + first_id).alias("scene_id"), F.get(listed, (F.col("id") % n).cast("int")).alias("target_label"))


def wave_sizes(width: float, length: float, step: float, roughness: str = "A") -> list[tuple[float, float]]:
    """Frequency and amplitude of each wave of a rough road: n_k (geometric from 1 / length to the grid's limit) and sqrt(2 G(n_k) dn_k)."""
    low, high = 1.0 / max(width, length), 0.5 / step
    factor = (high / low) ** (1.0 / WAVES)
    each = [low * factor**k for k in range(WAVES)]
    return [(n, math.sqrt(2.0 * ROUGHNESS[roughness] * 1e-6 * (n / 0.1) ** -2 * n * (factor - 1))) for n in each]


def surface(scenes: DataFrame, width: float, length: float, step: float, roughness: str = "A", seed: int = 42) -> DataFrame:
    """The scenes' points on a grid, with heights of a rough road: waves whose power follows the roughness class.

    Wave k has spatial frequency n_k (geometric from 1 / length to the grid's limit), a direction and a
    phase; its amplitude is sqrt(2 G(n_k) dn_k) with G(n) = G0 (n / 0.1)**-2.
    """
    s = F.col("scene_id")
    waves = []
    for k, (n, amplitude) in enumerate(wave_sizes(width, length, step, roughness)):
        angle = uniform(f"angle{k}", 0, math.pi, seed, s)
        waves.append(F.struct((2 * math.pi * n * F.cos(angle)).alias("kx"), (2 * math.pi * n * F.sin(angle)).alias("ky"), uniform(f"phase{k}", 0, 2 * math.pi, seed, s).alias("p"), F.lit(amplitude).alias("a")))
    cols, rows = int(width / step), int(length / step)
    points = scenes.withColumn("__waves", F.array(*waves)).withColumn("point_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols * rows - 1).cast("long"))))
    points = points.withColumns({"x": (F.col("point_id") % cols) * step, "y": F.floor(F.col("point_id") / cols) * step})
    z = F.aggregate("__waves", F.lit(0.0), lambda acc, w: acc + w["a"] * F.cos(w["kx"] * F.col("x") + w["ky"] * F.col("y") + w["p"]))
    return points.withColumn("z", z).drop("__waves")


def micro_texture(points: DataFrame, amplitude: float = 0.001, hurst: float = 0.7, octaves: int = 4, seed: int = 42) -> DataFrame:
    """Heavy-tailed height noise for each point: alpha-stable draws (Chambers, Mallows and Stuck), clipped at 5, over octaves."""
    alpha = min(max(2 * hurst, 0.1), 1.9)
    total = F.lit(0.0)
    for k in range(octaves):
        v = uniform(f"v{k}", -math.pi / 2, math.pi / 2, seed, F.col("scene_id"), F.col("point_id"))
        w = -F.log(uniform(f"w{k}", 0, 1, seed, F.col("scene_id"), F.col("point_id")))
        x = F.sin(alpha * v) / F.pow(F.cos(v), F.lit(1 / alpha)) * F.pow(F.cos((1 - alpha) * v) / w, F.lit((1 - alpha) / alpha))
        total = total + 2.0 ** (-k * hurst) * F.least(F.greatest(x, F.lit(-5.0)), F.lit(5.0))
    return points.withColumn("z", F.col("z") + amplitude * total)


def shapes_of(severe: Column, cx: Column, cy: Column, angle: Column, z: Column | str, width: float, length: float, step: float, seed: int) -> dict[tuple[str, str | None], shapes.Shape]:
    """Height change and place of the label of each (disease, variant) at x and y; z is the height that the damage meets."""
    s = F.col("scene_id")
    pick = lambda light, heavy: F.when(severe, heavy).otherwise(light)
    slab_w, slab_l = width / 2, length / 2
    joint = max(0.008, step)
    near = shapes.joint_distance("x", "y", slab_w, slab_l)
    block = pick(0.5, 0.2)
    web = shapes.joint_distance(F.col("x") + F.sin(F.col("y") * 3) * 0.05, F.col("y") + F.sin(F.col("x") * 3) * 0.05, block, block)
    along = F.abs(F.col("x") - cx - 0.05 * F.sin(F.col("y") * 2))
    across = F.abs(F.col("y") - cy - 0.05 * F.sin(F.col("x") * 2))
    hit = lambda name: uniform(name, 0, 1, seed, s, F.col("point_id"))
    inner = F.col("x").between(0.1 * width, 0.9 * width) & F.col("y").between(0.1 * length, 0.9 * length)
    sx, sy = shapes.slab_index("x", "y", slab_w, slab_l)
    one_slab = (sx == 0) & (sy == 0)
    groove = lambda d: shapes.crack_profile(d, pick(0.004, 0.012), pick(0.015, 0.04), 2.0 * step)
    return {
        ("crack", "alligator"): groove(web), ("crack", "block"): groove(web), ("crack", "longitudinal"): groove(along), ("crack", "transverse"): groove(across),
        ("pothole", None): shapes.pothole("x", "y", cx, cy, pick(0.15, 0.30), pick(0.025, 0.10)),
        ("raveling", None): (-0.3 * pick(0.002, 0.005) * (1 + hit("deep")), inner & (hit("gone") < pick(0.15, 0.30))),
        ("depression", None): shapes.depression("x", "y", cx, cy, F.lit(0.35 * width), pick(0.02, 0.06)), ("rutting", None): shapes.rutting("x", "y", width / 2, 0.5 * width, 0.3, pick(0.015, 0.04), length),
        ("corrugation", None): shapes.corrugation("x", "y", 0.6, pick(0.015, 0.035)), ("bleeding", None): shapes.bleeding("x", cx - 0.2, cx + 0.2),
        ("patching", None): shapes.patch("x", "y", z, cx, cy, 0.5, 0.6, 0.1, angle, (0.0, 0.0, 0.0), 0.015, 0.08), ("concrete_damage", "patching"): shapes.patch("x", "y", z, cx, cy, 0.5, 0.6, 0.1, angle, (0.0, 0.0, 0.0), 0.015, 0.08),
        ("concrete_damage", "slab_shatter"): (pick(0.01, 0.03) * (F.floor((F.col("x") + F.col("y")) / 0.4) % 3 - 1), one_slab), ("concrete_damage", "slab_crack"): shapes.slab_crack("x", "y", cx, cy, angle, pick(0.015, 0.04), joint),
        ("concrete_damage", "corner_break"): shapes.corner_break("x", "y", 0.0, 0.0, 0.6, pick(0.015, 0.03), joint), ("concrete_damage", "faulting"): shapes.faulting("x", slab_w, pick(0.008, 0.02), joint),
        ("concrete_damage", "pumping"): shapes.pumping(near, joint), ("concrete_damage", "edge_spall"): (-0.02 * F.exp(-near / joint), (near <= 10 * joint) & (hit("spall") < pick(0.3, 0.6))),
        ("concrete_damage", "joint_damage"): (lambda h: (F.when(hit("fill") < pick(0.4, 0.8), h[0]).otherwise(0.0), h[1] & (hit("fill") < pick(0.4, 0.8))))(shapes.joint_damage(near, 0.01, joint)),
        ("concrete_damage", "pitting"): shapes.pitting("x", "y", cx, cy, 0.15, 0.05), ("concrete_damage", "blowup"): shapes.blow_up("x", "y", slab_w, slab_l, 0.8, 0.06),
        ("concrete_damage", "exposed_aggregate"): (0.003 * normal("grain", seed, s, F.col("point_id")), inner & (hit("bare") < 0.3)),
    }


def chosen(kinds: dict, disease: Column, variant: Column) -> shapes.Shape:
    """The shape of a disease and variant; null and false of none of them count as no change."""
    dz, where = F.lit(0.0), F.lit(False)
    for (name, own), (height, label) in kinds.items():
        fits = (disease == name) & variant.eqNullSafe(own)
        only = name == "raveling" or own in ("slab_shatter", "edge_spall", "exposed_aggregate")
        dz = F.when(fits, F.when(label, height).otherwise(0.0) if only else height).otherwise(dz)
        where = F.when(fits, label).otherwise(where)
    return dz, where


def damage(points: DataFrame, width: float, length: float, step: float, seed: int = 42) -> DataFrame:
    """Applies each scene's target damage: changes z and sets label where it is (0 elsewhere)."""
    spark, s = points.sparkSession, F.col("scene_id")
    recipe = label_dim(spark).select(F.col("label").alias("target_label"), "disease", "severity", "variant")
    rows = points.join(F.broadcast(recipe), "target_label")
    cx, cy = uniform("cx", 0.4 * width, 0.6 * width, seed, s), uniform("cy", 0.4 * length, 0.6 * length, seed, s)
    kinds = shapes_of(F.col("severity") == "severe", cx, cy, uniform("turn", 0, math.pi, seed, s), "z", width, length, step, seed)
    dz, where = chosen(kinds, F.col("disease"), F.col("variant"))
    return rows.withColumns({"z": F.col("z") + dz, "label": F.when(where, F.col("target_label")).otherwise(0).cast("int")}).drop("disease", "severity", "variant")


def merged_label(old: Column, new: Column) -> Column:
    """The label of higher priority; at a tie the new one."""
    rank = F.array(*map(F.lit, PRIORITY))
    return F.when(F.get(rank, old) > F.get(rank, new), old).otherwise(new)


def reflect(points: DataFrame, seed: int = 42, concrete: Column | None = None) -> DataFrame:
    """Adds intensity: a base of the pavement with noise, shifted by the label."""
    concrete = F.col("target_label") > 20 if concrete is None else concrete
    base = F.when(concrete, uniform("base", 0.30, 0.50, seed, F.col("scene_id"))).otherwise(uniform("base", 0.10, 0.25, seed, F.col("scene_id")))
    return points.withColumn("intensity", shapes.reflectance(base + 0.02 * normal("shade", seed, F.col("scene_id"), F.col("point_id")), "label"))


def scan(points: DataFrame, sigma: float = 0.002, rate: float = 0.03, reach: float = 10.0, seed: int = 42) -> DataFrame:
    """A scanner's noise in range, and lost returns."""
    r, a, e = prepare.spherical(F.col("x"), F.col("y"), F.col("z"))
    keys = (F.col("scene_id"), F.col("point_id"))
    noisy = F.greatest(r + sigma * normal("range", seed, *keys), F.lit(0.0))
    x, y, z = prepare.cartesian(noisy, a, e)
    kept = points.where(uniform("lost", 0, 1, seed, *keys) > shapes.dropout(F.least(r / reach, F.lit(1.0)), rate))
    return kept.select(*(c for c in points.columns if c not in "xyz"), x.alias("x"), y.alias("y"), z.alias("z"))


def generate(scenes: DataFrame, width: float = 3.0, length: float = 3.0, step: float = 0.04, points: int = 2048, roughness: str = "A", noise: bool = True, seed: int = 42) -> DataFrame:
    """scene_id, target_label, point_id, x, y, z, label, intensity and the inverse of the unit ball of each point."""
    made = damage(micro_texture(surface(scenes, width, length, step, roughness, seed), seed=seed), width, length, step, seed)
    made = reflect(made, seed)
    if noise:
        made = scan(made, seed=seed)
    sampled = sampling.protected(made, points, F.col("target_label"), seed=seed)
    return prepare.unit_ball(sampled)


def fill_quota(spark: SparkSession, folder: str, labels: list[int], scenes: int, min_points: int, wave: int = 4, attempts: int = 20, **options) -> DataFrame:
    """Generates waves of scenes into folder until every label has its scenes and points, or the attempts end.

    What the folder has counts, and ids go on after its highest; returns the coverage.
    """
    first, tried = 0, dict.fromkeys(labels, 0)
    try:
        have = spark.read.parquet(folder)
        highest = have.agg(F.max("scene_id")).first()[0]
        first = 0 if highest is None else highest + 1
    except Exception as why:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(why):
            raise
        have = None
    while True:
        if have is not None:
            register = have.select("scene_id", "target_label").distinct()
            covered = balance.coverage(have.select("scene_id", "label"), register)
        else:
            covered = spark.createDataFrame([], "label int, scene_count long, instance_count long, point_count long")
        open_ = balance.unmet(covered, labels, scenes, min_points).collect()  # at most 37 rows
        plan = {r.label: max(1, min(wave, scenes - r.scene_count, attempts - tried[r.label])) for r in open_ if tried[r.label] < attempts}
        if not plan:
            return covered
        listed = [k for k, n in plan.items() for _ in range(n)]
        for k, n in plan.items():
            tried[k] += n
        generate(tasks(spark, listed, 1, first), **options).write.mode("append").parquet(folder)
        first += len(listed)
        have = spark.read.parquet(folder)


