"""Whole scenes: several damages, a scanner's lines and noise, labels carried over, voxels.

A scene's damages are an array in the order in which they are applied, and each point folds over it with the state (height, label,
gone): a damage meets the height that those before it left, labels merge by priority, and points that break out are only marked, so that
their label can still spread to their surroundings before they go.  Steps that need neighbours are joins by cells; for scenes of a tile's size
they look at a scene as a whole instead, many scenes in a task, without a shuffle, as a scene's points are made where its row lies.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import draw
from ..functions.settle import kept, settled
from ..labels import APPLY_ORDER, label_dim
from . import prepare, sampling, scene_arrays, shapes, spatial, synthesis, tiles
from .synthesis import merged_label, normal, uniform

#: Share of severe damages among those that are drawn, of concrete among scenes without a target, and labels of ravelling and cracks.
SEVERE, CONCRETE = 0.4, 0.3
RAVELLED, CRACKS = (11, 12), tuple(range(1, 9))
#: With as few points or fewer left, a scene keeps all of them whatever the scan lines see.
FEWEST = 10
#: Scenes whose points stand in memory at once.
SCENES = 16


def planned(tasks: DataFrame, width: float = 3.0, length: float = 3.0, extra: int = 3, beside: int = 0, weights: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """scene_id, target_label, pavement and damages: structs (order, label, disease, severity, variant, cx, cy, angle) in the order of application.

    A scene with a target has it and `beside` other kinds of its pavement (which may hide it); one without draws its pavement and `extra` kinds.
    Kinds are drawn by weight without replacement, severities by share.  Kinds of equal order go by their label; unknown kinds come last.
    """
    s = F.col("scene_id")
    dim = label_dim(tasks.sparkSession).where("label > 0").select("label", F.col("pavement").alias("p"), "disease", "severity", "variant")
    drawn = F.when(uniform("pavement", 0, 1, seed, s) < CONCRETE, "concrete").otherwise("asphalt")
    scenes = tasks.select("scene_id", F.col("target_label").cast("int").alias("target_label")).withColumn("pavement", F.when(F.col("target_label") > 20, "concrete").when(F.col("target_label") > 0, "asphalt").otherwise(drawn))
    rows = scenes.join(F.broadcast(dim), F.col("pavement") == F.col("p"))  # at most 20 rows a scene
    kind = F.concat_ws("/", "disease", "variant")
    severity = F.when(uniform("severity", 0, 1, seed, s, kind) < SEVERE, "severe").otherwise("light")
    own = F.coalesce(F.col("label") == F.col("target_label"), F.lit(False))
    # bleeding is light only
    fits = (F.col("severity") == "-") | (F.col("disease") == "bleeding") | (F.col("severity") == severity)
    same = F.max(F.when(own, kind)).over(Window.partitionBy("scene_id"))
    rows = rows.withColumn("kind", kind).withColumn("same", same).withColumn("own", own.cast("int")).where((F.col("own") == 1) | (fits & ~F.coalesce(F.col("kind") == F.col("same"), F.lit(False))))
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in (weights or {"": 1.0}).items() for x in kv)), F.col("disease")), F.lit(1.0))
    first = -F.log((draw(seed, F.lit("choice"), s, F.col("kind")) + 0.5) / float(1 << 32)) / weight
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("own"), first, "label")))
    kept = ranked.where(F.col("place") <= F.when(F.col("target_label") > 0, 1 + beside).otherwise(extra))
    order = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in APPLY_ORDER.items() for x in kv)), F.col("disease")), F.lit(99))
    part = lambda name, low, high: uniform(name, low, high, seed, s, F.col("kind")).alias(name)
    one = F.struct(order.alias("order"), "label", "disease", "severity", "variant", part("cx", 0.4 * width, 0.6 * width), part("cy", 0.4 * length, 0.6 * length), part("angle", 0, math.pi))
    found = kept.groupBy("scene_id").agg(F.array_sort(F.collect_list(one)).alias("damages"))
    return scenes.join(found, "scene_id", "left")


def applied(points: DataFrame, width: float, length: float, step: float, seed: int = 42) -> DataFrame:
    """Folds each point over its scene's damages: z and label change, and gone tells the points that break out.

    points has label and gone, or starts with label 0 and nothing gone.  The result is kept in the shared folder: the optimiser would
    repeat the fold wherever a later step names the label.
    """
    return settled(_folded(points, width, length, step, seed).withColumns({c: F.col(f"__state.{c}") for c in ("z", "label", "gone")}).drop("__state"))


def _folded(points: DataFrame, width: float, length: float, step: float, seed: int) -> DataFrame:
    """Adds __state: z, label and gone after the scene's damages."""
    if "label" not in points.columns:
        points = points.withColumns({"label": F.lit(0), "gone": F.lit(False)})
    s, point = F.col("scene_id"), F.col("point_id")

    def meet(state, d):
        severe = d["severity"] == "severe"
        kinds = synthesis.shapes_of(severe, d["cx"], d["cy"], d["angle"], state["z"], width, length, step, seed)
        dz, where = synthesis.chosen(kinds, d["disease"], d["variant"])
        there = F.coalesce(where, F.lit(False)) & ~state["gone"]
        # of a ravelled area, a part of the points breaks out
        inner = F.col("x").between(0.1 * width, 0.9 * width) & F.col("y").between(0.1 * length, 0.9 * length)
        out = (d["disease"] == "raveling") & inner & (uniform("out", 0, 1, seed, s, point) < F.when(severe, 0.3).otherwise(0.15))
        label = F.when(there, merged_label(state["label"], d["label"])).otherwise(state["label"])
        return F.struct((state["z"] + dz).alias("z"), label.cast("int").alias("label"), (state["gone"] | out).alias("gone"))

    start = F.struct(F.col("z").cast("double").alias("z"), F.col("label").cast("int").alias("label"), F.col("gone").alias("gone"))
    return points.withColumn("__state", F.aggregate(F.coalesce("damages", F.array().cast(points.schema["damages"].dataType)), start, meet))


def scan_lines(points: DataFrame, spacing: float, decay: float = 0.3, seed: int = 42) -> DataFrame:
    """The points that a scanner's lines, `spacing` apart along y, see; all points of a scene of which they see FEWEST or fewer."""
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    far = points.groupBy("scene_id").agg(F.max(r).alias("__far"))
    rows = points.join(far, "scene_id")
    line = F.abs(F.col("y") - F.floor(F.col("y") / spacing + 0.5) * spacing)
    seen = uniform("line", 0, 1, seed, F.col("scene_id"), F.col("point_id")) < shapes.scan_line_keep("y", line, spacing, F.coalesce(F.try_divide(r, F.col("__far")), F.lit(0.0)), decay)
    rows = rows.withColumn("__seen", seen)
    enough = rows.groupBy("scene_id").agg((F.sum(F.col("__seen").cast("int")) > FEWEST).alias("__enough"))
    return rows.join(enough, "scene_id").where(F.col("__seen") | ~F.col("__enough")).select(*points.columns)


def spread_ravelling(points: DataFrame, reach: float) -> DataFrame:
    """Background within reach of a ravelled point that is still there takes the nearest one's label."""
    ravelled = points.where(~F.col("gone") & F.col("label").isin(*RAVELLED)).select("scene_id", F.col("point_id").alias("source_id"), "x", "y", F.col("label").alias("__near"))
    near = spatial.nearest_within(points.where(~F.col("gone") & (F.col("label") == 0)).select("scene_id", "point_id", "x", "y"), ravelled, reach)
    spread = near.join(ravelled.select("scene_id", "source_id", "__near"), ["scene_id", "source_id"]).select("scene_id", "point_id", "__near")
    return points.join(spread, ["scene_id", "point_id"], "left").withColumn("label", F.coalesce("__near", "label")).select(*points.columns)


def scanned(points: DataFrame, sigma: float = 0.002, jitter: float = 0.02, rate: float = 0.03, mixing: float = 0.1, curved: float = 0.05, seed: int = 42) -> DataFrame:
    """Noise in range and angle (degrees), lost returns, and mixed returns: some points of high curvature become the mean of their neighbours."""
    keys = (F.col("scene_id"), F.col("point_id"))
    if mixing > 0:
        bent = spatial.curvature(points, 20).select("scene_id", "point_id", "curvature")
        points = settled(points.join(bent, ["scene_id", "point_id"], "left"))
        mixed = F.coalesce(F.col("curvature") > curved, F.lit(False)) & (uniform("mixed", 0, 1, seed, *keys) < mixing)
        points = spatial.mix_edges(points, mixed).drop("curvature")
    r, a, e = prepare.spherical(F.col("x"), F.col("y"), F.col("z"))
    turn = math.radians(jitter)
    moved = prepare.cartesian(F.greatest(r + sigma * normal("range", seed, *keys), F.lit(0.0)), a + turn * normal("azimuth", seed, *keys), e + turn * normal("elevation", seed, *keys))
    far = points.groupBy("scene_id").agg(F.max(r).alias("__far"))
    kept = points.join(far, "scene_id").where(uniform("lost", 0, 1, seed, *keys) > shapes.dropout(F.coalesce(F.try_divide(r, F.col("__far")), F.lit(0.0)), rate))
    return kept.select(*(c for c in points.columns if c not in "xyz"), *(v.alias(c) for v, c in zip(moved, "xyz")))


def carried_labels(noisy: DataFrame, before: DataFrame, sigma: float) -> DataFrame:
    """label and intensity of the nearest point before the noise; a crack's label farther than 3 sigma from it becomes background."""
    old = before.select("scene_id", F.col("point_id").alias("source_id"), "x", "y", "z", F.col("label").alias("__label"), F.col("intensity").alias("__intensity"))
    near = spatial.nearest(noisy.select("scene_id", "point_id", "x", "y", "z"), old.select("scene_id", "source_id", "x", "y", "z"))
    found = near.join(old.select("scene_id", "source_id", "__label", "__intensity"), ["scene_id", "source_id"]).select("scene_id", "point_id", "distance", "__label", "__intensity")
    unsure = (F.col("distance") > 3 * sigma) & F.col("__label").isin(*CRACKS) if sigma > 0 else F.lit(False)
    out = noisy.drop("label", "intensity").join(found, ["scene_id", "point_id"])
    return out.withColumns({"label": F.when(unsure, 0).otherwise(F.col("__label")), "intensity": F.col("__intensity")}).drop("distance", "__label", "__intensity")


#: What stays with each point, and its coordinates before and after the mixing of returns.
OWN = ("scene_id", "target_label", "pavement", "point_id")
MIXED = ("mx", "my", "mz")


def _spread_and_mixed(rows: DataFrame, reach: float, curved: float) -> DataFrame:
    """spread_ravelling, points that broke out gone, and the mixed returns of scanned (mx, my, mz; far is the scene's farthest) of whole scenes.

    rows has OWN, x, y, __state and __mix, whether the point is drawn for mixing.  Of curvatures, only those of drawn points are found.
    """

    def each(batches):
        for table in tiles.whole_scenes(batches, "scene_id"):
            state = dict(zip(("z", "label", "gone"), table["__state"].combine_chunks().flatten()))
            xyz = np.stack([table["x"].to_numpy(), table["y"].to_numpy(), state["z"].to_numpy()], axis=1)
            label, there_all, mix = state["label"].to_numpy().copy(), ~state["gone"].to_numpy(zero_copy_only=False), table["__mix"].to_numpy()
            mixed, far = xyz.copy(), np.zeros(len(xyz))
            for s in tiles.scene_slices(table["scene_id"].to_numpy()):
                there = np.flatnonzero(there_all[s]) + s.start
                points, own = xyz[there], label[there]
                tiles.spread(points, own, RAVELLED, reach)
                label[there], mixed[there] = own, tiles.mixed(points, np.flatnonzero(mix[there]), curved)
                if len(there):
                    far[s] = np.sqrt((mixed[there] ** 2).sum(axis=1)).max() + 1e-12
            made = pa.table({c: table[c] for c in (*OWN, "x", "y")} | {"z": state["z"], "label": label, "far": far} | {c: mixed[:, i] for i, c in enumerate(MIXED)})
            yield from made.filter(pa.array(there_all)).to_batches()

    schema = T.StructType([rows.schema[c] for c in (*OWN, "x", "y")] + [T.StructField(c, T.IntegerType() if c == "label" else T.DoubleType()) for c in ("z", "label", "far", *MIXED)])
    return rows.mapInArrow(each, schema)


def _carried_whole(rows: DataFrame, sigma: float) -> DataFrame:
    """carried_labels of whole scenes: OWN, x, y, z, label and intensity of the points that are __kept, at (mx, my, mz)."""

    def each(batches):
        for table in tiles.whole_scenes(batches, "scene_id"):
            before, after = (np.stack([table[c].to_numpy() for c in names], axis=1) for names in ("xyz", MIXED))
            stays, label, intensity = table["__kept"].to_numpy(), table["label"].to_numpy(), table["intensity"].to_numpy()
            source, distance = np.arange(len(before)), np.zeros(len(before))
            for s in tiles.scene_slices(table["scene_id"].to_numpy()):
                asked = np.flatnonzero(stays[s]) + s.start
                near, distance[asked] = tiles.nearest_places(after[asked], before[s])
                source[asked] = near + s.start
            found = label[source]
            if sigma > 0:
                found = np.where((distance > 3 * sigma) & np.isin(found, CRACKS), 0, found).astype(label.dtype)
            made = pa.table({c: table[c] for c in OWN} | {c: after[:, i] for i, c in enumerate("xyz")} | {"label": found, "intensity": intensity[source]})
            yield from made.filter(pa.array(stays)).to_batches()

    return rows.mapInArrow(each, rows.select(*OWN, "x", "y", "z", "label", "intensity").schema)


def _whole(made: DataFrame, width: float, length: float, step: float, sigma: float, jitter: float, rate: float, mixing: float, curved: float, seed: int) -> DataFrame:
    """The steps of generate from the fold to the labels carried over, of scenes of a tile's size whose points stand together, by scene and point."""
    s, keys = F.col("scene_id"), (F.col("scene_id"), F.col("point_id"))
    mix = uniform("mixed", 0, 1, seed, *keys) < mixing if mixing > 0 else F.lit(False)
    rows = _folded(made, width, length, step, seed).select(*OWN, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "__state", mix.alias("__mix"))
    rows = synthesis.reflect(_spread_and_mixed(rows, 3 * step, curved), seed, F.col("pavement") == "concrete")
    r, a, e = prepare.spherical(*(F.col(c) for c in MIXED))
    turn = math.radians(jitter)
    moved = prepare.cartesian(F.greatest(r + sigma * normal("range", seed, *keys), F.lit(0.0)), a + turn * normal("azimuth", seed, *keys), e + turn * normal("elevation", seed, *keys))
    stays = uniform("lost", 0, 1, seed, s, F.col("point_id")) > shapes.dropout(F.coalesce(F.try_divide(r, F.col("far")), F.lit(0.0)), rate)
    rows = rows.select(*OWN, "x", "y", "z", "label", "intensity", *(v.alias(c) for c, v in zip(MIXED, moved)), stays.alias("__kept"))
    return _carried_whole(rows, sigma)


def _made(plan: DataFrame, maker: Callable[[], scene_arrays.Scenes], sampled: bool) -> DataFrame:
    """The scenes of a plan whose rows are dealt out, each made as a whole where its row lies; sampled ones have the inverse of the unit ball."""
    doubles = ("x", "y", "z", "intensity", *(("cx", "cy", "cz", "scale") if sampled else ()))
    order = (*OWN, "x", "y", "z", "label", "intensity", *doubles[4:])
    types = {c: plan.schema[c].dataType for c in OWN[:3]} | {"point_id": T.LongType(), "label": T.IntegerType()} | dict.fromkeys(doubles, T.DoubleType())

    def each(batches):
        scenes = maker()
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for at in range(0, rows.num_rows, SCENES):
                some = rows.slice(at, SCENES)
                made = [scenes.make(*(r[c] for c in (*OWN[:3], "damages"))) for r in some.to_pylist()]
                n = [len(m["point_id"]) for m in made]
                own = some.select(OWN[:3]).take(np.repeat(np.arange(len(n)), n))
                columns = {c: own[c] for c in OWN[:3]} | {c: np.concatenate([m[c] for m in made]) for c in made[0]}
                yield from pa.table({c: columns[c] for c in order}).combine_chunks().to_batches()

    return plan.select(*OWN[:3], "damages").mapInArrow(each, T.StructType([T.StructField(c, types[c]) for c in order]))


def generate(
    tasks: DataFrame, width: float = 3.0, length: float = 3.0, step: float = 0.04, points: int = 2048, extra: int = 3, beside: int = 0, density: float | None = None, spacing: float | None = None,
    sigma: float = 0.002, jitter: float = 0.02, rate: float = 0.03, mixing: float = 0.1, roughness: str = "A", seed: int = 42,
) -> DataFrame:
    """scene_id, target_label, pavement, point_id, x, y, z, label, intensity and the inverse of the unit ball of each point.

    The steps: damages chosen and put in order; rough surface and micro texture; scan lines (with a spacing); the fold over the damages;
    ravelling spreads and points that broke out go; reflectance; noise; labels carried over from before it; means of voxels (with a
    density of points a square metre) or `points` of each scene that keep the target; the unit ball.  Each step that several others use is kept
    in the shared folder.  tasks has scene_id and target_label (null for damages drawn freely).
    """
    plan = settled(planned(tasks, width, length, extra, beside, seed=seed).where("scene_id is not null"))
    grid = int(width / step) * int(length / step)
    whole, curved = grid <= tiles.TILE, 0.05
    most = plan.count() * grid if whole else 0
    # a scene's points are made where its row lies
    started = tiles.dealt(plan, most, "scene_id") if whole else plan
    made = synthesis.micro_texture(synthesis.surface(started, width, length, step, roughness, seed), seed=seed)
    if spacing:
        made = scan_lines(made, spacing, seed=seed)
        made = tiles.dealt(made, most, "scene_id", "point_id") if whole else made
    if whole and not spacing:
        # the steps, sample and unit ball included, over arrays of a scene's points
        options = (width, length, step, None if density else points, sigma, jitter, rate, mixing, roughness, seed, curved, RAVELLED, CRACKS)
        out = _made(started, lambda: scene_arrays.Scenes(*options), not density)
        if not density:
            return out
    elif whole:
        out = _whole(made, width, length, step, sigma, jitter, rate, mixing, curved, seed)
    else:
        made = applied(made, width, length, step, seed).drop("damages")
        before = spread_ravelling(made, 3 * step).where(~F.col("gone")).drop("gone")
        before = settled(synthesis.reflect(before, seed, F.col("pavement") == "concrete"))
        noisy = settled(scanned(before, sigma, jitter, rate, mixing, curved, seed))
        out = carried_labels(noisy, before, sigma)
    if density:
        size = max(math.sqrt(1.0 / density), 1.5 * step)
        one = spatial.voxels(out, size)
        out = one.join(plan.select("scene_id", "target_label", "pavement"), "scene_id").withColumn("point_id", F.col("c_x") * (1 << 20) + F.col("c_y")).drop("c_x", "c_y", "n")
    else:
        out = sampling.protected(out, points, F.col("target_label"), seed=seed)
    return prepare.unit_ball(kept(out))
