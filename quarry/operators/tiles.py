"""Local surfaces of scenes of any size, by tiles.

Scenes of TILE points at most are looked at as a whole, many in a task.  The box of a larger one is halved along each axis until a tile holds at most TILE points, so a scene, however large
or uneven, is never in one task, and a stray return only makes the tree deeper.  The neighbours of a point are looked for
in its own tile first, in NumPy.  They are certain if the k-th is nearer than the tile's faces.  The others'
k-th distance is a bound: these points, with what they found, visit the tiles that the bound reaches, found by an
equi-join of cells as wide as the bound, and the nearest of all are kept.

Neighbours depend on a point's place alone, so equal places are looked up once, and of the points of a
place only the k + 1 with the smallest ids are looked at: no more of them can be neighbours of anything.

Edge cases: rows with a null or non-finite coordinate, or without a scene or point id, take no part and have no row; ties go to the smaller
id; repeated rows are points of their own; a scene of fewer than four points is flat, with its normal up; an
empty table gives an empty one; further columns are ignored but for those to keep.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_finite
from ..functions.settle import kept

#: Points of a tile, at most (but for those that DEPTH halvings don't part).
TILE = 2048
#: Points of a task where scenes are looked at as a whole.
ROWS = 200_000
#: Halvings of a scene's box at most, and how many are counted in one pass.
DEPTH, PASS = 24, 8

AXES = ("x", "y", "z")
GEOMETRY = ("curvature", "nx", "ny", "nz", "residual", "radius", "density")
NEAR = "array<struct<d2:double,id:long,x:double,y:double,z:double>>"


def neighbour_arrays(xyz: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of the k nearest other points of each point, in blocks of rows; ties to the lower place."""
    n = len(xyz)
    k = min(k, n - 1)
    near, far = np.empty((n, k), np.int64), np.empty((n, k))
    rows = max(1, 4_000_000 // max(n, 1))
    for at in range(0, n, rows):
        block = xyz[at : at + rows]
        d2 = sum((block[:, a, None] - xyz[None, :, a]) ** 2 for a in range(3))
        d2[np.arange(len(block)), np.arange(at, at + len(block))] = np.inf
        last = np.partition(d2, k - 1, axis=1)[:, k - 1]
        row, place = np.nonzero(d2 <= last[:, None])  # k a row, more with ties
        order = np.lexsort((place, d2[row, place], row))
        chosen = order[np.searchsorted(row, np.arange(len(block)))[:, None] + np.arange(k)]
        near[at : at + rows] = place[chosen]
        far[at : at + rows] = d2[row[chosen], place[chosen]]
    return near, far


def nearest_sets(xyz: np.ndarray, k: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k nearest other points of the points asked for (all), in no order, and the squared distance of the last; ties to the lower place.

    k is less than the number of points.  Blocks of rows stay in the processor's cache.
    """
    n = len(xyz)
    asked = np.arange(n) if asked is None else asked
    near, last = np.empty((len(asked), k), np.int64), np.empty(len(asked))
    rows = max(1, 32_768 // n)
    held, part = np.empty((rows, n)), np.empty((rows, n))
    axes = np.ascontiguousarray(xyz.T)
    for at in range(0, len(asked), rows):
        own = asked[at : at + rows]
        d2, more = held[: len(own)], part[: len(own)]
        for i, a in enumerate(axes):
            np.subtract(a[own, None], a[None], out=more if i else d2)
            np.multiply(more if i else d2, more if i else d2, out=more if i else d2)
            if i:
                d2 += more
        d2[np.arange(len(own)), own] = np.inf
        np.copyto(more, d2)
        more.partition(k - 1, axis=1)
        far = more[:, k - 1]
        place = np.flatnonzero(d2 <= far[:, None])
        if len(place) > k * len(own):  # ties
            row = place // n
            order = np.lexsort((place, d2.ravel()[place], row))
            place = place[order[np.searchsorted(row, np.arange(len(own)))[:, None] + np.arange(k)]]
        near[at : at + rows] = place.reshape(len(own), k) - n * np.arange(len(own))[:, None]
        last[at : at + rows] = far
    return near, last


def surfaces(xyz: np.ndarray, near: np.ndarray, last: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of GEOMETRY for points (n, 3), their neighbours (n, k, 3) and the last neighbour's squared distance."""
    n, k = near.shape[:2]
    centre = np.stack([near[:, :, i].mean(axis=1) for i in range(3)], axis=1)
    off = [np.ascontiguousarray(near[:, :, i]) - centre[:, i, None] for i in range(3)]
    spread = np.empty((n, 3, 3))
    for i in range(3):
        for j in range(i, 3):
            spread[:, i, j] = spread[:, j, i] = np.einsum("nk,nk->n", off[i], off[j])
    values, vectors = np.linalg.eigh(spread / max(k - 1, 1))
    normal = vectors[:, :, 0]
    normal = np.where(normal[:, 2:] < 0, -normal, normal)
    radius = np.maximum(np.sqrt(last), 1e-6)
    return {
        "curvature": np.clip(values[:, 0] / np.maximum(values.sum(axis=1), 1e-12), 0, 1), "nx": normal[:, 0], "ny": normal[:, 1], "nz": normal[:, 2],
        "residual": ((xyz - centre) * normal).sum(axis=1), "radius": radius, "density": k / (np.pi * radius**2),
    }


def nearest_places(asked: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each asked point's nearest source, the first at ties, and its distance; blocks stay in the processor's cache."""
    source, distance, axes = np.empty(len(asked), np.int64), np.empty(len(asked)), np.ascontiguousarray(sources.T)
    rows = max(1, 32_768 // len(sources))
    for at in range(0, len(asked), rows):
        own = asked[at : at + rows]
        d2 = sum((own[:, i, None] - axes[i]) ** 2 for i in range(3))
        source[at : at + rows] = near = d2.argmin(axis=1)
        distance[at : at + rows] = np.sqrt(d2[np.arange(len(own)), near])
    return source, distance


def spread(xyz: np.ndarray, label: np.ndarray, ravelled: tuple[int, ...], reach: float) -> None:
    """Background within reach of a ravelled point takes the nearest one's label, in place."""
    source, plain = np.flatnonzero(np.isin(label, ravelled)), np.flatnonzero(label == 0)
    if len(source) and len(plain):
        d2 = (xyz[plain, None, 0] - xyz[None, source, 0]) ** 2 + (xyz[plain, None, 1] - xyz[None, source, 1]) ** 2
        near = d2.argmin(axis=1)  # the first: the smaller id
        close = d2[np.arange(len(plain)), near] <= reach * reach
        label[plain[close]] = label[source[near[close]]]


def mixed(xyz: np.ndarray, drawn: np.ndarray, curved: float) -> np.ndarray:
    """The points, those drawn whose surface is curved as the mean of their five nearest."""
    out = xyz.copy()
    if len(xyz) > 2 and len(drawn):
        near, last = nearest_sets(xyz, min(20, len(xyz) - 1), drawn)
        drawn = drawn[surfaces(xyz[drawn], xyz[near], last)["curvature"] > curved]
        if len(drawn):
            out[drawn] = xyz[nearest_sets(xyz, min(5, len(xyz) - 1), drawn)[0]].mean(axis=1)
    return out


def surface_arrays(xyz: np.ndarray, k: int = 16) -> dict[str, np.ndarray]:
    """The columns of GEOMETRY for all points of a scene; with fewer than four everything is neutral."""
    n = len(xyz)
    if k < 3:
        raise ValueError("local geometry needs at least three neighbours")
    if n < 4:
        return {"curvature": np.zeros(n), "nx": np.zeros(n), "ny": np.zeros(n), "nz": np.ones(n), "residual": np.zeros(n), "radius": np.full(n, 1e-6), "density": np.zeros(n)}
    near, last = nearest_sets(xyz, min(k, n - 1))
    return surfaces(xyz, xyz[near], last)


def dealt(rows: DataFrame, n: int, scene: str, *order: str) -> DataFrame:
    """n rows dealt out by scene to as many partitions as n asks for, so that a task doesn't grow with the input; the rows of a scene stand together."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // ROWS + 1)
    return rows.repartition(parts, scene).sortWithinPartitions(scene, *order)


def whole_scenes(batches: Iterable[pa.RecordBatch], scene: str) -> Iterator[pa.Table]:
    """The batches of a partition, whose scenes stand together, cut anew: no scene is parted."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        ids = table[scene].to_numpy()
        first = int(np.argmax(ids == ids[-1]))
        if first:
            yield table.slice(0, first).combine_chunks()
        held = table.slice(first)
    if held is not None:
        yield held.combine_chunks()


def scene_slices(ids: np.ndarray) -> list[slice]:
    """Where each scene's rows stand."""
    cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
    return [slice(a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)])]


def _geometry_of_scenes(rows: DataFrame, n: int, k: int, keep: tuple[str, ...]) -> DataFrame:
    """scene, id, GEOMETRY and the columns to keep of scenes that are small enough to be looked at as a whole."""
    columns = ("scene", "id", *keep)

    def each(batches):
        for table in whole_scenes(batches, "scene"):
            xyz = np.stack([table[a].to_numpy() for a in AXES], axis=1)
            out = {c: np.empty(len(xyz)) for c in GEOMETRY}
            for s in scene_slices(table["scene"].to_numpy()):
                for c, v in surface_arrays(xyz[s], k).items():
                    out[c][s] = v
            made = pa.table({c: table[c] for c in columns} | {c: pa.array(v) for c, v in out.items()})
            yield from made.to_batches()

    schema = T.StructType([rows.schema[c] for c in columns] + [T.StructField(c, T.DoubleType()) for c in GEOMETRY])
    return dealt(rows, n, "scene", "id").mapInArrow(each, schema)


def _cell(value: Column, axis: str) -> Column:
    """The cell of a coordinate after DEPTH halvings of its scene's box; ascends with the coordinate."""
    return F.greatest(F.lit(0), F.least(F.lit((1 << DEPTH) - 1), F.floor((value - F.col(f"lo_{axis}")) / F.col("span") * float(1 << DEPTH)))).cast("int")


def _ancestor(cell: Column, depth: Column) -> Column:
    return F.call_function("shiftright", cell, (F.lit(DEPTH) - depth).cast("int"))


def nodes(placed: DataFrame, tile: int = TILE) -> DataFrame:
    """scene, depth, cells c_x, c_y, c_z, n and the box of the points of each tile, from rows with scene, x, y, z, their cells at DEPTH (f_x, ...) and total, the scene's points.

    Each pass counts PASS depths of the tiles that are still too full.
    """
    key = ["scene", "depth", "c_x", "c_y", "c_z"]
    found, open_, first = [], placed, 0
    while True:
        last = min(first + PASS - 1, DEPTH)
        depths = F.when(F.col("total") <= tile, F.array(F.lit(0))).otherwise(F.sequence(F.lit(first), F.lit(last)))
        each = open_.select("scene", *AXES, *(f"f_{a}" for a in AXES), F.explode(depths).alias("depth")).withColumns({f"c_{a}": _ancestor(F.col(f"f_{a}"), F.col("depth")) for a in AXES})
        counted = kept(each.groupBy(*key).agg(F.count("*").alias("n"), *(f(a).alias(f"{name}_{a}") for a in AXES for name, f in (("min", F.min), ("max", F.max)))))
        found.append(counted)
        full = counted.where((F.col("depth") == last) & (F.col("n") > tile))
        if last == DEPTH or full.isEmpty():
            break
        cut = full.select("scene", *(F.col(f"c_{a}").alias(f"f{a}") for a in AXES))
        on = (open_["scene"] == cut["scene"]) & reduce(Column.__and__, [_ancestor(open_[f"f_{a}"], F.lit(last)) == cut[f"f{a}"] for a in AXES])
        open_ = open_.join(cut, on, "left_semi")
        first = last + 1
    counts = reduce(DataFrame.union, found)
    # a tile is a node that is not too full under one that is
    above = counts.where(F.col("n") > tile).select("scene", (F.col("depth") + 1).alias("depth"), *(F.col(f"c_{a}").alias(f"p_{a}") for a in AXES))
    small = counts.where((F.col("n") <= tile) | (F.col("depth") == DEPTH)).withColumns({f"p_{a}": F.call_function("shiftright", F.col(f"c_{a}"), F.lit(1)) for a in AXES})
    under = small.where("depth > 0").join(above, ["scene", "depth", *(f"p_{a}" for a in AXES)], "left_semi")
    return small.where("depth = 0").unionByName(under).drop(*(f"p_{a}" for a in AXES))


def local_geometry(points: DataFrame, k: int = 16, scene: str = "scene_id", point: str = "point_id", tile: int = TILE, keep: tuple[str, ...] = ()) -> DataFrame:
    """scene, point, the columns of GEOMETRY, from the k nearest other points of the scene of each point, and the points' columns to keep."""
    if k < 3:
        raise ValueError("local geometry needs at least three neighbours")
    tile = max(tile, k + 1)
    kept_as = tuple(f"keep_{i}" for i in range(len(keep)))
    clean = points.select(F.col(scene).cast("long").alias("scene"), F.col(point).cast("long").alias("id"), *((F.col(a).cast("double") + 0.0).alias(a) for a in AXES), *(F.col(c).alias(n) for c, n in zip(keep, kept_as)))
    clean = clean.where(F.col("scene").isNotNull() & F.col("id").isNotNull() & reduce(Column.__and__, [is_finite(a) for a in AXES]))
    clean = kept(clean)
    extent = F.greatest(*(F.max(a) - F.min(a) for a in AXES))
    box = clean.groupBy("scene").agg(F.count("*").alias("total"), *(F.min(a).alias(f"lo_{a}") for a in AXES), F.when(extent > 0, extent).otherwise(1.0).alias("span"))
    box = kept(box)
    finished = lambda rows: rows.select(F.col("scene").alias(scene), F.col("id").alias(point), *GEOMETRY, *(F.col(n).alias(c) for c, n in zip(keep, kept_as)))
    most, few = box.agg(F.max("total"), F.sum(F.when(F.col("total") <= tile, F.col("total")))).first()
    large = box.where(F.col("total") > tile)
    if (most or 0) <= tile:
        return finished(_geometry_of_scenes(clean, few or 0, k, kept_as))
    whole = _geometry_of_scenes(clean.join(large.select("scene"), "scene", "left_anti"), few or 0, k, kept_as)
    parted = clean.join(large.select("scene"), "scene", "left_semi")
    return finished(whole).union(finished(_geometry_of_tiles(parted, large, k, tile)))


def _geometry_of_tiles(clean: DataFrame, box: DataFrame, k: int, tile: int) -> DataFrame:
    """The rows of scenes of more than `tile` points, whose sizes and boxes are given, with GEOMETRY."""
    rank = F.row_number().over(Window.partitionBy("scene", *AXES).orderBy("id"))
    looked_at = clean.withColumn("r", rank).where(F.col("r") <= k + 1)
    placed = looked_at.join(box, "scene").select("scene", "id", "r", *AXES, *(_cell(F.col(a), a).alias(f"f_{a}") for a in AXES), "total")
    placed = kept(placed)
    leaves = kept(nodes(placed, tile))
    key = ["scene", "depth", "c_x", "c_y", "c_z"]
    depths = leaves.groupBy("scene").agg(F.collect_set("depth").alias("depths"), F.min("depth").alias("least"))  # DEPTH + 1 numbers at most
    sent = placed.join(depths.select("scene", "depths"), "scene").withColumn("depth", F.explode("depths"))
    sent = sent.withColumns({f"c_{a}": _ancestor(F.col(f"f_{a}"), F.col("depth")) for a in AXES}).select(*key, "id", "r", *AXES)
    own = sent.join(leaves.select(*key), key)
    inside = own.join(box, "scene")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        xyz, ids = frame[list(AXES)].to_numpy(float), frame["id"].to_numpy()
        asked = np.flatnonzero(frame["r"].to_numpy() == 1)
        head = frame.iloc[0]
        depth = int(head["depth"])
        out = {c: np.repeat(head[c], len(asked)) for c in key} | {"id": ids[asked]} | {a: xyz[asked, i] for i, a in enumerate(AXES)}
        near, d2 = neighbour_arrays(xyz, k) if len(xyz) > 1 else (np.empty((1, 0), np.int64), np.empty((1, 0)))
        near, d2 = near[asked], d2[asked]
        # how far a point is from the tile's faces; no point of the scene lies beyond its box
        free = np.full(len(asked), np.inf)
        width = head["span"] / (1 << depth)
        for i, a in enumerate(AXES):
            low = head[f"lo_{a}"] + head[f"c_{a}"] * width
            if head[f"c_{a}"] > 0:
                free = np.minimum(free, xyz[asked, i] - low)
            if head[f"c_{a}"] < (1 << depth) - 1:
                free = np.minimum(free, low + width - xyz[asked, i])
        last = d2[:, -1] if near.shape[1] else np.full(len(asked), np.inf)
        sure = np.isinf(free) | ((near.shape[1] == k) & (np.sqrt(last) < free - 1e-9 * head["span"]))
        found = {c: np.full(len(asked), np.nan) for c in GEOMETRY}
        if sure.any():
            each = surface_arrays(xyz, k) if len(xyz) < 4 else surfaces(xyz[asked[sure]], xyz[near[sure]], last[sure])
            for c in GEOMETRY:
                found[c][sure] = each[c][asked] if len(xyz) < 4 else each[c]
        lists = [None] * len(asked)
        for at in np.flatnonzero(~sure).tolist():
            lists[at] = [{"d2": d, "id": int(ids[j]), "x": xyz[j, 0], "y": xyz[j, 1], "z": xyz[j, 2]} for d, j in zip(d2[at].tolist(), near[at].tolist())]
        return pd.DataFrame(out | found | {"near": lists})

    columns = ", ".join(f"{c} double" for c in (*AXES, *GEOMETRY))
    first = kept(inside.groupBy(*key).applyInPandas(one, f"scene long, depth int, c_x int, c_y int, c_z int, id long, {columns}, near {NEAR}"))

    # the others visit the tiles that their bound reaches; a tile lies under one with more than k points, so its width bounds what found fewer
    open_ = first.where(F.col("near").isNotNull()).select(*key, "id", *AXES, "near").join(box.drop("total"), "scene").join(depths.select("scene", "least"), "scene")
    bound = F.when(F.size("near") == k, F.sqrt(F.get("near", F.lit(k - 1))["d2"])).otherwise(F.col("span") / F.pow(F.lit(2.0), F.col("depth") - 1) * math.sqrt(3.0))
    reach = bound * (1 + 1e-9) + F.col("span") * 1e-9
    open_ = open_.withColumn("reach", reach)
    open_ = open_.withColumn("at", F.greatest(F.lit(0), F.least(F.lit(DEPTH), F.floor(F.log2(F.col("span") / (2.0 * F.col("reach")))))).cast("int"))
    touched = open_
    for a in AXES:
        ends = [_ancestor(_cell(F.col(a) + s * F.col("reach"), a), F.col("at")) for s in (-1, 1)]
        touched = touched.withColumn(f"t_{a}", F.explode(F.sequence(*ends)))
    # tiles at least as deep as the cells stand under their ancestor there, wider ones under their own cell
    levels = F.when(F.col("least") > F.col("at"), F.array(F.col("at"))).otherwise(F.sequence("least", "at"))
    touched = touched.withColumn("level", F.explode(levels)).withColumn("wide", F.col("level") < F.col("at"))
    up = lambda c: F.call_function("shiftright", F.col(c), (F.col("at") - F.col("level")).cast("int"))
    touched = touched.withColumns({f"t_{a}": up(f"t_{a}") for a in AXES})
    asked = touched.select("scene", "id", *AXES, "reach", "level", "wide", *(f"t_{a}" for a in AXES), *(F.col(c).alias(f"own_{c}") for c in key[1:])).distinct()
    tiles = leaves.select(*key, *(f"{e}_{a}" for a in AXES for e in ("min", "max")))
    above = tiles.withColumn("place", F.explode(F.concat(F.transform(F.sequence(F.lit(0), F.col("depth")), lambda d: F.struct(d.alias("level"), F.lit(False).alias("wide"))), F.array(F.struct(F.col("depth").alias("level"), F.lit(True).alias("wide"))))))
    above = above.select("*", "place.level", "place.wide").withColumns({f"t_{a}": F.call_function("shiftright", F.col(f"c_{a}"), (F.col("depth") - F.col("level")).cast("int")) for a in AXES}).drop("place")
    gap = lambda a: F.greatest(F.lit(0.0), F.col(f"min_{a}") - F.col(a), F.col(a) - F.col(f"max_{a}"))
    away = sum((gap(a) * gap(a) for a in AXES), F.lit(0.0))
    others = ~reduce(Column.__and__, [F.col(c) == F.col(f"own_{c}") for c in key[1:]])
    visits = asked.join(above, ["scene", "level", "wide", *(f"t_{a}" for a in AXES)]).where(others & (away <= F.col("reach") * F.col("reach")))
    visits = visits.select(*key, F.col("id").alias("q"), "reach", *(F.col(a).alias(f"q_{a}") for a in AXES))
    d2 = sum(((F.col(f"q_{a}") - F.col(a)) * (F.col(f"q_{a}") - F.col(a)) for a in AXES), F.lit(0.0))
    seen = visits.join(own, key).withColumn("d2", d2).where(F.col("d2") <= F.col("reach") * F.col("reach"))
    seen = seen.select("scene", "q", "d2", "id", *AXES).union(open_.select("scene", F.col("id").alias("q"), F.explode("near").alias("s")).select("scene", "q", "s.d2", "s.id", *(f"s.{a}" for a in AXES)))
    best = seen.withColumn("p", F.row_number().over(Window.partitionBy("scene", "q").orderBy("d2", "id"))).where(F.col("p") <= k)
    best = best.groupBy("scene", "q").agg(F.array_sort(F.collect_list(F.struct("d2", "id", *AXES))).alias("near"))  # k
    last = open_.select("scene", F.col("id").alias("q"), *AXES).join(best, ["scene", "q"])

    def finish(frames):
        for frame in frames:
            if len(frame):
                near = np.array([[[s[a] for a in AXES] for s in row] for row in frame["near"]])
                found = surfaces(frame[list(AXES)].to_numpy(float), near, np.array([row[-1]["d2"] for row in frame["near"]]))
                yield pd.DataFrame({"scene": frame["scene"], **{a: frame[a] for a in AXES}, **found})

    done = last.select("scene", *AXES, "near").mapInPandas(finish, f"scene long, {columns}")
    places = first.where(F.col("near").isNull()).select("scene", *AXES, *GEOMETRY).union(done)
    return clean.join(places, ["scene", *AXES])
