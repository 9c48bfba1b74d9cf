"""Queries that write point-cloud files to the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.settle import shared_root
from ..sources import clouds as C
from . import views as V
from .preparation import SMALL, rounded, small
from .registry import query
from .registry import r6 as q6


def fresh_folder(spark, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or on this machine if all tasks run on it."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def scans(spark, folder):
    """The small cloud as scans: labels from 0 to 30, intensities from 0 to 1."""
    return small(spark, folder).withColumns({"label": (F.col("point_id") % 31).cast("int"), "intensity": F.abs(F.col("intensity")) - F.floor(F.abs(F.col("intensity")))})


SCANS = SMALL + """, scans AS (SELECT 'scan_' || lpad(CAST(scene_id AS VARCHAR), 6, '0') AS name, row_number() OVER (PARTITION BY scene_id ORDER BY point_id) - 1 AS point_id, scene_id, x, y, z, nx, ny, nz,
  CAST(point_id % 31 AS INTEGER) AS label, abs(intensity) - floor(abs(intensity)) AS intensity FROM cloud_s)"""
FULL = f"WITH {SCANS} SELECT name, point_id, {', '.join(f'{q6(c)} AS {c}' for c in ('x', 'y', 'z', 'intensity', 'nx', 'ny', 'nz'))}, label FROM scans"


def read_back(spark, folder, ending: str, columns: tuple[str, ...]):
    place = fresh_folder(spark, f"scans{ending[1:]}")
    C.export_clouds(scans(spark, folder), place, ending).collect()  # a row a file
    return rounded(C.read_points(spark, place, f"*{ending}").select("name", "point_id", *columns, "label"), *columns)


@query(FULL)
def scans_npy(spark, folder):
    return read_back(spark, folder, ".npy", ("x", "y", "z", "intensity", "nx", "ny", "nz"))


@query(FULL)
def scans_ply(spark, folder):
    return read_back(spark, folder, ".ply", ("x", "y", "z", "intensity", "nx", "ny", "nz"))


@query(f"WITH {SCANS} SELECT name, point_id, {', '.join(f'{q6(c)} AS {c}' for c in ('x', 'y', 'z', 'intensity'))}, label FROM scans")
def scans_pcd(spark, folder):
    return read_back(spark, folder, ".pcd", ("x", "y", "z", "intensity"))


@query(f"WITH {SCANS} SELECT name, point_id, {', '.join(f'{q6(f"round_even({c} * 1000, 0) * 0.001")} AS {c}' for c in 'xyz')}, round_even(intensity * 65535, 0) AS intensity, label FROM scans")
def scans_las(spark, folder):
    """Places in whole millimetres and intensities in 16 bits."""
    return read_back(spark, folder, ".las", ("x", "y", "z", "intensity"))


@query(f"WITH {SCANS} SELECT 'scene_' || name[6:] AS name, point_id, {', '.join(f'{q6(c)} AS {c}' for c in ('x', 'y', 'z', 'intensity', 'nx', 'ny', 'nz'))}, label FROM scans")
def scenes_npz(spark, folder):
    """Scenes as compressed archives by split, those that are there left as they are, read back as points."""
    place = fresh_folder(spark, "scenes")
    points = scans(spark, folder).withColumns({"split": F.when(F.col("scene_id") % 2 == 0, "train").otherwise("val"), "intensity_n": F.col("intensity"), "curvature": F.lit(0.0), "residual": F.lit(0.0)})
    for again in (False, True):
        if any(r.written == again for r in C.export_npz(points, place).collect()):  # a row a file
            raise C.CloudError("a scene was written twice or not at all")
    columns = ("x", "y", "z", "intensity", "nx", "ny", "nz")
    return rounded(C.read_points(spark, place, "scene_*.npz").select("name", "point_id", *columns, "label"), *columns)


@query(f"WITH {SMALL} SELECT scene_id, point_id, {q6('x')} AS x, CASE WHEN scene_id % 2 = 0 THEN 'train' ELSE 'val' END AS split FROM cloud_s")
def scenes_parquet(spark, folder):
    place = fresh_folder(spark, "scene-table")
    C.write_scenes(small(spark, folder).withColumn("split", F.when(F.col("scene_id") % 2 == 0, "train").otherwise("val")), place)
    return rounded(spark.read.parquet(place).select("scene_id", "point_id", "x", "split"), "x")


UNITS = "CASE WHEN scene_id % 3 = 0 THEN 'mm' WHEN scene_id % 3 = 1 THEN 'm' END"


@query(f"""WITH {SCANS}, kept AS (SELECT *, coalesce({UNITS}, 'm') AS units, CASE WHEN scene_id % 3 = 0 THEN x * 0.001 ELSE x END AS mx, CASE WHEN scene_id % 3 = 0 THEN y * 0.001 ELSE y END AS my, CASE WHEN scene_id % 3 = 0 THEN z * 0.001 ELSE z END AS mz FROM scans)
  SELECT name, point_id, {", ".join(f"{q6(f'm{c}')} AS {c}" for c in "xyz")}, {q6("intensity")} AS intensity, label, units AS coordinate_units FROM kept""")
def real_scan_points(spark, folder):
    """Scans with their sidecar files, where they have one, in metres and with intensities from 0 to 1."""
    place = fresh_folder(spark, "real")
    points = scans(spark, folder)
    C.export_clouds(points, place, ".ply").collect()  # a row a file
    k = F.col("scene_id") % 3
    sidecars = points.select("scene_id").distinct().where(k < 2).select(F.format_string("scan_%06d", "scene_id").alias("name"), F.when(k == 0, "mm").otherwise("m").alias("coordinate_units"), F.lit("normalized").alias("intensity_scale"))
    C.write_sidecars(sidecars, place).collect()
    columns = ("x", "y", "z", "intensity")
    return rounded(C.real_scans(spark, place, "*.ply").select("name", "point_id", *columns, "label", "coordinate_units"), *columns)
