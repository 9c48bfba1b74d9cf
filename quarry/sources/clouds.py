"""Point-cloud files as tables of points.

Files are listed and read by Spark's binaryFile source, so any store that Spark reaches will do, and
are parsed in tasks, one file at a time.  A point's place in its file is its point_id.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Under which names fields are stored, first match first.
LABELS = ("label", "labels", "class", "semantic")
INTENSITIES = ("intensity", "reflectance", "scalar_intensity")
NORMALS = (("nx", "ny", "nz"), ("normal_x", "normal_y", "normal_z"))

SCHEMA = "path string, name string, point_id long, x double, y double, z double, label int, intensity double, nx double, ny double, nz double"
_PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
# Fixed values of the LAS format: byte offsets of optional groups don't matter here, only the least record lengths of point formats.
_LAS_LENGTH = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}


class CloudError(ValueError):
    """A file that isn't the point cloud that its name says."""


def _from_fields(fields: dict[str, np.ndarray], labels: tuple[str, ...] = LABELS) -> dict[str, np.ndarray]:
    missing = {"x", "y", "z"} - set(fields)
    if missing:
        raise CloudError(f"no field {', '.join(sorted(missing))}")
    out = {a: np.asarray(fields[a], float) for a in "xyz"}
    for into, names in (("label", labels), ("intensity", INTENSITIES)):
        found = next((n for n in names if n in fields), None)
        if found:
            out[into] = np.asarray(fields[found])
    for names in NORMALS:
        if set(names) <= set(fields):
            out |= {into: np.asarray(fields[n], float) for into, n in zip(("nx", "ny", "nz"), names)}
            break
    return out


def parse_npy(data: bytes) -> dict[str, np.ndarray]:
    """Named fields, or a matrix: x y z, label, normal (3), intensity."""
    a = np.load(io.BytesIO(data), allow_pickle=False)
    if a.dtype.names:
        return _from_fields({n: a[n] for n in a.dtype.names})
    if a.ndim != 2 or a.shape[1] < 3:
        raise CloudError(f"an array of shape {a.shape} has no x, y and z")
    out = {c: a[:, k].astype(float) for k, c in enumerate("xyz")}
    if a.shape[1] > 3:
        out["label"] = a[:, 3]
    if a.shape[1] > 6:
        out |= {c: a[:, 4 + k].astype(float) for k, c in enumerate(("nx", "ny", "nz"))}
    if a.shape[1] > 7:
        out["intensity"] = a[:, 7].astype(float)
    return out


def parse_npz(data: bytes) -> dict[str, np.ndarray]:
    """A stored scene: points, and labels, feats (intensity first) and normals where there are."""
    with np.load(io.BytesIO(data), allow_pickle=False) as scene:
        if "points" not in scene:
            raise CloudError("a scene without points")
        points = scene["points"]
        out = {c: points[:, k].astype(float) for k, c in enumerate("xyz")}
        if "labels" in scene:
            out["label"] = scene["labels"]
        if "feats" in scene:
            out["intensity"] = scene["feats"][:, 0].astype(float)
        if "normals" in scene:
            out |= {c: scene["normals"][:, k].astype(float) for k, c in enumerate(("nx", "ny", "nz"))}
    return out


def parse_ply(data: bytes) -> dict[str, np.ndarray]:
    """The vertices of an ASCII or binary PLY file, whose vertex element comes first."""
    end = re.search(rb"end_header\r?\n", data)
    if not data.startswith(b"ply") or not end:
        raise CloudError("no PLY header")
    kind, count, names, types, current = "", 0, [], [], None
    for line in data[: end.start()].decode("ascii").splitlines():
        part = line.split()
        if part[:1] == ["format"]:
            kind = part[1]
        elif part[:1] == ["element"]:
            current = part[1]
            if current == "vertex":
                count = int(part[2])
            elif not names:
                raise CloudError("another element stands before the vertices")
        elif part[:1] == ["property"] and current == "vertex":
            if part[1] == "list":
                raise CloudError("vertices with lists")
            names.append(part[2])
            types.append(_PLY_TYPES[part[1]])
    if not names:
        raise CloudError("no vertex element")
    body = data[end.end() :]
    if kind == "ascii":
        rows = np.array([line.split() for line in body.decode("ascii").splitlines()[:count]], dtype=float).reshape(count, -1)
        return _from_fields({n: rows[:, k] for k, n in enumerate(names)})
    order = "<" if kind == "binary_little_endian" else ">"
    rows = np.frombuffer(body, np.dtype([(n, order + t) for n, t in zip(names, types)]), count)
    return _from_fields({n: rows[n] for n in names})


def parse_pcd(data: bytes) -> dict[str, np.ndarray]:
    """ASCII or binary PCD; in a binary file a grey colour's red channel is the intensity, and labels aren't read."""
    header: dict[str, list[str]] = {}
    at = 0
    while True:
        stop = data.find(b"\n", at)
        if stop < 0:
            raise CloudError("the header ends before DATA")
        part = data[at:stop].decode("ascii").split()
        at = stop + 1
        if not part or part[0].startswith("#"):
            continue
        header[part[0].upper()] = part[1:]
        if part[0].upper() == "DATA":
            break
    names = header.get("FIELDS", [])
    counts = [int(c) for c in header.get("COUNT", ["1"] * len(names))]
    if header["DATA"][:1] == ["ascii"]:
        rows = np.loadtxt(io.BytesIO(data[at:]), ndmin=2)
        starts = np.cumsum([0, *counts])
        return _from_fields({n: rows[:, s] for n, s in zip(names, starts)})
    if header["DATA"][:1] != ["binary"]:
        raise CloudError(f"DATA {' '.join(header['DATA'])} isn't read")
    kinds = {"F": "f", "I": "i", "U": "u"}
    dtype = np.dtype([(f"{n}\0{k}", f"<{kinds[t]}{s}", (c,)) for k, (n, t, s, c) in enumerate(zip(names, header["TYPE"], header["SIZE"], counts))])
    rows = np.frombuffer(data[at:], dtype, int(header["POINTS"][0]))
    fields = {n: rows[f"{n}\0{k}"][:, 0] for k, n in enumerate(names)}
    for c in ("rgb", "rgba"):
        if c in fields:
            fields["intensity"] = ((fields[c].copy().view(np.uint32) >> 16) & 255) / 255.0
    out = _from_fields(fields)
    out.pop("label", None)
    finite = np.isfinite(np.column_stack([out[a] for a in "xyz"])).all(axis=1)
    return {k: v[finite] for k, v in out.items()}


def parse_las(data: bytes) -> dict[str, np.ndarray]:
    """LAS 1.0 to 1.4 with point formats 0 to 10; the classification is the label."""
    if data[:4] != b"LASF":
        raise CloudError("no LAS signature")
    start, kind, length, count = struct.unpack_from("<I", data, 96)[0], data[104], *struct.unpack_from("<HI", data, 105)
    if kind & 0x80:
        raise CloudError("compressed LAS (LAZ) isn't read; decompress it first")
    if kind not in _LAS_LENGTH or length < _LAS_LENGTH[kind]:
        raise CloudError(f"point format {kind} isn't read")
    if data[25] >= 4 and not count:  # counts of 64 bits
        count = struct.unpack_from("<Q", data, 247)[0]
    scale, offset = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    dtype = np.dtype({"names": ["x", "y", "z", "intensity", "classification"], "formats": ["<i4", "<i4", "<i4", "<u2", "u1"], "offsets": [0, 4, 8, 12, 16 if kind > 5 else 15], "itemsize": length})
    rows = np.frombuffer(data, dtype, count, start)
    fields = {a: rows[a] * scale[k] + offset[k] for k, a in enumerate("xyz")}
    return _from_fields(fields | {"intensity": rows["intensity"], "classification": rows["classification"] if kind > 5 else rows["classification"] & 31}, ("classification",))


PARSERS = {".npz": parse_npz, ".npy": parse_npy, ".ply": parse_ply, ".pcd": parse_pcd, ".las": parse_las, ".laz": parse_las}


def to_frame(path: str, data: bytes) -> pd.DataFrame:
    name, ending = os.path.splitext(os.path.basename(path))
    if ending.lower() not in PARSERS:
        raise CloudError(f"{path}: unknown kind of file")
    try:
        found = PARSERS[ending.lower()](data)
    except CloudError as why:
        raise CloudError(f"{path}: {why}") from why
    out = pd.DataFrame({"path": path, "name": name, "point_id": np.arange(len(found["x"]))} | {a: found[a] for a in "xyz"})
    out["label"] = pd.array(found["label"].astype(int), "Int32") if "label" in found else pd.array([None] * len(out), "Int32")
    for c in ("intensity", "nx", "ny", "nz"):
        out[c] = pd.array(np.asarray(found[c], float), "Float64") if c in found else pd.array([None] * len(out), "Float64")
    return out


def read_points(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The points of all files of a folder (with subfolders) that the pattern names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)

    def parse(frames):
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"]):
                yield to_frame(path, data)

    return files.select("path", "content").mapInPandas(parse, SCHEMA)


METADATA = (
    "schema_version string, sensor string, coordinate_units string, intensity_scale string, road_segment_id string, capture_date string, source_dataset string, "
    "coordinate_reference_system string, label_source string, notes string, intensity_min double, intensity_max double"
)


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """name and metadata of each JSON file beside a scan; keys that aren't known are dropped."""
    rows = spark.read.schema(METADATA + ", _corrupt_record string").option("multiLine", "true").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(folder)
    return rows.withColumn("name", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)).drop("_corrupt_record")


def with_metadata(points: DataFrame, sidecars: DataFrame, required: bool = False) -> DataFrame:
    """Points with their scan's metadata; scans without any have metres, and an inferred intensity scale.

    required raises if a scan has none.
    """
    from ..operators.prepare import inferred_scale

    if required and points.select("name").distinct().join(sidecars, "name", "left_anti").take(1):
        raise CloudError("a scan has no metadata")
    top = points.groupBy("path").agg(F.max("intensity").alias("__top"))
    out = points.join(sidecars, "name", "left").join(top, "path")
    guess = inferred_scale(F.col("path"), F.coalesce("__top", F.lit(0.0)))
    return out.withColumns({"coordinate_units": F.coalesce("coordinate_units", F.lit("m")), "intensity_scale": F.coalesce("intensity_scale", guess)}).drop("__top")


def real_scans(spark: SparkSession, folder: str, pattern: str = "*", require_metadata: bool = False) -> DataFrame:
    """Scans in metres with intensities from 0 to 1, unit normals, and without zero returns."""
    from ..operators import prepare as P

    rows = with_metadata(read_points(spark, folder, pattern), read_sidecars(spark, folder), require_metadata)
    moved = rows.withColumns({a: P.to_metres(F.col(a), F.col("coordinate_units")) for a in "xyz"})
    moved = P.real_points(moved)
    span = moved.groupBy("path").agg(F.min("intensity").alias("__lo"), F.max("intensity").alias("__hi"))
    out = moved.join(span, "path")
    low, high = F.coalesce("intensity_min", "__lo"), F.coalesce("intensity_max", "__hi")
    out = out.withColumn("intensity", P.normalize_intensity(F.col("intensity"), F.col("intensity_scale"), low, high)).drop("__lo", "__hi")
    return P.unit_normals(out)


def write_scenes(points: DataFrame, folder: str, mode: str = "append") -> None:
    """Scenes as Parquet by split; one scene's points stay together."""
    points.repartition("split", "scene_id").sortWithinPartitions("split", "scene_id", "point_id").write.mode(mode).partitionBy("split").parquet(folder)


def scene_bytes(frame: pd.DataFrame) -> bytes:
    """One scene as a compressed NPZ."""
    out = io.BytesIO()
    np.savez_compressed(
        out, points=frame[["x", "y", "z"]].to_numpy(np.float32), labels=frame["label"].to_numpy(np.int32), feats=frame[["intensity_n", "curvature", "residual"]].to_numpy(np.float32), normals=frame[["nx", "ny", "nz"]].to_numpy(np.float32)
    )
    return out.getvalue()


def export_npz(points: DataFrame, folder: str) -> DataFrame:
    """Writes scene_<id>.npz files under folder/<split> (any of pyarrow's file systems) that aren't there yet; returns path and written of each."""
    from pyarrow import fs

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        system, base = fs.FileSystem.from_uri(folder)
        split, scene = frame["split"].iloc[0], int(frame["scene_id"].iloc[0])
        path = f"{base}/{split}/scene_{scene:06d}.npz"
        there = system.get_file_info(path).type == fs.FileType.File
        if not there:
            system.create_dir(os.path.dirname(path), recursive=True)
            with system.open_output_stream(path + ".part") as sink:
                sink.write(scene_bytes(frame.sort_values("point_id")))
            system.move(path + ".part", path)
        return pd.DataFrame({"path": [path], "written": [not there]})

    return points.groupBy("split", "scene_id").applyInPandas(one, "path string, written boolean")


def cloud_bytes(frame: pd.DataFrame, ending: str) -> bytes:
    """Points with x, y, z, label, intensity and normals as a file: .npy (named fields), .ply (binary), .pcd (ASCII) or .las (millimetres, format 0)."""
    n, xyz = len(frame), frame[["x", "y", "z"]].to_numpy(float)
    if ending in (".npy", ".ply"):
        fields = [("x", "x", "<f8"), ("y", "y", "<f8"), ("z", "z", "<f8"), ("nx", "nx", "<f8"), ("ny", "ny", "<f8"), ("nz", "nz", "<f8"), ("intensity", "intensity", "<f8"), ("label", "label", "<i4")]
        rows = np.zeros(n, dtype=[(name, kind) for name, _, kind in fields])
        for name, column, _ in fields:
            rows[name] = frame[column].to_numpy()
        if ending == ".npy":
            out = io.BytesIO()
            np.save(out, rows)
            return out.getvalue()
        head = f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\n" + "".join(f"property {'double' if kind == '<f8' else 'int'} {name}\n" for name, _, kind in fields) + "end_header\n"
        return head.encode("ascii") + rows.tobytes()
    if ending == ".pcd":
        head = f"VERSION .7\nFIELDS x y z intensity label\nSIZE 8 8 8 8 4\nTYPE F F F F I\nCOUNT 1 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nPOINTS {n}\nDATA ascii\n"
        lines = (f"{x!r} {y!r} {z!r} {i!r} {label}" for (x, y, z), i, label in zip(xyz.tolist(), frame["intensity"].astype(float).tolist(), frame["label"].astype(int).tolist()))
        return (head + "\n".join(lines) + "\n").encode("ascii")
    if ending == ".las":
        head = bytearray(227)
        head[:4], head[24:26], head[104] = b"LASF", bytes([1, 2]), 0
        struct.pack_into("<HI", head, 94, 227, 227)
        struct.pack_into("<HI", head, 105, 20, n)
        struct.pack_into("<6d", head, 131, 0.001, 0.001, 0.001, 0, 0, 0)
        rows = np.zeros(n, dtype={"names": ["x", "y", "z", "i", "c"], "formats": ["<i4", "<i4", "<i4", "<u2", "u1"], "offsets": [0, 4, 8, 12, 15], "itemsize": 20})
        for k, a in enumerate("xyz"):
            rows[a] = np.rint(xyz[:, k] * 1000)
        rows["i"], rows["c"] = np.rint(frame["intensity"].to_numpy(float) * 65535), frame["label"].to_numpy()
        return bytes(head) + rows.tobytes()
    raise CloudError(f"{ending} isn't written")


def export_clouds(points: DataFrame, folder: str, ending: str) -> DataFrame:
    """Writes a file for each scene, folder/scan_<id><ending> (any of pyarrow's file systems); returns path and points of each."""
    from pyarrow import fs

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        system, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/scan_{int(frame['scene_id'].iloc[0]):06d}{ending}"
        system.create_dir(base, recursive=True)
        with system.open_output_stream(path + ".part") as sink:
            sink.write(cloud_bytes(frame.sort_values("point_id"), ending))
        system.move(path + ".part", path)
        return pd.DataFrame({"path": [path], "points": [len(frame)]})

    return points.groupBy("scene_id").applyInPandas(one, "path string, points long")


def write_sidecars(metadata: DataFrame, folder: str) -> DataFrame:
    """Writes folder/<name>.json for each row of name and metadata, whose units and intensity scale must be known ones; returns the paths."""
    from pyarrow import fs

    from ..operators.prepare import FULL_SCALE, UNITS

    wrong = metadata.where(~F.col("coordinate_units").isin(*UNITS) | ~F.col("intensity_scale").isin(*FULL_SCALE, "range"))
    if wrong.take(1):
        raise CloudError("metadata with units or an intensity scale that aren't known")

    def write(frames):
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for frame in frames:
            paths = [f"{base}/{name}.json" for name in frame["name"]]
            for path, row in zip(paths, frame.drop(columns="name").to_dict("records")):
                with system.open_output_stream(path) as sink:
                    sink.write(json.dumps({k: v for k, v in row.items() if v is not None and v == v}).encode())
            yield pd.DataFrame({"path": paths})

    return metadata.mapInPandas(write, "path string")


def write_report(report: DataFrame, path: str) -> None:
    """A report (one row, nested) as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


def report_text(report: DataFrame) -> str:
    """A one-row report as indented JSON text."""
    return json.dumps(json.loads(report.toJSON().first()), indent=2, ensure_ascii=False)
