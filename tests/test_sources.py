import io
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.plans import views as V
from quarry.sources import clouds as C
from quarry.streaming import running


def ply(binary):
    kinds = [("x", "f4"), ("y", "f4"), ("z", "f4"), ("nx", "f4"), ("ny", "f4"), ("nz", "f4"), ("label", "i4"), ("intensity", "u1")]
    rows = np.array([(1000, 2000, 10, 0, 0, 2, 7, 128), (2000, 3000, 20, 0, 0, 1, 8, 255)], dtype=[(n, "<" + t) for n, t in kinds])
    names = {"f4": "float", "i4": "int", "u1": "uchar"}
    head = f"ply\nformat {'binary_little_endian' if binary else 'ascii'} 1.0\nelement vertex 2\n" + "".join(f"property {names[t]} {n}\n" for n, t in kinds) + "end_header\n"
    return head.encode() + (rows.tobytes() if binary else "\n".join(" ".join(map(str, r)) for r in rows.tolist()).encode())


def las():
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = bytes([1, 2])
    struct.pack_into("<HI", head, 94, 227, 227)
    head[104] = 3
    struct.pack_into("<HI", head, 105, 34, 2)
    struct.pack_into("<6d", head, 131, 0.001, 0.001, 0.001, 1, 2, 3)
    body = b"".join(struct.pack("<3iHBB", *xyz, i, 0, c) + bytes(18) for xyz, i, c in (((1000, 2000, 500), 32768, 5), ((2000, 0, 0), 65535, 6)))
    return bytes(head) + body


def npy(array):
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


PCD = b"# c\nVERSION .7\nFIELDS x y z intensity label\nSIZE 4 4 4 4 4\nTYPE F F F F I\nCOUNT 1 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA ascii\n1 2 3 25 4\n2 3 4 255 5\n"


def test_scans(spark, tmp_path):
    (tmp_path / "a.ply").write_bytes(ply(True))
    (tmp_path / "a.json").write_text(json.dumps({"coordinate_units": "mm", "intensity_scale": "uint8", "road_segment_id": "segment-1", "unknown": 3}))
    (tmp_path / "t.ply").write_bytes(ply(False))
    (tmp_path / "b.las").write_bytes(las())
    (tmp_path / "c.pcd").write_bytes(PCD)
    (tmp_path / "d.npy").write_bytes(npy(np.array([[0.0, 0, 0], [1, 2, 3]])))
    got = {(r["name"], r["point_id"]): r for r in C.real_scans(spark, str(tmp_path), "*.[plna][lpcay][ysdp]*").collect()}
    a = got["a", 0]
    assert (a.x, a.y, a.z, a.label, a.nz) == (1.0, 2.0, 0.01, 7, 1.0) and a.intensity == pytest.approx(128 / 255) and got["a", 1].intensity == 1
    assert (got["t", 1].x, got["t", 1].label) == (2000.0, 8)
    assert (got["b", 0].x, got["b", 0].y, got["b", 0].z, got["b", 0].label, got["b", 0].nx) == (2.0, 4.0, 3.5, 5, None) and got["b", 0].intensity == pytest.approx(32768 / 65535)
    assert (got["c", 0].label, got["c", 1].label) == (4, 5) and got["c", 0].intensity == pytest.approx(25 / 255)
    assert ("d", 0) not in got and (got["d", 1].x, got["d", 1].label, got["d", 1].intensity) == (1.0, None, None)
    with pytest.raises(C.CloudError):
        C.with_metadata(C.read_points(spark, str(tmp_path), "*.npy"), C.read_sidecars(spark, str(tmp_path)), required=True)


def test_parsers():
    named = np.zeros(2, dtype=[("x", "f4"), ("y", "f4"), ("z", "f4"), ("semantic", "i4"), ("normal_x", "f4"), ("normal_y", "f4"), ("normal_z", "f4"), ("reflectance", "f4")])
    assert set(C.parse_npy(npy(named))) == {"x", "y", "z", "label", "nx", "ny", "nz", "intensity"}
    assert set(C.parse_npy(npy(np.zeros((3, 8))))) == {"x", "y", "z", "label", "nx", "ny", "nz", "intensity"}
    assert set(C.parse_npy(npy(np.zeros((3, 4))))) == {"x", "y", "z", "label"}
    grey = np.array([51 << 16 | 51 << 8 | 51, 204 << 16], np.uint32).view(np.float32)
    head = b"FIELDS x y z rgb label\nSIZE 4 4 4 4 4\nTYPE F F F F I\nCOUNT 1 1 1 1 1\nPOINTS 2\nDATA binary\n"
    rows = b"".join(struct.pack("<3f", 1, 2, 3) + g.tobytes() + struct.pack("<i", 9) for g in grey)
    got = C.parse_pcd(head + rows)
    assert "label" not in got and got["intensity"] == pytest.approx([0.2, 0.8])
    for bad in (lambda: C.parse_ply(b"x"), lambda: C.parse_las(b"x" * 300), lambda: C.parse_pcd(b"FIELDS x\n"), lambda: C.parse_npy(npy(np.zeros(3))), lambda: C.to_frame("a.txt", b""), lambda: C.parse_las(las()[:104] + b"\x83" + las()[105:])):
        with pytest.raises(C.CloudError):
            bad()


def test_scenes_round_trip(spark, tmp_path):
    rows = [("train" if s < 3 else "val", s, p, float(p), float(s), 0.5, p % 3, 0.1, 0.2, 0.3, 0.0, 0.0, 1.0) for s in range(4) for p in range(5)]
    points = spark.createDataFrame(rows, "split string, scene_id long, point_id long, x double, y double, z double, label int, intensity_n double, curvature double, residual double, nx double, ny double, nz double")
    C.write_scenes(points, f"{tmp_path}/t")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t").select(points.columns).collect())) == sorted(rows)
    folder = f"file://{tmp_path}/n"
    assert [r.written for r in C.export_npz(points, folder).collect()] == [True] * 4
    assert [r.written for r in C.export_npz(points, folder).collect()] == [False] * 4
    back = C.read_points(spark, folder, "scene_*.npz")
    assert back.count() == 20 and back.where("name = 'scene_000002'").agg(F.sum("label")).first()[0] == 4
    C.write_report(points.agg(F.struct(F.count("*").alias("n")).alias("points")), f"{tmp_path}/r")
    assert json.loads(C.report_text(spark.read.json(f"{tmp_path}/r"))) == {"points": {"n": 20}}


def test_streams(spark, data, tmp_path):
    rows = V.predictions(spark, data)
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = running.to_table(running.running_confusion(stream, 10), "confusion_now", f"{tmp_path}/c1")
    from quarry.plans.evaluation import counts

    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, counts(spark, data).collect()))
    cal = running.to_table(running.running_calibration(stream), "calibration_now", f"{tmp_path}/c2")
    assert cal.agg(F.sum("n")).first()[0] == rows.count()
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(f"{tmp_path}/ev")
    es = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev")
    found = running.to_table(running.windowed_counts(es, "1 day", "1 hour"), "windows_now", f"{tmp_path}/c3")
    want = events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
