"""The label space: 38 classes of road surface, their curriculum stages, priorities and recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_LABELS = 38

# Fixed values of the label space: (pavement, disease, severity, variant) of labels 1 to 37.
RECIPES = {
    1: ("asphalt", "crack", "light", "alligator"), 2: ("asphalt", "crack", "severe", "alligator"),
    3: ("asphalt", "crack", "light", "block"), 4: ("asphalt", "crack", "severe", "block"),
    5: ("asphalt", "crack", "light", "longitudinal"), 6: ("asphalt", "crack", "severe", "longitudinal"),
    7: ("asphalt", "crack", "light", "transverse"), 8: ("asphalt", "crack", "severe", "transverse"),
    9: ("asphalt", "pothole", "light", None), 10: ("asphalt", "pothole", "severe", None),
    11: ("asphalt", "raveling", "light", None), 12: ("asphalt", "raveling", "severe", None),
    13: ("asphalt", "depression", "light", None), 14: ("asphalt", "depression", "severe", None),
    15: ("asphalt", "rutting", "light", None), 16: ("asphalt", "rutting", "severe", None),
    17: ("asphalt", "corrugation", "light", None), 18: ("asphalt", "corrugation", "severe", None),
    19: ("asphalt", "bleeding", "light", None), 20: ("asphalt", "patching", "-", None),
    21: ("concrete", "concrete_damage", "light", "slab_shatter"), 22: ("concrete", "concrete_damage", "severe", "slab_shatter"),
    23: ("concrete", "concrete_damage", "light", "slab_crack"), 24: ("concrete", "concrete_damage", "severe", "slab_crack"),
    25: ("concrete", "concrete_damage", "light", "corner_break"), 26: ("concrete", "concrete_damage", "severe", "corner_break"),
    27: ("concrete", "concrete_damage", "light", "faulting"), 28: ("concrete", "concrete_damage", "severe", "faulting"),
    29: ("concrete", "concrete_damage", "-", "pumping"),
    30: ("concrete", "concrete_damage", "light", "edge_spall"), 31: ("concrete", "concrete_damage", "severe", "edge_spall"),
    32: ("concrete", "concrete_damage", "light", "joint_damage"), 33: ("concrete", "concrete_damage", "severe", "joint_damage"),
    34: ("concrete", "concrete_damage", "-", "pitting"), 35: ("concrete", "concrete_damage", "-", "blowup"),
    36: ("concrete", "concrete_damage", "-", "exposed_aggregate"), 37: ("concrete", "concrete_damage", "-", "patching"),
}

# Labels of each class of the stages with 4 and 8 classes (class 0 is background).
STAGE_CLASSES = {
    "binary": {1: list(range(1, 38))},
    "four": {1: [1, 2, 3, 4, 5, 6, 7, 8, 23, 24], 2: [9, 10, 11, 12, 19, 21, 22, 25, 26, 29, 30, 31, 32, 33, 34, 36], 3: [13, 14, 15, 16, 17, 18, 20, 27, 28, 35, 37]},
    "eight": {1: list(range(1, 9)), 2: list(range(9, 13)), 3: list(range(13, 19)), 4: [19, 20], 5: list(range(21, 27)), 6: list(range(27, 34)), 7: list(range(34, 38))},
    "full38": {k: [k] for k in range(1, 38)},
}
STAGE_SIZE = {"binary": 2, "four": 4, "eight": 8, "full38": 38}

# Which label stays where two meet (higher wins), in order of the labels 0 to 37.
PRIORITY = [0, 7, 8, 2, 3, 5, 6, 3, 4, 9, 10, 4, 5, 1, 2, 1, 2, 1, 2, 5, 6, 9, 10, 7, 8, 5, 6, 3, 4, 5, 3, 4, 1, 2, 6, 7, 4, 8]

# The order in which kinds of damage are applied to a surface.
APPLY_ORDER = {"corrugation": 0, "rutting": 1, "depression": 2, "pothole": 3, "crack": 4, "bleeding": 5, "patching": 3, "raveling": 6, "concrete_damage": 0}


def normalize_stage(name: str) -> str:
    found = name.strip().lower()
    if found not in STAGE_SIZE:
        raise ValueError(f"unknown label stage {name!r}")
    return found


def lut(stage: str) -> list[int]:
    """Class of each label 0 to 37; every label has exactly one."""
    out = [0] * N_LABELS
    seen = set()
    for k, members in STAGE_CLASSES[normalize_stage(stage)].items():
        for m in members:
            if m in seen or not 0 < m < N_LABELS:
                raise ValueError(f"label {m} isn't in exactly one class of {stage}")
            seen.add(m)
            out[m] = k
    if len(seen) != N_LABELS - 1:
        raise ValueError(f"{stage} doesn't cover the labels")
    return out


def stage_for_num_classes(n: int) -> str:
    found = [s for s, size in STAGE_SIZE.items() if size == n]
    if len(found) != 1:
        raise ValueError(f"no single stage has {n} classes")
    return found[0]


def label_dim(spark: SparkSession) -> DataFrame:
    """One row for each label: its class in every stage, priority and recipe."""
    tables = {s: lut(s) for s in STAGE_SIZE}
    rows = [(k, *(tables[s][k] for s in ("binary", "four", "eight", "full38")), PRIORITY[k], *(RECIPES.get(k) or ("common", "background", "-", None))) for k in range(N_LABELS)]
    return spark.createDataFrame(rows, "label int, binary int, four int, eight int, full38 int, priority int, pavement string, disease string, severity string, variant string")


def lut_column(label, stage: str):
    """The class of a label column as an expression; labels out of range give null."""
    return F.get(F.array(*(F.lit(k) for k in lut(stage))), label.cast("int"))


def label_for(pavement, damage, severity, dim: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds label to rows by (pavement, damage, severity); damage is a disease or a variant.

    A kind without a severity matches any; the smallest label wins; no match gives null.
    """
    d = dim.where("label > 0").select("label", F.col("pavement").alias("__p"), F.coalesce("variant", "disease").alias("__d"), F.col("severity").alias("__s"), F.col("disease").alias("__k"))
    on = (F.col(pavement) == d["__p"]) & (F.col(damage) == d["__d"]) & ((F.col(severity) == d["__s"]) | d["__s"].eqNullSafe("-") | d["__k"].eqNullSafe("bleeding"))
    return rows.join(F.broadcast(d), on, "left").drop("__p", "__d", "__s", "__k")


def sql_values() -> str:
    """The label dimension as SQL VALUES, for checks in other engines."""
    tables = {s: lut(s) for s in STAGE_SIZE}
    rows = []
    for k in range(N_LABELS):
        p, d, s, v = RECIPES.get(k) or ("common", "background", "-", None)
        rows.append(f"({k},{tables['binary'][k]},{tables['four'][k]},{tables['eight'][k]},{tables['full38'][k]},{PRIORITY[k]},'{p}','{d}','{s}',{repr(v) if v else 'NULL'})")
    return "(VALUES " + ",".join(rows) + ") AS label_dim(label, b2, c4, c8, c38, priority, pavement, disease, severity, variant)"
