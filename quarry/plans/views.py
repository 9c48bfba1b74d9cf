"""Canonical inputs made from the shared tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import softmax


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cloud_s(spark: SparkSession, folder: str) -> DataFrame:
    """A small cloud: scene, point, xyz, intensity and normals from embedding components."""
    e = F.col("embedding")
    names = ("x", "y", "z", "intensity", "nx", "ny", "nz")
    return table(spark, folder, "embeddings").select(F.col("label").cast("long").alias("scene_id"), F.col("vec_id").alias("point_id"), *(e[k].cast("double").alias(n) for k, n in enumerate(names)))


CLOUD_S = """cloud_s AS (SELECT CAST(label AS BIGINT) AS scene_id, vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
  CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS intensity, CAST(embedding[5] AS DOUBLE) AS nx, CAST(embedding[6] AS DOUBLE) AS ny, CAST(embedding[7] AS DOUBLE) AS nz FROM embeddings)"""


def cloud_l(spark: SparkSession, folder: str) -> DataFrame:
    """A large cloud from lineitem: a scene for each supplier."""
    keys = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("scene_id"), F.row_number().over(keys).cast("long").alias("point_id"), (F.col("l_extendedprice") / 1e4).alias("x"), F.col("l_quantity").alias("y"),
        (F.col("l_discount") + F.col("l_tax")).alias("z"), (F.col("l_quantity") / 50.0).alias("intensity"),
    )


CLOUD_L = """cloud_l AS (SELECT l_suppkey AS scene_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_quantity) AS point_id,
  l_extendedprice / 1e4 AS x, l_quantity AS y, l_discount + l_tax AS z, l_quantity / 50.0 AS intensity FROM lineitem)"""


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled points: scene of the supplier, label 0 to 37 from the part's size."""
    line, part = table(spark, folder, "lineitem"), table(spark, folder, "part")
    joined = line.join(part, line["l_partkey"] == part["p_partkey"])
    return joined.select(F.col("l_suppkey").alias("scene_id"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), (F.col("p_size") % 38).alias("label"))


LABELLED = "labelled AS (SELECT l_suppkey AS scene_id, l_orderkey AS order_id, l_linenumber AS line_no, p_size % 38 AS label FROM lineitem JOIN part ON l_partkey = p_partkey)"


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """scene_id, point_id, target and probs (10 classes)."""
    logits = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10.0)
    return table(spark, folder, "embeddings").select((F.col("vec_id") % 20).alias("scene_id"), F.col("vec_id").alias("point_id"), F.col("label").alias("target"), softmax(logits).alias("probs"))


PREDICTIONS = """predictions AS (SELECT vec_id % 20 AS scene_id, vec_id AS point_id, label AS target,
  list_transform(ex, lambda v: v / list_sum(ex)) AS probs FROM (SELECT *, list_transform(lg, lambda v: exp(v - list_max(lg))) AS ex
  FROM (SELECT *, list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE) * 10.0) AS lg FROM embeddings)))"""


def binary_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """target (0 or 1) and prob of class 1."""
    return predictions(spark, folder).select("scene_id", "point_id", (F.col("target") > 0).cast("int").alias("target"), (1.0 - F.col("probs")[0]).alias("prob"))


BINARY = PREDICTIONS + ", binary_predictions AS (SELECT scene_id, point_id, CAST(target > 0 AS INTEGER) AS target, 1.0 - probs[1] AS prob FROM predictions)"


def scene_log(spark: SparkSession, folder: str) -> DataFrame:
    """A register of scenes: split, target label and size."""
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("scene_id"), (F.col("o_custkey") % 37 + 1).cast("int").alias("target_label"), F.when(F.col("o_orderstatus") == "F", "val").otherwise("train").alias("split"),
        F.floor(F.col("o_totalprice")).cast("long").alias("n_points"),
    )


SCENE_LOG = "scene_log AS (SELECT o_orderkey AS scene_id, CAST(o_custkey % 37 + 1 AS INTEGER) AS target_label, CASE WHEN o_orderstatus = 'F' THEN 'val' ELSE 'train' END AS split, CAST(floor(o_totalprice) AS BIGINT) AS n_points FROM orders)"
