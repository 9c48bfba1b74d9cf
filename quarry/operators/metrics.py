"""Evaluation of predicted labels: confusion, segmentation metrics, calibration, thresholds, bootstrap, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import argmax, draw, ratio


def confusion(rows: DataFrame, classes: int, target: str = "target", pred: str = "pred", by: tuple[str, ...] = (), valid: str | None = None, ignore: int = -1) -> DataFrame:
    """Counts by (target, pred) of the rows whose both labels are classes and that are valid."""
    keep = (F.col(target) != ignore) & F.col(target).between(0, classes - 1) & F.col(pred).between(0, classes - 1)
    if valid:
        keep = keep & F.col(valid)
    return rows.where(keep).groupBy(*by, F.col(target).alias("target"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def dense(counts: DataFrame, classes: int) -> DataFrame:
    """The same counts with a row for every pair of classes."""
    spark = counts.sparkSession
    grid = spark.range(classes * classes).select(F.floor(F.col("id") / classes).cast("int").alias("target"), (F.col("id") % classes).cast("int").alias("pred"))
    return F.broadcast(grid).join(counts, ["target", "pred"], "left").select("target", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(counts: DataFrame, classes: int, min_support: int = 1) -> DataFrame:
    """label, support, predicted_support, tp, fp, fn, iou, recall, precision and supported of each class.

    The counts are small (classes squared), whatever the number of points.
    """
    spark = counts.sparkSession
    sides = F.array(F.struct(F.col("target").alias("label"), F.lit(1).alias("is_target")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("is_target")))
    long = counts.select("target", "pred", "n", F.explode(sides).alias("s")).select("s.*", "n", (F.col("target") == F.col("pred")).alias("hit"))
    sums = long.groupBy("label").agg(
        F.sum(F.when(F.col("is_target") == 1, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("is_target") == 0, F.col("n")).otherwise(0)).alias("predicted_support"),
        F.sum(F.when(F.col("hit") & (F.col("is_target") == 1), F.col("n")).otherwise(0)).alias("tp"),
    )
    out = spark.range(classes).select(F.col("id").cast("int").alias("label")).join(F.broadcast(sums), "label", "left").na.fill(0)
    tp, s, p = F.col("tp"), F.col("support"), F.col("predicted_support")
    return out.select("label", "support", "predicted_support", "tp", (p - tp).alias("fp"), (s - tp).alias("fn"), ratio(tp, s + p - tp).alias("iou"), ratio(tp, s).alias("recall"), ratio(tp, p).alias("precision"), (s >= min_support).alias("supported"))


def summary(counts: DataFrame, classes: int, tail: tuple[int, ...] = (), min_support: int = 1) -> DataFrame:
    """One row: mean IoU over supported, all and tail classes, and damage against background."""
    per = per_class(counts, classes, min_support).where("label > 0")
    means = per.agg(F.coalesce(F.avg(F.when(F.col("supported"), F.col("iou"))), F.lit(0.0)).alias("supported_miou"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("all_non_background_miou"), F.avg(F.when(F.col("label").isin(*tail) if tail else F.lit(False), F.col("iou"))).alias("tail_miou"))
    n, t, p = F.col("n"), F.col("target") > 0, F.col("pred") > 0
    fore = counts.agg(*(F.coalesce(F.sum(F.when(w, n)), F.lit(0)).alias(a) for a, w in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p))))
    one = lambda c: F.greatest(c, F.lit(1)).cast("double")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    fore = fore.select((tp / one(tp + fp + fn)).alias("foreground_iou"), (tp / one(tp + fp)).alias("foreground_precision"), (tp / one(tp + fn)).alias("foreground_recall"))
    return means.crossJoin(F.broadcast(fore))  # one row each


def with_confidence(rows: DataFrame, probs: str = "probs", target: str = "target") -> DataFrame:
    """Adds pred, conf, p_target, correct and brier of each row."""
    p = F.col(probs)
    squares = F.aggregate(p, F.lit(0.0), lambda s, x: s + x * x)
    out = rows.withColumns({"pred": argmax(p), "conf": F.array_max(p), "p_target": F.get(p, F.col(target))})
    return out.withColumns({"correct": (F.col("pred") == F.col(target)).cast("int"), "brier": squares - 2.0 * F.col("p_target") + 1.0})


def calibration_bins(rows: DataFrame, bins: int = 15) -> DataFrame:
    """bin, n, confidence and accuracy of each confidence bin; empty bins have nulls."""
    at = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).cast("int")
    found = with_confidence(rows).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(found), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_summary(rows: DataFrame, bins: int = 15) -> DataFrame:
    """ece, brier and nll over all rows; sums by bin are merged, so one pass does."""
    at = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).cast("int")
    sums = with_confidence(rows).groupBy(at.alias("bin")).agg(
        F.count("*").alias("n"), F.sum("conf").alias("c"), F.sum("correct").alias("r"), F.sum("brier").alias("b"), F.sum(-F.log(F.greatest("p_target", F.lit(1e-12)))).alias("l")
    )
    return sums.agg(F.sum("n").alias("n"), (F.sum(F.abs(F.col("c") - F.col("r"))) / F.sum("n")).alias("ece"), (F.sum("b") / F.sum("n")).alias("brier"), (F.sum("l") / F.sum("n")).alias("nll"))


def thresholds(spark, start: float = 0.05, end: float = 0.95, step: float = 0.01) -> DataFrame:
    """The thresholds from start to end (included, within a quarter step)."""
    if not (0 <= start <= end <= 1 and step > 0):
        raise ValueError("thresholds need 0 <= start <= end <= 1 and a positive step")
    n = int((end + step * 0.25 - start) / step) + 1
    return spark.range(n).select((F.lit(start) + F.col("id") * step).alias("threshold"))


def threshold_scan(rows: DataFrame, grid: DataFrame, prob: str = "prob", target: str = "target") -> DataFrame:
    """iou, precision and recall of class 1 at each threshold (prob >= threshold).

    Each point is counted once, by how many thresholds it reaches; what is left is a running sum over
    the thresholds, a row each.  A probability that is null or NaN reaches none.
    """
    order = Window.orderBy("threshold")
    steps = grid.select("threshold", F.row_number().over(order).alias("place"))
    every = steps.agg(F.array_sort(F.collect_list("threshold")).alias("__t"))
    # thresholds ascend, so those that a point reaches come first
    reached = F.coalesce(F.array_position(F.transform("__t", lambda t: t > F.col(prob)), True) - 1, F.lit(-1))
    reached = F.when(F.col(prob).isNull() | F.isnan(prob), 0).when(reached < 0, F.size("__t")).otherwise(reached).cast("int")
    binned = rows.where(F.col(target).isin(0, 1)).select(prob, target).crossJoin(F.broadcast(every)).groupBy(reached.alias("place")).agg(F.sum(F.col(target).cast("long")).alias("ones"), F.count("*").alias("all"))
    totals = binned.agg(F.coalesce(F.sum("ones"), F.lit(0)).alias("total"))
    after = Window.orderBy("place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sums = steps.join(F.broadcast(binned), "place", "left").na.fill(0, ["ones", "all"])
    sums = sums.select("threshold", F.sum("ones").over(after).alias("tp"), (F.sum("all").over(after) - F.sum("ones").over(after)).alias("fp")).crossJoin(F.broadcast(totals))
    sums = sums.withColumn("fn", F.col("total") - F.col("tp"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    one = lambda c: F.greatest(c, F.lit(1)).cast("double")
    return sums.select("threshold", "tp", "fp", "fn", (tp / one(tp + fp + fn)).alias("iou"), (tp / one(tp + fp)).alias("precision"), (tp / one(tp + fn)).alias("recall"))


def best_threshold(scan: DataFrame) -> DataFrame:
    """The first threshold with the highest iou."""
    return scan.agg(F.max_by(F.struct("threshold", "iou"), F.struct("iou", -F.col("threshold"))).alias("best")).select("best.*")


def split_leading(rows: DataFrame, n: int, scene: str = "scene_id") -> DataFrame:
    """Adds part: `calibrate` for the first n scenes in order, else `evaluate`."""
    scenes = rows.select(scene).distinct()
    if scenes.count() <= n:
        raise ValueError("no scene is left to evaluate")
    first = scenes.orderBy(scene).limit(n).withColumn("__first", F.lit(True))
    return rows.join(F.broadcast(first), scene, "left").withColumn("part", F.when(F.col("__first"), "calibrate").otherwise("evaluate")).drop("__first")


def _drawn(spark, n: int, replicates: int, seed: int) -> DataFrame:
    """replicate, slot and how many times it was drawn, of n draws with replacement from n slots in each replicate."""
    draws = spark.range(replicates * n).select(F.floor(F.col("id") / n).alias("replicate"), (F.col("id") % n).alias("k"))
    return draws.groupBy("replicate", (draw(seed, F.col("replicate"), F.col("k")) % n).alias("slot")).agg(F.count("*").alias("times"))


def bootstrap_metrics(by_scene: DataFrame, classes: int, tail: tuple[int, ...] = (), replicates: int = 200, seed: int = 42, alpha: float = 0.05, min_support: int = 1, scene: str = "scene_id") -> DataFrame:
    """metric, point_estimate, mean, lower and upper of supported_miou, foreground_iou and (with tail labels) tail_miou.

    by_scene has counts of (scene, target, pred); whole scenes are drawn with replacement.  Each scene becomes a row a class with
    its sums and one for the foreground (class -1), so a replicate is a sum of those.  With fewer than
    two scenes, or no replicates, mean and bounds are null.
    """
    spark = by_scene.sparkSession
    t, p, n = F.col("target"), F.col("pred"), F.col("n")
    sides = F.array(F.struct(t.alias("label"), F.lit(1).alias("is_target"), n.alias("c"), (t == p).alias("hit")), F.struct(p.alias("label"), F.lit(0).alias("is_target"), n.alias("c"), F.lit(False).alias("hit")))
    fore = F.array(F.struct(F.when(t > 0, -1).alias("label"), F.lit(1).alias("is_target"), n.alias("c"), (p > 0).alias("hit")), F.struct(F.when(p > 0, -1).alias("label"), F.lit(0).alias("is_target"), n.alias("c"), F.lit(False).alias("hit")))
    sums = (F.sum(F.when(F.col("is_target") == 1, F.col("c")).otherwise(0)).alias("s"), F.sum(F.when(F.col("is_target") == 0, F.col("c")).otherwise(0)).alias("p"), F.sum(F.when(F.col("hit"), F.col("c")).otherwise(0)).alias("tp"))
    long = by_scene.select(scene, F.explode(F.concat(sides, fore)).alias("x")).select(scene, "x.*").where("label is not null and label <> 0").groupBy(scene, "label").agg(*sums)

    def metrics(per: DataFrame, by: list[str]) -> DataFrame:
        """supported_miou, foreground_iou and tail_miou of each replicate."""
        tp, s, q = F.col("tp"), F.col("s"), F.col("p")
        iou = tp / F.greatest(s + q - tp, F.lit(1)).cast("double")
        tails = F.col("label").isin(*tail) if tail else F.lit(False)
        one = per.groupBy(*by).agg(
            F.coalesce(F.avg(F.when((F.col("label") > 0) & (s >= min_support), iou)), F.lit(0.0)).alias("supported_miou"), F.coalesce(F.max(F.when(F.col("label") == -1, iou)), F.lit(0.0)).alias("foreground_iou"),
            F.when(F.lit(bool(tail)), F.coalesce(F.sum(F.when(tails, iou)), F.lit(0.0)) / max(1, len(tail))).alias("tail_miou"),
        )
        kinds = ["supported_miou", "foreground_iou"] + (["tail_miou"] if tail else [])
        return one.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in kinds))).alias("x")).select(*by, "x.*")

    total = long.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("s", "p", "tp")))
    point = metrics(total, []).withColumnRenamed("value", "point_estimate")
    scenes = by_scene.select(scene).distinct()
    n_scenes = scenes.count()
    if n_scenes < 2 or replicates <= 0:
        return point.withColumns({c: F.lit(None).cast("double") for c in ("mean", "lower", "upper")})
    numbered = scenes.withColumn("slot", (F.row_number().over(Window.orderBy(scene)) - 1).cast("long"))  # a row for each scene
    drawn = _drawn(spark, n_scenes, replicates, seed).join(numbered, "slot").join(long, scene).groupBy("replicate", "label").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in ("s", "p", "tp")))
    values = metrics(drawn, ["replicate"]).groupBy("metric").agg(F.avg("value").alias("mean"), F.percentile("value", alpha / 2).alias("lower"), F.percentile("value", 1 - alpha / 2).alias("upper"))
    return point.join(F.broadcast(values), "metric")  # a row a metric


def bootstrap(by_scene: DataFrame, metric: Column, replicates: int = 200, seed: int = 42, alpha: float = 0.05, scene: str = "scene_id", scenes: int | None = None) -> DataFrame:
    """Scene-block bootstrap: mean and percentile bounds of a metric of summed counts.

    by_scene has one row for each scene with columns tp, fp and fn; metric is a column over their
    sums.  Draws are hashes, so partitioning doesn't change them.
    """
    spark = by_scene.sparkSession
    n = scenes or by_scene.count()
    if n < 2 or replicates <= 0:
        point = by_scene.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).select(metric.alias("mean"))
        return point.select("mean", F.col("mean").alias("lower"), F.col("mean").alias("upper"))
    numbered = by_scene.withColumn("slot", (F.row_number().over(Window.orderBy(scene)) - 1).cast("long"))  # a row for each scene
    sums = _drawn(spark, n, replicates, seed).join(numbered, "slot").groupBy("replicate").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in ("tp", "fp", "fn")))
    values = sums.select(metric.alias("value"))
    return values.agg(F.avg("value").alias("mean"), F.percentile("value", alpha / 2).alias("lower"), F.percentile("value", 1 - alpha / 2).alias("upper"))


def focal_loss(rows: DataFrame, gamma: float = 2.0, alpha: Column | None = None) -> DataFrame:
    """Mean of alpha (1 - p_t)**gamma * cross-entropy over the rows that aren't padding (target -1)."""
    p = F.greatest(F.get("probs", F.col("target")), F.lit(1e-12))
    loss = F.pow(1.0 - p, F.lit(gamma)) * -F.log(p) * (alpha if alpha is not None else F.lit(1.0))
    return rows.where("target >= 0").agg(F.avg(loss).alias("focal_loss"))


def dice_loss(rows: DataFrame, classes: int, smooth: float = 1.0) -> DataFrame:
    """1 - (2 I + s) / (U + s), averaged over the classes."""
    long = rows.where("target >= 0").select("target", F.posexplode("probs").alias("label", "p"))
    sums = long.where(F.col("label") < classes).groupBy("label").agg(F.sum(F.when(F.col("label") == F.col("target"), F.col("p")).otherwise(0.0)).alias("i"), (F.sum("p") + F.sum((F.col("label") == F.col("target")).cast("double"))).alias("u"))
    return sums.agg(F.avg(1.0 - (2.0 * F.col("i") + smooth) / (F.col("u") + smooth)).alias("dice_loss"))


def legacy_miou(counts: DataFrame, classes: int, eps: float = 1e-8) -> DataFrame:
    """Mean of I / (U + eps) over all classes but 0; classes that never occur count as 0."""
    per = per_class(counts, classes).where("label > 0")
    return per.agg(F.avg(F.col("tp") / (F.col("support") + F.col("predicted_support") - F.col("tp") + eps)).alias("miou"))


def histograms(rows: DataFrame) -> DataFrame:
    """label, n_target, n_pred and mean_prob of each class."""
    long = with_confidence(rows).select("target", "pred", F.posexplode("probs").alias("label", "p"))
    return long.groupBy("label").agg(F.sum((F.col("label") == F.col("target")).cast("long")).alias("n_target"), F.sum((F.col("label") == F.col("pred")).cast("long")).alias("n_pred"), F.avg("p").alias("mean_prob"))


