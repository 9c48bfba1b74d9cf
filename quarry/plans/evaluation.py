"""Queries over predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import metrics as M
from . import views as V
from .registry import query
from .registry import r6 as q6

PRED = V.PREDICTIONS + ", scored AS (SELECT *, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS pred, list_max(probs) AS conf, probs[target + 1] AS pt FROM predictions)"
CONF = PRED + ", confusion AS (SELECT target, pred, count(*) AS n FROM scored WHERE target BETWEEN 0 AND 9 AND pred BETWEEN 0 AND 9 GROUP BY ALL)"
PER = (
    CONF
    + """, per AS (SELECT CAST(l AS INTEGER) AS label, coalesce((SELECT sum(n) FROM confusion WHERE target = l), 0)::BIGINT AS support,
  coalesce((SELECT sum(n) FROM confusion WHERE pred = l), 0)::BIGINT AS predicted_support, coalesce((SELECT sum(n) FROM confusion WHERE pred = l AND target = l), 0)::BIGINT AS tp FROM range(10) t(l))"""
)


def scored(spark, folder):
    return M.with_confidence(V.predictions(spark, folder))


def counts(spark, folder):
    return M.confusion(scored(spark, folder), 10)


@query(f"""WITH {PER} SELECT label, support, predicted_support, tp, predicted_support - tp AS fp, support - tp AS fn,
  {q6("CASE WHEN support + predicted_support - tp = 0 THEN 0 ELSE tp / (support + predicted_support - tp) END")} AS iou,
  {q6("CASE WHEN support = 0 THEN 0 ELSE tp / support END")} AS recall, {q6("CASE WHEN predicted_support = 0 THEN 0 ELSE tp / predicted_support END")} AS "precision", support >= 1 AS supported FROM per""")
def segmentation_metrics(spark, folder):
    return M.per_class(counts(spark, folder), 10).withColumns({c: r6(c) for c in ("iou", "recall", "precision")})


@query(f"""WITH {PER}, m AS (SELECT avg(iou) FILTER (support >= 1) AS a, avg(iou) AS b, avg(iou) FILTER (label IN (7, 8, 9)) AS c FROM
  (SELECT *, CASE WHEN support + predicted_support - tp = 0 THEN 0 ELSE tp / (support + predicted_support - tp) END AS iou FROM per WHERE label > 0)),
  f AS (SELECT coalesce(sum(n) FILTER (target > 0 AND pred > 0), 0) AS tp, coalesce(sum(n) FILTER (target = 0 AND pred > 0), 0) AS fp, coalesce(sum(n) FILTER (target > 0 AND pred = 0), 0) AS fn FROM confusion)
  SELECT {q6("a")} AS supported_miou, {q6("b")} AS all_non_background_miou, {q6("c")} AS tail_miou, {q6("tp / greatest(tp + fp + fn, 1)")} AS foreground_iou, {q6("tp / greatest(tp + fp, 1)")} AS foreground_precision,
  {q6("tp / greatest(tp + fn, 1)")} AS foreground_recall FROM m, f""")
def segmentation_summary(spark, folder):
    out = M.summary(counts(spark, folder), 10, tail=(7, 8, 9))
    return out.select(*(r6(c).alias(c) for c in out.columns))


@query(f"WITH {CONF} SELECT CAST(a.l AS INTEGER) AS target, CAST(b.l AS INTEGER) AS pred, coalesce(n, 0) AS n FROM range(10) a(l) CROSS JOIN range(10) b(l) LEFT JOIN confusion ON target = a.l AND pred = b.l")
def confusion_dense(spark, folder):
    return M.dense(counts(spark, folder), 10)


@query(f"WITH {PRED} SELECT scene_id, target, pred, count(*) AS n FROM scored GROUP BY ALL")
def confusion_by_scene(spark, folder):
    return M.confusion(scored(spark, folder), 10, by=("scene_id",))


BINS = PRED + ", binned AS (SELECT *, CAST(least(floor(conf * 15), 14) AS INTEGER) AS bin, CAST(pred = target AS INTEGER) AS correct FROM scored)"


@query(f"WITH {BINS} SELECT CAST(l AS INTEGER) AS bin, count(conf) AS n, {q6('avg(conf)')} AS confidence, {q6('avg(correct)')} AS accuracy FROM range(15) t(l) LEFT JOIN binned ON bin = l GROUP BY l")
def calibration_bins(spark, folder):
    return M.calibration_bins(V.predictions(spark, folder)).withColumns({c: r6(c) for c in ("confidence", "accuracy")})


@query(f"""WITH {BINS}, s AS (SELECT bin, count(*) AS n, sum(conf) AS c, sum(correct) AS r, sum(list_sum(list_transform(probs, lambda p: p * p)) - 2 * pt + 1) AS b, sum(-ln(greatest(pt, 1e-12))) AS l FROM binned GROUP BY bin)
  SELECT CAST(sum(n) AS BIGINT) AS n, {q6("sum(abs(c - r)) / sum(n)")} AS ece, {q6("sum(b) / sum(n)")} AS brier, {q6("sum(l) / sum(n)")} AS nll FROM s""")
def calibration_summary(spark, folder):
    out = M.calibration_summary(V.predictions(spark, folder))
    return out.select("n", *(r6(c).alias(c) for c in ("ece", "brier", "nll")))


#: Every 97th probability is missing, every 101st isn't a number: both are below each threshold.
SCAN = V.BINARY + """, partly AS (SELECT target, CASE WHEN point_id % 97 = 0 THEN NULL WHEN point_id % 101 = 0 THEN 'nan'::DOUBLE ELSE prob END AS prob FROM binary_predictions), scan AS (SELECT threshold, tp, fp, fn, tp / greatest(tp + fp + fn, 1) AS iou, tp / greatest(tp + fp, 1) AS prec, tp / greatest(tp + fn, 1) AS rec FROM (
  SELECT threshold, CAST(count(*) FILTER (reached AND target = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (reached AND target = 0) AS BIGINT) AS fp, CAST(count(*) FILTER (NOT reached AND target = 1) AS BIGINT) AS fn
  FROM (SELECT *, coalesce(NOT isnan(prob) AND prob >= threshold, FALSE) AS reached FROM partly CROSS JOIN (SELECT CAST(0.05 AS DOUBLE) + k * CAST(0.01 AS DOUBLE) AS threshold FROM range(91) t(k))) GROUP BY threshold))"""


def scan(spark, folder):
    prob = F.when(F.col("point_id") % 97 == 0, None).when(F.col("point_id") % 101 == 0, float("nan")).otherwise(F.col("prob"))
    return M.threshold_scan(V.binary_predictions(spark, folder).withColumn("prob", prob), M.thresholds(spark))


@query(f"WITH {SCAN} SELECT {q6('threshold')} AS threshold, tp, fp, fn, {q6('iou')} AS iou, {q6('prec')} AS \"precision\", {q6('rec')} AS recall FROM scan")
def threshold_scan(spark, folder):
    return scan(spark, folder).withColumns({c: r6(c) for c in ("threshold", "iou", "precision", "recall")})


@query(f"WITH {SCAN} SELECT {q6('threshold')} AS threshold, {q6('iou')} AS iou FROM scan ORDER BY scan.iou DESC, scan.threshold LIMIT 1")
def best_threshold(spark, folder):
    out = M.best_threshold(scan(spark, folder))
    return out.select(*(r6(c).alias(c) for c in ("threshold", "iou")))


@query(f"""WITH {V.BINARY}, parted AS (SELECT *, CASE WHEN dense_rank() OVER (ORDER BY scene_id) <= 5 THEN 'calibrate' ELSE 'evaluate' END AS part FROM binary_predictions)
  SELECT part, count(DISTINCT scene_id) AS scenes, count(*) AS points, CAST(sum(target) AS BIGINT) AS positives FROM parted GROUP BY part""")
def calibration_split(spark, folder):
    return M.split_leading(V.binary_predictions(spark, folder), 5).groupBy("part").agg(F.countDistinct("scene_id").alias("scenes"), F.count("*").alias("points"), F.sum("target").alias("positives"))


@query(f"""WITH {PRED}, s AS (SELECT row_number() OVER (ORDER BY scene_id) - 1 AS slot, * FROM (SELECT scene_id, count(*) FILTER (target > 0 AND pred > 0) AS tp, count(*) FILTER (target = 0 AND pred > 0) AS fp, count(*) FILTER (target > 0 AND pred = 0) AS fn FROM scored GROUP BY scene_id)),
  d AS (SELECT r, CAST('0x' || substr(md5('42|' || r || '|' || k), 1, 8) AS BIGINT) % 20 AS slot FROM range(200) a(r), range(20) b(k)),
  v AS (SELECT sum(tp) / sum(tp + fp + fn) AS value FROM d JOIN s USING (slot) GROUP BY r)
  SELECT {q6("avg(value)")} AS mean, {q6("quantile_cont(value, 0.025)")} AS lower, {q6("quantile_cont(value, 0.975)")} AS upper FROM v""")
def bootstrap_ci(spark, folder):
    t, p = F.col("target") > 0, F.col("pred") > 0
    by_scene = scored(spark, folder).groupBy("scene_id").agg(*(F.sum(w.cast("long")).alias(a) for a, w in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p))))
    out = M.bootstrap(by_scene, F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn")))
    return out.select(*(r6(c).alias(c) for c in out.columns))


@query(f"""WITH {PRED}, c AS (SELECT scene_id, target, pred, count(*) AS n FROM scored WHERE target BETWEEN 0 AND 9 GROUP BY ALL), s AS (SELECT row_number() OVER (ORDER BY scene_id) - 1 AS slot, scene_id FROM (SELECT DISTINCT scene_id FROM c)),
  d AS (SELECT r, CAST('0x' || substr(md5('42|' || r || '|' || k), 1, 8) AS BIGINT) % 20 AS slot FROM range(200) a(r), range(20) b(k)),
  m AS (SELECT -1 AS r, target, pred, sum(n) AS n FROM c GROUP BY ALL UNION ALL SELECT r, target, pred, sum(n) AS n FROM d JOIN s USING (slot) JOIN c USING (scene_id) GROUP BY ALL),
  k AS (SELECT r, l AS label, coalesce(sum(n) FILTER (target = l), 0) AS sup, sum(n) FILTER (target = l AND pred = l) AS tp, sum(n) FILTER (target = l OR pred = l) AS u FROM m, range(1, 10) t(l) GROUP BY ALL),
  f AS (SELECT r, sum(n) FILTER (target > 0 AND pred > 0) / greatest(sum(n) FILTER (target > 0 OR pred > 0), 1) AS v FROM m GROUP BY r),
  v AS (SELECT r, 'supported_miou' AS metric, avg(coalesce(tp, 0) / greatest(u, 1)) FILTER (sup >= 1) AS v FROM k GROUP BY r UNION ALL SELECT r, 'tail_miou', sum(coalesce(tp, 0) / greatest(coalesce(u, 0), 1)) / 3 FROM k WHERE label IN (7, 8, 9) GROUP BY r UNION ALL SELECT r, 'foreground_iou', v FROM f)
  SELECT metric, {q6("max(v) FILTER (r = -1)")} AS point_estimate, {q6("avg(v) FILTER (r >= 0)")} AS mean, {q6("quantile_cont(v, 0.025) FILTER (r >= 0)")} AS lower, {q6("quantile_cont(v, 0.975) FILTER (r >= 0)")} AS upper FROM v GROUP BY metric""")
def bootstrap_metrics(spark, folder):
    by_scene = M.confusion(scored(spark, folder), 10, by=("scene_id",))
    out = M.bootstrap_metrics(by_scene, 10, tail=(7, 8, 9))
    return out.select("metric", *(r6(c).alias(c) for c in ("point_estimate", "mean", "lower", "upper")))


@query(f"WITH {PRED} SELECT {q6('avg(pow(1 - greatest(pt, 1e-12), 2) * -ln(greatest(pt, 1e-12)))')} AS focal_loss FROM scored WHERE target >= 0")
def focal_loss(spark, folder):
    return M.focal_loss(V.predictions(spark, folder)).select(r6("focal_loss").alias("focal_loss"))


@query(f"""WITH {PRED}, u AS (SELECT target, unnest(probs) AS p, unnest(range(10)) AS label FROM scored)
  SELECT {q6("avg(1 - (2 * i + 1) / (u + 1))")} AS dice_loss FROM (SELECT label, sum(CASE WHEN label = target THEN p ELSE 0 END) AS i, sum(p) + count(*) FILTER (label = target) AS u FROM u GROUP BY label)""")
def dice_loss(spark, folder):
    return M.dice_loss(V.predictions(spark, folder), 10).select(r6("dice_loss").alias("dice_loss"))


@query(f"WITH {PER} SELECT {q6('avg(tp / (support + predicted_support - tp + 1e-8))')} AS miou FROM per WHERE label > 0")
def legacy_miou(spark, folder):
    return M.legacy_miou(counts(spark, folder), 10).select(r6("miou").alias("miou"))


@query(f"""WITH {PRED}, u AS (SELECT target, pred, unnest(probs) AS p, unnest(range(10)) AS label FROM scored)
  SELECT CAST(label AS INTEGER) AS label, CAST(count(*) FILTER (label = target) AS BIGINT) AS n_target, CAST(count(*) FILTER (label = pred) AS BIGINT) AS n_pred, {q6("avg(p)")} AS mean_prob FROM u GROUP BY label""")
def prediction_histograms(spark, folder):
    return M.histograms(V.predictions(spark, folder)).withColumn("mean_prob", r6("mean_prob"))


@query(f"WITH {V.BINARY} SELECT point_id, target, CAST(prob >= 0.5 AS INTEGER) AS pred FROM binary_predictions")
def binary_prediction(spark, folder):
    return V.binary_predictions(spark, folder).select("point_id", "target", (F.col("prob") >= 0.5).cast("int").alias("pred"))
