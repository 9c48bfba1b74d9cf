"""Running confusion counts and calibration over a stream of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M


def running_confusion(stream: DataFrame, classes: int) -> DataFrame:
    """Counts by (target, pred) so far; for the update or complete mode."""
    return M.confusion(M.with_confidence(stream), classes)


def running_calibration(stream: DataFrame, bins: int = 15) -> DataFrame:
    """Sums by confidence bin so far; M.calibration_summary's figures follow from them."""
    at = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).cast("int")
    return M.with_confidence(stream).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum("conf").alias("conf"), F.sum("correct").alias("correct"), F.sum("brier").alias("brier"))


def windowed_counts(events: DataFrame, width: str, late: str, time: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts by tumbling window of event time; rows later than the watermark don't count."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Run over what is there and stop, into a memory table."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
