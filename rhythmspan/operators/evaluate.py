"""How well found beats agree with beats known to be there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def _near(times: DataFrame, others: DataFrame, tolerance: float) -> DataFrame:
    """``recording_id, time_sec, hit`` of every row of ``times``: is one of ``others`` within the tolerance, ends included?

    The nearest other on either side comes from running extremes over both tables in time order,
    so work grows with the rows, not with the pairs.
    """
    both = times.select("recording_id", "time_sec", F.lit(True).alias("ours")).unionByName(others.select("recording_id", "time_sec", F.lit(False).alias("ours")))
    other = F.when(~F.col("ours"), F.col("time_sec"))
    by = Window.partitionBy("recording_id")
    upto = lambda order: by.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("__before", F.max(other).over(upto(F.col("time_sec").asc()))).withColumn("__after", F.min(other).over(upto(F.col("time_sec").desc())))
    t = F.col("time_sec")
    hit = F.coalesce(t - F.col("__before") <= tolerance, F.lit(False)) | F.coalesce(F.col("__after") - t <= tolerance, F.lit(False))
    return rows.where("ours").select("recording_id", "time_sec", hit.alias("hit"))


def detection(truth: DataFrame, found: DataFrame, tolerance: float = C.MATCH_SEC) -> DataFrame:
    """``recording_id, truth, found, hits, sensitivity, precision`` for recordings with a true beat."""
    hits = _near(truth, found, tolerance).groupBy("recording_id").agg(F.count(F.lit(1)).alias("truth"), F.count_if("hit").alias("hits"))
    counts = found.groupBy("recording_id").agg(F.count(F.lit(1)).alias("found"))
    rows = hits.join(counts, "recording_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return rows.select("recording_id", "truth", "found", "hits", (F.col("hits") / F.col("truth")).alias("sensitivity"), (F.col("hits") / F.greatest(F.lit(1), "found")).alias("precision"))


def labels_accepted(truth: DataFrame, flagged: DataFrame, tolerance: float = C.MATCH_SEC) -> DataFrame:
    """``recording_id, truth, flagged, accepted``: as many flagged beats as true ones, each near a true one."""
    near = _near(flagged, truth, tolerance).groupBy("recording_id").agg(F.count(F.lit(1)).alias("flagged"), F.bool_and("hit").alias("near"))
    counts = truth.groupBy("recording_id").agg(F.count(F.lit(1)).alias("truth"))
    rows = counts.join(near, "recording_id", "full").na.fill(0, ["truth", "flagged"])
    return rows.select("recording_id", "truth", "flagged", ((F.col("truth") == F.col("flagged")) & F.coalesce("near", F.lit(True))).alias("accepted"))
