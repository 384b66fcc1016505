"""From labelled beats to one screening row a recording, with bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import bands
from ..operators import measures, rhythm


def screen(beats: DataFrame, min_hours: float = C.MIN_HOURS) -> DataFrame:
    """Burden, runs, pauses and their bands, a row a recording.

    Each part groups beats by recording. Parts read different columns, so Spark plans an exchange for
    each of them rather than one for all; give a stored table, so that none is computed again.
    """
    last = beats.groupBy("recording_id").agg(F.max("time_sec").alias("analyzed_sec"))
    out = rhythm.burden(beats).join(rhythm.run_counts(rhythm.runs(beats)), "recording_id", "left").join(rhythm.pauses(beats), "recording_id").join(last, "recording_id")
    scaled = bands.pvc_per_24h(F.col("pvc_count"), F.col("analyzed_sec"), min_hours)
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("couplets", "triplets", "vt_runs")]
    return out.withColumn("pvc_per_24h", scaled).select(
        "recording_id", "total_beats", "pvc_count", "burden_pct", *zero, "fastest_bpm", "pauses", "longest_sec", "analyzed_sec", "pvc_per_24h",
        bands.pvc_24h_status(F.col("pvc_per_24h")).alias("pvc_status"), bands.count_status(F.coalesce("vt_runs", F.lit(0))).alias("vt_status"),
        bands.run_rate_status(F.col("fastest_bpm")).alias("rate_status"), bands.pause_status(F.col("longest_sec")).alias("pause_status"),
        bands.analyzed_status(F.col("analyzed_sec"), min_hours).alias("analyzed_status"),
    )


def kept_presses(presses: DataFrame, lengths: DataFrame) -> DataFrame:
    """Presses before the end of what is kept of their recording (``recording_id, duration_sec``)."""
    return presses.join(lengths.select("recording_id", "duration_sec"), "recording_id").where("time_sec < duration_sec").drop("duration_sec")


def summarize(beats: DataFrame, recordings: DataFrame, presses: DataFrame, min_hours: float = C.MIN_HOURS) -> DataFrame:
    """One wide row for each of ``recordings`` (``recording_id, start_time, duration_sec, trimmed_sec, analyzed_sec, weight_class``), beats or none.

    The limits of slow and fast rates are those of the weight class. Unknown durations fall back to the
    last beat; presses after a known duration don't count. Beats, recordings and presses are read and
    exchanged once each (:mod:`measures`).
    """
    known = rhythm.limits(recordings)
    met = known.join(presses.select("recording_id", F.col("time_sec").alias("__at")), "recording_id", "left")
    within = F.col("__at").isNotNull() & (F.col("duration_sec").isNull() | (F.col("__at") < F.col("duration_sec")))
    out = measures.summary(met.groupBy(*known.columns).agg(F.count_if(within).alias("presses")), beats)
    last = F.coalesce("last_sec", F.lit(0.0))
    out = out.withColumns({"duration_sec": F.coalesce("duration_sec", last), "analyzed_sec": F.coalesce("analyzed_sec", last), "trimmed_sec": F.coalesce("trimmed_sec", F.lit(0.0))})
    scaled = bands.pvc_per_24h(F.col("pvc_count"), F.col("analyzed_sec"), min_hours)
    return out.withColumn("pvc_per_24h", scaled).drop("last_sec")
