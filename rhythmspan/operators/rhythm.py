"""Rhythm aggregates over labelled beats: windows and grouped aggregates keyed by recording.

All windows share one ordering, so each operator here has one exchange on ``recording_id``, and its
groupings that lead with it reuse the partitioning. For many measures at once see :mod:`measures`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import constants as C


def by() -> WindowSpec:
    return Window.partitionBy("recording_id").orderBy("time_sec", "beat_idx")


def usable(rr: Column) -> Column:
    """An interval counts unless it is null or 0."""
    return rr.isNotNull() & (rr != 0)


def burden(beats: DataFrame) -> DataFrame:
    """``recording_id, total_beats, pvc_count, burden_pct`` (V beats in percent)."""
    total, pvc = F.count(F.lit(1)), F.count_if(F.col("label") == "V")
    return beats.groupBy("recording_id").agg(total.alias("total_beats"), pvc.alias("pvc_count"), (pvc / total * 100).alias("burden_pct"))


def runs(beats: DataFrame, labels: tuple[str, ...] = ("V", "E")) -> DataFrame:
    """Maximal stretches of one label: ``recording_id, label, start_sec, end_sec, beats, bpm``.

    ``bpm`` is 60 / mean usable RR of the members after the first, for stretches of 3 or more.
    """
    same = F.col("label").eqNullSafe(F.lag("label").over(by()))
    marked = beats.withColumn("__run", F.sum(F.when(same, 0).otherwise(1)).over(by().rowsBetween(Window.unboundedPreceding, 0))).withColumn("__member", same & (F.lag("beat_idx").over(by()).isNotNull()))
    rate = F.avg(F.when(F.col("__member") & usable(F.col("rr_sec")), F.col("rr_sec")))
    n = F.count(F.lit(1))
    found = marked.groupBy("recording_id", "__run").agg(F.first("label").alias("label"), F.min("time_sec").alias("start_sec"), F.max("time_sec").alias("end_sec"), n.alias("beats"), F.when(n >= 3, 60 / rate).alias("bpm"))
    return found.where(F.col("label").isin(*labels)).drop("__run")


def run_counts(found: DataFrame) -> DataFrame:
    """Couplets, triplets and longer runs of V; escape couplets and runs of E; longest and fastest V run."""
    v, e, n = F.col("label") == "V", F.col("label") == "E", F.col("beats")
    longest = F.max(F.when(v & (n >= 3), F.struct(n, -F.col("start_sec"))))
    fastest = F.max(F.when(v & F.col("bpm").isNotNull(), F.struct(F.col("bpm"), -F.col("start_sec"))))
    return found.groupBy("recording_id").agg(
        F.count_if(v & (n == 2)).alias("couplets"), F.count_if(v & (n == 3)).alias("triplets"), F.count_if(v & (n >= 4)).alias("vt_runs"),
        F.count_if(e & (n == 2)).alias("escape_couplets"), F.count_if(e & (n >= 3)).alias("escape_runs"),
        longest["beats"].alias("longest_beats"), (-longest["col2"]).alias("longest_start"), fastest["bpm"].alias("fastest_bpm"), (-fastest["col2"]).alias("fastest_start"),
    )


def pauses(beats: DataFrame, pause: float = C.PAUSE_SEC, long_pause: float = C.LONG_PAUSE_SEC) -> DataFrame:
    """``recording_id, pauses, long_pauses, longest_sec``."""
    rr = F.col("rr_sec")
    return beats.groupBy("recording_id").agg(F.count_if(rr >= pause).alias("pauses"), F.count_if(rr > long_pause).alias("long_pauses"), F.max(rr).alias("longest_sec"))


def sustained(beats: DataFrame, kind: str, bpm: float | Column, least: int = C.SUSTAINED_BEATS) -> DataFrame:
    """Stretches of ``least`` or more beats slower ('brady') or faster ('tachy') than ``bpm``.

    ``recording_id, kind, start_sec, end_sec, beats``; an unusable or negative RR ends a stretch.
    """
    rate = 60 / F.col("rr_sec")
    match = F.when(F.col("rr_sec") > 0, rate < bpm if kind == "brady" else rate > bpm).otherwise(False)
    marked = beats.withColumn("__match", match)
    marked = marked.withColumn("__key", F.sum(F.when(F.col("__match"), 0).otherwise(1)).over(by().rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("time_sec", "beat_idx", "rr_sec"))
    found = marked.where("__match").groupBy("recording_id", "__key").agg(first.alias("f"), F.max("time_sec").alias("end_sec"), F.count(F.lit(1)).alias("beats"))
    return found.where(F.col("beats") >= least).select("recording_id", F.lit(kind).alias("kind"), (F.col("f.time_sec") - F.col("f.rr_sec")).alias("start_sec"), "end_sec", "beats")


def rate_windows(beats: DataFrame, *carried: str) -> DataFrame:
    """``recording_id, beat_idx, time_sec, rr_median``: medians of five usable RRs in a row, at the centre beat, with its ``carried`` columns."""
    near = [F.lag("rr_sec", 2).over(by()), F.lag("rr_sec", 1).over(by()), F.col("rr_sec"), F.lead("rr_sec", 1).over(by()), F.lead("rr_sec", 2).over(by())]
    five = beats.where(usable(F.col("rr_sec"))).select("recording_id", "beat_idx", "time_sec", *carried, F.array(*near).alias("five"))
    return five.where(F.col("five")[0].isNotNull() & F.col("five")[4].isNotNull()).select("recording_id", "beat_idx", "time_sec", *carried, F.sort_array("five")[2].alias("rr_median"))


def rate_stats(beats: DataFrame, brady: float | str = C.BRADY_BPM["medium"], tachy: float | str = C.TACHY_BPM["medium"]) -> DataFrame:
    """Mean, slowest and fastest rate with their times (first on a tie), and shares of slow and fast windows.

    A limit is a number, or names a column of ``beats`` (:func:`limits`).
    """
    means = beats.where(usable(F.col("rr_sec"))).groupBy("recording_id").agg((60 / F.avg("rr_sec")).alias("mean_bpm"))
    rr, time = F.col("rr_median"), F.col("time_sec")
    slow, fast = F.max(F.struct(rr, -time)), F.min(F.struct(rr, time))
    bpm = 60 / rr
    carried = [c for c in (brady, tachy) if isinstance(c, str)]
    brady, tachy = (F.col(c) if isinstance(c, str) else c for c in (brady, tachy))
    of = rate_windows(beats, *carried).groupBy("recording_id").agg(
        (60 / slow["rr_median"]).alias("min_bpm"), (-slow["col2"]).alias("min_time"), (60 / fast["rr_median"]).alias("max_bpm"), fast["time_sec"].alias("max_time"),
        F.count_if(bpm < brady).alias("slow_windows"), F.count_if(bpm < 60).alias("under_60_windows"), F.count_if(bpm > tachy).alias("fast_windows"), F.count(F.lit(1)).alias("windows"),
    )
    return of.join(means, "recording_id")


def variability(beats: DataFrame) -> DataFrame:
    """``recording_id, nn, sdnn_ms, rmssd_ms, pnn50_pct`` of intervals between adjacent normal beats; null with under 2 differences."""
    nn = F.when((F.col("label") == "N") & (F.lag("label").over(by()) == "N") & usable(F.col("rr_sec")), F.col("rr_sec") * 1000)
    rows = beats.withColumn("__nn", nn).withColumn("__d", F.col("__nn") - F.lag("__nn").over(by()))
    enough = F.count("__d") >= 2
    d = F.col("__d")
    out = rows.groupBy("recording_id").agg(
        F.count("__nn").alias("nn"), F.when(enough, F.stddev_pop("__nn")).alias("sdnn_ms"), F.when(enough, F.sqrt(F.avg(d * d))).alias("rmssd_ms"), F.when(enough, F.avg((F.abs(d) > 50).cast("double")) * 100).alias("pnn50_pct")
    )
    return out


def sinus_intervals(beats: DataFrame) -> DataFrame:
    """``recording_id, start_sec, end_sec, escape_beats``: from a normal beat to the next with only escapes between."""
    upto = F.sum(F.when(F.col("label") == "N", 1).otherwise(0)).over(by().rowsBetween(Window.unboundedPreceding, -1))
    rows = beats.withColumn("__seg", upto).withColumn("__from", F.lag("time_sec").over(by())).where("__seg >= 1")
    plain = F.bool_and(F.coalesce(F.col("label").isin("N", "E"), F.lit(False)) & usable(F.col("rr_sec")))
    of = rows.groupBy("recording_id", "__seg").agg(F.min("__from").alias("start_sec"), F.max("time_sec").alias("end_sec"), F.count_if(F.col("label") == "E").alias("escape_beats"), plain.alias("p"), F.bool_or(F.col("label") == "N").alias("closed"))
    return of.where("p and closed").select("recording_id", "start_sec", "end_sec", "escape_beats")


def sinus_summary(intervals: DataFrame) -> DataFrame:
    """Arrests (intervals with an escape) and the longest interval, bridged or not, first on a tie."""
    longest = F.max(F.struct((F.col("end_sec") - F.col("start_sec")).alias("d"), (-F.col("start_sec")).alias("s"), F.col("escape_beats").alias("e")))
    return intervals.groupBy("recording_id").agg(F.count_if(F.col("escape_beats") >= 1).alias("arrests"), longest["d"].alias("longest_sec"), (-longest["s"]).alias("longest_start"), longest["e"].alias("longest_escapes"))


def trend(beats: DataFrame, bin_sec: float = 60.0) -> DataFrame:
    """``recording_id, centre_sec, bpm``: 60 / median RR of each bin from 0 to the last; null with under 2 beats."""
    bins = beats.where(usable(F.col("rr_sec"))).withColumn("bin", F.floor(F.col("time_sec") / bin_sec))
    of = bins.groupBy("recording_id", "bin").agg(F.when(F.count(F.lit(1)) >= 2, 60 / F.median("rr_sec")).alias("bpm"))
    grid = of.groupBy("recording_id").agg(F.max("bin").alias("last")).select("recording_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bin"))
    return grid.join(of, ["recording_id", "bin"], "left").select("recording_id", ((F.col("bin") + 0.5) * bin_sec).alias("centre_sec"), "bpm")


def limits(recordings: DataFrame) -> DataFrame:
    """``recordings`` (``recording_id, weight_class``) with ``brady_bpm, tachy_bpm`` of the class; unknown classes count as medium."""
    rows = [(k, C.BRADY_BPM[k], C.TACHY_BPM[k]) for k in C.BRADY_BPM]
    classes = recordings.sparkSession.createDataFrame(rows, "__class string, brady_bpm double, tachy_bpm double")
    known = F.when(F.col("weight_class").isin(*C.BRADY_BPM), F.col("weight_class")).otherwise("medium")
    return recordings.withColumn("__class", known).join(F.broadcast(classes), "__class").drop("__class")  # three rows


def first_hour_sec(start: Column) -> Column:
    """Seconds from a start (null: unknown) to the next full hour of the clock; an hour if the start is one, or is unknown."""
    into = F.minute(start) * 60 + F.date_format(start, "s.SSSSSS").cast("double")
    return F.lit(3600.0) - F.coalesce(into, F.lit(0.0))


def hour_of(t: Column) -> Column:
    """The row of the hourly table that a time falls in: 0 up to the first full hour of the clock."""
    return F.when(t < F.col("first_hour_sec"), F.lit(0).cast("long")).otherwise(1 + F.floor((t - F.col("first_hour_sec")) / 3600))


def grid_of_hours(spans: DataFrame, *carried: str) -> DataFrame:
    """``recording_id, hour, start_sec, end_sec``: the hours of each of ``spans`` (``recording_id, duration_sec, first_hour_sec, last``).

    They go on to the duration or the last beat. A beat that stands on the last boundary gets an hour of no length.
    """
    spans = spans.withColumn("until", F.greatest(F.coalesce("duration_sec", F.lit(0.0)), F.coalesce("last", F.lit(0.0))))
    begin = lambda hour: F.when(hour == 0, F.lit(0.0)).otherwise(F.col("first_hour_sec") + (hour - 1) * 3600.0)
    plain = F.when(F.col("until") > F.col("first_hour_sec"), F.ceil((F.col("until") - F.col("first_hour_sec")) / 3600)).otherwise(F.when(F.col("until") > 0, 0).otherwise(-1))
    spans = spans.withColumn("n", plain.cast("long"))
    ends_on_beat = F.coalesce(F.col("last") == F.col("until"), F.lit(False)) & (begin(F.col("n") + 1) == F.col("until"))
    spans = spans.withColumn("n", F.col("n") + ends_on_beat.cast("long")).where("n >= 0")
    hours = spans.select("recording_id", "first_hour_sec", "until", *carried, F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("hour"))
    return hours.select("recording_id", "hour", begin(F.col("hour")).alias("start_sec"), F.least(F.col("first_hour_sec") + F.col("hour") * 3600.0, F.col("until")).alias("end_sec"), *carried)
