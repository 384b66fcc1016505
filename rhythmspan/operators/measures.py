"""All rhythm measures of a recording in one pass over its beats.

Every beat gets what it needs to know of its neighbours and of the stretch that it ends, by windows of
one partitioning and one order: one exchange and one sort. Stretches (runs, fast or slow ones, sinus
intervals) are not grouped by keys of their own; a running sum, taken at a stretch's end less what it was
at its start, stands for the group. What is left is one aggregate by recording, or by recording and hour,
on the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from .rhythm import by, grid_of_hours, hour_of, usable


def _of_recordings(recordings: DataFrame, beats: DataFrame) -> DataFrame:
    """Beats with their recording's columns; a recording without beats is a row of null beats."""
    return recordings.join(beats.select("recording_id", "beat_idx", "time_sec", "rr_sec", "label"), "recording_id", "left")


def marked(rows: DataFrame, brady: Column | float = C.BRADY_BPM["medium"], tachy: Column | float = C.TACHY_BPM["medium"]) -> DataFrame:
    """Add to beats (``recording_id, beat_idx, time_sec, rr_sec, label``, other columns kept):

    ``good_rr`` (usable interval), ``rr_median`` (of five usable ones around it), ``nn, nn_step`` (ms),
    ``run`` (at the last beat of a stretch of one label: ``beats, start_sec, bpm``), ``slow_run,
    fast_run`` (beats so far of a stretch beyond the limit), ``sinus`` (at a normal beat: ``start_sec,
    escapes`` of the interval it ends).
    """
    upto = by().rowsBetween(Window.unboundedPreceding, 0)
    before = by().rowsBetween(Window.unboundedPreceding, -1)
    rr, label = F.col("rr_sec"), F.col("label")
    near = lambda way, k: F.expr(f"{way}(good_rr, {k}) ignore nulls over (partition by recording_id order by time_sec, beat_idx)")
    rows = rows.withColumn("good_rr", F.when(usable(rr), rr))
    rows = rows.withColumns(
        {
            "__n": F.row_number().over(by()), "__more": F.lead("beat_idx").over(by()).isNotNull(), "__last": F.lag("label").over(by()), "__next": F.lead("label").over(by()),
            "__five": F.array(near("lag", 2), near("lag", 1), F.col("good_rr"), near("lead", 1), near("lead", 2)),
            "__escapes": F.count_if(label == "E").over(upto), "__odd": F.count_if(F.col("beat_idx").isNotNull() & ~F.coalesce(label.isin("N", "E") & usable(rr), F.lit(False))).over(upto),
        }
    )
    member = (F.col("__n") > 1) & label.eqNullSafe(F.col("__last"))
    rate = lambda limit, slow: F.coalesce(F.when(rr > 0, 60 / rr < limit if slow else 60 / rr > limit), F.lit(False))
    rows = rows.withColumns({"__member": member, "__slow": rate(brady, True), "__fast": rate(tachy, False), "nn": F.when((label == "N") & (F.col("__last") == "N"), F.col("good_rr") * 1000)})
    inside = F.when(F.col("__member"), F.col("good_rr"))
    rows = rows.withColumns(
        {
            "__sum": F.coalesce(F.sum(inside).over(upto), F.lit(0.0)), "__count": F.count(inside).over(upto), "nn_step": F.col("nn") - F.lag("nn").over(by()),
            "__not_slow": F.coalesce(F.max(F.when(~F.col("__slow"), F.col("__n"))).over(upto), F.lit(0)), "__not_fast": F.coalesce(F.max(F.when(~F.col("__fast"), F.col("__n"))).over(upto), F.lit(0)),
        }
    )
    rows = rows.withColumns(
        {
            "__start": F.last(F.when(~F.col("__member"), F.struct("__n", "time_sec", "__sum", "__count")), ignorenulls=True).over(upto),
            "__sinus": F.last(F.when(label == "N", F.struct("time_sec", "__odd", "__escapes")), ignorenulls=True).over(before),
        }
    )
    beats, rrs = F.col("__n") - F.col("__start.__n") + 1, F.col("__count") - F.col("__start.__count")
    bpm = F.when((beats >= 3) & (rrs > 0), 60 / ((F.col("__sum") - F.col("__start.__sum")) / rrs))
    ends = F.col("beat_idx").isNotNull() & ~(F.col("__more") & label.eqNullSafe(F.col("__next")))
    closes = (label == "N") & (F.col("__odd") == F.col("__sinus.__odd"))
    five = F.col("__five")
    full = five[0].isNotNull() & five[1].isNotNull() & five[2].isNotNull() & five[3].isNotNull() & five[4].isNotNull()
    rows = rows.withColumns(
        {
            "rr_median": F.when(full, F.sort_array(five)[2]), "run": F.when(ends, F.struct(beats.alias("beats"), F.col("__start.time_sec").alias("start_sec"), bpm.alias("bpm"))),
            "slow_run": F.col("__n") - F.col("__not_slow"), "fast_run": F.col("__n") - F.col("__not_fast"),
            "sinus": F.when(closes, F.struct(F.col("__sinus.time_sec").alias("start_sec"), (F.col("__escapes") - F.col("__sinus.__escapes")).alias("escapes"))),
        }
    )
    return rows.drop(*(c for c in rows.columns if c.startswith("__")))


def summary(recordings: DataFrame, beats: DataFrame, pause: float = C.PAUSE_SEC, long_pause: float = C.LONG_PAUSE_SEC, least: int = C.SUSTAINED_BEATS) -> DataFrame:
    """One row for each of ``recordings`` (with ``brady_bpm, tachy_bpm``; its columns are kept), beats or none.

    Counts are 0 without beats; rates are null without a window of five intervals, variability with
    under two differences, longest ones where there is none. Of equals the first counts.
    """
    kept = [c for c in recordings.columns if c != "recording_id"]
    rows = marked(_of_recordings(recordings, beats), F.col("brady_bpm"), F.col("tachy_bpm"))
    there, rr, time, label, median = F.col("beat_idx").isNotNull(), F.col("rr_sec"), F.col("time_sec"), F.col("label"), F.col("rr_median")
    v, e, n, nn, step = label == "V", label == "E", F.col("run.beats"), F.col("nn"), F.col("nn_step")
    first = -F.col("run.start_sec")
    longest = F.max(F.when(v & F.col("run.bpm").isNotNull(), F.struct(n, first.alias("s"), F.col("run.bpm").alias("bpm"))))
    fastest = F.max(F.when(v & F.col("run.bpm").isNotNull(), F.struct(F.col("run.bpm").alias("bpm"), first.alias("s"), n.alias("beats"))))
    slow, fast, windows = F.max(F.when(median.isNotNull(), F.struct(median, -time))), F.min(F.when(median.isNotNull(), F.struct(median, time))), F.count("rr_median")
    varied = F.count("nn_step") >= 2
    sinus = F.max(F.when(F.col("sinus").isNotNull(), time - F.col("sinus.start_sec")))
    totals = rows.groupBy("recording_id", *kept).agg(
        F.count_if(there).alias("total_beats"), F.count_if(v).alias("pvc_count"), F.count_if(e).alias("escapes"), F.coalesce(F.count_if(v) / F.nullif(F.count_if(there), F.lit(0)) * 100, F.lit(0.0)).alias("burden_pct"),
        F.count_if(v & (n == 2)).alias("couplets"), F.count_if(v & (n == 3)).alias("triplets"), F.count_if(v & (n >= 4)).alias("vt_runs"), F.count_if(e & (n == 2)).alias("escape_couplets"), F.count_if(e & (n >= 3)).alias("escape_runs"),
        longest.alias("__l"), fastest.alias("__f"), F.count_if(rr >= pause).alias("pauses"), F.count_if(rr > long_pause).alias("long_pauses"), F.max(rr).alias("longest_pause"),
        F.when(windows > 0, 60 / F.avg("good_rr")).alias("mean_bpm"), (60 / slow["rr_median"]).alias("min_bpm"), (-slow["col2"]).alias("min_time"), (60 / fast["rr_median"]).alias("max_bpm"), fast["time_sec"].alias("max_time"),
        F.count_if(60 / median < F.col("brady_bpm")).alias("slow_windows"), F.count_if(60 / median < 60).alias("under_60_windows"), F.count_if(60 / median > F.col("tachy_bpm")).alias("fast_windows"), windows.alias("windows"),
        F.count("nn").alias("nn"), F.when(varied, F.stddev_pop(nn)).alias("sdnn_ms"), F.when(varied, F.sqrt(F.avg(step * step))).alias("rmssd_ms"), F.when(varied, F.avg((F.abs(step) > 50).cast("double")) * 100).alias("pnn50_pct"),
        F.count_if(F.col("sinus.escapes") >= 1).alias("arrests"), sinus.alias("longest_sinus"), F.count_if(F.col("slow_run") == least).alias("brady_events"), F.count_if(F.col("fast_run") == least).alias("tachy_events"), F.max(time).alias("last_sec"),
    )
    runs = [F.col(f"{k}.{c}").alias(f"{name}_{c}") for k, name in (("__l", "longest"), ("__f", "fastest")) for c in ("beats", "bpm")]
    return totals.select("*", *runs).drop("__l", "__f")


def hourly(beats: DataFrame, recordings: DataFrame, pause: float = C.PAUSE_SEC) -> DataFrame:
    """One row an hour: ``recording_id, hour, start_sec, end_sec, beats, pvcs, escapes, couplets, runs, pauses, min_bpm, mean_bpm, max_bpm``.

    ``recordings`` has ``recording_id, duration_sec, first_hour_sec``; those without beats have hours too.
    The first row ends at the next full hour of the clock, the others after 3600 s
    (:func:`rhythm.grid_of_hours`). A run of V counts where it starts. The hours of a recording, a few
    hundred, are a map that the grid looks up.
    """
    of = ["recording_id", "duration_sec", "first_hour_sec"]
    rows = marked(_of_recordings(recordings.select(*of), beats))
    none, v, n = F.lit(0).cast("long"), F.col("label") == "V", F.col("run.beats")
    one = lambda c: F.coalesce(c.cast("long"), none)
    nothing = F.lit(None).cast("double")
    entry = lambda hour, **c: F.struct(hour.alias("hour"), *(c.get(k, none).alias(k) for k in ("beats", "pvcs", "escapes", "pauses", "couplets", "runs")), *(c.get(k, nothing).alias(k) for k in ("rr", "median")))
    beat = entry(hour_of(F.col("time_sec")), beats=none + 1, pvcs=one(v), escapes=one(F.col("label") == "E"), pauses=one(F.col("rr_sec") >= pause), rr=F.col("good_rr"), median=F.col("rr_median"))
    run = entry(hour_of(F.col("run.start_sec")), couplets=one(n == 2), runs=one(n >= 3))
    entries = rows.select(*of, "time_sec", F.explode_outer(F.array_compact(F.array(F.when(F.col("beat_idx").isNotNull(), beat), F.when(v & (n >= 2), run)))).alias("x"))
    rated = (F.count("x.rr") >= 5) & (F.count("x.median") > 0)
    sums = [F.sum(f"x.{c}").alias(c) for c in ("beats", "pvcs", "escapes", "couplets", "runs", "pauses")]
    rates = [F.when(rated, 60 / f).alias(c) for c, f in (("min_bpm", F.max("x.median")), ("mean_bpm", F.avg("x.rr")), ("max_bpm", F.min("x.median")))]
    hours = entries.groupBy(*of, F.col("x.hour").alias("hour")).agg(*sums, *rates, F.max("time_sec").alias("last"))
    found = F.struct("hour", F.struct("beats", "pvcs", "escapes", "couplets", "runs", "pauses", "min_bpm", "mean_bpm", "max_bpm"))
    whole = hours.groupBy(*of).agg(F.max("last").alias("last"), F.map_from_entries(F.collect_list(F.when(F.col("hour").isNotNull(), found))).alias("__found"))
    grid = grid_of_hours(whole, "__found").withColumn("h", F.try_element_at("__found", F.col("hour")))
    counts = [F.coalesce(F.col(f"h.{c}"), none).alias(c) for c in ("beats", "pvcs", "escapes", "couplets", "runs", "pauses")]
    return grid.select("recording_id", "hour", "start_sec", "end_sec", *counts, *(F.col(f"h.{c}").alias(c) for c in ("min_bpm", "mean_bpm", "max_bpm")))
