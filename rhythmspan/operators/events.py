"""Flagged events of a recording, the even sample of them to show, and the strips around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import bands
from . import rhythm
from .labels import typical


def catalogue(beats: DataFrame) -> DataFrame:
    """Every stretch of V or E beats with its kind, rate, status and what was usual just before it.

    ``recording_id, label, kind, start_sec, end_sec, beats, bpm, rr_list, qrs_list, typical_rr,
    typical_qrs, status``. The lists hold the measures of the members in time order (unknown ones
    left out). ``bpm`` is 60 / mean usable RR of the members after the first; status is null for
    single premature beats and for escapes.
    """
    same = F.col("label").eqNullSafe(F.lag("label").over(rhythm.by())) & F.lag("beat_idx").over(rhythm.by()).isNotNull()
    rows = typical(beats).withColumn("__member", same)
    rows = rows.withColumn("__run", F.sum(F.when(F.col("__member"), 0).otherwise(1)).over(rhythm.by().rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(F.col("label").isin("V", "E"))
    first = F.min(F.struct("time_sec", "beat_idx", "typical_rr", "typical_qrs"))
    members = F.sort_array(F.collect_list(F.struct("time_sec", "beat_idx", "rr_sec", "qrs_sec")))
    rate = 60 / F.avg(F.when(F.col("__member") & rhythm.usable(F.col("rr_sec")), F.col("rr_sec")))
    runs = rows.groupBy("recording_id", "__run", "label").agg(first.alias("f"), members.alias("m"), rate.alias("bpm"), F.count(F.lit(1)).alias("beats"))
    v, n, bpm = F.col("label") == "V", F.col("beats"), F.col("bpm")
    fast = bands.run_rate_status(bpm) == "alert"
    kind = (
        F.when(v & (n == 1), "isolated").when(v & (n == 2), "couplet").when(v & (n == 3), "triplet").when(v & fast, "tachycardia").when(v, "slower run")
        .when(n == 1, "escape").when(n == 2, "escape couplet").otherwise("escape run")
    )
    status = F.when(v & (n > 1), F.when((n < 4) | fast, "alert").otherwise("caution"))
    known = lambda c: F.filter(F.transform("m", lambda x: x[c]), lambda y: y.isNotNull()).alias(c.replace("_sec", "_list"))
    return runs.select(
        "recording_id", "label", kind.alias("kind"), F.col("f.time_sec").alias("start_sec"), F.element_at("m", -1)["time_sec"].alias("end_sec"), "beats", "bpm",
        known("rr_sec"), known("qrs_sec"), "f.typical_rr", "f.typical_qrs", status.alias("status"),
    )


def even_sample(rows: DataFrame, cap: int | Column, within: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Up to ``cap`` rows of each group spread evenly over its order, first and last included; adds ``position, total``.

    A report shows this many and says of how many; half positions round to even. A cap that is a
    column is constant in a group.
    """
    if isinstance(cap, int):
        if cap < 2:
            raise ValueError("cap must be 2 or more")
        cap = F.lit(cap)
    by = Window.partitionBy(*within)
    ranked = rows.withColumn("position", F.row_number().over(by.orderBy(*order)) - 1).withColumn("total", F.count(F.lit(1)).over(by))
    step = (F.col("total") - 1) / (cap - 1).cast("double")
    taken = F.exists(F.sequence(F.lit(0), cap - 1), lambda i: F.bround(i * step) == F.col("position"))
    return ranked.where((F.col("total") <= cap) | taken)


#: Sections of strips in the order of a report, and how many of each it shows at most.
SECTIONS = {"extremes": C.MAX_STRIPS, "presses": C.MAX_STRIPS, "runs": C.MAX_STRIPS, "isolated": C.MAX_STRIPS, "escapes": C.MAX_STRIPS, "hours": C.MAX_HOUR_STRIPS}


def sections(flagged: DataFrame, found: DataFrame, presses: DataFrame, beats: DataFrame, first_hours: DataFrame, caps: dict[str, int] = SECTIONS) -> DataFrame:
    """What a report shows strips of: ``recording_id, section, kind, start_sec, end_sec, marked, position, total``.

    ``flagged`` is the :func:`catalogue` (runs of V, isolated V and escapes are sections of their own,
    so many of one take no strip from another), ``found`` the :func:`extremes`, ``presses`` the diary's,
    ``first_hours`` (``recording_id, first_hour_sec``) where the hours begin. Each section is sampled
    evenly, all in one window; ``total`` says of how many. Hours and presses have no beats marked.
    """
    columns = ("recording_id", "section", "kind", "start_sec", "end_sec", "marked")
    section = F.when(F.col("label") == "E", "escapes").when(F.col("beats") > 1, "runs").otherwise("isolated")
    t = F.col("time_sec")
    hour = F.when(t < F.col("first_hour_sec"), F.lit(0).cast("long")).otherwise(1 + F.floor((t - F.col("first_hour_sec")) / 3600))
    first = beats.join(first_hours.select("recording_id", "first_hour_sec"), "recording_id").groupBy("recording_id", hour.alias("hour")).agg(F.min("time_sec").alias("time_sec"))
    of = lambda rows, section, kind, marked, begin="start_sec", end="end_sec": rows.select("recording_id", F.lit(section).alias("section") if isinstance(section, str) else section.alias("section"), kind.alias("kind"), F.col(begin).alias("start_sec"), F.col(end).alias("end_sec"), F.lit(marked).alias("marked"))
    rows = of(flagged, section, F.col("kind"), True).unionByName(of(found, "extremes", F.col("kind"), True))
    rows = rows.unionByName(of(presses, "presses", F.lit("press"), False, "time_sec", "time_sec")).unionByName(of(first, "hours", F.concat(F.lit("hour "), "hour"), False, "time_sec", "time_sec"))
    cap = F.coalesce(*(F.when(F.col("section") == name, n) for name, n in caps.items()))
    return even_sample(rows.select(*columns), cap, ("recording_id", "section"), ("start_sec", "end_sec", "kind"))


def press_strips(presses: DataFrame, recordings: DataFrame, cap: int = C.MAX_STRIPS) -> DataFrame:
    """Presses of the diary button, evenly sampled, each with the strip around it; nothing on it is marked.

    ``recording_id, kind, label, start_sec, end_sec, position, total, strip_start, strip_end``.
    """
    t = F.col("time_sec")
    shown = even_sample(presses.select("recording_id", F.lit("press").alias("kind"), "label", t.alias("start_sec"), t.alias("end_sec")), cap, ("recording_id",), ("start_sec", "label"))
    return strips(shown, recordings, margin=0.0)


def hour_samples(beats: DataFrame, first_hour_sec: Column, cap: int = C.MAX_HOUR_STRIPS) -> DataFrame:
    """The first beat of every hour that has one, evenly sampled: ``recording_id, hour, time_sec, beat_idx, position, total``."""
    t = F.col("time_sec")
    hour = F.when(t < first_hour_sec, F.lit(0).cast("long")).otherwise(1 + F.floor((t - first_hour_sec) / 3600))
    first = beats.withColumn("hour", hour).groupBy("recording_id", "hour").agg(F.min(F.struct("time_sec", "beat_idx")).alias("f"))
    return even_sample(first.select("recording_id", "hour", "f.time_sec", "f.beat_idx"), cap, ("recording_id",), ("hour",))


def extremes(beats: DataFrame) -> DataFrame:
    """What a reader looks at first, a row each: ``recording_id, kind, start_sec, end_sec, value``.

    Fastest and slowest rate; the longest pause from the beat before it, if it is one; the longest
    sinus interval if escapes bridge it; the fastest run. Recordings with under five usable RRs have none.
    """
    rates = rhythm.rate_stats(beats)
    point = lambda kind, at, value: rates.select("recording_id", F.lit(kind).alias("kind"), F.col(at).alias("start_sec"), F.col(at).alias("end_sec"), F.col(value).alias("value"))
    gaps = beats.withColumn("__before", F.coalesce(F.lag("time_sec").over(rhythm.by()), F.col("time_sec"))).where(F.col("rr_sec") >= C.PAUSE_SEC)
    worst = gaps.groupBy("recording_id").agg(F.max(F.struct("rr_sec", (-F.col("time_sec")).alias("t"), "__before")).alias("w"))
    pause = worst.select("recording_id", F.lit("longest pause").alias("kind"), F.col("w.__before").alias("start_sec"), (-F.col("w.t")).alias("end_sec"), F.col("w.rr_sec").alias("value"))
    sinus = rhythm.sinus_summary(rhythm.sinus_intervals(beats)).where("longest_escapes > 0")
    bridged = sinus.select("recording_id", F.lit("longest sinus interval").alias("kind"), F.col("longest_start").alias("start_sec"), (F.col("longest_start") + F.col("longest_sec")).alias("end_sec"), F.col("longest_sec").alias("value"))
    runs = rhythm.runs(beats, ("V",)).where(F.col("bpm").isNotNull())
    fastest = runs.groupBy("recording_id").agg(F.max(F.struct("bpm", (-F.col("start_sec")).alias("s"), "end_sec")).alias("r"))
    run = fastest.select("recording_id", F.lit("fastest run").alias("kind"), (-F.col("r.s")).alias("start_sec"), F.col("r.end_sec").alias("end_sec"), F.col("r.bpm").alias("value"))
    others = pause.unionByName(bridged).unionByName(run).join(rates.select("recording_id"), "recording_id", "left_semi")
    return point("fastest rate", "max_time", "max_bpm").unionByName(point("slowest rate", "min_time", "min_bpm")).unionByName(others)


def strips(events: DataFrame, recordings: DataFrame, window: float = C.STRIP_SEC, margin: float = C.STRIP_MARGIN_SEC) -> DataFrame:
    """Add ``strip_start, strip_end``: a window centred on the event, wide enough for all of it, inside the recording."""
    half = F.greatest(F.lit(window), F.col("end_sec") - F.col("start_sec") + 2 * margin) / 2
    rows = events.join(recordings.select("recording_id", "duration_sec"), "recording_id")
    start = F.greatest(F.lit(0.0), (F.col("start_sec") + F.col("end_sec")) / 2 - half)
    return rows.withColumn("strip_start", start).withColumn("strip_end", F.least(F.col("duration_sec"), F.col("strip_start") + 2 * half)).drop("duration_sec")
