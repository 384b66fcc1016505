"""Signal quality: windows that can't be trusted, the spans they make, beats inside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from .. import samples
from ..ordered import written


def with_rate(waveform: DataFrame, rate: float | None) -> DataFrame:
    """``waveform`` with a ``rate`` column: its own, constant in a recording, or one rate for all."""
    return waveform if rate is None else waveform.withColumn("rate", F.lit(float(rate)))


def _variance(values: Column) -> Column:
    """Population variance of an array."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return F.transform(F.array(mean), lambda m: F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))[0] / F.size(values)


def cut(waveform: DataFrame, rate: float | None = None, window_sec: float = C.WINDOW_SEC) -> DataFrame:
    """``recording_id, window_idx, samples``: the first lead's chunks as full windows; an incomplete last one is left out."""
    waveform = with_rate(waveform, rate)
    lead = waveform.groupBy("recording_id").agg(F.min("channel").alias("channel"))
    n, size, packed = samples.count(waveform), F.col("size"), samples.is_packed(waveform)
    rows = waveform.join(lead, ["recording_id", "channel"]).where(n > 0).withColumn("size", F.floor(F.lit(window_sec) * F.col("rate")))
    last = F.col("first_sample") + n - 1
    touched = F.sequence(F.floor(F.col("first_sample") / size), F.floor(last / size))
    pieces = rows.select("recording_id", "size", "first_sample", "samples", last.alias("last"), F.explode(touched).alias("window_idx"))
    low = F.greatest(F.col("first_sample"), F.col("window_idx") * size)
    high = F.least(F.col("last"), (F.col("window_idx") + 1) * size - 1)
    part = samples.part(waveform, low - F.col("first_sample"), high - low + 1)
    met = pieces.select("recording_id", "size", "window_idx", F.struct(low.alias("at"), part.alias("x")).alias("p"))
    whole = met.groupBy("recording_id", "window_idx", "size").agg(samples.put_together(F.collect_list("p"), packed).alias("samples"))
    return whole.where(samples.count(whole) == size).drop("size")


def recorded(waveform: DataFrame, rate: float | None = None) -> DataFrame:
    """``recording_id, recorded_sec, channels, rejected``: how long each recording is by its samples, and what is wrong with it.

    Leads of unlike length or rate, or samples missing within one, are rejected.
    """
    waveform = with_rate(waveform, rate)
    n = samples.count(waveform)
    of_lead = waveform.groupBy("recording_id", "channel").agg(
        F.sum(F.coalesce(n, F.lit(0))).alias("n"), F.max(F.col("first_sample") + n).alias("end"), F.min("rate").alias("rate"), F.max("rate").alias("other")
    )
    rows = of_lead.groupBy("recording_id").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.bool_or(F.col("n") != F.col("end")).alias("gap"), F.count(F.lit(1)).alias("channels"), F.min("rate").alias("rate"), F.max("other").alias("other")
    )
    reason = F.when(F.col("rate") != F.col("other"), "leads of unlike rate").when(F.col("least") != F.col("most"), "leads of unlike length").when(F.col("gap"), "samples missing")
    return rows.select("recording_id", (F.col("most") / F.col("rate")).alias("recorded_sec"), "channels", reason.alias("rejected"))


def contract(recordings: DataFrame, waveform: DataFrame, rate: float | None = None) -> DataFrame:
    """``recording_id, reason`` of recordings (``recording_id, channel_names``) whose leads don't fit together or lack a name."""
    rows = recordings.select("recording_id", "channel_names").join(recorded(waveform, rate), "recording_id", "left")
    unnamed = F.coalesce(F.size("channel_names"), F.lit(0)) != F.col("channels")
    reason = F.when(F.col("channels").isNull(), "no samples").otherwise(F.coalesce("rejected", F.when(unnamed, "a name for each lead is missing")))
    return rows.select("recording_id", reason.alias("reason")).where("reason is not null")


STATS = ("ptp", "flat_share", "tone_ratio")
#: Windows measured at once.
MEASURED = 512


def _spread(x: np.ndarray) -> np.ndarray:
    """Population variance of each row, summed from left to right as :func:`_variance` does."""
    away = x - (np.cumsum(x, axis=1)[:, -1] / x.shape[1])[:, None]
    return np.cumsum(away * away, axis=1)[:, -1] / x.shape[1]


def _packed_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, values = samples.flat(batch["samples"])
        sizes, out = np.diff(ends), np.zeros((len(STATS), batch.num_rows))
        for n in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == n)
            for rows in np.split(of, range(MEASURED, len(of), MEASURED)) if n else ():
                x = values[ends[rows][:, None] + np.arange(n)]
                out[0, rows] = x.max(axis=1) - x.min(axis=1)
                if n > 1:
                    d, spread = np.diff(x, axis=1), _spread(x)
                    out[1, rows] = (d == 0).sum(axis=1) / (n - 1)
                    out[2, rows] = np.divide(_spread(d), spread, out=np.zeros(len(rows)), where=spread != 0)
        none = sizes == 0
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[0], mask=none), pa.array(out[1]), pa.array(out[2])], names=[*batch.schema.names, *STATS])


def window_stats(windows: DataFrame) -> DataFrame:
    """Add ``ptp, flat_share, tone_ratio`` to ``recording_id, window_idx, samples``; map-side only.

    Peak to peak; share of sample-to-sample differences that are 0; variance of the differences
    over variance of the samples (0 if that is 0). Packed samples are measured in numpy, in the same order.
    """
    if samples.is_packed(windows):
        return windows.mapInArrow(_packed_stats, ", ".join(f"{c} {t}" for c, t in [*windows.dtypes, *((c, "double") for c in STATS)]))
    x = F.col("samples")
    n = F.size(x)
    rows = windows.withColumn("__d", F.zip_with(F.slice(x, F.lit(2), n - 1), F.slice(x, F.lit(1), n - 1), lambda a, b: a - b))
    var = _variance(x)
    return rows.withColumns(
        {
            "ptp": F.array_max(x) - F.array_min(x),
            "flat_share": F.when(n > 1, F.size(F.filter("__d", lambda d: d == 0)) / F.greatest(F.size("__d"), F.lit(1))).otherwise(0.0),
            "tone_ratio": F.transform(F.array(var), lambda v: F.when((v == 0) | (n < 2), F.lit(0.0)).otherwise(_variance(F.col("__d")) / v))[0],
        }
    ).drop("__d")


def bad_windows(stats: DataFrame, flat: float = C.FLAT_SHARE, tone: float = C.TONE_RATIO, high: float = C.HIGH_RATIO, low: float = C.LOW_RATIO) -> DataFrame:
    """Add ``lead_off, bad``: flat or toned, or an amplitude far from the recording's median over the others.

    If no window is left for the median, or it is 0, the whole recording is bad.
    """
    marked = stats.withColumn("lead_off", F.col("tone_ratio") > tone).withColumn("__out", F.col("lead_off") | (F.col("flat_share") > flat))
    middle = marked.groupBy("recording_id").agg(F.coalesce(F.median(F.when(~F.col("__out"), F.col("ptp"))), F.lit(0.0)).alias("__mid"))
    mid, ptp = F.col("__mid"), F.col("ptp")
    return marked.join(middle, "recording_id").withColumn("bad", (mid <= 0) | F.col("__out") | (ptp > high * mid) | (ptp < low * mid)).drop("__out", "__mid")


def islands(flags: DataFrame, flag: str, index: str = "window_idx") -> DataFrame:
    """Runs of true rows: ``recording_id, first, after`` (end exclusive)."""
    by = Window.partitionBy("recording_id").orderBy(index)
    keyed = flags.where(F.col(flag)).withColumn("__key", F.col(index) - F.row_number().over(by))
    return keyed.groupBy("recording_id", "__key").agg(F.min(index).alias("first"), (F.max(index) + 1).alias("after")).drop("__key")


def merge_spans(spans: DataFrame, gap: float = C.MERGE_SEC) -> DataFrame:
    """Union of spans that overlap or stand at most ``gap`` seconds apart."""
    by = Window.partitionBy("recording_id").orderBy("start_sec", "end_sec")
    reach = F.max("end_sec").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start_sec") - F.col("__reach") <= gap, 0).otherwise(1)
    keyed = spans.withColumn("__reach", reach).withColumn("__island", F.sum(new).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return keyed.groupBy("recording_id", "__island").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec")).drop("__island")


def with_edges(spans: DataFrame, recordings: DataFrame, pad: float = C.PAD_SEC, edge: float = C.EDGE_SEC) -> DataFrame:
    """Pad spans and clamp them to the recording (``recording_id, duration_sec``); add its first and last seconds."""
    d = F.col("duration_sec")
    padded = spans.join(recordings, "recording_id").select("recording_id", F.greatest(F.col("start_sec") - pad, F.lit(0.0)).alias("start_sec"), F.least(F.col("end_sec") + pad, d).alias("end_sec"))
    ends = recordings.select("recording_id", F.explode(F.array(F.struct(F.lit(0.0).alias("s"), F.least(F.lit(edge), d).alias("e")), F.struct(F.greatest(d - edge, F.lit(0.0)).alias("s"), d.alias("e")))).alias("x"))
    return padded.unionByName(ends.select("recording_id", F.col("x.s").alias("start_sec"), F.col("x.e").alias("end_sec")))


def analyzed_seconds(spans: DataFrame, recordings: DataFrame) -> DataFrame:
    """``recording_id, duration_sec, excluded_sec, analyzed_sec`` from merged spans."""
    lost = spans.groupBy("recording_id").agg(F.sum(F.col("end_sec") - F.col("start_sec")).alias("lost"))
    gone = F.coalesce(F.col("lost"), F.lit(0.0))
    return recordings.join(lost, "recording_id", "left").select("recording_id", "duration_sec", gone.alias("excluded_sec"), (F.col("duration_sec") - gone).alias("analyzed_sec"))


def exclude_beats(beats: DataFrame, spans: DataFrame) -> DataFrame:
    """Drop beats in a span (ends included); a kept beat whose gap to the kept one before holds a span loses its RR.

    Beats and spans of a recording go by in one order of time; the latest end of the spans begun so
    far says whether a beat is in one, and whether one lies behind it. Spans may overlap.
    """
    begun = spans.select("recording_id", F.col("start_sec").alias("__t"), F.lit(0).alias("__kind"), F.col("end_sec").alias("__end"))
    rows = begun.unionByName(beats.withColumns({"__t": F.col("time_sec"), "__kind": F.lit(1)}), allowMissingColumns=True)
    order = Window.partitionBy("recording_id").orderBy("__t", "__kind", "beat_idx")
    reach = F.max("__end").over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("__reach", reach).where("__kind = 1 and (__reach is null or __reach < __t)")
    cut = F.coalesce(F.col("__reach") > F.lag("__t").over(order), F.lit(False))
    return kept.withColumn("rr_sec", F.when(~cut, F.col("rr_sec"))).select(*beats.columns)


def kept_windows(flags: DataFrame, least: int = C.TAIL_WINDOWS, share: float = C.TAIL_SHARE, gap: int = C.REMOVAL_WINDOWS) -> DataFrame:
    """``recording_id, windows, kept``: where the off-body tail begins (``kept = windows`` if there is none).

    The tail is the earliest run of ``least`` lead-off windows after whose start ``share`` of the
    rest are lead-off. It moves back over bad windows, across fewer than ``gap`` good ones in a row.
    Recordings that are bad throughout keep all windows.
    """
    by = Window.partitionBy("recording_id").orderBy("window_idx")
    off = F.col("lead_off").cast("int")
    rows = flags.select("recording_id", "window_idx", "lead_off", "bad", F.coalesce(F.sum(off).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    whole = rows.groupBy("recording_id").agg(F.count(F.lit(1)).alias("windows"), F.sum(off).alias("__off"), F.bool_and("bad").alias("__all"))
    runs = islands(rows, "lead_off").where(F.col("after") - F.col("first") >= least)
    starts = runs.join(rows.withColumnRenamed("window_idx", "first"), ["recording_id", "first"]).join(whole, "recording_id")
    held = ~F.col("__all") & (F.col("__off") - F.col("__before") >= share * (F.col("windows") - F.col("first")))
    tails = starts.where(held).groupBy("recording_id").agg(F.min("first").alias("tail"))
    bad = rows.where("bad").join(tails, "recording_id").where(F.col("window_idx") < F.col("tail"))
    after = F.coalesce(F.lead("window_idx").over(by), F.col("tail"))
    back = Window.partitionBy("recording_id").orderBy(F.col("window_idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    far = bad.withColumn("__far", (after - F.col("window_idx") - 1 >= gap).cast("int")).withColumn("__stops", F.sum("__far").over(back))
    moved = far.where("__stops = 0").groupBy("recording_id").agg(F.min("window_idx").alias("moved"))
    return whole.join(tails, "recording_id", "left").join(moved, "recording_id", "left").select("recording_id", "windows", F.coalesce("moved", "tail", "windows").alias("kept"))


def assess(windows: DataFrame, recordings: DataFrame, window_sec: float = C.WINDOW_SEC) -> tuple[DataFrame, DataFrame]:
    """Judge recordings (``recording_id, recorded_sec``) by their full windows (``recording_id, window_idx, samples``).

    Returns ``recording_id, duration_sec, trimmed_sec`` and the merged spans to leave out. A
    recording without a full window is left out whole; one of no length has no span. The measures of
    windows, the flags and what is kept are written: each is asked for several times, and samples once.
    """
    stats = written(window_stats(windows).drop("samples"), "window-stats")
    flags = written(bad_windows(stats).select("recording_id", "window_idx", "lead_off", "bad"), "window-flags")
    kept = written(kept_windows(flags), "windows-kept")
    lasts = F.when(F.col("kept") < F.col("windows"), F.col("kept") * window_sec).otherwise(F.col("recorded_sec"))
    judged = recordings.join(kept, "recording_id", "left").withColumn("duration_sec", lasts)
    i = F.col("window_idx")
    found = flags.where("bad").join(kept, "recording_id").where(i < F.col("kept")).select("recording_id", (i * window_sec).alias("start_sec"), ((i + 1) * window_sec).alias("end_sec"))
    lengths = judged.select("recording_id", "duration_sec", (F.col("recorded_sec") - F.col("duration_sec")).alias("trimmed_sec"))
    return lengths, merge_spans(with_edges(found, lengths.where("duration_sec > 0")))


def analyzed_within(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Add ``analyzed_sec`` to rows with ``recording_id, start_sec, end_sec``: their length less the merged spans in it."""
    arrays = spans.groupBy("recording_id").agg(F.collect_list(F.struct("start_sec", "end_sec")).alias("__spans"))
    a, b = F.col("start_sec"), F.col("end_sec")
    lost = F.aggregate("__spans", F.lit(0.0), lambda total, s: total + F.greatest(F.lit(0.0), F.least(s["end_sec"], b) - F.greatest(s["start_sec"], a)))
    return rows.join(arrays, "recording_id", "left").withColumn("analyzed_sec", b - a - F.coalesce(lost, F.lit(0.0))).drop("__spans")
