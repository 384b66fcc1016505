"""The queries of the library over the stand-in recordings, each with SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detection, evaluate, events, labels, measures, quality, report, rhythm
from ..ordered import shared_folder, written
from ..sources import cards, testbeds
from . import archive
from .screening import kept_presses, screen, summarize

#: Seconds of the fast stand-in that count as enough analysed time, in hours.
FAST_HOURS = 0.02
BRADY, TACHY = 50.0, 160.0
#: Caps that trip on the fast stand-in.
SECTION_CAPS = {"extremes": 24, "presses": 4, "runs": 2, "isolated": 5, "escapes": 3, "hours": 2}
#: Limits that trip on the stand-in windows and spans.
WINDOW_LIMITS = {"flat": 0.05, "tone": 2.0, "high": 1.2, "low": 0.85}
GAP_SEC = 0.5
#: Tail rule that trips on the stand-in windows; tolerance of matching on the fast stand-in.
TAIL = {"least": 2, "share": 0.2, "gap": 3}
TOLERANCE = 0.4


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])  # + 0.0: no negative zeros


def _durations(beats: DataFrame) -> DataFrame:
    return beats.groupBy("recording_id").agg(F.max("time_sec").alias("duration_sec"))


def _merged(beats: DataFrame) -> DataFrame:
    return quality.merge_spans(quality.with_edges(testbeds.spans(beats), _durations(beats), pad=0.25, edge=1.0), GAP_SEC)


def _rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = testbeds.windows(spark, sf_dir)
    return quality.window_stats(w.withColumn("samples", F.transform("samples", lambda x: F.round(x, 2))))


def beats_burden(spark, d):
    return _rounded(rhythm.burden(testbeds.beats(spark, d)))


def beats_runs(spark, d):
    return _rounded(rhythm.runs(testbeds.beats(spark, d)))


def beats_run_counts(spark, d):
    return _rounded(rhythm.run_counts(rhythm.runs(testbeds.beats(spark, d))))


def beats_pauses(spark, d):
    return _rounded(rhythm.pauses(testbeds.beats(spark, d)))


def beats_sustained(spark, d):
    b = testbeds.beats(spark, d)
    return _rounded(rhythm.sustained(b, "brady", BRADY).unionByName(rhythm.sustained(b, "tachy", TACHY)))


def beats_rate_stats(spark, d):
    return _rounded(rhythm.rate_stats(testbeds.beats(spark, d), BRADY, TACHY))


def beats_variability(spark, d):
    return _rounded(rhythm.variability(testbeds.beats(spark, d)))


def beats_sinus_intervals(spark, d):
    return _rounded(rhythm.sinus_intervals(testbeds.beats(spark, d)))


def beats_sinus_summary(spark, d):
    return _rounded(rhythm.sinus_summary(rhythm.sinus_intervals(testbeds.beats(spark, d))))


def beats_trend(spark, d):
    return _rounded(rhythm.trend(testbeds.beats(spark, d, 6e7)))


def _day_beats(spark: SparkSession, d: str) -> DataFrame:
    """The day-long stand-in; every tenth recording has lost its beats."""
    return testbeds.beats(spark, d, 6e7).where("cast(recording_id as long) % 10 <> 0")


def beats_hourly(spark, d):
    return _rounded(measures.hourly(_day_beats(spark, d), testbeds.recordings(spark, d)))


def beats_screening(spark, d):
    return _rounded(screen(testbeds.beats(spark, d), FAST_HOURS))


def beats_labelled(spark, d):
    return _rounded(labels.label_beats(testbeds.beats(spark, d)))


def beats_typical(spark, d):
    return _rounded(labels.typical(testbeds.beats(spark, d)).drop("start_us"))


def windows_bad(spark, d):
    return _rounded(quality.bad_windows(_rough(spark, d), **WINDOW_LIMITS).drop("samples"))


def windows_islands(spark, d):
    return quality.islands(quality.bad_windows(_rough(spark, d), **WINDOW_LIMITS), "bad")


def spans_merged(spark, d):
    return _rounded(_merged(testbeds.beats(spark, d)))


def spans_analyzed(spark, d):
    b = testbeds.beats(spark, d)
    return _rounded(quality.analyzed_seconds(_merged(b), _durations(b)))


def beats_excluded(spark, d):
    b = testbeds.beats(spark, d)
    return _rounded(quality.exclude_beats(b, _merged(b)).drop("start_us"))


def windows_kept(spark, d):
    return quality.kept_windows(quality.bad_windows(_rough(spark, d), **WINDOW_LIMITS), **TAIL)


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    sizes = [F.size("rr_list").alias("rrs"), F.array_max("qrs_list").alias("widest_sec")]
    return events.catalogue(testbeds.beats(spark, d)).select("*", *sizes).drop("rr_list", "qrs_list")


def events_catalogue(spark, d):
    return _rounded(_catalogue(spark, d))


def events_strips(spark, d):
    """Evenly sampled events of each label with their strips."""
    b = testbeds.beats(spark, d)
    shown = events.even_sample(rhythm.runs(b), 4, ("recording_id", "label"), ("start_sec",)).drop("bpm")
    return _rounded(events.strips(shown, _durations(b)))


def events_extremes(spark, d):
    return _rounded(events.extremes(testbeds.beats(spark, d)))


def events_hour_samples(spark, d):
    b = testbeds.beats(spark, d, 6e7)
    into = F.pmod(F.col("start_us"), F.lit(3_600_000_000)) / 1e6
    return events.hour_samples(b, F.lit(3600.0) - into, 6).drop("time_sec")


def detection_scores(spark, d):
    b = testbeds.beats(spark, d)
    return _rounded(evaluate.detection(b.where("label = 'V'"), b.where("label = 'E'"), TOLERANCE))


def _hours(spark: SparkSession, d: str) -> DataFrame:
    """Hours of the day-long stand-in with what is left of them outside the spans."""
    b = _day_beats(spark, d)
    spans = quality.merge_spans(testbeds.spans(b, length=600.0))
    return quality.analyzed_within(measures.hourly(b, testbeds.recordings(spark, d)), spans)


def hourly_analyzed(spark, d):
    return _rounded(_hours(spark, d).select("recording_id", "hour", "start_sec", "end_sec", "analyzed_sec"))


def hourly_text(spark, d):
    return report.hourly_table(_hours(spark, d).join(testbeds.recordings(spark, d).select("recording_id", "start_time"), "recording_id"))


def _sustained(beats: DataFrame) -> DataFrame:
    return rhythm.sustained(beats, "brady", BRADY).unionByName(rhythm.sustained(beats, "tachy", TACHY))


def timeline_lanes(spark, d):
    b = testbeds.beats(spark, d)
    return _rounded(report.lanes(b, _sustained(b), b.where("label = 'U'")))


def timeline_spans(spark, d):
    b = written(testbeds.beats(spark, d), "beats")  # sorted once, and no task holds that sort beside the one of stretches
    return _rounded(report.spans(_durations(b), b, _sustained(b)))


def strip_beats(spark, d):
    """Beats on the strips around V runs."""
    b = testbeds.beats(spark, d)
    runs = rhythm.runs(b, ("V",)).withColumns({"strip_id": F.col("start_sec").cast("string"), "marks": F.array("start_sec", "end_sec")})
    return _rounded(report.strip_beats(events.strips(runs, _durations(b)), b).drop("strip_id").distinct())


def _waveform(spark: SparkSession, d: str) -> DataFrame:
    size = F.size("samples")
    rows = testbeds.windows(spark, d).withColumn("samples", F.transform("samples", lambda x: F.round(x, 2)))
    return rows.select("recording_id", F.lit(0).alias("channel"), (F.col("window_idx") * size).alias("first_sample"), "samples")


def strip_waveforms(spark, d):
    """Strips of six seconds around ten windows spread over each stand-in, at 16 samples a second."""
    w = testbeds.windows(spark, d).select("recording_id", "window_idx")
    shown = events.even_sample(w, 10, ("recording_id",), ("window_idx",)).select("recording_id", F.col("window_idx").alias("strip_id"), (F.col("window_idx") * 4.0).alias("strip_start"), (F.col("window_idx") * 4.0 + 6).alias("strip_end"))
    got = report.strip_waveforms(shown, _waveform(spark, d), 16.0)
    x = F.col("samples")
    return _rounded(got.select("recording_id", "strip_id", "channel", F.size(x).alias("n"), F.array_min(x).alias("lowest"), F.array_max(x).alias("highest"), x[0].alias("first"), "range_mv"))


def _summary(spark: SparkSession, d: str) -> DataFrame:
    """Summary of the fast stand-in; its recordings have the weight classes of the day-long one."""
    b = written(testbeds.beats(spark, d), "beats")
    left = quality.analyzed_seconds(_merged(b), _durations(b))
    of = testbeds.recordings(spark, d, 3e10).select("recording_id", "start_time", "weight_class")
    kept = written(left.join(of, "recording_id").withColumn("trimmed_sec", F.col("excluded_sec") * (F.col("recording_id").cast("long") % 2)).drop("excluded_sec"), "recordings")
    return summarize(b, kept, written(b.where("label = 'U'").select("recording_id", "time_sec"), "presses"), FAST_HOURS)


def recordings_summary(spark, d):
    """The wide summary row of every recording."""
    return _rounded(_summary(spark, d).drop("start_time", "duration_sec", "trimmed_sec", "analyzed_sec", "weight_class"))


def report_panels(spark, d):
    return report.panels(_summary(spark, d))


def strip_sections(spark, d):
    """Strips of the six sections of a report, each with its own even sample."""
    b = testbeds.beats(spark, d)
    hours = testbeds.recordings(spark, d, 3e10).select("recording_id", F.lit(7.5).alias("first_hour_sec"))
    flagged = events.catalogue(b)
    shown = events.sections(flagged, events.extremes(b), b.where("label = 'U'"), b, hours, SECTION_CAPS)
    return _rounded(events.strips(shown, _durations(b)).drop("marked"))


def waveform_planted(spark, d):
    """Beats found in planted pulse trains: times to a tenth of a second, wide ones told from narrow ones."""
    found = detection.detect(written(testbeds.pulses(spark, d), "pulses", "zstd"), float(testbeds.PULSE_RATE))
    return found.select("recording_id", "beat_idx", F.round("time_sec", 1).alias("time_sec"), F.round("rr_sec", 1).alias("rr_sec"), (F.col("qrs_sec") > 0.16).alias("wide"))


def beats_class_rates(spark, d):
    """Slow and fast stretches and windows by the limits of each recording's weight class."""
    limited = testbeds.beats(spark, d).join(rhythm.limits(testbeds.recordings(spark, d)).select("recording_id", "brady_bpm", "tachy_bpm"), "recording_id")
    stretches = rhythm.sustained(limited, "brady", F.col("brady_bpm")).unionByName(rhythm.sustained(limited, "tachy", F.col("tachy_bpm")))
    counts = stretches.groupBy("recording_id").agg(F.count_if(F.col("kind") == "brady").alias("brady_events"), F.count_if(F.col("kind") == "tachy").alias("tachy_events"))
    rates = rhythm.rate_stats(limited, "brady_bpm", "tachy_bpm").select("recording_id", "slow_windows", "under_60_windows", "fast_windows", "windows")
    return rates.join(counts, "recording_id", "left").na.fill(0, ["brady_events", "tachy_events"])


#: Samples a second of the stand-in waveforms where they are cut into windows of five seconds: 100 samples.
CUT_RATE = 20.0


def waveform_windows(spark, d):
    """Windows cut across the chunks of the stand-in waveforms."""
    got = quality.window_stats(quality.cut(_waveform(spark, d), CUT_RATE))
    return _rounded(got.select("recording_id", "window_idx", F.col("samples")[0].alias("first"), "ptp", "flat_share", "tone_ratio"))


def waveform_contract(spark, d):
    """Two leads a recording, of which some have lost a chunk; every fourth recording lacks a name."""
    w = _waveform(spark, d)
    label = F.col("recording_id").cast("int")
    second = w.withColumn("channel", F.lit(1)).where((label % 3 != 0) | (F.col("first_sample") != 64))
    names = F.when(label % 4 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return quality.contract(w.select("recording_id").distinct().withColumn("channel_names", names), w.unionByName(second), CUT_RATE)


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    label = F.col("recording_id").cast("int")
    return quality.recorded(_waveform(spark, d), CUT_RATE).select("recording_id", (F.col("recorded_sec") * (0.3 + 0.05 * label)).alias("duration_sec"))


def waveform_trimmed(spark, d):
    """What is left of the stand-in waveforms up to a duration."""
    got = report.trim(_waveform(spark, d), _lengths(spark, d), CUT_RATE)
    return got.groupBy("recording_id").agg(F.sum(F.size("samples")).alias("n"), F.max("first_sample").alias("last_chunk"), F.max_by(F.size("samples"), "first_sample").alias("in_last"))


def recordings_assessed(spark, d):
    """Durations of the stand-in waveforms and of recordings without a full window, judged by the rules as they are."""
    w = _waveform(spark, d)
    sizes = quality.recorded(w, CUT_RATE).select("recording_id", "recorded_sec")
    more = sizes.select(F.concat(F.lit("short "), "recording_id").alias("recording_id"), (F.col("recorded_sec") * 0 + F.length("recording_id") - 1).alias("recorded_sec"))
    lengths, spans = quality.assess(quality.cut(w, CUT_RATE), sizes.unionByName(more))
    total = spans.groupBy("recording_id").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("end_sec") - F.col("start_sec")).alias("excluded_sec"))
    return _rounded(lengths.join(total, "recording_id", "left").na.fill(0))


def presses_kept(spark, d):
    """Presses (the U beats) before two thirds of the recording."""
    b = testbeds.beats(spark, d)
    lengths = _durations(b).withColumn("duration_sec", F.col("duration_sec") * 2 / 3)
    return _rounded(kept_presses(b.where("label = 'U'").select("recording_id", "beat_idx", "time_sec"), lengths))


def events_presses(spark, d):
    b = testbeds.beats(spark, d)
    rows = b.where("label = 'U'").select("recording_id", "time_sec", F.concat(F.lit("press "), "beat_idx").alias("label"))
    return _rounded(events.press_strips(rows, _durations(b), 5))


def labels_accepted(spark, d):
    """Flagged (wide beats) against true ones (V beats)."""
    b = testbeds.beats(spark, d)
    return evaluate.labels_accepted(b.where("label = 'V'"), b.where("label = 'V' and (beat_idx % 9 <> 0 or cast(recording_id as long) % 2 = 0)").withColumn("time_sec", F.col("time_sec") + F.when(F.col("recording_id").cast("long") % 5 == 0, 0.3).otherwise(0.0)), 0.15)


def windows_by_clock(spark, d):
    """Named windows by offset and by the clock."""
    of = testbeds.recordings(spark, d)
    number = F.col("recording_id").cast("int")
    clock = F.when(number % 2 == 0, F.format_string("%02d:%02d:07", number % 24, number % 60))
    named = of.select("recording_id", F.lit("seen").alias("name"), F.when(number % 2 == 1, number * 1.5).alias("offset_sec"), clock.alias("clock"), F.lit(30.0).alias("length_sec"))
    return _rounded(report.clock_windows(named, of.withColumn("start_time", F.date_trunc("second", "start_time").cast("timestamp_ntz"))))


def strip_scales(spark, d):
    """Speed and gain of the strips of the stand-in waveforms."""
    w = testbeds.windows(spark, d).select("recording_id", "window_idx").where("window_idx % 5 = 0")
    shown = w.select("recording_id", F.col("window_idx").alias("strip_id"), (F.col("window_idx") * 4.0).alias("strip_start"), (F.col("window_idx") * 4.0 + 6).alias("strip_end"))
    tall = _waveform(spark, d).withColumn("samples", F.transform("samples", lambda x: x * 12))
    got = report.strip_waveforms(shown, tall, 16.0)
    return got.select("recording_id", "strip_id", report.scale_text(F.lit(6.0), F.col("range_mv")).alias("scale"))


def start_overrides(spark, d):
    """Starts under overrides: a clock time, a whole time, one that can't be read, or none."""
    of = testbeds.recordings(spark, d).select("recording_id", "start_time")
    number = F.col("recording_id").cast("int")
    text = F.when(number % 4 == 0, F.format_string("%d:%02d", number % 24, number % 60)).when(number % 4 == 1, F.format_string("2026-08-%02d 07:08:%02d", number % 28 + 1, number % 60)).when(number % 4 == 2, F.lit("soon"))
    got = report.start_times(of, of.select("recording_id", text.alias("text")).where("text is not null"))
    return got.select("recording_id", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_text"), "rejected")


def _open_cards(spark: SparkSession, d: str, packed: bool = False) -> dict[str, DataFrame]:
    return archive.open_cards(testbeds.cards(spark, d), testbeds.card_names(spark, d), packed)


def card_kinds(spark, d):
    """What a card is by its name and its first block: some have the fixed name, some another ending."""
    user = F.col("path").cast("long")
    name = F.when(user % 4 == 0, "Flash.DAT").when(user % 4 == 1, "copy.bin").otherwise(F.concat("path", F.lit(".dat")))
    images = testbeds.cards(spark, d).select("path", F.concat(F.lit("in/"), "path", F.lit("/"), name).alias("file"), F.substring("content", 1, cards.BLOCK).alias("head"))
    return images.select("path", cards.kind_of(F.col("file"), F.col("head")).alias("kind"))


def archive_grown(spark, d):
    """An archive after two commits, the second with every third recording anew, a replay of the first, and one that was never published."""
    grown = archive.Archive(spark, f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}")
    found = rhythm.burden(testbeds.beats(spark, d)).select("recording_id", "pvc_count")
    grown.commit({"summary": found}, "1")
    grown.commit({"summary": found.where("cast(recording_id as long) % 3 = 0").withColumn("pvc_count", F.col("pvc_count") + 100)}, "2")
    grown.commit({"summary": found.withColumn("pvc_count", F.col("pvc_count") - 1)}, "1")
    grown.write({"summary": found.withColumn("pvc_count", -F.col("pvc_count"))}, "3")
    return grown.read("summary")


def card_blocks(spark, d):
    """What is on the cards, block by block, before the session is found."""
    return cards.blocks(testbeds.cards(spark, d)).select("path", "block_idx", "ecg", "empty", "error", "sequence", "detail", "press", "live")


def card_sessions(spark, d):
    kept = cards.opened(testbeds.cards(spark, d))
    return kept.groupBy("path").agg(F.count_if("ecg").alias("blocks"), F.max("block_idx").alias("last_block"), F.max("ordinal").alias("last_ordinal"))


def card_headers(spark, d):
    got = cards.headers(cards.opened(testbeds.cards(spark, d)))
    return got.select("path", F.try_element_at("fields", F.lit("SampleRate")).alias("rate"), F.try_element_at("fields", F.lit("start_date")).alias("start_date"), F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_text"))


def card_rejects(spark, d):
    return cards.rejects(testbeds.card_names(spark, d), cards.opened(testbeds.cards(spark, d)))


def card_presses(spark, d):
    return _rounded(_open_cards(spark, d)["presses"])


def card_waveforms(spark, d):
    """Measures of every decoded chunk of the cards that can be used."""
    x = F.col("samples")
    got = _open_cards(spark, d)["waveform"]
    return _rounded(got.select("recording_id", "channel", "first_sample", F.size(x).alias("n"), x[0].alias("first"), x[303].alias("last"), F.array_min(x).alias("lowest"), F.array_max(x).alias("highest")))


def card_tables(spark, d):
    """Rows of each table of a whole job over the cards, from blocks to strips."""
    opened = _open_cards(spark, d, packed=True)
    tables = archive.analyse(written(opened["waveform"], "waveform", "zstd"), opened["recordings"], opened["presses"])
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def waveform_beats(spark, d):
    """Beats found in the stand-in waveforms, taken at 180 samples a second."""
    return _rounded(detection.detect(_waveform(spark, d), 180.0))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        beats_burden, beats_runs, beats_run_counts, beats_pauses, beats_sustained, beats_rate_stats, beats_variability, beats_sinus_intervals, beats_sinus_summary,
        beats_trend, beats_hourly, beats_screening, beats_labelled, beats_typical, windows_bad, windows_islands, spans_merged, spans_analyzed, beats_excluded,
        windows_kept, events_catalogue, events_strips, events_extremes, events_hour_samples, detection_scores,
        hourly_analyzed, hourly_text, timeline_lanes, timeline_spans, strip_beats, strip_waveforms, recordings_summary, report_panels, strip_sections, waveform_beats, waveform_planted,
        beats_class_rates, waveform_windows, waveform_contract, waveform_trimmed, recordings_assessed, presses_kept, events_presses, labels_accepted, windows_by_clock, strip_scales, start_overrides,
        archive_grown, card_kinds, card_blocks, card_sessions, card_headers, card_rejects, card_presses, card_waveforms, card_tables,
    )
    return {f.__name__: f for f in found}
