"""From cards or waveforms to the tables of a screening: windows, trimming, beats, labels, summaries, strips, and an archive that grows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import detection, events, labels, measures, quality, report, rhythm
from ..ordered import written
from ..sources import cards
from .screening import kept_presses, summarize


def open_cards(found: DataFrame, names: DataFrame | None = None, packed: bool = False) -> dict[str, DataFrame]:
    """``waveform, recordings, presses, rejects`` of cards (``path, content, kind``); each card is cut into blocks once.

    ``names`` (``path, kind``) are the same cards where a list of them costs less than the images; ``packed``
    samples are binary (:mod:`samples`).

    The path of a card is its ``recording_id``. Cards that can't be used are in ``rejects`` alone.
    """
    kept = cards.opened(found)
    rejects = written(cards.rejects(found if names is None else names, kept), "rejects")
    good = cards.usable(kept, rejects)
    name = F.col("path").alias("recording_id")
    channels = F.array(*[F.lit(n) for n in cards.CHANNEL_NAMES]).alias("channel_names")
    return {
        "waveform": cards.waveform(good, packed).select(name, "channel", "first_sample", "samples"),
        "recordings": cards.headers(good).select(name, "start_time", channels),
        "presses": cards.presses(good).select(name, "time_sec", "type_index", "label", "detail"),
        "rejects": rejects,
    }


def analyse(waveform: DataFrame, recordings: DataFrame, presses: DataFrame, rate: float | None = float(cards.RATE), min_hours: float = C.MIN_HOURS) -> dict[str, DataFrame]:
    """The tables of all recordings (``recording_id, start_time``, and ``weight_class`` where known).

    ``rate`` is the sample rate of all of them; if it is None, ``waveform`` has a ``rate`` column. Samples are
    arrays, or packed (:mod:`samples`).

    ``quality, spans, beats, presses, summary, panels, hours, hours_text, trend, lanes, timeline, events,
    extremes, strips, strip_beats, waveforms``. Recordings whose leads don't fit together are in ``rejects``
    and nowhere else. Strips are those of all sections of a report (:func:`events.sections`).
    """
    waveform = quality.with_rate(waveform, rate)
    if "weight_class" not in recordings.columns:
        recordings = recordings.withColumn("weight_class", F.lit("medium"))
    sizes = written(quality.recorded(waveform), "recorded")
    good = sizes.where("rejected is null").select("recording_id", "recorded_sec")
    waveform = waveform.join(good.select("recording_id"), "recording_id", "left_semi")
    lengths, spans = quality.assess(quality.cut(waveform), good)
    lengths, spans = written(lengths, "lengths"), written(spans, "spans")
    kept = report.trim(waveform, lengths)
    beats = written(labels.label_beats(quality.exclude_beats(detection.detect(kept), spans)).drop("rr_base", "qrs_base"), "beats")
    left = quality.analyzed_seconds(spans, lengths.select("recording_id", "duration_sec")).select("recording_id", "analyzed_sec")
    of = lengths.join(left, "recording_id").join(recordings, "recording_id")
    presses = kept_presses(presses, lengths)
    summary = written(summarize(beats, of, presses, min_hours), "summary")
    grid = of.select("recording_id", "start_time", "duration_sec", rhythm.first_hour_sec(F.col("start_time")).alias("first_hour_sec"))
    hours = quality.analyzed_within(measures.hourly(beats, grid), spans).join(grid.select("recording_id", "start_time"), "recording_id")
    hours = written(hours, "hours")
    flagged, extremes = events.catalogue(beats), events.extremes(beats)
    shown = events.sections(flagged, extremes, presses, beats, grid)
    name = F.concat_ws(" ", "section", F.format_string("%.3f", "start_sec"), "kind")
    marks = F.when(F.col("marked"), F.array("start_sec", "end_sec")).otherwise(F.array().cast("array<double>"))
    strips = written(events.strips(shown, lengths).withColumns({"strip_id": name, "marks": marks}).drop("marked"), "strips")
    limits = rhythm.limits(of.select("recording_id", "weight_class")).select("recording_id", "brady_bpm", "tachy_bpm")
    limited = beats.join(limits, "recording_id")
    sustained = rhythm.sustained(limited, "brady", F.col("brady_bpm")).unionByName(rhythm.sustained(limited, "tachy", F.col("tachy_bpm")))
    return {
        "rejects": sizes.where("rejected is not null"), "quality": lengths.join(left, "recording_id"), "spans": spans, "beats": beats, "presses": presses, "summary": summary, "panels": report.panels(summary),
        "hours": hours, "hours_text": report.hourly_table(hours), "trend": rhythm.trend(beats), "lanes": report.lanes(beats, sustained, presses), "timeline": report.spans(lengths.select("recording_id", "duration_sec"), beats, sustained),
        "events": flagged, "extremes": extremes, "strips": strips, "strip_beats": report.strip_beats(strips, beats), "waveforms": report.strip_waveforms(strips, kept),
    }


class Archive:
    """Tables under a folder, added to commit by commit; a recording counts as its last published commit has it.

    A commit first writes its own folders, which no reader looks at, and then publishes one file that
    names its recordings; that a job dies in between, or is run again, changes nothing for readers. One
    job commits at a time.
    """

    published = "recording_id string, commit string, seq long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @staticmethod
    def _named(commit: str) -> str:
        """The commit as its folders are named: never a number or a date, which readers would take for one."""
        if not commit.replace("-", "").isalnum():
            raise ValueError(f"commits are named by letters, digits and dashes: {commit!r}")
        return f"c-{commit}"

    def published_before(self, commit: str) -> bool:
        return not self.manifest().where(F.col("commit") == self._named(commit)).isEmpty()

    def manifest(self) -> DataFrame:
        """``recording_id, commit, seq`` of everything published."""
        try:
            return self.spark.read.schema(self.published).parquet(f"{self.folder}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.published)

    def write(self, tables: dict[str, DataFrame], commit: str) -> None:
        """Write the commit's own folders, in files of even size with a recording's rows side by side."""
        for name, rows in tables.items():
            rows.hint("rebalance", "recording_id").sortWithinPartitions("recording_id").write.mode("overwrite").parquet(f"{self.folder}/tables/{name}/commit={self._named(commit)}")

    def publish(self, tables: dict[str, DataFrame], commit: str) -> None:
        """Name the commit's recordings, those of its ``summary`` and ``rejects``, in one file."""
        seq = (self.manifest().agg(F.max("seq")).first()[0] or 0) + 1
        folders = [f"{self.folder}/tables/{name}/commit={self._named(commit)}" for name in ("summary", "rejects") if name in tables]
        ids = [self.spark.read.parquet(f).select("recording_id") for f in folders]
        names = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
        names.distinct().select("recording_id", F.lit(seq).cast("long").alias("seq")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/commit={self._named(commit)}")

    def commit(self, tables: dict[str, DataFrame], commit: str) -> bool:
        """Add the tables under a commit's name; False, and nothing is written, if it was published before."""
        if self.published_before(commit):
            return False
        self.write(tables, commit)
        self.publish(tables, commit)
        return True

    def read(self, name: str) -> DataFrame:
        """A table as published, with ``commit``: of each recording the rows of its last commit."""
        newest = Window.partitionBy("recording_id").orderBy(F.desc("seq"), F.desc("commit"))
        last = self.manifest().withColumn("__at", F.row_number().over(newest)).where("__at = 1").select("recording_id", "commit")
        return self.spark.read.parquet(f"{self.folder}/tables/{name}").join(last, ["recording_id", "commit"], "left_semi")


def run(spark: SparkSession, folder: str, out: str, commit: str | None = None) -> bool:
    """Add the cards of a folder to the archive of ``out``; without a name, the commit is named by what the folder holds."""
    found = written(cards.read_cards(spark, folder), "cards")
    archive = Archive(spark, out)
    commit = commit or f"{found.agg(F.coalesce(F.hex(F.bit_xor(F.xxhash64('path', 'length'))), F.lit('none'))).first()[0]}"
    if archive.published_before(commit):
        return False
    opened = open_cards(found, packed=True)
    waveform = written(opened["waveform"], "waveform", "zstd")
    tables = analyse(waveform, opened["recordings"], opened["presses"])
    bad = opened["rejects"].select(F.col("path").alias("recording_id"), "reason")
    return archive.commit(tables | {"rejects": bad.unionByName(tables["rejects"].select("recording_id", F.col("rejected").alias("reason")))}, commit)
