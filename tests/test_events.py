"""Golden values of quality trimming, flagged events and detection scores."""

import pytest
from pyspark.sql import functions as F
from test_rhythm import chain

from rhythmspan import schemas
from rhythmspan.operators import evaluate, events, quality

RATE = 100


def recording(spark, pieces):
    """Five-second windows of a 1.5 Hz sine, ten times it ('burst') or alternating samples ('tone'), by (kind, seconds)."""
    kinds = [k for k, sec in pieces for _ in range(sec // 5)]

    edge, case = 0, F.lit(None).cast("string")
    for k, sec in reversed(pieces):
        case = F.when(F.col("id") >= (sum(s for _, s in pieces) - edge - sec) // 5, F.coalesce(case, F.lit(k)))
        edge += sec
    rows = spark.range(len(kinds)).withColumn("kind", case)
    i = F.sequence(F.col("id") * 5 * RATE, (F.col("id") + 1) * 5 * RATE - 1)
    sine = F.transform(i, lambda x: F.sin(x * (2 * 3.141592653589793 * 1.5 / RATE)) * F.when(F.col("kind") == "burst", 10.0).otherwise(1.0))
    tone = F.transform(i, lambda x: F.when(x % 2 == 0, 1.0).otherwise(-1.0))
    windows = rows.select(F.lit("r").alias("recording_id"), F.col("id").alias("window_idx"), F.when(F.col("kind") == "tone", tone).otherwise(sine).alias("samples"))
    return windows, spark.createDataFrame([("r", float(sum(s for _, s in pieces)))], "recording_id string, recorded_sec double")


@pytest.mark.parametrize(
    ("pieces", "duration", "trimmed", "spans"),
    [
        ([("sine", 600)], 600, 0, [(0, 60), (540, 600)]),
        ([("sine", 200), ("burst", 10), ("sine", 390)], 600, 0, [(0, 60), (198, 212), (540, 600)]),
        ([("sine", 3600), ("tone", 7200)], 3600, 7200, [(0, 60), (3540, 3600)]),
        ([("sine", 3600), ("tone", 600)], 4200, 0, [(0, 60), (3598, 4200)]),
        ([("sine", 3600), ("burst", 60), ("sine", 120), ("burst", 60), ("tone", 7200)], 3600, 7440, [(0, 60), (3540, 3600)]),
        ([("sine", 3600), ("burst", 60), ("sine", 600), ("tone", 7200)], 4260, 7200, None),
        ([("tone", 3600)], 3600, 0, [(0, 3600)]),
    ],
)
def test_assess(spark, pieces, duration, trimmed, spans):
    lengths, found = quality.assess(*recording(spark, pieces))
    assert tuple(lengths.first()) == ("r", duration, trimmed)
    if spans:
        assert [(s.start_sec, s.end_sec) for s in found.orderBy("start_sec").collect()] == spans


def test_assess_without_a_full_window(spark):
    none = spark.createDataFrame([], "recording_id string, window_idx long, samples array<double>")
    lengths, found = quality.assess(none, spark.createDataFrame([("a", 3.0), ("b", 0.0)], "recording_id string, recorded_sec double"))
    assert sorted(map(tuple, lengths.collect())) == [("a", 3, 0), ("b", 0, 0)]
    assert list(map(tuple, found.collect())) == [("a", 0, 3)]


def test_samples_are_read_once_to_assess_them(spark, tmp_path):
    windows, sizes = recording(spark, [("sine", 600), ("tone", 60), ("sine", 60)])
    log = tmp_path / "read"

    def read(batches):
        for batch in batches:
            with log.open("a") as f:
                f.write("x" * len(batch))
            yield batch

    lengths, found = quality.assess(windows.mapInPandas(read, windows.schema), sizes)
    assert lengths.count() == 1 and found.count() >= 1
    assert len(log.read_text()) == 720 // 5


def test_even_sample(spark):
    rows = spark.range(30).select(F.lit("r").alias("recording_id"), "id")
    assert [r.id for r in events.even_sample(rows, 4, ("recording_id",), ("id",)).orderBy("id").collect()] == [0, 10, 19, 29]
    assert events.even_sample(rows, 30, ("recording_id",), ("id",)).count() == 30
    with pytest.raises(ValueError):
        events.even_sample(rows, 1, ("recording_id",), ("id",))


def test_catalogue(spark):
    rrs = [None] + [0.8] * 8 + [0.5, 0.8, 0.5, 0.3, 0.3, 0.3, 0.8, 1.4, 0.8]
    names = list("N" * 9 + "V" + "N" + "VVVV" + "N" + "E" + "N")
    got = events.catalogue(chain(spark, rrs, names)).orderBy("start_sec").collect()
    assert [(r.kind, r.beats, r.status) for r in got] == [("isolated", 1, None), ("tachycardia", 4, "alert"), ("escape", 1, None)]
    assert got[1].bpm == pytest.approx(200) and got[1].typical_rr == pytest.approx(0.8)
    assert got[1].rr_list == [0.5, 0.3, 0.3, 0.3] and got[0].bpm is None


def test_extremes(spark):
    rrs = [None] + [0.8] * 6 + [3.0] + [0.4] * 6
    got = {r.kind: r for r in events.extremes(chain(spark, rrs)).collect()}
    assert set(got) == {"fastest rate", "slowest rate", "longest pause"}
    assert (got["longest pause"].start_sec, got["longest pause"].value) == (pytest.approx(4.8), 3.0)
    assert got["fastest rate"].value == pytest.approx(150)
    assert events.extremes(chain(spark, [None, 0.8, 3.0])).count() == 0


def test_strips(spark):
    found = spark.createDataFrame([("r", 1.0, 1.0), ("r", 50.0, 60.0), ("r", 99.0, 99.0)], schemas.SPANS)
    got = events.strips(found, spark.createDataFrame([("r", 100.0)], "recording_id string, duration_sec double")).orderBy("start_sec").collect()
    assert [(r.strip_start, r.strip_end) for r in got] == [(0, 6), (49, 61), (96, 100)]


def test_many_isolated_beats_take_no_strip_from_runs(spark):
    """A thousand isolated V, five runs of six, 31 escapes, forty presses over six hours: each section has a sample of its own."""
    names, runs = [], []
    for i in range(1000):
        names += [*"NNNNNNNVNN"]
        if i % 200 == 100:
            runs.append(len(names))
            names += [*"VVVVVVNN"]
        if i % 33 == 5:
            names += [*"EN"]
    names += ["N"] * 15_000
    beats = spark.createDataFrame([("r", i, i * 0.85, 0.85 if i else None, 0.09, n) for i, n in enumerate(names)], schemas.BEATS)
    presses = spark.createDataFrame([("r", 50.0 * i) for i in range(40)], "recording_id string, time_sec double")
    hours = spark.createDataFrame([("r", 1000.0)], "recording_id string, first_hour_sec double")
    shown = events.sections(events.catalogue(beats), events.extremes(beats), presses, beats, hours).collect()
    of = lambda section: sorted((r.start_sec for r in shown if r.section == section))
    assert of("runs") == pytest.approx([i * 0.85 for i in runs])
    assert {r.section: (r.total, sum(x.section == r.section for x in shown)) for r in shown} == {"extremes": (4, 4), "runs": (5, 5), "isolated": (1000, 24), "escapes": (31, 24), "presses": (40, 24), "hours": (7, 7)}
    isolated = [i * 0.85 for i, n in enumerate(names) if n == "V" and names[i - 1] != "V" and names[i + 1] != "V"]
    assert of("isolated") == pytest.approx([isolated[round(k * 999 / 23)] for k in range(24)])
    assert {r.section for r in shown if not r.marked} == {"presses", "hours"}


def test_detection(spark):
    at = lambda *times: spark.createDataFrame([("r", float(t)) for t in times], "recording_id string, time_sec double")
    got = evaluate.detection(at(1, 2, 3, 3), at(0.75, 2.25, 3), 0.25).first()
    assert (got.truth, got.found, got.hits, got.sensitivity, got.precision) == (4, 3, 4, 1, pytest.approx(4 / 3))
    assert evaluate.detection(at(1), at()).first().sensitivity == 0
    assert evaluate.labels_accepted(at(1, 2), at(1.1, 2)).first().accepted
    assert not evaluate.labels_accepted(at(1, 2), at(1.1, 5)).first().accepted
    assert not evaluate.labels_accepted(at(), at(5)).first().accepted


def test_no_rows(spark):
    none = spark.createDataFrame([], schemas.BEATS)
    assert events.catalogue(none).count() == events.extremes(none).count() == events.hour_samples(none, F.lit(3600.0)).count() == 0
