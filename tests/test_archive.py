"""From card images to the tables of a screening, end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_cards import ecg, meta

from rhythmspan.jobs import archive
from rhythmspan.operators import quality
from rhythmspan.sources import cards


def heart(seconds, every=0.8, seed=3):
    """Codes (points, channels) whose running sum is a train of narrow peaks on two leads and a flat third, with some noise."""
    rng = np.random.default_rng(seed)
    n = int(seconds * 180) // cards.POINTS * cards.POINTS
    codes = np.zeros((n, 3), np.uint8)
    codes[::2, :2] = 1
    codes[1::2, :2] = 15
    codes[rng.integers(0, n, n // 40)] = 0
    for at in np.arange(0.5, seconds - 1, every):
        i = int(at * 180)
        if i + 4 <= n:
            codes[i : i + 4, :2] = np.array([7, 7, 9, 9])[:, None]
    return codes


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    codes = heart(400)
    blocks = [codes[i : i + cards.POINTS] for i in range(0, len(codes), cards.POINTS)]
    image = meta() + b"".join(ecg(b, position=5900 + i * cards.STEP, event=(0, 2) if i in (47, 120) else (0, 0)) for i, b in enumerate(blocks))
    folder, out = tmp_path_factory.mktemp("cards"), tmp_path_factory.mktemp("out")
    for name, content in (("a", image), ("broken", image[: 5 * 512 + 480] + b"\7" + image[5 * 512 + 481 :])):
        (folder / name).mkdir()
        (folder / name / "flash.dat").write_bytes(content)
    assert archive.run(spark, f"{folder}/*", f"{out}") and not archive.run(spark, f"{folder}/*", f"{out}")
    names = ("rejects", "quality", "beats", "summary", "panels", "hours", "hours_text", "presses", "trend", "lanes", "timeline", "strips", "strip_beats", "waveforms")
    return {name: archive.Archive(spark, f"{out}").read(name) for name in names}


def test_a_broken_card_is_rejected_and_the_other_one_goes_through(saved):
    assert [r.reason for r in saved["rejects"].collect()] == ["checksum"]
    summary = saved["summary"].collect()
    assert len(summary) == 1
    kept = saved["quality"].first()
    assert kept.duration_sec == pytest.approx(int(400 * 180) // 304 * 304 / 180) and kept.analyzed_sec == pytest.approx(kept.duration_sec - 120)


def test_beats_of_the_card(saved):
    beats = saved["beats"].orderBy("time_sec").toPandas()
    inside = [t for t in np.arange(0.5, 399, 0.8) if 60 < t < 339.5]
    assert abs(len(beats) - len(inside)) <= 2
    assert beats["rr_sec"].iloc[1:].median() == pytest.approx(0.8, abs=0.02)
    assert set(beats["label"]) <= {"U", "N"}
    assert saved["hours"].agg(F.sum("beats")).first()[0] == len(beats)


def test_presses_have_strips_of_every_lead(saved):
    presses = saved["presses"].orderBy("time_sec").collect()
    assert [(p.label, round(p.time_sec, 1)) for p in presses] == [("Short of breath", 79.4), ("Short of breath", 202.7)]
    assert {r.section for r in saved["strips"].collect()} == {"extremes", "presses", "hours"}
    assert saved["strip_beats"].count() > 20 and saved["trend"].count() == 6 and saved["timeline"].first().span_sec > 390
    strips = saved["strips"].where("kind = 'press'").orderBy("start_sec").collect()
    assert [s.strip_end - s.strip_start for s in strips] == pytest.approx([6, 6])
    shown = saved["waveforms"].where("strip_id like 'presses%'").collect()
    assert len(shown) == 6 and all(len(r.samples) == 1080 for r in shown)


def test_windows_and_contract(spark):
    rows = [("r", c, a, [float(v) for v in range(a, min(a + 70, n))]) for c, n in ((0, 250), (1, 240)) for a in range(0, n, 70)] + [("s", 0, 0, [1.0] * 99), ("t", 2, 0, None), ("u", 0, 50, [1.0] * 100)]
    waveform = spark.createDataFrame(rows, "recording_id string, channel int, first_sample long, samples array<double>")
    got = quality.cut(waveform, 20.0).orderBy("recording_id", "window_idx").collect()
    assert [(r.recording_id, r.window_idx, r.samples[0], r.samples[-1]) for r in got] == [("r", 0, 0, 99), ("r", 1, 100, 199)]
    names = spark.createDataFrame([("r", ["a", "b"]), ("s", ["a"]), ("t", ["a"]), ("u", ["a"]), ("v", None)], "recording_id string, channel_names array<string>")
    reasons = {r.recording_id: r.reason for r in quality.contract(names, waveform, 20.0).collect()}
    assert reasons == {"r": "leads of unlike length", "u": "samples missing", "v": "no samples"}


def test_an_archive_grows_and_a_job_that_dies_changes_nothing(spark, tmp_path):
    of = lambda **values: {"summary": spark.createDataFrame(list(values.items()), "recording_id string, n int"), "rejects": spark.createDataFrame([], "recording_id string, reason string")}
    kept = archive.Archive(spark, str(tmp_path / "a"))
    state = lambda: {(r.recording_id, r.n) for r in kept.read("summary").collect()}
    assert kept.commit(of(a=0), "007") and kept.commit(of(a=1, b=2), "first") and state() == {("a", 1), ("b", 2)}
    kept.write(of(b=9, c=9), "second")  # and dies here
    assert state() == {("a", 1), ("b", 2)}
    files = sorted((tmp_path / "a" / "tables" / "summary" / "commit=c-first").glob("*.parquet"))
    before = [f.stat().st_mtime_ns for f in files]
    assert kept.commit(of(b=3, c=4), "second") and state() == {("a", 1), ("b", 3), ("c", 4)}
    assert not kept.commit(of(a=7), "first") and state() == {("a", 1), ("b", 3), ("c", 4)}
    assert [f.stat().st_mtime_ns for f in files] == before
    with pytest.raises(ValueError):
        kept.commit(of(a=1), "../x")
    assert archive.Archive(spark, str(tmp_path / "none")).manifest().count() == 0


def test_recordings_of_different_rates_in_one_job(spark):
    """Each recording's tables are those of a job with that recording alone."""
    rows = []
    for name, rate in (("slow", 90.0), ("fast", 250.0)):
        t = np.arange(int(200 * rate)) / rate
        x = np.random.default_rng(1).normal(0, 0.01, len(t)) + sum(np.exp(-0.5 * ((t - at) / 0.02) ** 2) for at in np.arange(0.7, 199, 0.9))
        rows += [(name, c, rate, a, x[a : a + 777].tolist()) for c in range(2) for a in range(0, len(x), 777)]
    wave = spark.createDataFrame(rows, "recording_id string, channel int, rate double, first_sample long, samples array<double>").repartition(4)
    of = spark.createDataFrame([("slow", None), ("fast", None)], "recording_id string, start_time timestamp_ntz")
    presses = spark.createDataFrame([("slow", 100.0, "a"), ("fast", 60.01, "b")], "recording_id string, time_sec double, label string")
    both = archive.analyse(wave, of, presses, None)
    for name, rate in (("slow", 90.0), ("fast", 250.0)):
        own = F.col("recording_id") == name
        alone = archive.analyse(wave.where(own).drop("rate"), of.where(own), presses.where(own), rate)
        for table in ("quality", "beats", "strips", "waveforms"):
            key = lambda r: str(r.asDict().get("strip_id", "")) + str(r.asDict().get("channel", "")) + f"{r.asDict().get('time_sec', 0):012.4f}"
            got, want = (sorted(x.collect(), key=key) for x in (both[table].where(own), alone[table]))
            assert got == want and got
        strip = [r for r in both["waveforms"].where(own).collect() if r.strip_id.startswith("presses")]
        assert len(strip) == 2 and all(len(r.samples) == int(6 * rate) for r in strip)
