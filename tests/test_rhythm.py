"""The screening rules on beats built by hand, and against plain loops on random ones."""

import bisect
import itertools
from collections import Counter

import numpy as np
import pytest

from rhythmspan import schemas
from rhythmspan.operators import labels, measures, quality, rhythm


def chain(spark, rrs, names=None, first=0.0, widths=None):
    time, rows = first, []
    for i, rr in enumerate(rrs):
        time += rr or 0.0
        rows.append(("r", i, time, rr, widths[i] if widths else 0.08, names[i] if names else "N"))
    return spark.createDataFrame(rows, schemas.BEATS)


def drawn(spark, seed, n=400, names="NNNNNVEU"):
    """Random beats of two recordings: some intervals unknown, zero or long, labels in stretches."""
    rng = np.random.default_rng(seed)
    rows = []
    for name in ("p", "q"):
        time, label = 0.0, "N"
        for i in range(n):
            rr = None if i == 0 or rng.random() < 0.03 else 0.0 if rng.random() < 0.02 else round(float(rng.choice([0.31, 0.55, 0.83, 1.29, 2.7, 5.6], p=[0.25, 0.2, 0.3, 0.15, 0.07, 0.03])), 3)
            label = str(rng.choice(list(names))) if rng.random() < 0.6 else label
            time = round(time + (rr or 0.4), 3)
            rows.append((name, i, time, rr, 0.09, label))
    return rows, spark.createDataFrame(rows, schemas.BEATS).repartition(3)


def of(rows, name):
    return [r[1:] for r in rows if r[0] == name]


def test_variability_by_hand(spark):
    """Three normal pairs: 700, 1000 and 940 ms, so steps of 300 and -60, of which both exceed 50."""
    got = rhythm.variability(chain(spark, [None, 0.7, 1.0, 0.94, 0.4, 0.7], list("NNNNVN"))).first()
    assert (got.nn, got.pnn50_pct) == (3, 100)
    assert got.sdnn_ms == pytest.approx(np.std([700, 1000, 940])) and got.rmssd_ms == pytest.approx(np.sqrt((300**2 + 60**2) / 2))


@pytest.mark.parametrize("seed", [1, 2])
def test_one_pass_gives_what_plain_loops_give(spark, seed):
    rows, beats = drawn(spark, seed)
    recordings = spark.createDataFrame([("p", 61.0, 151.0), ("q", 47.0, 95.0), ("none", 50.0, 160.0)], "recording_id string, brady_bpm double, tachy_bpm double")
    got = {r.recording_id: r for r in measures.summary(recordings, beats).collect()}
    assert got["none"].total_beats == got["none"].arrests == 0 and got["none"].mean_bpm is None
    for name, brady, tachy in (("p", 61, 151), ("q", 47, 95)):
        own, r = of(rows, name), got[name]
        runs = [list(g) for _, g in itertools.groupby(own, key=lambda b: b[4])]
        sizes = Counter((g[0][4], min(len(g), 4)) for g in runs)
        assert (r.couplets, r.triplets, r.vt_runs, r.escape_couplets) == tuple(sizes[k] for k in (("V", 2), ("V", 3), ("V", 4), ("E", 2)))
        assert (r.escape_runs, r.pvc_count, r.pauses) == (sizes["E", 3] + sizes["E", 4], sum(b[4] == "V" for b in own), sum((b[2] or 0) >= 2.5 for b in own))
        rated = [(60 / np.mean(rrs), len(g)) for g in runs if g[0][4] == "V" and len(g) > 2 and (rrs := [b[2] for b in g[1:] if b[2]])]
        assert r.fastest_bpm == (pytest.approx(max(rated)[0]) if rated else None)
        stretches = lambda hit: sum(k and len(list(g)) >= 3 for k, g in itertools.groupby(own, key=lambda b: bool(b[2]) and hit(60 / b[2])))
        assert (r.brady_events, r.tachy_events) == (stretches(lambda x: x < brady), stretches(lambda x: x > tachy))
        known = [b for b in own if b[2]]
        middle = [sorted(b[2] for b in known[i - 2 : i + 3])[2] for i in range(2, len(known) - 2)]
        assert (r.windows, r.slow_windows, r.min_bpm, r.max_bpm) == (len(middle), sum(60 / m < brady for m in middle), pytest.approx(60 / max(middle)), pytest.approx(60 / min(middle)))
        arrests, longest, start, escapes = 0, None, None, 0
        for _, t, rr, _, label in own:
            fine = label in "NE" and rr
            if label == "N" and fine and start is not None:
                arrests, longest = arrests + (escapes > 0), max(longest or 0, t - start)
            start = t if label == "N" else start if fine else None
            escapes = 0 if label == "N" else escapes + (label == "E")
        assert (r.arrests, r.longest_sinus) == (arrests, longest and pytest.approx(longest))


def test_shares_of_slow_and_fast_windows(spark):
    """Seven intervals at 40 a minute and six at 190: three windows lie in each, four across."""
    got = rhythm.rate_stats(chain(spark, [None] + [1.5] * 7 + [60 / 190] * 6)).first()
    assert (got.slow_windows, got.fast_windows, got.windows) == (5, 4, 9)


def test_a_bridged_sinus_interval(spark):
    """Two escapes between normal beats are one interval; with a premature beat or an unknown interval there is none."""
    beats = chain(spark, [None, 0.7, 1.9, 2.1, 1.1, 0.7, 0.5, 1.2, 1.8, None], list("NNEENNVNEN"))
    got = {(round(r.start_sec, 6), round(r.end_sec, 6)): r.escape_beats for r in rhythm.sinus_intervals(beats).collect()}
    assert got == {(0.0, 0.7): 0, (0.7, 5.8): 2, (5.8, 6.5): 0}


def test_trend_of_bins(spark):
    beats = chain(spark, [None, 0.5, 0.75, 1.0, 45.0, 31.0])
    assert [(r.centre_sec, r.bpm and round(r.bpm, 3)) for r in rhythm.trend(beats, 20.0).orderBy("centre_sec").collect()] == [(10.0, 80.0), (30.0, None), (50.0, None), (70.0, None)]


STEADY = [None] + [0.9] * 9


@pytest.mark.parametrize(("rr", "qrs", "label"), [(0.6, 0.2, "V"), (0.77, 0.2, "N"), (1.36, 0.2, "E"), (1.34, 0.2, "N"), (0.6, 0.121, "N"), (1.8, 0.1, "N"), (0.6, None, "U")])
def test_a_beat_after_a_steady_rhythm(spark, rr, qrs, label):
    """Against 0.9 s and 0.1 s: early under 0.765 s, late from 1.35 s, wide over 0.13 s."""
    beats = chain(spark, [*STEADY, rr], widths=[0.1] * 10 + [qrs])
    assert labels.label_beats(beats).orderBy("beat_idx").collect()[-1].label == label


def test_only_normal_beats_move_the_baseline(spark):
    beats = chain(spark, [*STEADY, 1.5, 0.5, 0.8], widths=[0.1] * 10 + [0.2, 0.2, 0.1])
    got = labels.label_beats(beats).orderBy("beat_idx").collect()[-3:]
    assert [r.label for r in got] == ["E", "V", "N"] and [r.rr_base for r in got] == [pytest.approx(0.9)] * 3


@pytest.mark.parametrize("seed", [3, 4])
def test_beats_and_spans_against_every_pair(spark, seed):
    """Overlapping spans, ends that touch beats, recordings without spans or beats."""
    rng = np.random.default_rng(seed)
    beats = [(name, i, float(t), 0.5, 0.09, "N") for name in ("a", "b") for i, t in enumerate(np.sort(rng.choice(400, 120, replace=False)) / 2)]
    spans = [("a", float(s), float(s + n)) for s, n in zip(rng.integers(0, 190, 25) / 2 * 2, rng.integers(0, 6, 25) / 2, strict=True)] + [("c", 1.0, 9.0)]
    got = {(r.recording_id, r.beat_idx): r.rr_sec for r in quality.exclude_beats(spark.createDataFrame(beats, schemas.BEATS), spark.createDataFrame(spans, schemas.SPANS)).collect()}
    want, last = {}, {}
    for name, i, t, rr, *_ in beats:
        own = [s for s in spans if s[0] == name]
        if not any(a <= t <= z for _, a, z in own):
            want[name, i] = None if name in last and any(a < t and z > last[name] for _, a, z in own) else rr
            last[name] = t
    assert got == want and None in want.values()


def test_many_spans_take_time_in_proportion(spark):
    """A hundred thousand beats and ten thousand spans of one recording go by in one order."""
    beats = spark.range(100_000).selectExpr("'r' as recording_id", "id as beat_idx", "id * 0.8D as time_sec", "0.8D as rr_sec", "0.09D as qrs_sec", "'N' as label")
    spans = spark.range(10_000).selectExpr("'r' as recording_id", "id * 8.0D as start_sec", "id * 8.0D + 2.0 as end_sec")
    kept = quality.exclude_beats(beats, spans)
    assert "ArrayExists" not in (plan := kept._jdf.queryExecution().optimizedPlan().toString()) and "Join" not in plan
    assert kept.count() == 70_000 and kept.where("rr_sec is null").count() == 9_999


@pytest.mark.parametrize(("more", "want"), [([(30.0, 31.0)], [(5.0, 31.0)]), ([(41.5, 43.0)], [(5.0, 11.0), (41.5, 43.0)]), ([(41.0, 43.0)], [(5.0, 43.0)]), ([(6.0, 7.0), (0.0, 5.5)], [(0.0, 11.0)])])
def test_spans_that_are_near_become_one(spark, more, want):
    spans = spark.createDataFrame([("r", a, z) for a, z in [(5.0, 11.0), *more]], schemas.SPANS)
    assert [(r.start_sec, r.end_sec) for r in quality.merge_spans(spans).orderBy("start_sec").collect()] == want


def test_empty(spark):
    none = spark.createDataFrame([], schemas.BEATS)
    assert rhythm.burden(none).count() == rhythm.runs(none).count() == rhythm.rate_stats(none).count() == 0
    assert labels.label_beats(none).count() == quality.exclude_beats(none, spark.createDataFrame([], schemas.SPANS)).count() == 0


@pytest.mark.parametrize(("duration", "times"), [(0.0, []), (0.0, [0.0]), (3.0, []), (1250.0, []), (1250.0, [1250.0]), (1250.0, [1249.0]), (0.0, [4849.5, 4850.0]), (9000.0, [7.0, 1250.0, 8450.0]), (8450.0, [8450.0])])
def test_hours_begin_at_the_boundaries_of_the_clock(spark, duration, times):
    """A recording from 10:39:10 on: each beat belongs to the last boundary at or before it."""
    first = 1250.0
    begins = [0.0, *(first + 3600 * k for k in range(9))]
    end = max([duration, *times])
    held = Counter(bisect.bisect_right(begins, t) - 1 for t in times)
    last = max([bisect.bisect_left(begins, end) - 1, *held], default=-1)
    want = [(begins[h], min(begins[h + 1], end), held[h]) for h in range(last + 1)]
    beats = spark.createDataFrame([("r", i, t, None, 0.08, "N") for i, t in enumerate(times)], schemas.BEATS)
    recordings = spark.createDataFrame([("r", duration, first)], "recording_id string, duration_sec double, first_hour_sec double")
    assert [(r.start_sec, r.end_sec, r.beats) for r in measures.hourly(beats, recordings).orderBy("hour").collect()] == want


def test_runs_count_in_the_hour_that_they_begin_in(spark):
    beats = chain(spark, [None] + [0.5] * 11, list("NVVNNVVVNNVN"), first=97.0)
    recordings = spark.createDataFrame([("r", 104.0, 100.0)], "recording_id string, duration_sec double, first_hour_sec double")
    got = [(r.beats, r.pvcs, r.couplets, r.runs) for r in measures.hourly(beats, recordings).orderBy("hour").collect()]
    assert got == [(6, 3, 1, 1), (6, 3, 0, 0)]


def test_limits_follow_the_weight_class(spark):
    rows = spark.createDataFrame([("a", "small"), ("b", "large"), ("c", None), ("d", "giant")], "recording_id string, weight_class string")
    assert {r.recording_id: (r.brady_bpm, r.tachy_bpm) for r in rhythm.limits(rows).collect()} == {"a": (60, 180), "b": (45, 150), "c": (50, 160), "d": (50, 160)}
