"""Packed samples (binary) give what arrays give, from cards to strips."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rhythmspan import samples
from rhythmspan.operators import quality, report
from rhythmspan.sources import cards

RATE = 20.0


def both(spark):
    """One waveform as arrays and packed: two leads, chunks of unlike length, a null one, an empty one."""
    rng, rows = np.random.default_rng(8), []
    for name, n in (("a", 2000), ("b", 777), ("c", 90)):
        for channel in range(2):
            x = np.round(rng.normal(size=n).cumsum(), 1)
            x[200:340] = 1.0  # flat
            ends = np.unique(np.r_[0, rng.integers(1, n, 20), n]).tolist()
            rows += [(name, channel, a, x[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]
    rows += [("a", 0, 2000, None), ("b", 0, 777, [])]
    schema = "recording_id string, channel int, first_sample long, samples "
    arrays = spark.createDataFrame(rows, schema + "array<double>").repartition(3)
    packed = spark.createDataFrame([(*r[:3], None if r[3] is None else np.array(r[3]).tobytes()) for r in rows], schema + "binary").repartition(3)
    return arrays, packed


def rows_of(table):
    return sorted(map(tuple, table.collect()), key=str)


def test_windows_lengths_and_what_is_left(spark):
    arrays, packed = both(spark)
    assert rows_of(quality.recorded(arrays, RATE)) == rows_of(quality.recorded(packed, RATE))
    measured = [rows_of(quality.window_stats(quality.cut(w, RATE)).drop("samples")) for w in (arrays, packed)]
    assert measured[0] == measured[1] and len(measured[0]) == 27
    lengths = arrays.select("recording_id").distinct().withColumn("duration_sec", F.lit(30.13))
    left = report.trim(packed, lengths, RATE)
    left = left.withColumn("samples", samples.unpacked("samples"))
    assert rows_of(report.trim(arrays, lengths, RATE)) == rows_of(left)


def test_strips(spark):
    arrays, packed = both(spark)
    shown = spark.createDataFrame([("a", "x", 58.02, 64.02), ("a", "y", 0.0, 6.0), ("b", "x", 30.0, 36.0), ("c", "x", 3.0, 9.0)], "recording_id string, strip_id string, strip_start double, strip_end double")
    got = [rows_of(report.strip_waveforms(shown, w, RATE)) for w in (arrays, packed)]
    assert got[0] == got[1] and len(got[0]) == 8


def test_decoded_cards(spark):
    """Markers within a block, at its ends and throughout; no point known on one side or on both."""
    rng, n = np.random.default_rng(4), 300
    codes = rng.choice([0, 1, 2, 9, 15], (n, cards.POINTS, cards.CHANNELS))
    for k in range(n):
        a = int(rng.integers(0, cards.POINTS))
        codes[k, a : a + int(rng.integers(0, 70))] = cards.MARKER
    codes[::17] = cards.MARKER
    flat = codes.astype(np.uint8).reshape(n, -1)
    side = lambda far: [None if k % 3 == 0 or k < 20 else {"at": k * cards.POINTS + far, "count": [k, -k, 5]} for k in range(n)]
    names = ["path", "ordinal", "body", "carry", "before", "after"]
    bodies = [b.tobytes() for b in flat[:, 0::2] | (flat[:, 1::2] << 4)]
    batch = pa.RecordBatch.from_arrays([pa.array(["p"] * n), pa.array(np.arange(n)), pa.array(bodies), pa.array([[k, 2 * k, -k] for k in range(n)]), pa.array(side(-40)), pa.array(side(400))], names=names)
    plain = [x for b in cards._finish(iter([batch])) for x in b["samples"].to_pylist()]
    packed = [x for b in cards._finish(iter([batch]), packed=True) for x in b["samples"].to_pylist()]
    assert [None if x is None else np.frombuffer(x).tolist() for x in packed] == plain
    levels = np.cumsum(np.array(cards.DELTAS)[codes], axis=1)
    for k in range(n):
        good = np.flatnonzero(codes[k, :, 0] != cards.MARKER)
        before, after = batch["before"][k].as_py(), batch["after"][k].as_py()
        at = [*([-40] if before else []), *good, *([400] if after else [])]
        for c in range(cards.CHANNELS):
            known = [*([before["count"][c]] if before else []), *(levels[k, good, c] + [k, 2 * k, -k][c]), *([after["count"][c]] if after else [])]
            want = (np.interp(np.arange(cards.POINTS), at, known) * cards.MILLIVOLTS).tolist() if at else None
            assert plain[3 * k + c] == want
    assert plain.count(None) > 0


def test_images_of_any_size_are_cut_into_the_same_blocks(spark):
    """Across the cuts: parts are cut again, and what is left over ends the last one."""
    sizes = [1, 511, 512, 513, 64 * 512, 65 * 512 + 7, 2048 * 512, 2049 * 512 + 100]
    images = [(str(n), np.random.default_rng(n).bytes(n), "native") for n in sizes]
    got = cards.as_blocks(spark.createDataFrame(images, "path string, content binary, kind string")).collect()
    assert sorted((r.path, r.block_idx, bytes(r.block)) for r in got) == sorted((p, i // 512, c[i : i + 512]) for p, c, _ in images for i in range(0, len(c), 512))
