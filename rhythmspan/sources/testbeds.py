"""Stand-ins for recordings, made from the driver's tables. None of this is an ECG."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rhythm import first_hour_sec


def beats(spark: SparkSession, sf_dir: str, divisor: float = 3e10) -> DataFrame:
    """``BEATS`` plus ``start_time``: a user's events as one recording, time shrunk by the divisor (microseconds to seconds)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "event_type", "value")
    order = Window.partitionBy("recording_id").orderBy("us", "event_id")
    label = F.when(F.col("event_type") == "purchase", "V").when(F.col("event_type") == "error", "E").when(F.col("event_type") == "signup", "U").otherwise("N")
    rows = events.withColumn("recording_id", F.col("user_id").cast("string"))
    first = F.first("us").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(
        "recording_id",
        (F.row_number().over(order) - 1).cast("long").alias("beat_idx"),
        ((F.col("us") - first) / divisor).alias("time_sec"),
        ((F.col("us") - F.lag("us").over(order)) / divisor).alias("rr_sec"),
        (0.05 + F.col("value") / 1000).alias("qrs_sec"),
        label.alias("label"),
        first.alias("start_us"),
    )


def recordings(spark: SparkSession, sf_dir: str, divisor: float = 6e7) -> DataFrame:
    """``recording_id, start_time, first_hour_sec, last_sec, duration_sec, weight_class`` of the users; up to three hours go on after the last event."""
    of = beats(spark, sf_dir, divisor).groupBy("recording_id").agg(F.min("start_us").alias("us"), F.max("time_sec").alias("last_sec"))
    user = F.col("recording_id").cast("long")
    weight = F.element_at(F.array(F.lit("small"), F.lit("medium"), F.lit("large")), (user % 3 + 1).cast("int"))
    start = F.timestamp_micros("us").cast("timestamp_ntz")
    return of.select("recording_id", start.alias("start_time"), first_hour_sec(start).alias("first_hour_sec"), "last_sec", (F.col("last_sec") + user % 4 * 2700.0).alias("duration_sec"), weight.alias("weight_class"))


#: Of each ten cards made from users these have a fault: a checksum, a gap, markers alone, no rate, no date.
FAULTS = {0: "checksum", 1: "gap", 2: "markers", 3: "rate", 4: "date"}
STALE = 60


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content, kind``: an image of a card for each user, a block an event; from the 60th on blocks are of an older recording.

    Codes, presses and faults follow from ids, so that SQL can say what is on a card. The cards of every
    user whose id ends in 5 hold pacemaker markers across the seams of blocks, at the last point of one
    (``i % 3 = 1``) and the first two of the next.
    """
    import struct

    import numpy as np
    import pandas as pd

    from .cards import CHANNELS, CHECKSUM, MARKER, POINTS, STEP

    def packed(codes: np.ndarray) -> np.ndarray:
        flat = codes.astype(np.uint8).reshape(len(codes), -1)
        return flat[:, 0::2] | (flat[:, 1::2] << 4)

    def sealed(blocks: np.ndarray, fault: np.ndarray | int = 0) -> None:
        blocks[:, 508:512] = (CHECKSUM - blocks[:, :508].sum(axis=1, dtype=np.int64) + fault).astype("<u4").reshape(-1, 1).view(np.uint8)

    # ECG of a block by where its codes begin: plain, markers alone, a marker at the last point, markers at the first two
    point, channel = np.arange(POINTS)[:, None], np.arange(CHANNELS)[None, :]
    plain = (np.arange(16)[:, None, None] + point * (channel + 1)) % 16
    plain = np.where(plain == MARKER, 0, plain)
    at = np.arange(POINTS)[None, :, None]
    bodies = np.stack([packed(np.where(marked, MARKER, plain)) for marked in (at < 0, at >= 0, at == POINTS - 1, at < 2)])

    def ecg(rows: pd.DataFrame, i: np.ndarray) -> np.ndarray:
        """Blocks (a row each) of events that are each the ``i``-th of their user."""
        user, event = rows["user_id"].to_numpy(), rows["event_id"].to_numpy()
        fault = np.array([FAULTS.get(k, "") for k in range(10)])[user % 10]
        variant = np.where(fault == "markers", 1, np.where(user % 10 == 5, np.array([0, 2, 3])[i % 3], 0))
        out = np.zeros((len(rows), 512), np.uint8)
        put = lambda a, b, values: out.__setitem__((slice(None), slice(a, b)), np.ascontiguousarray(values, f"<u{b - a}").reshape(-1, 1).view(np.uint8))
        put(0, 4, np.full(len(rows), 512)), put(4, 6, np.full(len(rows), 0x1E))
        put(6, 10, 5900 + i * STEP + ((fault == "gap") & (i >= 3)))
        out[:, 10:466] = bodies[variant, (event + i) % 16]
        put(466, 468, user % 1000 + (i >= STALE)), put(468, 470, np.full(len(rows), 52837))
        out[:, 470], out[:, 471] = event % 7, np.where(rows["event_type"].to_numpy() == "signup", 1 + event % 4, 0)
        sealed(out, (fault == "checksum") & (i == 2))
        return out

    def head(user: int, us: int) -> bytes:
        fault, day = FAULTS.get(user % 10), pd.Timestamp(us // 1_000_000, unit="s")
        text = f"{'Rate' if fault == 'rate' else 'SampleRate'}=180\nSampleStorageFormat=1\nstart_time={day:%H:%M:%S}\nstart_date={'13/45/10' if fault == 'date' else f'{day:%m/%d/%y}'}\nDiaryText=Manual Event^ Chest Pain ^^Cough^\n".encode()
        block = np.zeros((1, 512), np.uint8)
        block[0, : 6 + len(text)] = np.frombuffer(struct.pack("<I", 512) + b" \n" + text, np.uint8)
        sealed(block)
        return block.tobytes()

    def images(batches):
        """Cards as their users end; of the one that goes on in the next batch what is there so far is held."""
        current, held, n = None, [], 0
        for rows in batches:
            if rows.empty:
                continue
            users = rows["user_id"].to_numpy()
            starts = np.flatnonzero(np.r_[True, users[1:] != users[:-1]])
            i = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
            i += np.where(np.arange(len(rows)) < (starts[1] if len(starts) > 1 else len(rows)), n if users[0] == current else 0, 0)
            blocks, out = ecg(rows, i), []
            for a, b in zip(starts.tolist(), np.r_[starts[1:], len(rows)].tolist(), strict=True):
                if users[a] != current:
                    if held:
                        out.append((str(current), b"".join(held), "native"))
                    current, held, n = int(users[a]), [head(int(users[a]), int(rows["us"].iloc[a]))], 0
                held.append(blocks[a:b].tobytes())
                n += b - a
            yield pd.DataFrame(out, columns=["path", "content", "kind"])
        if held:
            yield pd.DataFrame([(str(current), b"".join(held), "native")], columns=["path", "content", "kind"])

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "event_type")
    return events.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id").mapInPandas(images, "path string, content binary, kind string")


def card_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, kind`` of :func:`cards`, without their images."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("user_id").cast("string").alias("path"), F.lit("native").alias("kind")).distinct()


#: Of planted waveforms: samples a second, distance of beats in samples (0.7 s and more), quiet stretches at both ends.
PULSE_RATE, STEP_SAMPLES, LEAD_IN = 180, 18, 540
#: Width of a pulse (standard deviation in samples) and height of the T wave after it.
NARROW, WIDE, T_WAVE = 3.0, 6.0, 0.12


def pulse_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recording_id, n, at, event_type``: where each event of a user stands as a pulse, in samples; distances follow from ids."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "event_type")
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    gap = (F.col("event_id") % 4 + 7) * STEP_SAMPLES
    at = F.sum(gap).over(order.rowsBetween(Window.unboundedPreceding, 0)) + LEAD_IN
    return events.select(F.col("user_id").cast("string").alias("recording_id"), (F.row_number().over(order) - 1).cast("long").alias("n"), at.cast("long").alias("at"), "event_type")


def pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recording_id, channel, first_sample, samples`` (packed): pulse trains on two leads and a flat third one, a chunk an event.

    A purchase is a wide pulse, an error one that goes down on the second lead, a signup one that only the
    first lead has; each but the wide ones is followed by a T wave. What is planted is in :func:`pulse_plan`, so SQL knows the beats.
    """
    import numpy as np
    import pyarrow as pa

    from ..samples import pack

    plan = pulse_plan(spark, sf_dir)
    order = Window.partitionBy("recording_id").orderBy("n")
    near = [c for k in (-1, 0, 1) for c in (F.lag("at", -k).over(order).alias(f"at{k + 1}"), F.lag("event_type", -k).over(order).alias(f"kind{k + 1}"))]
    # a chunk goes from half-way after the beat before to half-way to the next, and the neighbours' pulses reach into it
    rows = plan.select("recording_id", "n", *near)
    at_once = 1024  # chunks, of some 150 samples and three leads
    # what an event adds to both leads by the samples from it, as the exponentials are 0 beyond: none, purchase, error, signup, any other
    reach = 1024
    off = np.arange(-reach, reach + 1, dtype=float)
    pulse = {wide: np.exp(-0.5 * (off / (WIDE if wide else NARROW)) ** 2) for wide in (False, True)}
    wave = T_WAVE * np.exp(-0.5 * ((off - 0.25 * PULSE_RATE) / 10.0) ** 2)
    none, plain, alike = np.zeros(len(off)), pulse[False] + wave, 0.8 * pulse[False] + wave
    shapes = np.stack([[none, pulse[True], plain, plain, plain], [none, 0.8 * pulse[True], -0.8 * pulse[False], none, alike]]).reshape(2, -1)
    numbers = {"purchase": 1, "error": 2, "signup": 3}

    def draw(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                part = batch.slice(i, at_once)
                ats = [part[f"at{k}"].to_numpy(zero_copy_only=False).astype(float) for k in range(3)]
                kinds = [part[f"kind{k}"].to_numpy(zero_copy_only=False) for k in range(3)]
                begin = np.where(np.isnan(ats[0]), 0, (np.nan_to_num(ats[0]) + ats[1]) // 2).astype(np.int64)
                end = np.where(np.isnan(ats[2]), ats[1] + LEAD_IN, (ats[1] + np.nan_to_num(ats[2])) // 2).astype(np.int64)
                size = end - begin
                ends = np.cumsum(size)
                t = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
                leads = np.zeros((3, len(t)))
                for at, kind in zip(ats, kinds, strict=True):
                    place = np.where(np.isnan(at), ats[1], at).astype(np.int64)  # there is no event, and it adds nothing
                    number = np.array([0 if np.isnan(x) else numbers.get(k, 4) for x, k in zip(at, kind, strict=True)])
                    shape = np.clip(t - np.repeat(place, size), -reach, reach) + np.repeat(number * len(off) + reach, size)
                    leads[0] += shapes[0][shape]
                    leads[1] += shapes[1][shape]
                for c in range(3):
                    yield pa.RecordBatch.from_arrays([part["recording_id"], pa.array(np.full(len(size), c, np.int32)), pa.array(begin), pack(np.r_[0, ends], leads[c])], names=["recording_id", "channel", "first_sample", "samples"])

    return rows.mapInArrow(draw, "recording_id string, channel int, first_sample long, samples binary")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recording_id, window_idx, samples``: each embedding as one window of samples."""
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("label").cast("string").alias("recording_id"), (F.row_number().over(order) - 1).cast("long").alias("window_idx"), F.col("embedding").cast("array<double>").alias("samples"))


def spans(rows: DataFrame, share: float = 0.9, length: float = 2.0) -> DataFrame:
    """``SPANS``: the stretch after each beat whose QRS is in the top share of all."""
    cut = rows.agg(F.percentile("qrs_sec", share).alias("cut"))  # exact, so that SQL can be held against it; a stand-in only
    return rows.join(F.broadcast(cut), F.col("qrs_sec") >= F.col("cut")).select("recording_id", F.col("time_sec").alias("start_sec"), (F.col("time_sec") + length).alias("end_sec"))
