"""Waveforms from images of recorder cards, many cards in one job.

Cards on disk are read by ranges of 512-byte blocks, so a card of any size is the work of several
tasks, and of what an older recording has left on it no task reads more than a block. Blocks are
cut and unpacked map-side; only thin rows (keys, sums of deltas) meet in windows, so a long card
is not decoded in one task. What is wrong with a card is a row of :func:`rejects`, not an exception
that ends the job. Images that are columns of a table (``content``) are cut
where they are, and go on as blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ordered import written
from ..samples import pack

# Fixed values of the card format.
BLOCK, POINTS, CHANNELS, RATE = 512, 304, 3, 180
CHECKSUM, STEP, MARKER, MILLIVOLTS = 0x4CB31, 1216, 8, 0.0125
DELTAS = (0, 1, 3, 6, 12, 21, 38, 70, 0, -70, -38, -21, -12, -6, -3, -1)

BLOCKS = (
    "path string, block_idx long, ecg boolean, empty boolean, error string, position long, sequence int, serial int, detail int, press int, live boolean, body binary"
)
CHANNEL_NAMES = ("Ch 1", "Ch 2", "Ch 3")
WAVEFORM = "path string, channel int, chunk_idx long, first_sample long, samples array<double>"
#: Blocks that are in memory at once, and that one task reads of a card (64 MB).
BATCH, RANGE = 4096, 131_072
#: Blocks of the parts that an image in a table is cut into, one after the other.
CUTS = (2048, 64, 8, 1)


def kind_of(path: Column, head: Column) -> Column:
    """'native' or 'unsupported', by name and by how the content begins."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    begins = (F.hex(F.substring(head, 1, 4)) == "00020000") & (F.instr(F.decode(head, "ISO-8859-1"), "SampleRate=") > 0)
    return F.when((name == "flash.dat") | (name.endswith(".dat") & begins), "native").otherwise("unsupported")


def _opened(path: str) -> BinaryIO:
    """A file of the shared storage, opened for reading at any place."""
    if path.startswith("file:") or "://" not in path:
        return open(unquote(urlparse(path).path) if path.startswith("file:") else path, "rb")
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def read_cards(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, kind`` of the files of a folder (or pattern); of each no more than a block is read. Spark lists no empty files."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["path"]:
                with _opened(path) as card:
                    found.append(card.read(BLOCK))
            yield batch.assign(head=found)

    listed = spark.read.format("binaryFile").load(folder).select("path", "length")  # names and sizes; no content
    return listed.mapInPandas(heads, "path string, length long, head binary").select("path", "length", kind_of(F.col("path"), F.col("head")).alias("kind"))


def ranges(cards: DataFrame, blocks_each: int = RANGE) -> DataFrame:
    """``path, from_block, to_block`` of native cards (``path, length, kind``), spread over tasks; a rest shorter than a block counts as one."""
    n = F.ceil(F.col("length") / BLOCK)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)), F.lit(blocks_each).cast("long")))
    rows = cards.where("kind = 'native' and length > 0").select("path", n.alias("__n"), starts.alias("from_block"))
    rows = rows.select("path", "from_block", F.least(F.col("from_block") + blocks_each, F.col("__n")).alias("to_block"))
    return rows.repartition("path", "from_block")


def session_key(block: bytes) -> bytes | None:
    """Sequence and serial of an ECG block."""
    return block[466:470] if len(block) == BLOCK and block[4:6] == b"\x1e\0" else None


def _read(path: str, first: int, after: int) -> Iterator[pd.DataFrame]:
    """Blocks of a range, so many at a time, up to the first ECG block of another recording than the card's first one, which is the last one given."""
    with _opened(path) as card:
        card.seek(BLOCK)
        own = session_key(card.read(BLOCK))
        card.seek(first * BLOCK)
        at, step = first, 1 if first else BATCH  # a later range looks at one block before it reads on
        while at < after:
            content = card.read(min(step, after - at) * BLOCK)
            whole = len(content) // BLOCK
            keys = [session_key(content[i * BLOCK : (i + 1) * BLOCK]) for i in range(whole)]
            foreign = next((i for i, k in enumerate(keys) if own and k and k != own), None)
            if foreign is not None:
                yield from _cut(path, content[: (foreign + 1) * BLOCK], at)
                return
            yield from _cut(path, content, at)
            if len(content) < min(step, after - at) * BLOCK:
                return
            at, step = at + whole, BATCH


def _cut(path: str, content: bytes, first: int = 0) -> Iterator[pd.DataFrame]:
    """Blocks of one card from its ``first`` on, so many at a time; a rest shorter than a block is an error unless it is zeros."""
    whole = len(content) // BLOCK
    image = np.frombuffer(content, dtype=np.uint8, count=whole * BLOCK).reshape(-1, BLOCK)
    for at in range(0, whole, BATCH):
        rows = image[at : at + BATCH]
        yield _judged(path, np.arange(first + at, first + at + len(rows)), rows)
    rest = content[whole * BLOCK :]
    if rest.strip(b"\0"):
        yield _truncated(path, first + whole, rest)


def _judged(path: str | np.ndarray, block_idx: np.ndarray, rows: np.ndarray) -> pd.DataFrame:
    """``BLOCKS`` of whole blocks, a row of bytes each."""
    number = lambda a, b: np.ascontiguousarray(rows[:, a:b]).view(f"<u{b - a}")[:, 0].astype(np.int64)
    empty, ecg = ~rows.any(axis=1), (rows[:, 4] == 0x1E) & (rows[:, 5] == 0)
    low, high = (rows[:, 10:466] & 15) == MARKER, (rows[:, 10:466] >> 4) == MARKER
    marked = low.any(axis=1) | high.any(axis=1)  # most blocks hold no marker, and then points need no look
    some, every = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    marks = nibbles(rows[marked, 10:466]) == MARKER
    some[marked], every[marked] = (marks.any(axis=2) != marks.all(axis=2)).any(axis=1), marks.all(axis=(1, 2))
    checks = (
        (~empty & (number(0, 4) != BLOCK), "length"),
        (~empty & (rows[:, :508].sum(axis=1, dtype=np.int64) + number(508, 512) != CHECKSUM), "checksum"),
        (ecg & some, "marker"),
    )
    raw = rows.tobytes()
    body = [raw[k + 10 : k + 466] if e else raw[k + 6 : k + 508] for k, e in zip(range(0, len(raw), BLOCK), ecg.tolist(), strict=True)]
    return pd.DataFrame(
        {
            "path": path, "block_idx": block_idx, "ecg": ecg, "empty": empty, "error": np.select([c for c, _ in checks], [n for _, n in checks], None),
            "position": number(6, 10), "sequence": number(466, 468), "serial": number(468, 470), "detail": rows[:, 470].astype(int), "press": rows[:, 471].astype(int), "live": ecg & ~every, "body": body,
        }
    )


def _truncated(path: str, block_idx: int, rest: bytes) -> pd.DataFrame:
    return pd.DataFrame([{"path": path, "block_idx": block_idx, "ecg": False, "empty": False, "error": "truncated", "position": 0, "sequence": 0, "serial": 0, "detail": 0, "press": 0, "live": False, "body": rest}])


def nibbles(body: np.ndarray) -> np.ndarray:
    """Codes (blocks, points, channels) of packed bytes, low half first."""
    return np.stack([body & 15, body >> 4], axis=2).reshape(len(body), POINTS, CHANNELS)


def _parts(rows: DataFrame, size: int) -> DataFrame:
    """``path, block_idx, block`` cut into parts of ``size`` blocks."""
    part = lambda i: F.substring("block", (i * (size * BLOCK) + 1).cast("int"), F.lit(size * BLOCK))
    starts = F.sequence(F.lit(0).cast("long"), F.ceil(F.length("block") / (size * BLOCK)) - 1)
    each = F.transform(starts, lambda i: F.struct((F.col("block_idx") + i * size).alias("block_idx"), part(i).alias("block")))
    return rows.select("path", F.explode(each).alias("b")).select("path", "b.block_idx", "b.block")


def as_blocks(cards: DataFrame) -> DataFrame:
    """``path, block_idx, block`` of images in a table, a row of 512 bytes each: a batch of whole images would grow with their size.

    Each cut copies what it is cut from, so images are cut into large parts, those into smaller ones and those into blocks.
    """
    rows = cards.where("kind = 'native' and length(content) > 0").select("path", F.lit(0).cast("long").alias("block_idx"), F.col("content").alias("block"))
    return reduce(_parts, CUTS, rows)


def blocks(cards: DataFrame) -> DataFrame:
    """``BLOCKS`` of the native cards (``path, kind`` and ``length``, or ``content`` of images in a table).

    ``body`` is the packed ECG, or the text of another block. Of a card on disk each range ends with the
    first block of another recording, if it holds one.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = (batch["block"].str.len() == BLOCK).to_numpy(bool)
            for i in range(0, len(batch), BATCH):
                part, of = batch.iloc[i : i + BATCH], whole[i : i + BATCH]
                if of.any():
                    rows = part[of]
                    image = np.frombuffer(b"".join(map(bytes, rows["block"])), dtype=np.uint8).reshape(-1, BLOCK)
                    yield _judged(rows["path"].to_numpy(), rows["block_idx"].to_numpy(), image)
                for r in part[~of].itertuples():
                    if bytes(r.block).strip(b"\0"):
                        yield _truncated(r.path, r.block_idx, bytes(r.block))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                yield from _read(r.path, r.from_block, r.to_block)

    if "content" in cards.columns:
        return as_blocks(cards).mapInPandas(cut, BLOCKS)
    return ranges(cards).mapInPandas(read, BLOCKS)


def session(rows: DataFrame) -> DataFrame:
    """Blocks up to the first ECG block of another recording than the first one's; add ``ordinal`` of the ECG blocks.

    What a reused card still holds of older recordings goes before anything is unpacked or judged. Where a
    session ends is found from thin rows: of the keys on a card, the second one to begin ends it. ``rows``
    are read twice, so give them written (:func:`opened`).
    """
    keys = rows.where("ecg").groupBy("path", "sequence", "serial").agg(F.min(F.struct("block_idx", "position")).alias("__f"))
    order = Window.partitionBy("path").orderBy("__f.block_idx")
    keys = keys.select("path", F.col("__f.position").alias("__from"), F.lead("__f.block_idx").over(order).alias("__end"), F.row_number().over(order).alias("__n"))
    kept = rows.join(keys.where("__n = 1").drop("__n"), "path", "left").where(F.col("__end").isNull() | (F.col("block_idx") < F.col("__end")))
    return kept.withColumn("ordinal", F.when(F.col("ecg"), F.floor((F.col("position") - F.col("__from")) / STEP))).drop("__from", "__end")


def opened(cards: DataFrame) -> DataFrame:
    """The blocks of each card's session, written; each card is cut into blocks once."""
    return written(session(written(blocks(cards), "read")), "blocks")


def headers(kept: DataFrame) -> DataFrame:
    """``path, fields, start_time`` from the first block: trimmed ``key=value`` lines; of a repeated key the last; a missing clock is null."""
    text = F.rtrim(F.translate(F.decode("body", "ISO-8859-1"), "\0\r", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains("="))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    rows = kept.where("block_idx = 0 and not ecg").select("path", pairs.alias("__all"))
    last = F.filter("__all", lambda x, i: ~F.exists(F.slice("__all", i + 2, F.size("__all")), lambda y: y["k"] == x["k"]))
    rows = rows.select("path", F.map_from_entries(last).alias("fields"))
    return rows.withColumn("start_time", start_clock(F.col("fields")["start_date"], F.col("fields")["start_time"]))


def start_clock(date: Column, time: Column) -> Column:
    """Clock of the recorder: a date with a year of two digits, or of four, and a time; null if unreadable or missing."""
    text = F.concat_ws(" ", date, time)
    read = F.coalesce(F.try_to_timestamp(text, F.lit("M/d/yy H:m:s")), F.try_to_timestamp(text, F.lit("M/d/yyyy H:m:s")))
    return F.when(date.isNotNull() & time.isNotNull(), read.cast("timestamp_ntz"))


def rejects(cards: DataFrame, kept: DataFrame) -> DataFrame:
    """``path, reason`` of the native cards (``path, kind``) that can't be used; the first bad block gives the reason."""
    before = Window.partitionBy("path").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    thin = kept.select("path", "block_idx", "ecg", "empty", "error", "position", "live")
    thin = thin.withColumns({"__padded": F.max("empty").over(before), "__at": F.last(F.when(F.col("ecg"), F.col("position")), ignorenulls=True).over(before)})
    fault = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("empty") & F.col("__padded"), "data after padding").when(F.col("ecg") & (F.col("position") - F.col("__at") != STEP), "not contiguous")
    first = F.min(F.when(fault.isNotNull(), F.struct("block_idx", fault.alias("reason"))))
    counts = thin.groupBy("path").agg(F.count_if("ecg").alias("n"), F.count_if("live").alias("live"), first["reason"].alias("reason"))
    fields = headers(kept).select("path", "fields", "start_time")
    whole = cards.where("kind = 'native'").select("path").join(counts, "path", "left").join(fields, "path", "left")
    get = F.col("fields")
    reason = (
        F.when(F.col("n").isNull(), "empty").when(F.col("reason").isNotNull(), F.col("reason")).when(get.isNull(), "no metadata")
        .when(~F.coalesce(get["SampleStorageFormat"] == "1", F.lit(False)), "unsupported mode").when(~F.coalesce(F.expr("try_cast(fields['SampleRate'] as double)") == RATE, F.lit(False)), "unsupported rate")
        .when(F.col("n") == 0, "no ECG blocks").when(F.col("live") == 0, "only markers").when(get["start_date"].isNotNull() & get["start_time"].isNotNull() & F.col("start_time").isNull(), "bad start date")
    )
    return whole.select("path", reason.alias("reason")).where("reason is not null")


def usable(kept: DataFrame, rejected: DataFrame) -> DataFrame:
    """The blocks of cards without a reason to reject them."""
    return kept.join(rejected.select("path"), "path", "left_anti")


def presses(kept: DataFrame) -> DataFrame:
    """``path, time_sec, type_index, label, detail`` of the diary button, labelled by the card's own list."""
    names = F.filter(F.transform(F.split(F.col("fields")["DiaryText"], r"\^"), lambda x: F.trim(x)), lambda x: x != "")
    rows = kept.where("ecg and press <> 0").join(headers(kept), "path", "left")
    label = F.coalesce(F.try_element_at(names, F.col("press")), F.concat(F.lit("Event type "), F.col("press")))
    return rows.select("path", (F.col("ordinal") * POINTS / RATE).alias("time_sec"), F.col("press").alias("type_index"), label.alias("label"), "detail")


#: Of an ECG block: what its codes add up to, and its first and last point that is no marker with the levels there, an entry a channel.
SUMS = "path string, ordinal long, total array<long>, first_at long, first_count array<long>, last_at long, last_count array<long>"
#: Blocks unpacked at once: arrays of theirs stay in a core's cache.
UNPACKED = 256


def _levels(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Running sums (blocks, channels, points) inside each block, and which points are no markers."""
    codes = np.ascontiguousarray(nibbles(np.frombuffer(b"".join(bodies), dtype=np.uint8).reshape(len(bodies), -1)).transpose(0, 2, 1))
    return np.cumsum(np.array(DELTAS, dtype=np.int64)[codes], axis=2), codes[:, 0] != MARKER


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SUMS.split(", ")]
    for batch in batches:
        for i in range(0, batch.num_rows, UNPACKED):
            part = batch.slice(i, UNPACKED)
            level, good = _levels(part["body"].to_pylist())
            none, first, last = ~good.any(axis=1), good.argmax(axis=1), POINTS - 1 - good[:, ::-1].argmax(axis=1)
            row = np.arange(len(level))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * CHANNELS, pa.int32()), pa.array(x.ravel(), pa.int64()))
            at = lambda x, none=none: pa.array(x, pa.int64(), mask=none)
            yield pa.RecordBatch.from_arrays([part["path"], part["ordinal"], lists(level[:, :, -1]), at(first), lists(level[row, :, first]), at(last), lists(level[row, :, last])], names=names)


def _side(points: list[dict | None], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the last or next point outside of each block is (NaN: there is none), and its levels."""
    at = np.array([p["at"] if p else np.nan for p in points]) - start
    return at, np.array([p["count"] if p else [0] * CHANNELS for p in points], dtype=np.float64)


def _lines(values: np.ndarray, good: np.ndarray, before: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks with lines drawn over what is not ``good``, and which of them have no known point on either side; beyond the last known one its level goes on."""
    point, row = np.arange(POINTS), np.arange(len(good))[:, None]
    left = np.maximum.accumulate(np.where(good, point, -1), axis=1)
    right = np.minimum.accumulate(np.where(good, point, POINTS)[:, ::-1], axis=1)[:, ::-1]
    x0, x1 = np.where(left >= 0, left, before[0][:, None]), np.where(right < POINTS, right, after[0][:, None])
    out = values.copy()
    for c in range(CHANNELS):
        y0 = np.where(left >= 0, values[row, c, left], before[1][:, c, None])
        y1 = np.where(right < POINTS, values[row, c, np.minimum(right, POINTS - 1)], after[1][:, c, None])
        with np.errstate(invalid="ignore", divide="ignore"):
            line = (y1 - y0) / (x1 - x0) * (point - x0) + y0
        out[:, c] = np.where(good, values[:, c], np.where(np.isnan(x0), y1, np.where(np.isnan(x1), y0, line)))
    return out, ~good.any(axis=1) & np.isnan(before[0]) & np.isnan(after[0])


def _finish(batches: Iterator[pa.RecordBatch], packed: bool = False) -> Iterator[pa.RecordBatch]:
    """Add the sum of the blocks before, draw lines over markers, scale; a channel of markers alone stays null."""
    names = [c.split()[0] for c in WAVEFORM.split(", ")]
    for batch in batches:
        for i in range(0, batch.num_rows, UNPACKED):
            part = batch.slice(i, UNPACKED)
            level, good = _levels(part["body"].to_pylist())
            n = len(level)
            values = (level + np.array(part["carry"].to_pylist(), dtype=np.int64)[:, :, None]).astype(np.float64)  # a row a channel
            unknown = np.zeros(n, bool)
            marked = np.flatnonzero(~good.all(axis=1))
            if len(marked):
                # positions of other blocks are counted from this one's first sample
                start = part["ordinal"].to_numpy(zero_copy_only=False)[marked] * POINTS
                sides = [_side(part[c].take(pa.array(marked)).to_pylist(), start) for c in ("before", "after")]
                values[marked], unknown[marked] = _lines(values[marked], good[marked], *sides)
            ordinal = np.repeat(part["ordinal"].to_numpy(zero_copy_only=False), CHANNELS)
            ends, flat, none = np.arange(n * CHANNELS + 1) * POINTS, (values * MILLIVOLTS).ravel(), np.repeat(unknown, CHANNELS)
            samples = pack(ends, flat, none) if packed else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array(none))
            path = part["path"].take(pa.array(np.repeat(np.arange(n), CHANNELS)))
            yield pa.RecordBatch.from_arrays([path, pa.array(np.tile(np.arange(CHANNELS, dtype=np.int32), n)), pa.array(ordinal), pa.array(ordinal * POINTS), samples], names=names)


def waveform(kept: DataFrame, packed_samples: bool = False) -> DataFrame:
    """``WAVEFORM`` in millivolts: one chunk a block and channel. Leave out the cards of :func:`rejects` first (:func:`usable`).

    With ``packed_samples`` they are binary (:mod:`samples`), which costs less to write and to read.
    Blocks are unpacked twice, which is cheap, and meet in the shuffles packed: unpacked ones take 16 times the room.
    """
    packed = kept.where("ecg").select("path", "ordinal", "body")
    by = Window.partitionBy("path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("path").orderBy(F.col("ordinal").desc()).rowsBetween(Window.unboundedPreceding, -1)
    thin = packed.mapInArrow(_sums, SUMS)
    carries = [F.coalesce(F.sum(F.col("total")[c]).over(by), F.lit(0).cast("long")) for c in range(CHANNELS)]
    thin = thin.withColumn("carry", F.array(*carries))
    level = lambda side: F.transform(F.arrays_zip("carry", f"{side}_count"), lambda x: x["carry"] + x[f"{side}_count"])
    point = lambda side: F.when(F.col(f"{side}_at").isNotNull(), F.struct((F.col("ordinal") * POINTS + F.col(f"{side}_at")).alias("at"), level(side).alias("count")))
    thin = thin.withColumns({"__first": point("first"), "__last": point("last")}).select("path", "ordinal", "carry", "__first", "__last")
    thin = thin.withColumn("before", F.last("__last", ignorenulls=True).over(by)).withColumn("after", F.last("__first", ignorenulls=True).over(down))
    return packed.join(thin.select("path", "ordinal", "carry", "before", "after"), ["path", "ordinal"]).mapInArrow(partial(_finish, packed=packed_samples), WAVEFORM.replace("array<double>", "binary") if packed_samples else WAVEFORM)
