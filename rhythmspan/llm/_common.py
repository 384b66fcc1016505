"""What the operators of this subpackage share: scratch tables, batches, numpy hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run without blanks (space, tab, line feed, vertical tab, form feed, carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (single-machine tests) is a temporary folder set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = sc.getCheckpointDir()
    return named


def staged(df: DataFrame, what: str, tidy: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back, so that a lost executor costs no recomputation.

    ``tidy``: its shuffles go as soon as it is written, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    if tidy:
        spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A tidy ``staged`` whose tables go when the block ends; nothing read later may depend on them."""
    name = f"scratch-{uuid.uuid4().hex}"
    try:
        yield lambda df, what: staged(df, f"{name}/{what}", tidy=True)
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_of_id(column: str = "doc_id") -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def map_rows(df: DataFrame, build: Callable[[], Callable[[dict[str, list]], dict[str, Iterable]]], schema: str, rows: int = 512) -> DataFrame:
    """Apply a function of column lists to small slices of each Arrow batch.

    ``build`` runs once in each task (caches, lookup tables); what it returns gets a dict of
    column lists of at most ``rows`` rows and returns a dict with the columns of ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or build()
            for at in range(0, batch.num_rows, rows):
                got = work(batch.slice(at, rows).to_pydict())
                cols = [pa.array(got[f.name], type=f.type) for f in out]
                yield pa.RecordBatch.from_arrays(cols, schema=out)

    return df.mapInArrow(run, schema)


def rolling_hash(codes: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit polynomial hash of every run of k codes, by doubling the run length."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        power, length = codes.astype(np.uint64) + np.uint64(1), 1
        whole, done = None, 0
        bits = k
        while True:
            if bits & 1:  # append the run of this length to what is done
                if whole is None:
                    whole = power
                else:
                    m = len(power) - done
                    whole = whole[:m] * np.uint64(pow(base, length, 1 << 64)) + power[done:]
                done += length
            bits >>= 1
            if not bits:
                break
            power = power[:-length] * np.uint64(pow(base, length, 1 << 64)) + power[length:]
            length *= 2
        h = whole[:n].copy()
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def window_runs(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window): the rightmost minimum of each window of w hashes
    (of all, if fewer), one row for each run of windows that have it in common.

    Compared are the upper 40 bits; long inputs go in blocks, which changes no result.
    """
    n = len(h)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    w = min(w, n)
    block, chosen, begun = 1 << 18, [], []
    low = np.uint64((1 << 24) - 1)
    for at in range(0, n - w + 1, block):
        part = h[at : at + block + w - 1]
        m = len(part)
        key = (part & ~low) | (low - np.arange(m, dtype=np.uint64))
        length, best = 1, key
        while length * 2 <= w:
            best = np.minimum(best[:-length], best[length:])
            length *= 2
        if length < w:
            best = np.minimum(best[: m - w + 1], best[w - length : w - length + m - w + 1])
        first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
        chosen.append((low - (best[first] & low)).astype(np.int64) + at)
        begun.append(first + at)
    position, first = np.concatenate(chosen), np.concatenate(begun)
    new = np.r_[True, position[1:] != position[:-1]]
    position, first = position[new], first[new]
    return position, first, np.r_[first[1:], n - w + 1] - 1


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the rightmost minimum of some window of w hashes (of all, if fewer)."""
    return window_runs(h, w)[0]
