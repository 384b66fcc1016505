"""Rows of a key in order, walked batch by batch with a small state; tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
#: Rows of a column each, as numpy has them; a null number is NaN.
Rows = dict[str, np.ndarray]


def runs_of(batch: pa.RecordBatch, key: tuple[str, ...]) -> tuple[list[int], list[tuple]]:
    """Where each run of rows of one key begins in a batch that is not empty, and the keys."""
    same = np.ones(batch.num_rows - 1, bool)
    for c in key:
        codes = batch[c].dictionary_encode().indices.to_numpy(zero_copy_only=False)
        same &= codes[1:] == codes[:-1]
    starts = np.flatnonzero(np.r_[True, ~same])
    return starts.tolist(), list(zip(*(batch[c].take(pa.array(starts)).to_pylist() for c in key), strict=True))


def walked(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...], walker: Callable, schema: str) -> DataFrame:
    """Hand the rows of each key, in order, to an own ``walker()``, as many at a time as an Arrow batch has.

    The walker has ``take(rows)``, which returns the rows that are settled, and ``rest()``, which returns
    what is left when the key ends (both may return None). Rows are a dict of arrays, so that many short
    keys cost little each; those returned have the columns of ``schema`` but for the key, and NaN is null.
    A task holds one batch and one walker at a time, so a key of any length fits.
    """
    columns = dict(c.split() for c in schema.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at_work, keys, out = None, None, [], []

        def put(found: Rows | None) -> None:
            if found is not None and len(found[others[0]]):
                keys.append(current), out.append(found)

        def batch_of() -> pa.RecordBatch:
            sizes = np.array([len(o[others[0]]) for o in out])
            of_key = {c: pa.array([k[i] for k in keys], ARROW[columns[c]]).take(pa.array(np.repeat(np.arange(len(keys)), sizes))) for i, c in enumerate(key)}
            arrays = [of_key[c] if c in of_key else pa.array(np.concatenate([o[c] for o in out]), from_pandas=True).cast(ARROW[t]) for c, t in columns.items()]
            return pa.RecordBatch.from_arrays(arrays, names=list(columns))

        others = [c for c in columns if c not in key]
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, names = runs_of(batch, key)
            values = {c: batch[c].to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in key}
            for own, a, b in zip(names, starts, [*starts[1:], batch.num_rows], strict=True):
                if own != current:
                    if at_work:
                        put(at_work.rest())
                    current, at_work = own, walker()
                put(at_work.take({c: v[a:b] for c, v in values.items()}))
            if out:
                yield batch_of()
                keys, out = [], []
        if at_work:
            put(at_work.rest())
            if out:
                yield batch_of()

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where the session names no such folder (single-machine tests) is a temporary one set."""
    sc = spark.sparkContext
    if not (folder := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = sc.getCheckpointDir()
    return folder


def written(rows: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """The table, written to the shared folder and read back, so that several uses compute it once."""
    path = f"{shared_folder(rows.sparkSession)}/{what}-{uuid.uuid4().hex}"
    rows.write.option("compression", compression).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
