"""Tables between two steps, and the result, are in files by their rows, however many shuffle partitions there are."""

import random
from pathlib import Path
from urllib.parse import urlparse

import numpy as np

from rhythmspan.llm import simhash
from rhythmspan.llm._common import shared_dir, staged

PARTITIONS = 48


def dealt_wide(spark):
    wide = spark.newSession()
    wide.conf.set("spark.sql.shuffle.partitions", PARTITIONS)
    wide.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    return wide


def files_since(spark, before):
    """Most files of a table of each kind that came after ``before``."""
    most = {}
    for t in set(Path(urlparse(shared_dir(spark)).path).iterdir()) - before:
        kind = t.name.split("-")[0]
        most[kind] = max(most.get(kind, 0), len(list(t.glob("*.parquet"))))
    return most


def tables(spark):
    return set(Path(urlparse(shared_dir(spark)).path).iterdir())


def test_files_by_rows(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(120)]
    texts += [t + " more" for t in texts] + texts[:40]
    rows = list(enumerate(texts))
    wide, before = dealt_wide(spark), tables(spark)
    found = simhash.near_duplicates(wide.createDataFrame(rows, "doc_id long, text string"))
    got = {tuple(r) for r in found.collect()}
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    most = files_since(spark, before)
    assert {"distinct", "links"} <= most.keys()
    few = spark.sparkContext.defaultParallelism
    assert few < PARTITIONS / 2 and max(most["distinct"], most["links"]) <= few
    prints = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= simhash.RADIUS
    least = np.arange(len(texts))
    while True:
        lower = np.where(near, least[None, :], len(texts)).min(axis=1)
        if (lower == least).all():
            break
        least = lower
    assert got == {(i, f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints.tolist(), least.tolist(), strict=True))}


def test_components_of_counted_links(spark):
    wide = dealt_wide(spark)
    links = [(i, i + 1) for i in range(300) if i % 50 != 49] + [(1000, 2000 + i) for i in range(200)]
    df, before = wide.createDataFrame(links, "u long, v long"), tables(spark)
    got = {tuple(r) for r in simhash.connected_components(df).collect()}
    assert files_since(spark, before)["links"] <= spark.sparkContext.defaultParallelism
    assert got == {(i, i - i % 50) for i in range(300)} | {(1000, 1000)} | {(2000 + i, 1000) for i in range(200)}


def test_more_rows_more_files(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ROWS_A_TASK", 20)
    wide, before = dealt_wide(spark), tables(spark)
    staged(simhash._thin(wide.range(400).repartition(PARTITIONS, "id"), 400), "thin")
    assert files_since(spark, before)["thin"] == 20
