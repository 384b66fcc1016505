"""Sharding by jump consistent hashing, in built-in expressions only.

A row's shard follows from its key and the number of shards alone; one more shard takes rows
only into itself. There is no ring table and nothing is broadcast but a few thousand counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of jump consistent hashing: the 64-bit multiplier of its generator, in two halves.
MULTIPLIER_HIGH = 2862933555777941757 >> 32
MULTIPLIER_LOW = 2862933555777941757 & 0xFFFFFFFF

#: Salt values within a shard, each numbered by its own task.
SALTS = 256


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """state * multiplier + 1 modulo 2^64, in 16-bit steps that stay below 2^63 (safe in ANSI mode)."""
    first = low.bitwiseAND(0xFFFF) * MULTIPLIER_LOW + 1
    second = F.shiftright(low, 16) * MULTIPLIER_LOW + F.shiftright(first, 16)
    new_low = F.shiftleft(second.bitwiseAND(0xFFFF), 16).bitwiseOR(first.bitwiseAND(0xFFFF))
    upper = (
        F.shiftright(second, 16)
        + high.bitwiseAND(0xFFFF) * MULTIPLIER_LOW
        + F.shiftleft((F.shiftright(high, 16) * MULTIPLIER_LOW).bitwiseAND(0xFFFF), 16)
        + low * MULTIPLIER_HIGH
    )
    return upper.bitwiseAND(0xFFFFFFFF), new_low


def jump_hash(key: Column, shards: int) -> Column:
    """STRUCT(shard, grown): the shard of ``key`` (LONG) among ``shards``, and among one more.

    A null key counts as 0.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(0xFFFFFFFF).alias("low"),
        F.lit(-1).cast("long").alias("shard"),
        F.lit(-1).cast("long").alias("grown"),
        F.lit(0).cast("long").alias("jump"),
    )

    def step(acc: Column, _: Column) -> Column:
        high, low = _next_state(acc["high"], acc["low"])
        at = acc["jump"]
        leap = F.floor((at + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double")))
        return F.when(at > shards, acc).otherwise(
            F.struct(
                high.alias("high"),
                low.alias("low"),
                F.when(at < shards, at).otherwise(acc["shard"]).alias("shard"),
                at.alias("grown"),
                leap.alias("jump"),
            )
        )

    # each step moves the jump on by one at least, so shards + 1 steps always suffice
    last = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    return F.transform(F.array(last), lambda x: F.struct(x["shard"].cast("int").alias("shard"), x["grown"].cast("int").alias("grown")))[0]


def assign_shards(docs: DataFrame, shards: int = 40, key: str = "doc_id", salts: int = SALTS, within: tuple[str, ...] = ()) -> DataFrame:
    """Add ``shard``, ``grown_shard`` (with one shard more) and ``slot``, gapless from 0 in each shard.

    Rows of a shard are numbered by salt (from the key's md5), then by key and by the other
    sort columns; only shard x salt counts (``shards * salts`` rows at most) are summed up and
    broadcast. ``within`` names columns to number by instead: a column of contiguous ranges (a file of
    a sorted table) stands for the salt, the others order the rows in it; then the counts are joined
    by a shuffle. Nulls: a null key goes where 0 goes. Repeated keys get the same shard and their
    own slots, ordered by ``size`` and ``text_crc32`` where the frame has them. An empty table
    gives an empty table. Columns of the input that clash with the new ones are replaced.
    """
    new = ("shard", "grown_shard", "slot")
    docs = docs.drop(*new)
    salt = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(salts)).cast("int")
    placed = docs.withColumns({"__jump": jump_hash(F.col(key), shards), "__salt": F.col(within[0]) if within else salt}).withColumns({"shard": F.col("__jump.shard"), "grown_shard": F.col("__jump.grown")}).drop("__jump")
    counts = placed.groupBy("shard", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "__salt", before.alias("__start"))
    order = [F.col(c).asc_nulls_last() for c in (*within[1:], key, "size", "text_crc32") if c in docs.columns]
    rank = F.row_number().over(Window.partitionBy("shard", "__salt").orderBy(*order))
    joined = placed.withColumn("__rank", rank).join(starts if within else F.broadcast(starts), ["shard", "__salt"])
    return joined.withColumn("slot", F.col("__start") + F.col("__rank") - 1).select(*docs.columns, "shard", "grown_shard", F.col("slot").cast("long").alias("slot"))


def with_size(docs: DataFrame) -> DataFrame:
    """Add ``size`` (UTF-8 bytes of the text, none if null, plus 16) and ``text_crc32`` (of the UTF-8 bytes; null: of none)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"size": F.octet_length(text).cast("long") + 16, "text_crc32": F.crc32(text.cast("binary"))})
