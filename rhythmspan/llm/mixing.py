"""Mixing sources to target weights by a time-varying curriculum, in built-in expressions only.

Each source has a total demand in words (water-filling of the weights under a cap on repeats)
and a weight schedule over training time t in [0, 1] that is linear: its rate at t is
``demand * (1 + tilt * (2 t - 1))``, whose integral over [0, 1] is the demand. A document's words
are met at a cumulative demand u (as a share of the source's); the integral
``(1 - tilt) t + tilt t^2 = u`` is inverted for its training position t, once for each pass over
the source, and documents are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD

WEIGHTS = (3, 1, 2)
#: Words asked for as a share of all words, and the most passes over a source.
TOTAL_SHARE, MAX_PASSES = 1.5, 2
#: Tilts of the schedules, repeating over the sources in order: early, even, late.
TILTS = (-0.5, 0.0, 0.5)
#: Leading hexadecimal digits of the order hash that make a bucket of its own: 4096 tasks can share a source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, total_share: float = TOTAL_SHARE, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row a source: ``source, source_ord, source_size, weight, target``.

    ``sizes`` has ``source`` and ``size``. Sources in code point order, null last, get the weights
    in turn. Target = min(max_passes * size, weight * level) with one level for all, which is
    where handing the excess of full sources to the others by weight ends. Sources are ranked in one
    task, a row of 40 bytes each: enough for millions of sources, not for one a document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_ord", F.row_number().over(ordered)).withColumns({"weight": _pick(weights, F.col("source_ord")), "cap": F.col("source_size") * max_passes})
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "source_ord")
    level = (F.sum("source_size").over(everything) * total_share - F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    per = per.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    common = F.max(F.when(~F.col("full"), F.struct(-F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    return per.select("source", "source_ord", "source_size", "weight", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(common * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, total_share: float = TOTAL_SHARE, max_passes: int = MAX_PASSES, tilts: tuple = TILTS, bucket_digits: int = BUCKET_DIGITS, ordered: bool = True) -> DataFrame:
    """Add ``size, source_size, target, taken, position, positions``; sorted by position, if ``ordered``.

    Within a source documents queue by the md5 of their id (ties: size, text hash). The source's
    demand ``floor(target)`` runs over the queue as often as needed, so ``taken`` sums to it
    exactly and a document gives at most ``max_passes`` times its size. ``positions`` has where in
    [0, 1] the curriculum meets the document, an entry for each pass that takes words of it;
    ``position`` is the first (null if there is none).

    Running sums are in two steps, buckets of the order hash first, so that a source with a third
    of all rows is summed by many tasks. Null text: size 0, taken 0. Null source: a source of its
    own, ordered last. Repeated rows are documents of their own. Clashing columns are replaced.
    An empty table gives an empty one.
    """
    new = ("size", "source_size", "target", "taken", "position", "positions")
    docs = docs.drop(*new)
    # a key that is never null: what is dealt by it for the queue needs no second exchange to meet the plan
    key = lambda source: F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))
    keyed = docs.withColumns({"size": word_count(F.col("text")), "__key": key(F.col("source")), "__order": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))}).withColumn("__bucket", F.substring("__order", 1, bucket_digits))
    sums = keyed.groupBy("source", "__bucket").agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), before.alias("__start"))
    targets = source_targets(sums, weights, total_share, max_passes).withColumn("__tilt", _pick(tilts, F.col("source_ord"))).select(F.col("source").alias("__ts"), "source_size", "target", "__tilt")
    plan = starts.join(targets, F.col("__s").eqNullSafe(F.col("__ts"))).withColumn("__k", key(F.col("__s"))).drop("__ts", "__s")

    ties = [F.col("__order"), F.col("size")] + ([F.xxhash64("text")] if "text" in docs.columns else [])
    queue = Window.partitionBy("__key", "__bucket").orderBy(*ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("__in", F.coalesce(F.sum("size").over(queue), F.lit(0)))
    joined = placed.join(plan, (F.col("__key") == F.col("__k")) & (F.col("__bucket") == F.col("__b")))
    at, demand = F.col("__start") + F.col("__in"), F.floor("target")
    passes = [F.least(F.greatest(demand - at - F.col("source_size") * i, F.lit(0)), F.col("size")) for i in range(max_passes)]
    taken = sum(passes[1:], passes[0])
    tilt = F.col("__tilt")

    def moment(i: int) -> Column:
        share = F.least((at + F.col("source_size") * i) / F.when(F.col("target") > 0, F.col("target")), F.lit(1.0))
        return F.round(F.when(tilt == 0, share).otherwise((F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share) - (1 - tilt)) / (2 * tilt)), 9)

    met = F.array_compact(F.array(*[F.when(words > 0, moment(i)) for i, words in enumerate(passes)]))
    out = joined.withColumn("taken", taken.cast("long")).withColumn("positions", met).withColumn("position", F.get("positions", F.lit(0)))
    out = out.select(*docs.columns, *new)
    return out.orderBy(F.col("position").asc_nulls_last(), F.col("doc_id")) if ordered else out
