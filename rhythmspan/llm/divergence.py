"""Which words set a source apart from its language, and how far sources are from each other.

Words are counted in tasks and summed by language, word and source. A word's postings (its count in
each source) carry its count in the language. Distances of sources come from the postings: of all
words a pair shares no word needs more than the two smoothed shares of an unseen word, so only words
that both have are met pair by pair, in numpy matrices of blocks of sources. Telling words come by
upper bounds: buckets of counts in a group, each with the least share its words have in the
language, are taken best first; once the 50th value found is above every bound left, the rest of
the words is not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged

#: Documents of its language that a word must be in, the share's unit, what each count is raised by, words reported.
MIN_DOCS, UNIT, SMOOTHING, TOP = 30, 1_000_000_000, 5, 50
#: Sources in a block; words that a task counts before it hands them on.
BLOCK, HELD = 256, 300_000
#: Bytes by what they count as: ASCII letters in lower case, other ASCII a blank, bytes of other characters themselves.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` (occurrences and documents), partial sums of tasks; nulls count as ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in counts.items():
                terms = list(n)
                for at in range(0, len(terms), 50_000):
                    part = terms[at : at + 50_000]
                    same = [pa.array([v]).take(pa.array(np.zeros(len(part), np.int32))) for v in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            counts.clear()

        for batch in batches:
            columns = [batch.column(c) for c in ("lang", "source", "text")]
            for lang, source, text in zip(*(c.cast(pa.binary()).to_pylist() if i == 2 else c.to_pylist() for i, c in enumerate(columns)), strict=True):
                n, docs = counts.setdefault((lang or "", source or ""), (Counter(), Counter()))
                words = (text or b"").translate(LOWERED).split()
                n.update(words)
                docs.update(set(words))
            if sum(len(n) for n, _ in counts.values()) > HELD:
                yield from out()
        yield from out()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTHING) / total), exact in longs for totals below 9e15: nine digits in three steps.

    0 where the total is 0.
    """
    div = lambda a, b: F.call_function("div", a, b)
    rest, found = count + SMOOTHING, F.lit(0).cast("long")
    for step in range(3):
        raised = rest * 1000
        found, rest = found * 1000 + div(raised, total), raised % total
    return F.when(total > 0, found + 1).otherwise(F.lit(0).cast("long"))


def postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, source, n, lang_n, first`` of the words that at least ``min_docs`` documents of the language have, written.

    ``first`` marks one row of each word of a language.
    """
    counts = count_terms(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    kept = counts.withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term), "at": F.row_number().over(term.orderBy("source"))}).where(F.col("lang_docs") >= min_docs)
    return staged(kept.select("lang", "term", "source", "n", "lang_n", (F.col("at") == 1).alias("first")), "postings")


def audit_groups(docs: DataFrame, posts: DataFrame) -> DataFrame:
    """``lang, source, sid, total, lang_total, terms, base`` of every (lang, source) of the documents.

    ``total`` is N + SMOOTHING * V of the group, ``terms`` V, ``base`` the share of a word that the
    group has not; ``sid`` numbers the sources of a language from 0.
    """
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = posts.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    langs = posts.groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum(F.col("first").cast("long")).alias("v"))
    known = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["own_n", "all_n", "v"])
    sid = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    totals = known.select("lang", "source", sid.alias("sid"), (F.col("own_n") + F.col("v") * SMOOTHING).alias("total"), (F.col("all_n") + F.col("v") * SMOOTHING).alias("lang_total"), F.col("v").alias("terms"))
    return totals.withColumn("base", share(F.lit(0).cast("long"), F.col("total")))


def telling_terms(posts: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, source, item, value, rank``: the words of a group whose share is most above the language's, exact.

    A bucket is the words of a group with counts of one length in bits and the same next three bits.
    Its bound: the share of its largest count less the least share in the language of its words.
    Best first, as many buckets as hold ``top`` words are evaluated; what they give as the
    ``top``-th value lets all buckets go whose bound is strictly below it.
    """
    group = ["lang", "source"]
    bits = F.bin("n")
    bucketed = posts.select(*group, "term", "n", "lang_n", F.concat_ws(":", F.length(bits), F.substring(bits, 1, 4)).alias("bucket"))
    extremes = bucketed.groupBy(*group, "bucket").agg(F.max("n").alias("most"), F.min("lang_n").alias("least"), F.count(F.lit(1)).alias("held"))
    bounds = extremes.join(groups, group).withColumn("bound", share(F.col("most"), F.col("total")) - share(F.col("least"), F.col("lang_total")))
    best_first = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    order = bounds.where("bound > 0").select(*group, "bucket", "bound", "total", "lang_total", (F.coalesce(F.sum("held").over(best_first), F.lit(0)) < top).alias("early"))

    def evaluated(buckets: DataFrame) -> DataFrame:
        f = share(F.col("n"), F.col("total")) - share(F.col("lang_n"), F.col("lang_total"))
        return bucketed.join(buckets, [*group, "bucket"]).select(*group, F.col("term").alias("item"), f.alias("value")).where("value > 0")

    ranked = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    rank = F.row_number().over(ranked)
    first = evaluated(order.where("early")).withColumn("rank", rank).where(F.col("rank") <= top)
    kth = first.where(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
    unseen = order.where("not early").join(kth, group, "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).drop("kth")
    both = first.drop("rank").unionByName(evaluated(unseen))
    return both.withColumn("rank", rank).where(F.col("rank") <= top)


def unshared(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``lang, one, other, apart``: for each pair of sources of a language (by ``sid``, one < other) the
    distance it would have if no word were in both.

    By |p - q| = p + q - 2 min(p, q): of a pair, the source of the smaller base gives, for each of
    its words, the lesser of the word's share and the other's base. Shares come as sorted counts of
    equal shares with running sums, so a pair costs one search.
    """
    each = shares.groupBy("lang", "sid", "p").agg(F.count(F.lit(1)).alias("words"))
    lists = each.groupBy("lang", "sid").agg(F.sort_array(F.collect_list(F.struct("p", "words"))).alias("held"))
    above = shares.groupBy("lang", "sid").agg(F.sum(F.col("p") - F.col("base")).alias("above"))
    known = groups.select("lang", "sid", "base", "terms").join(lists, ["lang", "sid"], "left").join(above, ["lang", "sid"], "left")
    known = known.withColumn("whole", F.coalesce("above", F.lit(0)) + F.col("terms") * F.col("base"))
    block = F.floor(F.col("sid") / BLOCK).alias("block")
    others = known.groupBy("lang", block).agg(F.collect_list(F.struct("sid", "base", "whole")).alias("others"))  # BLOCK at most
    met = known.select("lang", "sid", "base", "terms", "whole", F.col("held.p").alias("p"), F.col("held.words").alias("words")).join(others.select("lang", "others.sid", "others.base", "others.whole").toDF("lang", "sids", "bases", "wholes"), "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, sid, base, terms, whole = (batch.column(c)[i].as_py() for c in ("lang", "sid", "base", "terms", "whole"))
                p, words, sids, bases, wholes = (np.array(batch.column(c)[i].as_py() or [], np.int64) for c in ("p", "words", "sids", "bases", "wholes"))
                later = (bases > base) | ((bases == base) & (sids > sid))
                sids, bases, wholes = sids[later], bases[later], wholes[later]
                n, sums = np.r_[0, np.cumsum(words)], np.r_[0, np.cumsum(words * p)]
                at = np.searchsorted(p, bases)
                least = terms * base + sums[at] + (n[-1] - n[at]) * bases - n[-1] * base
                one, other = np.minimum(sids, sid).astype(np.int32), np.maximum(sids, sid).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sids), pa.string()), pa.array(one), pa.array(other), pa.array(whole + wholes - 2 * least)], names=["lang", "one", "other", "apart"])

    return met.mapInArrow(run, "lang string, one int, other int, apart long")


def shared_terms(shares: DataFrame) -> DataFrame:
    """``lang, one, other, nearer``: what the words that both have take off each pair's distance.

    Postings of a word are gathered by blocks of ``BLOCK`` sources; two blocks of a word meet by a
    join on it. A task goes through its rows by block pair and holds one matrix of sums at a time.
    """
    entry = F.struct((F.col("sid") % BLOCK).cast("int").alias("slot"), "p", "base")
    held = shares.repartition("lang", "term").groupBy("lang", "term", F.floor(F.col("sid") / BLOCK).cast("int").alias("block")).agg(F.collect_list(entry).alias("e"))
    sides = [held.select("lang", "term", *(F.col(c).alias(f"{c}{i}") for c in ("block", "e"))) for i in (0, 1)]
    met = sides[0].join(sides[1], ["lang", "term"]).where("block0 <= block1")
    met = met.select("lang", "block0", "block1", *(F.col(f"e{i}.{c}").alias(f"{c}{i}") for i in (0, 1) for c in ("slot", "p", "base")))

    def sums(batch: pa.RecordBatch, same: bool) -> np.ndarray:
        flat = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("slot0", "p0", "base0", "slot1", "p1", "base1")}
        sizes = [np.array(pa.compute.list_value_length(batch.column(f"slot{i}"))).astype(np.int64) for i in (0, 1)]
        pairs = sizes[0] * sizes[1]
        row = np.repeat(np.arange(len(pairs)), pairs)
        within = np.arange(len(row)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        at = [(np.cumsum(sizes[0]) - sizes[0])[row] + within // sizes[1][row], (np.cumsum(sizes[1]) - sizes[1])[row] + within % sizes[1][row]]
        slot, p, base = ([flat[f"{c}{i}"][at[i]] for i in (0, 1)] for c in ("slot", "p", "base"))
        once = slot[0] < slot[1] if same else np.ones(len(row), bool)
        first_low = base[0] <= base[1]
        gain = np.minimum(p[0], p[1]) - np.minimum(np.where(first_low, p[0], p[1]), np.maximum(base[0], base[1]))
        # of 2^21 pairs at most, so the doubles are exact
        return np.bincount(slot[0][once].astype(np.int64) * BLOCK + slot[1][once], weights=gain[once].astype(np.float64), minlength=BLOCK * BLOCK).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, None

        def out() -> pa.RecordBatch:
            (lang, i, j), cells = current, np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array((i * BLOCK + cells // BLOCK).astype(np.int32)), pa.array((j * BLOCK + cells % BLOCK).astype(np.int32)), pa.array(2 * total[cells])], names=["lang", "one", "other", "nearer"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "block0", "block1")), strict=True))
            at = 0
            while at < len(keys):
                if keys[at] != current:
                    if current:
                        yield out()
                    current, total = keys[at], np.zeros(BLOCK * BLOCK, np.int64)
                end = at + 1
                while end < len(keys) and end < at + 32 and keys[end] == current:
                    end += 1
                total += sums(batch.slice(at, end - at), current[1] == current[2])
                at = end
        if current:
            yield out()

    return met.sortWithinPartitions("lang", "block0", "block1").mapInArrow(run, "lang string, one int, other int, nearer long")


def pair_distances(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: for each group, its distance from each other source of its language."""
    own = groups.select("lang", "source", "sid", "total", "base")
    shares = posts.join(own, ["lang", "source"]).select("lang", "term", "sid", "base", share(F.col("n"), F.col("total")).alias("p"))
    nearer = shared_terms(shares).groupBy("lang", "one", "other").agg(F.sum("nearer").alias("nearer"))
    value = (F.col("apart") - F.coalesce("nearer", F.lit(0))).alias("value")
    pairs = unshared(groups, shares).join(nearer, ["lang", "one", "other"], "left").select("lang", "one", "other", value)
    both = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("one").alias("sid"), F.col("other").alias("other")), F.struct(F.col("other").alias("sid"), F.col("one").alias("other")))).alias("s"))
    names = groups.select("lang", F.col("sid"), "source")
    named = both.select("lang", "value", "s.sid", "s.other").join(names, ["lang", "sid"])
    return named.join(names.select("lang", F.col("sid").alias("other"), F.col("source").alias("item")), ["lang", "other"]).select("lang", "source", "item", "value")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: parts ``pair`` (all other sources of the language) and ``term`` (``top`` words).

    Null text, lang and source count as ''. Repeated rows and null ids are documents of their own;
    ties rank by item. A language that keeps no word has pairs of value 0 and no terms; an empty
    table gives no rows. Other columns are ignored.
    """
    posts = postings(docs, min_docs)
    groups = staged(audit_groups(docs, posts), "groups")
    pairs = pair_distances(posts, groups).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(out).unionByName(telling_terms(posts, groups, top).withColumn("part", F.lit("term")).select(out))
