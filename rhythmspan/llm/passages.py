"""Which texts hold a passage of many words that another text holds too.

The unit is the word, so this tells what a length in bytes does not: a passage of fifty short
words is shorter than 400 bytes. As with byte strings, every run of ``words`` words holds an anchor
(the rightmost minimum among the hashes of its shorter runs), and equal runs hold equal anchors:

1. a context is a stretch of neighbouring runs with one anchor. A context of two texts is shared.
2. Anchors with several different contexts (edges of passages, edits): their runs are counted
   one by one. Of each context one text stands for all, and no key's rows meet in a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, rolling_hash, scratch, staged, window_runs
from ._words import BASE, Words

WORDS, GRAM = 50, 25


def _contexts(hashes: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, context hash, first run, last run) of one text with at least ``words`` words."""
    from xxhash import xxh3_64_intdigest

    h = rolling_hash(hashes, gram)
    at, first, last = window_runs(h, words - gram + 1)
    context = [xxh3_64_intdigest(hashes[a : b + words].tobytes(), p - a) for p, a, b in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)]
    return h[at].view(np.int64), np.array(context, np.uint64).view(np.int64), first, last


def _texts(cols: dict[str, list], words: int):
    """(text hash, word hashes) of the texts that have enough words."""
    split = Words(cols["text"], plain=False)
    ends = np.cumsum(split.counts)
    for i in np.flatnonzero(split.counts >= words).tolist():
        yield i, split.hashes[ends[i] - split.counts[i] : ends[i]]


def shared_passages(keyed: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """``x`` of every text (``x``: its hash, ``text``) with a run of ``words`` words that another text, or a copy of it, holds too.

    Words are as written, apart by blanks; runs don't cross texts. A run that only its own text
    repeats does not count. Null texts, and texts with fewer words, are never among them. An empty
    table gives an empty one.
    """
    keyed = keyed.select("x", "text")

    def anchors():
        done: set[int] = set()

        def work(cols):
            out: list[tuple] = []
            for i, hashes in _texts(cols, words):
                x = cols["x"][i]
                again = x in done  # a second row of the same text in this task
                done.add(x)
                h, c, _, _ = _contexts(hashes, words, gram)
                # a context is told by both hashes together
                first = np.unique(h.view(np.uint64) * np.uint64(BASE) + c.view(np.uint64), return_index=True)[1][: 1 if again else None]
                out.append((h[first], c[first], np.full(len(first), x), np.full(len(first), again)))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
            return dict(zip(("h", "c", "x", "again"), cols, strict=True))

        return work

    def runs():
        def work(cols):
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for i, hashes in _texts(cols, words):
                h, c, first, last = _contexts(hashes, words, gram)
                asked = {(w["h"], w["c"]) for w in cols["wanted"][i]}
                whole = rolling_hash(hashes, words)
                for a, b in {(a, b) for k, q, a, b in zip(h.tolist(), c.tolist(), first.tolist(), last.tolist(), strict=True) if (k, q) in asked}:
                    out.append((whole[a : b + 1].view(np.int64), np.full(b + 1 - a, cols["x"][i])))
            w, x = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
            return {"w": w, "x": x}

        return work

    with scratch(keyed.sparkSession) as put:
        with scratch(keyed.sparkSession) as briefly:
            rows = briefly(map_rows(keyed, anchors, "h long, c long, x long, again boolean"), "word-anchors")
            # a copy of a text shows as `again` if both are of one task, else as two rows of a context
            contexts = rows.groupBy("h", "c").agg(F.min("x").alias("x"), F.max("x").alias("other"), F.bool_or("again").alias("again"), F.count(F.lit(1)).alias("n"))
            contexts = put(contexts, "word-contexts")
            alike = rows.join(contexts.where("x <> other or again or n > 1").select("h", "c"), ["h", "c"], "left_semi").select("x").distinct()
            alike = put(alike, "alike")
        several = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h")
        mixed = contexts.join(several, "h", "left_semi").select("h", "c", "x").join(alike.withColumn("found", F.lit(True)), "x", "left")
        # an anchor matters only while a text of it is undecided
        undecided = mixed.where("found is null").select("h").distinct()
        wanted = mixed.join(undecided, "h", "left_semi").groupBy("x").agg(F.collect_list(F.struct("h", "c")).alias("wanted"))
        # written before it meets the texts, so that its shuffles are gone when those are dealt
        asked = keyed.join(put(wanted, "word-wanted"), "x").select("x", "text", "wanted")
        singles = put(map_rows(asked, runs, "w long, x long", rows=64), "word-runs")
        many = singles.groupBy("w").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a <> b").select("w")
        return staged(alike.unionByName(singles.join(many, "w", "left_semi").select("x")).distinct(), "shared", tidy=True)
