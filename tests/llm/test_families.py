"""Families of texts that share a template but are less alike than what links: no link, and time in proportion."""

import random
import time

from rhythmspan.llm import similar


def family(spark, size, tail):
    """Texts of 220 common words and ``tail`` own ones each; with 34 own ones, Jaccard is 216 / 284 = 0.76."""
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    template = " ".join(word() for _ in range(220))
    rows = [(i, f"{template} {' '.join(word() for _ in range(tail))}", "en", "s", 0) for i in range(size)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def grouped(docs):
    began = time.perf_counter()
    found = {r.doc_id: r.component for r in similar.groups(docs).collect()}
    return found, time.perf_counter() - began


def test_a_family_below_the_threshold_is_not_compared_pair_by_pair(spark):
    grouped(family(spark, 50, 34))  # start the workers
    small, took = grouped(family(spark, 600, 34))
    large, longer = grouped(family(spark, 4800, 34))
    assert len(set(small.values())) == 600 and len(set(large.values())) == 4800
    assert longer < 10 * took


def test_a_family_above_the_threshold_is_one_group(spark):
    """With 26 own words, 216 of 268 shingles are common: 0.806."""
    found, _ = grouped(family(spark, 400, 26))
    assert len(set(found.values())) == 1
