"""Distances of sources and telling words against a plain count; nulls, ties, empty groups, blocks and bounds."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rhythmspan.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, value int, rank int"


def brute(rows, min_docs, top):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, docs, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups.add((lang or "", source or ""))
        docs.update((lang or "", w) for w in set(words))
        counts.update((lang or "", source or "", w) for w in words)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for (k, w), n in docs.items() if k == lang and n >= min_docs]
        sources = [s for k, s in groups if k == lang]
        share = lambda of: {w: 1 + 10**9 * (of[w] + 5) // (sum(of[x] for x in kept) + 5 * len(kept)) for w in kept}
        p = {s: share({w: counts[lang, s, w] for w in kept}) for s in sources}
        q = share({w: sum(counts[lang, s, w] for s in sources) for w in kept})
        for s in sources:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[w] - p[s][w], w.encode(), w) for w in kept if counts[lang, s, w] and p[s][w] > q[w]]
            out |= {(lang, s, "pair", item, -v, i) for i, (v, _, item) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", item, -v, i) for i, (v, _, item) in enumerate(sorted(terms)[:top], 1)}
    return out


def corpus(seed, docs=160, sources=7):
    rng = random.Random(seed)
    words = ["Über", "naïve", "x", "日本", "été", *("".join(rng.choice("abcDE") for _ in range(rng.randint(1, 4))) for _ in range(60))]
    rows = []
    for _ in range(docs):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice([None, "", "é", "Z", *(f"s{i}" for i in range(sources))])
        bias = hash_free(source or "") % 20
        rows.append((rng.choice("\t ;9").join(rng.choice(words[bias : bias + 30]) for _ in range(rng.choice([0, 3, 40]))), lang, source))
    return [*rows, (None, "en", "s0"), ("", "fr", "only"), ("rare", "xx", "a"), (None, "xx", "b"), ("\x00\x7f-7", "xx", "c"), rows[0], rows[0], ("LONG " * 5000, "en", "s1")]


def hash_free(text):
    return sum(map(ord, text))


@pytest.mark.parametrize("block, held, min_docs, top", [(256, 300_000, 3, 50), (3, 5, 1, 4), (2, 40, 6, 1)])
def test_against_a_plain_count(spark, monkeypatch, block, held, min_docs, top):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", held)
    rows = corpus(block)
    docs = spark.createDataFrame([(None if i % 9 else i, t, lang, source, 1, "t", 2, 3) for i, (t, lang, source) in enumerate(rows)], SCHEMA).repartition(6)
    got = divergence.source_divergence(docs, min_docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    have = [tuple(r) for r in got.collect()]
    assert len(have) == len(set(have)) and set(have) == brute(rows, min_docs, top)


def test_nothing_to_audit(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 0), (0, 7), (3, 8), (123_456_789_012_345, 8_999_999_999_999_999), (10**15, 10**15 + 5), (1, 3), (899, 904)]
    got = spark.createDataFrame(cases, "n long, total long").select("n", "total", divergence.share(F.col("n"), F.col("total")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 5) // t if t else 0 for n, t in cases]


def test_the_largest_leads_among_many_small_counts(spark):
    """Most words are in buckets whose bound is below the third value; those are the same for both sources."""
    counts = [5000, 4000, 3000, *[2] * 400, *[900] * 20]
    rows = [("en", f"w{i:04d}", source, n if source == "a" else 2, n + 2, source == "a") for i, n in enumerate(counts) for source in "ab"]
    posts = spark.createDataFrame(rows, "lang string, term string, source string, n long, lang_n long, first boolean")
    groups = divergence.audit_groups(spark.createDataFrame([("en", "a"), ("en", "b")], "lang string, source string"), posts)
    got = divergence.telling_terms(posts, groups, 3).where("source = 'a'").orderBy("rank").collect()
    assert [r.item for r in got] == ["w0000", "w0001", "w0002"]
