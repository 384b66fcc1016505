"""The models and fingerprints against plain versions written out by hand, and every operator on awkward rows."""

import math
import random
import zlib

import numpy as np
import pytest

from rhythmspan.llm import decontamination, language, mixing, quality, rollup, sharding, simhash, suffix_dedup, toxicity, winnowing
from rhythmspan.llm._common import rolling_hash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, score double, hashes string, component string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, None if k % 3 == 0 else "s", len(t or "") if k % 4 else None, -1, "x", -1.0, "h", "c") for k, (i, t) in enumerate(rows)], SCHEMA)


def test_winnowing_by_hand():
    """Every window of ten 8-grams keeps its least hash, of ties the rightmost."""
    rng = random.Random(1)
    for text in [prose(rng, n) for n in (0, 1, 2, 5, 40, 300)] + ["a" * 500, "ab" * 200, "é漢字" * 40, "x", "abcdefg", "abcdefgh"]:
        codes = np.array([ord(c) for c in text], np.uint32)
        h = (rolling_hash(codes, min(8, len(codes))) >> np.uint64(24)).tolist() if text else []
        want = set()
        for a in range(max(1, len(h) - 9) if h else 0):
            window = h[a : a + 10]
            want.add(a + max(i for i, v in enumerate(window) if v == min(window)))
        hashes, at = winnowing.winnow(text)
        assert at.tolist() == sorted(want) and hashes.tolist() == [h[i] for i in sorted(want)]


def test_edited_texts_by_hand(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 30))) for i in range(25)] + [(None, None), (40, "")]
    order = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -(1 << 62)))
    got = {r.doc_id: r for r in winnowing.edited_likeness(table(spark, rows)).collect()}
    for (i, text), (_, other) in zip(order, order[1:] + order[:1], strict=True):
        text, other = text or "", other or ""
        cut = len(text) // 3
        own, edited, near = (set(winnowing.winnow(t)[0].tolist()) for t in (text, text[: len(text) - cut] + other[:cut], other))
        share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert (got[i].near_edited, got[i].near_next) == (pytest.approx(share(own, edited)), pytest.approx(share(own, near)))
        assert [int(p) for p in got[i].positions.split()] == winnowing.winnow(text)[1].tolist()


def test_factorisation_machine_sums_all_pairs():
    rng = np.random.default_rng(4)
    w0, w, v = 0.3, rng.normal(size=30), rng.normal(size=(30, 5))
    starts, ids, xs = np.array([0, 4, 4, 9]), rng.integers(0, 30, 9), rng.normal(size=9)
    got = quality.machine(w0, w, v, starts, ids, xs)[0]
    for r, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        pairs = sum(v[ids[i]] @ v[ids[j]] * xs[i] * xs[j] for i in range(a, b) for j in range(a, i))
        assert got[r] == pytest.approx(w0 + sum(w[ids[i]] * xs[i] for i in range(a, b)) + pairs)


def grams(text):
    codes = [ord(c) for c in f" {text.lower()} "]
    for n in (1, 2, 3):
        for at in range(len(codes) - n + 1):
            run = 0
            for k in range(n):
                run = (run * 0x01000193 + codes[at + k] + k + 1) % 2**32
            yield (run * 0x9E3779B1 % 2**32 >> 8) % language.BUCKETS


def test_naive_bayes_by_hand(spark, monkeypatch):
    """Counts, smoothing and posterior, with blocks so short that n-grams cross their ends."""
    monkeypatch.setattr(language, "BLOCK", 7)
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 6)).replace("a", "xy"[i % 2]), ("aa", "bb")[i % 2]) for i in range(30)]
    docs = spark.createDataFrame([*rows, (50, "héé x", None), (51, None, "aa")], "doc_id long, text string, lang string")
    counts = {lang: {} for lang in ("aa", "bb")}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            for g in grams(text):
                counts[lang][g] = counts[lang].get(g, 0) + 1
    total = {k: sum(c.values()) + language.BUCKETS for k, c in counts.items()}
    for r in language.predict_languages(docs).where("lang_pred <> 'und'").collect():
        text = "héé x" if r.doc_id == 50 else rows[r.doc_id][1]
        logs = {k: sum(math.log((c.get(g, 0) + 1) / total[k]) for g in grams(text)) for k, c in counts.items()}
        best = max(logs, key=logs.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()), abs=1e-4)


def test_a_long_text_has_the_same_ngrams_in_blocks(monkeypatch):
    text = prose(random.Random(3), 400)
    whole = np.sort(np.concatenate(list(language.ngram_ids(text))))
    for block in (1, 2, 3, 100, len(text), len(text) + 1, len(text) + 2):
        monkeypatch.setattr(language, "BLOCK", block)
        assert np.array_equal(np.sort(np.concatenate(list(language.ngram_ids(text)))), whole)


def test_neutral_mentions_of_a_group_are_not_toxic(spark):
    """One group is named in most toxic texts. Without the penalty its name alone is held against neutral texts; with it, not."""
    rng = random.Random(6)
    rows, labels, neutral = [], [], []
    for i in range(900):
        text, toxic = prose(rng, 12), i % 3 == 0
        if toxic:
            text += " awful" if i % 2 else ""
            text += " the zorgs" if i % 5 else " the melks"
        else:
            text += " the zorgs" if i % 40 == 4 else " the melks"
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    for i in range(900, 1000):
        rows.append((i, prose(rng, 12) + " the zorgs"))
        neutral.append(i)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    wrong = {}
    for evenness in (0.0, 200.0):
        got = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(table(spark, rows), labels, identities=(("zorgs", "melks"),), evenness=evenness).collect()}
        wrong[evenness] = sum(got[i] for i in neutral) / len(neutral)
    assert wrong[0.0] > 0.9 and wrong[200.0] < 0.1


def test_awkward_rows_go_through_every_operator(spark, tmp_path):
    """Null ids and columns, repeated rows, ties, a very long text, blank texts, and columns named as those that operators make."""
    rng = random.Random(7)
    long, same = prose(rng, 60_000), prose(rng, 80)
    rows = [(None, None), (None, same), (None, same), (3, same), (3, same), (3, "other words"), (4, ""), (5, " \n\t"), (6, long), (7, long[: len(long) // 2]), (8, "\U0001f600" * 300)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(3, 1, 0), (3, None, 1), (None, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, same), (1, same), (None, "a b"), (2, None), (3, "")], "item_id long, text string")
    for got in (suffix_dedup.removal_digest(suffix_dedup.remove_repeats(docs)), simhash.near_duplicates(docs), sharding.assign_shards(sharding.with_size(docs)), winnowing.edited_likeness(docs), mixing.mix(docs), toxicity.toxicity_scores(docs, labels), quality.quality_scores(docs, labels), language.predict_languages(docs)):
        assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(i) for i, _ in rows)
    found = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, bench).collect()}
    assert {(None, 1), (3, 1)} <= found and not {d for d, _ in found} & {4, 5, 8}
    totals = rollup.TokenRollup(spark, f"{tmp_path}/rollup")
    totals.commit("all", rollup.inserts(rollup.count_tokens(docs)))
    assert totals.totals().where("tokenizer = 'words-1'").groupBy().sum("docs", "tokens").first() == (len(rows), sum(len((t or "").split()) for _, t in rows))
