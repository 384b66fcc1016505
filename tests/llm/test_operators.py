"""The training-data operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import time
import uuid
import zlib
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from rhythmspan.llm import decontamination, language, mixing, quality, rollup, sharding, simhash, suffix_dedup, toxicity, winnowing
from rhythmspan.llm._bwt import repeated_starts
from rhythmspan.llm._common import scratch, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def table(spark, texts, ids=None, langs=None, sources=None):
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t or ""), -1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, n) for n in (5, 60, 150, 300, 300, 2000)]
    passage = prose(rng, 90)
    near = base[3].split()
    near[140] = "CHANGED"
    return [*base, base[2], base[0], " ".join(near), f"{prose(rng, 40)} {passage} {prose(rng, 30)}", f"{passage} {prose(rng, 50)}", f"{prose(rng, 9)} {passage}", None, "", "  \n", "shti " * 400, "é" * 500 + prose(rng, 30)]


def repeats(raws, length):
    seen = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("hot", [400, 1])
def test_suffix_dedup(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = {r.doc_id: r for r in suffix_dedup.removal_digest(suffix_dedup.remove_repeats(table(spark, texts))).collect()}
    raws = [(t or "").encode() for t in texts]
    assert len(got) == len(texts)
    for i, (raw, gone) in enumerate(zip(raws, repeats(raws, 400), strict=True)):
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(raw), gone.sum(), spans)
        assert got[i].kept_sha256 == hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("hot", [400, 1])
def test_suffix_dedup_leaves_little_on_disk(spark, texts, monkeypatch, hot):
    """Before the result is asked for, only what it reads is left: no shuffles, no tables of steps that are done."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = files.getAllFiles()
        return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_") and name.endswith(".data")}

    old, tables = shuffles(), {f.name for f in Path(urlparse(shared_dir(spark)).path).iterdir()}
    kept = suffix_dedup.remove_repeats(table(spark, texts))
    until = time.time() + 20  # Spark removes them in the background
    while shuffles() - old and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - old
    left = sorted(f.name.rsplit("-", 1)[0] for f in Path(urlparse(shared_dir(spark)).path).iterdir() if f.name not in tables)
    assert left == ["shared", "spans", "spans", "spans"]
    assert kept.count() == len(texts)


def test_scratch(spark):
    """Tables of a block go with it, also if it fails; the session's settings are as before."""
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for before in (None, "false", "true"):
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
        with pytest.raises(ZeroDivisionError), scratch(spark) as put:
            got = put(spark.range(10).withColumn("half", F.floor(F.col("id") / 2)).groupBy("half").count(), "halves")
            (name,) = {f.rsplit("/", 1)[0] for f in got.inputFiles()}
            assert got.agg(F.sum("count")).first()[0] == 10 and Path(urlparse(name).path).is_dir()
            1 / 0
        assert not Path(urlparse(name).path).parent.exists() and spark.conf.get(cleanup, None) == before
    spark.conf.unset(cleanup)


def test_shared_passages(spark):
    """Passages of 40 to 60 short words at any place, edges, copies, and repeats within one text, against all runs of 50 words."""
    rng = random.Random(21)
    short = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(n))
    texts = [None, "", short(49), short(80), f"{(own := short(70))} {own}"]
    for n in (40, 48, 49, 50, 51, 60, 120):
        passage = short(n)
        texts += [f"{short(rng.randint(0, 90))} {passage}\n{short(rng.randint(0, 90))}" for _ in range(3)]
        texts += [f"{short(30)} {passage.rsplit(' ', n // 8)[0]} {short(40)}"]
    texts += [texts[3], short(20), short(49)]
    texts += [texts[-2], texts[-1]]
    runs = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        for at in range(len(w) - 49):
            runs.setdefault(tuple(w[at : at + 50]), set()).add(i)
    want = {i for own in runs.values() if len(own) > 1 for i in own}
    got = suffix_dedup.removal_digest(suffix_dedup.remove_repeats(table(spark, texts).repartition(4))).collect()
    assert len(got) == len(texts) and {r.doc_id for r in got if r.shared_passage} == want and 10 < len(want) < 25


def test_interval_expansion():
    rng = random.Random(1)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(30)]
    joined = np.arange(sum(map(len, parts)))
    flags, at = repeated_starts(parts, joined, 9), 0
    whole = [p[i : i + 9] for p in parts for i in range(len(p) - 8)]
    for p in parts:
        for i in range(len(p)):
            assert flags[at + i] == (i + 9 <= len(p) and whole.count(p[i : i + 9]) > 1)
        at += len(p)


def test_simhash_components(spark, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(table(spark, texts)).collect()}
    prints = [simhash.fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    assert [got[i].component_id for i in range(len(texts))] == root
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]


def test_bk_tree_links_all():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 90, dtype=np.uint64)) for c in centres] + [rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    root = np.arange(len(values))
    for i, j in simhash.shard_links(values, 4):
        assert np.bitwise_count(values[i] ^ values[j]) <= 4
        root[root == root[j]] = root[i]
    close = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    for i, j in zip(*np.nonzero(close), strict=True):
        assert root[i] == root[j]


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_sharding(spark, texts):
    ids = [None, 0, -5, 2**62, 7, 7, *range(100, 100 + len(texts) - 6)]
    rows = sharding.assign_shards(sharding.with_size(table(spark, texts, ids)), 7).collect()
    assert len(rows) == len(texts)
    for r in rows:
        key = (r.doc_id or 0) % 2**64
        assert (r.shard, r.grown_shard) == (jump(key, 7), jump(key, 8))
        assert (r.size, r.text_crc32) == (len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_winnowing(spark, texts):
    ids = [i * 3 for i in range(len(texts))]
    rows = {r.doc_id: r for r in winnowing.edited_likeness(table(spark, texts, ids)).collect()}
    order = sorted(ids, reverse=True)
    for i, d in enumerate(order):
        own, other = texts[d // 3] or "", texts[order[(i + 1) % len(order)] // 3] or ""
        cut = len(own) // 3
        edited = own[: len(own) - cut] + other[:cut]
        assert rows[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[d].near_next <= 1
    assert rows[6].fingerprint == rows[18].fingerprint
    assert rows[36].fingerprint == "" and rows[36].n_chars == 0
    shared = prose(random.Random(9), 40)
    a, b = (winnowing.winnow(f"{x * 77} {shared} {x}")[0] for x in "pq")
    assert np.intersect1d(a, b).size  # a shared run of gram + window - 1 is always caught


def test_decontamination(spark):
    rng = random.Random(4)
    items = [prose(rng, n) for n in (14, 30, 45, 60)]
    edited = items[2].split()
    edited[5] = edited[20] = "other"
    docs = [f"{prose(rng, 100)} {items[0]} {prose(rng, 50)}", items[1].upper(), f"{prose(rng, 33)} {' '.join(edited)}", *[prose(rng, 120) for _ in range(30)], None, "", "--- ***"]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, ""), (1, items[1])], "item_id long, text string")
    got = decontamination.matches(table(spark, docs), bench, items_in_block=2).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 0), (1, 1), (2, 2)}
    none = decontamination.matches(table(spark, docs).limit(0), bench.limit(0))
    assert none.count() == 0


def test_a_commit_that_dies_leaves_the_totals(spark):
    """Before any commit, after a batch of no rows, after deltas that were written and never named, and after a replay."""
    row = lambda docs, tokens: spark.createDataFrame([("a", None, "t", docs, tokens, "x"), (None, "en", "t", 0, 0, "y"), ("a", None, "t", docs, tokens, "x")], "source string, lang string, tokenizer string, docs long, tokens long, commit string")
    totals = rollup.TokenRollup(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    assert totals.totals().collect() == []
    totals.commit("none", row(1, 1).limit(0))
    assert totals.totals().collect() == []
    totals.commit("1", row(1, 10))
    totals.write("1", row(9, 90))  # and dies here
    assert [tuple(r) for r in totals.totals().collect()] == [("a", None, "t", 2, 20)]
    totals.commit("1", row(3, 30))
    totals.commit("2", row(-1, -5))
    totals.commit("2", row(-1, -5))
    assert [tuple(r) for r in totals.totals().collect()] == [("a", None, "t", 4, 50)]


def test_rollup(spark, texts):
    docs = table(spark, texts, sources=[None if i % 4 == 0 else f"s{i % 3}" for i in range(len(texts))])
    counts = rollup.count_tokens(docs)
    totals = rollup.TokenRollup(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    totals.commit("1", rollup.inserts(counts))
    want = {tuple(r) for r in counts.groupBy(*rollup.KEYS).agg(F.count("*"), F.sum("tokens")).collect()}
    assert {tuple(r) for r in totals.totals().collect()} == want
    totals.commit("2", rollup.revisions(counts, counts.withColumn("tokens", F.col("tokens") * 2)))
    totals.commit("2", rollup.revisions(counts, counts.withColumn("tokens", F.col("tokens") * 2)))
    assert {tuple(r) for r in totals.totals().collect()} == {(*k[:4], k[4] * 2) for k in want}
    totals.commit("3", rollup.deletes(counts.withColumn("tokens", F.col("tokens") * 2)))
    assert totals.totals().count() == 0


def test_mixing(spark, texts):
    docs = table(spark, texts, sources=[None if i % 4 == 0 else f"s{i % 3}" for i in range(len(texts))])
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert own[0].source_size == sum(r.size for r in own)
        assert sum(r.taken for r in own) == int(own[0].target)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert mixing.mix(docs.limit(0)).count() == 0


def labelled(spark, rng, n=240):
    texts, good, toxic = [], [], []
    for i in range(n):
        t = prose(rng, 60)
        toxic.append(int(i % 3 == 0))
        good.append(int(i % 4 != 0))
        if toxic[-1]:
            t += " you idiot"
        if not good[-1]:
            t = " | ".join(t.split())
        texts.append(t)
    labels = spark.createDataFrame([(i, good[i], toxic[i]) for i in range(n)], "doc_id long, quality int, toxic int")
    return table(spark, [*texts, None, ""]), labels, good, toxic


def test_classifiers(spark):
    docs, labels, good, toxic = labelled(spark, random.Random(8))
    for rows, truth in ((quality.quality_scores(docs, labels).collect(), good), (toxicity.toxicity_scores(docs, labels).collect(), toxic)):
        assert len(rows) == len(truth) + 2
        held = [r for r in rows if r.held_out and r.doc_id < len(truth)]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
        assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
        assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0.5 for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect())


def test_counterfactual_penalty_evens_identity_terms():
    texts = [f"w{i % 7} women" if i % 2 else f"w{i % 7} men" for i in range(400)]
    y = np.array([float(i % 2) for i in range(400)])
    data = toxicity.with_twin()(texts)
    gaps = [abs(float(np.ptp([w[i] for i in toxicity.Words(["women", "men"], plain=True).ids(toxicity.WIDTH)]))) for w in (toxicity.fit(y, *data, evenness=e)[1] for e in (0.0, 50.0))]
    assert gaps[1] < 0.2 * gaps[0]


def test_language(spark):
    rng = random.Random(2)
    abc = {"aa": "abcdefgh", "bb": "mnopqrst"}
    langs = [rng.choice(list(abc)) for _ in range(120)]
    texts = [" ".join("".join(rng.choice(abc[lang]) for _ in range(5)) for _ in range(20)) for lang in langs]
    rows = language.predict_languages(table(spark, [*texts, None, "12 34 !"], langs=[*langs, None, "aa"])).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == [*langs, "und", "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_empty_tables(spark):
    none = table(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for got in (suffix_dedup.remove_repeats(none), simhash.near_duplicates(none), sharding.assign_shards(none), winnowing.edited_likeness(none), quality.quality_scores(none, labels), toxicity.toxicity_scores(none, labels), language.predict_languages(none)):
        assert got.count() == 0
