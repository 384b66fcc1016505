"""The stages of the corpus pipeline against brute force, on small tables with nulls, repeated ids and near copies."""

import random

import pytest

import corpus_pipeline
from rhythmspan.llm import decontamination, similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or ""), 5) for k, (i, t) in enumerate(rows)], SCHEMA)


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(texts):
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def near_copies():
    rng = random.Random(6)
    texts = [None, "", "  \n", "one two", "ONE two", "one two three"]
    for n in (30, 120, 300):
        base = prose(rng, n).split()
        for changed in range(8):
            for _ in range(2):
                words = list(base)
                for at in rng.sample(range(n), changed * n // 120):
                    words[at] = "changed"
                texts.append(" ".join(words))
    return texts


def test_near_dedup_links_from_jaccard_of_four_fifths(spark):
    texts = near_copies()
    want = components(texts)
    got = {r.doc_id: r.component for r in similar.groups(table(spark, enumerate(texts))).collect()}
    assert len(got) == len(texts)
    firsts = {}
    for i in range(len(texts)):
        firsts.setdefault(got[i], i)
    assert [firsts[got[i]] for i in range(len(texts))] == want
    kept = corpus_pipeline.one_of_each_group(spark, table(spark, enumerate(texts)), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


@pytest.mark.parametrize("n", [20, 100, 300])
def test_radius_reaches_pairs_of_four_fifths(n):
    """Of pairs of Jaccard 0.8 to 0.9 with n shingles nearly all are within the radius."""
    import numpy as np

    rng = np.random.default_rng(n)
    near = 0
    for _ in range(300):
        changed = max(1, int(n * 0.1))
        both, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, k, dtype=np.uint64) for k in (n - changed, changed, changed))
        near += (similar.fingerprint(np.r_[both, a]) ^ similar.fingerprint(np.r_[both, b])).bit_count() <= similar.RADIUS
    assert near >= 299


def save(spark, folder, docs, items=(), labels=()):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_dedup_keeps_null_and_repeated_ids(spark):
    rng = random.Random(9)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    docs = table(spark, [(None, a), (None, b), (7, c), (7, d), (7, d), (3, d.upper()), (None, c), (None, None)])
    assert pairs(corpus_pipeline.one_of_each_group(spark, docs, "")) == sorted([(None, a), (None, b), (7, c), (3, d.upper()), (None, None)], key=str)


def test_quality_judges_rows(spark, tmp_path):
    rng = random.Random(2)
    good, bad = ([prose(rng, 60) for _ in range(120)] for _ in range(2))
    bad = [" | ".join(t.split()) for t in bad]
    labels = [(i, int(i < 120), 0) for i in range(240)]
    extra = [(None, prose(rng, 60)), (None, " | ".join(prose(rng, 60).split())), (900, prose(rng, 60)), (900, " | ".join(prose(rng, 60).split()))]
    docs = table(spark, [*enumerate(good + bad), *extra])
    got = pairs(corpus_pipeline.keep_quality(spark, docs, save(spark, tmp_path, docs, labels=labels)))
    assert [p for p in got if p[0] is None or p[0] == 900] == sorted([extra[0], extra[2]], key=str)


def test_decontamination_judges_rows(spark, tmp_path):
    rng = random.Random(4)
    item, clean = prose(rng, 40), [prose(rng, 120) for _ in range(30)]
    dirty = [f"{prose(rng, 30)} {item} {prose(rng, 20)}" for _ in range(2)]
    docs = table(spark, [*enumerate(clean[2:]), (None, clean[0]), (None, dirty[0]), (500, clean[1]), (500, dirty[1])])
    got = pairs(corpus_pipeline.without_benchmark(spark, docs, save(spark, tmp_path, docs, [(1, item)])))
    assert got == sorted([*enumerate(clean[2:]), (None, clean[0]), (500, clean[1])], key=str)


def test_decontamination_finds_what_a_third_of_documents_quote(spark):
    """Every third document holds the item (verbatim or with every ninth word replaced), amid words of its own."""
    rng = random.Random(12)
    item, other = prose(rng, 40), prose(rng, 25)
    edited = " ".join("other" if k % 9 == 8 else w for k, w in enumerate(item.split()))
    texts = [f"{prose(rng, 60 + i % 23)} {(item, edited)[i % 2]} {prose(rng, 70)}" if i % 3 == 0 else prose(rng, 150) for i in range(120)]
    bench = spark.createDataFrame([(1, item), (2, other), (3, "single")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(table(spark, enumerate(texts)), bench).collect()}
    want = {(i, 1) for i, t in enumerate(texts) if decontamination.common_subsequence(item.split(), t.split()) >= 0.8 * 40}
    assert len(want) == 40 and got == want


def test_near_dedup_of_an_empty_table(spark):
    none = table(spark, [(1, "x")]).limit(0)
    assert similar.groups(none).count() == 0
    assert corpus_pipeline.one_of_each_group(spark, none, "").count() == 0


def test_near_dedup_with_small_trees(spark, monkeypatch):
    """Shards cut into many trees, and pairs of components tested a few at a time, give the same groups."""
    monkeypatch.setattr(similar, "TREE", 3)
    monkeypatch.setattr(similar, "NEAREST", 1)
    texts = near_copies()
    got = {r.doc_id: r.component for r in similar.groups(table(spark, enumerate(texts))).collect()}
    firsts = {}
    for i in range(len(texts)):
        firsts.setdefault(got[i], i)
    assert [firsts[got[i]] for i in range(len(texts))] == components(texts)


def test_sketches_differ_in_no_more_bits_than_sets():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 9, 63, 65, 500):
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for extra in (0, 1, n // 8):
            a, b = similar.sketch(both), similar.sketch(np.r_[both, rng.integers(0, 1 << 63, extra, dtype=np.uint64)])
            if len(b) > len(a):
                b = b[: len(a)] ^ b[len(a) :]
            assert np.bitwise_count(a ^ b).sum() <= extra


def test_mixing_and_shards_keep_order_and_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 40))) for i in range(90)] + [(None, prose(rng, 9)), (5, prose(rng, 9)), (7, None)]
    docs = table(spark, rows).selectExpr("*", "1 as size", "2 as position")  # columns that clash with those of the stages
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == list(corpus_pipeline.DOCUMENTS)
    plan = corpus_pipeline.mixing.mix(docs.select(*corpus_pipeline.DOCUMENTS)).collect()
    want = sorted((p, -1 if r.doc_id is None else r.doc_id, r.text) for r in plan if r["size"] for p in r.positions[: int(r.taken / r["size"] + 0.5)])
    got = [(-1 if r.doc_id is None else r.doc_id, r.text) for r in mixed.collect()]
    assert sorted(got) == sorted(w[1:] for w in want) and len(set(got)) < len(got)
    mixed.write.parquet(f"{tmp_path}/mixed")
    sharded = corpus_pipeline.shard(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    assert len(sharded) == len(got)
    place = {}
    for at, w in enumerate(want):
        place.setdefault(w[1:], []).append(at)
    for k in {r.shard for r in sharded}:
        own = sorted((r for r in sharded if r.shard == k), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        at = [place[(-1 if r.doc_id is None else r.doc_id, r.text)].pop(0) for r in own]
        assert at == sorted(at)


def test_run_from_documents_to_shards(spark, tmp_path):
    rng = random.Random(3)
    good, bad = [prose(rng, 80) for _ in range(60)], [" | ".join(prose(rng, 80).split()) for _ in range(60)]
    item = prose(rng, 40)
    texts = good + bad + good[:5] + [f"{prose(rng, 30)} {item} {prose(rng, 30)}" for _ in range(4)] + [None]
    docs = table(spark, enumerate(texts))
    folder = save(spark, tmp_path, docs, [(1, item)], [(i, int(i < 60), 0) for i in range(120)])
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} <= set(range(60)) and len({r.doc_id for r in got}) > 40
    assert all(r.text == texts[r.doc_id] for r in got)
    none = tmp_path / "none"
    empty = save(spark, none, docs.limit(0), [(1, item)])
    assert corpus_pipeline.run(spark, empty).count() == 0
