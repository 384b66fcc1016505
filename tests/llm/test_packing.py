"""Packing: ids, cuts and slots against the vocabulary itself, the plan against best-fit decreasing piece by piece."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rhythmspan.llm import packing

PATHS = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
SCHEMA = "doc_id long, text string, length string, lot int, place long, rank int, piece string"


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATHS[0])


@pytest.fixture(scope="module")
def quick():
    return packing.encoder(*PATHS)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(st.characters(max_codepoint=0x24F)), st.text(st.sampled_from(" \t\n\r\x0b\x0c'sSdDlL.09aé\xa0\x85 ßǅ…€"))))
def test_ids_of_plain_texts_are_those_of_the_vocabulary(whole, quick, text):
    assert quick(text) == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|>b", "x" * 30_000, " " * 5_000, "\n" * 999, "日本語 テキスト", "𝔘𝔫𝔦 👩‍👩‍👧", "á"])
def test_ids_of_odd_texts(whole, quick, text):
    assert quick(text) == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size, want", [(1, [(0, 1)]), (10, [(0, 10)]), (11, [(0, 1), (1, 10)]), (20, [(0, 10), (10, 10)]), (25, [(0, 5), (5, 10), (15, 10)])])
def test_only_the_first_piece_is_short(size, want):
    assert packing.cut(size, 10) == want


def one_by_one(counts, capacity):
    """Free space left by best-fit decreasing, a piece at a time."""
    bins = []
    for length, n in sorted(counts.items(), reverse=True):
        for _ in range(n):
            fit = [b for b in range(len(bins)) if bins[b] >= length]
            if fit:
                bins[min(fit, key=lambda b: bins[b])] -= length
            else:
                bins.append(capacity - length)
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_is_best_fit_decreasing(counts):
    capacity, free, slots = 40, {}, {}
    for length, low, high, first, each, offset in packing.plan(counts.items(), capacity):
        for r in range(low, high):
            assert (length, r) not in slots
            at = slots[length, r] = (first + (r - low) // each, offset + (r - low) % each * length)
            free.setdefault(at[0], []).append((at[1], length))
    assert len(slots) == sum(counts.values())
    for held in free.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *(n for _, n in held)])[:-1].tolist()
    assert sorted(capacity - sum(n for _, n in held) for held in free.values()) == one_by_one(counts, capacity)


def test_plan_stays_small_whatever_the_counts():
    rng = random.Random(4)
    counts = {n: rng.randrange(1, 10**9) for n in range(1, 2049)}
    assert len(packing.plan(counts.items())) <= 3 * 2048 * 11


@pytest.mark.parametrize("capacity", [2048, 16])
def test_documents_are_packed(spark, whole, capacity):
    rng = random.Random(8)
    texts = [None, "", "", "one two", "one two", "x" * 9000, *(" ".join(rng.choice(["alpha", "beta", "über", "Ω"]) for _ in range(rng.randint(1, 900))) for _ in range(60))]
    rows = [(None if i == 3 else i // 2 if i < 6 else i, t, "x", 1, 2, 3, "y") for i, t in enumerate(texts)]
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(5), *PATHS, capacity=capacity, keep_ids=True)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    have = got.collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc_id, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids), capacity))]
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in have), key=key) == sorted(want, key=key)
    held = {}
    for r in have:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist() and sum(n for _, n in places) <= capacity
    counts = {}
    for r in have:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert len(held) == len(one_by_one(counts, capacity))
    filled = {r.sequence_id: r for r in packing.sequences(got).collect()}
    for r in have:
        assert filled[r.sequence_id].ids[r.offset : r.offset + r.length] == r.ids


def test_nothing_to_pack(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), *PATHS).collect() == []
