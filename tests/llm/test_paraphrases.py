"""Decontamination against the longest common subsequence over all windows, of passages edited beyond any shared run."""

import numpy as np
import pytest

from rhythmspan.llm import decontamination as dec


def found_by_hand(item: list[str], text: list[str]) -> bool:
    if dec.common_subsequence(item, text) < dec.COMMON_WITH_ANSWER * len(item):
        return False  # no window has more than the whole text
    size, tail = dec.window_of(len(item)), item[-dec.ANSWER_WORDS :]
    for at in range(max(1, len(text) - size + 1)):
        region = text[at : at + size]
        share = dec.common_subsequence(item, region) / len(item)
        if share >= dec.COMMON or (share >= dec.COMMON_WITH_ANSWER and dec.common_subsequence(tail, region) / len(tail) >= dec.ANSWER):
            return True
    return False


def edited(item: list[str], rng: np.random.Generator) -> list[str]:
    """Every fourth or fifth word becomes another one, so that no run of five words is left."""
    out, at = list(item), int(rng.integers(1, 4))
    while at < len(out):
        out[at] = f"other{rng.integers(100_000)}"
        at += int(rng.integers(4, 6))
    return out


@pytest.mark.parametrize("blocks", [1, 3])
def test_recall_of_paraphrases(spark, blocks):
    rng = np.random.default_rng(29)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = (1.0 / np.arange(1, 3001)) / (1.0 / np.arange(1, 3001)).sum()
    say = lambda n: [str(w) for w in rng.choice(vocabulary, n, p=common)]
    items = [say(int(n)) for n in rng.integers(18, 60, 24)]
    texts = []
    for d in range(240):
        text = say(int(rng.integers(60, 400)))
        if d % 2:
            at = int(rng.integers(0, len(text)))
            text[at:at] = edited(items[d // 2 % len(items)], rng)
        texts.append(text)
    plain = lambda words: [w for i, w in enumerate(words) if not i or words[i - 1] != w]
    want = {(d, i) for d, text in enumerate(texts) for i, item in enumerate(items) if found_by_hand(plain(item), plain(text))}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dec.matches(docs, bench, items_in_block=-(-len(items) // blocks)).collect()}
    assert len(want) >= 60
    assert len(want & got) >= 0.9 * len(want)
    # what is found besides is in the reach of a window, half a window more to both sides
    assert len(got - want) <= 0.05 * len(want)
