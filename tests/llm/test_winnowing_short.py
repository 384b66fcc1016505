"""Likeness by winnowing on short texts against the exact Jaccard of their grams."""

import random

import numpy as np
import pytest

from rhythmspan.llm import winnowing


def grams(text):
    k = winnowing.GRAM
    return {text[i : i + k] for i in range(max(1, len(text) - k + 1))}


@pytest.mark.parametrize(("low", "high", "error", "zeros"), [(20, 36, 0.2, 0.15), (37, 123, 0.1, 0.0), (124, 200, 0.06, 0.0)])
def test_near_edited_of_short_texts(low, high, error, zeros):
    rng = random.Random(low)
    got = []
    for _ in range(200):
        n = rng.randint(low, high)
        own, other = ("".join(rng.choice("abcdefghij  ") for _ in range(n)) for _ in range(2))
        edited = own[: n - n // 3] + other[: n // 3]
        both = len(grams(own) & grams(edited))
        got.append((winnowing.likeness(*(winnowing.winnow(t)[0] for t in (own, edited))), both / (len(grams(own) | grams(edited)))))
    near, exact = np.array(got).T
    assert (exact > 0).all()
    assert np.abs(near - exact).mean() <= error
    assert abs(near.mean() - exact.mean()) <= 0.05
    assert (near == 0).mean() <= zeros


def test_fingerprint_text():
    hashes = np.array([1, (1 << 40) - 1, 255], np.uint64)
    assert winnowing.fingerprint_text(hashes) == "0000000001 ffffffffff 00000000ff"
    assert winnowing.fingerprint_text(hashes[:0]) == ""
