"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts come from a bounded sample of documents; the matrix of log probabilities
(buckets x languages) is broadcast, and each text is scored by gathering the rows of its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc32_of_id, map_rows

#: Buckets of the n-gram hash, lengths, documents to learn from at most for each language.
BUCKETS, LENGTHS, BOUND = 1 << 15, (1, 2, 3), 3000
FOLD, HELD_OUT = 4, 2
UNKNOWN = "und"
BLOCK = 1 << 18


def ngram_ids(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Hashed ids of all character n-grams of the lower-cased text, a blank at each end; a long text in blocks.

    A block carries over the characters that the n-grams across its end begin with, so no n-gram is
    lost and none is counted twice.
    """
    whole = f" {text.lower()} "
    for at in range(0, len(whole), BLOCK):
        last = at + BLOCK >= len(whole)
        codes = np.frombuffer(whole[at : at + BLOCK + max(LENGTHS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        out, run = [], np.zeros(len(codes), np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            run = run[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
            if n in LENGTHS:
                mixed = (run if last else run[:BLOCK]) * np.uint32(0x9E3779B1)
                out.append((mixed >> np.uint32(8)) % np.uint32(buckets))
        yield np.concatenate(out)


def learning_counts(docs: DataFrame, bound: int = BOUND, buckets: int = BUCKETS) -> DataFrame:
    """``lang, bucket, n``: n-gram counts of at most ``bound`` documents a language.

    Only documents with a language and a text, crc32(doc_id) mod 4 other than 2; of more, those
    of the lowest hash.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(crc32_of_id() % FOLD != HELD_OUT)
    # the hash threshold keeps about `bound` documents of each language without sorting any group
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("__n"))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.select("lang", "text", "doc_id").join(F.broadcast(sizes), "lang").where(unit * F.col("__n") < bound)

    def build():
        def work(cols):
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(cols["lang"], cols["text"], strict=True):
                got = sums.setdefault(lang, np.zeros(buckets, np.int64))
                for ids in ngram_ids(text, buckets):
                    got += np.bincount(ids, minlength=buckets)
            found = {lang: np.flatnonzero(c) for lang, c in sums.items()}
            return {
                "lang": [lang for lang, i in found.items() for _ in range(len(i))],
                "bucket": np.concatenate([*found.values(), np.zeros(0, np.int64)]).astype(np.int32),
                "n": np.concatenate([*(sums[lang][i] for lang, i in found.items()), np.zeros(0, np.int64)]),
            }

        return work

    return map_rows(chosen.select("lang", "text"), build, "lang string, bucket int, n long", rows=4096).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def log_probabilities(counts: DataFrame, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """(languages, matrix): smoothed log probabilities, at most buckets x languages numbers."""
    got = counts.toArrow()
    names = np.array(got["lang"].to_pylist(), object)
    bucket, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    langs = sorted(set(names.tolist()))
    matrix = np.ones((buckets, len(langs)))
    for i, lang in enumerate(langs):
        own = names == lang
        matrix[bucket[own], i] += n[own]
    return langs, np.log(matrix / matrix.sum(0)).astype(np.float32)


def predict_languages(docs: DataFrame, bound: int = BOUND, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document.

    ``lang_pred`` is a language of the learning rows (ties: the first in order), or ``und`` with
    score 0 if the text is null, has no letter, or nothing could be learnt. ``score`` is the
    posterior probability. ``held_out``: crc32(doc_id) mod 4 is 2. Whole texts are scored.
    Repeated rows are scored alike; columns other than doc_id, text and lang are not read. An empty
    table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(log_probabilities(learning_counts(docs, bound, buckets), buckets))

    def build():
        langs, table = shared.value

        def one(text):
            if not text or not langs or not any(map(str.isalpha, text)):
                return UNKNOWN, 0.0
            total = np.zeros(len(langs))
            for ids in ngram_ids(text, buckets):
                total += table[ids].sum(0, dtype=np.float64)
            odds = np.exp(total - total.max())
            return langs[int(total.argmax())], float(odds.max() / odds.sum())

        def work(cols):
            got = [one(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc32_of_id() % FOLD == HELD_OUT).alias("held_out"))
    return map_rows(rows, build, "doc_id long, held_out boolean, lang_pred string, score double")
