"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

score = w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2], which takes time linear
in the number of features. It is fitted on a bounded sample of labelled rows and applied to all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import Words, gather, learning_rows, row_sums, score_rows, sigmoid

#: Hashed word features, factors, labelled rows to learn from at most.
WIDTH, FACTORS, BOUND = 1 << 16, 8, 8000
THRESHOLD = 0.3
BINS = 10
STATISTICS = ("symbols", "digits", "capitals", "line breaks", "marks", "distinct words", "word length", "words", "characters", "longest word", "blanks")
#: Metadata that is an input: characters as the table states them, and how far that is from the text (null: a bin of its own).
METADATA = ("stated characters", "stated less true characters")


def _byte_classes() -> np.ndarray:
    """Of each byte its class: 0 symbols, 1 digits, 2 capitals, 3 line breaks, 4 marks, 5 blanks, 6 all else."""
    out = np.full(256, 6)
    out[33:127] = 0
    for kind, chars in enumerate(("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\n", ".,;:!?'\"-()", " \t\r\v\f"), 1):
        out[[ord(c) for c in chars]] = kind
    out[97:123] = 6
    return out


CLASSES = _byte_classes()


def statistics(words: Words, distinct: np.ndarray) -> np.ndarray:
    """The structure statistics of each text, each scaled to [0, 1]."""
    rows = len(words.counts)
    of_byte = np.repeat(np.arange(rows), words.sizes + 1)
    counts = np.bincount(of_byte * 7 + CLASSES[words.buffer], minlength=rows * 7).reshape(rows, 7).astype(float)
    symbols, digits, capitals, breaks, marks, blanks, _ = counts.T
    breaks = breaks - 1  # the one that ends the text in the buffer
    n, m = np.maximum(1, words.sizes), np.maximum(1, words.counts)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, words.doc, words.lengths)
    scaled = [
        symbols / n * 4, digits / n * 4, capitals / n * 4, breaks / m * 4, marks / m, distinct / m,
        (n - blanks - breaks) / m / 20, np.log1p(words.counts) / 12, np.log1p(words.sizes) / 15, np.log1p(longest) / 6, blanks / n * 2,
    ]
    return np.clip(np.stack(scaled, 1), 0, 1)


def metadata(stated: list[int | None], texts: list[str | None]) -> np.ndarray:
    """Bins of the metadata of each text, 0 for what is not stated."""
    known = np.array([s is not None for s in stated])
    n = np.array([float(s or 0) for s in stated])
    true = np.array([float(len(t or "")) for t in texts])
    length = 1 + np.minimum(np.log1p(np.maximum(n, 0)) / 15 * (BINS - 1), BINS - 2).astype(np.int64)
    apart = 1 + np.where(n == true, 0, np.where(n > true, 1, 2)) + 2 * (np.abs(n - true) > 0.1 * true)
    return np.stack([np.where(known, length, 0), np.where(known, apart, 0)], 1)


def featurizer():
    """A function of a list of texts (null: empty) and of stated lengths that gives (row starts, ids, values): statistics and metadata in bins, then words."""

    def of(texts: list[str | None], stated: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = Words(texts, plain=False)
        rows, stats = len(texts), len(STATISTICS) + len(METADATA)
        doc, ids = words.distinct(WIDTH)
        distinct = np.bincount(doc, minlength=rows)
        bins = np.minimum((statistics(words, distinct) * BINS).astype(np.int64), BINS - 1)
        binned = np.arange(stats) * BINS + np.concatenate([bins, metadata(stated, texts)], axis=1)
        starts = np.r_[0, np.cumsum(distinct + stats)]
        out, xs = np.empty(starts[-1], np.int32), np.ones(starts[-1], np.float32)
        head = (starts[:-1, None] + np.arange(stats)).ravel()
        out[head] = binned.ravel()
        rest = np.ones(starts[-1], bool)
        rest[head] = False
        out[rest] = ids + stats * BINS
        xs[rest] = np.repeat(1 / np.sqrt(np.maximum(1, distinct)), distinct)
        return starts, out, xs

    return of


def machine(w0: float, w: np.ndarray, v: np.ndarray, starts: np.ndarray, ids: np.ndarray, xs: np.ndarray):
    """(logits, factor sums) of rows, by the sum-of-squares identity."""
    xs = xs.astype(np.float64)
    scaled = v[ids] * xs[:, None]
    sums = row_sums(scaled, starts)
    logits = w0 + row_sums(w[ids] * xs, starts) + 0.5 * ((sums * sums).sum(1) - row_sums((scaled * scaled).sum(1), starts))
    return logits, sums


def fit(y: np.ndarray, starts: np.ndarray, ids: np.ndarray, xs: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.08, decay: float = 1e-4, seed: int = 7):
    """Adagrad on the logistic loss. No rows: a model that scores 0.5. Rows of one class: near that class."""
    width = (len(STATISTICS) + len(METADATA)) * BINS + WIDTH
    rng = np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(width), rng.normal(0, 0.02, (width, FACTORS))
    g0, gw, gv = 1e-8, np.full(width, 1e-8), np.full((width, FACTORS), 1e-8)
    if not len(y):
        return w0, w.astype(np.float32), (v * 0).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            sizes = starts[rows + 1] - starts[rows]
            own = np.r_[0, np.cumsum(sizes)]
            where = np.repeat(starts[rows] - own[:-1], sizes) + np.arange(own[-1])
            i, x = ids[where], xs[where].astype(np.float64)
            logits, sums = machine(w0, w, v, own, i, x)
            err = (sigmoid(logits) - y[rows]) / len(rows)
            each = np.repeat(err, sizes) * x
            touched, slot = np.unique(i, return_inverse=True)
            dw = np.bincount(slot, each, len(touched)) + decay * w[touched]
            inner = np.repeat(sums, sizes, axis=0) - v[i] * x[:, None]
            dv = np.stack([np.bincount(slot, each * inner[:, f], len(touched)) for f in range(FACTORS)], 1) + decay * v[touched]
            g0 += err.sum() ** 2
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            w0 -= rate * err.sum() / np.sqrt(g0)
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= rate * 0.3 * dv / np.sqrt(gv[touched])
    return w0, w.astype(np.float32), v.astype(np.float32)


def quality_scores(docs: DataFrame, labels: DataFrame, bound: int = BOUND, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document (score: how likely quality is 1).

    Learns from at most ``bound`` labelled rows outside the fold crc32(doc_id) mod 5 = 0; inputs are
    the text and ``n_chars`` (null, or no such column: not stated). Null and empty texts get the score of a text without words. Repeated rows
    are scored alike. No labels: every score is 0.5. An empty table gives an empty one. Columns
    named in ``carry`` come back with their row; others are not read.
    """
    stated = (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("long")
    rows = learning_rows(docs, labels, "quality", 5, bound, (stated.alias("stated"),))
    model = fit(*gather(rows, featurizer, bound, "stated"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # width * (factors + 1) floats

    def build():
        of, (w0, w, v) = featurizer(), shared.value

        def score(texts, stated):
            return sigmoid(machine(w0, w, v, *of(texts, stated))[0])

        return score

    return score_rows(docs, build, 5, 0, threshold, carry, stated)
