"""Toxicity: a logistic classifier over hashed words with counterfactual regularisation.

For each labelled text that names a group, a twin is made in which every identity term is
swapped for another of its set; the squared change of the logit between the two is penalised
beside the logistic loss, so the model can't lean on which group is named. A sparsity penalty
keeps words without evidence at weight zero. Fitted on a bounded sample, applied to all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ._words import Words, gather, learning_rows, score_rows, sigmoid

WIDTH, BOUND = 1 << 18, 12000
THRESHOLD = 0.5
#: Words in fewer learning rows than this have no weight.
LEAST_ROWS = 3
#: Penalties: on weights, in standard errors of a word without effect; on logit changes between twins;
#: on the weights of the words that are left, in the second fit.
SPARSITY, EVENNESS, RIDGE = 4.0, 1.0, 1e-4
#: Sets of identity terms that may stand for each other.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girl", "boy"), ("girls", "boys"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "arab"), ("immigrant", "native"), ("immigrants", "natives"), ("refugees", "citizens"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
    ("old", "young"), ("deaf", "blind", "disabled"),
)


def swaps(identities: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the identity terms, sorted; ids of the terms that stand in for them)."""
    terms = [t for group in identities for t in group]
    others = [group[(i + 1) % len(group)] for group in identities for i in range(len(group))]
    own, other = (Words(x, plain=True).ids(WIDTH) for x in (terms, others))
    own, first = np.unique(own, return_index=True)
    return own, other[first]


def with_twin(identities: tuple[tuple[str, ...], ...] = IDENTITY_TERMS):
    """A function of a list of texts that gives (row starts, ids, values): +1 for a text's own words,
    -1 for own words lost and 2 for words won in its twin (nothing but +1 if it names no group)."""
    terms, others = swaps(identities)

    def of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc, ids = Words(texts, plain=True).distinct(WIDTH)
        at = np.minimum(np.searchsorted(terms, ids), len(terms) - 1)
        named = terms[at] == ids
        pair = doc * WIDTH + ids
        enters = np.unique(doc[named] * WIDTH + others[at[named]])
        lost = named & ~np.isin(pair, enters)
        won = np.setdiff1d(enters, pair)
        pairs = np.r_[pair, won]
        values = np.r_[np.where(lost, -1.0, 1.0), np.full(len(won), 2.0)].astype(np.float32)
        order = np.argsort(pairs, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(pairs // WIDTH, minlength=len(texts)))]
        return starts, (pairs[order] % WIDTH).astype(np.int32), values[order]

    return of


def fit(y: np.ndarray, starts: np.ndarray, ids: np.ndarray, xs: np.ndarray, sparsity: float = SPARSITY, evenness: float = EVENNESS, ridge: float = RIDGE) -> tuple[float, np.ndarray]:
    """A sparse fit chooses the words; a second one, without the shrinkage, weighs them."""
    w = np.zeros(WIDTH, np.float32)
    if not len(y):
        return 0.0, w
    row = np.repeat(np.arange(len(y)), np.diff(starts))
    own = np.where(xs <= 1, 1.0, 0.0)
    change = np.where(xs < 0, -1.0, np.where(xs > 1, 1.0, 0.0))
    seen = np.bincount(ids, weights=own, minlength=WIDTH)
    columns = np.flatnonzero((seen >= LEAST_ROWS) | (np.bincount(ids, weights=np.abs(change), minlength=WIDTH) > 0))
    place = np.full(WIDTH, -1)
    place[columns] = np.arange(len(columns))
    kept = place[ids] >= 0
    row, col, own, change = row[kept], place[ids[kept]], own[kept], change[kept]
    n, k = len(y), len(columns)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    # words are scaled by their spread, so that rare telling words may move fast
    rare = np.sqrt(n / np.maximum(seen[columns], 1))
    b, x = _descend(y, row, col, own * rare[col], change * rare[col], k, 200, sparsity * np.sqrt(share * (1 - share) / n), evenness, 0.0)
    left = np.flatnonzero(x)
    place = np.full(k, -1)
    place[left] = np.arange(len(left))
    kept = place[col] >= 0
    row, col, own, change = row[kept], place[col[kept]], own[kept], change[kept]
    b, x = _descend(y, row, col, own * rare[left][col], change * rare[left][col], len(left), 200, 0.0, evenness, ridge)
    w[columns[left]] = x * rare[left]
    return float(b), w


def _descend(y: np.ndarray, row: np.ndarray, col: np.ndarray, own: np.ndarray, change: np.ndarray, k: int, rounds: int, sparsity: float, evenness: float, ridge: float) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient on logistic loss + evenness * mean squared logit change + sparsity * |x| + ridge * x^2 / 2."""
    n, moved = len(y), change != 0
    b = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    x, z, bz, t, step, last = np.zeros(k), np.zeros(k), b, 1.0, 4.0, np.inf
    for _ in range(rounds):
        logits = bz + np.bincount(row, own * z[col], n)
        gap = np.bincount(row[moved], change[moved] * z[col[moved]], n)
        loss = np.mean(np.logaddexp(0, logits) - y * logits) + evenness * np.mean(gap * gap) + sparsity * np.abs(z).sum() + ridge * (z @ z) / 2
        if loss > last + 1e-12:  # too long a step, or momentum overshoots: start anew from the best point
            step, t, z, bz, last = step / 2, 1.0, x.copy(), b, np.inf
            continue
        last = loss
        err = (sigmoid(logits) - y) / n
        grad = np.bincount(col, own * err[row], k) + 2 * evenness / n * np.bincount(col[moved], change[moved] * gap[row[moved]], k) + ridge * z
        new = z - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * sparsity, 0)
        new_b = bz - step * err.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, bz = new + (t - 1) / t_new * (new - x), new_b + (t - 1) / t_new * (new_b - b)
        x, b, t = new, new_b, t_new
    return b, x


def toxicity_scores(docs: DataFrame, labels: DataFrame, bound: int = BOUND, threshold: float = THRESHOLD, identities: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, evenness: float = EVENNESS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document (score: how likely toxic is 1).

    ``identities`` are sets of terms that may stand for each other; ``evenness`` is the weight of the
    squared logit change between a text and its twin (0: no counterfactual penalty). Where no labelled
    text names a group, there are no twins and the penalty has no effect.

    Learns from at most ``bound`` labelled rows outside the fold crc32(doc_id) mod 5 = 0; only
    texts are inputs. Null and empty texts get the score of a text without words. Repeated rows
    are scored alike. No labels: every score is 0.5. Other columns are not read. An empty table
    gives an empty one.
    """
    model = fit(*gather(learning_rows(docs, labels, "toxic", 5, bound), lambda: with_twin(identities), bound), evenness=evenness)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # width floats

    def build():
        b, w = shared.value

        def score(texts):
            words = Words(texts, plain=True)
            telling = w[words.ids(WIDTH)] != 0
            words.doc, words.hashes = words.doc[telling], words.hashes[telling]
            doc, ids = words.distinct(WIDTH)
            return sigmoid(b + np.bincount(doc, w[ids], len(texts)))

        return score

    return score_rows(docs, build, 5, 0, threshold)
