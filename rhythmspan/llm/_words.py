"""Sparse hashed features of documents, built in tasks and gathered only for bounded samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import crc32_of_id, map_rows


#: Base of the word hash, odd, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept in the task and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = _powers[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 16), base, np.uint64)], dtype=np.uint64)
    return have[:n]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte: is it a blank; is it part of a letter or digit; its lower case."""
    blank, letter, lower = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    blank[[32, *range(9, 14)]] = True
    letter[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    lower[65:91] += 32
    return blank, letter, lower


BLANK, LETTER, LOWER = _tables()


class Words:
    """The words of some texts (null: empty) as 64-bit hashes, in order.

    ``plain``: a word's letters and digits in lower case (ASCII and Latin-1), words without any
    left out; else all of its bytes. ``hashes``, ``doc`` (index of the text) and ``lengths`` (in
    bytes) go by word; ``counts`` by text; ``buffer`` and ``ends`` are the joined bytes, a line
    feed after each text.
    """

    def __init__(self, texts: list[str | None], plain: bool):
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.sizes = np.array([len(r) for r in raws], np.int64)
        self.ends = np.cumsum(self.sizes + 1)
        self.buffer = buf = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
        blank = BLANK[buf]
        keep = LETTER[buf] if plain else ~blank
        word = np.cumsum(~blank & np.r_[True, blank[:-1]]) if len(buf) else np.zeros(0, np.int64)
        at = np.flatnonzero(keep)
        codes = buf[at]
        if plain:
            codes = LOWER[codes]
            wide = (codes >= 0x80) & (codes <= 0x9E) & (np.r_[0, buf][at] == 0xC3)
            codes = codes + wide.astype(np.uint8) * np.uint8(32)
        n = len(at)
        sums = np.r_[np.uint64(0), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _power_table(BASE, n), dtype=np.uint64)]
        own = word[at]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if n else np.zeros(0, np.int64)
        last = np.r_[first[1:], n][: len(first)]
        h = (sums[last] - sums[first]) * _power_table(INVERSE, n)[first]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        self.hashes = h ^ (h >> np.uint64(32))
        self.lengths = last - first
        self.doc = np.searchsorted(self.ends, at[first], side="right")
        self.counts = np.bincount(self.doc, minlength=len(texts))

    def without_repeats(self) -> Words:
        """Of a word several times in a row only the first is left."""
        new = np.r_[True, (self.hashes[1:] != self.hashes[:-1]) | (self.doc[1:] != self.doc[:-1])][: len(self.hashes)]
        self.hashes, self.doc, self.lengths = self.hashes[new], self.doc[new], self.lengths[new]
        self.counts = np.bincount(self.doc, minlength=len(self.counts))
        return self

    def ids(self, width: int) -> np.ndarray:
        return (self.hashes % np.uint64(width)).astype(np.int64)

    def distinct(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, id) of each text's distinct ids, sorted."""
        both = np.unique(self.doc * width + self.ids(width))
        return both // width, both % width


def runs(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every run of ``n`` words within a text."""
    at = np.flatnonzero(doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :])
    h = np.full(len(at), n, np.uint64)
    for i in range(n):
        h = h * np.uint64(BASE) + hashes[at + i]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return at, h ^ (h >> np.uint64(29))


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, held_out_of: int, bound: int, more: tuple[Column, ...] = ()) -> DataFrame:
    """``doc_id, text, y`` and ``more`` columns of at most ``bound`` labelled documents outside the held-out fold.

    The fold is crc32(doc_id as text) mod ``held_out_of`` = 0. If more are labelled, those of
    the lowest hash are taken, so reruns agree. Null labels and ids are left out; of repeated
    ids the greatest label holds.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(crc32_of_id() % held_out_of != 0)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # bound rows of 12 bytes are broadcast
    return docs.select("doc_id", "text", *more).join(F.broadcast(chosen), "doc_id")


def gather(rows: DataFrame, build: Callable, bound: int, meta: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels and features of a bounded sample as (y, row starts, ids, values), in doc_id order.

    ``build()`` returns a function of a list of texts (and of the column named by ``meta``) that gives (row starts, ids, values). Rows with a repeated
    doc_id may exceed the bound by the repeats; those are cut in the same order.
    """

    def make():
        of = build()

        def work(cols):
            starts, ids, xs = of(cols["text"], cols[meta]) if meta else of(cols["text"])
            cut = starts[1:-1]
            return {"doc_id": cols["doc_id"], "y": cols["y"], "ids": np.split(ids, cut), "xs": np.split(xs, cut)}

        return work

    found = map_rows(rows, make, "doc_id long, y int, ids array<int>, xs array<float>", rows=64).orderBy("doc_id").limit(bound)
    got = found.toArrow()
    y = got["y"].to_numpy().astype(np.float64)
    ids, xs = (got[c].combine_chunks() for c in ("ids", "xs"))
    starts = np.r_[0, np.cumsum(np.diff(ids.offsets.to_numpy()))] if len(y) else np.zeros(1, np.int64)
    return y, starts, ids.flatten().to_numpy(), xs.flatten().to_numpy()


def score_rows(docs: DataFrame, build: Callable, fold: int, rest: int, threshold: float, carry: tuple[str, ...] = (), meta: Column | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; ``build()`` gives a function of a list of texts (and of ``meta``).

    Columns named in ``carry`` come back unchanged with their row, after these.
    """

    def make():
        of = build()

        def work(cols):
            score = np.clip(of(cols["__text"], cols["__meta"]) if "__meta" in cols else of(cols["__text"]), 0.0, 1.0)
            return {"doc_id": cols["__id"], "held_out": cols["held_out"], "score": score, "predicted": (score >= threshold).astype(np.int32)} | {c: cols[c] for c in carry if c != "doc_id"}

        return work

    kept = [F.col(c) for c in carry if c != "doc_id"]
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text"), (crc32_of_id() % fold == rest).alias("held_out"), *([] if meta is None else [meta.alias("__meta")]), *kept)
    schema = "doc_id long, held_out boolean, score double, predicted int" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return map_rows(rows, make, schema, rows=64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs values[starts[i]:starts[i+1]] (runs may be empty), for 1 or more columns."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]
