"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; in each window of w of them the minimum is chosen
(of ties the rightmost); chosen hashes and their positions make the fingerprint. Two texts that
share a run of k + w - 1 code points share a chosen hash. Texts shorter than k are one hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_rows, partitions, rolling_hash, window_minima

GRAM, WINDOW = 8, 10
#: Bytes of text in a range of ids, whose neighbours are found by one task; ranges are two to a partition at least.
RANGE_BYTES, RANGES_PER_PARTITION = 32 << 20, 2


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the chosen k-grams; an empty text has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = rolling_hash(codes, min(gram, len(codes)))
    at = window_minima(h, window)
    return h[at] >> np.uint64(24), at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the distinct hashes of both that are in each (two empty ones: 1)."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b))
    return both / (len(np.unique(a)) + len(np.unique(b)) - both)


def fingerprint_text(hashes: np.ndarray) -> str:
    """Ten hexadecimal digits for each chosen hash, in order of position, apart by a space."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex(" ", 5)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id, hashes, positions`` of every document (null text: empty arrays); repeated rows stay."""

    def build():
        def work(cols):
            got = [winnow(t or "", gram, window) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "hashes": [g[0].astype(np.int64) for g in got], "positions": [g[1] for g in got]}

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), build, "doc_id long, hashes array<long>, positions array<long>")


def ranges_of(docs: DataFrame) -> int:
    """How many ranges of ids hold about ``RANGE_BYTES`` of text each."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(RANGES_PER_PARTITION * partitions(docs.sparkSession), -(-size // RANGE_BYTES))


def with_next_text(docs: DataFrame, ranges: int) -> DataFrame:
    """``doc_id, text, next_text``: the text of the next document by descending id, after the last the first's.

    Ids are cut into ranges at quantiles, so that texts move once, to the range's task; only the
    first document of each range (at most ``ranges`` of them) is joined across. Equal ids are
    ordered by a hash of their text, null ids come last.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = docs.select(F.percentile_approx("doc_id", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10_000)).first()[0] if ranges > 1 else None
    cuts = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts or []))])
    nth = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(cuts, lambda c: c <= F.col("doc_id"))))
    placed = docs.withColumn("part", nth).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    inside = placed.withColumn("next_text", F.lead("text").over(Window.partitionBy("part").orderBy(*order)))
    # the first document of each range, handed to the range before it (the highest range is first)
    heads = _heads(docs.withColumn("part", nth))
    return inside.join(heads, "part").select("doc_id", "text", F.coalesce("next_text", "head").alias("next_text"))


def _heads(placed: DataFrame) -> DataFrame:
    """``part, head``: for each range the text of the first document of the range that follows it."""
    ids = placed.groupBy("part").agg(F.max("doc_id").alias("top"))
    follow = Window.orderBy(F.col("part").desc())
    whole = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = ids.select("part", F.coalesce(F.lead("part").over(follow), F.first("part").over(whole)).alias("from"))
    top = ids.select(F.col("part").alias("p"), "top")
    first = placed.join(F.broadcast(top), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("top")))
    first = first.groupBy("p").agg(F.min_by("text", F.xxhash64("text")).alias("head"))
    return nxt.join(first, F.col("from") == F.col("p")).select("part", "head")


def edited_likeness(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, positions``. ``positions`` has where in the text each gram of ``fingerprint`` begins, as
    text, apart by a blank. The edited text has its last floor(n_chars / 3) code points replaced by the first
    as many (or all) of the next document's. Null text: empty (fingerprint ''). A single document
    is its own next. Repeated rows stay. An empty table gives an empty one.
    """
    pairs = with_next_text(docs, ranges_of(docs))

    def build():
        last: list = [None, None]

        def of(text):
            if last[0] != text:
                last[:] = text, winnow(text, gram, window)
            return last[1]

        def work(cols):
            out: dict[str, list] = {k: [] for k in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions")}
            for text, other in zip(cols["text"], cols["next_text"], strict=True):
                own, at = of(text)
                cut = len(text) // 3
                edited = text[: len(text) - cut] + other[:cut]
                new = winnow(edited, gram, window)[0]
                for k, v in zip(out, (len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint_text(own), fingerprint_text(new), likeness(own, new), likeness(own, of(other)[0]), " ".join(map(str, at.tolist()))), strict=True):
                    out[k].append(v)
            return {"doc_id": cols["doc_id"], **out}

        return work

    return map_rows(pairs, build, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions string", rows=128)
