"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all documents give inverse document frequencies.
   Passages around a run of words of an item are not counted, so that documents which quote an
   item don't lower the weight of its words.
2. The benchmark goes in blocks of a bounded number of items. A distributed randomised SVD of the
   block's TF-IDF passages gives a latent space (weight of a word: sqrt(count) * idf).
3. The words of every document are projected, summed to cells and to overlapping windows about as
   long as the items, and each window is compared with all items of its length. Windows whose
   mass on words of the block can't reach the cosine are not compared.
4. Every place where a document has a run of words of an item (all of them, if it has fewer) is
   a candidate too, whatever its cosine: verbatim passages are found without exception.
5. Candidates are checked by the longest common subsequence of words and by the item's answer
   words, so paraphrases with edits are found and mere likeness of topic is not.

No candidate list is cut off; there is no join of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, partitions
from ._words import Words, runs

WIDTH, RANK, OVERSAMPLE = 1 << 18, 96, 8
#: Items that share a latent space (the rank keeps most of what so many rare words say), and
#: latent spaces that documents meet in one reading of them: together some 8 MB a block.
ITEMS_IN_BLOCK, BLOCKS_IN_PASS = 256, 16
#: Least latent cosine of a candidate, least share of the item's words in common order, and the
#: lower share that suffices if this share of the answer (the item's last words) is there too.
COSINE, COMMON, COMMON_WITH_ANSWER, ANSWER, ANSWER_WORDS = 0.35, 0.8, 0.6, 0.6, 5
#: In the comparison a window's norm counts as at most so many times the item's, so that words which
#: an edit puts in, however rare, can't outweigh what it leaves.
HEAVIEST = 1.3
#: Words in a cell; windows are whole cells, their lengths grow by this factor, and items get the
#: first that holds 1.25 times their words. A window starts every third of its length.
CELL, FIRST_WINDOW, WINDOW_GROWTH, STEPS = 4, 12, 1.4, 3
#: Words of a run that makes a candidate by itself.
RUN = 5


class Runs:
    """The runs of words of some items (sequences of 64-bit word hashes), for looking them up in texts.

    24 bytes a word of the items.
    """

    def __init__(self, items: list[list[int]]):
        lengths = np.array([len(i) for i in items], np.int64)
        self.lengths, self.by_size = lengths, {}
        for n in np.unique(np.minimum(lengths, RUN))[::-1].tolist():
            which = np.flatnonzero(np.minimum(lengths, RUN) == n) if n else []
            if not len(which):
                continue
            doc = np.repeat(which, lengths[which])
            at, h = runs(np.concatenate([np.array(items[i], np.int64) for i in which]).view(np.uint64), doc, n)
            start = np.cumsum(lengths[which]) - lengths[which]
            offset = at - np.repeat(start, lengths[which])[at]
            order = np.argsort(h, kind="stable")
            self.by_size[n] = (h[order], doc[at][order], offset[order])

    def places(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(item, word where the item would start) of every run that the texts share with an item."""
        items, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (known, item, offset) in self.by_size.items():
            at, h = runs(words.hashes, words.doc, n)
            low = np.searchsorted(known, h)
            found = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == h)
            low, times = low[found], np.searchsorted(known, h[found], side="right") - low[found]
            where = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
            items.append(item[where])
            starts.append(np.repeat(at[found], times) - offset[where])
        return np.concatenate(items), np.concatenate(starts)

    def quoted(self, words: Words) -> np.ndarray:
        """Of each word: is it where an item stands that the text shares a run with."""
        item, start = self.places(words)
        steps = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(steps, np.clip(start, 0, len(words.hashes)), 1)
        np.add.at(steps, np.clip(start + self.lengths[item], 0, len(words.hashes)), -1)
        return np.cumsum(steps)[:-1] > 0


def document_frequencies(docs: DataFrame, items: list[list[int]], width: int = WIDTH) -> tuple[np.ndarray, int]:
    """(documents with each hashed word, documents), over all documents; ``width`` numbers reach the driver.

    Words where a document quotes one of ``items`` don't count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Runs(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(width, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                texts = batch.column(0).slice(at, 64).to_pylist()
                words = Words(texts, plain=True).without_repeats()
                own = ~shared.value.quoted(words)
                found = np.unique(words.doc[own] * width + words.ids(width)[own]) % width
                counts += np.bincount(found, minlength=width)
                n += len(texts)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, counts[at]])], names=["bucket", "n"])

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width + 1, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out[:-1], int(out[-1])


def tfidf(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, weights) of a passage."""
    own, counts = np.unique(ids, return_counts=True)
    return own, np.sqrt(counts) * idf[own]


def randomised_svd(items: DataFrame, idf: np.ndarray, vocabulary: np.ndarray, rank: int = RANK, rounds: int = 2, seed: int = 11) -> np.ndarray:
    """An orthonormal basis (words of the vocabulary x rank) of the items' leading right singular space.

    ``items`` has ``ids array<int>``. Each round multiplies by the Gram matrix of the normalised
    TF-IDF rows: tasks send the product of their rows, summed by word. Sizes: vocabulary x rank.
    """
    spark = items.sparkSession
    sketch = min(rank + OVERSAMPLE, max(1, len(vocabulary)))
    place = np.full(len(idf), -1)
    place[vocabulary] = np.arange(len(vocabulary))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(vocabulary), sketch)))[0]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((place, basis, idf))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            place, basis, idf = shared.value
            total = np.zeros_like(basis)
            for batch in batches:
                for ids in batch.column(0).to_pylist():
                    own, w = tfidf(np.array(ids, np.int64), idf)
                    if len(own) and (norm := np.sqrt(w @ w)) > 0:
                        rows = place[own]
                        total[rows] += np.outer(w / norm, (w / norm) @ basis[rows])
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["word", "row"])

        parts = items.select("ids").mapInArrow(run, "word long, row array<double>")
        sums = parts.repartition(partitions(spark), "word").mapInArrow(_row_sums, "word long, row array<double>").orderBy("word").toArrow()
        product = np.zeros_like(basis)
        if sums.num_rows:
            product[sums["word"].to_numpy()] = sums["row"].combine_chunks().flatten().to_numpy().reshape(-1, sketch)
        basis, scale, _ = np.linalg.svd(product, full_matrices=False)
        shared.unpersist()
    keep = min(rank, int((scale > 1e-9 * max(scale.max(initial=0), 1e-12)).sum()))
    return basis[:, :keep]


def _row_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a word, of a task that holds all rows of its words."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for word, row in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), strict=True):
            sums[word] = sums[word] + row if word in sums else row
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["word", "row"])


def common_subsequence(item: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence of two word sequences (bit-parallel)."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    whole = (1 << len(item)) - 1
    row = whole
    for w in region:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(item) - row.bit_count()


def window_of(n: int) -> int:
    """Words of the window that is searched for an item of n words."""
    w = float(FIRST_WINDOW)
    while w < 1.25 * n:
        w *= WINDOW_GROWTH
    return CELL * round(w / CELL)


def matches(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, common: float = COMMON, items_in_block: int = ITEMS_IN_BLOCK) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, cosine, common, answer``: items found in documents.

    Words are letters and digits in lower case; of a word several times in a row one counts. One
    row a document and item, of the best window: its place in words, latent cosine, the share
    of the item's words that stand there in order, and the share of its answer. Items or
    documents without a word match nothing (null and empty texts among them). Repeated rows of
    documents or items come back once for each pair of ids. Other columns are not read. Empty
    tables give an empty one.
    """
    def ids_of():
        def work(cols):
            words = Words(cols["text"], plain=True).without_repeats()
            ends = np.cumsum(words.counts)[:-1]
            return {"item_id": cols["item_id"], "ids": np.split(words.ids(WIDTH), ends), "words": np.split(words.hashes.view(np.int64), ends)}

        return work

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    blocks = max(1, -(-items.count() // items_in_block))
    ids = map_rows(items, ids_of, "item_id long, ids array<int>, words array<long>").where(F.size("ids") > 0)
    df, n_docs = document_frequencies(docs, ids.select("words").toArrow()["words"].to_pylist())
    idf = np.log((1.0 + n_docs) / (1.0 + df)).astype(np.float32) + np.float32(1e-3)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for first in range(0, blocks, BLOCKS_IN_PASS):
        in_pass = [ids.where(F.pmod(F.xxhash64("item_id", "ids"), F.lit(blocks)) == b) for b in range(first, min(first + BLOCKS_IN_PASS, blocks))]
        part = _search(rows, [_block_model(items, idf) for items in in_pass], idf, cosine, common)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("common", "cosine", (-F.col("start_word")).alias("back"), "n_words", "answer")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.back")).alias("start_word"), "b.n_words", F.round("b.cosine", 4).alias("cosine"), F.round("b.common", 4).alias("common"), F.round("b.answer", 4).alias("answer"))


class BlockModel:
    """What a task needs to search for the items of one block, in arrays.

    ``words`` is the latent vector of each word of the vocabulary times its idf, with a row of
    zeros at the end for all words that are in no item; ``by_window`` has the items by the length
    of the window that is searched for them.
    """

    def __init__(self, item_ids: list[int], ids: list[list[int]], hashes: list[list[int]], basis: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray):
        self.item_ids, self.sequences, self.runs = item_ids, hashes, Runs(hashes)
        self.place = np.full(len(idf), -1, np.int32)
        self.place[vocabulary] = np.arange(len(vocabulary))
        latent = np.zeros((len(ids), basis.shape[1]))
        for i, own in enumerate(ids):
            words, w = tfidf(np.array(own, np.int64), idf)
            latent[i] = (w @ basis[self.place[words]]) if len(words) else 0
        norm = np.maximum(np.linalg.norm(latent, axis=1), 1e-12)
        self.latent, self.most = (latent / norm[:, None]).astype(np.float32), (HEAVIEST * norm).astype(np.float32)
        self.words = np.concatenate([basis * idf[vocabulary][:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
        windows = np.array([window_of(len(i)) for i in ids], np.int64)
        self.by_window = {int(w): np.flatnonzero(windows == w) for w in np.unique(windows)}

    def candidates(self, seq: np.ndarray, mass_of: np.ndarray, cosine: float) -> Iterator[tuple[int, int, int, float]]:
        """(first word, last word + 1, item, cosine) over the joined words of some documents."""
        n = -(-len(seq) // CELL)
        padded = np.full(n * CELL, -1)
        padded[: len(seq)] = self.place[seq]
        cells = np.zeros((n + 1, self.words.shape[1]))
        for at in range(0, n, 4096):
            part = self.words[padded[at * CELL : (at + 4096) * CELL]]
            cells[at + 1 : at + 1 + len(part) // CELL] = part.reshape(-1, CELL, part.shape[1]).sum(1)
        np.cumsum(cells, axis=0, out=cells)
        mass = np.zeros(n * CELL)
        mass[: len(seq)] = mass_of[seq]
        whole = np.r_[0, np.cumsum(mass.reshape(-1, CELL).sum(1))]
        inside = np.r_[0, np.cumsum(np.where(padded >= 0, mass, 0).reshape(-1, CELL).sum(1))]
        for w, which in self.by_window.items():
            size = w // CELL
            at = np.arange(0, max(1, n - size + size // STEPS + 1), max(1, size // STEPS))
            to = np.minimum(at + size, n)
            total = whole[to] - whole[at]
            bound = (inside[to] - inside[at]) >= cosine**2 * np.minimum(total, self.most[which].min() ** 2)
            at, to = at[bound], to[bound]
            norm = np.sqrt(np.maximum(total[bound], 1e-9)).astype(np.float32)
            common = (cells[to] - cells[at]).astype(np.float32) @ self.latent[which].T
            for i, k in zip(*np.nonzero(common >= cosine * np.minimum(norm[:, None], self.most[which])), strict=True):
                yield int(at[i]) * CELL, min(int(to[i]) * CELL, len(seq)), int(which[k]), float(common[i, k] / norm[i])

    def by_runs(self, split: Words, seq: np.ndarray, mass_of: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """As ``candidates``, for all places of a run of an item; windows have the item in their middle."""
        which, start = self.runs.places(split)
        if not len(which):
            return
        sizes = np.array([window_of(n) for n in self.runs.lengths.tolist()], np.int64)[which]
        # nearby starts share a window: what is checked reaches half a window further to both sides
        kept = np.unique(np.stack([which, start // (sizes // 4)]), axis=1, return_index=True)[1]
        for k, at, w in zip(which[kept].tolist(), start[kept].tolist(), sizes[kept].tolist(), strict=True):
            a = at - (w - int(self.runs.lengths[k])) // 2
            a, b = max(0, a), min(len(seq), a + w)
            score = self.words[self.place[seq[a:b]]].sum(0) @ self.latent[k] / np.sqrt(max(mass_of[seq[a:b]].sum(), 1e-9))
            yield a, b, k, float(score)


def _block_model(items: DataFrame, idf: np.ndarray) -> BlockModel:
    own = items.orderBy("item_id").toArrow()  # a block: bounded
    ids = own["ids"].to_pylist()
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(s, np.int64) for s in ids)])).astype(np.int64)
    basis = randomised_svd(items, idf, vocabulary) if len(vocabulary) else np.zeros((0, 0))
    return BlockModel(own["item_id"].to_pylist(), ids, own["words"].to_pylist(), basis, vocabulary, idf)


def _search(rows: DataFrame, blocks: list[BlockModel], idf: np.ndarray, cosine: float, common: float) -> DataFrame:
    """The items of all the blocks in one reading of the documents."""
    shared = rows.sparkSession.sparkContext.broadcast(([b for b in blocks if b.sequences], idf))

    def build():
        blocks, idf = shared.value
        mass_of = idf.astype(np.float64) ** 2

        def search(doc_ids: list, texts: list) -> Iterator[tuple]:
            split = Words(texts, plain=True).without_repeats()
            ends = np.cumsum(split.counts)
            seq, hashes = split.ids(WIDTH), split.hashes.view(np.int64)
            if not len(seq):
                return
            for block in blocks:
                for a, b, k, score in chain(block.candidates(seq, mass_of, cosine), block.by_runs(split, seq, mass_of)):
                    item = block.sequences[k]
                    reach = (b - a) // 2
                    # a window may touch several documents: each is checked by itself
                    for d in range(int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, b - 1, side="right")) + 1):
                        start = int(ends[d] - split.counts[d])
                        region = hashes[max(start, a - reach) : min(int(ends[d]), b + reach)].tolist()
                        share = common_subsequence(item, region) / len(item)
                        if share < min(common, COMMON_WITH_ANSWER):
                            continue
                        tail = item[-ANSWER_WORDS:]
                        answer = common_subsequence(tail, region) / len(tail)
                        if share >= common or answer >= ANSWER:
                            first = max(start, a) - start
                            yield doc_ids[d], block.item_ids[k], first, min(b - start, int(split.counts[d])) - first, score, share, answer

        def work(cols):
            found = list(search(cols["doc_id"], cols["text"]))
            names = ("doc_id", "item_id", "start_word", "n_words", "cosine", "common", "answer")
            return dict(zip(names, zip(*found, strict=True), strict=True)) if found else {k: [] for k in names}

        return work

    return map_rows(rows, build, "doc_id long, item_id long, start_word long, n_words long, cosine double, common double, answer double", rows=64)
