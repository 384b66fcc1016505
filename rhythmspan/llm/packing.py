"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents become ids in tasks; longer ones are cut into pieces. Only the counts by length (as many
rows as a sequence has tokens) reach the driver, where best-fit decreasing runs over counts: a run
of equal lengths goes to a run of equally full sequences in one step. The plan is a table of runs;
pieces take their slots by joining on the rank within their length.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged

CAPACITY = 2048
#: Id that ends a document.
END = 0
#: Texts of these characters, without the special token's name, give the same ids by the rank table, four times as fast.
PLAIN = re.compile(r"[\t\n\r\x20-ɏ‐-…€]*")
SPECIAL = "<|endoftext|>"
PLAN = "length int, from_rank long, to_rank long, first_sequence long, in_each long, first_offset long"


def encoder(vocabulary: str, ranks: str | None = None) -> Callable[[str], list[int]]:
    """Ids of a text by the vocabulary file, special tokens not added.

    ``ranks`` names the same vocabulary as a rank table, which then serves texts of plain characters.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    if not ranks:
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> list[int]:
        if PLAIN.fullmatch(text) and SPECIAL not in text:
            return quick.encode_ordinary(text)
        return whole.encode(text, add_special_tokens=False).ids

    return encode


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole ones from the end, so only the first may be shorter."""
    first = size % capacity or capacity
    starts = [0, *range(first, size, capacity)] if size > capacity else [0]
    return list(zip(starts, [*(b - a for a, b in zip(starts, starts[1:], strict=False)), size - starts[-1]], strict=True))


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` of each piece; ``lot, place``.

    ``lot`` is the task that cut the piece and ``place`` its rank there among pieces of its length,
    so the table is to be written before it is used twice. Null texts are empty: the end id alone.
    """
    out = "doc_id long, piece int, start long, length int, ids_crc32 long, lot int, place long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lot, seen = encoder(vocabulary, ranks), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), END], "<u4")
                    for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + length]
                        rows.append((doc_id, piece, start, length, zlib.crc32(own.tobytes()), lot, seen[length], own.view("<i4"))[: 7 + keep_ids])
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "lot", "place", "ids"][: 7 + keep_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())][: 7 + keep_ids]
    return docs.select("doc_id", "text").mapInArrow(run, out)


def plan(counts: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, from_rank, to_rank, first_sequence, in_each, first_offset) of best-fit decreasing over (length, count).

    Piece ``r`` of a length, ``from_rank <= r < to_rank``, goes to sequence ``first_sequence + (r - from_rank) // in_each``
    at ``first_offset + (r - from_rank) % in_each * length``. Equally full sequences that were filled
    alike stand side by side, so a run covers any number of them. A length opens two runs more at
    most and each use at least halves what a run's sequences have free, so there are no more than
    ``3 * capacity * log2(capacity)`` runs, however many pieces.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by free space: (first sequence, how many)
    spaces: list[int] = []
    runs, opened = [], 0

    def put(space: int, first: int, many: int) -> None:
        if space and many:
            if not free[space]:
                insort(spaces, space)
            free[space].append((first, many))

    for length, count in sorted(counts, reverse=True):
        done = 0
        while done < count:
            left, at = count - done, bisect_left(spaces, length)
            if at == len(spaces):
                many = -(-left // (capacity // length))
                put(capacity, opened, many)
                opened += many
                continue
            space = spaces[at]
            first, many = free[space].pop()
            if not free[space]:
                del spaces[at]
            in_each = min(space // length, left)
            used = min(many, left // in_each)
            runs.append((length, done, done + used * in_each, first, in_each, capacity - space))
            put(space - in_each * length, first, used)
            put(space, first + used, many - used)
            done += used * in_each
    return runs


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id, offset`` to written pieces (``length, lot, place``); best-fit decreasing over all of them.

    Ranks within a length are the place in the lot plus the pieces of that length in earlier lots:
    a length that a third of all pieces have is ranked by all tasks. At most ``capacity`` counts
    reach the driver; the plan's runs are broadcast (their number is bounded by the capacity alone).
    """
    spark = cut_pieces.sparkSession
    counts = cut_pieces.groupBy("length", "lot").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "lot", before.alias("before"))
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    runs = spark.createDataFrame(plan(((r.length, r.n) for r in lengths), capacity), PLAN)
    ranked = cut_pieces.join(starts, ["length", "lot"]).withColumn("rank", F.col("before") + F.col("place"))
    within = (ranked["length"] == runs["length"]) & (ranked["rank"] >= runs["from_rank"]) & (ranked["rank"] < runs["to_rank"])
    placed = ranked.join(F.broadcast(runs), within).drop(runs["length"])
    at = F.col("rank") - F.col("from_rank")
    sequence = F.col("first_sequence") + F.floor(at / F.col("in_each"))
    return placed.select(
        *(c for c in cut_pieces.columns if c not in ("lot", "place")),
        sequence.cast("long").alias("sequence_id"), (F.col("first_offset") + at % F.col("in_each") * F.col("length")).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, lengths``: the training sequences of packed pieces that kept their ids."""
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("held"))
    return held.select("sequence_id", F.flatten("held.ids").alias("ids"), F.col("held.doc_id").alias("doc_ids"), F.col("held.length").alias("lengths"))


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) of every piece of ``docs`` (``doc_id, text``).

    Null and empty texts are a piece of one id. Repeated rows and null ids are documents of their
    own. Texts of any length are cut, never shortened. An empty table gives an empty one; other
    columns are ignored.
    """
    return pack(staged(pieces(docs, vocabulary, ranks, capacity, keep_ids), "pieces"), capacity)
