"""Removal of long repeated byte strings.

Every string of ``length`` bytes holds an anchor: the rightmost minimum among the hashes of its
k-grams. Equal strings hold equal anchors at equal offsets, so strings need comparing only with
others of their anchor:

1. a context is a run of neighbouring strings with one anchor. Contexts are counted by anchor and
   hash; one that occurs twice is repeated as a whole.
2. Anchors with several different contexts (edges of copies, edits, passages): their contexts go
   to the task of the anchor. There, strings at like offsets from the anchor share a core. Cores
   that occur once are done; where different texts surround a core, it is replaced by one
   symbol, and a Burrows-Wheeler transform over those texts is expanded, breadth first by backward
   extension, up to the strings' length: what is still together then is repeated.
3. An anchor with very many contexts (a passage in thousands of documents) would make one large
   task; there cores, and the strings around cores that differ, are counted by key instead. That
   is exact too.
4. The spans of a document meet its text again, which is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bwt import repeated_starts
from ._common import map_rows, partitions, rolling_hash, scratch, staged, window_runs
from .passages import WORDS, shared_passages

LENGTH, GRAM = 400, 80
#: Strings that share a core; contexts of one anchor beyond which strings are counted by key;
#: bytes of contexts in a task.
SHARE, HOT, TASK_BYTES = 41, 400, 6_000_000
#: Bytes of the symbol that stands for a core.
SYMBOL = 8

ANCHORS = "kind string, h long, c long, id long, x long, pos long, head int, tail int, n int"
SPANS = "id long, x long, start long, stop long"


def _keyed(docs: DataFrame) -> DataFrame:
    """``id, x, text``: the id (null: the least long) and a hash of the text tell rows apart; equal rows are copies."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("x"), text.alias("text"))


def runs_of(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans covered by strings of the length at the sorted starts."""
    if not len(starts):
        return starts, starts
    new = np.r_[True, starts[1:] > starts[:-1] + length]
    return starts[new], np.r_[starts[:-1][new[1:]], starts[-1]] + length


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans; touching spans are one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def anchors_of(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, context hash, position, bytes of context before it, bytes from it on) of each anchor."""
    from xxhash import xxh3_64_intdigest

    h = rolling_hash(np.frombuffer(raw, np.uint8), gram)
    at, first, last = window_runs(h, length - gram + 1)
    context = [xxh3_64_intdigest(raw[a:b], p - a) for p, a, b in zip(at.tolist(), first.tolist(), (last + length).tolist(), strict=True)]
    return h[at].view(np.int64), np.array(context, np.uint64).view(np.int64), at, at - first, last + length - at


def anchors(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows of kind 'a': a context and how often the document has it; of kind 's': spans that the document repeats itself."""

    def build():
        def work(cols):
            out: list[tuple[np.ndarray, ...]] = []
            kinds: list[str] = []
            for i, x, text in zip(cols["id"], cols["x"], cols["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                h, c, at, head, tail = anchors_of(raw, length, gram)
                # a context is told by both hashes together
                _, first, slot, n = np.unique(h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + c.view(np.uint64), return_index=True, return_inverse=True, return_counts=True)
                m = len(first)
                out.append((h[first], c[first], np.full(m, i), np.full(m, x), at[first], head[first], tail[first], n))
                kinds += ["a"] * m
                twice = np.flatnonzero(n[slot] > 1)
                if len(twice):
                    spans = merge(list(zip((at - head)[twice].tolist(), (at + tail)[twice].tolist(), strict=True)))
                    z = np.zeros(len(spans), np.int64)
                    start, stop = np.array(spans).T
                    out.append((z, z, z + i, z + x, start, z, stop - start, z))
                    kinds += ["s"] * len(spans)
            cols = zip(*out, strict=True) if out else [()] * 8
            flat = [np.concatenate([np.zeros(0, np.int64), *c]) for c in cols]
            names = ("h", "c", "id", "x", "pos", "head", "tail", "n")
            return {"kind": kinds} | {k: v.astype(np.int32) if k in ("head", "tail", "n") else v for k, v in zip(names, flat, strict=True)}

        return work

    return map_rows(keyed, build, ANCHORS)


def around_cores(context: bytes, head: int, length: int) -> Iterator[tuple[bytes, int, bytes]]:
    """(core's symbol, offset of the first string, text with the symbol for the core).

    Strings that begin t bytes before the anchor (which is ``head`` bytes into the context) with
    equal t // SHARE share a core of ``length - SHARE + 1`` bytes. In the text each of them is a
    string of ``SHARE - 1 + SYMBOL`` bytes.
    """
    from xxhash import xxh3_64_digest

    last = len(context) - length
    for j in range((head - min(head, last)) // SHARE, head // SHARE + 1):
        least, most = head - (j + 1) * SHARE + 1, head - j * SHARE  # of all strings with this core, here or not
        symbol = xxh3_64_digest(context[most : least + length], j)
        first = max(least, 0)
        yield symbol, first, context[first:most] + symbol + context[least + length : min(most, last) + length]


def _task_spans(length: int):
    """Spans of the contexts of one task that are not yet known to be repeated."""
    schema = pa.schema([(k, pa.int64()) for k in ("id", "x", "start", "stop")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[bytes, dict[bytes, list[int]]] = {}  # by core: the texts around it and the places of each
        owners: list[tuple[int, int, int, bool]] = []  # of each context around a core
        docs: dict[tuple[int, int], int] = {}
        for b in batches:
            for row in b.to_pylist():
                doc = docs.setdefault((row["id"], row["x"]), len(docs))
                for symbol, first, text in around_cores(row["context"], row["head"], length):
                    texts.setdefault(symbol, {}).setdefault(text, []).append(len(owners))
                    owners.append((doc, row["start"] + first, row["single"]))
        hits: list[tuple[int, int, int]] = []
        parts: list[bytes] = []
        of_part: list[int] = []
        short = SHARE - 1 + SYMBOL
        for around in texts.values():
            for text, own in around.items():
                if len({owners[i][:2] for i in own}) > 1:  # these stand at several places
                    hits += [(owners[i][0], owners[i][1], len(text) - short) for i in own if owners[i][2]]
                if len(around) > 1:
                    parts.append(text)
                    of_part.append(own[0])
        if parts:
            sizes = np.array([len(t) for t in parts])
            ends = np.cumsum(sizes)
            places = np.repeat([(owners[i][0] << 40) + owners[i][1] for i in of_part], sizes) + np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
            flags = repeated_starts(parts, places, short)
            for i, at, size in zip(of_part, (ends - sizes).tolist(), sizes.tolist(), strict=True):
                if owners[i][2]:
                    hits += [(owners[i][0], owners[i][1] + int(o), 0) for o in np.flatnonzero(flags[at : at + size])]
        names = list(docs)
        by_doc: dict[int, list[tuple[int, int]]] = {}
        for doc, start, more in hits:
            by_doc.setdefault(doc, []).append((start, start + more + length))
        rows = np.array([(*names[doc], a, b) for doc, spans in by_doc.items() for a, b in merge(spans)], np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(4)], schema=schema)

    return run


BLOCKS = "h long, core long, q long, id long, x long, start long, more int, single boolean, text binary"


def _blocks(contexts: DataFrame, length: int) -> DataFrame:
    """The contexts of hot anchors, core by core: ``q`` is the hash of the text around the core."""
    from xxhash import xxh3_64_intdigest

    def build():
        def work(cols):
            out: dict[str, list] = {k: [] for k in ("h", "core", "q", "id", "x", "start", "more", "single", "text")}
            for h, i, x, start, head, single, context in zip(*(cols[k] for k in ("h", "id", "x", "start", "head", "single", "context")), strict=True):
                for symbol, first, text in around_cores(context, head, length):
                    q = xxh3_64_intdigest(text) - (1 << 63)
                    for k, v in zip(out, (h, int.from_bytes(symbol, "big", signed=True), q, i, x, start + first, len(text) - SHARE + 1 - SYMBOL, single, text), strict=True):
                        out[k].append(v)
            return out

        return work

    return map_rows(contexts, build, BLOCKS, rows=256)


def _strings(blocks: DataFrame) -> DataFrame:
    """Every string around a core: ``h, core, w`` (its hash), ``id, x, at, single``."""

    def build():
        def work(cols):
            hashes = [rolling_hash(np.frombuffer(t, np.uint8), SHARE - 1 + SYMBOL) for t in cols["text"]]
            sizes = np.array([len(h) for h in hashes], np.int64)
            own = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            spread = {k: np.repeat(np.array(cols[k], bool if k == "single" else np.int64), sizes) for k in ("h", "core", "id", "x", "start", "single")}
            return {"w": np.concatenate([np.zeros(0, np.uint64), *hashes]).view(np.int64), "at": spread["start"] + own} | spread

        return work

    return map_rows(blocks, build, "h long, core long, w long, id long, x long, at long, single boolean", rows=1024)


def hot_spans(contexts: DataFrame, length: int, put: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Spans of the contexts of anchors with very many of them, by counting keys; no key's rows meet in a task. ``put`` stages."""
    place = F.struct("id", "x", "start")
    blocks = put(_blocks(contexts, length), "blocks")
    around = put(blocks.groupBy("h", "core", "q").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count_if("single").alias("singles")), "around")
    copied = blocks.where("single").join(around.where("a <> b").select("h", "core", "q"), ["h", "core", "q"], "left_semi")
    whole = copied.select("id", "x", "start", (F.col("start") + F.col("more") + length).alias("stop"))
    differ = around.groupBy("h", "core").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h", "core")
    edges = blocks.join(around.where("a = b").select("h", "core", "q"), ["h", "core", "q"], "left_semi").unionByName(
        blocks.join(around.where("a <> b").select("h", "core", "q", F.col("a.id").alias("id"), F.col("a.x").alias("x"), F.col("a.start").alias("start")), ["h", "core", "q", "id", "x", "start"], "left_semi").withColumn("single", F.lit(False))
    )
    strings = put(_strings(edges.join(differ, ["h", "core"], "left_semi")), "strings")
    at = F.struct("id", "x", "at")
    many = strings.groupBy("h", "core", "w").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a <> b").select("h", "core", "w")
    counted = strings.where("single").join(many, ["h", "core", "w"], "left_semi").select("id", "x", F.col("at").alias("start"), (F.col("at") + length).alias("stop"))
    return whole.unionByName(counted)


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``id, x, start, stop``: spans that cover exactly the bytes of repeated strings; spans may overlap."""
    spark = keyed.sparkSession

    def build():
        def work(cols):
            out: dict[str, list] = {k: [] for k in ("h", "m", "id", "x", "start", "head", "single", "context")}
            for i, x, text, wanted in zip(cols["id"], cols["x"], cols["text"], cols["wanted"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    start = w["pos"] - w["head"]
                    for k, v in zip(out, (w["h"], w["m"], i, x, start, w["head"], w["single"], raw[start : w["pos"] + w["tail"]]), strict=True):
                        out[k].append(v)
            return out

        return work

    with scratch(spark) as put:
        found = put(anchors(keyed, length, gram), "anchors")
        rows = found.where("kind = 'a'").drop("kind")
        within = found.where("kind = 's'").select("id", "x", F.col("pos").alias("start"), (F.col("pos") + F.col("tail")).alias("stop"))
        contexts = rows.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min(F.struct("id", "x", "pos", "head", "tail")).alias("one"))
        copied = rows.join(contexts.where("n > 1").select("h", "c"), ["h", "c"], "left_semi").where(F.col("head") + F.col("tail") >= length)
        spans = within.unionByName(copied.select("id", "x", (F.col("pos") - F.col("head")).alias("start"), (F.col("pos") + F.col("tail")).alias("stop")))

        several = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("n") == 1).alias("singles")).where("m > 1 and singles > 0").drop("singles")
        mixed = put(contexts.join(several, "h").select("h", "m", (F.col("n") == 1).alias("single"), "one.*").where(F.col("head") + F.col("tail") >= length), "contexts")
        wanted = mixed.groupBy("id", "x").agg(F.collect_list(F.struct("h", "m", "single", "pos", "head", "tail")).alias("wanted"))
        # equal rows (same id, same text) come twice here, at one place
        texts = keyed.join(wanted, ["id", "x"]).select("id", "x", "text", "wanted")
        pieces = put(map_rows(texts, build, "h long, m long, id long, x long, start long, head int, single boolean, context binary", rows=64), "pieces")
        small = pieces.where(F.col("m") <= HOT)
        size = small.agg(F.sum(F.octet_length("context"))).first()[0] or 0
        tasks = max(partitions(spark), -(-size // TASK_BYTES))
        expanded = small.repartition(tasks, "h").select("id", "x", "start", "head", "single", "context").mapInArrow(_task_spans(length), SPANS)
        # written one by one, so that the shuffles of one are gone before those of the next
        done = [staged(part, "spans", tidy=True) for part in (spans, expanded, hot_spans(pieces.where(F.col("m") > HOT), length, put))]
    return done[0].unionByName(done[1]).unionByName(done[2])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = WORDS) -> DataFrame:
    """``doc_id, n_bytes, spans, kept, shared_passage``: the removed runs (start, stop) and the bytes left of every document.

    Removed is each byte covered by a string of ``length`` bytes that also starts anywhere else in
    the input, the same document included; strings never cross documents. Null text counts as
    empty; texts shorter than the length keep everything. Repeated rows (same id, same text) are
    copies of each other. Rows with a null id come back with a null id. Other columns are not
    read. An empty table gives an empty one.

    ``shared_passage`` is 1 where the text holds a passage of ``words`` words that another document
    holds too (:mod:`.passages`), removed or not: such a passage may be shorter than ``length`` bytes.
    """
    keyed = _keyed(docs)
    shared = shared_passages(keyed, words).select("x", F.lit(1).alias("shared_passage"))
    spans = repeated_spans(keyed, length, gram)
    of_doc = spans.groupBy("id", "x").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def build():
        def work(cols):
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "spans", "kept")} | {"shared_passage": cols["shared_passage"]}
            for i, text, spans in zip(cols["id"], cols["text"], cols["spans"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                runs = merge([(s["start"], s["stop"]) for s in spans or ()])
                cuts = [0, *(x for run in runs for x in run), len(raw)]
                for k, v in zip(("doc_id", "n_bytes", "spans", "kept"), (None if i == -(1 << 63) else i, len(raw), [{"start": a, "stop": b} for a, b in runs], b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))), strict=True):
                    out[k].append(v)
            return out

        return work

    marks = keyed.select("id", "x").join(shared, "x").distinct()  # rows without texts
    joined = keyed.join(of_doc.join(marks, ["id", "x"], "full"), ["id", "x"], "left")
    joined = joined.select("id", "text", "spans", F.coalesce("shared_passage", F.lit(0)).alias("shared_passage"))
    return map_rows(joined, build, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary, shared_passage int", rows=64)


def removal_digest(kept: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, shared_passage`` of :func:`remove_repeats`."""
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "shared_passage")
