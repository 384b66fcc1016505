"""Groups of documents alike by Jaccard of word shingles: SimHash and BK-trees find, exact shingles decide.

A SimHash radius that reaches a similarity of 0.8 (about 9 bits of 64 on average, up to 20) leaves
no blocks that select, so the shards are of shingles: with all shingles in one order, rare ones
first, two sets of Jaccard >= 4/5 share one of their first n - ceil(4n/5) + 1 shingles. Their first
common shingle also stands so far ahead that what follows it suffices for the overlap, and in the
smaller set within its first n / 9 (a set that has the shard's shingle there *leads*). Both hold without
exception, so no pair is lost by sharding, and by looking only at pairs of which one set leads: of a
family of texts that are less alike than that, none leads in the shards of what they have in common,
since what is their own is rarer and comes first. In the shards:

1. every text is held against one text of each of its shards (another one in each), which takes
   time linear in the shards; what links is joined to components;
2. texts of a shard that are in different components by then meet a BK-tree over the SimHash of the
   shard's texts (of its leading texts alone, if they do not lead). A large shard is cut into trees of
   bounded size, and the texts outside its largest component are sent to each of them. What a tree
   gives is sifted as it comes. Of each two components the nearest few pairs are tested first, and
   more of them only where those fail.

Before its exact Jaccard is taken, a pair has to pass SimHash and a parity sketch: one bit for an
odd number of shingles in a bucket. Two sketches differ in no more bits than the sets differ in
shingles, so that test loses nothing either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, partitions, staged
from ._words import BASE, Words
from .simhash import BKTree, connected_components

#: Words in a shingle; least Jaccard as a fraction; bits that SimHash of such a pair may differ in.
SHINGLE, NUMERATOR, DENOMINATOR, RADIUS = 5, 4, 5, 24
#: Buckets that shingles are counted in for the order (any order gives the same links; a good one gives small shards).
BUCKETS = 1 << 18
#: Shingles to a 64-bit word of a sketch; texts in a tree; pairs of two components that are tested at first.
SHINGLES_A_WORD, TREE, NEAREST = 64, 4096, 4
#: Rows of shards that a task holds, about; pairs that are sifted at a time.
ROWS_A_TASK, SIFTED = 500_000, 1 << 19
#: Pairs whose sets are picked out by a broadcast of their ids (16 bytes a pair); more are joined by shuffles.
FEW_PAIRS = 100_000


def text_hash(text: str = "text") -> Column:
    """64-bit hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def shingles(texts: list[str | None], words_in: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row starts, hashes): each text's distinct shingles as 64-bit hashes, sorted.

    Lower-cases A-Z only; fewer words than a shingle: the whole sequence; no word (or null): none.
    """
    words = Words([(t or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") for t in texts], plain=False)
    first = np.cumsum(words.counts) - words.counts
    docs, hashes = [], []
    for n in range(1, words_in + 1):
        if n < words_in:
            doc = np.flatnonzero(words.counts == n)
            at = first[doc]
        else:
            at = np.flatnonzero(words.doc[: max(0, len(words.doc) - n + 1)] == words.doc[n - 1 :])
            doc = words.doc[at]
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = h * np.uint64(BASE) + words.hashes[at + i]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
        docs.append(doc)
        hashes.append(h ^ (h >> np.uint64(29)))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]
    return np.r_[0, np.cumsum(np.bincount(doc[new], minlength=len(texts)))], h[new]


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of distinct shingles: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((ones * 2 > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each bucket, as 64-bit words; their number is a power of two.

    The sketch of half as many buckets is one half of it XOR the other, so sketches of different
    length can be compared.
    """
    words = 1 << max(0, (-(-len(hashes) // SHINGLES_A_WORD) - 1).bit_length())
    bucket, n = np.unique(hashes & np.uint64(words * 64 - 1), return_counts=True)
    bits = np.zeros(words * 64, np.uint8)
    bits[bucket[n % 2 == 1].astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<u8").astype(np.uint64)


def _set_hash(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.astype("<u8").tobytes(), 42)


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def _counts(docs: DataFrame, words_in: int) -> np.ndarray:
    """How often a bucket's shingles are in the texts; ``BUCKETS`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                h = shingles(batch.column(0).slice(at, 64).to_pylist(), words_in)[1]
                counts += np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    got = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def _prints(docs: DataFrame, words_in: int, shared) -> DataFrame:
    """``doc_id, text_hash, set, n, keys``: the hash of the shingle set, its size and, once for each set and task, its first shingles in order."""

    def build():
        counts, done = shared.value, set()

        def first(own: np.ndarray, name: int) -> np.ndarray:
            if name in done or not len(own):
                return own[:0]
            done.add(name)
            return own[np.lexsort((own, counts[(own % np.uint64(BUCKETS)).astype(np.int64)]))[: prefix_length(len(own))]]

        def work(cols):
            starts, h = shingles(cols["text"], words_in)
            own = np.split(h, starts[1:-1])
            names = [_set_hash(o) for o in own]
            return {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"], "set": np.array(names, np.uint64).view(np.int64), "n": np.diff(starts), "keys": [first(o, n).view(np.int64) for o, n in zip(own, names, strict=True)]}

        return work

    return map_rows(docs, build, "doc_id long, text_hash long, set long, n long, keys array<long>", rows=64)


def _with_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (key, set) of keys with more than one set of which one leads, with a leading set of the key (another one for each key); a task holds all rows of its keys."""
    parts = [[b.column(c).to_numpy() for c in ("key", "set", "place", "n")] for b in batches if b.num_rows]
    if not parts:
        return
    key, own, place, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
    leads = place * (DENOMINATOR + NUMERATOR) <= n * (DENOMINATOR - NUMERATOR)
    by = (key.view(np.uint64) ^ own.view(np.uint64)) * np.uint64(BASE)
    order = np.lexsort((own, by, ~leads, key))
    key, own, place, leads = key[order], own[order], place[order], leads[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]
    key, own, place, leads = key[new], own[new], place[new], leads[new]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    hub, shared = np.repeat(own[starts], sizes), np.repeat((sizes > 1) & leads[starts], sizes)
    yield pa.RecordBatch.from_arrays([pa.array(x[shared]) for x in (key, own, hub, place, leads)], names=["key", "set", "hub", "place", "leads"])


def _differing(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ; the longer one is folded to the length of the other."""
    size = F.least(F.size(a), F.size(b))
    half = lambda x: F.when(F.size(x) > size, F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q))).otherwise(x)
    return F.aggregate(F.zip_with(half(a), half(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, x: n + x)


def _passing(pairs: DataFrame, sets: DataFrame, radius: int) -> DataFrame:
    """Those of ``u, v`` (distinct) that sizes, SimHash and sketches let pass."""
    of = lambda c: sets.select(F.col("set").alias(c), F.col("fp").alias(f"fp_{c}"), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")).hint("merge")
    alike = F.least("n_u", "n_v") * DENOMINATOR >= F.greatest("n_u", "n_v") * NUMERATOR
    near = F.bit_count(F.col("fp_u").bitwiseXOR(F.col("fp_v"))) <= radius
    few = _differing(F.col("s_u"), F.col("s_v")) * (DENOMINATOR + NUMERATOR) <= (F.col("n_u") + F.col("n_v")) * (DENOMINATOR - NUMERATOR)
    return pairs.join(of("u"), "u").join(of("v"), "v").where(alike & near & few).select("u", "v")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``u, v`` (distinct, written) whose Jaccard is high enough.

    Shingles are told apart by 32 bits here, which halves what is shuffled: of two texts of n shingles
    with a chance of n^2 / 2^32 one shingle too many counts as common.
    """
    hashes = sets.select("set", "hashes")
    if pairs.count() <= FEW_PAIRS:
        hashes = hashes.join(F.broadcast(pairs.select(F.explode(F.array("u", "v")).alias("set")).distinct()), "set", "left_semi")
    for c in ("u", "v"):
        pairs = pairs.join(hashes.select(F.col("set").alias(c), F.col("hashes").alias(f"h_{c}")).hint("merge"), c)
    both = F.size(F.array_intersect("h_u", "h_v"))
    return pairs.withColumn("both", both).where(F.col("both") * DENOMINATOR >= (F.size("h_u") + F.size("h_v") - F.col("both")) * NUMERATOR).select("u", "v")


def _spread(shards: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """``key, part, set, root, place, leads, fp, n, sketch, asks, held``: shards of several components, cut into parts.

    A text is held by one part of its shard. It asks all parts, unless it is of the shard's largest
    component: of two texts in different components one at least asks.
    """
    own = shards.select("key", "set", "place", "leads").join(roots.select(F.col("node").alias("set"), "root").hint("merge"), "set", "left").select("key", "set", "place", "leads", F.coalesce("root", "set").alias("root"))
    own = staged(own, "roots")
    sizes = own.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("texts"), F.max(F.struct("n", "root"))["root"].alias("top"), F.count(F.lit(1)).alias("roots"))
    split = own.join(sizes.where("roots > 1").drop("roots").hint("merge"), "key")
    parts = F.ceil(F.col("texts") / TREE).cast("int")
    home = F.pmod(F.xxhash64("set"), parts).cast("int")
    rows = split.withColumn("asks", F.col("root") != F.col("top")).withColumn("home", home)
    rows = rows.withColumn("part", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array("home"))))
    return rows.join(sets.select("set", "fp", "n", "sketch").hint("merge"), "set").select("key", "part", "set", "root", "place", "leads", "fp", "n", "sketch", "asks", (F.col("part") == F.col("home")).alias("held"))


def _apart(radius: int, nearest: int):
    """Pairs of texts of one part and different components that may be alike, with their ``key``: of two components the ``nearest`` ones; ``more``: there were more."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("more", pa.bool_()), ("key", pa.int64())])

    def sifted(a: np.ndarray, b: np.ndarray, root: np.ndarray, place: np.ndarray, n: np.ndarray, sketches: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Pairs of different components that sizes, places of the shard's shingle and sketches let pass, and bits of the sketches in which they differ."""
        whole = n[a] + n[b]
        apart = (root[a] != root[b]) & (np.minimum(n[a], n[b]) * DENOMINATOR >= np.maximum(n[a], n[b]) * NUMERATOR)
        apart &= np.minimum(n[a] - place[a], n[b] - place[b]) * (DENOMINATOR + NUMERATOR) >= whole * NUMERATOR
        a, b, whole = a[apart], b[apart], whole[apart]
        differ = np.zeros(len(a), np.int64)
        size = np.array([len(s) for s in sketches])
        both = np.minimum(size[a], size[b])
        for words in np.unique(both).tolist():
            of = np.flatnonzero(both == words)
            folded = {}
            for i in np.unique(np.r_[a[of], b[of]]).tolist():
                s = sketches[i]
                folded[i] = s if len(s) == words else s[:words] ^ s[words:]
            at = {i: k for k, i in enumerate(folded)}
            table = np.stack(list(folded.values()))
            slot = np.zeros(len(sketches), np.int64)
            slot[list(at)] = list(at.values())
            step = max(1, (1 << 20) // words)
            for i in range(0, len(of), step):
                part = of[i : i + step]
                differ[part] = np.bitwise_count(table[slot[a[part]]] ^ table[slot[b[part]]]).sum(1)
        few = differ * (DENOMINATOR + NUMERATOR) <= whole * (DENOMINATOR - NUMERATOR)
        return a[few], b[few], differ[few]

    def pairs(own: np.ndarray, root: np.ndarray, place: np.ndarray, leads: np.ndarray, fp: np.ndarray, n: np.ndarray, sketches: list[np.ndarray], asks: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, ...]:
        kept, open_, waiting = [], [], 0

        def sift() -> None:
            a, b = (np.concatenate(x) for x in zip(*open_, strict=True))
            kept.append(sifted(a, b, root, place, n, sketches))
            open_.clear()

        # leading texts ask all, the others the leading ones
        for known, asking in ((np.flatnonzero(held), np.flatnonzero(asks & leads)), (np.flatnonzero(held & leads), np.flatnonzero(asks & ~leads))):
            if not len(known) or not len(asking):
                continue
            for m, q in BKTree(fp[known]).search(radius, fp[asking]):
                if len(q):
                    open_.append((np.full(len(q), known[m]), asking[q]))
                    waiting += len(q)
                    if waiting >= SIFTED:
                        sift()
                        waiting = 0
        if open_:
            sift()
        a, b, differ = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else [np.zeros(0, np.int64)] * 3
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        order = np.lexsort((differ, high, low))
        a, b, low, high = a[order], b[order], low[order], high[order]
        starts = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])][: len(a)])
        sizes = np.diff(np.r_[starts, len(a)])
        rank = np.arange(len(a)) - np.repeat(starts, sizes)
        kept = rank < nearest
        return np.minimum(own[a], own[b])[kept], np.maximum(own[a], own[b])[kept], np.repeat(sizes > nearest, sizes)[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        whole = pa.Table.from_batches(rows)
        key, part, own, root, place, leads, fp, n, asks, held = (whole[c].to_numpy() for c in ("key", "part", "set", "root", "place", "leads", "fp", "n", "asks", "held"))
        words = whole["sketch"].combine_chunks()
        flat, ends = words.flatten().to_numpy().view(np.uint64), np.cumsum(np.diff(words.offsets.to_numpy()))
        order = np.lexsort((part, key))
        starts = np.flatnonzero(np.r_[True, (key[order][1:] != key[order][:-1]) | (part[order][1:] != part[order][:-1])])
        begins = np.r_[0, ends[:-1]]
        out = []
        for a, b in zip(starts.tolist(), np.r_[starts[1:], len(order)].tolist(), strict=True):
            i = order[a:b]
            if b - a > 1 and asks[i].any() and held[i].any():
                u, v, more = pairs(own[i], root[i], place[i], leads[i], fp[i].view(np.uint64), n[i], [flat[begins[k] : ends[k]] for k in i.tolist()], asks[i], held[i])
                out.append((u, v, more, np.full(len(u), key[i[0]])))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, t.type.to_pandas_dtype()) for t in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)

    return run


def groups(docs: DataFrame, words_in: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, text_hash, component``, one row a document.

    Documents are of one component if they are linked, directly or by others: Jaccard of their
    distinct shingles >= 4/5 (and SimHash within ``radius``), or the same shingles. Null and blank
    texts have no shingle and are one component. ``text_hash`` is that of ``text_hash()``; null
    doc_ids and repeated rows keep their rows. Other columns are not read. An empty table gives
    an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(_counts(docs, words_in))
    prints = staged(_prints(docs, words_in, shared), "prints")
    shared.destroy()
    rows = prints.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    tasks = max(2 * partitions(spark), rows // ROWS_A_TASK)
    met = prints.select("set", "n", F.posexplode("keys").alias("place", "key")).select("key", "set", F.col("place").cast("long").alias("place"), "n")
    shards = staged(met.repartition(tasks, "key").mapInArrow(_with_hub, "key long, set long, hub long, place long, leads boolean"), "shards")

    def build():
        def work(cols):
            starts, h = shingles(cols["text"], words_in)
            own = np.split(h, starts[1:-1])
            return {"set": cols["set"], "fp": np.array([fingerprint(o) for o in own], np.uint64).view(np.int64), "n": np.diff(starts), "sketch": [sketch(o).view(np.int64) for o in own], "hashes": [(o >> np.uint64(32)).astype(np.uint32).view(np.int32) for o in own]}

        return work

    # one text of each set that meets another one
    one = prints.groupBy("set").agg(F.min("text_hash").alias("text_hash")).join(shards.select("set").distinct().hint("merge"), "set", "left_semi")
    texts = docs.select("text_hash", "text").join(one.hint("merge"), "text_hash").groupBy("text_hash").agg(F.first("set").alias("set"), F.first("text").alias("text")).select("set", "text")
    sets = staged(map_rows(texts, build, "set long, fp long, n long, sketch array<long>, hashes array<int>", rows=64), "sets")

    pairs = shards.where("set <> hub").select(F.least("set", "hub").alias("u"), F.greatest("set", "hub").alias("v")).distinct()
    links = staged(_confirmed(staged(_passing(pairs, sets, radius), "passing"), sets), "confirmed")
    roots = connected_components(links)
    nearest = NEAREST
    while True:
        spread = _spread(shards, roots, sets).repartition(tasks, "key", "part")
        found = staged(spread.mapInArrow(_apart(radius, nearest), "u long, v long, more boolean, key long"), "apart")
        more = staged(_confirmed(staged(found.select("u", "v").distinct(), "asked"), sets), "confirmed")
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = connected_components(links)
        # shards with pairs of components that had more pairs than were tested, and are still two; in the others all are tested
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")).hint("merge")
        apart = found.where("more").join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v"))
        open_ = staged(apart.select("key").distinct(), "open")
        if open_.isEmpty():
            break
        shards = shards.join(open_.hint("merge"), "key", "left_semi")
        nearest *= 16
    return prints.select("doc_id", "text_hash", "set").join(roots.select(F.col("node").alias("set"), "root").hint("merge"), "set", "left").select("doc_id", "text_hash", F.coalesce("root", "set").alias("component"))
