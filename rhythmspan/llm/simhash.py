"""Near-duplicates by SimHash: BK-trees over shards of fingerprints, then connected components.

Two 64-bit fingerprints that differ in at most 4 bits agree on at least two of six blocks, so
every pair of blocks (15 of them, 20 to 22 bits) shards the distinct fingerprints; a linked pair
meets in at least one shard. In each shard a BK-tree is built (children keyed by their Hamming
distance to the parent) and all its members are searched at once, following only the edges
within the radius. A shard returns a spanning forest of its links, never all its pairs.
Equal fingerprints are one row before any of this, so copies cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, partitions, staged

RADIUS = 4
SHINGLE = 4
#: Bits of the blocks; radius + 2 blocks, two of which agree.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Rows (16 to 32 bytes) that one task writes, about.
ROWS_A_TASK = 1 << 20


def fingerprint(text: str | None, words_in: int = SHINGLE) -> int:
    """SimHash of the word shingles: a bit is 1 if it is set in over half of the shingles' XXH64.

    Lower-cases A-Z only; fewer words than a shingle: the whole sequence; no word (or null): 0.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n < words_in:
        spans = [(0, len(joined))]
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        spans = zip((ends - lengths)[: n - words_in + 1].tolist(), ends[words_in - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((ones * 2 > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, words_in: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed LONG."""

    def build():
        def work(cols):
            fp = np.array([fingerprint(t, words_in) for t in cols["text"]], np.uint64)
            return {"doc_id": cols["doc_id"], "fp": fp.view(np.int64)}

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), build, "doc_id long, fp long")


class BKTree:
    """A BK-tree over distinct 64-bit values, searched by many queries at once.

    A node is (value, {Hamming distance: child}); ``leaf`` values or fewer stay in a flat node.
    """

    leaf = 24

    def __init__(self, values: np.ndarray):
        self.values = values
        self.root = self._node(np.arange(len(values)))

    def _node(self, members: np.ndarray):
        if len(members) <= self.leaf:
            return members, None
        pivot, rest = members[0], members[1:]
        to = np.bitwise_count(self.values[rest] ^ self.values[pivot])
        return int(pivot), {int(edge): self._node(rest[to == edge]) for edge in np.unique(to)}

    def search(self, radius: int, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(index of a value, indices of the queries within the radius of it), following only edges within the radius."""
        v, stack = self.values, [(self.root, np.arange(len(queries)))]
        while stack:
            (own, children), asked = stack.pop()
            if children is None:
                for at in range(0, len(asked), 1 << 16):
                    part = asked[at : at + (1 << 16)]
                    near = np.bitwise_count(v[own][:, None] ^ queries[part][None, :]) <= radius
                    for i in np.flatnonzero(near.any(axis=1)).tolist():
                        yield int(own[i]), part[near[i]]
                continue
            d = np.bitwise_count(queries[asked] ^ v[own]).astype(np.int16)
            yield own, asked[d <= radius]
            for edge, child in children.items():
                followed = asked[np.abs(d - edge) <= radius]
                if len(followed):
                    stack.append((child, followed))


def shard_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest (index pairs) of the links between distinct values."""
    label = np.arange(len(values))
    links = []
    for p, near in BKTree(values).search(radius, values):
        if len(near) < 2:
            continue
        labels, first = np.unique(label[near], return_index=True)
        other = labels != label[p]
        if other.any():
            links += [(p, int(near[i])) for i in first[other]]
            least = min(int(labels.min()), int(label[p]))
            label[np.isin(label, labels) | (label == label[p])] = least
    return links


def _links_of_partition(radius: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        key, fp = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order].view(np.uint64)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        two = starts[sizes == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        u, v = [fp[near]], [fp[near + 1]]
        for at, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            values = fp[at : at + size]
            if links := shard_links(values, radius):
                i, j = np.array(links).T
                u.append(values[i])
                v.append(values[j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], schema=schema)

    return run


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``u, v`` that connect all fingerprints (``fp``, distinct) within the radius."""
    if radius > len(BLOCKS) - 2:
        raise ValueError("the blocks find links of at most 4 bits")
    ends = np.cumsum(BLOCKS).tolist()
    block = [F.shiftrightunsigned(F.col("fp"), end - bits).bitwiseAND((1 << bits) - 1) for bits, end in zip(BLOCKS, ends, strict=True)]
    pairs = [(i, j) for i in range(len(BLOCKS)) for j in range(i)]
    keys = [F.lit(t << 22) + F.shiftleft(block[i], 11) + block[j] for t, (i, j) in enumerate(pairs)]
    shards = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")
    # one task holds some hundred thousand rows of 16 bytes
    return shards.repartition(2 * partitions(distinct.sparkSession), "key").mapInArrow(_links_of_partition(radius), "u long, v long").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars: each node with the least node it reaches by them."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    nodes, index = np.unique(np.r_[u, v], return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    root = np.arange(len(nodes))
    while True:  # hand the lesser root to the greater one, then shorten all ways
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["u", "v"])


def _thin(df: DataFrame, rows: int) -> DataFrame:
    """Dealt by the number of rows (about that many) and not by that of shuffle partitions.

    A small table in hundreds of files costs more than its rows: without Hadoop's native library a
    local folder starts processes for each file, beside the executor's own.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))


def connected_components(links: DataFrame, most: int | None = None) -> DataFrame:
    """``node, root``: the least node of each node's component, for all nodes that have a link.

    Edges are first turned into stars within each task. Then large stars (hand higher neighbours
    to the least one) and small stars (hand lower ones) alternate until no link changes. Every
    round is a table in the shared folder; its joins are not broadcast. ``most``: there are no
    more links than that; without it they are counted, which reads them twice.
    """
    stars = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(_forest, "u long, v long")
    edges = staged(_thin(stars.distinct(), links.count() if most is None else most), "links")
    state = lambda: edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = staged(_thin(small, before[0]), "links")
        now = state()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words_in: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row a document.

    ``component_id`` is the least doc_id reachable over links of at most ``radius`` bits. Null and
    blank texts have fingerprint zero and are linked like any other. Rows with a null doc_id keep
    their row and never name a component unless they are alone in it. Repeated rows stay. Other
    columns are not read. An empty table gives an empty one.
    """
    prints = staged(fingerprints(docs, words_in), "fingerprints")
    rows = prints.count()
    distinct = staged(_thin(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), rows), "distinct")
    # a shard's forest has fewer links than members
    roots = connected_components(fingerprint_links(distinct, radius), math.comb(len(BLOCKS), 2) * distinct.count())
    linked = roots.join(distinct.withColumnRenamed("fp", "node"), "node")
    named = linked.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    # prints without a link have no root: they never meet on that key
    of_node = roots.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    of_print = distinct.join(of_node, "fp", "left").select("fp", F.coalesce("component_id", "first_doc").alias("component_id"))
    return _thin(prints.join(of_print, "fp"), rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
