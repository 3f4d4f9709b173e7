"""Near-duplicate documents by chosen-path set similarity join.

A document's set holds its distinct shingles of five words. Sets are brought
together by branching trees: a tree's root node is split by one minwise token
(the shingle with the smallest hash under a random function), so that two sets
of similarity J land in one child with probability J. A node of at most
``leaf`` sets is compared exhaustively; a larger one is split again by two
further minwise tokens, each choosing its own branch, so that a similar pair
stays together in one of them with probability 1 - (1 - J)^2. Every tree has
tokens of its own for each level, so that trees are independent; they are
repeated until the miss probability of a pair at the threshold is below ``miss``
even if all its nodes are split to the last level. Nodes that stay large to the last level hold sets that really
are alike; they are compared exhaustively in blocks, each pair of blocks in its
own task.

Links are confirmed on full sets, which are built again from the texts of a
node. A node's task gives back a spanning forest of its links, not the pairs,
and the forests' connected components are the groups. Documents with equal sets
are one set from the start. Only ids, sizes and sketches are shuffled for the
trees; texts move compressed, once by document and once for each node.

Defined cases: a text without words or null has the empty set and is linked
with nothing; fewer than five words make one shingle; a null id is in no group
(its component is null, it is kept); rows with one id are one document, their
components are the same; an empty table gives no rows; extra columns are not
carried by :func:`groups` and pass through :func:`keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, write_table
from . import words as WD
from .components import components

SHINGLE = 5
PERCENT = 85  # links: 100 * intersection >= PERCENT * union
MISS = 1e-8  # of a pair at the threshold, over all trees
BRANCHES = 2
LEVELS = 4
LEAF = 2048  # sets of a node compared in one task
LEAF_SHINGLES = 1_500_000  # and their shingles


def n_trees(percent: int = PERCENT, miss: float = MISS) -> int:
    """Trees until a pair at the threshold is missed with probability
    ``miss``, if it has to stay together through every level."""
    j = percent / 100
    found = j * (1 - (1 - j) ** BRANCHES) ** (LEVELS - 1)
    return max(1, math.ceil(math.log(miss) / math.log(1 - found))) if found < 1 else 1


def n_deep(trees: int, levels: int = LEVELS) -> int:
    """Minwise tokens of a set for the branches of all trees at their deeper levels."""
    return trees * (levels - 1) * BRANCHES


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    starts, ends, first = WD.word_bounds(data, offsets)
    words = WD.word_hashes(data, starts, ends, lower=True)
    prefix = WD.prefix_hashes(words)
    at = np.arange(max(0, len(words) - k + 1))
    grams = WD.range_hashes(prefix, at, at + k)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= k:
            out.append(np.unique(grams[lo:hi - k + 1]))
        else:
            out.append(WD.range_hashes(prefix, np.array([lo]), np.array([hi])) if hi > lo else grams[:0])
    return out


def _lists(tokens: np.ndarray, size: int) -> pa.ListArray:
    """Rows of tokens, cut to a number of bytes: equal tokens stay equal, others rarely become so."""
    values = tokens.astype(f"u{size}", order="C").view(f"i{size}").reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * tokens.shape[1]), pa.array(values))


def _sketch(k: int, trees: int):
    n = trees + n_deep(trees)
    factors = WD.mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets in WD.text_slices(batch.column(1)):
                sets = shingle_sets(data, offsets, k)
                size = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(size)
                sums = np.zeros((2, len(sets)), dtype=np.uint64)
                low = np.zeros((len(sets), n), dtype=np.uint64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    begin = np.cumsum(size[full]) - size[full]
                    for row, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                        sums[row, full] = np.add.reduceat(WD.mix(flat ^ np.uint64(salt)), begin)
                    for j, factor in enumerate(factors):
                        low[full, j] = np.minimum.reduceat(flat * factor, begin)
                low = WD.mix(low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(sets)), pa.array(size), pa.array(sums[0].view(np.int64)),
                     pa.array(sums[1].view(np.int64)), _lists(low[:, :trees], 4), _lists(low[:, trees:], 2)],
                    names=["id", "n", "s1", "s2", "low", "deep"])

    return run


def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for lo in range(0, max(1, batch.num_rows), 1024):
            part = batch.slice(lo, 1024)
            packed = [squeeze.compress(x.as_py().encode("utf-8", "surrogatepass")) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["id", "packed"])


def spanning_links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets of a node. Each set's
    intersections with all others come from the node's inverted lists; sets
    that are already in one tree need no further look."""
    m = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    root = np.arange(m)
    out: list[tuple[int, int]] = []

    def unite(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = int(root[i]), int(root[j])
            if a != b:
                out.append((i, j))
                root[root == max(a, b)] = min(a, b)

    if m == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * common >= percent * (size[0] + size[1] - common) else []
    _, kind, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(kind, kind="stable")
    lists, begin = owner[order], np.cumsum(df) - df
    first = np.cumsum(size) - size
    for i in range(m):
        if (root == root[0]).all():
            break
        kinds = kind[first[i]:first[i] + size[i]]
        kinds = kinds[df[kinds] > 1]
        count = df[kinds]
        total = int(count.sum())
        if not total:
            continue
        inside = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        common = np.bincount(lists[np.repeat(begin[kinds], count) + inside], minlength=m)
        near = 100 * common >= percent * (size[i] + size - common)
        near[i] = False
        unite(i, np.flatnonzero(near & (root != root[i])))
    return out


def _compare(k: int, percent: int):
    """Spanning links of each node; the rows of a node follow one another."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        found: list[tuple[int, int]] = []
        for _, members in groupby(rows(batches), key=lambda r: r[0]):
            ids, sets = [], []
            for _, doc, packed in members:
                data = np.frombuffer(unpack.decompress(packed.as_py()), dtype=np.uint8)
                own = shingle_sets(data, np.array([0, len(data)]), k)[0]
                if len(own):
                    ids.append(doc)
                    sets.append(own)
            if len(sets) > 1:
                found += [(ids[i], ids[j]) for i, j in spanning_links(sets, percent)]
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return run


def _sized(members: DataFrame) -> DataFrame:
    """Members of nodes with at least two sets, with the node's size, weight
    and two fingerprints of its member list."""
    nodes = members.groupBy("node").agg(
        F.count("*").alias("m"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("id")).alias("f1"),
        F.sum(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 31))).alias("f2")).where("m > 1")
    # sums are written before they are joined: Spark splits a hot key only between plain shuffles
    return members.join(write_table(nodes, "near-nodes"), "node")


def nodes(sets: DataFrame, trees: int, leaf: int = LEAF, leaf_shingles: int = LEAF_SHINGLES,
          levels: int = LEVELS) -> DataFrame:
    """(node, id): the nodes to be compared. ``sets`` is (id, n, low, deep)."""
    roots = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)),
                                     lambda t: F.xxhash64(t, F.col("low")[t]))).alias("tree", "node")
    level = cut_lineage(_sized(sets.select("id", "n", roots)))
    small = (F.col("m") <= leaf) & (F.col("weight") <= leaf_shingles)
    done = []
    for depth in range(levels):
        done.append(level.where(small))
        if depth == levels - 1 or level.where(~small).isEmpty():
            break
        branch = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BRANCHES - 1)), lambda j: F.xxhash64(
            F.col("node"), j, F.col("deep")[(F.col("tree") * (levels - 1) + depth) * BRANCHES + j]))).alias("child")
        split = (level.where(~small).select("tree", "node", "id", "n").join(sets.select("id", "deep"), "id")
                 .select("id", "n", "tree", branch).withColumnRenamed("child", "node").distinct())
        level = cut_lineage(_sized(split))
    leaves = done[0]
    for more in done[1:]:
        leaves = leaves.unionByName(more)
    # trees often find the same group of sets: one node of each such group is compared
    once = leaves.groupBy("f1", "f2", "m").agg(F.min("node").alias("node")).select("node")
    out = leaves.select("node", "id").join(once, "node", "left_semi")
    alike = level.where(~small)
    if not alike.isEmpty():
        n_blocks = F.greatest(F.ceil(F.col("m") * 2 / leaf), F.ceil(F.col("weight") * 2 / leaf_shingles))
        own = F.pmod(F.xxhash64(F.lit(2), "id"), n_blocks)
        pairs = (alike.select("node", "id", n_blocks.alias("k"), own.alias("own"))
                 .select("node", "id", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other")))
        out = out.unionByName(pairs.select(
            F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "id"))
    return out


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE,
           miss: float = MISS, leaf: int = LEAF) -> DataFrame:
    """(id, n_shingles, component) for every row."""
    trees = n_trees(percent, miss)
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("id"), docs[f"`{text}`"].cast("string").alias("text"))
    sketches = write_table(rows.mapInArrow(_sketch(shingle, trees),
                                           "id long, n long, s1 long, s2 long, low array<int>, deep array<smallint>"), "near-sketches")
    with_set = sketches.where("n > 0 and id is not null")
    same = write_table(with_set.groupBy("s1", "s2").agg(F.min("id").alias("rep")), "near-same")
    owned = with_set.select("id", "s1", "s2").join(same, ["s1", "s2"]).select("id", "rep")
    sets = (with_set.join(same.select(F.col("rep").alias("id"), "s1", "s2"), ["id", "s1", "s2"], "left_semi")
            .dropDuplicates(["id", "s1", "s2"]).select("id", "n", "low", "deep"))
    sets = write_table(sets, "near-sets")  # read again by every level of the trees
    members = nodes(sets, trees, leaf)
    packed = rows.where("id is not null and text is not null").mapInArrow(packed_texts, "id long, packed binary")
    met = (members.join(packed, "id").select("node", "id", "packed")
           .repartition(F.col("node")).sortWithinPartitions("node"))
    links = met.mapInArrow(_compare(shingle, percent), "a long, b long")
    # rows of one id with different texts tie their sets together
    ties = owned.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("id")
    links = links.unionByName(owned.join(ties, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    found = components(links)
    with_rep = sketches.join(same, ["s1", "s2"], "left")
    own: Column = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("rep")).otherwise(F.col("id"))
    return (with_rep.withColumn("own", own)
            .join(found, F.col("own") == F.col("node"), "left")
            .select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "own").alias("component")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with one of each group: the smallest id. Of rows that
    repeat an id all stay."""
    found = groups(docs, doc_id, text, **options)
    gone = found.where("component <> id").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs[f"`{doc_id}`"] == gone["_gone"], "left_anti")
