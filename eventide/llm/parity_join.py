"""Jaccard join of shingle sets by parity sketches.

A document's set holds its distinct shingles of ``shingle`` words; two sets link
when ``100 * intersection >= percent * union``, which bounds their symmetric
difference by ``(100 - percent) * (|a| + |b|) / (100 + percent)``.

*Sketches.* Tokens are XORed into sketches in two ways. The *parity sketch* has
512 bits, or as many as the set has tokens, and a token flips one of them; the
Hamming distance of two sketches is at most the symmetric difference. The *segments* are the words of a wider
sketch: a token is XORed, as 64 bits, into one of them, so that no more segments
differ than there are different tokens.

*Pigeonhole join.* Sizes fall into bands such that a set's partners lie in its
own band or in a neighbouring one. A band has ``d + 1 + 2 z`` segments, where d
is the largest symmetric difference of a link in it; linked sets share at least
``2 z + 1`` of them. A set enters its own band and, if it may have a larger
partner there, the next one, and meets others under equal segments. Of the segments that very many
sets share (an empty one, a passage found everywhere) a set leaves out the z most
common: a linked pair still has one in common. The join is exact: apart from
64-bit hashes that agree by chance, no linked pair is lost at any size.

*Verification.* No pairs are formed within a group. Its smallest set is compared
with each other one (sizes and Hamming distance first, then the full sets), and
the links' components are taken. Groups that then lie in one component are done.
In the others, members of different components within the Hamming bound are
connected, and what hangs together over all groups is one cluster, whose full
sets are compared with each other, each text once. A group or cluster too large
for a task is cut into blocks, each pair of blocks in its own task. Documents
with equal sets are one set from the start. Texts move compressed, for
verification only.

Defined cases: a text without words or null has the empty set and is linked with
nothing; fewer words than a shingle's make one shingle; a null id is in no group
(its component is null); rows with one id are one document; an empty table gives
no rows; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, write_table
from . import words as WD
from .components import components
from .near_dedup import packed_texts, shingle_sets, spanning_links

SHINGLE = 4
PERCENT = 85
LEAF = 2048  # sets of a group compared in one task
LEAF_SHINGLES = 1_500_000  # and their shingles
STAR_ROWS = 512  # sets that are compared with one copy of a group's smallest set
PARITY_BITS = 512  # of the smallest parity sketch
_SEEN = 100_000  # fingerprints a task remembers, so that copies send their segments once
_SEGMENT, _TOKEN, _BIT = (np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0x1D8E4E27C47D124F, 0xA24BAED4963EE407))


@dataclass(frozen=True)
class Bands:
    """Size bands of a threshold: ``low`` sizes, segments, and segments that a set may leave out."""
    low: np.ndarray
    segments: np.ndarray
    spare: np.ndarray

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1


def bands(percent: int = PERCENT) -> Bands:
    """A partner of a set of the band is no larger than the next band's largest.
    Bands are twice as wide as that asks, so that only half of the sets enter two."""
    if not 0 < percent < 100:
        raise ValueError("percent must lie between 1 and 99")
    low = [1]
    while low[-1] < 1 << 36:
        low.append((low[-1] * 100 // percent + 1) * 100 // percent + 1)
    most = np.array([2 * (high - 1) * (100 - percent) // (100 + percent) for high in low[1:]], dtype=np.int64)
    spare = 1 + most // 32
    return Bands(np.array(low[:-1], dtype=np.int64), np.where(most > 0, most + 1 + 2 * spare, 0), spare)


def segment_keys(tokens: np.ndarray, owner: np.ndarray, band: np.ndarray, all_bands: Bands,
                 wanted: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(keys, keys per set): for each wanted set its segments in the given band,
    each hashed with its place. ``owner`` is each token's set. The lowest bit
    tells odd bands."""
    count = np.where(wanted, all_bands.segments[band], 0)
    base = np.cumsum(count) - count
    used = count[owner] > 0
    tokens, owner = tokens[used], owner[used]
    value = np.zeros(int(count.sum()), dtype=np.uint64)
    place = base[owner] + ((WD.mix(tokens ^ _SEGMENT) >> np.uint64(32)) * count[owner].astype(np.uint64)
                           >> np.uint64(32)).astype(np.int64)
    if len(place):
        order = np.argsort(place, kind="stable")
        place = place[order]
        head = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        value[place[head]] = np.bitwise_xor.reduceat(WD.mix(tokens ^ _TOKEN)[order], head)
    of = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(value)) - base[of]
    salted = WD.mix((band[of].astype(np.uint64) << np.uint64(40)) + at.astype(np.uint64) + np.uint64(1))
    keys = WD.mix(value ^ salted) >> np.uint64(1) << np.uint64(1)
    return keys | (band[of] & 1).astype(np.uint64), count


def parity_sketches(tokens: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words per set): each token flips one bit of its set's sketch. A
    sketch has at least as many bits as its set has tokens, a power of two, so
    that XORing its halves gives the sketch of half the length."""
    n_bits = PARITY_BITS << np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / PARITY_BITS))).astype(np.int64)
    salted, parts = WD.mix(tokens ^ _BIT), [np.zeros(0, dtype=np.uint64)]
    for lo in range(0, len(sizes), 512):
        a, b = np.searchsorted(owner, [lo, lo + 512])
        length = n_bits[lo:lo + 512]
        base, of = np.cumsum(length) - length, owner[a:b] - lo
        bit = base[of] + (salted[a:b] & (length[of] - 1).astype(np.uint64)).astype(np.int64)
        odd = np.bincount(bit, minlength=int(length.sum())) & 1
        parts.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8"))
    return np.concatenate(parts), n_bits // 64


def _lists(values: np.ndarray, count: np.ndarray) -> pa.ListArray:
    ends = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(count, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))


def _sketch(k: int, percent: int):
    all_bands = bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for lo, data, offsets in WD.text_slices(batch.column(1)):
                sets = shingle_sets(data, offsets, k)
                ids = batch.column(0).slice(lo, len(sets))
                size = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero((size > 0) & ids.is_valid().to_numpy(zero_copy_only=False))
                sums = np.zeros((2, len(sets)), dtype=np.uint64)
                bits, n_words = np.zeros(0, dtype=np.uint64), np.zeros(len(sets), dtype=np.int64)
                spare = np.zeros(len(sets), dtype=np.int64)
                keys, n_keys = [np.zeros(0, dtype=np.uint64)], np.zeros(len(sets), dtype=np.int64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    owner = np.repeat(np.arange(len(full)), size[full])
                    begin = np.cumsum(size[full]) - size[full]
                    for row, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                        sums[row, full] = np.add.reduceat(WD.mix(flat ^ np.uint64(salt)), begin)
                    bits, n_words[full] = parity_sketches(flat, owner, size[full])
                    spare[full] = all_bands.spare[all_bands.of(size[full])]
                    fresh = []
                    for at, print_ in enumerate(zip(*sums[:, full].tolist())):
                        if print_ not in seen:
                            seen.add(print_)
                            fresh.append(at)
                    if len(seen) > _SEEN:
                        seen.clear()
                    flat = np.concatenate([sets[full[i]] for i in fresh]) if fresh else flat[:0]
                    fresh_size = size[full[fresh]]
                    owner = np.repeat(np.arange(len(fresh)), fresh_size)
                    own = all_bands.of(fresh_size)
                    a, n_a = segment_keys(flat, owner, own, all_bands)
                    above = fresh_size * 100 // percent >= all_bands.low[own + 1]  # a partner may lie in the next band
                    b, n_b = segment_keys(flat, owner, own + 1, all_bands, above)
                    n_keys[full[fresh]] = n_a + n_b
                    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
                    for i in range(len(fresh)):
                        keys += [a[ends_a[i] - n_a[i]:ends_a[i]], b[ends_b[i] - n_b[i]:ends_b[i]]]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(size), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                     _lists(bits, n_words), pa.array(spare),
                     _lists(np.concatenate(keys), n_keys)],
                    names=["id", "n", "s1", "s2", "bits", "spare", "keys"])

    return run


SKETCH = "id long, n long, s1 long, s2 long, bits array<long>, spare long, keys array<long>"


def may_link(percent: int, n_a: Column, bits_a: Column, n_b: Column, bits_b: Column) -> Column:
    """Whether sizes and Hamming distance leave a link possible."""
    def xor(x: Column, y: Column) -> Column:
        return x.bitwiseXOR(y)

    def folded(x: Column, other: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(other), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), xor)).otherwise(x)

    differ = F.zip_with(folded(bits_a, bits_b), folded(bits_b, bits_a), lambda x, y: F.bit_count(xor(x, y)))
    distance = F.aggregate(differ, F.lit(0), lambda s, x: s + x)
    # without a value where lengths still differ, as at low thresholds
    return ((100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b))
            & F.coalesce((100 + percent) * distance <= (100 - percent) * (n_a + n_b), F.lit(True)))


def segment_groups(sketches: DataFrame, owned: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(node, id): sets under equal segments, at least two in a group."""
    members = sketches.select("id", F.explode("keys").alias("node"))
    shared = write_table(members.groupBy("node").count().where("count > 1").select("node"), "parity-shared")
    # copies stand in for the smallest id of their set
    met = members.join(shared, "node").join(owned, "id").select("node", F.col("rep").alias("id"), "spare")
    met = write_table(met.groupBy("node", "id").agg(F.min("spare").alias("spare")), "parity-met")
    size = write_table(met.groupBy("node").agg(F.count("*").alias("m")).where("m > 1"), "parity-sizes")
    met = write_table(met.join(size, "node"), "parity-members")
    # each set leaves its most common segments out, as many as its band has to spare
    common = Window.partitionBy("id", F.col("node").bitwiseAND(F.lit(1).cast("long"))).orderBy(F.desc("m"), "node")
    kept = met.where(F.col("m") > leaf).withColumn("place", F.row_number().over(common)).where("place > spare")
    return met.where(F.col("m") <= leaf).select("node", "id").unionByName(kept.select("node", "id"))


def _star_links(k: int, percent: int):
    """Links of each node's head with its other members; the head's rows come first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        node, head, heads = None, None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            columns = (batch.column(i).to_pylist() for i in range(3))
            for (at, is_head, doc), packed in zip(zip(*columns), batch.column(3)):
                data = np.frombuffer(unpack.decompress(packed.as_py()), dtype=np.uint8)
                own = shingle_sets(data, np.array([0, len(data)]), k)[0]
                if at != node:
                    node, heads = at, []
                if is_head:
                    head = doc
                    heads.append(own)
                    continue
                for other in heads:
                    common = len(np.intersect1d(other, own, assume_unique=True))
                    if common and 100 * common >= percent * (len(own) + len(other) - common):
                        found.append((head, doc))
                        break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link. ``a`` is sent once for a block of its partners."""
    blocks = write_table(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_ROWS).alias("blocks")), "parity-stars")
    dealt = (pairs.join(blocks, "a")
             .select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("blocks"))).alias("node")))
    dealt = write_table(dealt, "parity-dealt")
    rows = (dealt.select("node", F.lit(False).alias("head"), F.col("b").alias("id"))
            .unionByName(dealt.select("node", F.lit(True).alias("head"), F.col("a").alias("id")).distinct()))
    met = (rows.join(texts, "id").select("node", "head", "id", "packed")
           .repartition(F.col("node")).sortWithinPartitions("node", F.desc("head")))
    return met.mapInArrow(_star_links(shingle, percent), "a long, b long")


def _near_edges(percent: int):
    """A spanning forest, for each node, of the pairs of members in different
    components within the Hamming bound; the rows of a node follow one another."""
    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            bits = (x.values.to_numpy().view(np.uint64) for x in batch.column(4))
            yield from zip(*(batch.column(i).to_pylist() for i in range(4)), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for _, members in groupby(rows(batches), key=lambda r: r[0]):
            _, doc, own, n, bits = zip(*members)
            own, n, length = np.array(own), np.array(n), min(map(len, bits))
            bits = np.array([np.bitwise_xor.reduce(x.reshape(-1, length)) for x in bits])  # all of one length
            root = np.arange(len(n))
            for i in range(len(n)):
                if (root == root[0]).all():
                    break
                distance = np.bitwise_count(bits ^ bits[i]).sum(axis=1, dtype=np.int64)
                near = ((own != own[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
                        & ((100 + percent) * distance <= (100 - percent) * (n + n[i])))
                for j in np.flatnonzero(near & (root != root[i])).tolist():
                    if root[i] != root[j]:
                        found.append((doc[i], doc[j]))
                        root[root == root[j]] = root[i]
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return run


def _node_links(k: int, percent: int):
    """Spanning links of each node; the rows of a node follow one another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
        for _, members in groupby(rows, key=lambda r: r[0]):
            ids, sets = [], []
            for _, doc, packed in members:
                data = np.frombuffer(unpack.decompress(packed.as_py()), dtype=np.uint8)
                own = shingle_sets(data, np.array([0, len(data)]), k)[0]
                if len(own):
                    ids.append(doc)
                    sets.append(own)
            found = [(ids[i], ids[j]) for i, j in spanning_links(sets, percent)] if len(sets) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return run


def _blocks(members: DataFrame, leaf: int, leaf_shingles: int) -> DataFrame:
    """(node, id, own, n): nodes too large for a task are cut into blocks, and
    each pair of blocks is a node of its own. ``members`` has m, the node's
    members, and weight, their shingles."""
    n_blocks = F.greatest(F.ceil(F.col("m") * 2 / leaf), F.ceil(F.col("weight") * 2 / leaf_shingles))
    small = (F.col("m") <= leaf) & (F.col("weight") <= leaf_shingles)
    block = F.pmod(F.xxhash64(F.lit(2), "id"), n_blocks)
    pairs = (members.where(~small).select("node", "id", "own", "n", n_blocks.alias("k"), block.alias("x"))
             .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("y")))
    return members.where(small).select("node", "id", "own", "n").unionByName(
        pairs.select(F.xxhash64("node", F.least("x", "y"), F.greatest("x", "y")).alias("node"), "id", "own", "n"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE,
           leaf: int = LEAF, leaf_shingles: int = LEAF_SHINGLES) -> DataFrame:
    """(id, n_shingles, component) for every row."""
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("id"), docs[f"`{text}`"].cast("string").alias("text"))
    sketches = write_table(rows.mapInArrow(_sketch(shingle, percent), SKETCH), "parity-sketches")
    with_set = sketches.where("n > 0 and id is not null")
    same = write_table(with_set.groupBy("s1", "s2").agg(F.min("id").alias("rep")), "parity-same")
    owned = write_table(with_set.select("id", "s1", "s2", "spare").join(same, ["s1", "s2"]).groupBy("id", "rep")
                        .agg(F.min("spare").alias("spare")), "parity-owned")
    members = write_table(segment_groups(sketches, owned, leaf), "parity-nodes")
    nodes = members.groupBy("node").agg(
        F.count("*").alias("m"), F.min("id").alias("head"), F.bit_xor(F.xxhash64("id")).alias("f1"),
        F.sum(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 31))).alias("f2")).where("m > 1")
    # many segments bring the same sets together: one node of each such group goes on
    nodes = write_table(nodes.groupBy("f1", "f2", "m").agg(F.min("node").alias("node"), F.min("head").alias("head"))
                        .select("node", "m", "head"), "parity-heads")
    members = write_table(members.join(nodes, "node"), "parity-groups")

    prints = with_set.select("id", "n", "bits")
    a = prints.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    b = prints.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    stars = (members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
             .join(a, "a").join(b, "b")
             .where(may_link(percent, *(F.col(c) for c in ("n_a", "bits_a", "n_b", "bits_b")))).select("a", "b").distinct())
    texts = rows.where("id is not null and text is not null").mapInArrow(packed_texts, "id long, packed binary")
    links = cut_lineage(verified(write_table(stars, "parity-pairs"), texts, shingle, percent))

    joined = components(links).select(F.col("node").alias("id"), "component")
    sizes = with_set.groupBy("id").agg(F.max("n").alias("n"))
    # after a star, a group of two is settled
    placed = (members.where("m > 2").select("node", "id").join(joined, "id", "left").join(sizes, "id")
              .select("node", "id", F.coalesce("component", "id").alias("own"), "n"))
    placed = write_table(placed, "parity-placed")
    split = write_table(placed.groupBy("node").agg(
        F.count("*").alias("m"), F.sum("n").alias("weight"), F.min("own").alias("lo"), F.max("own").alias("hi"))
        .where("lo <> hi").select("node", "m", "weight"), "parity-split")
    cut = _blocks(placed.join(split, "node"), leaf, 16 * leaf_shingles)  # sketches, not sets
    near = (cut.join(prints.select("id", "bits", F.col("n").alias("size")), "id").select("node", "id", "own", "size", "bits")
            .repartition(F.col("node")).sortWithinPartitions("node").mapInArrow(_near_edges(percent), "a long, b long"))
    clusters = components(near).select(F.col("node").alias("id"), F.col("component").alias("node")).join(sizes, "id")
    clusters = write_table(clusters.withColumn("own", F.col("id")), "parity-clusters")
    weights = write_table(clusters.groupBy("node").agg(F.count("*").alias("m"), F.sum("n").alias("weight")), "parity-weights")
    clusters = _blocks(clusters.join(weights, "node"), leaf, leaf_shingles).select("node", "id")
    met = (clusters.join(texts, "id").select("node", "id", "packed")
           .repartition(F.col("node")).sortWithinPartitions("node"))
    links = links.unionByName(met.mapInArrow(_node_links(shingle, percent), "a long, b long"))
    # rows of one id with different texts tie their sets together
    ties = owned.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("id")
    links = links.unionByName(owned.join(ties, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    found = components(links)
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("rep")).otherwise(F.col("id"))
    return (sketches.select("id", "n", "s1", "s2").join(same, ["s1", "s2"], "left").withColumn("own", own)
            .join(found, F.col("own") == F.col("node"), "left")
            .select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "own").alias("component")))
