"""Substring dedup by relative Lempel-Ziv factors.

Every window of ``window`` consecutive words that also starts anywhere else is
a duplicate; the words it covers are removed. The corpus itself is the
reference: it is indexed in blocks, each document is parsed greedily into
factors, the longest stretches that go on in one place of the reference, and at
the ends of factors, where a block is only partly repeated, single windows are
checked.

1. *Reference blocks.* In each window the run of ``anchor`` words with the
   smallest hash is the anchor; the windows with one anchor are a block. Equal
   windows have equal anchors, wherever they stand. One row per block (a tenth
   of the words) carries the hash of the anchor and of the whole block.
2. *Index.* Blocks are counted by anchor with map-side sums, which also keep the
   first and the last place where a block stands. Only blocks whose anchor
   occurs again go on; where all blocks of an anchor are equal, nothing is left
   to check.
3. *Ends of factors.* Where blocks of one anchor differ, a factor ends inside
   them: equal ones are counted again, and one copy of each different block has
   its windows hashed, counted and placed within the anchor. This finds each
   window that different blocks share.
4. *Parse.* A document's repeated blocks and windows, each with up to two places
   other than its own, are read from left to right: of the two places that is
   taken which goes on further, and the factor runs until its place does not go
   on. A factor has at least ``window`` words; the words outside all factors are
   kept.

The parse is greedy over the two places that the index keeps, not over all
places of a block, so a factor may be shorter than the longest match of all;
which words are covered does not depend on that, as every repeated window is in
some factor. Nothing is grouped by a hot key without a map-side sum: hashes are
counted, and rows meet the counted hashes in joins that Spark may split. Texts
move compressed, keyed by document. Hashes of blocks and windows are compared
within one anchor hash, which makes 128 bits. A place is one number: 36 bits of
the document's key and the index of the word.

Defined cases: a null or short text has no window and loses nothing; repeated
rows repeat each other's windows (their key is one, so their place is their
own); repeated ids with other texts are other documents (rows are keyed by id
and text); an empty table gives no rows; other columns pass through
:func:`remove`, but for those that have the name of a new column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from . import words as WD

WINDOW = 35
ANCHOR = 12
_POS_BITS = np.uint64(28)  # of a word's place in a slice, for ties
_POS_MASK = np.uint64((1 << 28) - 1)
PLACE_BITS = 28  # of a place, for the index of its first word


def blocks(words: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, start, count, anchor hash, block hash) of each block of a slice:
    windows ``start .. start + count - 1`` of the text share one anchor.
    ``first`` has the index of each text's first word."""
    n_words = np.diff(first)
    text = np.repeat(np.arange(len(n_words)), n_words)
    at = np.arange(len(words))
    starts = at[at + window <= first[1:][text]] if len(words) else at
    none = np.zeros(0, dtype=np.int64)
    if len(starts) == 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = WD.prefix_hashes(words)
    grams = WD.range_hashes(prefix, at[:len(words) - anchor + 1], at[:len(words) - anchor + 1] + anchor)
    # the smallest hash; of equal ones the leftmost
    ranked = (grams >> _POS_BITS << _POS_BITS) | (np.arange(len(grams), dtype=np.uint64) & _POS_MASK)
    place = (WD.sliding_min(ranked, window - anchor + 1)[starts] & _POS_MASK).astype(np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(starts)))
    begin = starts[head]
    whole = WD.range_hashes(prefix, begin, begin + count - 1 + window)
    whole = whole ^ WD.mix((place[head] - begin).astype(np.uint64))
    return text[begin], begin - first[text[begin]], count, grams[place[head]], whole


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _block_rows(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, data, offsets in WD.text_slices(batch.column(1)):
                starts, ends, first = WD.word_bounds(data, offsets)
                text, begin, count, a, b = blocks(WD.word_hashes(data, starts, ends), first, window, anchor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[lo + text]), _signed(a), _signed(b), pa.array(begin << 8 | count)],
                    names=["key", "a", "b", "pos"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, compressed."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        for lo in range(0, max(1, batch.num_rows), 1024):
            packed = [squeeze.compress((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in text.slice(lo, 1024)]
            yield pa.RecordBatch.from_arrays([*[c.slice(lo, 1024) for c in batch.columns[:-1]],
                                              pa.array(packed, pa.binary())], names=batch.schema.names)


def _window_rows(window: int):
    """(a, h, key, at, single) for each window of the listed blocks of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in range(batch.num_rows):
                data = np.frombuffer(unpack.decompress(batch.column(1)[r].as_py()), dtype=np.uint8)
                starts, ends, _ = WD.word_bounds(data, np.array([0, len(data)]))
                prefix = WD.prefix_hashes(WD.word_hashes(data, starts, ends))
                listed = batch.column(2)[r].values
                a, pos = (listed.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                single = listed.field(2).to_numpy(zero_copy_only=False)
                count = pos & 255
                which = np.repeat(np.arange(len(pos)), count)
                at = (pos >> 8)[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[which]), _signed(WD.range_hashes(prefix, at, at + window)),
                     pa.array(np.full(len(at), batch.column(0)[r].as_py())), pa.array(at), pa.array(single[which])],
                    names=["a", "h", "key", "at", "single"])

    return run


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, text): a document's key is a hash of its id and its text."""
    body = docs[f"`{text}`"].cast("string")
    return docs.select(F.xxhash64(docs[f"`{doc_id}`"], body).alias("key"), body.alias("text"))


def _place(at: Column) -> Column:
    return F.col("key").bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(at)


def _others(own: Column) -> list[Column]:
    """The first and last place of a block, or the other one where it is the row's own."""
    first, last = F.col("first"), F.col("last")
    return [F.when(first == own, last).otherwise(first).alias("near"),
            F.when(last == own, first).otherwise(last).alias("far")]


def duplicate_windows(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(key, at, count, near, far): windows ``at .. at + count - 1`` of the
    document start elsewhere too, the first of them at the places near and far.
    ``rows`` is (key, text)."""
    index = rows.mapInArrow(_block_rows(window, anchor), "key long, a long, b long, pos long")
    pos_at, pos_n = F.shiftright("pos", 8), F.col("pos").bitwiseAND(F.lit(255).cast("long"))
    place = _place(pos_at)
    first, last = F.min(place), F.max(place)
    differ = F.min("b") != F.max("b")
    again = (index.groupBy("a").agg(F.count("*").alias("n"), differ.alias("differ"),
                                    F.when(~differ, first).alias("first"), F.when(~differ, last).alias("last"))
             .where("n > 1").drop("n"))
    # sums are written before they are joined: Spark splits a hot key only between plain shuffles
    again = write_table(again, "substring-anchors")
    shared = write_table(index.join(again, "a"), "substring-blocks")
    found = ["key", pos_at.alias("at"), pos_n.alias("count"), *_others(place)]
    equal = shared.where(~F.col("differ")).select(*found)

    mixed = shared.where("differ").select("key", "a", "b", "pos")
    kinds = mixed.groupBy("a", "b").agg(F.count("*").alias("n"), F.min_by("key", place).alias("key"),
                                        F.min_by("pos", place).alias("pos"), first.alias("first"), last.alias("last"))
    kinds = write_table(kinds, "substring-kinds")  # the copy that stands for a block is chosen once
    repeated = mixed.join(kinds.where("n > 1").select("a", "b", "first", "last"), ["a", "b"]).select(*found)
    open_anchors = write_table(kinds.where("n = 1").select("a").distinct(), "substring-open")
    listed = (kinds.join(open_anchors, "a", "left_semi")
              .groupBy("key").agg(F.collect_list(F.struct("a", "pos", (F.col("n") == 1).alias("single"))).alias("listed")))
    packed = rows.mapInArrow(_packed, "key long, packed binary")
    # rows that repeat a document have one key: the copy that stands for a block is read once
    chosen = packed.join(listed, "key").dropDuplicates(["key"]).select("key", "packed", "listed")
    windows = write_table(chosen.mapInArrow(_window_rows(window), "a long, h long, key long, at long, single boolean"),
                          "substring-windows")
    place = _place(F.col("at"))
    twice = windows.groupBy("a", "h").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    twice = write_table(twice.where("n > 1").drop("n"), "substring-twice")
    border = (windows.where("single").join(twice, ["a", "h"])
              .select("key", "at", F.lit(1).cast("long").alias("count"), *_others(place)))
    return equal.unionByName(repeated).unionByName(border)


def parse(at: np.ndarray, count: np.ndarray, near: np.ndarray, far: np.ndarray,
          window: int) -> list[tuple[int, int, int]]:
    """Greedy factors (start word, end word, place) of a document from its
    repeated stretches of windows, which do not overlap."""
    order = np.argsort(at, kind="stable")
    begin, n = at[order].tolist(), count[order].tolist()
    places = list(zip(near[order].tolist(), far[order].tolist()))
    # how far a factor goes that starts with a stretch at the first or the second of its places
    reach: list[tuple[int, int]] = [(0, 0)] * len(begin)
    for j in range(len(begin) - 1, -1, -1):
        end = begin[j] + n[j]
        ends = [end, end]
        if j + 1 < len(begin) and begin[j + 1] == end:
            for k in (0, 1):
                if places[j][k] + n[j] in places[j + 1]:
                    ends[k] = max(r for p, r in zip(places[j + 1], reach[j + 1]) if p == places[j][k] + n[j])
        reach[j] = (ends[0], ends[1])
    factors, done = [], 0
    for j, start in enumerate(begin):
        if start >= done:
            k = int(reach[j][1] > reach[j][0])
            done = reach[j][k]
            factors.append((start, done + window - 1, places[j][k]))
    return factors


def _covered(factors: list[tuple[int, int, int]], n_words: int) -> np.ndarray:
    """Flags of the words in a factor."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    for start, end, _ in factors:
        change[start] += 1
        change[end] -= 1
    return np.cumsum(change[:-1]) > 0


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR,
           full: bool = True) -> DataFrame:
    """The documents' columns but the text, with n_words, n_removed,
    kept_sha256 (of the kept words joined by a space) and, if ``full``, spans
    (removed word ranges [start, end)), factors (word ranges [start, end) that
    equal the words from source_start on in the document source, the upper bits
    of its key by :func:`keyed`) and kept_text."""
    found = duplicate_windows(keyed(docs, doc_id, text), window, anchor)
    # a set: rows that repeat a document have one key, and their equal windows are reduced in each map task
    by_key = found.groupBy("key").agg(F.collect_set(F.struct("at", "count", "near", "far")).alias("found"))
    new = ["n_words", "n_removed", "kept_sha256", *(["spans", "factors", "kept_text"] if full else [])]
    others = [c for c in docs.columns if c.lower() not in (text.lower(), *new)]
    body = docs[f"`{text}`"].cast("string")
    given = docs.select(F.xxhash64(docs[f"`{doc_id}`"], body).alias("key"),
                        F.struct(*[docs[f"`{c}`"].alias(f"p{i}") for i, c in enumerate(others)], F.lit(0).alias("z"))
                        .alias("kept"), body.alias("text"))
    kept_type = given.schema["kept"].dataType.simpleString()
    packed = given.mapInArrow(_packed, f"key long, kept {kept_type}, packed binary")
    joined = packed.join(by_key, "key", "left").select("kept", "packed", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for packed_text, hit in zip(part.column(1), part.column(2)):
                    raw = unpack.decompress(packed_text.as_py())
                    ws = raw.split()
                    spans: list[dict[str, int]] = []
                    factors: list[tuple[int, int, int]] = []
                    keep = ws
                    if hit.is_valid:
                        factors = parse(*(hit.values.field(i).to_numpy(zero_copy_only=False) for i in range(4)), window)
                        gone = _covered(factors, len(ws))
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                        spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
                        keep = [w for w, g in zip(ws, gone.tolist()) if not g]
                    out = b" ".join(keep)
                    sourced = [{"start": a, "end": b, "source": p >> PLACE_BITS, "source_start": p & (1 << PLACE_BITS) - 1}
                               for a, b, p in factors] if full else []
                    rows.append((len(ws), len(ws) - len(keep), hashlib.sha256(out).hexdigest(), spans, sourced,
                                 out.decode("utf-8", "surrogatepass") if full else ""))
                n, removed, sha, spans, sourced, texts = zip(*rows)
                cols = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
                if full:
                    span, factor = (pa.list_(pa.struct([(c, pa.int64()) for c in names])) for names in (
                        ("start", "end"), ("start", "end", "source", "source_start")))
                    cols += [pa.array(spans, span), pa.array(sourced, factor), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["kept", *new])

    kinds = ["long", "long", "string", "array<struct<start:bigint,end:bigint>>",
             "array<struct<start:bigint,end:bigint,source:bigint,source_start:bigint>>", "string"]
    schema = f"kept {kept_type}, " + ", ".join(f"{n} {k}" for n, k in zip(new, kinds))
    out = joined.mapInArrow(run, schema)
    return out.select(*[F.col(f"kept.p{i}").alias(c) for i, c in enumerate(others)], *new)
