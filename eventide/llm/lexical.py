"""Ranked lexical search over hashed max-sketches.

*Index.* A document's terms are kept with their counts, and each term's impact
(its saturated frequency, scaled by the document's length) is folded into a
sketch: a term is hashed to one of ``COORDINATES`` coordinates, which hold the
largest impact among their terms, rounded up. The document frequencies of all
terms and the corpus sums N and L are kept beside it.

*Search.* Queries are looked up in batches. A task reads its part of the index
in blocks of documents. The bound of a document for a query is the sum, over the
query's terms, of the term's weight times the sketch's coordinate of that term,
which is no less than its score. Documents are rescored exactly in descending
order of bounds until the bound falls under the task's threshold, the score of
the k-th best so far; a bound equal to it is still rescored, as equal scores go
to the smaller id. A task gives back at most k documents for each query, and the
best of these are taken in two steps. No document is left out: results are exact.

Terms are 64-bit hashes (:func:`words.span_hashes`). A batch of queries is the
only thing that is broadcast, and holds about ``BATCH_TERMS`` terms; a single
query with more makes a batch by itself.

Defined cases: a null text has no terms; a document or query without terms is in
no result, and such documents don't count for N; a term that no document holds
adds nothing; each row is a document, so that rows which repeat an id are ranked
one by one; a null document id comes last among equal scores; rows with one query
id are one query, a null id included; an empty table on either side gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_table
from . import words as WD

TOP = 50
COORDINATES = 4096
STEP = 16  # sketch entries are in steps of so many units of impact, so that two bytes hold them
BATCH_TERMS = 200_000
BLOCK_DOCS = 512  # documents whose bounds are computed at once
RESCORED = 64  # documents rescored between two looks at the threshold
LANES = 64  # first step of the merge
# bytes of the terms [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[ord("0"):ord("9") + 1] = _INSIDE[ord("A"):ord("Z") + 1] = _INSIDE[ord("a"):ord("z") + 1] = True
_INSIDE[0x80:] = True
_NO_ID = np.iinfo(np.int64).max


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of each distinct term of a slice, by text and term,
    and the number of terms with repeats of each text."""
    starts, ends, first = WD.word_bounds(data, offsets, _INSIDE[data])
    n = np.diff(first)
    text, term = np.repeat(np.arange(len(n)), n), WD.word_hashes(data, starts, ends, lower=True)
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    head = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (term[1:] != term[:-1]))[:len(text)])
    return text[head], term[head], np.diff(np.append(head, len(text))), n


def length_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's m; whole numbers of any size on the way."""
    return np.array([100 - 50 + (50 * x * n_docs) // n_terms for x in n.tolist()], dtype=np.int64)


def impacts(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    count = count.astype(np.int64)
    return (1_000_000_000 * count) // (1000 * count + 20 * m)


def coordinates(term: np.ndarray) -> np.ndarray:
    return (WD.mix(term ^ np.uint64(0x71C9F6B3A8D25E17)) % np.uint64(COORDINATES)).astype(np.uint16)


def _blobs(flat: np.ndarray, per_row: np.ndarray) -> pa.Array:
    """A binary column whose rows hold runs of ``flat``."""
    ends = np.zeros(len(per_row) + 1, dtype=np.int64)
    np.cumsum(per_row * flat.itemsize, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(per_row), [None, pa.py_buffer(ends.astype(np.int32)),
                                                            pa.py_buffer(np.ascontiguousarray(flat))])


def _flat(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a binary column and the number of each row's."""
    wide = pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[ends[0]:ends[-1]].copy() if raw is not None else np.zeros(0, dtype=np.uint8)
    return data.view(dtype), np.diff(ends) // np.dtype(dtype).itemsize


def _index_rows(n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets in WD.text_slices(batch.column(1)):
                text, term, count, n = terms_of(data, offsets)
                full = np.flatnonzero(n)
                place = np.cumsum(n > 0) - 1  # of a text among those with terms
                owner = place[text]
                m = length_factor(n[full], n_docs, n_terms)
                top = -(-impacts(count, m[owner]) // STEP)
                at = owner * COORDINATES + coordinates(term)
                order = np.argsort(at, kind="stable")
                at = at[order]
                head = np.flatnonzero(np.append(True, at[1:] != at[:-1])[:len(at)])
                top = np.maximum.reduceat(top[order], head) if len(head) else top
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(n)).take(pa.array(full)), pa.array(n[full]),
                     _blobs(term, np.bincount(owner, minlength=len(full))),
                     _blobs(count.astype(np.uint32), np.bincount(owner, minlength=len(full))),
                     _blobs((at[head] % COORDINATES).astype(np.uint16), np.bincount(at[head] // COORDINATES, minlength=len(full))),
                     _blobs(top.astype(np.uint16), np.bincount(at[head] // COORDINATES, minlength=len(full)))],
                    names=["id", "n", "terms", "counts", "places", "tops"])

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with terms and their terms with repeats."""
    for batch in batches:
        for _, data, offsets in WD.text_slices(batch.column(0)):
            n = np.diff(WD.word_bounds(data, offsets, _INSIDE[data])[2])
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "terms"])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        term, count = np.unique(_flat(batch.column(0), "<u8")[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(count)], names=["term", "df"])


@dataclass
class Index:
    """``docs``: (id, n, terms, counts, places, tops), documents with terms only.
    ``frequencies``: (term, df)."""
    docs: DataFrame
    frequencies: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Index of every document, written to the shared folder."""
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("id"), docs[f"`{text}`"].cast("string").alias("text"))
    sums = (rows.select("text").mapInArrow(_lengths, "docs long, terms long")
            .agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.sum("terms").alias("terms")).collect()[0])
    n_docs, n_terms = sums["docs"], sums["terms"] or 0
    schema = "id long, n long, terms binary, counts binary, places binary, tops binary"
    index = write_table(rows.mapInArrow(_index_rows(n_docs, n_terms), schema), "search-index")
    counts = index.select("terms").mapInArrow(_document_counts, "term long, df long")
    return Index(index, write_table(counts.groupBy("term").agg(F.sum("df").alias("df")), "search-terms"), n_docs, n_terms)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, data, offsets in WD.text_slices(batch.column(1)):
            text, term, _, _ = terms_of(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(offsets) - 1).take(pa.array(text)),
                                              pa.array(term.view(np.int64))], names=["item", "term"])


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Batch:
    """The terms and weights of a batch of queries."""

    def __init__(self, query: list[int], term: list[int], weights: list[int], n_queries: int):
        at = np.array(query, dtype=np.int64)
        terms = np.array(term, dtype=np.int64).view(np.uint64)
        order = np.argsort(at, kind="stable")
        self.vocabulary, number = np.unique(terms[order], return_inverse=True)
        self.weights = np.zeros(len(self.vocabulary), dtype=np.int64)
        self.weights[number] = np.array(weights, dtype=np.int64)[order]
        places = coordinates(self.vocabulary)
        self.row_of_place = np.full(COORDINATES, -1, dtype=np.int64)
        used = np.unique(places)
        self.row_of_place[used] = np.arange(len(used))
        self.n_rows = len(used)
        self.rows = self.row_of_place[places]
        bounds = np.searchsorted(at[order], np.arange(n_queries + 1))
        self.queries = [number[bounds[i]:bounds[i + 1]] for i in range(n_queries)]


class _Best:
    """The best documents of a query so far: score descending, id ascending."""

    def __init__(self):
        self.scores, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def threshold(self, top: int) -> int:
        return int(self.scores[-1]) if len(self.scores) == top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, top: int) -> None:
        fit = scores >= self.threshold(top)
        scores, ids = np.concatenate([self.scores, scores[fit]]), np.concatenate([self.ids, ids[fit]])
        order = np.lexsort((ids, -scores))[:top]
        self.scores, self.ids = scores[order], ids[order]


class _Block:
    """Sketches and postings of a block of documents, for one batch of queries."""

    def __init__(self, batch: _Batch, columns: list[pa.Array], n_docs: int, n_terms: int):
        n = columns[1].to_numpy(zero_copy_only=False)
        term, per_doc = _flat(columns[2], "<u8")
        count, _ = _flat(columns[3], "<u4")
        place, per_sketch = _flat(columns[4], "<u2")
        tops, _ = _flat(columns[5], "<u2")
        row, owner = batch.row_of_place[place], np.repeat(np.arange(len(n)), per_sketch)
        self.sketch = np.zeros((batch.n_rows, len(n)))
        self.sketch[row[row >= 0], owner[row >= 0]] = tops[row >= 0].astype(np.float64) * STEP
        number = np.minimum(np.searchsorted(batch.vocabulary, term), len(batch.vocabulary) - 1)
        asked = batch.vocabulary[number] == term
        owner = np.repeat(np.arange(len(n)), per_doc)[asked]
        self.number = number[asked]
        self.gain = impacts(count[asked], length_factor(n, n_docs, n_terms)[owner]) * batch.weights[self.number]
        self.first = np.searchsorted(owner, np.arange(len(n) + 1))

    def scores(self, docs: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """Exact scores; ``flags`` marks the query's terms."""
        size = self.first[docs + 1] - self.first[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.first[docs] - (ends - size), size)
        total = np.zeros(len(at) + 1, dtype=np.int64)
        np.cumsum(np.where(flags[self.number[at]], self.gain[at], 0), out=total[1:])
        return total[ends] - total[ends - size]


def _search_rows(shared, n_docs: int, n_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: _Batch = shared.value
        best = [_Best() for _ in asked.queries]
        flags = np.zeros(len(asked.vocabulary), dtype=bool)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_DOCS):
                columns = [c.slice(lo, BLOCK_DOCS) for c in batch.columns]
                ids = columns[0].fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                block = _Block(asked, columns, n_docs, n_terms)
                for query, mine in zip(asked.queries, best):
                    if not len(query):
                        continue
                    bound = asked.weights[query].astype(np.float64) @ block.sketch[asked.rows[query]]
                    near = np.flatnonzero(bound >= mine.threshold(top))
                    if not len(near):
                        continue
                    near = near[np.argsort(-bound[near], kind="stable")]
                    flags[query] = True
                    for at in range(0, len(near), RESCORED):
                        part = near[at:at + RESCORED]
                        if bound[part[0]] < mine.threshold(top):
                            break
                        mine.add(block.scores(part, flags), ids[part], top)
                    flags[query] = False
        size = np.array([len(b.ids) for b in best])
        if size.sum():
            ids = np.concatenate([b.ids for b in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(best)), size)), pa.array(ids, mask=ids == _NO_ID),
                 pa.array(np.concatenate([b.scores for b in best]))], names=["query", "doc_id", "score"])

    return run


def search(index: Index, items: DataFrame, item_id: str = "item_id", text: str = "text", top: int = TOP,
           batch_terms: int = BATCH_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's best documents."""
    spark = items.sparkSession
    kind = items.schema[item_id].dataType
    result = T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()),
                           T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    given = items.select(items[f"`{item_id}`"].alias("item"), items[f"`{text}`"].cast("string").alias("text"))
    asked = given.mapInArrow(_query_terms, T.StructType([T.StructField("item", kind), T.StructField("term", T.LongType())]))
    asked = write_table(asked.distinct().join(index.frequencies, "term"), "search-queries")
    n_batches = max(1, math.ceil(asked.count() / batch_terms))
    out = spark.createDataFrame([], result)
    for number in range(n_batches):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(n_batches)) == number).collect()  # about batch_terms
        if not rows:
            continue
        names = list(dict.fromkeys(r["item"] for r in rows))
        place = {name: i for i, name in enumerate(names)}
        shared = spark.sparkContext.broadcast(_Batch(
            [place[r["item"]] for r in rows], [r["term"] for r in rows],
            [weight(r["df"], index.n_docs) for r in rows], len(names)))
        found = index.docs.mapInArrow(_search_rows(shared, index.n_docs, index.n_terms, top),
                                      "query long, doc_id long, score long")
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        first = Window.partitionBy("query", "lane").orderBy(*order)
        last = Window.partitionBy("query").orderBy(*order)
        found = (found.withColumn("lane", F.spark_partition_id() % LANES)
                 .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
                 .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top))
        keys = spark.createDataFrame([(i, name) for i, name in enumerate(names)],
                                     T.StructType([T.StructField("query", T.LongType()), T.StructField("item_id", kind)]))
        out = out.unionByName(found.join(F.broadcast(keys), "query").select("item_id", "rank", "doc_id", "score"))
    return out
