"""Rankings equal scores of all documents; bounds are bounds."""
import math
import random
import re

import numpy as np
import pytest

from eventide.llm import lexical


def _terms(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top=50):
    bags = [(i, _terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = {}
    for _, bag in bags:
        for t in set(bag):
            df[t] = df.get(t, 0) + 1
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(_terms(text))
    out = []
    for item, terms in queries.items():
        scored = []
        for i, bag in bags:
            m = 100 - 50 + (50 * len(bag) * n_docs) // n_terms if bag else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10 ** 9 * bag.count(t)) // (1000 * bag.count(t) + 20 * m)) for t in terms if t in bag)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    vocab = [f"t{i}" for i in range(400)]
    docs = [(i, " ".join(vocab[min(399, int(r.expovariate(0.02)))] for _ in range(r.choice([0, 1, 5, 40, 300]))))
            for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(80)] + [(7, docs[7][1]), (7, "T3 t4")]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 30)))) for i in range(30)] + [(90, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"top": 3}, {"batch_terms": 40}])
def test_equals_brute_force(spark, corpus, options):
    docs, items = corpus
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert got(lexical.search(index, asked, **options)) == brute(docs, items, options.get("top", 50))


def test_bounds_hold_with_all_terms_in_few_coordinates(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "COORDINATES", 7)
    docs, items = corpus
    r = random.Random(1)
    data = np.frombuffer("".join(t for _, t in docs[:50]).encode(), dtype=np.uint8)
    _, term, count, n = lexical.terms_of(data, np.array([0, len(data)]))
    rows = list(lexical._index_rows(60, 5000)([_batch(docs[:60])]))[0]
    asked = lexical._Batch([0] * 20, r.sample(term.view(np.int64).tolist(), 20), [r.randint(1, 9000) for _ in range(20)], 1)
    block = lexical._Block(asked, rows.columns, 60, 5000)
    flags = np.zeros(len(asked.vocabulary), dtype=bool)
    flags[asked.queries[0]] = True
    bound = asked.weights[asked.queries[0]].astype(float) @ block.sketch[asked.rows[asked.queries[0]]]
    assert (bound >= block.scores(np.arange(rows.num_rows), flags)).all() and count.sum() == n.sum()


def _batch(docs):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], names=["id", "text"])


def test_defined_cases(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    items = [(1, "Same TEXT here, word"), (None, "one of three"), (1, "漢字 é漢字"), (4, None), (5, ""), (6, "nowhere"),
             (7, "x" * 200_000 + " id")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'q' as term", "1 as df", "2 as item")
    assert got(lexical.search(lexical.build(odd_docs), asked)) == brute(docs, items)
    assert lexical.search(lexical.build(no_docs), asked).count() == 0
    assert lexical.search(lexical.build(odd_docs), asked.limit(0)).count() == 0


def test_names_as_item_ids(spark, corpus):
    docs, items = corpus
    named = [(f"item {i}", t) for i, t in items[:5]]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got(lexical.search(index, spark.createDataFrame(named, "item_id string, text string"))) == brute(docs, named)
