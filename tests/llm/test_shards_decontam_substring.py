"""Sharding, decontamination and substring dedup against plain versions."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import decontam, sharding, substring
from eventide.llm.queries import Q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_sharding(spark, sample):
    rows = Q["op8_sharding"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in sample.collect()}
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        body = texts[r["doc_id"]].encode()
        assert r["size"] == len(body) + 8 and r["text_crc32"] == zlib.crc32(body)
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_follow_weights_and_blocks(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    weights = {0: 1.0, 1: 1.0, 2: 2.0}
    out = sharding.assign(df, "doc_id", "text", weights, weights | {7: 1.0}, block_rows=500)
    n = {r["shard"]: r["count"] for r in out.groupBy("shard").count().collect()}
    assert abs(n[2] / 20_000 - 0.5) < 0.02 and abs(n[0] / 20_000 - 0.25) < 0.02
    moved = out.where("grown_shard <> shard")
    assert moved.where("grown_shard <> 7").count() == 0 and abs(moved.count() / 20_000 - 0.2) < 0.02
    for s in weights:
        own = out.where(F.col("shard") == s).agg(F.countDistinct("slot").alias("d"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect()[0]
        assert (own["d"], own["a"], own["b"]) == (n[s], 0, n[s] - 1)


def test_shard_tables(odd_docs, no_docs):
    w = {s: 1.0 for s in range(3)}
    rows = sharding.assign(odd_docs, "doc_id", "text", w).collect()
    assert len(rows) == odd_docs.count() and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert {r["size"] for r in rows if r["key"] == 0} == {8} and all(r["grown_shard"] is None for r in rows)
    assert sharding.assign(no_docs, "doc_id", "text", w).count() == 0


def _plain_shard(key, shards):
    """Shard of the highest score -1 / ln(hash), hashed as Spark's xxhash64 does."""
    import math
    import struct

    import xxhash

    def score(shard):
        h = xxhash.xxh64_intdigest(b"shard", 42)
        if key is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", key), h)
        h = xxhash.xxh64_intdigest(struct.pack("<q", shard), h)
        return -1 / math.log(((h >> 11) + 0.5) / (1 << 53)), shard

    return max(map(score, range(shards)))[1]


def test_shards_recomputed(spark):
    w = {s: 1.0 for s in range(24)}
    rows = [(i, f"text {i}") for i in range(-50, 400)] + [(None, "no key"), (2**62, None)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", w, w | {24: 1.0}).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["shard"], r["grown_shard"]) == (_plain_shard(r["key"], 24), _plain_shard(r["key"], 25))


def test_one_row_repeated(spark):
    """60,000 equal rows: no block holds more than its task read, slots have no gap."""
    df = spark.range(60_000).selectExpr("cast(null as long) as doc_id", "'same' as text").repartition(12)
    got = sharding.assign(df, "doc_id", "text", {0: 1.0, 1: 1.0}, block_rows=2000)
    rows = got.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"),
                                    F.countDistinct("slot").alias("d")).collect()
    assert [(r["n"], r["a"], r["b"], r["d"]) for r in rows] == [(60_000, 0, 59_999, 60_000)]


FOLD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _fold(t):
    return FOLD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def plain_contamination(docs, items, n=10):
    grams = {}
    for i, t in items:
        ws = _fold(t)
        for k in range(len(ws) - min(n, len(ws)) + 1 if ws and i is not None else 0):
            grams.setdefault(tuple(ws[k:k + n]), set()).add(str(i))
    lengths = {len(g) for g in grams}
    out = []
    for i, t in docs:
        ws, hit, found = _fold(t), set(), set()
        for size in lengths:
            for k in range(len(ws) - size + 1):
                if (g := grams.get(tuple(ws[k:k + size]))):
                    hit.update(range(k, k + size))
                    found |= g
        out.append((str(i), len(ws), len(hit), sorted(found)))
    return sorted(out)


@pytest.fixture(scope="module")
def bench_case(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([3, 9, 10, 14, 30])))) for i in range(30)]
    items += [(30, items[0][1]), (31, None), (32, "-- !"), (33, "Only Two"), (None, "an item without id")]
    docs = []
    for i in range(200):
        ws = [r.choice(vocab) for _ in range(r.randrange(40))]
        if i % 3 == 0:
            ws[2:2] = items[r.randrange(30)][1].upper().split()
        docs.append((i, r.choice([" ", ", ", " - "]).join(ws)))
    docs += [(7, docs[7][1]), (7, "w1 other text"), (None, items[4][1]), (500, None), (501, ""), (502, "only, two only: TWO")]
    return docs, items


def test_contamination_equals_plain(spark, bench_case):
    docs, items = bench_case
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                                 spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r["id"]), r["n_words"], r["n_hit"], list(r["item_ids"])) for r in got) == plain_contamination(docs, items)


def test_windows_beyond_the_broadcast(spark, bench_case, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_BROADCAST_WINDOWS", 0)
    test_contamination_equals_plain(spark, bench_case)


def test_removed_spans_are_gone(spark, bench_case):
    docs, items = bench_case
    out = decontam.remove_spans(spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(1)),
                                spark.createDataFrame(items, "item_id long, text string"), drop_share=1.0)
    assert out.columns == ["doc_id", "text", "spans"]
    rows = out.collect()
    plain = {}
    for (i, n, hit, _), in zip(plain_contamination(docs, items)):
        plain.setdefault(i, []).append((n, hit))
    assert len(rows) == len(docs)
    got = {}
    for r in rows:
        got.setdefault(str(r["doc_id"]), []).append(len(_fold(r["text"])))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(n - hit for n, hit in x) for i, x in plain.items()}
    clean = {(i, t) for i, t in docs} - {(r["doc_id"], r["text"]) for r in rows}
    assert all(hit for i, _ in clean for _, hit in plain[str(i)][:1])


def test_decontam_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "same text here")], "item_id long, text string")
    rows = decontam.contamination(odd_docs, items).collect()
    assert len(rows) == odd_docs.count() and sum(r["n_hit"] > 0 for r in rows) == 2
    assert decontam.contamination(no_docs, items).count() == 0
    assert decontam.contamination(odd_docs, items.limit(0)).where("n_hit > 0").count() == 0
    kept = decontam.remove_spans(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2


def plain_substring(docs, window=35):
    count = {}
    cut = [(i, WORD.findall(t or "")) for i, t in docs]
    for _, ws in cut:
        for k in range(len(ws) - window + 1):
            g = tuple(ws[k:k + window])
            count[g] = count.get(g, 0) + 1
    out = []
    for i, ws in cut:
        gone = {j for k in range(len(ws) - window + 1) if count[tuple(ws[k:k + window])] > 1 for j in range(k, k + window)}
        kept = [w for j, w in enumerate(ws) if j not in gone]
        out.append((str(i), len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def passages():
    """Passages of 30 to 90 words in many places, with edits, overlaps and loops."""
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(500)]
    shared = [[r.choice(vocab) for _ in range(r.choice([30, 34, 35, 36, 40, 60, 90]))] for _ in range(14)]
    docs = []
    for i in range(160):
        ws = []
        for _ in range(r.randrange(1, 6)):
            ws += [r.choice(vocab) for _ in range(r.randrange(0, 25))]
            p = list(r.choice(shared))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = "edit"
            a = r.randrange(0, 20) if r.random() < 0.4 else 0
            ws += p[a:]
        docs.append((i, r.choice([" ", "\n", "  "]).join(ws)))
    docs += [(900, "a b " * 60), (901, "tick " * 35), (902, "tick " * 34), (903, "tock " * 36)]
    docs += [(3, docs[3][1]), (3, docs[4][1]), (None, docs[5][1]), (904, None), (905, "")]
    return docs


@pytest.mark.parametrize("anchor", [12, 35, 3])
def test_substring_equals_plain(spark, passages, anchor):
    df = spark.createDataFrame(passages, "doc_id long, text string").repartition(6)
    got = substring.remove(df, anchor=anchor, full=False).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == plain_substring(passages)


def test_substring_spans_and_tables(spark, odd_docs, no_docs, passages):
    out = substring.remove(spark.createDataFrame(passages, "doc_id long, text string")).collect()
    for r in out:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert len(r["kept_text"].split()) == r["n_words"] - r["n_removed"]
    odd = substring.remove(odd_docs)
    assert odd.count() == odd_docs.count() and odd.columns.count("spans") == 1 and "key" in odd.columns
    assert substring.remove(no_docs).count() == 0


def test_one_document_repeated(spark):
    """20,000 rows without an id and of one text: each window starts elsewhere too."""
    text = " ".join(f"w{i}" for i in range(90))
    df = spark.range(20_000).selectExpr("cast(null as long) as doc_id", f"'{text}' as text").repartition(6)
    got = substring.remove(df, full=False).groupBy("n_words", "n_removed").count().collect()
    assert [tuple(r) for r in got] == [(90, 90, 20_000)]


def test_factors_equal_their_sources(spark, passages):
    """Each factor is found word by word at its place; none goes on there."""
    df = spark.createDataFrame(passages, "doc_id long, text string").repartition(6)
    names = {r.key >> substring.PLACE_BITS: WORD.findall(r.text) for r in substring.keyed(df, "doc_id", "text").collect()
             if r.text}
    rows = substring.remove(df.withColumn("body", F.col("text"))).collect()
    n = 0
    for r in rows:
        ws = WORD.findall(r["body"] or "")
        covered = {j for f in r["factors"] for j in range(f["start"], f["end"])}
        assert covered == {j for s in r["spans"] for j in range(s["start"], s["end"])}
        for f, after in zip(r["factors"], [*r["factors"][1:], None]):
            there, length = names[f["source"]][f["source_start"]:], f["end"] - f["start"]
            assert length >= 35 and ws[f["start"]:f["end"]] == there[:length]
            assert after is None or after["start"] >= f["end"] - 34
            n += 1
    assert n > 100


def test_a_factor_takes_the_place_that_goes_on():
    at, count = np.array([10, 0, 5]), np.array([3, 5, 5])
    near, far = np.array([900, 100, 500]), np.array([210, 200, 205])
    assert substring.parse(at, count, near, far, 35) == [(0, 47, 200)]
    assert substring.parse(at, count, near, near, 35) == [(0, 39, 100), (5, 44, 500), (10, 47, 900)]
    assert substring.parse(*[np.array([], dtype=np.int64)] * 4, 35) == []


def test_one_long_copy_is_one_factor(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    df = spark.createDataFrame([(1, "head " + text), (2, text + " tail"), (3, "x")], "doc_id long, text string")
    got = {r["doc_id"]: [(f["start"], f["end"], f["source_start"]) for f in r["factors"]]
           for r in substring.remove(df).collect()}
    assert got == {1: [(1, 3001, 0)], 2: [(0, 3000, 1)], 3: []}
