"""The pipeline's stages against plain versions of their decisions."""
import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from test_near_dedup import brute
from test_quality_pii_licenses import plain_quality, plain_spans
from test_shards_decontam_substring import plain_contamination

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    want = {r["doc_id"] for r in docs.collect() if plain_quality(r["text"])[-1]}
    good = cp.quality_rules(spark, docs, SF).cache()
    assert {r["doc_id"] for r in good.collect()} == want and good.columns == docs.columns

    kept = cp.near_duplicates(spark, good, SF).cache()
    groups = brute([(r["doc_id"], r["text"]) for r in good.collect()], 80)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in groups.items() if i == c}

    clean = cp.decontamination(spark, kept, SF).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {i: (n, hit) for i, n, hit, _ in plain_contamination([(r["doc_id"], r["text"]) for r in kept.collect()], items)}
    assert {str(r["doc_id"]) for r in clean.collect()} == {i for i, (n, hit) in before.items() if 2 * hit <= n}
    same = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert all(r["text"] == same[r["doc_id"]] for r in clean.collect() if not before[str(r["doc_id"])][1])

    hidden = cp.personal_data(spark, clean, SF).cache()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in hidden.collect():
        if plain_spans(texts[r["doc_id"]]):
            assert re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r["text"]) and not plain_spans(r["text"])
        assert r["n_chars"] == len(r["text"])
    last = cp.encoding(spark, hidden, SF)
    assert last.count() == hidden.count() and last.where(F.size("token_ids") != F.col("n_tokens")).count() == 0


def test_odd_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()
