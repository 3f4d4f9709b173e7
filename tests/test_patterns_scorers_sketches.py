"""Reject patterns, user scorers and key sketches against plain Python."""
import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from eventide.operators import keysketch as S
from eventide.operators.classify import model_scorer
from eventide.operators.match import key_set, known_anti
from eventide.operators.patterns import reject_patterns


def test_reject_patterns(spark):
    r = random.Random(8)
    terms = ["alpha", "beta", "gamma", "delta", "été"]
    rows = [(c, int(r.random() < 0.5), " ".join(t for t in terms + ["noise", "more"] if r.random() < 0.6).title())
            for c in ("x", "y") for _ in range(60)] + [(None, 0, "alpha beta"), ("x", None, "alpha beta"), ("z", 0, "alpha beta")]
    docs = spark.createDataFrame(rows, "category string, label int, text string")
    signals = spark.createDataFrame([(c, "reject", t, 1.0) for c in ("x", "y") for t in terms] + [("x", "prefer", "noise", -1.0)],
                                    "category string, side string, term string, weight double")
    want = {}
    for c in ("x", "y"):
        mine = [(label, set((t or "").lower().split())) for cat, label, t in rows if cat == c and label is not None]
        n = [sum(label == k for label, _ in mine) for k in (0, 1)]
        for size in (2, 3):
            for combo in combinations(sorted(terms), size):
                neg, pos = (sum(label == k and set(combo) <= ws for label, ws in mine) for k in (0, 1))
                weight = round(math.log((neg + 1) / (n[0] - neg + 1)) - math.log((pos + 1) / (n[1] - pos + 1)), 6)
                if neg >= 4 and weight > 0:
                    want[c, " + ".join(combo)] = (neg, pos, weight)
    got = reject_patterns(docs, signals, min_support=4, top_k=None).collect()
    assert {(r.category, r.pattern): (r.neg_df, r.pos_df, round(r.weight, 6)) for r in got} == want and want
    assert all(r.pattern == " + ".join(r.signals) and r["rank"] is None for r in got)
    top = reject_patterns(docs, signals, min_support=4, top_k=1).collect()
    assert {(r.category, r["rank"]) for r in top} == {(c, 1) for c in {k[0] for k in want}}
    assert reject_patterns(docs.limit(0), signals).count() == 0


def test_scorer_marks_failed_rows(spark):
    def stubborn():
        """Raises on a batch that holds a 7, and on the row itself."""
        def model(rows):
            import pandas as pd

            if (rows["n"] % 10 == 7).any():
                raise RuntimeError("seven")
            return pd.DataFrame({"relevant": rows["n"] % 2 == 0, "fit_score": rows["n"]})

        return model

    def unloadable():
        raise OSError("no such model")

    df = spark.range(300).select(F.col("id").alias("n"), F.concat(F.lit("t"), "id").alias("text")).repartition(3)
    got = model_scorer(stubborn, ["n"], "relevant boolean, fit_score long")(df).collect()
    assert len(got) == 300
    for row in got:
        if row.n % 10 == 7:
            assert row.relevant is None and row.fit_score is None and row.score_error == "RuntimeError: seven"
        else:
            assert row.relevant == (row.n % 2 == 0) and row.fit_score == row.n and row.score_error is None
    failed = model_scorer(unloadable, ["n"], "relevant boolean")(df).collect()
    assert len(failed) == 300 and {r.score_error for r in failed} == {"OSError: no such model"}
    assert model_scorer(stubborn, ["n"], "relevant boolean, fit_score long")(df.limit(0)).count() == 0


@pytest.mark.parametrize("n_bits", [S.MIN_BITS, 1 << 10])
def test_sketch_never_loses_a_key(spark, tmp_path, n_bits):
    a = spark.range(0, 3000).select(F.concat(F.lit("k"), "id").alias("key"))
    b = spark.range(2000, 5000).select(F.concat(F.lit("k"), "id").alias("key")).unionByName(spark.sql("select cast(null as string) key"))
    S.save_sketch(S.merged(S.sketch(a, n_bits), S.sketch(b, n_bits)), n_bits, str(tmp_path / "s"))
    stored, size = S.load_sketch(spark, str(tmp_path / "s"))
    whole = S.sketch(a.unionByName(b), n_bits)
    assert size == n_bits and sorted(map(tuple, stored.collect())) == sorted(map(tuple, whole.collect()))
    probe = spark.range(0, 20_000).select("id", F.concat(F.lit("k"), "id").alias("key"))
    hits = {r.id for r in probe.where(S.maybe_in(F.col("key"), stored, size)).collect()}
    assert set(range(5000)) <= hits
    if n_bits == S.MIN_BITS:
        assert len(hits) < 5000 + 15_000 * 0.05
    cand = probe.select(F.col("id").alias("ord"), F.concat(F.lit(" "), F.upper("key")).alias("name")) \
        .unionByName(spark.createDataFrame([(-1, ""), (-2, None)], "ord long, name string"))
    known = key_set(a.unionByName(b).withColumnRenamed("key", "name"), "name")
    plain, tested = known_anti(cand, "name", known), known_anti(cand, "name", known, (stored, size))
    assert sorted(r.ord for r in tested.collect()) == sorted(r.ord for r in plain.collect())
    assert plain.columns == tested.columns


def test_empty_sketch(spark, tmp_path):
    none = spark.createDataFrame([], "key string")
    S.save_sketch(S.sketch(none, 1 << 16), 1 << 16, str(tmp_path / "s"))
    stored, size = S.load_sketch(spark, str(tmp_path / "s"))
    assert spark.range(5).selectExpr("string(id) key").where(S.maybe_in(F.col("key"), stored, size)).count() == 0
