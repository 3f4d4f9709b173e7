"""The join equals all pairs; its bounds hold for every linked pair."""
import random
import re

import numpy as np
import pytest

from eventide.llm import parity_join as PJ


def _set(text, k=4):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute(docs, percent):
    """{id: (sizes, component)} by all pairs; rows of one id belong together."""
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, _set(t)) for i, t in docs]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def got(df):
    return sorted((r.id, r.n_shingles, r.component) for r in df.collect())


def family(seed, n_docs, sizes):
    """Copies at many distances of a few texts of each size, passages that many
    texts share, and short texts over few words."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    passage = [r.choice(vocab) for _ in range(40)]
    docs, bases = [], [[r.choice(vocab) for _ in range(n)] for n in sizes]
    for i in range(n_docs):
        ws = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6, len(ws) // 40])):
            at = r.randrange(len(ws))
            ws[at:at + r.randint(0, 1)] = [r.choice(vocab)] * r.randint(0, 2)
        if r.random() < 0.3:
            ws = [r.choice(vocab) for _ in range(r.randint(10, 60))] + passage
        docs.append((i, " ".join(ws)))
    docs += [(n_docs + i, " ".join(r.choice("abc") for _ in range(r.randint(0, 9)))) for i in range(60)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("percent", [85, 60])
def test_equals_all_pairs(spark, percent):
    docs = family(1, 150, (9, 14, 25, 60, 130, 300, 520, 1040))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(PJ.groups(df, percent=percent)) == brute(docs, percent)


def test_small_groups_cut_into_blocks(spark):
    """With leaves of a few sets, segments are left out and large groups cut."""
    docs = family(2, 160, (30, 90, 200))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(PJ.groups(df, leaf=4, leaf_shingles=600)) == brute(docs, 85)


def test_linked_pairs_share_segments():
    r = random.Random(5)
    b = PJ.bands(85)
    for _ in range(400):
        n = r.choice([1, 3, 6, 7, 8, 20, 100, 500, 700, 1030, 3000])
        pool = np.array([r.getrandbits(64) for _ in range(2 * n + 4)], dtype=np.uint64)
        one = pool[:n]
        two = np.concatenate([one[:n - r.randint(0, n // 8)], pool[n:n + r.randint(0, n // 8 + 1)]])
        common, union = len(np.intersect1d(one, two)), len(np.union1d(one, two))
        x, y = (PJ.parity_sketches(np.sort(s), np.zeros(len(s), dtype=np.int64), np.array([len(s)]))[0] for s in (one, two))
        x, y = (np.bitwise_xor.reduce(w.reshape(-1, min(len(x), len(y)))) for w in (x, y))
        assert np.bitwise_count(x ^ y).sum() <= union - common
        if not len(two) or 100 * common < 85 * union or union == common:
            continue
        bands = b.of(np.array([len(one), len(two)]))
        assert abs(bands[0] - bands[1]) <= 1
        keys = [PJ.segment_keys(s, np.zeros(len(s), dtype=np.int64), bands.max(keepdims=True), b)[0] for s in (one, two)]
        assert len(np.intersect1d(*keys)) >= 2 * b.spare[bands.max()] + 1


def test_hot_groups(spark):
    """Many exact and near copies, and one passage in every other text."""
    r = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    docs = [(i, " ".join(base)) for i in range(400)]
    for i in range(400, 900):
        ws = list(base)
        ws[r.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(ws)))
    docs += [(i, " ".join([f"u{i}_{j}" for j in range(20)] + base[:40])) for i in range(900, 1200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert got(PJ.groups(df, leaf=100)) == sorted(
        (i, len(_set(t)), 0 if i < 900 else i) for i, t in docs)


def test_defined_cases(spark, odd_docs, no_docs):
    out = PJ.groups(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by_id = {}
    for row in out:
        by_id.setdefault(row.id, []).append(row)
    assert all(row.component is None for row in by_id[None])
    # 3 is "one" and another text, so that its rows tie their sets together
    assert {row.component for row in by_id[3]} == {3}
    assert by_id[0][0].n_shingles == by_id[1][0].n_shingles == 0 and by_id[4][0].component == by_id[5][0].component == 4
    assert by_id[6][0].n_shingles == 1
    assert PJ.groups(no_docs).count() == 0
