"""Groups equal those of all pairs; components equal union-find."""
import random
import re

import pytest

from eventide.llm import near_dedup
from eventide.llm.components import components


def _set(text, k=5):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute(docs, percent):
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
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.fixture(scope="module")
def family():
    """A base text with copies at many distances, plus texts that share a long passage."""
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    base = [r.choice(vocab) for _ in range(150)]
    docs = []
    for i in range(120):
        ws = list(base)
        for _ in range(r.randrange(0, 9)):
            ws[r.randrange(len(ws))] = r.choice(vocab)
        docs.append((i, " ".join(ws).title() if i % 3 else " ".join(ws)))
    passage = " ".join(r.choice(vocab) for _ in range(60))
    docs += [(200 + i, passage + " " + " ".join(r.choice(vocab) for _ in range(r.randrange(3, 40)))) for i in range(60)]
    docs += [(300 + i, docs[i][1]) for i in range(20)]
    return docs


@pytest.mark.parametrize("leaf", [2048, 16])
@pytest.mark.parametrize("percent", [80, 85])
def test_groups_equal_all_pairs(spark, family, leaf, percent):
    df = spark.createDataFrame(family, "doc_id long, text string").repartition(5)
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in near_dedup.groups(df, percent=percent, leaf=leaf).collect()}
    assert got == brute(family, percent)


def test_sample_equals_all_pairs(spark, sample):
    docs = [(r["doc_id"], r["text"]) for r in sample.collect()]
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in near_dedup.groups(sample).collect()}
    assert got == brute(docs, 85)


def test_odd_tables(odd_docs, no_docs):
    rows = near_dedup.groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["id"], set()).add(r["component"])
    assert by[4] == by[5] == {4} and by[0] == {0} and by[None] == {None} and by[3] == {3}
    kept = near_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 5").count() == 0
    assert kept.where("doc_id is null").count() == 2
    assert near_dedup.groups(no_docs).count() == 0 and near_dedup.keep_one(no_docs).count() == 0


def test_trees_reach_the_target():
    assert 0.15 ** near_dedup.n_trees(85, 1e-8) <= 1e-8 and near_dedup.n_trees(80, 1e-8) > near_dedup.n_trees(85, 1e-8)


@pytest.mark.parametrize("percent", [80, 85])
def test_trees_reach_the_target_through_all_levels(spark, percent):
    j, trees = percent / 100, near_dedup.n_trees(percent)
    kept = j * (1 - (1 - j) ** near_dedup.BRANCHES) ** (near_dedup.LEVELS - 1)
    assert (1 - kept) ** trees <= near_dedup.MISS < (1 - kept) ** (trees - 1)
    # sets that agree in one tree's tokens only: they are split away by every other tree, and stay together in that one
    per = (near_dedup.LEVELS - 1) * near_dedup.BRANCHES
    n = near_dedup.n_deep(trees)
    for tree in (0, trees - 1):
        own = range(tree * per, (tree + 1) * per)
        assert own[-1] < n

        def low(i):
            return [7 if t == tree else i * 100 + t for t in range(trees)]

        rows = [(i, 10, low(i), [7 if k in own else i * 500 + k for k in range(n)]) for i in range(6)]
        rows += [(10 + i, 10, low(10 + i), [-1 - i * 500 - k for k in range(n)]) for i in range(30)]
        sets = spark.createDataFrame(rows, "id long, n long, low array<int>, deep array<smallint>")
        met = {}
        for r in near_dedup.nodes(sets, trees, leaf=8).collect():
            met.setdefault(r["node"], set()).add(r["id"])
        assert any(x == set(range(6)) for x in met.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)]
    edges += [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if x in got}
    assert {x for e in edges if e[0] != e[1] for x in e} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
