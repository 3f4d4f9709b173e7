"""The audit against plain replays of all 120 orders."""
import re
from itertools import permutations

from eventide.llm import filter_audit


def fails(rows):
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws),
                    "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                    "E": doc_id is not None and any(d is not None and d < doc_id and (u or "") == t for d, u, _ in rows)})
    return out


def brute(rows, labels):
    verdicts, out = fails(rows), {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(v, {i for i, (q, t) in enumerate(zip(("good", "toxic"), labels.get(r[0], (0, 0)))) if t == 1})
                for v, r in zip(verdicts, rows) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [m for m in left if m[0][name]]
                left = [m for m in left if not m[0][name]]
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(m[0][name] for m in mine) - len(gone),
                    sum(m[0][name] and sum(m[0].values()) == 1 for m in mine),
                    sum(0 in m[1] for m in gone), sum(1 in m[1] for m in gone), name]
        for key, row in out.items():
            if key[0] == part:
                row.append(shapley[row[-1]])
    return out


def got(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost,
                                               r.toxic_lost, r.filter, r.shapley] for r in df.collect()}


def test_equals_replay(spark):
    prose = " ".join(f"word{i}" for i in range(120))
    rows = [(5, prose, "en"), (2, prose, "de"), (9, prose, "en"), (9, prose, "en"), (2, prose, "de"), (None, prose, "en"),
            (1, prose + " A|B", "en"), (3, "SHORT TEXT", None), (4, None, "en"), (6, "", ""), (7, None, "de"),
            (8, "same " * 300, "en"), (10, prose.upper(), "en"), (11, "\x0b one\x0ctwo \r", "fr"), (12, "a b\x85c", "fr"),
            (9, "another text of nine", "de"), (None, None, None)]
    labels = {1: (1, 0), 2: (1, 1), 9: (0, 1), 5: (1, 0), 4: (None, 1), 8: (0, 0)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "*", "'x' as part", "'x' as mask", "1 as good", "2 as n", "3 as id", "4 as low")
    marks = spark.createDataFrame([(k, *v) for k, v in labels.items()] + [(2, 0, 0), (9, None, None), (None, 1, 1)],
                                  "doc_id long, quality int, toxic int")
    assert got(filter_audit.audit(docs, marks)) == brute(rows, labels)


def test_shapley_sums_to_the_grand_value(spark, odd_docs):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for (part, order, _), row in got(filter_audit.audit(odd_docs, marks)).items():
        assert row[0] >= 0 and row[7] >= 120 * row[3]
    rows = filter_audit.audit(odd_docs, marks).where("filter_order = 'ABCDE'").groupBy("part").sum().collect()
    assert rows and all(r["sum(shapley)"] == 120 * r["sum(removed)"] for r in rows)


def test_empty_table(spark, no_docs):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(no_docs, marks).count() == 0
