"""Word hashes against words made to collide under polynomial hashes."""
import numpy as np

from eventide.llm import near_dedup, quality, substring
from eventide.llm import words as WD


def crafted():
    """A word of 1,024 letters in the Thue-Morse order, and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_spans_of_every_length_differ():
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 400, dtype=np.uint8)
    pairs = [(lo, hi) for lo in range(0, 400, 3) for hi in range(lo, min(400, lo + 200))]
    starts, ends = (np.array(c) for c in zip(*pairs))
    got = WD.span_hashes(data, starts, ends)
    raw, seen = data.tobytes(), {}
    for (lo, hi), h in zip(pairs, got.tolist()):
        assert seen.setdefault(raw[lo:hi], h) == h
    assert len(set(seen.values())) == len(seen)


def test_crafted_lines_and_words(spark):
    a, b = crafted()
    fill = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"{a}\n{b}"), (2, f"{fill} {a} {fill}"), (3, f"{fill} {b} {fill}"), (4, a), (5, b)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.n_dup_lines for r in quality.clean(df, clean_text=None).collect()}[1] == 0
    assert all(r.n_removed == 0 for r in substring.remove(df, full=False).collect())
    assert {r.id: r.component for r in near_dedup.groups(df.where("doc_id > 3")).collect()} == {4: 4, 5: 5}
