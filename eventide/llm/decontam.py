"""Benchmark decontamination by a broadcast set of test n-grams (native).

Texts are folded (A-Z as a-z) and cut into words of digits, letters a-z and
anything outside ASCII. Every run of ``n`` words of a benchmark item is a
window; an item with fewer words is one window of its own length. The windows
are a table of one row each, whose size is checked before it is broadcast. Beyond
``MAX_BROADCAST_WINDOWS`` windows are joined by a shuffle, in which a document's
window is two hashes and its place; what is found is verified against the text.
Documents are scanned once: each window's key, a hash of its first, middle and
last word, is exploded and met with that table in the same stage; where a key
is found, the window is verified word by word, so only hits leave the stage.
Hits are reduced to distinct positions and
distinct windows before they are grouped by document.

Documents meet their hits on (id, hash of text), so that repeated ids do not
mix; a row that occurs several times gets the same result each time.

Defined cases: a null or wordless text has no words and no hits; a null or
wordless item has no windows; repeated items count by their distinct ids, a
null item id is no item; empty tables give no hits; extra columns are not
carried by :func:`contamination` and pass through :func:`remove_spans`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

N = 10
# About 150 bytes a row (a key and ten words): 75 MB of broadcast.
MAX_BROADCAST_WINDOWS = 500_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def fold(text: Column) -> Column:
    """A-Z as a-z and nothing else changed."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words(text: Column) -> Column:
    """The words of a folded text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BREAK), lambda w: w != "")


def window_keys(ws: Column, n: int) -> Column:
    """For each run of ``n`` words, in order, a hash of its first, middle and
    last word; none if there are fewer words."""
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(0), F.size(ws) - n), lambda i: F.xxhash64(
        ws[i], ws[i + n // 2], ws[i + (n - 1)]))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(items: DataFrame, item_id: str, text: str, n: int = N) -> DataFrame:
    """(len, h, gram, item_id) for each distinct window of each item."""
    ws = items.select(F.col(f"`{item_id}`").alias("item_id"), fold(F.col(f"`{text}`").cast("string")).alias("t"))
    ws = ws.where("item_id is not null").select("item_id", words(F.col("t")).alias("ws")).where(F.size("ws") > 0)
    ws = ws.withColumn("len", F.least(F.lit(n), F.size("ws")))
    at = F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("len") + 1)).alias("at")
    return (ws.select("item_id", "len", "ws", at)
            .select("item_id", "len", F.slice("ws", F.col("at"), F.col("len")).alias("gram"))
            .withColumn("h", F.xxhash64("gram")).distinct())


def _hits(docs: DataFrame, windows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(documents with their word counts, verified hits (key, start, len, h))."""
    grams = cut_lineage(windows.select("len", "h", "gram").distinct())
    few = grams.count() <= MAX_BROADCAST_WINDOWS
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())  # at most n values
    ws = words(fold(F.col("text")))
    counted = docs.select("id", "key", F.size(ws).cast("long").alias("n_words"))
    found = None
    for length in lengths:
        own = grams.where(F.col("len") == length).select(
            window_keys(F.col("gram"), length)[0].alias("g_key"), F.col("gram").alias("g"), "h")
        # the word array is bound once: inside a lambda it would be cut anew for each window
        both = F.transform(F.array(ws), lambda w: F.struct(w.alias("ws"), window_keys(w, length).alias("ks")))[0]
        keys = docs.select("key", both.alias("both")).select("key", F.col("both.ws").alias("ws"),
                                                               F.posexplode("both.ks").alias("start", "k"))
        if few:
            hit = (keys.join(F.broadcast(own), F.col("k") == F.col("g_key"))
                   .where(F.slice("ws", F.col("start") + 1, length) == F.col("g"))
                   .select("key", "start", F.lit(length).alias("len"), "h"))
        else:
            hit = _shuffled_hits(docs, keys, own, length)
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = docs.limit(0).select("key", F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("h"))
    return counted, found


def _shuffled_hits(docs: DataFrame, keys: DataFrame, own: DataFrame, length: int) -> DataFrame:
    """Hits of windows of one length, however many there are: only hashes are
    shuffled with the places, and the few that agree meet the texts again."""
    whole = F.xxhash64(F.slice("ws", F.col("start") + 1, length))
    found = (keys.select("key", "start", "k", whole.alias("h"))
             .join(own.withColumnRenamed("g_key", "k"), ["k", "h"]).select("key", "start", "h", "g").distinct())
    texts = docs.join(cut_lineage(found.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"])
    return (found.join(texts.select("key", words(fold(F.col("text"))).alias("ws")), "key")
            .where(F.slice("ws", F.col("start") + 1, length) == F.col("g"))
            .select("key", "start", F.lit(length).alias("len"), "h"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = docs[f"`{text}`"].cast("string")
    return docs.select(docs[f"`{doc_id}`"].alias("id"), F.struct(docs[f"`{doc_id}`"].alias("id"), F.xxhash64(t).alias("t"))
                       .alias("key"), t.alias("text"))


def spans(hits: DataFrame) -> DataFrame:
    """(key, spans): each document's hit word ranges [start, end), merged."""
    by_doc = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("len"))
                                                                         .alias("end")))).alias("ranges"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    empty = F.struct(none.alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))

    def close(a: Column) -> Column:
        return F.when(a["start"] < 0, a["done"]).otherwise(
            F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))))

    def step(a: Column, x: Column) -> Column:
        joins = (a["start"] >= 0) & (x["start"] <= a["end"])
        return F.when(joins, F.struct(a["done"].alias("done"), a["start"].alias("start"),
                                      F.greatest(a["end"], x["end"]).alias("end"))).otherwise(
            F.struct(close(a).alias("done"), x["start"].alias("start"), x["end"].alias("end")))

    return by_doc.select("key", F.aggregate("ranges", empty, step, close).alias("spans"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", n: int = N) -> DataFrame:
    """One row per document: (id, n_words, n_hit, item_ids sorted as strings,
    spans)."""
    windows = cut_lineage(benchmark_windows(items, item_id, item_text, n))
    counted, hits = _hits(_keyed(docs, doc_id, text), windows, n)
    hits = cut_lineage(hits.distinct())  # hits only: read twice
    covered = spans(hits).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"),
                                                          lambda a, x: a + x["end"] - x["start"]))
    owners = windows.select("len", "h", F.col("item_id").cast("string").alias("item"))
    items_of = (hits.select("key", "len", "h").distinct().join(owners, ["len", "h"])
                .groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("item_ids")))
    found = covered.join(items_of, "key", "left")
    return (counted.join(found, "key", "left")
            .select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "spans"))


def remove_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", n: int = N, drop_share: float = 0.5) -> DataFrame:
    """The documents without benchmark passages. A document that is hit keeps
    the text around its hit words (words and the signs that follow them go); one
    whose hit words are more than ``drop_share`` of all its words goes whole."""
    keyed = _keyed(docs, doc_id, text)
    windows = cut_lineage(benchmark_windows(items, item_id, item_text, n))
    _, hits = _hits(keyed, windows, n)
    found = spans(hits.distinct()).withColumnRenamed("key", "hit_key")
    kept = F.struct(*[docs[f"`{c}`"].alias(f"p{i}") for i, c in enumerate(docs.columns)]).alias("kept")
    t = docs[f"`{text}`"].cast("string")
    given = docs.select(kept, F.struct(docs[f"`{doc_id}`"].alias("id"), F.xxhash64(t).alias("t")).alias("key"), t.alias("body"))
    joined = given.join(found, F.col("key") == F.col("hit_key"), "left")
    # each word, as it stands with its capitals, and what follows it; and what precedes the first word
    breaks = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
    word, gap = f"[^{breaks}]+", f"[{breaks}]*"
    parts = F.regexp_extract_all("body", F.lit(f"({word}{gap})"), F.lit(1))
    lead = F.regexp_extract("body", f"^({gap})", 1)
    hit_words = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    rest = F.filter(parts, lambda p, i: ~F.exists("spans", lambda x: (x["start"] <= i) & (i < x["end"])))
    clean = F.when(F.col("spans").isNull(), F.col("body")).otherwise(F.concat(lead, F.array_join(rest, "")))
    share = F.when(F.col("spans").isNull(), F.lit(0.0)).otherwise(hit_words / F.size(parts))
    out = joined.select("kept", clean.alias("clean"), share.alias("share")).where(F.col("share") <= drop_share)
    return out.select(*[(F.col("clean") if c.lower() == text.lower() else F.col(f"kept.p{i}")).alias(c)
                        for i, c in enumerate(docs.columns)])
