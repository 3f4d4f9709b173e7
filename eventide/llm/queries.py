"""The dealt operators as queries over the driver tables.

Each ``opN_<name>`` applies its operator to the whole table with production
parameters and derives the contract's columns from the operator's output.
``SQL`` holds DuckDB twins where SQL can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (bpe_codec, decontam, filter_audit, lexical, licenses, near_dedup, parity_join, pii, quality, sharding,
               substring, token_count, warc)

Query = Callable[[SparkSession, str], DataFrame]
Q: dict[str, Query] = {}
SQL: dict[str, str] = {}

N_SHARDS = 24


def query(fn: Query) -> Query:
    Q[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocab_file() -> str:
    """The public vocabulary file of ops 1 and 7."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# -------------------------------------------------------- op1: token counts

@query
def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the compiled transducer."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return token_count.count_tokens(docs, vocab_file()).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


# ----------------------------------------------------- op2: near duplicates

@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked at a Jaccard similarity of 0.85."""
    got = near_dedup.groups(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
                      F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL["op2_near_dedup"] = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_AZ}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id),
e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""


# ---------------------------------------------------------------- op3: WARC

@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as segmented WARC archives, read back and reassembled."""
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                               "refers_to", "state")


SQL["op3_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to, 'ok' AS state
FROM w
"""


# ------------------------------------------------------- op4: quality rules

@query
def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first quality verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.clean(docs, clean_text=None).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_lines_removed", "chars_removed")


_STOP = r"""'[.!?"'')\]:;…”’»。！？]$'"""
# The phrases of page furniture, stated here for the SQL alone.
_FURNITURE = ("all rights reserved", "cookie policy", "use cookies", "privacy policy", "terms of use", "terms of service",
              "enable javascript", "lorem ipsum", "sign up for our newsletter", "subscribe to our newsletter", "click here",
              "read more", "skip to content", "powered by wordpress")
_N_PHRASES = " + ".join(f"(len(low) - len(replace(low, '{p}', ''))) // {len(p)}" for p in _FURNITURE)
SQL["op4_line_quality"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS win
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY r),
l0 AS (SELECT r, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
l1 AS (SELECT r, k, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw FROM l0
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
l2 AS (SELECT r, l, len(lw) AS n, {_AZ.replace("coalesce(text, '')", "l")} AS low, len(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS chars,
              len(l) - len(regexp_replace(l, '[#*$%&|<>]', '', 'g')) AS syms,
              len(l) - len(regexp_replace(l, '[|<>]', '', 'g')) AS bars,
              len([x for x in lw if regexp_matches(x, {_STOP})]) AS stops,
              row_number() OVER (PARTITION BY r, l ORDER BY k) > 1 AS dup FROM l1),
l3 AS (SELECT *, stops = 0 OR (bars >= 2 AND 100 * bars > 3 * chars) OR dup OR 100 * syms > 10 * chars
              OR ({_N_PHRASES} > 0 AND 20 * ({_N_PHRASES}) >= n) AS bad FROM l2),
ls AS (SELECT r, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad, count(*) FILTER (dup) AS n_dup,
              coalesce(sum(chars) FILTER (bad), 0) AS lost FROM l3 GROUP BY r),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_bad, 0) AS BIGINT) AS n_lines_removed,
             CAST(coalesce(lost, 0) AS BIGINT) AS chars_removed
      FROM w LEFT JOIN ls USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND 100 * chars_removed <= 50 * word_chars AS kept FROM f
"""


# ------------------------------------------------------ op5: licence scan

@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document's sentences show."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _license_sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in licenses.SENTENCES.items())
    steps, before = [], "coded"
    for n, (seq, name) in enumerate(licenses.RULES):
        code = "".join(f"<{i}>" for i in seq)
        held = f"contains(rest, '{code}')" + (" AND len(found) = 0" if name == "Proprietary" else "")
        steps.append(f"r{n} AS (SELECT r, ids, CASE WHEN {held} THEN replace(rest, '{code}', '|') ELSE rest END AS rest, "
                     f"CASE WHEN {held} THEN list_append(found, '{name}') ELSE found END AS found FROM {before})")
        before = f"r{n}"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
known(s, id) AS (VALUES {known}),
c AS (SELECT r, regexp_replace(regexp_replace(t, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'),
                               '[ \t\r]*\n[ \t\r\n]*([^a-z \t\r\n])', chr(1) || '\1', 'g') AS t FROM d),
p AS (SELECT r, unnest(string_split(t, chr(1))) AS s, generate_subscripts(string_split(t, chr(1)), 1) AS k FROM c),
n AS (SELECT r, k, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s FROM p),
ids AS (SELECT r, list(id ORDER BY k) AS ids FROM n JOIN known USING (s) GROUP BY r),
coded AS (SELECT r, ids, array_to_string([concat('<', x, '>') for x in ids], '') AS rest, CAST([] AS VARCHAR[]) AS found
          FROM ids),
{", ".join(steps)}
SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_known,
       coalesce(array_to_string(ids, ' '), '') AS identifiers,
       coalesce(array_to_string(list_sort(list_distinct(found)), ','), '') AS licenses,
       coalesce(regexp_replace(regexp_replace(replace(rest, '|', ''), '><', ' ', 'g'), '[<>]', '', 'g'), '') AS unmatched
FROM d LEFT JOIN {before} USING (r)
"""


SQL["op5_license_scan"] = _license_sql()


# ------------------------------------------------------ op6: personal data

@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans and the method's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.fit(docs), redacted=None).select(
        "doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256", "spans")


# ------------------------------------------------- op7: BPE encode, decode

@query
def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of their decoding."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec.encode(docs, vocab_file(), full=False)


# ------------------------------------------------------------ op8: sharding

@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over 24 shards by rendezvous hashing of the document id."""
    weights = {s: 1.0 for s in range(N_SHARDS)}
    out = sharding.assign(table(spark, sf_dir, "documents"), "doc_id", "text", weights, weights | {N_SHARDS: 1.0})
    return out.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                      "grown_shard")


# ------------------------------------------------------ op9: decontamination

@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words found in every document."""
    got = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL["op9_decontamination"] = rf"""
WITH b AS (SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + 9], ' ') AS win
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
       FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n)),
h AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, win)),
p AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
q AS (SELECT r, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM h GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)
"""


# ---------------------------------------------------- op10: substring dedup

@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document outside the passages of 35 words that repeat."""
    return substring.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), full=False)


SQL["op10_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS win
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
twice AS (SELECT win FROM w GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM w SEMI JOIN twice USING (win)),
k AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM k ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


# --------------------------------------------- op11: filter interaction audit

@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps and Shapley values of five filters in all orders, for each language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op11_filter_audit"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS MATERIALIZED (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
          100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t), regexp_matches(t, '[#$%&*|]'),
          coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN l USING (doc_id)),
orders(o) AS (SELECT '' UNION ALL SELECT o || c FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c)
              WHERE NOT contains(o, c)),
steps AS (SELECT o AS filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM orders WHERE len(o) = 5),
kinds AS MATERIALIZED (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT part, filter_order, step, filter_order[step] AS filter, n, good, toxic, fails,
             fails[ascii(filter_order[step]) - 64] AS own,
             len([c FOR c IN string_split(filter_order[1:step - 1], '') IF c <> '' AND fails[ascii(c) - 64]]) > 0 AS gone
      FROM kinds, steps),
r AS (SELECT part, filter_order, step, filter,
             CAST(coalesce(sum(n) FILTER (NOT gone AND NOT own), 0) AS BIGINT) AS kept,
             CAST(coalesce(sum(n) FILTER (NOT gone AND own), 0) AS BIGINT) AS removed,
             CAST(coalesce(sum(n) FILTER (gone AND own), 0) AS BIGINT) AS redundant,
             CAST(coalesce(sum(n) FILTER (own AND len([y FOR y IN fails IF y]) = 1), 0) AS BIGINT) AS unique_fails,
             CAST(coalesce(sum(n) FILTER (NOT gone AND own AND good = 1), 0) AS BIGINT) AS good_lost,
             CAST(coalesce(sum(n) FILTER (NOT gone AND own AND toxic = 1), 0) AS BIGINT) AS toxic_lost
      FROM x GROUP BY ALL)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
"""


# --------------------------------------------------- op12: ranked search

@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    index = lexical.build(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark"))


SQL["op12_ranked_search"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
c AS (SELECT count(*) AS n_docs, sum(len(ws)) AS n_terms FROM d WHERE len(ws) > 0),
t AS MATERIALIZED (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM t, c GROUP BY term, n_docs),
s AS (SELECT item_id, r, doc_id,
             CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN t USING (term) JOIN w USING (term), c GROUP BY ALL),
x AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT * FROM x WHERE rank <= 50
"""


# ------------------------------------------------- op13: n-gram Jaccard join

@query
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the links at a Jaccard similarity of 0.85 on four-word shingles."""
    got = parity_join.groups(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


SQL["op13_jaccard_join"] = (SQL["op2_near_dedup"].replace("ws[i:i + 4]", "ws[i:i + 3]")
                            .replace("greatest(len(ws) - 3, 2)", "greatest(len(ws) - 2, 2)")
                            .replace("component_id,\n       d.doc_id <= coalesce(m, d.doc_id) AS kept", "component_id"))
