"""Learning reject / prefer signals from labelled rows (A3) and applying them
as evidence (M3).

The reference asks a hosted model once per run to summarise the rejected
rows. Re-aimed as a distributed job: tokenise, document frequency per class
and category (hash aggregate with map-side combine, so a term present in
every document is no hot spot), smoothed log-odds, minimum support, top-k
per (category, side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _col, ColumnOrName
from ..session import cut_lineage
from .common import sized_broadcast

TOKEN_RE = r"\p{L}+"

# Signals up to this number are sent to the tasks as one map per category
# (about 60 bytes each); beyond it, terms and signals meet in a join.
MAX_MAP_SIGNALS = 20_000

# Signals of a category that patterns are made of.
MAX_PATTERN_SIGNALS = 16


def tokens(text: ColumnOrName) -> Column:
    """Distinct lower-cased runs of letters of any script."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_RE), 0))


def learn_signals(labelled: DataFrame, text: str = "text", category: str = "category",
                  label: str = "label", min_support: int | None = None, top_k: int | None = None,
                  alpha: float = 1.0, decimals: int = 6) -> DataFrame:
    """A3. ``labelled``: one row per document with ``label`` 0 (rejected) or 1
    (kept). Returns category, side ('reject' | 'prefer'), rank, term, weight,
    neg_df, pos_df; weight > 0 marks reject evidence. ``min_support`` (documents
    that hold a term) and ``top_k`` (terms per category and side) are off unless
    given; without ``top_k`` there is no rank."""
    docs = labelled.select(F.col(category).alias("category"), F.col(label).cast("int").alias("label"),
                           tokens(F.col(text)).alias("_toks"))
    totals = docs.groupBy("category").agg(
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).cast("long").alias("n_neg"),
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).cast("long").alias("n_pos"))
    df = (docs.select("category", "label", F.explode("_toks").alias("term"))
          .groupBy("category", "term")
          .agg(F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).cast("long").alias("neg_df"),
               F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).cast("long").alias("pos_df"))
          )
    if min_support is not None:
        df = df.where(F.col("neg_df") + F.col("pos_df") >= min_support)
    a = F.lit(float(alpha))
    x = df.join(sized_broadcast(totals), "category")  # one row per category, size-checked
    w = (F.log((F.col("neg_df") + a) / (F.col("n_neg") - F.col("neg_df") + a))
         - F.log((F.col("pos_df") + a) / (F.col("n_pos") - F.col("pos_df") + a)))
    x = x.withColumn("weight", F.round(w, decimals)).where(F.col("weight") != 0)
    x = x.withColumn("side", F.when(F.col("weight") > 0, F.lit("reject")).otherwise(F.lit("prefer")))
    if top_k is None:
        return x.select("category", "side", F.lit(None).cast("int").alias("rank"), "term", "weight", "neg_df", "pos_df")
    rank_w = Window.partitionBy("category", "side").orderBy(F.abs("weight").desc(), F.col("term"))
    return (x.withColumn("rank", F.row_number().over(rank_w)).where(F.col("rank") <= top_k)
            .select("category", "side", F.col("rank").cast("int"), "term", "weight", "neg_df", "pos_df"))


def signal_evidence(docs: DataFrame, signals: DataFrame, key: str, text: str = "text",
                    category: str = "category") -> DataFrame:
    """M3: per document, the summed weight of the learned terms it contains
    and the number of such terms (0 without a hit). The signals are worked out
    once. While they are few, each row sums them from its category's map, and
    no text is shuffled; beyond ``MAX_MAP_SIGNALS`` terms join signals and the
    sums join the documents by ``key``."""
    sig = cut_lineage(signals.select(F.col("category").alias("_cat"), F.col("term").alias("_term"), "weight"))
    if sig.limit(MAX_MAP_SIGNALS + 1).count() <= MAX_MAP_SIGNALS:
        maps = sig.groupBy("_cat").agg(F.map_from_entries(F.collect_list(F.struct("_term", "weight"))).alias("_map"))
        x = docs.join(F.broadcast(maps), F.col(category).eqNullSafe(F.col("_cat")), "left")
        hits = F.transform(F.array_intersect(tokens(F.col(text)), F.map_keys("_map")), lambda t: F.col("_map")[t])
        kind = dict(sig.dtypes)["weight"]
        return (x.withColumn("_hits", F.coalesce(hits, F.array().cast(f"array<{kind}>")))
                .withColumn("evidence", F.aggregate("_hits", F.lit(0).cast(kind), lambda a, w: a + w))
                .withColumn("n_signals", F.size("_hits").cast("long")).drop("_cat", "_map", "_hits"))
    hits = (docs.select(key, F.col(category).alias("_cat"), F.explode(tokens(F.col(text))).alias("_term"))
            .join(sig, ["_cat", "_term"])
            .groupBy(key).agg(F.sum("weight").alias("evidence"), F.count("*").cast("long").alias("n_signals")))
    return (docs.join(hits, key, "left")
            .withColumn("evidence", F.coalesce(F.col("evidence"), F.lit(0)))
            .withColumn("n_signals", F.coalesce(F.col("n_signals"), F.lit(0)).cast("long")))


def reject_patterns(labelled: DataFrame, signals: DataFrame, text: str = "text", category: str = "category",
                    label: str = "label", min_support: int = 5, top_k: int | None = 10, max_words: int = 3,
                    max_signals: int = MAX_PATTERN_SIGNALS, alpha: float = 1.0, decimals: int = 6) -> DataFrame:
    """A3: what rejected documents have in common, as sets of signal words.

    ``signals`` are terms of :func:`learn_signals`; of each category's reject
    terms the ``max_signals`` strongest are taken (the number of sets may double
    with each). The sets of two to ``max_words`` of them that at least ``min_support`` rejected documents of a category hold together
    are found by FP-growth, whose trees Spark builds for each word in its own
    task; a mark on rejected documents makes one run count both classes. A set is
    scored like a single term, by smoothed log-odds, and kept if it speaks for
    rejection. Returns category, rank, pattern (words joined by `` + ``), signals
    (the words), weight, neg_df, pos_df; the best ``top_k`` of each category, or
    all without a rank if it is None."""
    from pyspark.ml.fpm import FPGrowth

    docs = labelled.select(F.col(category).alias("category"), F.col(label).cast("int").alias("label"),
                           tokens(F.col(text)).alias("_toks"))
    docs = docs.where(F.col("label").isin(0, 1) & F.col("category").isNotNull())
    strongest = Window.partitionBy("category").orderBy(F.desc("weight"), F.col("term"))
    words = (signals.where(F.col("side") == "reject").withColumn("_n", F.row_number().over(strongest))
             .where(F.col("_n") <= max_signals).groupBy("category").agg(F.array_sort(F.collect_set("term")).alias("_terms")))
    held = docs.join(sized_broadcast(words), "category").select(
        "category", "label", F.array_intersect("_toks", "_terms").alias("_held"))
    # the items of a category carry its name, so that no set mixes two
    item = F.transform("_held", lambda t: F.concat(F.lit("t"), F.col("category"), F.lit("\x1f"), t))
    mark = F.when(F.col("label") == 0, F.array(F.lit("rejected"))).otherwise(F.array().cast("array<string>"))
    baskets = cut_lineage(held.where(F.size("_held") > 1).select(F.concat(item, mark).alias("items")))
    n = baskets.count()
    schema = "category string, rank int, pattern string, signals array<string>, weight double, neg_df long, pos_df long"
    if not n:
        return labelled.sparkSession.createDataFrame([], schema)
    # a share that means min_support baskets whatever the rounding
    found = FPGrowth(itemsCol="items", minSupport=max(min_support - 0.5, 0.5) / n).fit(baskets).freqItemsets
    terms = F.array_sort(F.filter("items", lambda i: i != "rejected"))
    sets = found.select(terms.alias("set"), F.array_contains("items", "rejected").alias("marked"), "freq") \
        .where((F.size("set") > 1) & (F.size("set") <= max_words))
    counted = (sets.groupBy("set").agg(F.max(F.when(F.col("marked"), F.col("freq"))).alias("neg_df"),
                                       F.max(F.when(~F.col("marked"), F.col("freq"))).alias("all_df"))
               .where("neg_df is not null").withColumn("pos_df", F.col("all_df") - F.col("neg_df")))
    totals = docs.groupBy("category").agg(F.sum((F.col("label") == 0).cast("long")).alias("n_neg"),
                                          F.sum((F.col("label") == 1).cast("long")).alias("n_pos"))
    split = counted.select(
        F.expr("substring(substring_index(set[0], '\x1f', 1), 2)").alias("category"),
        F.transform("set", lambda i: F.substring_index(i, "\x1f", -1)).alias("signals"), "neg_df", "pos_df")
    a = F.lit(float(alpha))
    weight = (F.log((F.col("neg_df") + a) / (F.col("n_neg") - F.col("neg_df") + a))
              - F.log((F.col("pos_df") + a) / (F.col("n_pos") - F.col("pos_df") + a)))
    out = (split.join(sized_broadcast(totals), "category").withColumn("weight", F.round(weight, decimals)).where("weight > 0")
           .withColumn("pattern", F.array_join("signals", " + ")))
    if top_k is None:
        out = out.withColumn("rank", F.lit(None).cast("int"))
    else:
        w = Window.partitionBy("category").orderBy(F.desc("weight"), F.desc("neg_df"), F.col("pattern"))
        out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    return out.select("category", F.col("rank").cast("int"), "pattern", "signals", "weight", "neg_df", "pos_df")
