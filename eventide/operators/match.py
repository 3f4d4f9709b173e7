"""Key sets and matching joins.

An OR condition (name = name OR url = url) would force a nested-loop join, so
every two-key match is split into two equi-joins on a normalised key. Empty
keys become NULL first: they never match and never form a hot join key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_key
from ..session import cut_lineage
from .common import hot_key_join, sized_broadcast
from .keysketch import maybe_in


def _nonempty_key(c) -> F.Column:
    k = norm_key(c)
    return F.when(k != "", k)


def key_set(df: DataFrame, col: str, out: str = "key") -> DataFrame:
    """Distinct lower-cased trimmed non-empty values of one column."""
    return df.select(_nonempty_key(F.col(col)).alias(out)).where(F.col(out).isNotNull()).distinct()


def union_keys(*sets: DataFrame, out: str = "key") -> DataFrame:
    """Set union of several one-column key sets."""
    return reduce(lambda a, b: a.unionByName(b), [s.select(F.col(s.columns[0]).alias(out)) for s in sets]).distinct()


def block_anti(df: DataFrame, name: str, url: str, blocked_names: DataFrame,
               blocked_urls: DataFrame) -> DataFrame:
    """Drop rows whose name key OR URL key is in the block lists.

    Two chained left-anti joins; the block lists are broadcast only when a
    row bound is proven.
    """
    bn = sized_broadcast(blocked_names.select(F.col(blocked_names.columns[0]).alias("_bn")))
    bu = sized_broadcast(blocked_urls.select(F.col(blocked_urls.columns[0]).alias("_bu")))
    out = (df.withColumn("_nk", _nonempty_key(F.col(name)))
           .withColumn("_uk", _nonempty_key(F.col(url))))
    out = hot_key_join(out, bn, F.col("_nk") == F.col("_bn"), "_nk", "_bn", "left_anti")
    out = hot_key_join(out, bu, F.col("_uk") == F.col("_bu"), "_uk", "_bu", "left_anti")
    return out.drop("_nk", "_uk")


def blocked_flag(df: DataFrame, name: str, url: str, blocked_names: DataFrame,
                 blocked_urls: DataFrame, out: str = "blocked") -> DataFrame:
    """J1 as a flag instead of a filter (for run metrics): two left joins
    against distinct key sets, so the row count is unchanged."""
    bn = blocked_names.select(F.col(blocked_names.columns[0]).alias("_bn")).distinct()
    bu = blocked_urls.select(F.col(blocked_urls.columns[0]).alias("_bu")).distinct()
    bn = sized_broadcast(bn.withColumn("_hn", F.lit(True)))
    bu = sized_broadcast(bu.withColumn("_hu", F.lit(True)))
    x = (df.withColumn("_nk", _nonempty_key(F.col(name)))
         .withColumn("_uk", _nonempty_key(F.col(url))))
    x = hot_key_join(x, bn, F.col("_nk") == F.col("_bn"), "_nk", "_bn", "left")
    x = hot_key_join(x, bu, F.col("_uk") == F.col("_bu"), "_uk", "_bu", "left")
    return (x.withColumn(out, F.coalesce(F.col("_hn"), F.col("_hu"), F.lit(False)))
            .drop("_nk", "_uk", "_bn", "_bu", "_hn", "_hu"))


def known_anti(df: DataFrame, name: str, known: DataFrame, sketch: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Drop rows whose name key is already known. With a stored ``sketch``
    of the known keys (``keysketch.load_sketch``), a row is tested where it lies:
    one that the sketch rules out is new and is not shuffled, only the others
    meet the keys in a join. ``df`` is written once for the two."""
    k = known.select(F.col(known.columns[0]).alias("_known"))
    x = df.withColumn("_nk", _nonempty_key(F.col(name)))
    if sketch is not None:
        x = cut_lineage(x.withColumn("_maybe", maybe_in(F.col("_nk"), *sketch)))
        new = x.where(~F.col("_maybe")).drop("_nk", "_maybe")
        probable = hot_key_join(x.where("_maybe"), k.distinct(), F.col("_nk") == F.col("_known"), "_nk", "_known", "left_anti")
        return new.unionByName(probable.drop("_nk", "_maybe"))
    return hot_key_join(x, k.distinct(), F.col("_nk") == F.col("_known"), "_nk", "_known", "left_anti").drop("_nk")


def last_row_per_key(existing: DataFrame, key_col, row_id: str = "row_id",
                     row_no: str = "row_no", out: str = "key") -> DataFrame:
    """Last existing row per non-empty key (dict-overwrite semantics);
    ``max_by`` is a hash aggregate with map-side partial aggregation."""
    return (existing.select(key_col.alias(out), row_id, row_no).where(F.col(out).isNotNull())
            .groupBy(out).agg(F.max_by(row_id, row_no).alias(row_id)))


def match_existing(incoming: DataFrame, existing: DataFrame, name: str = "name",
                   url: str = "website", row_id: str = "row_id", row_no: str = "row_no",
                   out: str = "match_row_id") -> DataFrame:
    """The existing row an incoming row updates: name key first, else
    non-empty URL key; last existing row per key. Only named existing rows
    take part (nameless rows are not read back)."""
    named = existing.where(_nonempty_key(F.col(name)).isNotNull())
    by_name = last_row_per_key(named, _nonempty_key(F.col(name)), row_id, row_no, "_mk_n") \
        .withColumnRenamed(row_id, "_rid_n")
    by_url = last_row_per_key(named, _nonempty_key(F.col(url)), row_id, row_no, "_mk_u") \
        .withColumnRenamed(row_id, "_rid_u")
    x = (incoming.withColumn("_nk", _nonempty_key(F.col(name)))
         .withColumn("_uk", _nonempty_key(F.col(url))))
    # one lookup row per key, while an incoming key may be hot
    x = hot_key_join(x, by_name, F.col("_nk") == F.col("_mk_n"), "_nk", "_mk_n", "left")
    x = hot_key_join(x, by_url, F.col("_uk") == F.col("_mk_u"), "_uk", "_mk_u", "left")
    return (x.withColumn(out, F.coalesce("_rid_n", "_rid_u"))
            .withColumn("match_by", F.when(F.col("_rid_n").isNotNull(), F.lit("name"))
                        .when(F.col("_rid_u").isNotNull(), F.lit("url")))
            .drop("_nk", "_uk", "_mk_n", "_mk_u", "_rid_n", "_rid_u"))
