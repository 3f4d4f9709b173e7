"""Small plan helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# A dimension is broadcast only when it is proven to hold at most this many
# rows; above it the join stays a shuffle join (AQE may still pick broadcast
# from runtime sizes under spark.sql.autoBroadcastJoinThreshold).
MAX_BROADCAST_ROWS = 200_000


def sized_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a checked row bound (``limit(n+1).count()``)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def order_key(*parts) -> F.Column:
    """Arrival order over several columns as one sortable value: an array of
    longs, compared part by part. Nothing is packed, so no part has a limit."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.array(*[c.cast("long") for c in cols])


def require_unique(df: DataFrame, order_col: str, what: str) -> None:
    """Raise if two rows hold the same order value: every rule that keeps the
    first or last row needs one order, or rows are lost."""
    if not df.groupBy(order_col).count().where("count > 1").isEmpty():
        raise ValueError(f"{what}: the order column {order_col!r} holds the same value twice")


def with_positions(df: DataFrame, order_col: str, out_col: str = "_pos",
                   start: int = 1) -> DataFrame:
    """Dense 1-based positions in ``order_col`` order without a single-task window.

    Range-partition by the order column, number rows inside each partition,
    checkpoint (so partition ids are fixed), then add per-partition offsets
    computed from one count per partition (at most #partitions rows reach the
    driver).
    """
    ranged = (df.repartitionByRange(order_col).sortWithinPartitions(order_col)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mono", F.monotonically_increasing_id()))
    ranged = cut_lineage(ranged)
    counts = sorted((r["_pid"], r["count"]) for r in ranged.groupBy("_pid").count().collect())
    offsets, acc = [], 0
    for pid, cnt in counts:
        offsets.append((pid, acc))
        acc += cnt
    if not offsets:
        return df.withColumn(out_col, F.lit(None).cast("long")).limit(0)
    off_df = df.sparkSession.createDataFrame(offsets, "_pid int, _off long")
    return (ranged.join(F.broadcast(off_df), "_pid")
            .withColumn(out_col, F.col("_off") + (F.col("_mono") - (F.col("_pid").cast("long") * (1 << 33)))
                        + F.lit(start))
            .drop("_pid", "_mono", "_off"))


def _aqe_splits_skew(spark) -> bool:
    conf = spark.conf
    return (conf.get("spark.sql.adaptive.enabled", "true").lower() == "true"
            and conf.get("spark.sql.adaptive.skewJoin.enabled", "true").lower() == "true")


def _nulls_apart(big: DataFrame, key: str, small_key: str) -> F.Column:
    """The equality of two string keys, stated so that the rows of ``big`` without
    a key, which an outer join hands on, do not meet in one partition."""
    flat = [f"`{c}`" for c, kind in big.dtypes if kind in ("string", "int", "bigint", "date", "array<bigint>")]
    spread = F.concat(F.lit("-"), F.pmod(F.xxhash64(*flat), F.lit(4096)).cast("string"))
    return F.coalesce(F.concat(F.lit("+"), F.col(key)), spread) == F.concat(F.lit("+"), F.col(small_key))


def hot_key_join(big: DataFrame, small: DataFrame, on, key: str, small_key: str, how: str = "inner",
                 hot_rows: int = 1_000_000, max_hot: int = 1_000, force: bool = False) -> DataFrame:
    """Join a large side to a lookup with at most one row per ``key`` value
    while one key value may hold a large share of the large side.

    With AQE skew-join splitting on, Spark splits hot partitions at run time,
    and this is a plain join. Otherwise (or with ``force``), the keys holding
    at least ``hot_rows`` rows are found by one partial aggregate (at most
    ``max_hot`` keys reach the driver). Their rows join a broadcast of just the
    matching lookup rows (bounded: one per hot key), and the remaining rows take
    the normal shuffle join. Rows without a key are spread over the partitions. The union is exact for inner, left, left-semi and
    left-anti joins because both halves are split on the join key of the large
    side. ``on`` is the join condition (a Column or key list) as for
    ``DataFrame.join``; ``key`` / ``small_key`` name the join key on each side.
    """
    spark = big.sparkSession
    if how in ("left", "left_anti") and isinstance(on, Column) and dict(big.dtypes).get(key) == "string":
        on = on & _nulls_apart(big, key, small_key)
    if not force and _aqe_splits_skew(spark):
        return big.join(small, on, how)
    hot = (big.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= hot_rows)
           .orderBy(F.col("count").desc()).limit(max_hot).collect())
    if not hot:
        return big.join(small, on, how)
    keys = [r[key] for r in hot]
    is_hot = F.col(key).isin(keys)
    hot_side = big.where(is_hot)
    cold_side = big.where(~is_hot | F.col(key).isNull())
    small_hot = small.where(F.col(small_key).isin(keys))  # <= max_hot rows: one per hot key
    return hot_side.join(F.broadcast(small_hot), on, how).unionByName(cold_side.join(small, on, how))
