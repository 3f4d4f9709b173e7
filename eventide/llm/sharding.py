"""Sharding by weighted rendezvous hashing of stable record keys (native).

Every (record key, shard) pair gets a hash in (0, 1) and the score
``-weight / ln(hash)``; the record goes to the shard of the highest score. The
key and the shard set alone decide, so adding a shard moves only those records
whose new score is the highest, and all of them to the new shard.

Slots number a shard's rows without gaps. A shard is a fixed fraction of all
rows, far too many for one window, so each shard is cut into blocks by a second
hash; rows are numbered inside their block, and a block starts where
the sizes of the shard's earlier blocks end. The number of blocks follows the
row count. A block is chosen by key, content and the task that read the row, so
that neither a key that many rows share nor a row that is repeated very often
meets in one block. Rows with their shards are written once, so that every later
step sees them in the same blocks.

Defined cases: a null text has size 8 and CRC 0; a null key is one more key
value; repeated rows get slots of their own; an empty table gives no rows;
other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import write_table

# Rows of a block; blocks are sorted and numbered by one task each.
BLOCK_ROWS = 50_000


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """Rendezvous score of one shard for a key."""
    h = F.xxhash64(F.lit("shard"), key, F.lit(shard).cast("long"))
    # 53 bits, centred: never 0 and never 1
    unit = (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.lit(-float(weight)) / F.ln(unit)


def pick(key: Column, weights: dict[int, float]) -> Column:
    """The shard with the highest score; of equal scores the larger shard."""
    best = F.array_max(F.array(*[F.struct(score(key, s, w).alias("score"), F.lit(s).alias("shard"))
                                 for s, w in sorted(weights.items())]))
    return best["shard"].cast("int")


def assign(docs: DataFrame, key: str, text: str, weights: dict[int, float],
           grown: dict[int, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) for every row."""
    k = F.col(f"`{key}`")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(k.alias("key"), (F.octet_length(body).cast("long") + F.lit(8)).alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"))
    blocks = max(1, -(-docs.select(k).count() // (block_rows * max(1, len(weights)))))
    placed = rows.select(
        "*", pick(F.col("key"), weights).alias("shard"),
        (pick(F.col("key"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit("block"), F.col("key"), F.col("text_crc32"), F.col("size"), F.spark_partition_id()),
               F.lit(blocks)).alias("block"))
    placed = write_table(placed, "shards")
    sizes = placed.groupBy("shard", "block").count()
    before = (W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("shard", "block").orderBy("key", "text_crc32", "size")
    return (placed.withColumn("nth", F.row_number().over(inside).cast("long"))
            .join(starts, ["shard", "block"])
            .select("key", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).alias("slot"),
                    "grown_shard"))
