"""Sharding by a two-pass external shuffle, with DataFrame functions alone.

Pass one scatters rows by seeded hashes: the id and the number of shards decide the shard (the shard of the highest
seeded hash wins, so one more shard takes rows into itself and moves no others), and a hash of the whole row decides
the bucket inside the shard.  A shard has as many buckets of ``bucket_bytes`` as its rows fill.  Pass two holds one
bucket in memory at a time, orders it by row hash, permutes it (Spark's ``shuffle`` is a Fisher-Yates shuffle, here
with a seed per bucket) and numbers its rows after those of the shard's earlier buckets.

Rows equal in every column share a hash; where such copies fill more than a bucket they are scattered by row number,
which changes nothing but the order of rows that cannot be told apart.

Defined results: null ids are one id, a null text counts no bytes, rows of one id share a shard, repeated rows are all
kept, input columns called as a result column (shard, bucket, slot, grown_shard) are replaced, columns of map type
take no part in the row hash, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabscope.functions.columns import col
from tabscope.llm.common import others
from tabscope.plans.stored import stored

RESULT = ("shard", "bucket", "slot", "grown_shard")
#: So many bucket offsets (24 bytes each) are broadcast at most; beyond, they are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash of the key is the highest."""
    hashes = F.array(*[F.xxhash64(F.lit(seed), F.lit(s), key) for s in range(shards)])
    return (F.array_position(hashes, F.array_max(hashes)) - 1).cast("int")


def _row_bytes(df: DataFrame) -> Column:
    sizes = [F.coalesce(F.octet_length(col(f.name)), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(16)
             for f in df.schema.fields]
    return sum(sizes, F.lit(0)).cast("bigint")


def shuffled(df: DataFrame, key: str = "doc_id", shards: int = 16, seed: int = 0, bucket_bytes: int = 16 << 20) -> DataFrame:
    """``df`` with shard, bucket (numbered over all shards), slot (gapless from 0 in a shard) and grown_shard.

    A task writes one bucket, rows in the order of their slots.
    """
    hashable = [col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = df.select(F.struct(*[col(c) for c in df.columns]).alias("own"), shard_of(col(key), shards, seed).alias("shard"),
                     shard_of(col(key), shards + 1, seed).alias("grown_shard"),
                     F.xxhash64(F.lit(seed), *hashable).alias("row_hash"), _row_bytes(df).alias("row_bytes"))
    sums = stored(rows.groupBy("shard", "row_hash").agg(F.sum("row_bytes").alias("bytes"), F.count("*").alias("n")), "row-hashes")
    # stored, so that Spark knows its size: one row per bucket's worth of equal rows at most
    hot = stored(sums.where((F.col("bytes") > bucket_bytes) & (F.col("n") > 1)).select(F.col("row_hash").alias("hot_hash")).distinct(), "copied-rows")
    bytes_of = {r["shard"]: r["bytes"] for r in sums.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    buckets_of = [max(1, -(-bytes_of.get(s, 0) // bucket_bytes)) for s in range(shards)]
    first_of = [sum(buckets_of[:s]) for s in range(shards)]
    n = sum(buckets_of)
    salt = F.when(F.col("hot_hash").isNotNull(), F.col("row_no"))
    own_number = F.pmod(F.xxhash64(F.lit(seed), "row_hash", salt), F.array(*map(F.lit, buckets_of))[F.col("shard")])
    scattered = (rows.withColumn("row_no", F.monotonically_increasing_id())
                 .join(hot, F.col("row_hash") == F.col("hot_hash"), "left")
                 .select("own", "shard", "grown_shard", "row_hash",
                         (F.array(*map(F.lit, first_of))[F.col("shard")] + own_number).cast("int").alias("bucket")))
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("rows"), F.first("shard").alias("of_shard"))
    before = stored(counts, "bucket-sizes").selectExpr(
        "bucket AS of_bucket", "coalesce(sum(rows) OVER (PARTITION BY of_shard ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier")
    together = (scattered.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "row_hash")
                .groupBy("bucket").agg(F.collect_list(F.struct("own", "shard", "grown_shard")).alias("held"))
                # here a partition is a bucket, and the order that its seed gives does not depend on the join
                .select("bucket", F.shuffle("held", seed).alias("held")))
    placed = (together.join(F.broadcast(before) if n <= MOST_BROADCAST else before, F.col("bucket") == F.col("of_bucket"))
              .select("bucket", "earlier", F.posexplode("held").alias("place", "row")))
    return placed.select(F.col("row.own.*"), F.col("row.shard").alias("__shard"), F.col("bucket").alias("__bucket"),
                         (F.col("earlier") + F.col("place")).cast("bigint").alias("__slot"), F.col("row.grown_shard").alias("__grown")).select(
        *others(df, RESULT), *[F.col(f"__{c}").alias(r) for c, r in zip(("shard", "bucket", "slot", "grown"), RESULT, strict=True)])


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Shards as folders of Parquet files; read in the order of their names, files and rows follow the slots."""
    shuffled(df, **options).write.partitionBy("shard").parquet(path)
