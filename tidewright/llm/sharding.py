"""Sharding by jump consistent hashing, as DataFrame functions only.

A row's shard depends on its key and the number of shards alone, so no table of
ring positions exists anywhere. When a shard is appended, the rows that move are
exactly those that the new shard takes (1/(n+1) of them), and no others.

The generator is the 64-bit linear congruential one of the published algorithm,
in ``decimal(38,0)`` arithmetic because SQL multiplication does not wrap.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the published algorithm.
MULTIPLIER, WRAP, SHIFT, UNIT = 2862933555777941757, 1 << 64, 1 << 33, float(1 << 31)
#: Jumps evaluated before the rare rows that need more take the full loop.
SHORT = 64
#: Rows of a shard are numbered in this many parts; a prime, so that regular keys spread.
PARTS = 1009


def key_seed(key: Column, kind: T.DataType) -> Column:
    """Unsigned 64-bit seed: integers stand for themselves, other keys are hashed, null is 0."""
    number = key if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else F.when(key.isNotNull(), F.xxhash64(key))
    seed = number.cast("decimal(20,0)")
    return F.coalesce(F.when(seed < 0, seed + F.lit(Decimal(WRAP))).otherwise(seed), F.lit(0).cast("decimal(20,0)")).cast("decimal(20,0)")


def jump_hash(seed: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a seed made by :func:`key_seed`."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    wrap, times = F.lit(Decimal(WRAP)), F.lit(Decimal(MULTIPLIER))

    def jump(s: Column, _i: Column) -> Column:
        key = ((s["key"] * times + F.lit(1).cast("decimal(1,0)")) % wrap).cast("decimal(20,0)")
        unit = F.floor(key / F.lit(SHIFT).cast("decimal(10,0)")).cast("double") + F.lit(1.0)
        to = F.floor((s["at"] + F.lit(1)).cast("double") * (F.lit(UNIT) / unit)).cast("long")
        return F.when(s["at"] < F.lit(shards), F.struct(s["at"].alias("last"), to.alias("at"), key.alias("key"))).otherwise(s)

    start = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("at"), seed.alias("key"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, SHORT))), start, jump)
    if shards > SHORT:
        state = F.when(state["at"] >= shards, state).otherwise(F.aggregate(F.sequence(F.lit(SHORT + 1), F.lit(shards)), state, jump))
    return state["last"].cast("int")


def with_shard(df: DataFrame, key: str, shards: int, column: str = "shard") -> DataFrame:
    """``df`` with the shard of each row. Null keys share the shard of seed 0."""
    return df.withColumn(column, jump_hash(key_seed(df[key], df.schema[key].dataType), shards))


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``df``: key, ``keep`` columns, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text plus one; a null text has length 0
    and crc32 0. ``slot`` numbers a shard's rows from 0 without gaps: rows are
    ordered by (seed mod 1009, seed, size, crc), so repeated rows and ties get
    neighbouring slots and each part is numbered by a task of its own after a
    count per part. Rows with a null key go to the shard of seed 0. An empty
    table gives an empty result; columns other than those named are ignored.
    """
    data = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    seed = key_seed(df[key], df.schema[key].dataType)
    at = df.select(
        F.col(key), *[F.col(c) for c in keep], (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"), jump_hash(seed, shards).alias("shard"), jump_hash(seed, shards + 1).alias("grown_shard"), seed.alias("__seed"),
    ).withColumn("__part", (F.col("__seed") % F.lit(PARTS).cast("decimal(10,0)")).cast("int"))
    counts = df.select(jump_hash(seed, shards).alias("shard"), (seed % F.lit(PARTS).cast("decimal(10,0)")).cast("int").alias("__part")).groupBy("shard", "__part").count()
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__part").orderBy("__seed", "size", "text_crc32")
    numbered = at.withColumn("__n", F.row_number().over(inside))
    # starts has at most shards * PARTS rows
    out = numbered.join(F.broadcast(starts), ["shard", "__part"])
    return out.select(key, *keep, "size", "text_crc32", "law", "shard", (F.col("__start") + F.col("__n") - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = 8, files: int = 4) -> None:
    """Write ``df`` as ``path/shard=k``, with ``files`` files per shard so that no shard is one task."""
    out = with_shard(df, key, shards)
    spread = F.pmod(F.xxhash64(*[F.col(key)]), F.lit(files))
    out.repartition(shards * files, "shard", spread).write.partitionBy("shard").parquet(path)
