"""Sharding by jump consistent hashing (Lamping and Veach 2014), as column expressions.

A row's shard is a pure function of its key and the number of shards, so there is no ring table to
ship; one more shard takes rows only into itself, 1/(n+1) of them. Slots number the rows of a shard
without gaps: rows are dealt over (shard, block) by a hash of their values, numbered inside each
block and moved up by the rows of the blocks before. No task holds more than a block, and the
offsets that are broadcast are ``shards * BLOCKS`` rows, whatever the input.

Defined results: a null key hashes like the empty string; a null text counts as empty; repeated
rows get a slot each; an empty table gives no rows; columns besides the key and the text are left
alone by ``with_shard`` and dropped by ``sharded``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import staged, table

#: Multiplier of the generator that jump hashing draws from.
MULTIPLIER = 2862933555777941757
KEY = "decimal(20,0)"
SHARDS = 8
#: Hex digits of the block: 16 ** 3 blocks a shard.
BLOCK_DIGITS = 3


def hash_key(key: Column) -> Column:
    """60 bits of the md5 of the key as text, as a decimal."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast(KEY)


def jump_shard(hashed: Column, shards: int) -> Column:
    """The shard, from 0, of a hashed key. A step raises j by one at least, so ``shards`` steps do."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(s: Column, _: Column) -> Column:
        k = F.pmod(s["k"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + 1, F.expr("cast('18446744073709551616' as decimal(20,0))")).cast(KEY)
        high = F.floor(k / F.lit(1 << 33).cast("decimal(10,0)")).cast("double")
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + F.lit(1.0)))).cast("bigint")
        moved = F.struct(k.alias("k"), s["j"].alias("b"), j.alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    start = F.struct(hashed.alias("k"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def with_shard(df: DataFrame, key: str, shards: int = SHARDS, name: str = "shard") -> DataFrame:
    """df and one more column: the shard of each row's key. No shuffle."""
    return df.withColumn(name, jump_shard(hash_key(F.col(key)), shards))


def sharded(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, text_crc32, law, shard, slot and grown_shard of every row."""
    content = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key),
        (F.octet_length(content).cast("bigint") + 1).alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    )
    value = F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("text_crc32"), F.col("size"))
    placed = staged(
        narrow.withColumn("shard", jump_shard(hash_key(F.col(key)), shards))
        .withColumn("grown_shard", jump_shard(hash_key(F.col(key)), shards + 1))
        .withColumn("block", F.substring(F.md5(value.cast("binary")), 1, BLOCK_DIGITS)),
        "shards",
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "block")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("shard", "block").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    return (
        placed.withColumn("at", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "block"])
        .select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("at") - 1).alias("slot"), "grown_shard")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 7."""
    return sharded(table(spark, sf_dir, "documents"))
