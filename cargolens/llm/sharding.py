"""Shards by jump consistent hashing, in DataFrame functions only.

Every key follows its own pseudo-random walk of jumps over shard numbers and stays where the next jump
would leave the ``shards`` there are. Appending a shard moves only the keys whose walk lands on it, about
one in ``shards + 1``; no table of the ring is kept. (Lamping and Veach, 2014.)

Defined cases: a null key walks as key 0; null text has size 1 and the checksum of no bytes; equal rows
keep a slot each; an empty table gives no rows; other columns of the input are kept unless they carry the
name of a result column, which is then replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from .shared import cut_lineage, normal_text

#: Fixed values of the published method: the multiplier of its generator.
MULTIPLIER = 2862933555777941757
#: A walk over n shards takes ln n + 1 jumps on average; one that is longer than this is an error, not a guess.
LONGEST_WALK = 256

_LIMB = 22
_MASK = (1 << _LIMB) - 1


def _step(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64, in limbs of 22 bits so that no product overflows."""
    low = [(MULTIPLIER >> (_LIMB * i)) & _MASK for i in range(3)]
    part = [F.shiftrightunsigned(key, _LIMB * i).bitwiseAND(F.lit(_MASK)) for i in range(3)]
    first = part[0] * F.lit(low[0]) + F.lit(1)
    second = part[0] * F.lit(low[1]) + part[1] * F.lit(low[0]) + F.shiftright(first, _LIMB)
    third = (part[0] * F.lit(low[2]) + part[1] * F.lit(low[1]) + part[2] * F.lit(low[0])
             + F.shiftright(second, _LIMB))
    return (first.bitwiseAND(F.lit(_MASK))
            .bitwiseOR(F.shiftleft(second.bitwiseAND(F.lit(_MASK)), _LIMB))
            .bitwiseOR(F.shiftleft(third, 2 * _LIMB)))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key among ``shards``."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def jump(state: Column, _: Column) -> Column:
        after = _step(state["key"])
        span = F.shiftrightunsigned(after, 33) + F.lit(1)
        target = F.floor((state["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / span.cast("double")))
        return (F.when(state["next"] >= shards, state)
                .otherwise(F.struct(state["next"].alias("at"), target.cast("bigint").alias("next"),
                                    after.alias("key"))))

    start = F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("next"),
                     F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint")).alias("key"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, LONGEST_WALK))), start, jump,
                      lambda s: F.when(s["next"] >= shards, s["at"]))
    return F.coalesce(end, F.raise_error(F.lit("a walk is longer than expected"))).cast("int")


def stable_key(df: DataFrame, column: str) -> Column:
    """Integers are their own key; any other type is hashed first."""
    if isinstance(df.schema[column].dataType, IntegralType):
        return F.col(column).cast("bigint")
    return F.xxhash64(column)


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """The rows with size, text_crc32, law, shard and grown_shard; nothing is shuffled."""
    made = {"size", "text_crc32", "law", "shard", "grown_shard"}
    walk = stable_key(df, key)
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in made],
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(normal_text(text).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        jump_hash(walk, shards).alias("shard"), jump_hash(walk, shards + 1).alias("grown_shard"))


def number_slots(rows: DataFrame, order: str = "doc_id") -> DataFrame:
    """Add ``slot`` to rows with a shard: gapless from 0 in each. Give it narrow rows, as they are written once.

    No shard and no key is numbered by one task: the partition that read a row is frozen by a reliable
    checkpoint, totals of (partition, shard) give each its first slot, and inside it the order is that of the key.
    """
    dealt = cut_lineage(rows.withColumn("_chunk", F.spark_partition_id()))
    totals = dealt.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", "_chunk", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_chunk", "shard").orderBy(order)
    numbered = dealt.withColumn("_in", F.row_number().over(inside))
    return (numbered.join(totals, ["shard", "_chunk"])
            .withColumn("slot", (F.col("_first") + F.col("_in") - 1).cast("bigint"))
            .drop("_chunk", "_first", "_in"))


def write_shards(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", shards: int = 8) -> None:
    """Write the rows to one folder for each shard."""
    assign_shards(df, key, text, shards).write.partitionBy("shard").parquet(folder)
