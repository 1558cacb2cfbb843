"""A Bloom filter of one table's keys, to thin out another table before it is shuffled.

The filter is a table itself: every key has a block of ``BLOCK_BITS`` bits and ``PROBES`` bits in it, which
``bitmap_construct_agg`` sets. It is broadcast to the other table, whose keys are let through if all their bits
are set: every key that is there, and about one in a thousand of the others. What is shuffled afterwards
follows the smaller table, not the larger. ``parted`` finds a table's rows that are alone in the same way.

The size is known before it is built, from the number of keys. Beyond ``MOST_BYTES``, or if the other table is
not ``RATIO`` times as many rows, there is no filter, and the join shuffles both sides as it would without.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import spool

BLOCK_BITS = 8 * 4096  # what a bitmap holds
PROBES = 6
BITS_PER_KEY = 16
MOST_BYTES = 64 << 20
RATIO = 4
MOST_SHARED = 0.75  # of the rows, beyond which rows that are alone are not looked for


def blocks_for(keys: int) -> int:
    """Blocks of a filter for so many keys; 0 if it would be too large to broadcast."""
    blocks = max(1, -(-keys * BITS_PER_KEY // BLOCK_BITS))
    return blocks if blocks * BLOCK_BITS // 8 <= MOST_BYTES else 0


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """Places of the key's bits in its block: two steps of 15 bits from a second hash, doubly hashed."""
    second = F.xxhash64(F.lit(1), key)
    low, step = second.bitwiseAND(F.lit(BLOCK_BITS - 1)), F.shiftright(second, 20).bitwiseAND(F.lit(BLOCK_BITS - 1))
    return [(low + step * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(PROBES)]


def key_filter(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """(block, words): the filter of a column's keys, four bytes of a block to a word."""
    each = keys.where(F.col(column).isNotNull()).select(
        _block(F.col(column), blocks).alias("block"), F.explode(F.array(*_bits(F.col(column)))).alias("bit"))
    maps = each.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bits"))
    words = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 32 - 1)), lambda i: F.conv(
        F.hex(F.col("bits").substr(i * 4 + 1, F.lit(4))), 16, 10).cast("long"))
    return maps.select("block", words.alias("words"))


def marked(rows: DataFrame, column: str, built: DataFrame, blocks: int, name: str) -> DataFrame:
    """The rows with a flag: may their key be in the filter? Null keys are not."""
    key = F.col(column)
    keyed = rows.withColumn("_block", _block(key, blocks))
    known = built.withColumnRenamed("block", "_block").withColumnRenamed("words", "_words")
    inside = key.isNotNull() & F.col("_words").isNotNull()
    for bit in _bits(key):
        byte, place = F.shiftright(bit, 3).bitwiseAND(F.lit(3)), bit.bitwiseAND(F.lit(7))
        word = F.get(F.col("_words"), F.shiftright(bit, 5))
        inside = inside & F.coalesce(F.getbit(word, (F.lit(3) - byte) * 8 + place) == 1, F.lit(False))
    return keyed.join(F.broadcast(known), "_block", "left").withColumn(name, inside).drop("_block", "_words")


def let_through(rows: DataFrame, column: str, built: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key may be in the filter; null keys are not."""
    return marked(rows, column, built, blocks, "_inside").where("_inside").drop("_inside")


def thinned(rows: DataFrame, column: str, keys: DataFrame, of: DataFrame) -> DataFrame:
    """``rows``, made from ``of``, without most of those whose key is not among ``keys``, if that pays.

    ``keys`` has the same column and should be a stored table, as it is read to count it and again to build
    the filter; ``of`` is counted only.
    """
    n = keys.count()
    blocks = blocks_for(n)
    if not blocks or of.count() < RATIO * n:
        return rows
    return let_through(rows, column, key_filter(keys, column, blocks), blocks)


def parted(rows: DataFrame, key: Column, always: Column) -> tuple[DataFrame | None, DataFrame | None]:
    """``rows`` whose key no other row has, and the rest, among them those that are ``always`` to be there.

    ``rows`` should be a stored table, as it is read to count hashes of the keys, which are all that is shuffled,
    and again for each part. A filter of the hashes that occur several times tells the parts apart: what it does not
    let through is certainly alone. Null stands for a part that is empty; if the filter would be too large or most
    rows are not alone, all rows are in the rest.
    """
    hashed = rows.withColumns({"_hash": F.xxhash64(key), "_always": F.coalesce(always, F.lit(True))})
    several = spool(hashed.groupBy("_hash").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("_always").alias("always")).where("n > 1 OR always"), "several")
    keys, held = several.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not keys:
        return rows, None
    blocks = blocks_for(keys)
    if not blocks or held > MOST_SHARED * rows.count():
        return None, rows
    flagged = marked(hashed.drop("_always"), "_hash", key_filter(several, "_hash", blocks), blocks, "_met").drop("_hash")
    return flagged.where("NOT _met").drop("_met"), flagged.where("_met").drop("_met")
