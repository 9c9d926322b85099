"""Blocked Bloom filter as a small table: eight 64-bit lanes a block, of which a key sets one bit each.

The number of blocks follows the number of keys, up to MAX_BLOCKS rows of 72 bytes (19 MB), so it can always be broadcast.
Up to MAX_KEYS keys at most one in forty of the other keys passes; for more keys there is no filter and everything passes
(``blocks_for`` is 0), as a filter that full would keep nothing out. An exact join must follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 18
LANES = 8
KEYS_PER_BLOCK = 32
MAX_KEYS = 2 * KEYS_PER_BLOCK * MAX_BLOCKS
_WORDS = [f"b_word{j}" for j in range(LANES)]


def blocks_for(n_keys: int) -> int:
    """Blocks for so many keys; 0 if they are too many for a filter."""
    if n_keys > MAX_KEYS:
        return 0
    return min(MAX_BLOCKS, 1 << (max(0, n_keys - 1) // KEYS_PER_BLOCK).bit_length())


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _bits(key: Column) -> list[Column]:
    mixed = F.xxhash64(key, F.lit(1))
    places = [F.shiftrightunsigned(mixed, 6 * j).bitwiseAND(F.lit(63)).cast("int") for j in range(LANES)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places]


def bloom(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """One row for each used block."""
    words = [F.bit_or(b).alias(w) for b, w in zip(_bits(F.col(key)), _WORDS, strict=True)]
    return keys.groupBy(_block(F.col(key), n_blocks).alias("b_block")).agg(*words)


def with_maybe(df: DataFrame, key: str, words: DataFrame, n_blocks: int) -> DataFrame:
    """Append b_maybe: false only if the key is not in the filter. A null key is not."""
    hit = F.col(key).isNotNull()
    for b, w in zip(_bits(F.col(key)), _WORDS, strict=True):
        hit = hit & (F.col(w).bitwiseAND(b) == b)
    df = df.withColumn("b_block", _block(F.col(key), n_blocks)).join(F.broadcast(words), "b_block", "left")
    return df.withColumn("b_maybe", F.coalesce(hit, F.lit(False))).drop("b_block", *_WORDS)


def possible(df: DataFrame, key: str, keys: DataFrame, n_keys: int) -> DataFrame:
    """Rows of df whose key may be among the n_keys keys; all rows if these are too many for a filter."""
    n = blocks_for(n_keys)
    return with_maybe(df, key, bloom(keys, key, n), n).filter("b_maybe").drop("b_maybe") if n else df
