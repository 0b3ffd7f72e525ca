"""Rows that may be among the wanted ones, found before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits for a wanted key at least, as long as they do not exceed the most.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 26


def maybe_among(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, flag: str, most_bits: int = MOST_BITS) -> DataFrame:
    """``rows`` with a column ``flag``: false only if the row's key (a 64-bit hash) is none of the wanted.

    A bit table of the wanted keys is broadcast; its size has a bound, above
    which more rows are flagged that are not wanted. So an exact join should
    follow, which then moves few rows besides the wanted ones. Rows stay where
    they are.
    """
    bits = LEAST_BITS
    keys = wanted.count()
    while bits < min(BITS_PER_KEY * keys, most_bits):
        bits *= 2
    place = lambda k: F.pmod(k, F.lit(bits))
    word = lambda k: F.shiftright(place(k), 6)
    bit = lambda k: F.pmod(k, F.lit(64)).cast("int")
    table = wanted.select(word(wanted_key).alias("_sift_word"), bit(wanted_key).alias("_sift_bit"))
    table = table.groupBy("_sift_word").agg(F.bit_or(F.expr("shiftleft(1L, _sift_bit)")).alias("_sift_bits"))
    found = rows.join(F.broadcast(table), word(key) == F.col("_sift_word"), "left")
    held = F.coalesce(F.getbit("_sift_bits", bit(key)), F.lit(0)) == 1
    return found.withColumn(flag, held).drop("_sift_word", "_sift_bits")
