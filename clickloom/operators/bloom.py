"""A stored, mergeable Bloom filter over link tokens.

The bit array is a table of buckets of 32,768 bits (``bucket``, ``bits``), at
most ``bits / 32768`` rows whatever the number of tokens. Each row names the
filter's ``size`` and ``salts``, so that a filter is never read as another one.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.hashing import bloom_offsets
from clickloom.schemas import BLOOM_BITS, BLOOM_SALTS

BUCKET_BITS = 32_768
BROADCAST_BYTES = 64 * 1024 * 1024


def offsets(tokens: DataFrame, bits: int = BLOOM_BITS, token_col: str = "short_token") -> DataFrame:
    """Add one offset column per salt: ``offset_0``, ``offset_1``, ..."""
    columns = bloom_offsets(F.col(token_col), bits)
    return tokens.withColumns({f"offset_{i}": column for i, column in enumerate(columns)})


def build(tokens: DataFrame, bits: int = BLOOM_BITS, token_col: str = "short_token") -> DataFrame:
    """Buckets with the bits of all tokens.

    Offsets are made distinct first: a task then sends at most ``bits`` rows,
    however many tokens it read. Offsets count from 1 in the bitmap functions.
    """
    every = F.explode(F.array(*[offset + 1 for offset in bloom_offsets(F.col(token_col), bits)]))
    distinct = tokens.filter(F.col(token_col).isNotNull()).select(every.alias("_at")).distinct()
    return distinct.groupBy(F.bitmap_bucket_number("_at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("bits"),
        F.lit(bits).cast("bigint").alias("size"),
        F.lit(",".join(BLOOM_SALTS)).alias("salts"),
    )


def bits_for(tokens: int, false_positives: float = 0.01, salts: int = len(BLOOM_SALTS)) -> int:
    """The size at which so many tokens give about that rate of false positives."""
    return max(BUCKET_BITS, ceil(-salts * tokens / log(1 - false_positives ** (1 / salts))))


def size_of(buckets: DataFrame) -> int | None:
    """The size that all rows of a stored filter name; None for an empty one."""
    found = buckets.agg(F.min("size").alias("a"), F.max("size").alias("b"), F.min("salts").alias("s"), F.max("salts").alias("t")).first()
    if found["a"] != found["b"] or found["s"] != found["t"] or found["s"] not in (None, ",".join(BLOOM_SALTS)):
        raise ValueError("the rows belong to Bloom filters of different sizes or salts")
    return found["a"]


def merge(stored: DataFrame, added: DataFrame) -> DataFrame:
    """OR of two filters of the same size and salts."""
    if None not in (sizes := (size_of(stored), size_of(added))) and sizes[0] != sizes[1]:
        raise ValueError(f"Bloom filters of {sizes[0]} and {sizes[1]} bits cannot be merged")
    return stored.unionByName(added).groupBy("bucket").agg(
        F.bitmap_or_agg("bits").alias("bits"), F.min("size").alias("size"), F.min("salts").alias("salts"))


def set_bits(buckets: DataFrame) -> DataFrame:
    return buckets.agg(F.sum(F.bitmap_count("bits")).alias("bits_set"))


def _words(bitmap: Column) -> Column:
    """A bucket as 32-bit words, so that testing a bit is integer arithmetic."""
    word = F.transform(
        F.sequence(F.lit(0), F.lit(BUCKET_BITS // 32 - 1)),
        lambda i: F.conv(F.hex(F.substr(bitmap, i * 4 + 1, F.lit(4))), 16, 10).cast("bigint"),
    )
    return word


def _bit(words: Column, offset: Column) -> Column:
    """Bit ``offset`` of the bucket it falls in; an absent bucket is all zeros.

    A bitmap keeps its bits from the lowest of the first byte upwards, a word
    has its first byte highest.
    """
    place = (offset % BUCKET_BITS).cast("int")
    word = F.get(words, F.call_function("div", place, F.lit(32)).cast("int"))
    shift = F.lit(24) - F.call_function("div", place % 32, F.lit(8)).cast("int") * 8 + place % 8
    return F.coalesce(F.getbit(word, shift), F.lit(0)) == 1


def probe(tokens: DataFrame, buckets: DataFrame, token_col: str = "short_token") -> DataFrame:
    """Add ``maybe``: False means the token was certainly never added.

    ``buckets`` should be a stored table, as it is read once per salt; its rows
    say how many bits it has. One lookup per salt. The filter holds at most
    ``bits / 4`` bytes as words, so up to 64 MiB it is broadcast and rows are not
    shuffled; a larger one is joined by bucket, over which the hash spreads rows
    evenly, and only the answer goes on to the next join.
    """
    bits = size_of(buckets) or BLOOM_BITS
    small = ceil(bits / 4) <= BROADCAST_BYTES
    found = offsets(tokens, bits, token_col)
    names = [name for name in found.columns if name not in tokens.columns]
    words = buckets.select("bucket", _words(F.col("bits")).alias("words"))
    maybe = F.lit(True)
    for name in names:
        side = words.select(F.col("bucket").alias(f"_bucket_{name}"), F.col("words").alias(f"_words_{name}"))
        on = F.bitmap_bucket_number(F.col(name) + 1) == F.col(f"_bucket_{name}")
        found = found.join(F.broadcast(side) if small else side, on, "left")
        found = found.withColumn(f"_bit_{name}", _bit(F.col(f"_words_{name}"), F.col(name))).drop(f"_words_{name}", f"_bucket_{name}")
        maybe = maybe & F.col(f"_bit_{name}")
    return found.withColumn("maybe", maybe).select(*tokens.columns, "maybe")


def false_positives(probed: DataFrame, members: DataFrame, token_col: str = "short_token") -> DataFrame:
    """Filter answers against the exact set: one row of counts."""
    known = members.select(token_col, F.lit(True).alias("_known"))
    checked = probed.join(known, token_col, "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    return checked.agg(
        F.count(F.lit(1)).alias("probed"),
        F.count_if("maybe").alias("positives"),
        F.count_if(F.col("maybe") & ~F.col("_known")).alias("false_positives"),
        F.count_if(~F.col("maybe") & F.col("_known")).alias("false_negatives"),
    )
