"""Remainders of wide hex digests, and the hashes built on them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clickloom.schemas import BLOOM_SALTS, COUNTRIES, LOCAL_ADDRESSES, LOCAL_COUNTRY

# 15 hex digits are 60 bits: the most that fits a BIGINT next to a product.
PIECE_CHARS = 15


def hex_mod(digest: Column, n_chars: int, modulus: int) -> Column:
    """``int(digest, 16) mod modulus`` in BIGINT arithmetic.

    Reads the digest in pieces; with a modulus under 2^31 every intermediate
    value stays below 2^62 + 2^60.
    """
    if not 0 < modulus < 2**31:
        raise ValueError("modulus must be between 1 and 2^31 - 1")
    rest = None
    for start in range(0, n_chars, PIECE_CHARS):
        width = min(PIECE_CHARS, n_chars - start)
        piece = F.conv(F.substr(digest, F.lit(start + 1), F.lit(width)), 16, 10).cast("bigint")
        if rest is not None:
            piece = rest * F.lit(16**width % modulus).cast("bigint") + piece
        rest = piece % F.lit(modulus).cast("bigint")
    return rest


def is_local(ip: Column) -> Column:
    """Whether an address is absent or local."""
    return ip.isNull() | (ip == "") | ip.isin(*LOCAL_ADDRESSES)


def country_of(ip: Column) -> Column:
    """Country code of an address; absent and local addresses are ``LCL``."""
    local = is_local(ip)
    slot = hex_mod(F.md5(ip.cast("binary")), 32, len(COUNTRIES)).cast("int")
    names = F.array(*[F.lit(name) for name in COUNTRIES])
    return F.when(local, F.lit(LOCAL_COUNTRY)).otherwise(F.get(names, slot))


def bloom_offsets(value: Column, bits: int) -> list[Column]:
    """One bit offset per salt, each in ``[0, bits)``."""
    return [
        hex_mod(F.sha2(F.concat(F.lit(salt), value).cast("binary"), 256), 64, bits)
        for salt in BLOOM_SALTS
    ]
