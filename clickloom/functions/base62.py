"""Base62 as column arithmetic."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from clickloom.schemas import BASE62_ALPHABET

ZERO = BASE62_ALPHABET[0]
# 62^11 > 2^63, so every BIGINT has at most 11 digits.
DIGITS = 11
PAIR = 62 * 62


def encode(number: Column) -> Column:
    """Token of a non-negative BIGINT; NULL for a negative one.

    Two digits per step, from a table of all pairs; small numbers, the usual
    case, take two or four steps instead of six.
    """
    number = number.cast("bigint")
    pairs = F.split(F.lit(" ".join(a + b for a in BASE62_ALPHABET for b in BASE62_ALPHABET)), " ")

    def padded(steps: int) -> Column:
        places = [_div(number, PAIR**p) if p else number for p in range(steps - 1, -1, -1)]
        return F.concat(*[F.get(pairs, (place % PAIR).cast("int")) for place in places])

    wide = F.when(number < PAIR**2, padded(2)).when(number < PAIR**4, padded(4)).otherwise(padded(6))
    return F.when(number > 0, F.ltrim(wide, F.lit(ZERO))).when(number == 0, F.lit(ZERO))


def is_valid(token: Column) -> Column:
    """True when every character belongs to the alphabet ('' does)."""
    return F.translate(token, BASE62_ALPHABET, "") == ""


def decode(token: Column) -> Column:
    """Number of a token; NULL for a foreign character or a value over BIGINT.

    Leading zeros are insignificant, so tokens are padded to a fixed width and
    decoded as a sum of digit * 62^place without a loop.
    """
    significant = F.ltrim(token, F.lit(ZERO))
    padded = F.when(
        is_valid(token) & (F.length(significant) <= DIGITS), F.lpad(significant, DIGITS, ZERO)
    )
    by_code = F.array(*[F.lit(BASE62_ALPHABET.find(chr(code))).cast("bigint") for code in range(128)])
    digits = [
        F.get(by_code, F.ascii(F.substr(padded, F.lit(i + 1), F.lit(1)))) for i in range(DIGITS)
    ]
    # Only the first digit can take the sum over BIGINT.
    rest = reduce(add, [d * F.lit(62 ** (DIGITS - 1 - i)) for i, d in enumerate(digits) if i])
    return F.try_add(F.try_multiply(digits[0], F.lit(62 ** (DIGITS - 1))), rest)


def _div(number: Column, divisor: int) -> Column:
    return F.call_function("div", number, F.lit(divisor).cast("bigint"))
