"""Feature hashing of terms: bucket and sign from a digest, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 512


#: Hexadecimal digits of even numbers.
_EVEN = tuple("02468ace")


def bucket(term: Column, dim: int = DIM) -> Column:
    """The digest's first four bytes, least first, modulo ``dim``."""
    first = F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long")
    byte = lambda k: F.shiftright(first, 8 * (3 - k)).bitwiseAND(255)
    return (sum((F.shiftleft(byte(k), 8 * k) for k in range(1, 4)), byte(0)) % dim).cast("int")


def sign(term: Column) -> Column:
    """By the parity of the digest's fifth byte."""
    return F.when(F.substring(F.md5(term), 10, 1).isin(*_EVEN), 1.0).otherwise(-1.0)
