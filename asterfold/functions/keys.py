"""Keys: packing, sparse numbering, string codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def packed_key(orderkey: str, linenumber: str) -> Column:
    """(orderkey << 8) + linenumber as a long."""
    return F.shiftleft(F.col(orderkey).cast("long"), 8) + F.col(linenumber)


def unpacked_order(packed: str) -> Column:
    return F.shiftright(F.col(packed), 8)


def unpacked_line(packed: str) -> Column:
    return F.col(packed).bitwiseAND(F.lit(255)).cast("int")


def sparse_key(sequence: str) -> Column:
    """Order keys use the first 8 of every 32 numbers."""
    return F.expr(f"({sequence} div 8) * 32 + {sequence} % 8")


def to_int(text: str) -> Column:
    """The number a text is, or 0."""
    return F.coalesce(F.expr(f"try_cast(trim({text}) as int)"), F.lit(0))


def padded(text: str, length: int) -> Column:
    """Cut or filled up with spaces to a fixed width."""
    return F.rpad(F.col(text), length, " ")


def string_hash(text: str, buckets: int) -> Column:
    """A bucket of a string; which one is the engine's affair."""
    return F.pmod(F.xxhash64(text), F.lit(buckets))


def tuple_compare(left: list[str], right: list[str]) -> Column:
    """-1, 0 or 1: composite keys in key order."""
    out = F.lit(0)
    for a, b in zip(reversed(left), reversed(right), strict=True):
        out = F.when(F.col(a) < F.col(b), -1).when(F.col(a) > F.col(b), 1).otherwise(out)
    return out
