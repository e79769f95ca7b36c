"""Scans by key over tables kept in key order. Files' and row groups' key ranges do the skipping."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def full_scan(df: DataFrame, until: Column | None = None) -> DataFrame:
    """All rows; `until` stands for a callback that ends the scan: the rows before it would, as a filter."""
    return df if until is None else df.where(~until)


def range_scan(df: DataFrame, key: str, low, high=None) -> DataFrame:
    """Rows with key >= low, and < high if given."""
    df = df.where(F.col(key) >= F.lit(low))
    return df if high is None else df.where(F.col(key) < F.lit(high))


def at_least(df: DataFrame, keys: list[str], values: list) -> DataFrame:
    """Rows whose composite key is at or after `values` in key order. The first column's bound is stated by
    itself, as only that is pushed down to the files."""
    after = F.lit(True)
    for k, v in zip(reversed(keys), reversed(values), strict=True):
        after = (F.col(k) > F.lit(v)) | ((F.col(k) == F.lit(v)) & after)
    return df.where((F.col(keys[0]) >= F.lit(values[0])) & after)


def point_lookup(df: DataFrame, **key) -> DataFrame:
    """All rows of exactly this key; none if it is absent."""
    for column, value in key.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def prefix_scan(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of one value of the leading key column."""
    return df.where(F.col(column) == F.lit(value))


def skip_scan(df: DataFrame, leading: str, values: Iterable, column: str, value) -> DataFrame:
    """Rows by the second key column, for known values of the leading one: with a table partitioned by both,
    only those partitions are read."""
    return df.where(F.col(leading).isin(*values) & (F.col(column) == F.lit(value)))


def ordered(df: DataFrame, keys: list[str], descending: bool = False) -> DataFrame:
    """Rows in key order, or against it."""
    return df.orderBy(*(F.col(k).desc() if descending else F.col(k) for k in keys))


def traverse(df: DataFrame, keys: list[str], visit: Callable) -> int:
    """Calls visit(row) in key order until it returns False; how many rows it saw. Rows come a partition at a
    time. For driver-side use on results, not for work on data."""
    seen = 0
    for row in ordered(df, keys).toLocalIterator():
        seen += 1
        if visit(row) is False:
            break
    return seen
