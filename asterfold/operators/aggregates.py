"""Sums, counts and distinct values; and the partial and final form of a grouped sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def partial_sums(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.sum(F.col(value).cast("long")).alias("partial"))


def final_sums(parts: list[DataFrame], groups: list[str], name: str) -> DataFrame:
    """The sums over all rows of all parts, from each part's own sums."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy(*groups).agg(F.sum("partial").cast("long").alias(name))


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows, checksum: equal for tables of equal rows in any order (sum of CRC-32 over the joined values)."""
    row = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns or df.columns))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.crc32(row)), F.lit(0)).alias("checksum"))
