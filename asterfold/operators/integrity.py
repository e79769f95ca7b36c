"""Key checks and subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(fact: DataFrame, key: str, dimension: DataFrame, dimension_key: str) -> DataFrame:
    """Distinct key values of the fact table that the dimension lacks. Keys are made distinct before the join."""
    keys = fact.select(F.col(key).alias("orphan")).where("orphan is not null").distinct()
    return keys.join(dimension, F.col("orphan") == F.col(dimension_key), "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_rows(fact: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows in key order."""
    return fact.orderBy(*keys).limit(n)


def used_only(dimension: DataFrame, dimension_key: str, fact: DataFrame, key: str) -> DataFrame:
    """The dimension's rows that the fact rows refer to."""
    return dimension.join(fact.select(F.col(key).alias("_used")).distinct(), F.col(dimension_key) == F.col("_used"), "left_semi")
