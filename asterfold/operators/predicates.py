"""Search conditions on one column, as the column store's scans take them."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize(key: str, length: int | None = None) -> str:
    """A string key as it is compared: without NUL padding; longer than `length` is an error."""
    key = key.rstrip("\x00")
    if length is not None and len(key.encode()) > length:
        raise ValueError(f"{key!r} is longer than {length}")
    return key


def _key(value: Any) -> Any:
    return normalize(value) if isinstance(value, str) else value


@dataclass(frozen=True)
class SearchCond:
    """=, <, >, <=, >=, BETWEEN (inclusive) or IN. Strings compare by their bytes."""

    kind: str
    keys: tuple

    @staticmethod
    def equal(key) -> SearchCond:
        return SearchCond("=", (_key(key),))

    @staticmethod
    def less(key) -> SearchCond:
        return SearchCond("<", (_key(key),))

    @staticmethod
    def greater(key) -> SearchCond:
        return SearchCond(">", (_key(key),))

    @staticmethod
    def at_most(key) -> SearchCond:
        return SearchCond("<=", (_key(key),))

    @staticmethod
    def at_least(key) -> SearchCond:
        return SearchCond(">=", (_key(key),))

    @staticmethod
    def between(low, high) -> SearchCond:
        return SearchCond("BETWEEN", (_key(low), _key(high)))

    @staticmethod
    def among(keys) -> SearchCond:
        return SearchCond("IN", tuple(map(_key, keys)))

    def on(self, column: str | Column) -> Column:
        """The condition as a Catalyst expression: pushed down to Parquet, typed and compiled by Spark."""
        c = F.col(column) if isinstance(column, str) else column
        k = self.keys
        match self.kind:
            case "=":
                return c == F.lit(k[0])
            case "<":
                return c < F.lit(k[0])
            case ">":
                return c > F.lit(k[0])
            case "<=":
                return c <= F.lit(k[0])
            case ">=":
                return c >= F.lit(k[0])
            case "BETWEEN":
                return c.between(F.lit(k[0]), F.lit(k[1]))
            case "IN":
                return c.isin(*k) if k else F.lit(False)
        raise ValueError(self.kind)

    def __str__(self) -> str:
        return f"{self.kind} {' AND '.join(map(repr, self.keys)) if self.kind == 'BETWEEN' else ', '.join(map(repr, self.keys))}"


def search(df: DataFrame, **conditions: SearchCond) -> DataFrame:
    """Rows that meet every condition, named by column: what narrowing a scan's positions column by column gives."""
    for column, condition in conditions.items():
        df = df.where(condition.on(column))
    return df
