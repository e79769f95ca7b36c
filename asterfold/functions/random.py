"""Reproducible random values: a multiplicative generator for the driver, hashes of row numbers for rows.

A row's values depend on its number and the seed alone, so any partitioning, retry or order gives the same
table; no generator state is passed between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The minimal standard generator.
MULTIPLIER, MODULUS = 16807, 2147483647


class Lcg:
    def __init__(self, seed: int):
        self.state = seed % MODULUS or 1

    def next(self) -> int:
        self.state = self.state * MULTIPLIER % MODULUS
        return self.state

    def between(self, low: int, high: int) -> int:
        """In [low, high]."""
        return low + self.next() % (high - low + 1)

    def skip(self, n: int) -> None:
        """As n calls of next, at once."""
        self.state = self.state * pow(MULTIPLIER, n, MODULUS) % MODULUS


def lcg_step(state: str) -> Column:
    """The state after this one, as an expression on a long column."""
    return F.expr(f"{state} * {MULTIPLIER} % {MODULUS}")


def uniform(row: Column, salt: str, low: int, high: int, seed: int = 0) -> Column:
    """An integer in [low, high], by row number."""
    return (F.lit(low) + F.pmod(F.xxhash64(row, F.lit(salt), F.lit(seed)), F.lit(high - low + 1))).cast("int")


def fraction(row: Column, salt: str, seed: int = 0) -> Column:
    """A double in [0, 1), by row number."""
    return F.pmod(F.xxhash64(row, F.lit(salt), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def exponential(row: Column, salt: str, mean: float, seed: int = 0) -> Column:
    return -F.lit(mean) * F.log(1 - fraction(row, salt, seed))


def pick(row: Column, salt: str, values: list[str], seed: int = 0) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), uniform(row, salt, 1, len(values), seed))


def weighted(row: Column, salt: str, values: dict[str, int], seed: int = 0) -> Column:
    """A value by its weight."""
    x, at, out = uniform(row, salt, 0, sum(values.values()) - 1, seed), 0, None
    for value, weight in values.items():
        at += weight
        out = F.when(x < at, value) if out is None else out.when(x < at, value)
    return out


def letters(row: Column, salt: str, length: int, seed: int = 0) -> Column:
    """A string of `length` letters and digits."""
    return F.substring(F.concat(*(F.sha2(F.concat_ws("/", row, F.lit(f"{salt}{k}{seed}")), 256) for k in range(-(-length // 64)))), 1, length)


def permuted(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """The rows in an order that depends on their key and the seed alone."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
