"""Money, in cents; all divisions truncate. Arguments are column names or Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _div(a: Column, n: int) -> Column:
    return F.call_function("div", a, F.lit(n))


def retail_price(partkey: str | Column) -> Column:
    k = _long(partkey)
    return 90000 + _div(k, 10) % 20001 + (k % 1000) * 100


def revenue(price: str | Column, discount: str | Column) -> Column:
    return _div(_long(price) * (100 - _long(discount)), 100)


def supply_cost(price: str | Column) -> Column:
    return _div(6 * _long(price), 10)


def line_total(price: str | Column, discount: str | Column, tax: str | Column) -> Column:
    """What a line adds to its order's total price."""
    return _div(revenue(price, discount) * (100 + _long(tax)), 100)


def discounted(price: str | Column, discount: str | Column) -> Column:
    return _long(price) * _long(discount)


def profit(earned: str | Column, cost: str | Column) -> Column:
    return _long(earned) - _long(cost)
