"""Text columns of the dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def city(nation: str, number: str) -> Column:
    """The nation's first nine characters, filled up with spaces, and a digit."""
    return F.concat(F.rpad(F.substring(nation, 1, 9), 9, " "), (F.col(number) % 10).cast("string"))


def color(name: str) -> Column:
    """The first word of a part's name."""
    return F.substring_index(name, " ", 1)


def without_color(name: str) -> Column:
    return F.when(F.instr(name, " ") > 0, F.expr(f"substr({name}, instr({name}, ' ') + 1)")).otherwise(F.lit(""))


def phone(nationkey: str, seed: str) -> Column:
    """(10 + nation)-ddd-ddd-dddd, with digits that depend on the seed column alone."""
    digits = lambda salt, low, n: F.lit(low) + F.pmod(F.xxhash64(F.col(seed), F.lit(salt)), F.lit(n))
    return F.format_string("%02d-%03d-%03d-%04d", F.col(nationkey) + 10, digits("a", 100, 900), digits("b", 100, 900), digits("c", 1000, 9000))


def mfgr_category_brand(m: Column, c: Column, b: Column) -> tuple[Column, Column, Column]:
    mfgr = F.concat(F.lit("MFGR#"), m.cast("string"))
    category = F.concat(mfgr, c.cast("string"))
    return mfgr, category, F.concat(category, b.cast("string"))
