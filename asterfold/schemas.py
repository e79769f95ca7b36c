"""Schemas of the star schema's tables, without the prefixes that SQL names have. Nothing is nullable.

Money is in cents, percentages are whole, dates are yyyymmdd integers: sums are exact.
"""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"byte": T.ByteType, "short": T.ShortType, "int": T.IntegerType, "long": T.LongType, "string": T.StringType}


def _struct(spec: str) -> T.StructType:
    """'name kind, name kind, ...'"""
    return T.StructType([T.StructField(name, _KINDS[kind](), False) for name, kind in (part.split() for part in spec.split(","))])


# Column names, order and types of the public benchmark's tables.
LINEORDER = _struct("orderkey int, linenumber byte, custkey int, partkey int, suppkey int, orderdate int, orderpriority string, shippriority string, quantity byte, extendedprice int, ordertotalprice int, discount byte, revenue int, supplycost int, tax byte, commitdate int, shipmode string")
CUSTOMER = _struct("custkey int, name string, address string, city string, nation string, region string, phone string, mktsegment string")
SUPPLIER = _struct("suppkey int, name string, address string, city string, nation string, region string, phone string")
PART = _struct("partkey int, name string, mfgr string, category string, brand string, color string, type string, size byte, container string")
DATE = _struct("datekey int, date string, dayofweek string, month string, year short, yearmonthnum int, yearmonth string, daynuminweek byte, daynuminmonth byte, daynuminyear short, monthnuminyear byte, weeknuminyear byte, sellingseason string, lastdayinweekfl byte, lastdayinmonthfl byte, holidayfl byte, weekdayfl byte")
MV = _struct("s_region string, d_year short, c_region string, s_nation string, c_nation string, s_city string, c_city string, d_yearmonthnum int, d_yearmonth string, l_orderkey int, l_linenumber byte, l_quantity byte, l_extendedprice int, l_discount byte, l_revenue int, l_supplycost int, p_mfgr string, p_category string, p_brand string, d_weeknuminyear byte")

TABLES = {"lineorder": LINEORDER, "customer": CUSTOMER, "supplier": SUPPLIER, "part": PART, "date": DATE, "mv": MV}

#: The order in which a table is kept: its key.
SORT_ORDER = {
    "lineorder": ["orderkey", "linenumber"],
    "customer": ["custkey"],
    "supplier": ["suppkey"],
    "part": ["partkey"],
    "date": ["datekey"],
    "mv": MV.names[:11],
}

#: Fact columns that refer to a dimension: (fact column, dimension, its key).
FOREIGN_KEYS = [("custkey", "customer", "custkey"), ("suppkey", "supplier", "suppkey"), ("partkey", "part", "partkey"), ("orderdate", "date", "datekey")]

#: How the column layout keeps what it doesn't keep as plain values. Parquet decides by itself; this is for
#: tables that say so (see operators.columns).
RUN_LENGTH = {"lineorder": ["orderkey"], "mv": ["s_region", "d_year", "c_region", "s_nation", "c_nation", "s_city", "c_city", "d_yearmonthnum", "d_yearmonth"]}
DICTIONARY = {
    "lineorder": ["orderpriority", "shippriority", "shipmode"],
    "customer": ["city", "nation", "region", "mktsegment"],
    "supplier": ["city", "nation", "region"],
    "part": ["mfgr", "category", "brand", "color", "container"],
    "mv": ["p_mfgr", "p_category", "p_brand"],
}


def encoding(table: str, column: str) -> str:
    """'rle', 'dictionary' or 'plain'."""
    return "rle" if column in RUN_LENGTH.get(table, ()) else "dictionary" if column in DICTIONARY.get(table, ()) else "plain"


def empty(spark, table: str):
    """An empty table of a given type."""
    return spark.createDataFrame([], TABLES[table])
