"""Fresh rows beside a view: small fixed batches, and the union that queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.schemas import MV

# The ten rows of the public query tests' delta.
_REGIONS = ("AFRICA", "MIDDLE EAST", "ASIA", "ASIA", "MIDDLE EAST")
_CATEGORIES = ("MFGR#12", "MFGR#15", "MFGR#12", "MFGR#22", "MFGR#25")
_BRANDS = ("MFGR#3330", "MFGR#220", "MFGR#225", "MFGR#320", "MFGR#3332")


def test_rows(spark: SparkSession) -> DataFrame:
    """The ten rows, with the view's schema."""
    rows = []
    for i in range(10):
        year = 1993 + i % 7
        known = {"l_orderkey": 10000 + i, "s_region": _REGIONS[i % 5], "d_year": year, "d_yearmonthnum": year * 100 + 12, "l_quantity": 5 * i, "l_discount": i}
        known |= {"l_extendedprice": 10 + i, "l_revenue": 20 + i, "l_supplycost": 50 + i, "d_weeknuminyear": 5, "p_category": _CATEGORIES[i % 5], "p_brand": _BRANDS[i % 5]}
        rows.append(tuple(known.get(f.name, "" if f.dataType.simpleString() == "string" else 0) for f in MV.fields))
    return spark.createDataFrame(rows, MV)


def union_all(main: DataFrame, *fresh: DataFrame) -> DataFrame:
    """All rows of all, by column name, cast to main's types. Nothing is dropped, duplicates stay."""
    for df in fresh:
        main = main.unionByName(df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in main.schema.fields)))
    return main
