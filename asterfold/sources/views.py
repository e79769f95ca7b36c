"""The star schema over the driver's tables, with SQL's column prefixes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_DAY, LAST_DAY = "1995-01-01", "2001-12-31"


class Bounds(NamedTuple):
    """Conditions on the star's columns, in terms of the files' own columns: first and last day, and inclusive
    ranges of whole per cents and quantities. They are implied by what the caller asks of the star anyway, and are
    stated so that they reach the scans of orders and lines: files and row groups are skipped, and less is shuffled."""

    days: tuple[str, str] | None = None
    discount: tuple[int, int] | None = None
    quantity: tuple[int, int] | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


NO_BOUNDS = Bounds()


def dwdate(spark: SparkSession) -> DataFrame:
    days = spark.sql(f"select explode(sequence(date'{FIRST_DAY}', date'{LAST_DAY}', interval 1 day)) as d")
    return days.select(
        F.date_format("d", "yyyyMMdd").cast("int").alias("d_datekey"), F.year("d").alias("d_year"), (F.year("d") * 100 + F.month("d")).alias("d_yearmonthnum"),
        F.date_format("d", "MMMyyyy").alias("d_yearmonth"), F.expr("cast(dayofyear(d) div 7 + 1 as int)").alias("d_weeknuminyear"),
    )


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring("p_brand", 7, 10).cast("int") - 1
    mfgr = F.concat(F.lit("MFGR#"), F.expr("(cast(substr(p_brand, 7) as int) - 1) div 5 + 1").cast("string"))
    category = F.concat(mfgr, (number % 5 + 1).cast("string"))
    brand = F.concat(category, (F.col("p_partkey") % 40 + 1).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", mfgr.alias("p_mfgr"), category.alias("p_category"), brand.alias("p_brand1"), cents("p_retailprice").alias("p_retail"))


def _placed(df: DataFrame, spark: SparkSession, sf_dir: str, p: str, key: str) -> DataFrame:
    """With city, nation and region. Nations and regions are 25 and 5 rows by the schema's definition."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    city = F.concat(F.rpad(F.substring("n_name", 1, 9), 9, " "), (F.col(key) % 10).cast("string"))
    joined = df.join(F.broadcast(places), F.col(f"{p}_nationkey") == F.col("n_nationkey"))
    return joined.select(key, city.alias(f"{p}_city"), F.col("n_name").alias(f"{p}_nation"), F.col("r_name").alias(f"{p}_region"))


def supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(table(spark, sf_dir, "supplier"), spark, sf_dir, "s", "s_suppkey")


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(table(spark, sf_dir, "customer"), spark, sf_dir, "c", "c_custkey")


def lineorder(spark: SparkSession, sf_dir: str, cost: bool = False, bounds: Bounds = NO_BOUNDS) -> DataFrame:
    """The fact table. Supply cost needs the part's price: only with `cost` is part joined."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    if bounds.days:
        first, last = (F.lit(d).cast("timestamp") for d in bounds.days)
        orders = orders.where((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < last + F.expr("interval 1 day")))
    if bounds.discount:  # rounded to whole per cents, above; a hair more for doubles
        low, high = bounds.discount
        lines = lines.where(F.col("l_discount").between((low - 0.5) / 100 - 1e-9, (high + 0.5) / 100 + 1e-9))
    if bounds.quantity:  # whole numbers, cut off
        low, high = bounds.quantity
        lines = lines.where((F.col("l_quantity") > float(low - 1)) & (F.col("l_quantity") < float(high + 1)))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    extra = []
    if cost:
        price = part(spark, sf_dir).select(F.col("p_partkey").alias("_pk"), F.col("p_retail").alias("_retail"))
        joined = joined.join(price, F.col("l_partkey") == F.col("_pk"))
        extra = [F.expr("6 * _retail div 10").alias("lo_supplycost")]
    price, discount = cents("l_extendedprice"), F.round(F.col("l_discount") * 100).cast("int")
    joined = joined.withColumns({"_price": price, "_discount": discount})
    return joined.select(
        F.col("l_orderkey").alias("lo_orderkey"), F.col("l_linenumber").alias("lo_linenumber"), F.col("o_custkey").alias("lo_custkey"), F.col("l_partkey").alias("lo_partkey"), F.col("l_suppkey").alias("lo_suppkey"),
        F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("lo_orderdate"), F.col("o_orderpriority").alias("lo_orderpriority"), F.col("l_quantity").cast("int").alias("lo_quantity"),
        F.col("_price").alias("lo_extendedprice"), F.col("_discount").alias("lo_discount"), F.round(F.col("l_tax") * 100).cast("int").alias("lo_tax"),
        F.expr("_price * (100 - _discount) div 100").alias("lo_revenue"), *extra,
    )


def star(spark: SparkSession, sf_dir: str, dimensions: str = "dcsp", cost: bool = True, bounds: Bounds = NO_BOUNDS) -> DataFrame:
    """The fact table joined to the dimensions named by their initials; the rest is left out, as foreign keys
    are valid (see operators.integrity). Which side is sent or shuffled is Catalyst's choice by size; only the
    calendar, a fixed few thousand days, is always sent."""
    if "d" in dimensions and not bounds.days:
        bounds = bounds._replace(days=(FIRST_DAY, LAST_DAY))  # the calendar's
    df = lineorder(spark, sf_dir, cost, bounds)
    if "d" in dimensions:
        df = df.join(F.broadcast(dwdate(spark)), F.col("lo_orderdate") == F.col("d_datekey"))
    if "c" in dimensions:
        df = df.join(customer(spark, sf_dir), F.col("lo_custkey") == F.col("c_custkey"))
    if "s" in dimensions:
        df = df.join(supplier(spark, sf_dir), F.col("lo_suppkey") == F.col("s_suppkey"))
    if "p" in dimensions:
        df = df.join(part(spark, sf_dir).drop("p_retail"), F.col("lo_partkey") == F.col("p_partkey"))
    return df
