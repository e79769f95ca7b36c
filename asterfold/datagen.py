"""Generated star schema tables, of any scale, and batches of fresh fact rows.

Every value is a function of its row's number (functions.random), so a table is one spark.range of as many
tasks as wanted, and a batch continues where the last one ended.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.functions import calendar, keys, pricing, text
from asterfold.functions.random import letters, pick, uniform
from asterfold.schemas import TABLES

# The public benchmark's word lists.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
NATIONS = {
    "AFRICA": ["ALGERIA", "ETHIOPIA", "KENYA", "MOROCCO", "MOZAMBIQUE"], "AMERICA": ["ARGENTINA", "BRAZIL", "CANADA", "PERU", "UNITED STATES"], "ASIA": ["CHINA", "INDIA", "INDONESIA", "JAPAN", "VIETNAM"],
    "EUROPE": ["FRANCE", "GERMANY", "ROMANIA", "RUSSIA", "UNITED KINGDOM"], "MIDDLE EAST": ["EGYPT", "IRAN", "IRAQ", "JORDAN", "SAUDI ARABIA"],
}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECI", "5-LOW"]
MODES = ["AIR", "FOB", "MAIL", "RAIL", "REG AIR", "SHIP", "TRUCK"]
COLORS = """almond antique aquamarine azure beige bisque black blanched blue blush brown burlywood burnished chartreuse chiffon chocolate coral cornflower cornsilk cream cyan dark deep dim dodger drab firebrick
floral forest frosted gainsboro ghost goldenrod green grey honeydew hot indian ivory khaki lace lavender lawn lemon light lime linen magenta maroon medium metallic midnight mint misty moccasin navajo navy olive
orange orchid pale papaya peach peru pink plum powder puff purple red rose rosy royal saddle salmon sandy seashell sienna sky slate smoke snow spring steel tan thistle tomato turquoise violet wheat white yellow""".split()
TYPES = [f"{a} {b} {c}" for a in ("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO") for b in ("ANODIZED", "BURNISHED", "PLATED", "POLISHED", "BRUSHED") for c in ("TIN", "NICKEL", "BRASS", "STEEL", "COPPER")]
CONTAINERS = [f"{a} {b}" for a in ("SM", "LG", "MED", "JUMBO", "WRAP") for b in ("CASE", "BOX", "BAG", "JAR", "PKG", "PACK", "CAN", "DRUM")]
FIRST_DAY, DAYS = "1992-01-01", 2406
SEED = 7


def row_counts(scale: float) -> dict[str, int]:
    """Rows by table; `order` counts orders, of one to seven lines each."""
    parts = 200_000 * int(1 + math.log2(scale)) if scale >= 1 else int(200_000 * scale)
    return {"part": max(1, parts), "supplier": max(1, int(10_000 * scale)), "customer": max(1, int(30_000 * scale)), "date": 2556, "order": max(1, int(1_500_000 * scale))}


def _typed(df: DataFrame, table: str) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].fields))


def _places(row: Column, salt: str) -> dict[str, Column]:
    flat = [(n, r) for r in REGIONS for n in NATIONS[r]]
    number = uniform(row, salt, 1, len(flat), SEED)
    return {"_n": number - 1, "nation": F.element_at(F.array(*(F.lit(n) for n, _ in flat)), number), "region": F.element_at(F.array(*(F.lit(r) for _, r in flat)), number)}


def _people(spark: SparkSession, n: int, key: str, what: str) -> DataFrame:
    row = F.col("id")
    df = spark.range(1, n + 1).withColumns(_places(row, what)).withColumn("_digit", uniform(row, f"{what}city", 0, 9, SEED))
    return df.withColumns({key: row, "name": F.format_string(f"{what}#%09d", row), "address": letters(row, f"{what}addr", 15, SEED), "city": text.city("nation", "_digit"), "phone": text.phone("_n", "id")})


def customer(spark: SparkSession, scale: float) -> DataFrame:
    df = _people(spark, row_counts(scale)["customer"], "custkey", "Customer")
    return _typed(df.withColumn("mktsegment", pick(F.col("id"), "segment", SEGMENTS, SEED)), "customer")


def supplier(spark: SparkSession, scale: float) -> DataFrame:
    return _typed(_people(spark, row_counts(scale)["supplier"], "suppkey", "Supplier"), "supplier")


def part(spark: SparkSession, scale: float) -> DataFrame:
    row = F.col("id")
    names = dict(zip(("mfgr", "category", "brand"), text.mfgr_category_brand(uniform(row, "m", 1, 5, SEED), uniform(row, "c", 1, 5, SEED), uniform(row, "b", 1, 40, SEED)), strict=True))
    df = spark.range(1, row_counts(scale)["part"] + 1).withColumns(names | {"partkey": row, "color": pick(row, "color", COLORS, SEED), "name": F.concat_ws(" ", pick(row, "n1", COLORS, SEED), pick(row, "n2", COLORS, SEED))})
    return _typed(df.withColumns({"type": pick(row, "type", TYPES, SEED), "size": uniform(row, "size", 1, 50, SEED), "container": pick(row, "cont", CONTAINERS, SEED)}), "part")


def date(spark: SparkSession) -> DataFrame:
    return _typed(calendar.date_dimension(spark), "date")


def lineorder(spark: SparkSession, scale: float, first_order: int = 0, orders: int | None = None) -> DataFrame:
    """Lines of `orders` whole orders from order number `first_order` on. Foreign keys are within `scale`'s tables.

    An order's lines are made as one array, summed up for its total, and only then exploded: no shuffle.
    """
    n = row_counts(scale)
    order = F.col("id")
    day = lambda c, salt, last: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), uniform(c, salt, 0, last, SEED)), "yyyyMMdd").cast("int")

    def drawn(line: Column) -> Column:
        each = F.concat_ws("/", order, line)
        values = {
            "linenumber": line, "partkey": uniform(each, "part", 1, n["part"], SEED), "suppkey": uniform(each, "supp", 1, n["supplier"], SEED), "quantity": uniform(each, "qty", 1, 50, SEED), "discount": uniform(each, "disc", 0, 10, SEED),
            "tax": uniform(each, "tax", 0, 8, SEED), "commitdate": day(each, "commit", DAYS + 60), "shipmode": pick(each, "mode", MODES, SEED),
        }
        return F.struct(*(c.alias(k) for k, c in values.items()))

    def priced(line: Column) -> Column:
        price = pricing.retail_price(line.partkey)
        return line.withField("extendedprice", line.quantity * price).withField("supplycost", pricing.supply_cost(price))

    lines = F.transform(F.transform(F.sequence(F.lit(1), uniform(order, "lines", 1, 7, SEED)), drawn), priced)
    df = spark.range(first_order, first_order + (orders or n["order"])).withColumn("_lines", lines)
    total = F.aggregate("_lines", F.lit(0).cast("long"), lambda sum_, line: sum_ + pricing.line_total(line.extendedprice, line.discount, line.tax))
    df = df.withColumns({"orderkey": keys.sparse_key("(id + 1)"), "custkey": uniform(order, "cust", 1, n["customer"], SEED), "orderdate": day(order, "date", DAYS - 1), "orderpriority": pick(order, "prio", PRIORITIES, SEED), "shippriority": F.lit("0"), "ordertotalprice": total})
    df = df.select("*", F.inline("_lines"))
    return _typed(df.withColumn("revenue", pricing.revenue("extendedprice", "discount")), "lineorder")


def tables(spark: SparkSession, scale: float) -> dict[str, DataFrame]:
    return {"lineorder": lineorder(spark, scale), "customer": customer(spark, scale), "supplier": supplier(spark, scale), "part": part(spark, scale), "date": date(spark)}


class Batches:
    """Fact batches one after another; its state is the next order number."""

    def __init__(self, spark: SparkSession, scale: float, next_order: int = 0):
        self.spark, self.scale, self.next_order = spark, scale, next_order

    def next(self, orders: int) -> DataFrame:
        df = lineorder(self.spark, self.scale, self.next_order, orders)
        self.next_order += orders
        return df


def update_set(lineorder_rows: DataFrame, low: int, high: int, fresh: DataFrame) -> DataFrame:
    """The fact table without orders [low, high), and with fresh rows."""
    return lineorder_rows.where(~F.col("orderkey").between(low, high - 1)).unionByName(fresh)
