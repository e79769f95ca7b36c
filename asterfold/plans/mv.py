"""The materialised view: the fact table joined to its dimensions, kept in clustering order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.family import Files
from asterfold.schemas import MV
from asterfold.scratch import new_path
from asterfold.sources import views

#: Columns of the joined rows that the view keeps, clustering key first.
CLUSTER = ["s_region", "d_year", "c_region", "s_nation", "c_nation", "s_city", "c_city", "d_yearmonthnum", "d_yearmonth", "lo_orderkey", "lo_linenumber"]
PAYLOAD = ["lo_quantity", "lo_extendedprice", "lo_discount", "lo_revenue", "lo_supplycost", "p_mfgr", "p_category", "p_brand1", "d_weeknuminyear"]
_written: dict[tuple, str] = {}


def build(star: DataFrame) -> DataFrame:
    return star.select(*CLUSTER, *PAYLOAD)


def from_base(lineorder: DataFrame, customer: DataFrame, supplier: DataFrame, part: DataFrame, date: DataFrame) -> DataFrame:
    """The view over loaded base tables (schemas.TABLES), with the view's schema."""
    c, s, p, d = (df.select(*(F.col(x).alias(f"{n}_{x}") for x in df.columns)) for n, df in (("c", customer), ("s", supplier), ("p", part), ("d", date)))
    lo = lineorder.select(*(F.col(x).alias(f"l_{x}") for x in lineorder.columns))
    joined = lo.join(c, F.col("l_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.join(p, F.col("l_partkey") == F.col("p_partkey")).join(d, F.col("l_orderdate") == F.col("d_datekey"))
    return joined.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in MV.fields))


def as_star(view: DataFrame) -> DataFrame:
    """View rows under the names that plans.ssb uses."""
    names = {c: f"lo_{c[2:]}" for c in view.columns if c.startswith("l_")} | {"p_brand": "p_brand1"}
    return view.withColumnsRenamed(names)


def write(view: DataFrame, path: str, keys: list[str] | None = None, by: tuple[str, ...] = ("s_region", "d_year")) -> None:
    """Writes the view by region and year, the rest of the key sorted inside.

    Ranges of the whole clustering key, not of the partition columns, are dealt to tasks: a large region and
    year is written by many tasks, and each task's files hold narrow key ranges.
    """
    keys = keys or [c for c in CLUSTER if c in view.columns]
    view.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy(*by).parquet(path)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view over a driver data set, written once a session for each state of its files."""
    tables = ("lineitem", "orders", "customer", "supplier", "part", "nation", "region")
    key = (spark.sparkContext.applicationId, sf_dir, *(Files(spark, f"{sf_dir}/{t}.parquet").changed() for t in tables))
    if key not in _written:
        path = new_path(spark, "mv")
        write(build(views.star(spark, sf_dir)), path)
        _written[key] = path
    return spark.read.parquet(_written[key])
