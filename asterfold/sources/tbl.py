"""Delimited text tables: one line a row, '|' between values, no header and no quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asterfold.schemas import SORT_ORDER, TABLES


#: Values stand as they are: no quotes, no escapes, no trimming.
PLAIN = {"sep": "|", "quote": "", "escape": "", "escapeQuotes": "false", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}


def read_tbl(spark: SparkSession, path: str, table: str, lenient: bool = False) -> DataFrame:
    """A table from text. A value that is no number fails the read; with lenient it counts as 0.

    The schema is given, so that nothing is inferred and only the columns asked for are parsed. Blank lines
    are skipped. Trailing NUL padding of strings is dropped, an empty string
    stays one.
    """
    schema = TABLES[table]
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.schema(text if lenient else schema).options(**PLAIN).option("mode", "PERMISSIVE" if lenient else "FAILFAST").csv(path)
    columns = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.coalesce(F.rtrim(c, F.lit("\x00")), F.lit(""))
        elif lenient:
            c = F.coalesce(F.expr(f"try_cast(trim(`{f.name}`) as {f.dataType.simpleString()})"), F.lit(0).cast(f.dataType))
        columns.append(c.alias(f.name))
    return raw.select(columns)


def write_tbl(df: DataFrame, path: str) -> None:
    """The table as text files that read_tbl reads."""
    df.write.options(**PLAIN).mode("overwrite").csv(path)


def convert(spark: SparkSession, source: str, target: str, tables=("lineorder", "customer", "supplier", "part", "date"), lenient: bool = False) -> None:
    """Text tables `source`/<table>.tbl to Parquet `target`/<table>, each clustered on its key.

    Range partitioning by the key and a sort inside each partition give files with narrow key ranges, so that
    range scans and point look-ups skip files and row groups.
    """
    for name in tables:
        keys = SORT_ORDER[name]
        df = read_tbl(spark, f"{source}/{name}.tbl", name, lenient)
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{target}/{name}")


def load(spark: SparkSession, folder: str, tables=("lineorder", "customer", "supplier", "part", "date")) -> dict[str, DataFrame]:
    """Converted tables, with their fixed schemas."""
    return {name: spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}") for name in tables}
