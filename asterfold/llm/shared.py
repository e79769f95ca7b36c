"""Scratch tables in the cluster's shared folder, and small helpers that the operators have in common."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Scratch tables of this process, in the order they were made; a caller that has written a result may remove those
#: that went into it.
made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. One of our own is set only where the session names none and has no other
    machines; executors elsewhere couldn't read it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='asterfold-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Removes scratch tables that no returned DataFrame reads."""
    jvm = spark._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Shuffle files of tables that nothing refers to any more go now, not when the driver happens to collect its
    garbage."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sample(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """`most` rows or all, if fewer: those of the smallest hashes of `columns`, and of rows that are equal there those
    of the smallest hashes of all columns. The same rows whatever the partitioning."""
    count = df.count()
    if count <= most:
        return df
    # Ordered are only those rows that may be among them, about twice as many as are taken.
    near = df.withColumn("_hash", F.pmod(F.xxhash64(*columns), F.lit(1 << 31)))
    few = near.where(F.col("_hash") < int((1 << 31) * min(1, 2 * most / count)))
    few = few if few.count() >= most else near
    return few.orderBy("_hash", F.xxhash64(*df.columns)).limit(most).drop("_hash")


def id_bounds(df: DataFrame, column: str, rows_per_range: int = 2000) -> list[int]:
    """Ascending cut points that deal a column of whole numbers into ranges of about equal row counts, four for
    each task of a shuffle at most. Null counts as the least number. A value of very many rows is there several
    times. The ranges are only a way to deal rows out: results don't depend on where the cuts fall."""
    n = max(1, min(4 * shuffle_width(df.sparkSession), -(-df.count() // rows_per_range)))
    if n == 1:
        return []
    shares = [k / n for k in range(1, n)]
    return sorted(df.agg(F.percentile_approx(F.coalesce(F.col(column).cast("long"), F.lit(-(1 << 63))), shares, max(10_000, 10 * n))).head()[0] or [])
