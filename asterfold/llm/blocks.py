"""Vectors in blocks, for a stated set of queries against all rows.

Rows are dealt by a hash of their id into blocks of a fixed size, each packed into one row of bytes. Every
block of queries meets every run of candidate blocks in a group of its own: the group is the unit of work and of
memory, whatever the table's size. Each meeting keeps its best k, and the meetings' results are ranked by
query with limits applied before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asterfold.llm.shared import shuffle_width

#: Candidates of a block, blocks that a block of queries meets one after the other, and the least and most queries
#: of a block.
CANDIDATES, RUN, LEAST_QUERIES, QUERIES = 16_384, 16, 512, 8_192


def usable(df: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """id, vector: rows with an id and a vector of finite components (and with zero=False, not all zero).

    An id names one vector: of several rows with one id, the smallest vector (in array order) stands for it.
    """
    x = F.col(vector_col).cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    ok = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, finite)
    if not zero:
        ok = ok & F.exists(x, lambda v: v != 0)
    rows = df.where(ok).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def matrix(lists: pa.Array, dim: int, kind: type) -> np.ndarray:
    """Lists of numbers as rows of a matrix; shorter ones are filled up with zeros."""
    out = np.zeros((len(lists), dim), kind)
    out[np.arange(dim) < lists.value_lengths().to_numpy()[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def kind_of(rows: DataFrame, column: str) -> type:
    """What numbers the vectors hold; they travel as such."""
    return np.float32 if rows.schema[column].dataType.elementType.simpleString() == "float" else np.float64


def packed(rows: DataFrame, count: int, size: int, dim: int) -> tuple[DataFrame, int]:
    """block, ids, vectors: one row for each block of about `size` rows, ids ascending."""
    blocks, kind = max(1, -(-count // size)), kind_of(rows, "vector")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        vectors = matrix(table.column("vector").chunk(0), dim, kind)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "ids": [table.column("id").to_numpy().tobytes()], "vectors": [vectors.tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(run, "block int, ids binary, vectors binary"), blocks


def query_size(rows: DataFrame, asked: int) -> int:
    """Queries of a block: so few that small tables keep all tasks busy, so many that candidates move seldom."""
    return min(QUERIES, max(LEAST_QUERIES, -(-asked // (2 * shuffle_width(rows.sparkSession)))))


def met(asking: DataFrame, groups: int, stock: DataFrame, blocks: int, run: Callable, schema: str, length: int = RUN) -> DataFrame:
    """run(a row of queries, `length` rows of candidates) -> table, for each block of queries and run of blocks."""
    stock = stock.withColumn("run", F.expr(f"block div {length}").cast("int")).withColumn("asking", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    runs = -(-blocks // length)
    asking = asking.withColumnsRenamed({"block": "asking", "ids": "q_ids", "vectors": "q_vectors"}).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    names = [(part.split()[0], pa.int64() if part.split()[1] == "long" else pa.float64()) for part in schema.split(", ")]

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            return run(left, right.sort_by("block"))
        return pa.table({n: pa.array([], t) for n, t in names})

    return asking.groupBy("asking", "run").cogroup(stock.groupBy("asking", "run")).applyInArrow(both, schema)


def read(table: pa.Table, column: str, kind: type, dim: int = 0, row: int = 0) -> np.ndarray:
    """The numbers of a block's column; rows of `dim` as doubles."""
    out = np.frombuffer(table.column(column)[row].as_py(), kind)
    return out.reshape(-1, dim).astype(float) if dim else out


def ranked(best: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest scores of each query, ties to smaller ids."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
