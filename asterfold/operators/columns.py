"""A column store's building blocks as DataFrame operators: positions, runs, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asterfold.operators.predicates import SearchCond
from asterfold.scratch import materialise

ROW = (1 << 33) - 1


def with_positions(df: DataFrame, keys: list[str], name: str = "pos") -> DataFrame:
    """df with each row's 0-based place in the order of `keys` (all keys together should be unique: ties fall
    as they may), and its part, the range of keys it was sorted in.

    Range partitions are sorted apart and written; only their row counts are then summed up. So no task sees
    more than its range, unlike a row_number over everything.
    """
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = materialise(ordered, "positions").withColumn("part", F.expr("shiftright(_at, 33)").cast("int")).withColumn("_row", F.col("_at").bitwiseAND(F.lit(ROW)))
    # One row for each partition.
    counts = rows.groupBy("part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).drop("_n")
    return rows.join(F.broadcast(before), "part").withColumn(name, F.col("_before") + F.col("_row")).drop("_at", "_row", "_before")


def runs(positioned: DataFrame, column: str, pos: str = "pos") -> DataFrame:
    """value, begin, end (exclusive) of every run of equal values, in a DataFrame from with_positions.

    Runs are found part by part; where the last of a part and the first of the next are equal they are one.
    """
    flagged = positioned.select("part", F.col(pos).alias("_pos"), F.col(column).alias("value"))
    w = Window.partitionBy("part").orderBy("_pos")
    changed = F.when(F.lag("_pos").over(w).isNull(), 1).otherwise((~F.lag("value").over(w).eqNullSafe(F.col("value"))).cast("int"))
    local = flagged.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.groupBy("part", "_run").agg(F.first("value").alias("value"), F.min("_pos").alias("begin"), (F.max("_pos") + 1).alias("end"))
    # Two values and a count for each partition.
    edges = local.groupBy("part").agg(F.min_by("value", "_run").alias("first"), F.max_by("value", "_run").alias("last"), F.count("*").alias("n"))
    over = Window.orderBy("part")
    joins = (F.lag("part").over(over).isNotNull() & F.lag("last").over(over).eqNullSafe(F.col("first"))).cast("long")
    shift = edges.withColumn("_joins", joins).withColumn("_shift", F.sum(F.col("n") - F.col("_joins")).over(over) - F.col("n"))
    whole = local.join(F.broadcast(shift.select("part", "_shift")), "part").withColumn("_id", F.col("_run") + F.col("_shift"))
    return whole.groupBy("_id").agg(F.first("value").alias("value"), F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_id")


def ranges(run_table: DataFrame, condition: SearchCond, within: tuple[int, int] | None = None) -> DataFrame:
    """begin, end of the position ranges whose runs meet the condition, neighbours merged, cut to `within`."""
    hit = run_table.where(condition.on("value"))
    if within:
        low, high = within
        hit = hit.where((F.col("begin") < high) & (F.col("end") > low)).withColumns({"begin": F.greatest("begin", F.lit(low)), "end": F.least("end", F.lit(high))})
    # A matching run starts a range unless a matching run ends where it begins: a join, not a global sort.
    ends = hit.select(F.col("end").alias("_stop"))
    starts = hit.join(ends, F.col("begin") == F.col("_stop"), "left_anti").select("begin")
    begins = hit.select(F.col("begin").alias("_go"))
    stops = hit.join(begins, F.col("end") == F.col("_go"), "left_anti").select("end")
    both = starts.select(F.col("begin").alias("at"), F.lit(0).alias("side")).unionByName(stops.select(F.col("end").alias("at"), F.lit(1).alias("side")))
    placed = with_positions(both, ["at", "side"], "n")
    pair = placed.groupBy(F.expr("n div 2").alias("k")).agg(F.min("at").alias("begin"), F.max("at").alias("end"))
    return pair.drop("k")


def decode_runs(run_table: DataFrame) -> DataFrame:
    """pos, value of every position of the runs."""
    return run_table.select(F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos"), "value")


def longest_run(run_table: DataFrame) -> DataFrame:
    return run_table.agg(F.coalesce(F.max(F.col("end") - F.col("begin")), F.lit(0)).alias("longest"))


def bitmap(positioned: DataFrame, condition: SearchCond, column: str, pos: str = "pos") -> DataFrame:
    """pos, matched for every position."""
    return positioned.select(pos, F.coalesce(condition.on(column), F.lit(False)).alias("matched"))


def match_count(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count_if(condition).alias("matched"))


def values_at(positioned: DataFrame, column: str, begin: int, end: int, pos: str = "pos") -> DataFrame:
    """pos, value for positions in [begin, end)."""
    return positioned.where((F.col(pos) >= begin) & (F.col(pos) < end)).select(pos, F.col(column).alias("value"))


def dictionary(df: DataFrame, column: str, most: int | None = 1 << 16) -> DataFrame:
    """code, value: the distinct values, coded 0, 1, ... in their order. More than `most` is an error."""
    values = df.select(F.col(column).alias("value")).distinct()
    coded = with_positions(values, ["value"], "code").select(F.col("code").cast("int").alias("code"), "value")
    if most is not None and coded.count() > most:
        raise ValueError(f"{column} has more than {most} values")
    return coded


def encode(df: DataFrame, column: str, entries: DataFrame, name: str = "code") -> DataFrame:
    """df with `column` replaced by its code. Catalyst sends the dictionary if it is small."""
    return df.join(entries.select(F.col("code").alias(name), F.col("value").alias("_value")), F.col(column) == F.col("_value")).drop("_value", column)


def decode(df: DataFrame, code: str, entries: DataFrame, name: str = "value") -> DataFrame:
    return df.join(entries.select(F.col("code").alias("_code"), F.col("value").alias(name)), F.col(code) == F.col("_code")).drop("_code", code)


def search_dictionary(entries: DataFrame, condition: SearchCond) -> DataFrame:
    """Entries that meet a condition; codes follow the values' order, so a range of values is one of codes."""
    return entries.where(condition.on("value"))


def filter_by_codes(encoded: DataFrame, code: str, entries: DataFrame, condition: SearchCond) -> DataFrame:
    """Rows whose codes stand for values that meet the condition, without decoding."""
    return encoded.join(search_dictionary(entries, condition).select(F.col("code").alias("_hit")), F.col(code) == F.col("_hit"), "left_semi")


def entry_id(entries: DataFrame, value) -> DataFrame:
    """The code of a value, or -1."""
    return entries.where(F.col("value") == F.lit(value)).agg(F.coalesce(F.max("code"), F.lit(-1)).alias("id"))


def bits(count: Column) -> Column:
    """Bits that a code takes: 1, 2, 4, 8 or 16."""
    return F.when(count <= 2, 1).when(count <= 4, 2).when(count <= 16, 4).when(count <= 256, 8).otherwise(16)


def dictionary_size(df: DataFrame, column: str) -> DataFrame:
    """entries, bits."""
    return df.agg(F.countDistinct(column).alias("entries")).select("entries", bits(F.col("entries")).alias("bits"))


def union_dictionaries(first: DataFrame, second: DataFrame) -> DataFrame:
    """The dictionary of both tables' values together."""
    return dictionary(first.select("value").union(second.select("value")), "value")
