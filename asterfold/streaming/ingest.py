"""Structured Streaming into a family, and the mixed load of queries and inserts."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold.datagen import Batches
from asterfold.family import Family
from asterfold.plans import ssb


def ingest(spark: SparkSession, source: str, family: Family, checkpoint: str, files_per_batch: int = 100) -> int:
    """Streams the Parquet files under `source` into the family, a segment for each micro-batch, until all
    present files are in. How many segments came of it.

    The batch's number is part of its segment's name in the log: a batch that runs again after a failure is
    recognised, so that each file's rows are in exactly once.
    """
    before = len(family.segments())
    stream = spark.readStream.schema(family.schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(lambda rows, n: family.append(rows, batch=f"{checkpoint}#{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(family.segments()) - before


def mixed_load(view: DataFrame, family: Family, batches: Batches, rounds: int, queries: int, orders: int, seed: int, to_view, compact_at: int = 8) -> list[dict]:
    """Rounds of random queries over view and family, each followed by a batch of inserts; seconds of each.

    to_view makes view rows of a batch. The family is compacted whenever it has `compact_at` segments.
    """
    draw = ssb.RandomQueries(seed)
    out = []
    for number in range(rounds):
        for _ in range(queries):
            name, parameters = draw.draw()
            began = time.perf_counter()
            rows = ssb.run(name, family.read(view), **parameters).collect()
            out.append({"round": number, "what": name, "seconds": time.perf_counter() - began, "rows": len(rows)})
        began = time.perf_counter()
        family.append(to_view(batches.next(orders)), batch=f"load-{seed}-{number}")
        if len(family.segments()) >= compact_at:
            family.compact()
        out.append({"round": number, "what": "insert", "seconds": time.perf_counter() - began, "rows": orders})
    return out


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events by window and type, with a watermark. An extension: the star schema has no event time."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
