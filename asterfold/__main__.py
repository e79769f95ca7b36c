"""python -m asterfold COMMAND: convert, load, loadmv, tiny, generate, describe, bench."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from asterfold import datagen, schemas
from asterfold.family import Engine
from asterfold.operators import integrity
from asterfold.plans import mv, ssb
from asterfold.sources import tbl
from asterfold.streaming import ingest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="asterfold", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("convert", "text tables to Parquet"), ("load", "text tables to Parquet, checked"), ("loadmv", "base tables in Parquet to the materialised view")):
        c = sub.add_parser(name, help=text)
        c.add_argument("source")
        c.add_argument("target")
        c.add_argument("--lenient", action="store_true", help="values that are no numbers count as 0")
    c = sub.add_parser("tiny", help="the first N facts, with the dimension rows they use, as text")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("rows", type=int)
    c = sub.add_parser("generate", help="generated tables as text or Parquet")
    c.add_argument("target")
    c.add_argument("--scale", type=float, default=0.01)
    c.add_argument("--format", choices=("tbl", "parquet"), default="tbl")
    c = sub.add_parser("describe", help="what a folder of tables holds")
    c.add_argument("source")
    c = sub.add_parser("bench", help="random queries mixed with inserts")
    c.add_argument("folder")
    for name, default in (("rounds", 3), ("queries", 6), ("orders", 1000), ("seed", 1)):
        c.add_argument(f"--{name}", type=int, default=default)
    c.add_argument("--scale", type=float, default=0.01)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("asterfold").getOrCreate()
    match a.command:
        case "convert":
            tbl.convert(spark, a.source, a.target, lenient=a.lenient)
        case "load":
            tbl.convert(spark, a.source, a.target, lenient=a.lenient)
            tables = tbl.load(spark, a.target)
            for column, dimension, key in schemas.FOREIGN_KEYS:
                if bad := integrity.orphans(tables["lineorder"], column, tables[dimension], key).count():
                    print(f"lineorder.{column}: {bad} values that {dimension} lacks")
        case "loadmv":
            mv.write(mv.from_base(**tbl.load(spark, a.source)), a.target, keys=schemas.SORT_ORDER["mv"])
        case "tiny":
            facts = integrity.first_rows(tbl.read_tbl(spark, f"{a.source}/lineorder.tbl", "lineorder"), schemas.SORT_ORDER["lineorder"], a.rows)
            tbl.write_tbl(facts, f"{a.target}/lineorder.tbl")
            for column, dimension, key in schemas.FOREIGN_KEYS:
                tbl.write_tbl(integrity.used_only(tbl.read_tbl(spark, f"{a.source}/{dimension}.tbl", dimension), key, facts, column), f"{a.target}/{dimension}.tbl")
        case "generate":
            for name, df in datagen.tables(spark, a.scale).items():
                tbl.write_tbl(df, f"{a.target}/{name}.tbl") if a.format == "tbl" else df.write.mode("overwrite").parquet(f"{a.target}/{name}")
        case "describe":
            engine = Engine(spark, a.source)
            there = [name for name in ("lineorder", "customer", "supplier", "part", "date") if name in engine.files.names()]
            for name, df in tbl.load(spark, a.source, there).items():
                print(f"{name}: {df.count()} rows, key {', '.join(schemas.SORT_ORDER[name])}")
                df.printSchema()
            for family in engine.families.values():
                print(f"family {family.name} of {family.table}, key {', '.join(family.keys)}")
                for s in family.segments():
                    print(f"  {s.name}: {s.rows} rows" + (f", batch {s.batch}" if s.batch else ""))
        case "bench":
            base = datagen.tables(spark, a.scale)
            view = lambda lines: mv.from_base(**{**base, "lineorder": lines})
            mv.write(view(base["lineorder"]), f"{a.folder}/mv", keys=schemas.SORT_ORDER["mv"])
            stored = mv.as_star(spark.read.parquet(f"{a.folder}/mv"))
            family = Engine(spark, a.folder).create_family("fresh", "mv")

            class AsStar:
                """The family under the names that queries use."""

                append, segments, compact = family.append, family.segments, family.compact

                @staticmethod
                def read(main):
                    fresh = mv.as_star(family.read())
                    return main.unionByName(fresh.select(*(F.col(c).cast(t).alias(c) for c, t in main.dtypes)))

            began = time.perf_counter()
            batches = datagen.Batches(spark, a.scale, next_order=datagen.row_counts(a.scale)["order"])
            for row in ingest.mixed_load(stored, AsStar, batches, a.rounds, a.queries, a.orders, a.seed, view):
                print(f"{row['round']} {row['what']} {row['seconds']:.3f} s, {row['rows']} rows")
            print(f"total {time.perf_counter() - began:.3f} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
