"""Segments, their log, compaction and streaming."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asterfold import datagen
from asterfold.__main__ import main
from asterfold.family import Engine, Family
from asterfold.plans import mv
from asterfold.streaming import ingest


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/engine")


def marks(df):
    return df.agg(F.count("*"), F.sum("revenue"), F.min("orderkey"), F.max("orderkey")).head()


def test_append_merge_erase(spark, engine):
    family, batches = engine.create_family("f", "lineorder"), datagen.Batches(spark, 0.001)
    for _ in range(6):
        family.append(batches.next(20))
    before, names = marks(family.read()), [s.name for s in family.segments()]
    merged = [family.compact(names[i : i + 2]) for i in (0, 2, 4)]
    assert [s.name for s in family.segments()] == merged
    assert marks(family.read()) == before
    family.compact(merged)
    assert marks(family.read()) == before and len(family.segments()) == 1
    family.erase([family.segments()[0].name])
    assert family.read().count() == 0
    with pytest.raises(KeyError):
        family.compact()
    with pytest.raises(KeyError):
        engine.create_family("f", "lineorder")
    assert engine.describe().count() == 1
    engine.erase_family("f")
    with pytest.raises(KeyError):
        engine.family("f")


def test_families_outlive_the_engine(spark, engine, capsys):
    rows = datagen.lineorder(spark, 0.001, 0, 10)
    engine.create_family("f", "lineorder").append(rows, batch="one")
    again = Engine(spark, engine.path)
    assert list(again.families) == ["f"] and again.family("f").read().count() == rows.count()
    assert [tuple(r)[:4] for r in again.describe().collect()] == [("family", "f", "lineorder", 1)]
    for e in (engine, again):
        with pytest.raises(KeyError):
            e.create_family("f", "lineorder")
    engine.create_family("later", "mv")
    assert again.family("later").table == "mv"  # made meanwhile by another
    assert main(["describe", engine.path], spark) == 0
    shown = capsys.readouterr().out
    assert "family f of lineorder, key orderkey, linenumber" in shown and f"{rows.count()} rows, batch one" in shown
    again.erase_family("f")
    assert "f" not in Engine(spark, engine.path).families


def test_first_of_a_key_stays(spark, engine):
    family = Family(spark, engine.path, "d", "kv", keys=["k"], schema=T._parse_datatype_string("k int, v int"))
    make = lambda rows: spark.createDataFrame(rows, "k int, v int")
    family.insert(make([(k % 7, k) for k in range(70)]).coalesce(1), dedup=True)
    family.insert(make([(k % 9, 100 + k) for k in range(90)]).repartition(1), dedup=True)
    assert sorted(map(tuple, family.read().where("k < 7").collect())) == [(k, k) for k in range(7)]
    assert family.read().count() == 9


def test_merged_rows_are_in_key_order(spark, engine):
    family, batches = engine.create_family("o", "lineorder"), datagen.Batches(spark, 0.001)
    for _ in range(3):
        family.append(batches.next(30).orderBy(F.rand(1)))
    merged = family.segment(family.compact())
    files = merged.select("orderkey", "linenumber", F.input_file_name().alias("f")).collect()  # file by file, in row order
    by_file = {}
    for r in files:
        by_file.setdefault(r["f"], []).append((r["orderkey"], r["linenumber"]))
    assert all(own == sorted(own) for own in by_file.values())
    ends = sorted((own[0], own[-1]) for own in by_file.values())
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))  # ranges of their own


def test_current_segment(spark, engine):
    family, rows = engine.create_family("c", "lineorder"), datagen.lineorder(spark, 0.001, 0, 10)
    family.insert(rows)
    family.insert(rows, dedup=True)
    assert family.read().count() == rows.count()
    family.insert(rows)
    assert family.read().count() == 2 * rows.count()
    family.seal()
    with pytest.raises(RuntimeError):
        family.insert(rows)
    assert family.flush() and family.current is None
    assert family.read(rows).count() == 3 * rows.count()
    assert family.flush() is None


def test_batches_are_written_once(spark, engine):
    family, rows = engine.create_family("b", "lineorder"), datagen.lineorder(spark, 0.001, 0, 10)
    assert family.append(rows, batch="1") and family.append(rows, batch="1") is None
    assert family.append(rows.where("false"), batch="2") is None
    again = Family(spark, engine.path, "b", "lineorder")
    assert again.read().count() == rows.count()


def test_stream(spark, engine, tmp_path):
    family, source = engine.create_family("s", "lineorder"), f"file://{tmp_path}/in"
    datagen.lineorder(spark, 0.001, 0, 40).repartition(4).write.parquet(source)
    assert ingest.ingest(spark, source, family, f"file://{tmp_path}/check", files_per_batch=2) >= 2
    assert family.read().count() == spark.read.parquet(source).count()
    datagen.lineorder(spark, 0.001, 40, 5).write.mode("append").parquet(source)
    ingest.ingest(spark, source, family, f"file://{tmp_path}/check")
    assert family.read().count() == spark.read.parquet(source).count()


def test_commands(spark, tmp_path, capsys):
    at = f"file://{tmp_path}"
    assert main(["generate", f"{at}/tbl", "--scale", "0.0005"], spark) == 0
    assert main(["load", f"{at}/tbl", f"{at}/base"], spark) == 0
    assert main(["loadmv", f"{at}/base", f"{at}/mv"], spark) == 0
    assert spark.read.parquet(f"{at}/mv").count() == spark.read.parquet(f"{at}/base/lineorder").count()
    assert main(["tiny", f"{at}/tbl", f"{at}/tiny", "20"], spark) == 0
    assert main(["describe", f"{at}/base"], spark) == 0
    assert "lineorder:" in capsys.readouterr().out
    assert main(["bench", f"{at}/bench", "--rounds", "1", "--queries", "2", "--orders", "20", "--scale", "0.0005"], spark) == 0
    assert "total" in capsys.readouterr().out


def test_view_columns(spark):
    view = mv.from_base(**datagen.tables(spark, 0.0005))
    assert view.columns[0] == "s_region" and set(mv.CLUSTER + mv.PAYLOAD) == set(mv.as_star(view).columns)
