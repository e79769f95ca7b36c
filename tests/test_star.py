"""The benchmark's queries on small fixed rows, the view, and the plans Spark makes."""

import pytest
from pyspark.sql import functions as F

from asterfold import datagen, schemas
from asterfold.functions import random
from asterfold.operators import integrity
from asterfold.operators.predicates import SearchCond, normalize
from asterfold.plans import delta, mv, ssb
from asterfold.sources import tbl, views

NAMES = ("lineorder", "customer", "supplier", "part", "date")


# A star of a few rows, as text, and what the queries give on it, worked out by hand.
TINY = {
    "date": """19931224|December 24, 1993|Friday|December|1993|199312|Dec1993|6|24|358|12|52|Christmas|0|0|1|1
19960203|February 3, 1996|Saturday|February|1996|199602|Feb1996|7|3|34|2|5|Winter|1|0|0|0
19970305|March 5, 1997|Wednesday|March|1997|199703|Mar1997|4|5|64|3|10|Winter|0|0|0|1
""",
    "customer": "1|C1|here|CHINA    1|CHINA|ASIA|28-1|BUILDING\n2|C2|there|PERU     2|PERU|AMERICA|27-2|MACHINERY\n",
    "supplier": "1|S1|here|INDIA    1|INDIA|ASIA|18-1\n2|S2|there|PERU     3|PERU|AMERICA|27-3\n",
    "part": "1|red lace|MFGR#1|MFGR#12|MFGR#1201|red|PROMO TIN|7|SM CASE\n2|blue lace|MFGR#2|MFGR#22|MFGR#2221|blue|LARGE TIN|8|LG BOX\n",
    # order, line, customer, part, supplier, date, priority, ship priority, quantity, price, total, discount, revenue, cost, tax, ...
    "lineorder": """1|1|1|1|1|19960203|1-URGENT|0|10|1000|3000|2|980|600|0|19960303|AIR
1|2|1|2|1|19960203|1-URGENT|0|24|2000|3000|3|1940|700|0|19960303|AIR
2|1|2|1|2|19960203|2-HIGH|0|25|500|900|1|495|100|1|19960303|RAIL
2|2|2|2|2|19970305|2-HIGH|0|30|400|900|5|380|90|1|19970405|RAIL
3|1|1|1|2|19970305|5-LOW|0|5|300|1100|1|297|310|2|19970405|SHIP
3|2|2|1|2|19931224|5-LOW|0|40|800|1100|8|736|200|2|19940124|SHIP
4|1|1|1|1|19970305|5-LOW|0|35|600|600|6|564|564|0|19970405|TRUCK
""",
}


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tiny")
    for name, text in TINY.items():
        (folder / f"{name}.tbl").write_text(text)
    return {name: tbl.read_tbl(spark, f"file://{folder}/{name}.tbl", name) for name in NAMES}


@pytest.fixture(scope="module")
def tiny_view(tiny):
    return mv.as_star(mv.from_base(**tiny)).cache()


def groups(df):
    return [tuple(r) for r in df.collect()]


_PERU = {"c": ("PERU     2",), "s": ("PERU     3",), "level": "city"}
GOLDEN = [
    ("q11", {"year": 1996, "discount": (1, 3), "quantity": (0, 24)}, [(1000 * 2 + 2000 * 3,)]),
    ("q11", {"year": 1996, "discount": (1, 3), "quantity": (0, 25)}, [(8000 + 500 * 1,)]),
    ("q11", {"year": 1900}, [(0,)]),
    ("q12", {"yearmonthnum": 199312, "discount": (7, 10), "quantity": (30, 50)}, [(800 * 8,)]),
    ("q13", {"year": 1997, "week": 10, "discount": (5, 7), "quantity": (26, 35)}, [(400 * 5 + 600 * 6,)]),
    ("q13", {"year": 1997, "week": 10, "discount": (5, 7), "quantity": (31, 35)}, [(600 * 6,)]),  # the lower bound counts
    ("q21", {"category": "MFGR#12", "s_region": "ASIA"}, [(1996, "MFGR#1201", 980), (1997, "MFGR#1201", 564)]),
    ("q22", {"brands": ("MFGR#2220", "MFGR#2228"), "s_region": "ASIA"}, [(1996, "MFGR#2221", 1940)]),
    ("q23", {"brand": "MFGR#2221", "s_region": "AMERICA"}, [(1997, "MFGR#2221", 380)]),
    ("q31", {"c": "ASIA", "s": "ASIA", "years": (1992, 1997)}, [("CHINA", "INDIA", 1996, 980 + 1940), ("CHINA", "INDIA", 1997, 564)]),
    ("q32", {"c": "PERU", "s": "PERU", "level": "nation", "years": (1992, 1997)}, [("PERU     2", "PERU     3", 1993, 736), ("PERU     2", "PERU     3", 1996, 495), ("PERU     2", "PERU     3", 1997, 380)]),
    ("q33", {**_PERU, "years": (1996, 1997)}, [("PERU     2", "PERU     3", 1996, 495), ("PERU     2", "PERU     3", 1997, 380)]),
    ("q34", {**_PERU, "yearmonth": "Mar1997"}, [("PERU     2", "PERU     3", 1997, 380)]),
    ("q41", {"c_region": "AMERICA", "s_region": "AMERICA", "mfgrs": ("MFGR#1", "MFGR#2")}, [(1993, "PERU", 736 - 200), (1996, "PERU", 495 - 100), (1997, "PERU", 380 - 90)]),
    ("q41", {"c_region": "ASIA", "s_region": "ASIA", "mfgrs": ("MFGR#1",)}, [(1996, "CHINA", 380), (1997, "CHINA", 0)]),  # a sum of 0 stays
    ("q42", {"c_region": "AMERICA", "s_region": "AMERICA", "years": (1996, 1997), "mfgrs": ("MFGR#1", "MFGR#2")}, [(1996, "PERU", "MFGR#12", 395), (1997, "PERU", "MFGR#22", 290)]),
    ("q43", {"s_nation": "PERU", "years": (1996, 1997), "category": "MFGR#12"}, [(1996, "PERU     3", "MFGR#1201", 395), (1997, "PERU     3", "MFGR#1201", 297 - 310)]),
]


@pytest.mark.parametrize("name,parameters,expected", GOLDEN)
def test_golden(tiny_view, name, parameters, expected):
    assert groups(ssb.run(name, tiny_view, **parameters)) == expected


def test_delta_is_read(spark, tiny_view):
    both = delta.union_all(tiny_view, mv.as_star(delta.test_rows(spark)))
    # Of the fresh rows one has 1996, discount 3, price 13; one December 1993, discount 7, price 17, quantity 35.
    assert groups(ssb.run("q11", both, year=1996, discount=(1, 5), quantity=(0, 29))) == [(8500 + 3 * 13,)]
    assert groups(ssb.run("q12", both, yearmonthnum=199312, discount=(7, 10), quantity=(30, 50))) == [(6400 + 7 * 17,)]
    # Quantity 15 is outside of 30 to 40: no fresh row counts.
    assert groups(ssb.run("q13", both, year=1996, week=5, discount=(0, 10), quantity=(30, 40))) == [(0,)]


def test_tiny_integrity(tiny):
    for column, dimension, key in schemas.FOREIGN_KEYS:
        assert integrity.orphans(tiny["lineorder"], column, tiny[dimension], key).count() == 0
    assert integrity.duplicates(tiny["lineorder"], schemas.SORT_ORDER["lineorder"]).count() == 0


def test_text_round_trip(spark, tiny, tmp_path):
    for name, df in tiny.items():
        tbl.write_tbl(df, f"file://{tmp_path}/{name}.tbl")
        back = tbl.read_tbl(spark, f"file://{tmp_path}/{name}.tbl", name)
        assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0
    tbl.convert(spark, f"file://{tmp_path}", f"file://{tmp_path}/parquet")
    assert {n: d.count() for n, d in tbl.load(spark, f"file://{tmp_path}/parquet").items()} == {n: d.count() for n, d in tiny.items()}


def test_lenient_numbers(spark, tmp_path):
    (tmp_path / "x.tbl").write_text("7|a|b|c|d|e|f\nseven|a|b|c|d|e|f\n\n")
    rows = tbl.read_tbl(spark, f"file://{tmp_path}/x.tbl", "supplier", lenient=True).collect()
    assert sorted(r["suppkey"] for r in rows) == [0, 7]


def test_conditions(spark):
    df = spark.createDataFrame([(i, f"k{i}") for i in range(10)], "n int, s string")
    count = lambda c, on: df.where(c.on(on)).count()
    assert [count(c, "n") for c in (SearchCond.equal(3), SearchCond.less(3), SearchCond.greater(3), SearchCond.at_most(3), SearchCond.at_least(3), SearchCond.between(3, 5), SearchCond.among((1, 99)), SearchCond.among(()))] == [1, 3, 6, 4, 7, 3, 1, 0]
    assert count(SearchCond.between("k3", "k5"), "s") == 3
    assert count(SearchCond.equal("k3\x00\x00"), "s") == 1
    with pytest.raises(ValueError):
        normalize("too long", 3)
    assert str(SearchCond.between(1, 2)) == "BETWEEN 1 AND 2"


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().toString()


def test_filters_reach_the_files(spark, sf_dir):
    shown = plan(ssb.run("q21", mv.stored(spark, sf_dir)))
    assert "PartitionFilters: [isnotnull(s_region" in shown and "EqualTo(p_category,MFGR#12)" in shown
    read = shown.rpartition("ReadSchema: ")[2].splitlines()[0]
    assert "lo_extendedprice" not in read and "lo_revenue" in read


def test_conditions_reach_the_base_tables(spark, sf_dir):
    """Dates, discounts and quantities are tested in the scans, on the files' own columns, before any join."""

    def pushed(name, table):
        shown = plan(ssb.run(name, views.star(spark, sf_dir, ssb.QUERIES[name].dimensions, ssb.QUERIES[name].cost, ssb.bounds(name)))).rpartition("== Physical Plan ==")[2]
        return next(x for x in shown.splitlines() if f"{table}.parquet" in x)

    for name in ("q11", "q12", "q13"):
        scan = pushed(name, "lineitem").rpartition("PushedFilters")[2]
        assert "GreaterThanOrEqual(l_discount" in scan and "LessThan(l_quantity" in scan
    for name in ("q11", "q12", "q13", "q31", "q34", "q42", "q21"):
        scan = pushed(name, "orders").rpartition("PushedFilters")[2]
        assert "GreaterThanOrEqual(o_orderdate" in scan and "LessThan(o_orderdate" in scan
    assert "1997-12-01" in pushed("q34", "orders") and "1998-01-01" in pushed("q34", "orders")


def test_view_is_made_anew_when_its_tables_change(spark, sf_dir, tmp_path):
    for name in ("lineitem", "orders", "customer", "supplier", "part", "nation", "region"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"file://{tmp_path}/{name}.parquet")
    at = f"file://{tmp_path}"
    before = mv.stored(spark, at).count()
    assert mv.stored(spark, at).inputFiles() == mv.stored(spark, at).inputFiles()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(100).write.mode("overwrite").parquet(f"{at}/lineitem.parquet")
    assert mv.stored(spark, at).count() < before


def test_no_needless_join(spark, sf_dir):
    shown = plan(ssb.run("q11", views.star(spark, sf_dir, "d", cost=False)))
    assert "part.parquet" not in shown and "supplier.parquet" not in shown


def test_random_queries_run(spark, sf_dir):
    draw, view = ssb.RandomQueries(1223345), mv.stored(spark, sf_dir).cache()
    seen = set()
    for _ in range(12):
        name, parameters = draw.draw()
        seen.add(name)
        ssb.run(name, view, **parameters).collect()
    assert len(seen) > 3


def test_generated_tables(spark):
    tables = datagen.tables(spark, 0.001)
    for name, df in tables.items():
        assert [f.name for f in df.schema] == schemas.TABLES[name].names
        assert integrity.duplicates(df, schemas.SORT_ORDER[name]).count() == 0
    for column, dimension, key in schemas.FOREIGN_KEYS:
        assert integrity.orphans(tables["lineorder"], column, tables[dimension], key).count() == 0
    lines = tables["lineorder"].agg(F.min("discount"), F.max("discount"), F.min("quantity"), F.max("quantity")).head()
    assert tuple(lines) == (0, 10, 1, 50)
    again = datagen.lineorder(spark, 0.001).repartition(7)
    assert again.exceptAll(tables["lineorder"]).count() == 0


def test_generated_words(spark):
    parts = datagen.part(spark, 0.01)
    assert len(set(datagen.COLORS)) == 92 and len(set(datagen.TYPES)) == 150 and len(set(datagen.CONTAINERS)) == 40
    found = parts.agg(F.countDistinct("color"), F.countDistinct("type"), F.countDistinct("container")).head()
    assert tuple(found) == (92, 150, 40)


def test_distributions(spark):
    rows = spark.range(20_000)
    by = {r["v"]: r["count"] for r in rows.select(random.weighted(F.col("id"), "w", {"a": 1, "b": 3, "c": 0, "d": 6}).alias("v")).groupBy("v").count().collect()}
    assert set(by) == {"a", "b", "d"} and abs(by["a"] - 2000) < 200 and abs(by["b"] - 6000) < 300
    x = rows.select(random.exponential(F.col("id"), "e", 5.0).alias("x")).agg(F.avg("x"), F.min("x"), F.stddev("x")).head()
    assert abs(x[0] - 5) < 0.2 and x[1] >= 0 and abs(x[2] - 5) < 0.3


def test_batches_continue(spark):
    batches = datagen.Batches(spark, 0.001)
    first, second = batches.next(100), batches.next(100)
    assert first.join(second, "orderkey", "left_semi").count() == 0
    assert first.select("orderkey").distinct().count() == 100
    assert datagen.update_set(first, 0, 1 << 30, second).count() == second.count()


def test_generated_orders_add_up(spark):
    lines = datagen.lineorder(spark, 0.001, 0, 50)
    assert "Exchange" not in plan(lines).rpartition("== Physical Plan ==")[2]
    # Exact integer arithmetic, spelled out.
    totals = {}
    for r in lines.collect():
        assert r["revenue"] == r["extendedprice"] * (100 - r["discount"]) // 100
        got = totals.setdefault(r["orderkey"], [0, r["ordertotalprice"]])
        got[0] += r["revenue"] * (100 + r["tax"]) // 100
    assert len(totals) == 50 and all(a == b for a, b in totals.values())
