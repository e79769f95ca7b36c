"""Positions, runs and dictionaries against plain Python."""

from itertools import groupby

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from asterfold.functions.random import Lcg
from asterfold.operators import columns, scans
from asterfold.operators.predicates import SearchCond


def runs_of(values):
    out, at = [], 0
    for v, g in groupby(values):
        n = len(list(g))
        out.append((v, at, at + n))
        at += n
    return out


def positioned(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int").repartition(5)
    return columns.with_positions(df, ["i"])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60))
def test_runs(spark, values):
    p = positioned(spark, values)
    assert sorted((r["pos"], r["v"]) for r in p.collect()) == list(enumerate(values))
    r = columns.runs(p, "v")
    assert sorted(((x["value"], x["begin"], x["end"]) for x in r.collect()), key=lambda x: x[1]) == runs_of(values)
    assert sorted((x["pos"], x["value"]) for x in columns.decode_runs(r).collect()) == list(enumerate(values))


def test_run_over_all_partitions(spark):
    df = spark.range(1000).selectExpr("cast(id as int) i", "1 v").repartition(4)
    assert [tuple(r) for r in columns.runs(columns.with_positions(df, ["i"]), "v").select("value", "begin", "end").collect()] == [(1, 0, 1000)]


def test_ranges_merge_and_clamp(spark):
    values = [1] * 5 + [2] * 5 + [3] * 5 + [1] * 5
    r = columns.runs(positioned(spark, values), "v")
    got = lambda df: sorted((x["begin"], x["end"]) for x in df.collect())
    assert got(columns.ranges(r, SearchCond.among((1, 2)))) == [(0, 10), (15, 20)]
    assert got(columns.ranges(r, SearchCond.among((1, 2)), within=(3, 17))) == [(3, 10), (15, 17)]
    assert got(columns.ranges(r, SearchCond.equal(9))) == []
    assert columns.longest_run(r).head()[0] == 5


def test_dictionary(spark):
    df = spark.createDataFrame([(w,) for w in "b c a b a".split()], "w string")
    d = columns.dictionary(df, "w")
    assert sorted(tuple(r) for r in d.select("code", "value").collect()) == [(0, "a"), (1, "b"), (2, "c")]
    with pytest.raises(ValueError):
        columns.dictionary(df, "w", most=2)
    coded = columns.encode(df.withColumnRenamed("w", "x"), "x", d)
    assert sorted(r[0] for r in coded.collect()) == [0, 0, 1, 1, 2]
    assert columns.filter_by_codes(coded, "code", d, SearchCond.at_least("b")).count() == 3
    assert sorted(r["value"] for r in columns.decode(coded, "code", d).collect()) == sorted("b c a b a".split())
    assert columns.entry_id(d, "zz").head()[0] == -1


def test_scans(spark):
    df = spark.createDataFrame([(i, i // 100) for i in range(1000)], "k int, n int")
    assert scans.range_scan(df, "k", 500).count() == 500
    assert scans.range_scan(df, "k", 250, 300).count() == 50
    assert scans.at_least(df, ["n", "k"], [5, 550]).count() == 450
    assert scans.point_lookup(df, k=5, n=0).count() == 1
    assert scans.point_lookup(df, k=5, n=1).count() == 0
    seen = []
    assert scans.traverse(df, ["k"], lambda r: (seen.append(r["k"]), r["k"] < 9)[1]) == 10
    assert seen == list(range(10))
    assert scans.ordered(df, ["k"], descending=True).first()["k"] == 999


def test_generator_skips():
    a, b = Lcg(42), Lcg(42)
    for _ in range(1000):
        a.next()
    b.skip(1000)
    assert a.state == b.state
    assert all(3 <= a.between(3, 5) <= 5 for _ in range(100))
