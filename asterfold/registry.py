"""All registered queries, each with the SQL that DuckDB gives the same rows for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterfold import datagen, schemas
from asterfold.family import Family
from asterfold.functions import calendar, keys, pricing, random, text
from asterfold.operators import aggregates, columns, integrity, scans
from asterfold.operators.predicates import SearchCond, search
from asterfold.plans import delta, mv, ssb
from asterfold.scratch import materialise, new_path
from asterfold.sources import tbl, views
from asterfold.streaming import ingest

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

#: The star schema in DuckDB's dialect.
STAR = """with ssb_dwdate as (
  select cast(strftime(d, '%Y%m%d') as int) d_datekey, cast(year(d) as int) d_year, cast(year(d) * 100 + month(d) as int) d_yearmonthnum, strftime(d, '%b%Y') d_yearmonth, cast(dayofyear(d) // 7 + 1 as int) d_weeknuminyear
  from (select unnest(generate_series(timestamp '1995-01-01', timestamp '2001-12-31', interval 1 day)) d)),
ssb_part as (
  select p_partkey, 'MFGR#' || m p_mfgr, 'MFGR#' || m || c p_category, 'MFGR#' || m || c || b p_brand1, retail
  from (select p_partkey, cast((cast(substr(p_brand, 7) as int) - 1) // 5 + 1 as varchar) m, cast((cast(substr(p_brand, 7) as int) - 1) % 5 + 1 as varchar) c, cast(p_partkey % 40 + 1 as varchar) b, cast(round(p_retailprice * 100) as bigint) retail from part)),
ssb_supplier as (
  select s_suppkey, rpad(substr(n_name, 1, 9), 9, ' ') || cast(s_suppkey % 10 as varchar) s_city, n_name s_nation, r_name s_region
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
ssb_customer as (
  select c_custkey, rpad(substr(n_name, 1, 9), 9, ' ') || cast(c_custkey % 10 as varchar) c_city, n_name c_nation, r_name c_region
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
ssb_lineorder as (
  select l_orderkey lo_orderkey, l_linenumber lo_linenumber, o_custkey lo_custkey, l_partkey lo_partkey, l_suppkey lo_suppkey, cast(strftime(o_orderdate, '%Y%m%d') as int) lo_orderdate, o_orderpriority lo_orderpriority,
         cast(l_quantity as int) lo_quantity, cast(round(l_extendedprice * 100) as bigint) lo_extendedprice, cast(round(l_discount * 100) as int) lo_discount, cast(round(l_tax * 100) as int) lo_tax,
         cast(round(l_extendedprice * 100) as bigint) * (100 - cast(round(l_discount * 100) as int)) // 100 lo_revenue, 6 * retail // 10 lo_supplycost
  from lineitem join orders on l_orderkey = o_orderkey join ssb_part on l_partkey = p_partkey),
star as (
  select * from ssb_lineorder join ssb_dwdate on lo_orderdate = d_datekey join ssb_customer on lo_custkey = c_custkey join ssb_supplier on lo_suppkey = s_suppkey join ssb_part on lo_partkey = p_partkey)
"""


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        _queries[key] = f
        if sql is not None:
            _sql[key] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries["q21"](spark, sf_dir)


# -- the thirteen queries, over the normalised star and over the view

_Q1 = "coalesce(cast(sum(lo_extendedprice * lo_discount) as bigint), 0) revenue"
_REV, _PROFIT = "cast(sum(lo_revenue) as bigint) revenue", "cast(sum(lo_revenue - lo_supplycost) as bigint) profit"
_CITY = "c_city in ('NATION_1 5', 'NATION_1 8') and s_city in ('NATION_1 3', 'NATION_1 8')"
_SSB_SQL = {
    "q11": (_Q1, "d_year = 1996 and lo_discount between 1 and 3 and lo_quantity < 25", ""),
    "q12": (_Q1, "d_yearmonthnum = 199701 and lo_discount between 4 and 6 and lo_quantity between 26 and 35", ""),
    "q13": (_Q1, "d_weeknuminyear = 6 and d_year = 1997 and lo_discount between 5 and 7 and lo_quantity between 26 and 35", ""),
    "q21": (_REV, "p_category = 'MFGR#12' and s_region = 'AMERICA'", "d_year, p_brand1"),
    "q22": (_REV, "p_brand1 between 'MFGR#2221' and 'MFGR#2228' and s_region = 'ASIA'", "d_year, p_brand1"),
    "q23": (_REV, "p_brand1 = 'MFGR#2221' and s_region = 'EUROPE'", "d_year, p_brand1"),
    "q31": (_REV, "c_region = 'ASIA' and s_region = 'ASIA' and d_year between 1995 and 2000", "c_nation, s_nation, d_year"),
    "q32": (_REV, "c_nation = 'NATION_1' and s_nation = 'NATION_1' and d_year between 1995 and 2000", "c_city, s_city, d_year"),
    "q33": (_REV, f"{_CITY} and d_year between 1995 and 2000", "c_city, s_city, d_year"),
    "q34": (_REV, f"{_CITY} and d_yearmonth = 'Dec1997'", "c_city, s_city, d_year"),
    "q41": (_PROFIT, "c_region = 'AMERICA' and s_region = 'AMERICA' and p_mfgr in ('MFGR#1', 'MFGR#2')", "d_year, c_nation"),
    "q42": (_PROFIT, "c_region = 'AMERICA' and s_region = 'AMERICA' and d_year in (2000, 2001) and p_mfgr in ('MFGR#1', 'MFGR#2')", "d_year, s_nation, p_category"),
    "q43": (_PROFIT, "s_nation = 'NATION_1' and d_year in (2000, 2001) and p_category = 'MFGR#14'", "d_year, s_city, p_brand1"),
}


def _ssb_sql(name: str, source: str = "star") -> str:
    total, where, group = _SSB_SQL[name]
    return f"{STAR} select {group + ', ' if group else ''}{total} from {source} where {where}" + (f" group by {group}" if group else "")


def _normalised(name: str):
    q = ssb.QUERIES[name]
    return lambda spark, sf_dir: ssb.run(name, views.star(spark, sf_dir, q.dimensions, q.cost, ssb.bounds(name)))


def _with_delta(name: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        fresh = mv.as_star(delta.test_rows(spark))
        return ssb.run(name, delta.union_all(mv.stored(spark, sf_dir), fresh))

    return f


_FRESH = ", fresh as (select * from (values {rows}) t(s_region, d_year, d_yearmonthnum, lo_quantity, lo_discount, lo_extendedprice, lo_revenue, lo_supplycost, d_weeknuminyear, p_category, p_brand1)), both_ as (select {cols} from star union all select {cols} from fresh)"


def _delta_sql(name: str) -> str:
    rows = []
    for i in range(10):
        region, category, brand = (f"'{x[i % 5]}'" for x in (delta._REGIONS, delta._CATEGORIES, delta._BRANDS))
        year = 1993 + i % 7
        rows.append(f"({region}, {year}, {year * 100 + 12}, {5 * i}, {i}, {10 + i}, {20 + i}, {50 + i}, 5, {category}, {brand})")
    cols = "s_region, d_year, d_yearmonthnum, lo_quantity, lo_discount, lo_extendedprice, lo_revenue, lo_supplycost, d_weeknuminyear, p_category, p_brand1"
    total, where, group = _SSB_SQL[name]
    return STAR + _FRESH.format(rows=", ".join(rows), cols=cols) + f" select {group + ', ' if group else ''}{total} from both_ where {where}" + (f" group by {group}" if group else "")


for _name in ssb.QUERIES:
    query(_ssb_sql(_name), _name)(_normalised(_name))
    query(_ssb_sql(_name), f"mv_{_name}")(lambda spark, sf_dir, n=_name: ssb.run(n, mv.stored(spark, sf_dir)))
for _name in ("q11", "q12", "q13", "q21", "q22", "q23"):
    query(_delta_sql(_name), f"delta_{_name}")(_with_delta(_name))


@query(f"{STAR} select {', '.join(mv.CLUSTER + mv.PAYLOAD)} from star")
def mv_build(spark, sf_dir):
    return mv.build(views.star(spark, sf_dir))


# -- predicates on an integer and a string column

_CONDITIONS = {
    "eq": (SearchCond.equal, (25,), ("MFGR#1212",), "= {0}"), "lt": (SearchCond.less, (25,), ("MFGR#1212",), "< {0}"), "gt": (SearchCond.greater, (25,), ("MFGR#1212",), "> {0}"),
    "lteq": (SearchCond.at_most, (25,), ("MFGR#1212",), "<= {0}"), "gteq": (SearchCond.at_least, (25,), ("MFGR#1212",), ">= {0}"), "between": (SearchCond.between, (26, 35), ("MFGR#2221", "MFGR#2228"), "between {0} and {1}"),
    "in": (lambda *k: SearchCond.among(k), (1, 7, 50), ("MFGR#1212", "MFGR#2221", "none"), "in ({0}, {1}, {2})"),
}
for _kind, (_make, _ints, _strings, _text) in _CONDITIONS.items():
    query(f"{STAR} select lo_orderkey, lo_linenumber, lo_quantity from ssb_lineorder where lo_quantity {_text.format(*_ints)}", f"pred_{_kind}")(
        lambda spark, sf_dir, c=_make(*_ints): search(views.lineorder(spark, sf_dir), lo_quantity=c).select("lo_orderkey", "lo_linenumber", "lo_quantity")
    )
    query(f"{STAR} select p_partkey, p_brand1 from ssb_part where p_brand1 {_text.format(*(repr(s) for s in _strings))}", f"pred_str_{_kind}")(
        lambda spark, sf_dir, c=_make(*_strings): search(views.part(spark, sf_dir), p_brand1=c).select("p_partkey", "p_brand1")
    )


@query(f"{STAR} select lo_orderkey, lo_linenumber from star where lo_discount between 4 and 6 and lo_quantity >= 40 and d_year = 1997")
def pred_chain(spark, sf_dir):
    rows = search(views.star(spark, sf_dir, "d", cost=False), lo_discount=SearchCond.between(4, 6), lo_quantity=SearchCond.at_least(40), d_year=SearchCond.equal(1997))
    return rows.select("lo_orderkey", "lo_linenumber")


# -- positions and runs: orders by status, year and key

_RUN_KEYS = ["o_orderstatus", "y", "o_orderkey"]
_ORDERED = "with o as (select o_orderstatus, cast(year(o_orderdate) as int) y, o_orderkey, o_orderpriority from orders), p as (select *, row_number() over (order by o_orderstatus, y, o_orderkey) - 1 pos from o)"
_RUNS = _ORDERED + ", f as (select *, case when lag(y) over (order by pos) = y then 0 else 1 end f from p), g as (select *, sum(f) over (order by pos) g from f), r as (select any_value(y) \"value\", min(pos) \"begin\", max(pos) + 1 \"end\" from g group by g)"


def _ordered(spark, sf_dir) -> DataFrame:
    rows = views.table(spark, sf_dir, "orders").select("o_orderstatus", F.year("o_orderdate").alias("y"), "o_orderkey", "o_orderpriority")
    return columns.with_positions(rows, _RUN_KEYS)


def _runs(spark, sf_dir) -> DataFrame:
    return columns.runs(_ordered(spark, sf_dir), "y")


@query(f"{_ORDERED} select pos, o_orderkey, o_orderstatus, y from p")
def positions(spark, sf_dir):
    return _ordered(spark, sf_dir).select("pos", "o_orderkey", "o_orderstatus", "y")


@query(f'{_RUNS} select "value", "begin", "end" from r')
def rle_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(f'{_RUNS} select "begin", "end" from r where "value" = 1997')
def rle_ranges_eq(spark, sf_dir):
    return columns.ranges(_runs(spark, sf_dir), SearchCond.equal(1997))


_MERGED = ', h as (select *, case when lag("end") over (order by "begin") = "begin" then 0 else 1 end n from r where "value" in (1996, 1997, 1999)), i as (select *, sum(n) over (order by "begin") k from h), ranges as (select min("begin") "begin", max("end") "end" from i group by k)'


@query(f'{_RUNS}{_MERGED} select "begin", "end" from ranges')
def rle_ranges_in(spark, sf_dir):
    return columns.ranges(_runs(spark, sf_dir), SearchCond.among((1996, 1997, 1999)))


@query(f'{_RUNS}{_MERGED} select greatest("begin", 100) "begin", least("end", 900) "end" from ranges where "begin" < 900 and "end" > 100')
def rle_ranges_clamped(spark, sf_dir):
    return columns.ranges(_runs(spark, sf_dir), SearchCond.among((1996, 1997, 1999)), within=(100, 900))


@query(f'{_ORDERED} select pos, y "value" from p')
def rle_decode(spark, sf_dir):
    return columns.decode_runs(_runs(spark, sf_dir))


@query(f'{_RUNS} select max("end" - "begin") longest from r')
def run_longest(spark, sf_dir):
    return columns.longest_run(_runs(spark, sf_dir))


@query(f"{_ORDERED} select pos, y between 1996 and 1997 matched from p")
def position_bitmap(spark, sf_dir):
    return columns.bitmap(_ordered(spark, sf_dir), SearchCond.between(1996, 1997), "y")


@query(f'{_ORDERED} select pos, o_orderpriority "value" from p where pos >= 50 and pos < 250')
def values_at_positions(spark, sf_dir):
    return columns.values_at(_ordered(spark, sf_dir), "o_orderpriority", 50, 250)


# -- dictionaries

_DICT = f'{STAR}, e as (select cast(row_number() over (order by p_brand1) - 1 as int) code, p_brand1 "value" from (select distinct p_brand1 from ssb_part))'


def _brands(spark, sf_dir) -> DataFrame:
    return materialise(columns.dictionary(views.part(spark, sf_dir), "p_brand1"), "dictionary")


@query(f'{_DICT} select code, "value" from e')
def dict_entries(spark, sf_dir):
    return _brands(spark, sf_dir)


@query(f'{_DICT} select p_partkey, code from ssb_part join e on p_brand1 = "value"')
def dict_encode(spark, sf_dir):
    return columns.encode(views.part(spark, sf_dir).select("p_partkey", "p_brand1"), "p_brand1", _brands(spark, sf_dir))


@query(f'{_DICT} select p_partkey, p_brand1 "value" from ssb_part')
def dict_decode(spark, sf_dir):
    entries = _brands(spark, sf_dir)
    coded = columns.encode(views.part(spark, sf_dir).select("p_partkey", "p_brand1"), "p_brand1", entries)
    return columns.decode(coded, "code", entries).select("p_partkey", "value")


@query(f"""{_DICT} select code, "value" from e where "value" between 'MFGR#2221' and 'MFGR#2228'""")
def dict_search(spark, sf_dir):
    return columns.search_dictionary(_brands(spark, sf_dir), SearchCond.between("MFGR#2221", "MFGR#2228"))


@query(f"{STAR} select cast(n as bigint) entries, case when n <= 2 then 1 when n <= 4 then 2 when n <= 16 then 4 when n <= 256 then 8 else 16 end bits from (select count(distinct p_brand1) n from ssb_part)")
def dict_bits(spark, sf_dir):
    return columns.dictionary_size(views.part(spark, sf_dir), "p_brand1")


@query(f"""{_DICT} select coalesce(max(code), -1) id from e where "value" = 'MFGR#2221' union all select coalesce(max(code), -1) from e where "value" = 'MFGR#9999'""")
def dict_entry_id(spark, sf_dir):
    entries = _brands(spark, sf_dir)
    return columns.entry_id(entries, "MFGR#2221").union(columns.entry_id(entries, "MFGR#9999"))


@query(f"""{_DICT} select p_partkey, code from ssb_part join e on p_brand1 = "value" where "value" in ('MFGR#1212', 'MFGR#2221', 'MFGR#5540')""")
def dict_filter(spark, sf_dir):
    entries = _brands(spark, sf_dir)
    coded = columns.encode(views.part(spark, sf_dir).select("p_partkey", "p_brand1"), "p_brand1", entries)
    return columns.filter_by_codes(coded, "code", entries, SearchCond.among(("MFGR#1212", "MFGR#2221", "MFGR#5540")))


@query("""select cast(row_number() over (order by v) - 1 as int) code, v "value" from (select c_mktsegment v from customer union select o_orderpriority from orders)""")
def dict_union(spark, sf_dir):
    first, second = (columns.dictionary(views.table(spark, sf_dir, t), c) for t, c in (("customer", "c_mktsegment"), ("orders", "o_orderpriority")))
    return columns.union_dictionaries(first, second)


# -- scans

_MV_COLS = "lo_orderkey, lo_linenumber, s_region, d_year, c_city, lo_revenue"


def _mv_rows(df: DataFrame) -> DataFrame:
    return df.select(*_MV_COLS.split(", "))


@query(f"{STAR} select {_MV_COLS} from star")
def full_scan(spark, sf_dir):
    return _mv_rows(scans.full_scan(mv.stored(spark, sf_dir)))


@query(f"{STAR} select {_MV_COLS} from star where d_year < 1997")
def full_scan_until(spark, sf_dir):
    return _mv_rows(scans.full_scan(mv.stored(spark, sf_dir), until=F.col("d_year") >= 1997))


@query("select o_orderkey, o_custkey from orders where o_orderkey = 77")
def point_lookup(spark, sf_dir):
    return scans.point_lookup(views.table(spark, sf_dir, "orders"), o_orderkey=77).select("o_orderkey", "o_custkey")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey >= 500")
def range_scan_ge(spark, sf_dir):
    return scans.range_scan(views.table(spark, sf_dir, "lineitem"), "l_orderkey", 500).select("l_orderkey", "l_linenumber", "l_partkey")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey >= 500 and l_orderkey < 900")
def range_scan_between(spark, sf_dir):
    return scans.range_scan(views.table(spark, sf_dir, "lineitem"), "l_orderkey", 500, 900).select("l_orderkey", "l_linenumber", "l_partkey")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey > 500 or (l_orderkey = 500 and l_linenumber >= 3)")
def composite_scan_ge(spark, sf_dir):
    return scans.at_least(views.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [500, 3]).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"{STAR} select {_MV_COLS} from star where d_year = 1997 and s_region in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')")
def skip_scan(spark, sf_dir):
    return _mv_rows(scans.skip_scan(mv.stored(spark, sf_dir), "s_region", datagen.REGIONS, "d_year", 1997))


@query(f"{STAR} select {_MV_COLS} from star where s_region = 'ASIA'")
def prefix_scan(spark, sf_dir):
    return _mv_rows(scans.prefix_scan(mv.stored(spark, sf_dir), "s_region", "ASIA"))


@query("select row_number() over (order by o_orderdate, o_orderkey) n, o_orderkey from orders")
def sorted_traverse(spark, sf_dir):
    rows = columns.with_positions(views.table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"])
    return rows.select((F.col("pos") + 1).alias("n"), "o_orderkey")


# -- unions, merges, families

@query(f"{STAR} select s_region, d_year, count(*) n, cast(sum(lo_revenue) as bigint) revenue from (select s_region, d_year, lo_revenue from star union all select s_region, d_year, lo_revenue from star where d_year = 1999) group by all")
def union_main_delta(spark, sf_dir):
    main = mv.stored(spark, sf_dir)
    both = delta.union_all(main, main.where("d_year = 1999"))
    return both.groupBy("s_region", "d_year").agg(F.count("*").alias("n"), F.sum("lo_revenue").cast("long").alias("revenue"))


@query(f"{STAR} select d_year, p_brand1, cast(sum(lo_revenue) as bigint) revenue from star where s_region = 'AMERICA' group by all")
def partial_final_sum(spark, sf_dir):
    main = mv.stored(spark, sf_dir).where("s_region = 'AMERICA'")
    early, late = (aggregates.partial_sums(main.where(c), ["d_year", "p_brand1"], "lo_revenue") for c in ("d_yearmonthnum < 199807", "d_yearmonthnum >= 199807"))
    return aggregates.final_sums([early, late], ["d_year", "p_brand1"], "revenue")


@query(_ssb_sql("q21"))
def merge_results(spark, sf_dir):
    main = mv.stored(spark, sf_dir)
    return ssb.merge_results(ssb.run("q21", main.where("lo_orderkey % 2 = 0")), ssb.run("q21", main.where("lo_orderkey % 2 <> 0")), "q21")


def _family(spark, sf_dir) -> Family:
    rows = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    family = Family(spark, new_path(spark, "families"), "lines", "lines", keys=["l_orderkey", "l_linenumber"], schema=rows.schema)
    for k in range(4):
        family.append(rows.where(F.pmod("l_orderkey", F.lit(4)) == k), batch=f"part-{k}")
    return family


@query("select l_orderkey, l_linenumber, l_partkey, l_shipdate from lineitem")
def merge_fractures(spark, sf_dir):
    family = _family(spark, sf_dir)
    first = family.segments()
    merged = [family.compact([a.name, b.name]) for a, b in (first[:2], first[2:])]
    family.compact(merged)
    return family.read()


@query("select 4 segments_before, 1 segments_after, count(*) \"rows\", count(*) rows_listed from lineitem")
def compaction_files(spark, sf_dir):
    family = _family(spark, sf_dir)
    before = len(family.segments())
    family.compact()
    after = family.segments()
    return family.read().agg(F.lit(before).alias("segments_before"), F.lit(len(after)).alias("segments_after"), F.count("*").alias("rows")).withColumn("rows_listed", F.lit(sum(s.rows for s in after)).cast("long"))


@query("select l_orderkey, l_linenumber, l_partkey, l_shipdate from lineitem")
def stream_ingest(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    source, target = new_path(spark, "stream"), new_path(spark, "families")
    rows.repartition(6, "l_orderkey").write.parquet(source)
    family = Family(spark, target, "lines", "lines", keys=["l_orderkey", "l_linenumber"], schema=rows.schema)
    ingest.ingest(spark, source, family, f"{target}/checkpoint", files_per_batch=2)
    return family.read()


@query("select date_trunc('hour', ts) \"start\", event_type, count(*) n from events where ts is not null group by all")
def event_windows(spark, sf_dir):
    return ingest.windowed_counts(views.table(spark, sf_dir, "events"))


@query("select s_suppkey, s_name, s_nationkey from supplier")
def tbl_roundtrip(spark, sf_dir):
    path = new_path(spark, "supplier_tbl")
    blank = [F.lit("").alias(c) for c in ("address", "city", "nation", "region", "phone")]
    rows = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("suppkey"), F.col("s_name").alias("name"), *blank[:2], F.col("s_nationkey").cast("string").alias("nation"), *blank[3:])
    tbl.write_tbl(rows, path)
    return tbl.read_tbl(spark, path, "supplier").select(F.col("suppkey").cast("long").alias("s_suppkey"), F.col("name").alias("s_name"), keys.to_int("nation").alias("s_nationkey"))


# Text tables of each type, over the driver's tables; columns that these lack are made of their keys.
_TBL = {
    "customer": ("customer", "c_custkey custkey, c_name name, 'a' || c_custkey address, '' city, cast(c_nationkey as {string}) nation, ' r' region, '1/2' phone, c_mktsegment mktsegment"),
    "part": ("part", "p_partkey partkey, p_name name, 'M' mfgr, 'C' category, p_brand brand, '\"q\"' color, p_type type, cast(p_size as {tiny}) size, '' container"),
    "lineorder": ("lineitem", "l_orderkey orderkey, cast(l_linenumber as {tiny}) linenumber, 7 custkey, l_partkey partkey, l_suppkey suppkey, 19970101 orderdate, '1-URGENT' orderpriority, '0' shippriority, cast(l_quantity as {tiny}) quantity, cast(round(l_extendedprice * 100) as int) extendedprice, -1 ordertotalprice, cast(round(l_discount * 100) as {tiny}) discount, 0 revenue, 5 supplycost, cast(round(l_tax * 100) as {tiny}) tax, 19970102 commitdate, l_returnflag || ' ' shipmode"),
    "date": ("orders", "cast(o_orderkey as int) datekey, o_orderstatus date, 'Monday' dayofweek, 'May' month, cast(1997 as {small}) year, 199705 yearmonthnum, 'May1997' yearmonth, cast(1 as {tiny}) daynuminweek, cast(2 as {tiny}) daynuminmonth, cast(3 as {small}) daynuminyear, cast(5 as {tiny}) monthnuminyear, cast(20 as {tiny}) weeknuminyear, '' sellingseason, cast(0 as {tiny}) lastdayinweekfl, cast(0 as {tiny}) lastdayinmonthfl, cast(1 as {tiny}) holidayfl, cast(1 as {tiny}) weekdayfl"),
}


def _tbl_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns_ = _TBL[name]
    rows = views.table(spark, sf_dir, source).selectExpr(*columns_.format(string="string", tiny="tinyint", small="smallint").split(", "))
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.TABLES[name].fields))


def _tbl_sql(name: str) -> str:
    source, columns_ = _TBL[name]
    whole = {"byte": "int", "short": "int", "int": "int", "tinyint": "int", "smallint": "int"}
    out = [f'cast("{f.name}" as {whole.get(f.dataType.simpleString(), "varchar")}) "{f.name}"' for f in schemas.TABLES[name].fields]
    named = ", ".join(c[: c.rindex(" ")] + ' "' + c[c.rindex(" ") + 1 :] + '"' for c in columns_.format(string="varchar", tiny="int", small="int").split(", "))
    return f"select {', '.join(out)} from (select {named} from {source})"


def _tbl_query(name: str):
    def f(spark, sf_dir):
        path = new_path(spark, f"{name}_tbl")
        tbl.write_tbl(_tbl_source(spark, sf_dir, name), path)
        back = tbl.read_tbl(spark, path, name)
        return back.select(*(F.col(n).cast("int").alias(n) if t in ("tinyint", "smallint") else F.col(n) for n, t in back.dtypes))

    return f


for _name in _TBL:
    query(_tbl_sql(_name), f"tbl_{_name}")(_tbl_query(_name))


# -- integrity and subsets

@query("select l_orderkey, l_linenumber, count(*) n from lineitem group by all having count(*) > 1")
def pk_duplicates(spark, sf_dir):
    return integrity.duplicates(views.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_FKS = [("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey")]


@query(" union all ".join(f"select '{k}' fk, count(distinct {k}) orphans from {f} where not exists (select 1 from {d} where {dk} = {k})" for f, k, d, dk in _FKS))
def fk_orphans(spark, sf_dir):
    out = None
    for fact, key, dim, dim_key in _FKS:
        one = integrity.orphans(views.table(spark, sf_dir, fact), key, views.table(spark, sf_dir, dim), dim_key).agg(F.lit(key).alias("fk"), F.count("*").alias("orphans"))
        out = one if out is None else out.union(one)
    return out


_FIRST = "select * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey limit 200"


def _first(spark, sf_dir) -> DataFrame:
    return integrity.first_rows(views.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 200)


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey from ({_FIRST})")
def tiny_fact(spark, sf_dir):
    return _first(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"select p_partkey, p_name from part where p_partkey in (select l_partkey from ({_FIRST}))")
def tiny_semijoin(spark, sf_dir):
    return integrity.used_only(views.table(spark, sf_dir, "part"), "p_partkey", _first(spark, sf_dir), "l_partkey").select("p_partkey", "p_name")


# -- counts

@query(f"{STAR} select lo_orderdate, count(*) n from ssb_lineorder group by all")
def count_by_orderdate(spark, sf_dir):
    return aggregates.count_by(views.lineorder(spark, sf_dir), "lo_orderdate")


@query("select l_quantity, count(*) n from lineitem group by all")
def histogram(spark, sf_dir):
    return aggregates.count_by(views.table(spark, sf_dir, "lineitem"), "l_quantity")


@query("select distinct c_mktsegment from customer")
def distinct_values(spark, sf_dir):
    return aggregates.distinct_values(views.table(spark, sf_dir, "customer"), "c_mktsegment")


@query("select count(*) filter (where l_quantity between 10 and 20) matched from lineitem")
def match_count(spark, sf_dir):
    return columns.match_count(views.table(spark, sf_dir, "lineitem"), SearchCond.between(10, 20).on("l_quantity"))


@query("select count(*) n from lineitem")
def row_count(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


# -- functions

@query("select (l_orderkey << 8) + l_linenumber packed, l_orderkey o, cast(l_linenumber as int) l from lineitem")
def packed_pk(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select(keys.packed_key("l_orderkey", "l_linenumber").alias("packed"))
    return rows.select("packed", keys.unpacked_order("packed").alias("o"), keys.unpacked_line("packed").alias("l"))


@query("select l_orderkey, l_linenumber, case when (l_orderkey, l_linenumber) < (500, 3) then -1 when (l_orderkey, l_linenumber) > (500, 3) then 1 else 0 end cmp from lineitem")
def tuple_key_extract(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").withColumns({"a": F.lit(500), "b": F.lit(3)})
    return rows.select("l_orderkey", "l_linenumber", keys.tuple_compare(["l_orderkey", "l_linenumber"], ["a", "b"]).alias("cmp"))


@query(f"{STAR} select distinct d_yearmonthnum, cast(d_yearmonthnum // 100 as int) y from ssb_dwdate")
def yearmonth_to_year(spark, sf_dir):
    return views.dwdate(spark).select("d_yearmonthnum", calendar.year_of_month("d_yearmonthnum").alias("y")).distinct()


@query("select p_partkey, 90000 + (p_partkey // 10) % 20001 + (p_partkey % 1000) * 100 price from part")
def retail_price(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", pricing.retail_price("p_partkey").alias("price"))


@query(f"{STAR} select lo_orderkey, lo_linenumber, lo_extendedprice * (100 - lo_discount) // 100 revenue, 6 * lo_extendedprice // 10 cost, lo_extendedprice * lo_discount discounted from ssb_lineorder")
def revenue_calc(spark, sf_dir):
    rows = views.lineorder(spark, sf_dir)
    return rows.select("lo_orderkey", "lo_linenumber", pricing.revenue("lo_extendedprice", "lo_discount").alias("revenue"), pricing.supply_cost("lo_extendedprice").alias("cost"), pricing.discounted("lo_extendedprice", "lo_discount").alias("discounted"))


@query(f"{STAR} select lo_orderkey, cast(sum((lo_extendedprice * (100 - lo_discount) // 100) * (100 + lo_tax) // 100) as bigint) total from ssb_lineorder group by all")
def order_total(spark, sf_dir):
    rows = views.lineorder(spark, sf_dir)
    return rows.groupBy("lo_orderkey").agg(F.sum(pricing.line_total("lo_extendedprice", "lo_discount", "lo_tax")).alias("total"))


@query("select o_orderkey, (o_orderkey // 8) * 32 + o_orderkey % 8 sparse from orders")
def sparse_key(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select("o_orderkey", keys.sparse_key("o_orderkey").alias("sparse"))


@query("select n_name, rpad(substr(n_name, 1, 9), 9, ' ') || cast(n_nationkey % 10 as varchar) city from nation")
def city_code(spark, sf_dir):
    return views.table(spark, sf_dir, "nation").select("n_name", text.city("n_name", "n_nationkey").alias("city"))


@query("select p_partkey, split_part(p_name, ' ', 1) color, case when instr(p_name, ' ') > 0 then substr(p_name, instr(p_name, ' ') + 1) else '' end rest from part")
def part_color(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", text.color("p_name").alias("color"), text.without_color("p_name").alias("rest"))


@query("""select cast(strftime(d, '%Y%m%d') as int) datekey, dayname(d) dayofweek, monthname(d) "month", cast(year(d) as int) "year", cast(year(d) * 100 + month(d) as int) yearmonthnum, strftime(d, '%b%Y') yearmonth, cast(dayofweek(d) + 1 as int) daynuminweek,
 cast(day(d) as int) daynuminmonth, cast(dayofyear(d) as int) daynuminyear, cast(dayofyear(d) // 7 + 1 as int) weeknuminyear, cast(dayofweek(d) = 6 as int) lastdayinweekfl, cast(last_day(d) = cast(d as date) as int) lastdayinmonthfl, cast(dayofweek(d) between 1 and 5 as int) weekdayfl,
 case when month(d) >= 11 then 'Christmas' when month(d) >= 9 then 'Fall' when month(d) >= 5 then 'Summer' when month(d) = 4 then 'Spring' else 'Winter' end sellingseason,
 cast(strftime(d, '%m%d') in ('1224', '0101', '0220', '0420', '0520', '0720', '0820', '0920', '1020', '1120') as int) holidayfl
 from (select unnest(generate_series(timestamp '1992-01-01', timestamp '1998-12-30', interval 1 day)) d)""")
def date_dim(spark, sf_dir):
    names = ["datekey", "dayofweek", "month", "year", "yearmonthnum", "yearmonth", "daynuminweek", "daynuminmonth", "daynuminyear", "weeknuminyear", "lastdayinweekfl", "lastdayinmonthfl", "weekdayfl", "sellingseason", "holidayfl"]
    return calendar.date_dimension(spark).select(*(F.col(c).cast("int").alias(c) if t in ("tinyint", "smallint") else c for c, t in calendar.date_dimension(spark).dtypes if c in names))


@query("select o_orderkey, cast(cast(o_orderdate as date) + 30 as date) due, cast(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as int) age from orders")
def date_arithmetic(spark, sf_dir):
    rows = views.table(spark, sf_dir, "orders").withColumns({"first": F.lit(19950101)}).withColumn("first_day", calendar.from_key("first"))
    return rows.select("o_orderkey", calendar.add_days("o_orderdate", 30).alias("due"), calendar.days_between("o_orderdate", "first_day").alias("age"))


@query("select o_orderkey, (o_orderkey * 16807 % 2147483647) * 16807 % 2147483647 state from orders")
def lcg_states(spark, sf_dir):
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", random.lcg_step("o_orderkey").alias("one"))
    return rows.select("o_orderkey", random.lcg_step("one").alias("state"))


@query("select p_partkey, coalesce(try_cast(substr(p_brand, 7) as int), 0) number, coalesce(try_cast(p_type as int), 0) junk, rpad(p_brand, 12, ' ') padded from part")
def text_numbers(spark, sf_dir):
    rows = views.table(spark, sf_dir, "part").withColumn("tail", F.expr("substr(p_brand, 7)"))
    return rows.select("p_partkey", keys.to_int("tail").alias("number"), keys.to_int("p_type").alias("junk"), keys.padded("p_brand", 12).alias("padded"))


@query("select l_orderkey, l_linenumber, case when l_orderkey % 2 = 0 then 1 else 3 end \"insert\" from lineitem group by all")
def insert_dedup(spark, sf_dir):
    """Of rows of one key the first stays: `insert` numbers the four parts in the order they come in."""
    rows = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    numbered = lambda df, n: df.withColumn("insert", F.lit(n))
    family = Family(spark, new_path(spark, "families"), "keys", "keys", keys=["l_orderkey", "l_linenumber"], schema=numbered(rows, 0).schema)
    even = rows.where("l_orderkey % 2 = 0")
    family.insert(numbered(even, 1).union(numbered(even, 2)), dedup=True)
    family.insert(numbered(rows, 3).union(numbered(rows, 4)), dedup=True)
    family.flush()
    return family.read()


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey > 500 or (l_orderkey = 500 and l_linenumber >= 3)")
def fresh_scan_ge(spark, sf_dir):
    """A scan by key over a written segment and a current one in memory."""
    family = _fresh(spark, sf_dir)
    return scans.at_least(family.read(), ["l_orderkey", "l_linenumber"], [500, 3])


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey = 77")
def fresh_lookup(spark, sf_dir):
    family = _fresh(spark, sf_dir)
    found = scans.point_lookup(family.read(), l_orderkey=77)
    return found.union(scans.point_lookup(family.read(), l_orderkey=-1))


def _fresh(spark, sf_dir) -> Family:
    rows = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    family = Family(spark, new_path(spark, "families"), "fresh", "fresh", keys=["l_orderkey", "l_linenumber"], schema=rows.schema)
    family.append(rows.where("l_orderkey % 3 <> 0"))
    family.insert(rows.where("l_orderkey % 3 = 0"))
    return family


@query(f"{STAR} select p_brand1, cast(sum(lo_revenue) as bigint) revenue from ssb_lineorder join ssb_part on lo_partkey = p_partkey group by all")
def sum_by_code(spark, sf_dir):
    """Summed up by dictionary code, decoded after: sums, not rows, meet the dictionary."""
    entries = _brands(spark, sf_dir)
    parts = columns.encode(views.part(spark, sf_dir).select("p_partkey", "p_brand1"), "p_brand1", entries)
    sums = views.lineorder(spark, sf_dir).join(parts, F.col("lo_partkey") == F.col("p_partkey")).groupBy("code").agg(F.sum("lo_revenue").cast("long").alias("revenue"))
    return columns.decode(sums, "code", entries).select(F.col("value").alias("p_brand1"), "revenue")


@query(f"{STAR} select o, p from (select lo_orderkey o, lo_partkey p from ssb_lineorder where lo_orderkey not between 100 and 199) union all select lo_orderkey, lo_partkey from ssb_lineorder where lo_orderkey between 300 and 349")
def update_set(spark, sf_dir):
    rows = views.lineorder(spark, sf_dir).select(F.col("lo_orderkey").alias("orderkey"), F.col("lo_partkey").alias("p"))
    return datagen.update_set(rows, 100, 200, rows.where("orderkey between 300 and 349")).select(F.col("orderkey").alias("o"), "p")


@query("select row_number() over (order by o_orderdate desc, o_orderkey desc) n, o_orderkey from orders")
def reverse_traverse(spark, sf_dir):
    rows = columns.with_positions(views.table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"])
    return rows.select((F.lit(rows.count()) - F.col("pos")).alias("n"), "o_orderkey")


@query("select o_orderkey from orders")
def permuted_orders(spark, sf_dir):
    return random.permuted(views.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", seed=3)


def _random_sql() -> str:
    """The same ten queries spelled out."""
    draw, parts = ssb.RandomQueries(7), []
    for number in range(10):
        name, p = draw.draw()
        if name[:2] == "q1":
            parts.append(f"select {number} number, '{name}' query, 1 \"rows\"")
            continue
        brand = {"q21": lambda p: f"p_category = '{p['category']}'", "q22": lambda p: "p_brand1 between '{}' and '{}'".format(*p["brands"]), "q23": lambda p: f"p_brand1 = '{p['brand']}'"}[name](p)
        parts.append(f"select {number}, '{name}', count(*) from (select distinct d_year, p_brand1 from star where s_region = '{p['s_region']}' and {brand})")
    return f"{STAR} {' union all '.join(parts)}"


@query(_random_sql())
def random_queries(spark, sf_dir):
    """Ten random queries' names and how many rows they have."""
    draw, view = ssb.RandomQueries(7), mv.stored(spark, sf_dir)
    out = None
    for number in range(10):
        name, parameters = draw.draw()
        one = ssb.run(name, view, **parameters).agg(F.lit(number).alias("number"), F.lit(name).alias("query"), F.count("*").alias("rows"))
        out = one if out is None else out.union(one)
    return out


@query("select count(*) \"rows\", count(distinct o_orderkey) distinct_keys from orders")
def key_counts(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").agg(F.count("*").alias("rows"), F.countDistinct("o_orderkey").alias("distinct_keys"))


@query("select 1500 orders, 0 bad_revenue, 0 bad_total, 0 bad_place, 0 no_customer, 0 no_supplier, 0 no_part, 0 no_date")
def generated_invariants(spark, sf_dir):
    """What must hold of any generated table, whatever its random values are."""
    tables = datagen.tables(spark, 0.001)
    lines = tables["lineorder"]
    revenue = F.expr("extendedprice * (100 - discount) div 100")
    own = lines.groupBy("orderkey").agg(F.sum(F.expr("(extendedprice * (100 - discount) div 100) * (100 + tax) div 100")).alias("total"), F.min("ordertotalprice").alias("said"), F.max("linenumber").alias("last"), F.count("*").alias("n"))
    sums = own.agg(F.count("*").alias("orders"), F.count_if(F.col("total") != F.col("said")).alias("bad_total"), F.count_if(F.col("last") != F.col("n")).alias("bad_place"))
    out = sums.crossJoin(lines.agg(F.count_if(F.col("revenue") != revenue).alias("bad_revenue")))  # one row each
    for column, dimension, key in schemas.FOREIGN_KEYS:
        out = out.crossJoin(integrity.orphans(lines, column, tables[dimension], key).agg(F.count("*").alias(f"no_{dimension}")))
    return out


@query(None)
def generated_lines(spark, sf_dir):
    return datagen.lineorder(spark, 0.001)


@query(None)
def generated_dimensions(spark, sf_dir):
    out = None
    for name, df in datagen.tables(spark, 0.001).items():
        one = aggregates.fingerprint(df).select(F.lit(name).alias("name"), "rows", "checksum")
        out = one if out is None else out.union(one)
    return out
