"""The thirteen benchmark queries, with parameters, over anything that has the star's columns.

A query needs one DataFrame of joined rows: the normalised star (sources.views.star), the materialised view
(plans.mv), or either with fresher rows added (union_all). All thirteen are filters, one grouping, one sum.
"""

from __future__ import annotations

import calendar
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterfold.operators.predicates import SearchCond
from asterfold.sources.views import Bounds

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def year_days(first: int, last: int) -> tuple[str, str]:
    return f"{first}-01-01", f"{last}-12-31"


def month_days(yearmonthnum: int) -> tuple[str, str]:
    year, month = divmod(yearmonthnum, 100)
    return f"{year}-{month:02d}-01", f"{year}-{month:02d}-{calendar.monthrange(year, month)[1]}"


@dataclass(frozen=True)
class Query:
    where: Callable[..., list[Column]]
    defaults: dict
    group: tuple[str, ...] = ()
    measure: str = "revenue"
    order: tuple[str, ...] = ()
    dimensions: str = "d"

    #: Conditions on the raw columns below the star that these parameters imply.
    bounds: Callable[..., Bounds] = lambda **_: Bounds()

    @property
    def cost(self) -> bool:
        return self.measure == "profit"


def _eq(column: str, value) -> Column:
    return SearchCond.equal(value).on(column)


def _q1(year=None, yearmonthnum=None, week=None, discount=(1, 3), quantity=(0, 24)) -> list[Column]:
    out = [SearchCond.between(*discount).on("lo_discount"), SearchCond.between(*quantity).on("lo_quantity")]
    if yearmonthnum is not None:
        # A month implies its year, which is what the view is partitioned by.
        out += [_eq("d_yearmonthnum", yearmonthnum), _eq("d_year", yearmonthnum // 100)]
    if year is not None:
        out.append(_eq("d_year", year))
    if week is not None:
        out.append(_eq("d_weeknuminyear", week))
    return out


def _q1_bounds(year=None, yearmonthnum=None, week=None, discount=(1, 3), quantity=(0, 24)) -> Bounds:
    days = year_days(year, year) if yearmonthnum is None else month_days(yearmonthnum)
    return Bounds(days if year or yearmonthnum else None, tuple(discount), tuple(quantity))


def _q3_bounds(c=None, s=None, years=(1995, 2000), level="region", yearmonth=None) -> Bounds:
    return Bounds(month_days(int(yearmonth[-4:]) * 100 + MONTHS.index(yearmonth[:3]) + 1) if yearmonth else year_days(*years))


def _q4_bounds(years=None, **_) -> Bounds:
    return Bounds(year_days(min(years), max(years)) if years else None)


def _q2(s_region, category=None, brand=None, brands=None) -> list[Column]:
    out = [_eq("s_region", s_region)]
    if category is not None:
        out.append(_eq("p_category", category))
    if brand is not None:
        out.append(_eq("p_brand1", brand))
    if brands is not None:
        out.append(SearchCond.between(*brands).on("p_brand1"))
    return out


def _q3(c=None, s=None, years=(1995, 2000), level="region", yearmonth=None) -> list[Column]:
    one = lambda p, v: SearchCond.among(v).on(f"{p}_{level}") if isinstance(v, tuple) else _eq(f"{p}_{level}", v)
    when = _eq("d_yearmonth", yearmonth) if yearmonth else SearchCond.between(*years).on("d_year")
    implied = [_eq("d_year", int(yearmonth[-4:]))] if yearmonth else []
    return [one("c", c), one("s", s), when, *implied]


def _q4(c_region=None, s_region=None, s_nation=None, years=None, mfgrs=None, category=None) -> list[Column]:
    pairs = [("c_region", c_region), ("s_region", s_region), ("s_nation", s_nation), ("p_category", category)]
    out = [_eq(column, value) for column, value in pairs if value is not None]
    for column, values in (("d_year", years), ("p_mfgr", mfgrs)):
        if values:
            out.append(SearchCond.among(values).on(column))
    return out


_CITIES = {"c": ("NATION_1 5", "NATION_1 8"), "s": ("NATION_1 3", "NATION_1 8"), "level": "city"}
_BY_TIME = ("d_year", "-revenue")
QUERIES: dict[str, Query] = {
    "q11": Query(_q1, {"year": 1996, "discount": (1, 3), "quantity": (0, 24)}, bounds=_q1_bounds),
    "q12": Query(_q1, {"yearmonthnum": 199701, "discount": (4, 6), "quantity": (26, 35)}, bounds=_q1_bounds),
    "q13": Query(_q1, {"year": 1997, "week": 6, "discount": (5, 7), "quantity": (26, 35)}, bounds=_q1_bounds),
    "q21": Query(_q2, {"category": "MFGR#12", "s_region": "AMERICA"}, ("d_year", "p_brand1"), order=("d_year", "p_brand1"), dimensions="dsp"),
    "q22": Query(_q2, {"brands": ("MFGR#2221", "MFGR#2228"), "s_region": "ASIA"}, ("d_year", "p_brand1"), order=("d_year", "p_brand1"), dimensions="dsp"),
    "q23": Query(_q2, {"brand": "MFGR#2221", "s_region": "EUROPE"}, ("d_year", "p_brand1"), order=("d_year", "p_brand1"), dimensions="dsp"),
    "q31": Query(_q3, {"c": "ASIA", "s": "ASIA"}, ("c_nation", "s_nation", "d_year"), order=_BY_TIME, dimensions="dcs", bounds=_q3_bounds),
    "q32": Query(_q3, {"c": "NATION_1", "s": "NATION_1", "level": "nation"}, ("c_city", "s_city", "d_year"), order=_BY_TIME, dimensions="dcs", bounds=_q3_bounds),
    "q33": Query(_q3, _CITIES, ("c_city", "s_city", "d_year"), order=_BY_TIME, dimensions="dcs", bounds=_q3_bounds),
    "q34": Query(_q3, {**_CITIES, "yearmonth": "Dec1997"}, ("c_city", "s_city", "d_year"), order=_BY_TIME, dimensions="dcs", bounds=_q3_bounds),
    "q41": Query(_q4, {"c_region": "AMERICA", "s_region": "AMERICA", "mfgrs": ("MFGR#1", "MFGR#2")}, ("d_year", "c_nation"), "profit", ("d_year", "c_nation"), "dcsp", bounds=_q4_bounds),
    "q42": Query(_q4, {"c_region": "AMERICA", "s_region": "AMERICA", "years": (2000, 2001), "mfgrs": ("MFGR#1", "MFGR#2")}, ("d_year", "s_nation", "p_category"), "profit", ("d_year", "s_nation", "p_category"), "dcsp", bounds=_q4_bounds),
    "q43": Query(_q4, {"s_nation": "NATION_1", "years": (2000, 2001), "category": "MFGR#14"}, ("d_year", "s_city", "p_brand1"), "profit", ("d_year", "s_city", "p_brand1"), "dsp", bounds=_q4_bounds),
}


def bounds(name: str, **parameters) -> Bounds:
    """What a query's parameters say of the raw rows, for sources.views.star to push down to the files."""
    query = QUERIES[name]
    return query.bounds(**{**query.defaults, **parameters})


def measure(query: Query) -> Column:
    if query.cost:
        return F.col("lo_revenue").cast("long") - F.col("lo_supplycost").cast("long")
    if query.group:
        return F.col("lo_revenue").cast("long")
    return F.col("lo_extendedprice").cast("long") * F.col("lo_discount").cast("long")


def run(name: str, rows: DataFrame, **parameters) -> DataFrame:
    """A query over joined rows. A sum over no rows is 0; groups whose sum is 0 stay."""
    query = QUERIES[name]
    for condition in query.where(**{**query.defaults, **parameters}):
        rows = rows.where(condition)
    total = F.sum(measure(query))
    if not query.group:
        return rows.agg(F.coalesce(total, F.lit(0)).cast("long").alias(query.measure))
    out = rows.groupBy(*query.group).agg(total.cast("long").alias(query.measure))
    return out.orderBy(*(F.col(c[1:]).desc() if c[0] == "-" else F.col(c) for c in query.order))


def merge_results(first: DataFrame, second: DataFrame, name: str) -> DataFrame:
    """Two finished results of one query added up, as sums of disjoint rows may be."""
    query = QUERIES[name]
    both = first.unionByName(second)
    if not query.group:
        return both.agg(F.coalesce(F.sum(query.measure), F.lit(0)).cast("long").alias(query.measure))
    return both.groupBy(*query.group).agg(F.sum(query.measure).cast("long").alias(query.measure))


class RandomQueries:
    """Query names and parameters drawn at random: uniform over six queries, like the benchmark's mixed load.

    Bounds are inclusive: every manufacturer, category and brand number can come up.
    """

    NAMES = ("q11", "q12", "q13", "q21", "q22", "q23")
    REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")

    def __init__(self, seed: int, first_year: int = 1995, last_year: int = 2001):
        self.random, self.years = random.Random(seed), (first_year, last_year)

    def draw(self) -> tuple[str, dict]:
        name = self.random.choice(self.NAMES)
        return name, getattr(self, f"_{name[:2]}")(name)

    def _q1(self, name: str) -> dict:
        r = self.random
        year, low, quantity = r.randint(*self.years), r.randint(0, 8), r.randint(1, 40)
        when = {"q11": {"year": year}, "q12": {"yearmonthnum": year * 100 + r.randint(1, 12)}, "q13": {"year": year, "week": r.randint(1, 53)}}[name]
        return {**when, "discount": (low, low + 2), "quantity": (0, 24) if name == "q11" else (quantity, quantity + 10)}

    def _q2(self, name: str) -> dict:
        r = self.random
        category = f"MFGR#{r.randint(1, 5)}{r.randint(1, 5)}"
        brand = r.randint(1, 40)
        what = {"q21": {"category": category}, "q22": {"brands": (f"{category}{brand}", f"{category}{brand + 7}")}, "q23": {"brand": f"{category}{brand}"}}[name]
        return {**what, "s_region": r.choice(self.REGIONS)}
