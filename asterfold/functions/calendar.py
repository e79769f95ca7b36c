"""The calendar of the date dimension. Weekdays and month ends are the true ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def year_of_month(yearmonthnum: str) -> Column:
    return F.expr(f"cast({yearmonthnum} div 100 as int)")


def add_days(day: str, n: int) -> Column:
    return F.date_add(F.col(day).cast("date"), n)


def days_between(later: str, earlier: str) -> Column:
    return F.datediff(F.col(later), F.col(earlier))


def from_key(datekey: str) -> Column:
    """The day of a yyyymmdd key."""
    return F.to_date(F.col(datekey).cast("string"), "yyyyMMdd")


def week_of_year(day: str) -> Column:
    """Weeks start on January 1st: day of year div 7, plus 1."""
    return F.expr(f"cast(dayofyear({day}) div 7 + 1 as int)")


# The selling seasons by their months, and the holidays as (month, day).
SEASONS = {"Christmas": (11, 12), "Summer": (5, 8), "Winter": (1, 3), "Spring": (4, 4), "Fall": (9, 10)}
HOLIDAYS = [(12, 24), (1, 1), (2, 20), (4, 20), (5, 20), (7, 20), (8, 20), (9, 20), (10, 20), (11, 20)]


def season(day: str) -> Column:
    out = F.lit("")
    for name, (first, last) in SEASONS.items():
        out = F.when(F.month(day).between(first, last), name).otherwise(out)
    return out


def holiday(day: str) -> Column:
    return F.date_format(day, "MMdd").isin(*(f"{month:02d}{number:02d}" for month, number in HOLIDAYS))


def date_dimension(spark: SparkSession, first: str = "1992-01-01", last: str = "1998-12-30") -> DataFrame:
    """One row for each day, with the date table's columns."""
    flag = lambda c: c.cast("byte")
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 day)) as d")
    # Spark counts Sunday as day 1.
    return days.select(
        F.date_format("d", "yyyyMMdd").cast("int").alias("datekey"), F.date_format("d", "MMMM d, yyyy").alias("date"), F.date_format("d", "EEEE").alias("dayofweek"), F.date_format("d", "MMMM").alias("month"),
        F.year("d").cast("short").alias("year"), (F.year("d") * 100 + F.month("d")).alias("yearmonthnum"), F.date_format("d", "MMMyyyy").alias("yearmonth"), F.dayofweek("d").cast("byte").alias("daynuminweek"),
        F.dayofmonth("d").cast("byte").alias("daynuminmonth"), F.dayofyear("d").cast("short").alias("daynuminyear"), F.month("d").cast("byte").alias("monthnuminyear"), week_of_year("d").cast("byte").alias("weeknuminyear"),
        season("d").alias("sellingseason"), flag(F.dayofweek("d") == 7).alias("lastdayinweekfl"), flag(F.last_day("d") == F.col("d")).alias("lastdayinmonthfl"), flag(holiday("d")).alias("holidayfl"), flag(F.dayofweek("d").between(2, 6)).alias("weekdayfl"),
    )
