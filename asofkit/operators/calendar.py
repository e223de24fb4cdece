"""Exchange sessions by rule, session numbers and period ends, as generated dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FIRST_YEAR, LAST_YEAR = 2022, 2030
#: Closures of the exchange that follow no rule.
SPECIAL_CLOSURES = ("2025-01-09",)


def _nth_weekday(year: Column, month: int, weekday: str, n: int) -> Column:
    """The n-th such weekday of a month (n = -1: the last)."""
    if n == -1:
        last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
        return F.next_day(F.date_sub(last, 7), weekday)
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), weekday), 7 * (n - 1))


def _easter(y: Column) -> Column:
    """Western Easter by the anonymous Gregorian computus."""
    f = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = y % 19, f(y, 100), y % 100
    d, e = f(b, 4), b % 4
    g = f(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = f(c, 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = f(a + 11 * h + 22 * m, 451)
    month = f(h + m - 7 * n + 114, 31)
    return F.make_date(y, month, (h + m - 7 * n + 114) % 31 + 1)


def _observed(d: Column, saturday_moves: bool = True) -> Column:
    """Sunday holidays move to Monday; Saturday ones to Friday (New Year's Day does not, as Friday is in the old year)."""
    moved = F.when(F.dayofweek(d) == 1, F.date_add(d, 1))
    return (moved.when(F.dayofweek(d) == 7, F.date_sub(d, 1)) if saturday_moves else moved.when(F.dayofweek(d) == 7, F.lit(None).cast("date"))).otherwise(d)


def holidays(spark: SparkSession, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """``day`` of every weekday on which the exchange is closed."""
    if first < FIRST_YEAR or last > LAST_YEAR:
        raise ValueError(f"the calendar covers {FIRST_YEAR} to {LAST_YEAR}")
    y = F.col("y")
    fixed = lambda month, day: F.make_date(y, F.lit(month), F.lit(day))
    rules = [
        _observed(fixed(1, 1), saturday_moves=False), _nth_weekday(y, 1, "Mon", 3), _nth_weekday(y, 2, "Mon", 3), F.date_sub(_easter(y), 2),
        _nth_weekday(y, 5, "Mon", -1), _observed(fixed(6, 19)), _observed(fixed(7, 4)), _nth_weekday(y, 9, "Mon", 1), _nth_weekday(y, 11, "Thu", 4), _observed(fixed(12, 25)),
    ]
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("y"))
    days = years.select(F.explode(F.array(*rules)).alias("day")).filter("day is not null")
    special = spark.range(len(SPECIAL_CLOSURES)).select(F.to_date(F.element_at(F.array(*[F.lit(d) for d in SPECIAL_CLOSURES]), F.col("id").cast("int") + 1)).alias("day"))
    return days.unionByName(special.filter(F.year("day").between(first, last))).distinct()


def sessions(spark: SparkSession, start: str, end: str) -> DataFrame:
    """``day, session_no`` for the open days between two dates (numbers count from ``start``)."""
    first, last = int(start[:4]), int(end[:4])
    every = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))
    open_ = every.filter(F.weekday("day") < 5).join(F.broadcast(holidays(spark, first, last)), "day", "left_anti")  # at most 11 days a year
    return open_.withColumn("session_no", F.row_number().over(W.orderBy("day")))  # at most 262 days a year


def session_distance(df: DataFrame, calendar: DataFrame, a: str, b: str, name: str = "sessions_between") -> DataFrame:
    """Sessions from column ``a`` to column ``b``; NULL if either is no session."""
    at = lambda c, n: F.broadcast(calendar.select(F.col("day").alias(c), F.col("session_no").alias(n)))
    joined = df.join(at(a, "__a"), a, "left").join(at(b, "__b"), b, "left")
    return joined.withColumn(name, F.col("__b") - F.col("__a")).drop("__a", "__b")


def iso_week(day: Column | str) -> Column:
    """ISO year and week as one number; the year is the year of the week."""
    day = F.col(day) if isinstance(day, str) else day
    return (F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day)).cast("int")


def last_session_of_week(df: DataFrame, day: str = "session", keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys, iso_week(day).alias("iso_week")).agg(F.max(day).alias(day))


def first_session_of_month(df: DataFrame, day: str = "session", keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys, F.trunc(day, "month").alias("month")).agg(F.min(day).alias(day))


def midpoint_quarter(start: Column, end: Column) -> tuple[Column, Column]:
    """Calendar (year, quarter) of the middle of a period."""
    middle = F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))
    return F.year(middle), F.quarter(middle)


def quarterly_contracts(spark: SparkSession, first_year: int, last_year: int, roll_days: int = 8) -> DataFrame:
    """Contracts that expire on the third Friday of March, June, September and December, with their front windows."""
    months = spark.range((last_year - first_year + 1) * 4).select((F.lit(first_year) + F.floor(F.col("id") / 4)).cast("int").alias("y"), (F.col("id") % 4 * 3 + 3).cast("int").alias("m"))
    expiry = F.date_add(F.next_day(F.date_sub(F.make_date("y", "m", F.lit(1)), 1), "Fri"), 14)
    code = F.concat(F.element_at(F.array(*map(F.lit, "HMUZ")), F.floor(F.col("m") / 3).cast("int")), F.lpad((F.col("y") % 100).cast("string"), 2, "0"))
    rows = months.select(code.alias("contract"), expiry.alias("expiry"))
    return rows.withColumn("front_from", F.date_sub(F.lag("expiry").over(W.orderBy("expiry")), roll_days)).withColumn("front_to", F.date_sub("expiry", roll_days + 1))
