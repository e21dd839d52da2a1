"""Calendar columns: weekday, season, month and Japanese public holidays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .values import any_of, col, known

WINTER, SUMMER = (12, 1, 2), (6, 7, 8)
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def day_of_week(date: Column | str) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(col(date))


def is_weekend(date: Column | str) -> Column:
    return day_of_week(date).isin(5, 6).cast("int")


def season(month: Column | str) -> Column:
    m = col(month)
    return (
        F.when(m.isin(12, 1, 2), "Winter")
        .when(m.isin(3, 4, 5), "Spring")
        .when(m.isin(6, 7, 8), "Summer")
        .when(m.isin(9, 10, 11), "Autumn")
    )


def month_name(month: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), col(month).cast("int"))


def month_start(date: Column | str) -> Column:
    return F.trunc(col(date), "MM")


def _statutory_holiday(y: Column, md: Column, weekday: Column) -> Column:
    """Holidays named by law (from 1995 on), before substitutes and bridge days.

    ``md`` is month · 100 + day.
    """
    shifted = y.isin(2020, 2021)

    def nth_monday(month: int, nth: int) -> Column:
        first = month * 100 + 7 * nth - 6
        return md.between(first, first + 6)

    drift = F.lit(0.242194) * (y - 1980) - F.floor((y - 1980) / 4)
    mondays = [
        nth_monday(1, 2) & (y >= 2000), nth_monday(7, 3) & (y >= 2003) & ~shifted,
        nth_monday(9, 3) & (y >= 2003), nth_monday(10, 2) & (y >= 2000) & ~shifted,
    ]
    return any_of([
        md.isin(101, 211, 429, 503, 505, 1103, 1123),
        (md == F.floor(320.8431 + drift)) | (md == F.floor(923.2488 + drift)),
        md.isin(115, 1010) & (y <= 1999), (md == 915) & (y <= 2002), (md == 720) & y.between(1996, 2002),
        (md == 1223) & (y <= 2018), (md == 504) & (y >= 2007), (md == 811) & (y >= 2016) & ~shifted,
        (md == 223) & (y >= 2020), (weekday == 0) & any_of(mondays),
        # One-off dates of 2019 to 2021, as yyyymmdd (fixed values).
        (y * 10000 + md).isin(20190501, 20191022, 20200723, 20200724, 20200810, 20210722, 20210723, 20210808),
    ])


def is_japanese_holiday(date: Column | str) -> Column:
    """Public holidays from 1995 on, with substitute days and bridge days.

    A pure column rule: no join and no calendar table to keep up to date.
    """
    d = col(date)
    days = F.array(*[
        F.struct(F.year(x).alias("y"), (F.month(x) * 100 + F.dayofmonth(x)).alias("md"), F.weekday(x).alias("w"))
        for x in (F.date_add(d, k) for k in range(-3, 2))
    ])
    around = F.transform(days, lambda x: _statutory_holiday(x["y"], x["md"], x["w"]))

    def rule(h: Column) -> Column:
        def named(shift: int) -> Column:
            return F.get(h, F.lit(shift + 3))

        def on_sunday(shift: int) -> Column:
            return F.weekday(F.date_add(d, shift)) == 6

        # Before 2007 only the Monday after counts; since then the next day that is no holiday.
        substitute = named(-1) & (
            on_sunday(-1)
            | ((F.year(d) >= 2007) & named(-2) & (on_sunday(-2) | (named(-3) & on_sunday(-3))))
        )
        bridge = named(-1) & named(1) & (F.weekday(d) != 6)
        return named(0) | substitute | bridge

    # One-element transforms bind the five flags once, so the rule stays a small expression.
    return known(F.get(F.transform(F.array(around), rule), F.lit(0)))


def add_calendar(df: DataFrame, date: str = "date", holidays: DataFrame | None = None) -> DataFrame:
    """Add dow, is_weekend, is_holiday, is_weekend_or_holiday and month.

    ``holidays`` is an optional ``(date)`` dimension; the built-in rule is used without it.
    """
    if holidays is None:
        out = df.withColumn("is_holiday", is_japanese_holiday(date).cast("int"))
    else:
        days = holidays.select(F.col("date").alias(date)).distinct().withColumn("_h", F.lit(1))
        out = (
            df.join(days, date, "left")
            .withColumn("is_holiday", F.coalesce(F.col("_h"), F.lit(0)))
            .drop("_h")
        )
    return out.withColumns({
        "dow": day_of_week(date),
        "is_weekend": is_weekend(date),
        "is_weekend_or_holiday": F.greatest(is_weekend(date), F.col("is_holiday")),
        "month": F.month(F.col(date)),
    })
