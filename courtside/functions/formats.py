"""Number, date and matchup texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtside.functions.rounding import rounded


def percent_text(p: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", rounded(p * 100.0, digits))


def signed_text(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%+.{digits}f", rounded(x, digits))


def moneyline_text(american: Column) -> Column:
    return F.when(american > 0, F.concat(F.lit("+"), american.cast("string"))).otherwise(american.cast("string"))


def eastern(utc_minute: Column) -> tuple[Column, Column]:
    """ISO minute in UTC -> US Eastern date and h:mm AM text."""
    local = F.from_utc_timestamp(F.try_to_timestamp(utc_minute, F.lit("yyyy-MM-dd'T'HH:mmX")), "US/Eastern")
    return F.date_format(local, "yyyy-MM-dd"), F.date_format(local, "h:mm a")


def long_date(day: Column) -> Column:
    return F.date_format(day, "EEEE, MMMM d, yyyy")


def clock(feed_time: Column) -> Column:
    """The time of day of an ISO text, without a fraction."""
    return F.regexp_extract(feed_time, r"T([^.]*)", 1)


def score_text(home: Column, away: Column) -> Column:
    return F.concat_ws("-", home.cast("string"), away.cast("string"))


def versus(home: Column, away: Column) -> Column:
    return F.concat_ws(" vs ", home, away)


def first_where(items: Column, test) -> Column:
    """The first element that passes, or null."""
    return F.get(F.filter(items, test), F.lit(0))
