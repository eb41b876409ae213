"""Odds, implied probability and expected value as column expressions.

Division by zero gives null (``try_divide``) where the quantity has no value; nulls pass through.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtside.functions.rounding import whole

STANDARD_ODDS = -110
#: Decimal payout of a spread leg at standard odds, as the slip form prices it.
SPREAD_MULTIPLIER = 1.91


def american_odds(p: Column) -> Column:
    """Probability -> American odds, half-even to an integer."""
    favourite = -100.0 * F.try_divide(p, 1 - p)
    outsider = 100.0 * F.try_divide(1 - p, p)
    return whole(F.when(p >= 0.5, favourite).otherwise(outsider))


def implied_probability(american: Column) -> Column:
    """American odds -> the probability they imply; 0 gives 0."""
    x = american.cast("double")
    return F.when(x > 0, 100.0 / (x + 100.0)).otherwise(-x / (-x + 100.0) + 0.0)


def decimal_odds(american: Column) -> Column:
    """American odds, as a number or text such as +150 -> decimal odds; null when unreadable."""
    x = F.regexp_replace(american.cast("string"), r"\+", "").try_cast("double")
    return F.when(x > 0, 1.0 + x / 100.0).otherwise(1.0 + F.try_divide(F.lit(100.0), F.abs(x)))


def american_from_decimal(combined: Column) -> Column:
    """Decimal odds -> American odds; unreadable odds give the standard ones."""
    value = F.when(combined > 2, (combined - 1) * 100.0).otherwise(F.try_divide(F.lit(-100.0), combined - 1))
    return F.coalesce(whole(value), F.lit(STANDARD_ODDS).cast("long"))


def side_value(p: Column, american: Column) -> Column:
    """Expected value of a unit on one side."""
    x = american.cast("double")
    gain = F.when(x > 0, x / 100.0).otherwise(F.try_divide(F.lit(100.0), F.abs(x)))
    return p * gain - (1 - p)


def moneyline_value(p_home: Column, p_away: Column, home: Column, away: Column) -> Column:
    """Expected value of the better side."""
    return F.greatest(side_value(p_home, home), side_value(p_away, away))


def spread_value(p_home: Column, spread: Column) -> Column:
    """Expected value of a spread bet at standard odds; a zero spread has none."""
    adjusted = p_home - F.abs(spread) / 20.0
    return F.when(spread == 0, 0.0).otherwise(adjusted * (100.0 / 110.0) - (1 - adjusted))


def payout_multiplier(kind: Column, american: Column, legs: Column) -> Column:
    """What a unit stake returns: spread, moneyline or parlay of ``legs`` listed legs."""
    return F.when(kind == "spread", F.lit(SPREAD_MULTIPLIER)).when(kind == "moneyline", decimal_odds(american)).otherwise(F.pow(F.lit(SPREAD_MULTIPLIER), legs.cast("double")))
