"""Betting risk: four components, their weighted sum, a level and insight texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions.rounding import clamp
from courtside.params import RISK_LEVELS, RISK_WEIGHTS


#: The main text by level of risk, the texts of single components with their bounds, and the fallback.
MAIN_TEXTS = ("Strong opportunity with solid statistical backing", "Balanced risk-reward profile with moderate confidence", "High-risk bet with potential for variance")
COMPONENT_TEXTS = (
    ("confidence_risk", 0.6, "Model shows lower confidence in prediction"),
    ("odds_risk", 0.7, "Line movement suggests market uncertainty"),
    ("volatility_risk", 0.6, "Recent performance shows high variability"),
    ("historical_risk", 0.7, "Historical matchup data indicates unpredictability"),
)
FALLBACK_TEXT = "Unable to calculate detailed risk analysis"


def confidence_risk(confidence: Column, agree: Column) -> Column:
    return clamp(1 - F.coalesce(confidence, F.lit(0.5)) + F.when(F.coalesce(agree, F.lit(True)), 0.0).otherwise(0.2), 0.0, 1.0)


def odds_risk(home: Column, away: Column) -> Column:
    """Disparity of the money lines; one half without them."""
    h, a = F.abs(home.cast("double")), F.abs(away.cast("double"))
    return F.when(h.isNull() | a.isNull(), 0.5).otherwise(F.least(F.abs(h - a) / F.greatest(h + 1, a + 1), F.lit(1.0)))


def volatility_risk() -> Column:
    return clamp((F.abs(F.col("hp") - F.col("ha")) + F.abs(F.col("ap") - F.col("aa"))) / 40.0, 0.0, 1.0)


def historical_risk() -> Column:
    return F.least(1 - F.abs(F.coalesce("hw", F.lit(0.5)) - F.coalesce("aw", F.lit(0.5))), F.lit(1.0))


def level(score: Column) -> Column:
    """Inclusive bounds; above the highest is very_high."""
    return F.when(score <= RISK_LEVELS["low"], "low").when(score <= RISK_LEVELS["medium"], "medium").when(score <= RISK_LEVELS["high"], "high").otherwise("very_high")


def insights() -> Column:
    """The main text, by strict bounds, and one text for each high component."""
    low, middle, high = MAIN_TEXTS
    main = F.when(F.col("risk_score") < RISK_LEVELS["low"], low).when(F.col("risk_score") < RISK_LEVELS["medium"], middle).otherwise(high)
    return F.array_compact(F.array(main, *[F.when(F.col(name) > bound, words) for name, bound, words in COMPONENT_TEXTS]))


def assess(forecasts: DataFrame, agree: Column | None = None, home_ml: Column | None = None, away_ml: Column | None = None) -> DataFrame:
    """Adds the components, risk_score, risk_level and insights; a row whose score has no value gets the fallback."""
    none = F.lit(None).cast("double")
    parts = forecasts.withColumns({
        "confidence_risk": confidence_risk(F.col("confidence"), F.lit(True) if agree is None else agree),
        "odds_risk": odds_risk(none if home_ml is None else home_ml, none if away_ml is None else away_ml),
        "volatility_risk": volatility_risk(),
        "historical_risk": historical_risk(),
    })
    total = sum((F.col(f"{name}_risk") * w for name, w in list(RISK_WEIGHTS.items())[1:]), F.col("confidence_risk") * RISK_WEIGHTS["confidence"])
    scored = parts.withColumn("raw_risk", total).withColumn("risk_score", F.coalesce("raw_risk", F.lit(0.5)))
    fallback = F.array(F.lit(FALLBACK_TEXT))
    return scored.withColumns({"risk_level": level(F.col("risk_score")), "insights": F.when(F.col("raw_risk").isNull(), fallback).otherwise(insights())}).drop("raw_risk")
