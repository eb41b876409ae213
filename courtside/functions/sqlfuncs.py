"""The odds and risk rules as SQL functions: expressions that the optimiser inlines, so nothing leaves the JVM."""

from pyspark.sql import SparkSession

#: name(arguments) -> returned type and expression.
FUNCTIONS = {
    "american_odds(p DOUBLE)": ("BIGINT", "CAST(rint(CASE WHEN p >= 0.5D THEN -100D * try_divide(p, 1D - p) ELSE 100D * try_divide(1D - p, p) END) AS BIGINT)"),
    "implied_probability(ml DOUBLE)": ("DOUBLE", "CASE WHEN ml > 0 THEN 100D / (ml + 100D) ELSE -ml / (-ml + 100D) + 0D END"),
    "decimal_odds(ml DOUBLE)": ("DOUBLE", "CASE WHEN ml > 0 THEN 1D + ml / 100D ELSE 1D + try_divide(100D, abs(ml)) END"),
    "side_value(p DOUBLE, ml DOUBLE)": ("DOUBLE", "p * CASE WHEN ml > 0 THEN ml / 100D ELSE try_divide(100D, abs(ml)) END - (1D - p)"),
    "spread_value(p DOUBLE, spread DOUBLE)": ("DOUBLE", "CASE WHEN spread = 0 THEN 0D ELSE (p - abs(spread) / 20D) * (100D / 110D) - (1D - (p - abs(spread) / 20D)) END"),
    "american_from_decimal(odds DOUBLE)": ("BIGINT", "coalesce(CAST(rint(CASE WHEN odds > 2 THEN (odds - 1D) * 100D ELSE try_divide(-100D, odds - 1D) END) AS BIGINT), -110L)"),
    "moneyline_value(p_home DOUBLE, p_away DOUBLE, home DOUBLE, away DOUBLE)": ("DOUBLE", "greatest(p_home * CASE WHEN home > 0 THEN home / 100D ELSE try_divide(100D, abs(home)) END - (1D - p_home), p_away * CASE WHEN away > 0 THEN away / 100D ELSE try_divide(100D, abs(away)) END - (1D - p_away))"),
    "confidence_risk(confidence DOUBLE, agree BOOLEAN)": ("DOUBLE", "least(greatest(1D - coalesce(confidence, 0.5D) + CASE WHEN coalesce(agree, true) THEN 0D ELSE 0.2D END, 0D), 1D)"),
    "odds_risk(home DOUBLE, away DOUBLE)": ("DOUBLE", "CASE WHEN home IS NULL OR away IS NULL THEN 0.5D ELSE least(abs(abs(home) - abs(away)) / greatest(abs(home) + 1D, abs(away) + 1D), 1D) END"),
    "volatility_risk(home_for DOUBLE, home_against DOUBLE, away_for DOUBLE, away_against DOUBLE)": ("DOUBLE", "least(greatest((abs(home_for - home_against) + abs(away_for - away_against)) / 40D, 0D), 1D)"),
    "historical_risk(home_share DOUBLE, away_share DOUBLE)": ("DOUBLE", "least(1D - abs(coalesce(home_share, 0.5D) - coalesce(away_share, 0.5D)), 1D)"),
    "overall_risk(confidence DOUBLE, odds DOUBLE, volatility DOUBLE, historical DOUBLE)": ("DOUBLE", "coalesce(confidence * 0.3D + odds * 0.25D + volatility * 0.25D + historical * 0.2D, 0.5D)"),
    "risk_level(score DOUBLE)": ("STRING", "CASE WHEN score <= 0.3D THEN 'low' WHEN score <= 0.6D THEN 'medium' WHEN score <= 0.8D THEN 'high' ELSE 'very_high' END"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session and return their names."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.partition("(")[0] for head in FUNCTIONS]
