"""Game forecasts: matchups with team statistics, closed-form and per-sport lines, probabilities and texts.

Every operator takes and returns a DataFrame and stays one narrow stage after the joins with the small team
dimension, whose size decides whether Spark broadcasts it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions.odds import american_odds
from courtside.functions.rounding import clamp, rounded, whole
from courtside.params import CONFIDENCE, DEFAULT_STATS, ENDPOINT_HOME_ADVANTAGE, IMPORTANCE, NEUTRAL_ERA, SPORTS

REASONS = ("Based on current form and historical matchups", "Home court advantage factored in", "Recent scoring trends considered")


def matchups(games: DataFrame, teams: DataFrame) -> DataFrame:
    """games (home_id, away_id) with both teams' name, hw/hp/ha and aw/ap/aa; unknown teams get the default row."""
    stats = {"w": "win_pct", "p": "points_avg", "a": "points_against_avg"}

    def side(letter: str, key: str) -> DataFrame:
        return teams.select(F.col("team_id").alias(key), F.col("team_name").alias(f"{letter}_name"), *[F.col(c).alias(f"{letter}{s}_") for s, c in stats.items()])

    joined = games.join(side("h", "home_id"), "home_id", "left").join(side("a", "away_id"), "away_id", "left")
    filled = [F.coalesce(f"{x}{s}_", F.lit(DEFAULT_STATS[c])).alias(f"{x}{s}") for x in "ha" for s, c in stats.items()]
    names = [F.coalesce(f"{x}_name", F.concat(F.lit("Team "), F.col(f"{k}_id").cast("string"))).alias(f"{k}_name") for x, k in (("h", "home"), ("a", "away"))]
    return joined.select(*games.columns, *names, *filled)


def closed_form(games: DataFrame) -> DataFrame:
    """Adds expected scores, spread, p_home, total, confidence, odds and integer scores to matchups."""
    home = (F.col("hp") + F.col("aa")) / 2.0 + ENDPOINT_HOME_ADVANTAGE
    away = (F.col("ap") + F.col("ha")) / 2.0
    record = (F.col("hw") - F.col("aw")) / 2.0
    scored = games.withColumns({"exp_home": home, "exp_away": away, "record_factor": record})
    scored = scored.withColumns({"spread": F.col("exp_home") - F.col("exp_away"), "total_points": F.col("exp_home") + F.col("exp_away")})
    scored = scored.withColumns({"p_home": clamp(0.5 + F.col("spread") / 20.0 + F.col("record_factor"), 0.05, 0.95), "confidence": F.least(F.lit(0.9), 0.7 + F.abs("record_factor"))})
    return scored.withColumns({"p_away": 1 - F.col("p_home"), "home_odds": american_odds(F.col("p_home")), "away_odds": american_odds(1 - F.col("p_home")), "home_score_int": whole("exp_home"), "away_score_int": whole("exp_away")})


def _by_sport(pick) -> Column:
    """A per-sport constant."""
    out = F.lit(None).cast("double")
    for name, sport in SPORTS.items():
        out = F.when(F.col("sport") == name, F.lit(float(pick(sport)))).otherwise(out)
    return out


def point_spread(games: DataFrame) -> DataFrame:
    """Adds the unrounded line, its rounded value and the offence and defence factors, by sport."""
    raw = (F.col("hp") + F.col("aa")) / 2.0 - (F.col("ap") + F.col("ha")) / 2.0 + _by_sport(lambda s: s.home_advantage)
    return games.withColumns({"raw_line": raw, "line": rounded(raw, 1), "offensive": rounded(F.col("hp") - F.col("ap"), 1), "defensive": rounded(F.col("aa") - F.col("ha"), 1), "home_court": _by_sport(lambda s: s.home_advantage)})


def run_line(games: DataFrame, home_era: Column, away_era: Column) -> DataFrame:
    """Adds the run line with pitcher shifts where an ERA is known (above zero)."""
    raw = (F.col("hp") + F.col("aa")) / 2.0 - (F.col("ap") + F.col("ha")) / 2.0 + SPORTS["MLB"].home_advantage
    shift = lambda era: F.when(F.coalesce(era, F.lit(0.0)) > 0, (era - NEUTRAL_ERA) * 0.2).otherwise(0.0)
    return games.withColumn("run_line", rounded(raw - shift(home_era) + shift(away_era), 1))


def tier(games: DataFrame) -> DataFrame:
    """Adds the confidence tier of the line, tested unrounded or rounded as the sport has it."""
    tested = F.abs(F.when(_by_sport(lambda s: s.rounded_tier) == 1.0, F.col("line")).otherwise(F.col("raw_line")))
    return games.withColumn("tier", F.when(tested > _by_sport(lambda s: s.high), "high").when(tested > _by_sport(lambda s: s.medium), "medium").otherwise("low"))


def agreement(games: DataFrame, p_home: Column, line: Column) -> DataFrame:
    """Adds model_agreement and the reasons."""
    return games.withColumns({"model_agreement": (p_home > 1 - p_home) == (line > 0), "reasons": F.array(*map(F.lit, REASONS))})


def clamped(games: DataFrame, p: Column) -> DataFrame:
    """Adds the clamped home probability, the average of both averages and the larger side's probability."""
    home = clamp(p, 0.1, 0.9)
    return games.withColumns({"p_home_model": home, "avg_points": (F.col("hp") + F.col("ap")) / 2.0, "confidence_model": F.greatest(home, 1 - home)})


def sentiment_adjusted(p: Column, home: Column, away: Column) -> Column:
    return clamp(p + home - away, 0.1, 0.9)


def win_percentage(wins: Column, losses: Column, digits: int | None = 3) -> Column:
    share = F.try_divide(wins.cast("double"), (wins + losses).cast("double"))
    share = F.when(wins + losses > 0, share).otherwise(0.0)
    return share if digits is None else rounded(share, digits)


def picks(games: DataFrame) -> DataFrame:
    """Adds winner, its probability, the favoured team and the abs-spread text; ties go to the away team."""
    home = F.col("p_home") > F.col("p_away")
    return games.withColumns({"winner": F.when(home, F.col("home_name")).otherwise(F.col("away_name")), "winner_p": F.when(home, F.col("p_home")).otherwise(F.col("p_away")), "favoured": F.when(F.col("spread") > 0, F.col("home_name")).otherwise(F.col("away_name")), "spread_text": F.format_string("%.1f", rounded(F.abs("spread"), 1))})


def signed_spread(winner: Column, home: Column, spread: Column) -> Column:
    """Positive iff the home side is picked."""
    return F.when(winner == home, F.abs(spread)).otherwise(-F.abs(spread) + 0.0)


def form_label(win_pct: Column) -> Column:
    return F.when(win_pct > 0.6, "Strong").otherwise("Average")


def band(x: Column, levels: dict[str, float]) -> Column:
    """The highest level reached, else minimal."""
    out = F.lit("minimal")
    for name, least in sorted(levels.items(), key=lambda kv: kv[1]):
        out = F.when(x >= least, name).otherwise(out)
    return out


def importance_band(x: Column) -> Column:
    return band(x, IMPORTANCE)


def confidence_band(x: Column) -> Column:
    return band(x, CONFIDENCE)


def valid_games(games: DataFrame, required: list[str]) -> DataFrame:
    """Adds is_valid: every required column exists and is not null."""
    missing = [c for c in required if c not in games.columns]
    whole_row = F.lit(not missing)
    for c in required:
        if c not in missing:
            whole_row = whole_row & F.col(c).isNotNull()
    return games.withColumn("is_valid", whole_row)


def supported(games: DataFrame, sport: str) -> DataFrame:
    """Games of one sport, in any case; an unsupported sport raises."""
    if sport.upper() not in SPORTS:
        raise ValueError(f"unsupported sport: {sport}")
    return games.filter(F.upper("sport") == sport.upper())


def upcoming(games: DataFrame, as_of: Column, days: int = 7, time_col: str = "game_ts") -> DataFrame:
    """as_of <= time <= as_of + days, at timestamp precision."""
    return games.filter((F.col(time_col) >= as_of) & (F.col(time_col) <= as_of + F.expr(f"interval {days} days")))
