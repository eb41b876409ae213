"""The registered queries of the engine's own operators, and the same in DuckDB's SQL over the same tables.

Each query applies one operator (its id leads the name) to whole tables or to views over them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.functions import formats, odds, sqlfuncs
from courtside.functions.rounding import rounded, whole
from courtside.operators import bets, features, forecast, ml, risk, text, tracking
from courtside.operators.store import TrackingStore
from courtside.plans.fixtures import PRELUDE, open_views
from courtside.sources import feeds
from courtside.sources.storage import kept, scratch
from courtside.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = "2001-08-01 00:00:00"


def R(x: str, digits: int = 6) -> str:  # noqa: N802
    """DuckDB's form of rounding.rounded."""
    return f"(round_even(({x}) * CAST(1e{digits} AS DOUBLE), 0) / CAST(1e{digits} AS DOUBLE) + CAST(0 AS DOUBLE))"


def I(x: str) -> str:  # noqa: E743, N802
    """DuckDB's form of rounding.whole."""
    return f"CAST(round_even({x}, 0) AS BIGINT)"


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(open_views(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"{PRELUDE}{sql}"
        return f

    return register


# ---- forecasts ------------------------------------------------------------------------------------------------

MATCHUPS = """, matchups AS (SELECT g.*, coalesce(h.team_name, concat('Team ', CAST(g.home_id AS STRING))) AS home_name, coalesce(a.team_name, concat('Team ', CAST(g.away_id AS STRING))) AS away_name,
    coalesce(h.win_pct, CAST(0.5 AS DOUBLE)) AS hw, coalesce(h.points_avg, CAST(110 AS DOUBLE)) AS hp, coalesce(h.points_against_avg, CAST(110 AS DOUBLE)) AS ha,
    coalesce(a.win_pct, CAST(0.5 AS DOUBLE)) AS aw, coalesce(a.points_avg, CAST(110 AS DOUBLE)) AS ap, coalesce(a.points_against_avg, CAST(110 AS DOUBLE)) AS aa
    FROM games g LEFT JOIN teams h ON g.home_id = h.team_id LEFT JOIN teams a ON g.away_id = a.team_id)"""

D = lambda x: f"CAST({x} AS DOUBLE)"


def american_sql(p: str) -> str:
    return f"CASE WHEN {p} >= {D(0.5)} THEN {I(f'{D(-100)} * ({p} / (1 - {p}))')} ELSE {I(f'{D(100)} * ((1 - {p}) / {p})')} END"


FORECAST = MATCHUPS + f""", f1 AS (SELECT *, (hp + aa) / {D(2)} + {D(3)} AS exp_home, (ap + ha) / {D(2)} AS exp_away, (hw - aw) / {D(2)} AS record_factor FROM matchups),
    f2 AS (SELECT *, exp_home - exp_away AS spread, exp_home + exp_away AS total_points FROM f1),
    f3 AS (SELECT *, least(greatest({D(0.5)} + spread / {D(20)} + record_factor, {D(0.05)}), {D(0.95)}) AS p_home, least({D(0.9)}, {D(0.7)} + abs(record_factor)) AS confidence FROM f2),
    forecasts AS (SELECT *, 1 - p_home AS p_away, {american_sql('p_home')} AS home_odds, {american_sql('(1 - p_home)')} AS away_odds, {I('exp_home')} AS home_score_int, {I('exp_away')} AS away_score_int FROM f3)"""


def forecasts(view) -> DataFrame:
    return forecast.closed_form(forecast.matchups(view("games"), view("teams")))


@query(FORECAST + f"""SELECT game_id, home_name, away_name, {R('p_home')} AS p_home, {R('spread')} AS spread, {R('total_points')} AS total_points, {R('confidence')} AS confidence, home_odds, away_odds, home_score_int, away_score_int,
    CASE WHEN p_home > p_away THEN home_name ELSE away_name END AS winner FROM forecasts""")
def forecast_games(view):
    out = forecast.picks(forecasts(view))
    return out.select("game_id", "home_name", "away_name", *[rounded(c).alias(c) for c in ("p_home", "spread", "total_points", "confidence")], "home_odds", "away_odds", "home_score_int", "away_score_int", "winner")


@query(MATCHUPS + f"SELECT game_id, {R('hw')} AS hw, {R('hp')} AS hp, {R('aw')} AS aw, {R('aa')} AS aa FROM matchups")
def jon02_team_stats_lookup(view):
    m = forecast.matchups(view("games"), view("teams"))
    return m.select("game_id", *[rounded(c).alias(c) for c in ("hw", "hp", "aw", "aa")])


@query(FORECAST + f"SELECT game_id, {R('exp_home')} AS exp_home, {R('exp_away')} AS exp_away, {R('record_factor')} AS record_factor, {R('p_home')} AS p_home, {R('p_away')} AS p_away FROM forecasts")
def prj05_closed_form(view):
    return forecasts(view).select("game_id", *[rounded(c).alias(c) for c in ("exp_home", "exp_away", "record_factor", "p_home", "p_away")])


@query(" SELECT team_id, " + R("CASE WHEN w + l > 0 THEN CAST(w AS DOUBLE) / (w + l) ELSE 0 END", 3) + " AS win_pct FROM (SELECT team_id, count(*) FILTER (WHERE points > opponent_points) AS w, count(*) FILTER (WHERE points <= opponent_points) AS l FROM team_games GROUP BY team_id)")
def prj01_win_percentage(view):
    t = view("team_games").groupBy("team_id").agg(F.count_if(F.expr("points > opponent_points")).alias("w"), F.count_if(F.expr("points <= opponent_points")).alias("l"))
    return t.select("team_id", forecast.win_percentage(F.col("w"), F.col("l")).alias("win_pct"))


@query(" SELECT team_id, " + R("CAST(w AS DOUBLE) / (w + l)", 12) + " AS win_pct FROM (SELECT team_id, count(*) FILTER (WHERE points > opponent_points) AS w, count(*) FILTER (WHERE points <= opponent_points) AS l FROM team_games GROUP BY team_id)")
def prj02_win_share(view):
    t = view("team_games").groupBy("team_id").agg(F.count_if(F.expr("points > opponent_points")).alias("w"), F.count_if(F.expr("points <= opponent_points")).alias("l"))
    return t.select("team_id", rounded(forecast.win_percentage(F.col("w"), F.col("l"), None), 12).alias("win_pct"))


@query(" SELECT game_id, sport FROM games WHERE game_ts >= TIMESTAMP '2001-08-01 00:00:00' AND game_ts <= TIMESTAMP '2001-08-08 00:00:00'")
def prj03_upcoming(view):
    return forecast.upcoming(view("games"), F.lit(AS_OF).cast("timestamp_ntz")).select("game_id", "sport")


@query(" SELECT game_id, sport FROM games WHERE sport = 'MLB'")
def prj04_sport_filter(view):
    return forecast.supported(view("games"), "mlb").select("game_id", "sport")


SPORT = lambda nba, nfl, mlb: f"CASE sport WHEN 'NBA' THEN {D(nba)} WHEN 'NFL' THEN {D(nfl)} ELSE {D(mlb)} END"
LINES = MATCHUPS + f""", lines AS (SELECT *, {R('raw_line', 1)} AS line FROM (SELECT *, (hp + aa) / {D(2)} - (ap + ha) / {D(2)} + {SPORT(3.5, 2.5, 0.15)} AS raw_line FROM matchups))"""


@query(LINES + f"SELECT game_id, line, {R('hp - ap', 1)} AS offensive, {R('aa - ha', 1)} AS defensive, {SPORT(3.5, 2.5, 0.15)} AS home_court FROM lines")
def prj06_point_spread(view):
    return forecast.point_spread(forecast.matchups(view("games"), view("teams"))).select("game_id", "line", "offensive", "defensive", "home_court")


ERA = lambda k: f"CASE WHEN game_id % 3 = {k} THEN NULL ELSE {D(2)} + CAST(game_id * {7 + k} % 40 AS DOUBLE) / 10 END"


@query(MATCHUPS + f"""SELECT game_id, {R(f'(hp + aa) / {D(2)} - (ap + ha) / {D(2)} + {D(0.15)} - CASE WHEN coalesce(he, 0) > 0 THEN (he - {D(4)}) * {D(0.2)} ELSE {D(0)} END + CASE WHEN coalesce(ae, 0) > 0 THEN (ae - {D(4)}) * {D(0.2)} ELSE {D(0)} END', 1)} AS run_line
    FROM (SELECT *, {ERA(0)} AS he, {ERA(1)} AS ae FROM matchups)""")
def prj07_run_line(view):
    m = forecast.matchups(view("games"), view("teams"))
    return forecast.run_line(m, F.expr(ERA(0)), F.expr(ERA(1))).select("game_id", "run_line")


@query(LINES + f"SELECT game_id, CASE WHEN t > {SPORT(7, 7, 2)} THEN 'high' WHEN t > {SPORT(3, 3, 1)} THEN 'medium' ELSE 'low' END AS tier FROM (SELECT *, abs(CASE WHEN sport = 'NBA' THEN raw_line ELSE line END) AS t FROM lines)")
def prj08_tier(view):
    return forecast.tier(forecast.point_spread(forecast.matchups(view("games"), view("teams")))).select("game_id", "tier")


@query(LINES + f", p AS (SELECT game_id, line, {D(50)} / 100 + CAST(game_id * 17 % 46 AS DOUBLE) / 100 - {D(0.2)} AS p FROM lines) SELECT game_id, (p > 1 - p) = (line > 0) AS model_agreement FROM p")
def prj09_model_agreement(view):
    lined = forecast.point_spread(forecast.matchups(view("games"), view("teams")))
    p = F.lit(50.0) / 100 + F.expr("CAST(game_id * 17 % 46 AS DOUBLE)") / 100 - F.lit(0.2)
    return forecast.agreement(lined, p, F.col("line")).select("game_id", "model_agreement")


@query(MATCHUPS + f"SELECT game_id, {R('p')} AS p_home_model, {R('(hp + ap) / 2')} AS avg_points, {R('greatest(p, 1 - p)')} AS confidence_model FROM (SELECT *, least(greatest(CAST(game_id * 29 % 100 AS DOUBLE) / 100, {D(0.1)}), {D(0.9)}) AS p FROM matchups)")
def prj10_clamped_probability(view):
    out = forecast.clamped(forecast.matchups(view("games"), view("teams")), F.expr("CAST(game_id * 29 % 100 AS DOUBLE) / 100"))
    return out.select("game_id", *[rounded(c).alias(c) for c in ("p_home_model", "avg_points", "confidence_model")])


@query(f" SELECT game_id, {R(f'least(greatest(p + hs - as_, {D(0.1)}), {D(0.9)})')} AS p FROM (SELECT game_id, CAST(game_id * 29 % 100 AS DOUBLE) / 100 AS p, CAST(game_id % 21 - 10 AS DOUBLE) / 100 AS hs, CAST(game_id % 17 - 8 AS DOUBLE) / 100 AS as_ FROM games)")
def prj11_sentiment_adjusted(view):
    p, h, a = (F.expr(x) for x in ("CAST(game_id * 29 % 100 AS DOUBLE) / 100", "CAST(game_id % 21 - 10 AS DOUBLE) / 100", "CAST(game_id % 17 - 8 AS DOUBLE) / 100"))
    return view("games").select("game_id", rounded(forecast.sentiment_adjusted(p, h, a)).alias("p"))


@query(MATCHUPS + f"SELECT game_id, {R('hw')} AS home_team_win_pct, {R('hp')} AS home_team_points_avg, {R('ha')} AS home_team_points_allowed_avg, {R('aw')} AS away_team_win_pct FROM matchups")
def prj12_feature_projection(view):
    m = forecast.matchups(view("games"), view("teams"))
    return m.select("game_id", rounded("hw").alias("home_team_win_pct"), rounded("hp").alias("home_team_points_avg"), rounded("ha").alias("home_team_points_allowed_avg"), rounded("aw").alias("away_team_win_pct"))


@query(" SELECT game_id, actual_winner IS NOT NULL AND final_spread IS NOT NULL AS is_valid FROM results")
def prj13_required_fields(view):
    return forecast.valid_games(view("results"), ["game_id", "actual_winner", "final_spread"]).select("game_id", "is_valid")


@query(FORECAST + f"SELECT game_id, CASE WHEN p_home > p_away THEN home_name ELSE away_name END AS winner, {R('CASE WHEN p_home > p_away THEN p_home ELSE p_away END')} AS winner_p, CASE WHEN spread > 0 THEN home_name ELSE away_name END AS favoured, printf('%.1f', {R('abs(spread)', 1)}) AS spread_text FROM forecasts")
def prj14_winner_text(view):
    return forecast.picks(forecasts(view)).select("game_id", "winner", rounded("winner_p").alias("winner_p"), "favoured", "spread_text")


@query(f" SELECT team_id, CASE WHEN win_pct > {D(0.6)} THEN 'Strong' ELSE 'Average' END AS form, printf('%.1f%%', {R('win_pct * 100', 1)}) AS win_text FROM teams")
def prj15_form_label(view):
    return view("teams").select("team_id", forecast.form_label(F.col("win_pct")).alias("form"), formats.percent_text(F.col("win_pct")).alias("win_text"))


@query(" SELECT game_id, CASE WHEN predicted_winner = home_id THEN abs(predicted_spread) ELSE -abs(predicted_spread) + CAST(0 AS DOUBLE) END AS spread, greatest(win_probability, 1 - win_probability) AS p FROM predictions")
def prj16_signed_spread(view):
    p = view("predictions")
    return p.select("game_id", forecast.signed_spread(F.col("predicted_winner"), F.col("home_id"), F.col("predicted_spread")).alias("spread"), F.greatest("win_probability", 1 - F.col("win_probability")).alias("p"))


@query(f" SELECT game_id, CASE WHEN x >= {D(0.15)} THEN 'high' WHEN x >= {D(0.08)} THEN 'medium' WHEN x >= {D(0.03)} THEN 'low' ELSE 'minimal' END AS importance, CASE WHEN p >= {D(0.8)} THEN 'high' WHEN p >= {D(0.6)} THEN 'medium' WHEN p >= {D(0.4)} THEN 'low' ELSE 'minimal' END AS confidence FROM (SELECT game_id, win_probability / 4 - {D(0.1)} AS x, win_probability AS p FROM predictions)")
def prj18_bands(view):
    p = F.col("win_probability")
    return view("predictions").select("game_id", forecast.importance_band(p / 4 - F.lit(0.1)).alias("importance"), forecast.confidence_band(p).alias("confidence"))


# ---- odds -----------------------------------------------------------------------------------------------------


@query(f" SELECT game_id, {american_sql('win_probability')} AS american FROM predictions")
def fn01_american_odds(view):
    return view("predictions").select("game_id", odds.american_odds(F.col("win_probability")).alias("american"))


def implied_sql(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {D(100)} / ({x} + {D(100)}) ELSE -{x} / (-{x} + {D(100)}) END"


@query(f" SELECT game_id, {R(implied_sql('CAST(home_ml AS DOUBLE)'))} AS home, {R(implied_sql('CAST(away_ml AS DOUBLE)'))} AS away FROM market_odds")
def fn02_implied_probability(view):
    implied = lambda c: rounded(F.when(F.col(c).isNotNull(), odds.implied_probability(F.col(c))))
    return view("market_odds").select("game_id", implied("home_ml").alias("home"), implied("away_ml").alias("away"))


def decimal_sql(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN 1 + {x} / {D(100)} ELSE 1 + {D(100)} / abs({x}) END"


@query(f" SELECT slip_id, leg_no, {R(decimal_sql('CAST(odds AS DOUBLE)'))} AS price FROM slip_legs")
def fn03_decimal_odds(view):
    text_odds = F.when(F.col("odds") > 0, F.concat(F.lit("+"), F.col("odds").cast("string"))).otherwise(F.col("odds").cast("string"))
    return view("slip_legs").select("slip_id", "leg_no", rounded(odds.decimal_odds(text_odds)).alias("price"))


def back_sql(c: str) -> str:
    return f"CASE WHEN {c} > 2 THEN {I(f'({c} - 1) * {D(100)}')} WHEN {c} = 1 THEN -110 ELSE {I(f'{D(-100)} / ({c} - 1)')} END"


@query(f" SELECT slip_id, leg_no, {back_sql('p')} AS american FROM (SELECT *, {decimal_sql('CAST(odds AS DOUBLE)')} AS p FROM slip_legs)")
def fn04_american_from_decimal(view):
    return view("slip_legs").select("slip_id", "leg_no", odds.american_from_decimal(odds.decimal_odds(F.col("odds"))).alias("american"))


def side_sql(p: str, x: str) -> str:
    return f"({p} * CASE WHEN {x} > 0 THEN {x} / {D(100)} ELSE {D(100)} / abs({x}) END - (1 - {p}))"


@query(FORECAST + f"SELECT game_id, {R('greatest(' + side_sql('p_home', 'CAST(home_ml AS DOUBLE)') + ', ' + side_sql('p_away', 'CAST(away_ml AS DOUBLE)') + ')')} AS value FROM forecasts JOIN market_odds USING (game_id) WHERE home_ml IS NOT NULL")
def fn05_moneyline_value(view):
    j = forecasts(view).join(view("market_odds").filter("home_ml is not null"), "game_id")
    return j.select("game_id", rounded(odds.moneyline_value(F.col("p_home"), F.col("p_away"), F.col("home_ml"), F.col("away_ml"))).alias("value"))


SPREAD_EV = f"(CASE WHEN spread = 0 THEN {D(0)} ELSE (p_home - abs(spread) / {D(20)}) * ({D(100)} / {D(110)}) - (1 - (p_home - abs(spread) / {D(20)})) END)"


@query(FORECAST + f"SELECT game_id, {R(SPREAD_EV)} AS value FROM forecasts")
def fn06_spread_value(view):
    return forecasts(view).select("game_id", rounded(odds.spread_value(F.col("p_home"), F.col("spread"))).alias("value"))


SLIPS = ", slips AS (SELECT slip_id, min(bet_type) AS kind, CAST(sum(amount) AS DOUBLE) AS amount, max(odds) AS odds, count(*) AS legs, CASE WHEN slip_id % 9 <> 0 THEN min(side) END AS side FROM slip_legs GROUP BY slip_id)"


def slips(view) -> DataFrame:
    return view("slip_legs").groupBy("slip_id").agg(F.min("bet_type").alias("kind"), F.sum("amount").cast("double").alias("amount"), F.max("odds").alias("odds"), F.count(F.lit(1)).alias("legs"), F.min("side").alias("s")).withColumn("side", F.when(F.col("slip_id") % 9 != 0, F.col("s"))).drop("s")


@query(SLIPS + f"SELECT slip_id, kind, {R(f'amount * CASE kind WHEN {chr(39)}spread{chr(39)} THEN {D(1.91)} WHEN {chr(39)}moneyline{chr(39)} THEN ' + decimal_sql('CAST(odds AS DOUBLE)') + f' ELSE pow({D(1.91)}, legs) END', 4)} AS payout FROM slips")
def fn07_slip_payout(view):
    return bets.slip_payouts(slips(view)).select("slip_id", "kind", "payout")


@query(""" SELECT game_id, strftime(l, '%Y-%m-%d') AS game_date, strftime(l, '%-I:%M %p') AS game_time FROM (SELECT game_id, u - to_hours(CASE WHEN u >= a AND u < b THEN 4 ELSE 5 END) AS l FROM (SELECT *,
    CAST(make_date(year(u), 4, 1) + CAST((7 - dayofweek(make_date(year(u), 4, 1))) % 7 AS INTEGER) AS TIMESTAMP) + INTERVAL 7 HOUR AS a,
    CAST(make_date(year(u), 10, 31) - CAST(dayofweek(make_date(year(u), 10, 31)) AS INTEGER) AS TIMESTAMP) + INTERVAL 6 HOUR AS b FROM (SELECT game_id, game_ts + to_minutes(CAST(game_id % 1440 AS BIGINT)) AS u FROM games)))""")
def fn08_eastern_time(view):
    minute = F.date_format(F.col("game_ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("game_id") % 1440).cast("int")), "yyyy-MM-dd'T'HH:mm'Z'")
    day, time = formats.eastern(minute)
    return view("games").select("game_id", day.alias("game_date"), time.alias("game_time"))


@query(f" SELECT game_id, printf('%.0f%%', {R('win_probability * 100', 0)}) AS p, printf('%+.1f', {R('predicted_spread', 1)}) AS spread FROM predictions")
def fn09_number_text(view):
    return view("predictions").select("game_id", formats.percent_text(F.col("win_probability"), 0).alias("p"), formats.signed_text(F.col("predicted_spread")).alias("spread"))


@query(" SELECT game_id, strftime(game_ts, '%A, %B %-d, %Y') AS day FROM games")
def fn10_long_date(view):
    return view("games").select("game_id", formats.long_date(F.col("game_ts")).alias("day"))


@query(" SELECT event_id, strftime(ts, '%H:%M:%S') AS clock FROM events")
def fn11_clock(view):
    return view("events").select("event_id", formats.clock(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")).alias("clock"))


@query(MATCHUPS + "SELECT game_id, concat(CAST(home_score AS STRING), '-', CAST(away_score AS STRING)) AS score, concat(home_name, ' vs ', away_name) AS matchup FROM matchups")
def fn12_score_text(view):
    m = forecast.matchups(view("games"), view("teams"))
    return m.select("game_id", formats.score_text(F.col("home_score"), F.col("away_score")).alias("score"), formats.versus(F.col("home_name"), F.col("away_name")).alias("matchup"))


@query(" SELECT slip_id, min_by(odds, leg_no * 100000 + odds) FILTER (WHERE odds > 0) AS first_positive FROM slip_legs GROUP BY slip_id")
def fn14_first_match(view):
    legs = view("slip_legs").groupBy("slip_id").agg(F.array_sort(F.collect_list(F.struct("leg_no", "odds"))).alias("l"))
    return legs.select("slip_id", formats.first_where(F.col("l"), lambda x: x["odds"] > 0)["odds"].alias("first_positive"))


# ---- team history ---------------------------------------------------------------------------------------------


@query(" SELECT game_id, team_id, opponent_id, is_home, points, opponent_points FROM team_games")
def set01_team_orientation(view):
    return features.team_games(view("games")).select("game_id", "team_id", "opponent_id", "is_home", "points", "opponent_points")


@query(" SELECT sport, count(*) AS games FROM games GROUP BY sport")
def set02_all_sports(view):
    g = view("games")
    parts = [forecast.supported(g, s).select("game_id", "sport") for s in ("NBA", "NFL", "MLB")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("sport").agg(F.count(F.lit(1)).alias("games"))


ROLL = lambda x, n: f"avg({x}) OVER (PARTITION BY team_id ORDER BY game_ts, game_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
LAG = "date_diff('day', CAST(lag(game_ts) OVER (PARTITION BY team_id ORDER BY game_ts, game_id) AS DATE), CAST(game_ts AS DATE))"


def _rolling(view):
    return features.rolling_form(features.team_games(view("games")))


@query(f" SELECT game_id, team_id, {R(ROLL('points', 10))} AS points_10 FROM team_games")
def win02_rolling_points(view):
    return _rolling(view).select("game_id", "team_id", rounded("points_10").alias("points_10"))


@query(f" SELECT game_id, team_id, {R(ROLL('opponent_points', 10))} AS opponent_points_10 FROM team_games")
def win03_rolling_opponent_points(view):
    return _rolling(view).select("game_id", "team_id", rounded("opponent_points_10").alias("opponent_points_10"))


@query(f" SELECT game_id, team_id, {R(ROLL('CAST(points > opponent_points AS INT)', 20))} AS win_rate_20 FROM team_games")
def win04_rolling_win_rate(view):
    return _rolling(view).select("game_id", "team_id", rounded("win_rate_20").alias("win_rate_20"))


@query(f" SELECT game_id, team_id, CAST({LAG} AS INT) AS days_rest FROM team_games")
def win05_days_rest(view):
    return _rolling(view).select("game_id", "team_id", "days_rest")


@query(f" SELECT game_id, team_id, coalesce({LAG} <= 1, false) AS back_to_back FROM team_games")
def win06_back_to_back(view):
    return _rolling(view).select("game_id", "team_id", "back_to_back")


RECENT = f""", r1 AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY game_ts DESC, game_id DESC) AS recency FROM team_games),
    r2 AS (SELECT *, count(*) OVER (PARTITION BY team_id) AS n FROM r1 WHERE recency <= 10),
    recent AS (SELECT *, CASE WHEN n = 1 THEN {D(0.5)} ELSE {D(0.5)} + {D(0.5)} * (CAST(n - recency AS DOUBLE) / (n - 1)) END AS weight FROM r2)"""


@query(RECENT + f"SELECT team_id, game_id, CAST(recency AS INT) AS recency, {R('weight')} AS weight FROM recent")
def win01_recency_weights(view):
    return features.recent_weights(features.team_games(view("games"))).select("team_id", "game_id", "recency", rounded("weight").alias("weight"))


@query(RECENT + f"""SELECT team_id, {R(f"sum(weight * CASE WHEN points > opponent_points THEN {D(1)} ELSE {D(-1)} END * (1 + CAST(points - opponent_points AS DOUBLE) / greatest(points, opponent_points))) / count(*)")} AS momentum FROM recent GROUP BY team_id""")
def agg05_momentum(view):
    return features.momentum(features.team_games(view("games"))).select("team_id", rounded("momentum").alias("momentum"))


@query(RECENT + "SELECT team_id, count(*) AS games, min(game_id) AS first_game, CAST(sum(points) AS BIGINT) AS points FROM recent GROUP BY team_id")
def jon06_team_in_game(view):
    r = features.recent_weights(features.team_games(view("games")))
    return r.groupBy("team_id").agg(F.count(F.lit(1)).alias("games"), F.min("game_id").alias("first_game"), F.sum("points").alias("points"))


STEPS = f""", formed AS (SELECT team_id, game_id, game_ts, CAST(points AS DOUBLE) AS points, CAST(opponent_points AS DOUBLE) AS opponent_points, CAST(is_home AS DOUBLE) AS is_home,
    avg(points) OVER ten AS points_10, avg(opponent_points) OVER ten AS opponent_points_10, avg(CAST(points > opponent_points AS INT)) OVER twenty AS win_rate_20, CAST(coalesce({LAG}, 0) AS DOUBLE) AS days_rest, CAST(coalesce({LAG} <= 1, false) AS INT)::DOUBLE AS back_to_back FROM team_games
    WINDOW ten AS (PARTITION BY team_id ORDER BY game_ts, game_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), twenty AS (PARTITION BY team_id ORDER BY game_ts, game_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
TEN = "OVER (PARTITION BY team_id ORDER BY game_ts, game_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query(STEPS + " SELECT * EXCLUDE (n) FROM (SELECT team_id, game_id, " + ", ".join(f"{R(f'sum({c}) {TEN}')} AS {c}_sum, {R(f'first({c}) {TEN}')} AS {c}_first" for c in features.STEP) + f", count(*) {TEN} AS n FROM formed) WHERE n = 10")
def win09_sequences(view):
    """Of each sequence, every feature's sum over its steps and its value in the oldest step."""
    s = features.sequences(features.team_games(view("games")))
    place = lambda i, step: F.get(F.col("sequence"), F.lit(step * len(features.STEP) + i))
    total = lambda i: rounded(sum((place(i, step) for step in range(1, 10)), place(i, 0)))
    return s.select("team_id", "game_id", *[x for i, c in enumerate(features.STEP) for x in (total(i).alias(f"{c}_sum"), rounded(place(i, 0)).alias(f"{c}_first"))])


H2H = """, pairs AS (SELECT least(home_id, away_id) AS lo, greatest(home_id, away_id) AS hi, count(*) AS n, CAST(sum(CASE WHEN home_id <= away_id THEN home_score - away_score ELSE away_score - home_score END) AS DOUBLE) AS d,
    count(*) FILTER (WHERE home_id <= away_id AND home_score > away_score) AS hw_low, count(*) FILTER (WHERE home_id > away_id AND home_score > away_score) AS hw_high,
    count(*) FILTER (WHERE home_id <= away_id AND away_score > home_score) AS aw_low, count(*) FILTER (WHERE home_id > away_id AND away_score > home_score) AS aw_high FROM games GROUP BY 1, 2),
    met AS (SELECT g.*, n, d, hw_low, hw_high, aw_low, aw_high FROM games g JOIN pairs ON least(home_id, away_id) = lo AND greatest(home_id, away_id) = hi)"""
HOME_WINS = "CASE WHEN home_id <= away_id THEN hw_low ELSE hw_high END"


@query(H2H + f"""SELECT game_id, n AS meetings, {HOME_WINS} AS home_wins, CASE WHEN home_id <= away_id THEN aw_low ELSE aw_high END AS away_wins,
    {R("(CASE WHEN home_id <= away_id THEN d ELSE -d END) / n")} AS average_difference, {R(f"CAST({HOME_WINS} AS DOUBLE) / n")} AS home_advantage FROM met""")
def agg04_head_to_head(view):
    g = view("games")
    return features.head_to_head(g, g).select("game_id", "meetings", "home_wins", "away_wins", "average_difference", "home_advantage")


@query(" SELECT least(home_id, away_id) AS low_id, greatest(home_id, away_id) AS high_id, count(*) AS n, CAST(sum(CASE WHEN home_id <= away_id THEN home_score - away_score ELSE away_score - home_score END) AS BIGINT) AS difference FROM games GROUP BY 1, 2")
def jon05_pair_key(view):
    return features.pair_history(view("games")).select("low_id", "high_id", "n", F.col("difference"))


BEFORE = "OVER (PARTITION BY team_id ORDER BY game_ts, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"


@query(f" SELECT game_id, {R('max(p) FILTER (WHERE is_home = 1)')} AS home_points_10, {R('max(p) FILTER (WHERE is_home = 0)')} AS away_points_10 FROM (SELECT game_id, is_home, avg(points) {BEFORE} AS p FROM team_games) GROUP BY game_id")
def jon10_point_in_time(view):
    return features.point_in_time(view("games")).select("game_id", rounded("home_points_10").alias("home_points_10"), rounded("away_points_10").alias("away_points_10"))


# ---- risk and bets --------------------------------------------------------------------------------------------

RISK = FORECAST + f""", k1 AS (SELECT f.*, home_ml, away_ml, least(greatest(1 - confidence, {D(0)}), {D(1)}) AS confidence_risk,
    CASE WHEN home_ml IS NULL THEN {D(0.5)} ELSE least(abs(abs(CAST(home_ml AS DOUBLE)) - abs(CAST(away_ml AS DOUBLE))) / greatest(abs(CAST(home_ml AS DOUBLE)) + 1, abs(CAST(away_ml AS DOUBLE)) + 1), {D(1)}) END AS odds_risk,
    least(greatest((abs(hp - ha) + abs(ap - aa)) / {D(40)}, {D(0)}), {D(1)}) AS volatility_risk, least(1 - abs(hw - aw), {D(1)}) AS historical_risk FROM forecasts f JOIN market_odds o ON f.game_id = o.game_id),
    k2 AS (SELECT *, confidence_risk * {D(0.3)} + odds_risk * {D(0.25)} + volatility_risk * {D(0.25)} + historical_risk * {D(0.2)} AS risk_score FROM k1),
    risks AS (SELECT *, CASE WHEN risk_score <= {D(0.3)} THEN 'low' WHEN risk_score <= {D(0.6)} THEN 'medium' WHEN risk_score <= {D(0.8)} THEN 'high' ELSE 'very_high' END AS risk_level FROM k2)"""


def assessed(view) -> DataFrame:
    joined = forecasts(view).join(view("market_odds"), "game_id")
    return risk.assess(joined, home_ml=F.col("home_ml"), away_ml=F.col("away_ml"))


@query(FORECAST + f"SELECT game_id, {R(f'least(greatest(1 - confidence + CASE WHEN game_id % 2 = 0 THEN {D(0)} ELSE {D(0.2)} END, {D(0)}), {D(1)})')} AS confidence_risk FROM forecasts")
def bet01_confidence_risk(view):
    return forecasts(view).select("game_id", rounded(risk.confidence_risk(F.col("confidence"), F.col("game_id") % 2 == 0)).alias("confidence_risk"))


def _risk_part(name: str):
    def run(view):
        return assessed(view).select("game_id", rounded(name).alias(name))

    return run


for _name, _part in (("bet02_odds_risk", "odds_risk"), ("bet03_volatility_risk", "volatility_risk"), ("bet04_historical_risk", "historical_risk"), ("bet05_overall_risk", "risk_score")):
    _f = _risk_part(_part)
    _f.__name__ = _name
    query(RISK + f"SELECT game_id, {R(_part)} AS {_part} FROM risks")(_f)


@query(RISK + "SELECT risk_level, count(*) AS games FROM risks GROUP BY risk_level")
def bet06_risk_level(view):
    return assessed(view).groupBy("risk_level").agg(F.count(F.lit(1)).alias("games"))


@query(RISK + f"""SELECT game_id, concat_ws('; ', CASE WHEN risk_score < {D(0.3)} THEN 'Strong opportunity with solid statistical backing' WHEN risk_score < {D(0.6)} THEN 'Balanced risk-reward profile with moderate confidence' ELSE 'High-risk bet with potential for variance' END,
    CASE WHEN confidence_risk > {D(0.6)} THEN 'Model shows lower confidence in prediction' END, CASE WHEN odds_risk > {D(0.7)} THEN 'Line movement suggests market uncertainty' END,
    CASE WHEN volatility_risk > {D(0.6)} THEN 'Recent performance shows high variability' END, CASE WHEN historical_risk > {D(0.7)} THEN 'Historical matchup data indicates unpredictability' END) AS insights FROM risks""")
def bet07_insights(view):
    return assessed(view).select("game_id", F.concat_ws("; ", "insights").alias("insights"))


MONEY_EV = "greatest(" + side_sql("p_home", "CAST(home_odds AS DOUBLE)") + ", " + side_sql("p_away", "CAST(away_odds AS DOUBLE)") + ")"
BETS = RISK + f""", b1 AS (SELECT *, {SPREAD_EV} AS spread_ev, {MONEY_EV} AS money_ev FROM risks WHERE risk_score < {D(0.8)}),
    b2 AS (SELECT *, CASE WHEN spread_ev > money_ev AND abs(spread) > 0 THEN 'Spread' ELSE 'Moneyline' END AS bet_type, CASE WHEN spread_ev > money_ev AND abs(spread) > 0 THEN spread_ev ELSE money_ev END AS value FROM b1),
    bets AS (SELECT *, CASE WHEN bet_type = 'Spread' THEN -110 ELSE home_odds END AS odds, {I(f'(1 - risk_score) * {D(100)}')} AS confidence_pct, {R('value', 2)} AS value_score FROM b2)"""


@query(BETS + "SELECT game_id, bet_type, odds, confidence_pct, value_score FROM bets")
def bet08_single_bets(view):
    return bets.single_bets(assessed(view)).select("game_id", "bet_type", "odds", "confidence_pct", "value_score")


@query(BETS + f"""SELECT game_id, concat_ws(' | ', CASE WHEN value > {D(0.15)} THEN concat('Strong value opportunity with ', printf('%.1f%%', {R('value * 100', 1)}), ' edge') WHEN value > {D(0.05)} THEN concat('Moderate value with ', printf('%.1f%%', {R('value * 100', 1)}), ' edge') END,
    CASE WHEN abs(hp - ap) > 5 THEN concat(CASE WHEN hp > ap THEN home_name ELSE away_name END, ' shows stronger offensive performance') END,
    CASE risk_level WHEN 'low' THEN 'Historical data suggests consistent performance patterns' WHEN 'medium' THEN 'Moderate volatility in recent performances' END) AS reasoning FROM bets""")
def bet09_reasoning(view):
    return bets.single_bets(assessed(view)).select("game_id", "reasoning")


PARLAYS = BETS + f""", q1 AS (SELECT *, row_number() OVER (ORDER BY value_score DESC, confidence_pct DESC, game_id) AS place, concat(home_name, ' vs ', away_name, ': ', bet_type, ' (', CAST(odds AS STRING), ')') AS leg, {decimal_sql('CAST(odds AS DOUBLE)')} AS price FROM bets WHERE value_score > 0 AND confidence_pct > 70),
    q2 AS (SELECT a.place, a.leg AS leg, b.leg AS next_leg, a.price * b.price AS c, (a.value_score + b.value_score) / 2 AS v FROM q1 a JOIN q1 b ON b.place = a.place + 1 WHERE a.place <= 3)"""


def _parlays(view) -> DataFrame:
    return bets.parlays(bets.single_bets(assessed(view)))


@query(PARLAYS + f"SELECT place AS parlay_id, '2-Game Value Parlay' AS name, {back_sql('c')} AS combined_odds, {R(f'{back_sql(chr(99))} * {D(1.5)}', 2)} AS potential_payout, {R('c')} AS decimal_payout, {R('v', 2)} AS value_score, concat(leg, '; ', next_leg) AS bets FROM q2")
def bet10_parlays(view):
    return _parlays(view)


@query(PARLAYS + "SELECT place AS parlay_id, leg AS first_leg, next_leg AS second_leg FROM q2")
def win07_adjacent_pairs(view):
    return _parlays(view).select("parlay_id", F.split("bets", "; ")[0].alias("first_leg"), F.split("bets", "; ")[1].alias("second_leg"))


@query(BETS + "SELECT row_number() OVER (ORDER BY value_score DESC, confidence_pct DESC, game_id) AS place, game_id, value_score FROM bets")
def srt01_ranked_bets(view):
    return bets.placed_bets(bets.single_bets(assessed(view))).select("place", "game_id", "value_score")


@query(PARLAYS + f"SELECT place AS parlay_id, {R('v', 2)} AS value_score FROM q2 ORDER BY 2 DESC, 1 LIMIT 3")
def srt02_top_parlays(view):
    return _parlays(view).select("parlay_id", "value_score").orderBy(F.desc("value_score"), "parlay_id").limit(3)


@query(SLIPS + "SELECT slip_id, CASE WHEN kind IS NULL THEN 'type required' WHEN NOT (coalesce(amount, 0) > 0) THEN 'amount must be positive' WHEN kind IN ('spread', 'moneyline') AND side IS NULL THEN 'team required' WHEN kind = 'parlay' AND NOT (legs >= 1) THEN 'parlay needs a leg' END AS reject_reason FROM slips")
def bet11_slip_validation(view):
    return bets.checked_slips(slips(view)).select("slip_id", "reject_reason")


PRODUCT = f", priced AS (SELECT slip_id, count(*) AS legs, list_reduce(list({decimal_sql('CAST(odds AS DOUBLE)')} ORDER BY leg_no, {decimal_sql('CAST(odds AS DOUBLE)')}), lambda x, y: x * y) AS c FROM slip_legs GROUP BY slip_id)"


@query(PRODUCT + f"SELECT slip_id, legs, {R('c')} AS decimal_odds, {back_sql('c')} AS american_odds FROM priced")
def agg09_slip_odds(view):
    return bets.slip_odds(view("slip_legs"))


SETTLED = f""", played AS (SELECT g.game_id, g.home_id, g.away_id, r.actual_winner, r.final_spread FROM games g JOIN results r ON g.game_id = r.game_id),
    s1 AS (SELECT l.*, CASE WHEN p.game_id IS NOT NULL THEN coalesce(CASE WHEN bet_type = 'spread' THEN CASE WHEN side = 'home' THEN final_spread ELSE -final_spread END + coalesce(line, 0) > 0 ELSE CASE WHEN side = 'home' THEN home_id ELSE away_id END = actual_winner END, false) END AS leg_won FROM slip_legs l LEFT JOIN played p ON l.game_id = p.game_id),
    s2 AS (SELECT slip_id, count(*) AS legs, CASE WHEN count(*) > 1 THEN 'parlay' ELSE min(bet_type) END AS kind, max(odds) AS odds, count(leg_won) AS known, bool_and(leg_won) AS all_won, CAST(max(amount) AS DOUBLE) AS stake FROM s1 GROUP BY slip_id),
    s3 AS (SELECT *, CASE WHEN NOT all_won THEN false WHEN known = legs THEN all_won END AS won FROM s2),
    s4 AS (SELECT *, CASE WHEN won THEN stake * CASE kind WHEN 'spread' THEN {D(1.91)} WHEN 'moneyline' THEN {decimal_sql('CAST(odds AS DOUBLE)')} ELSE pow({D(1.91)}, legs) END WHEN NOT won THEN {D(0)} END AS payout FROM s3)"""


@query(SETTLED + f"SELECT slip_id, kind, legs, won, stake, {R('payout', 4)} AS payout, {R('payout - stake', 4)} AS profit FROM s4")
def bet13_settlement(view):
    played = view("results").join(view("games").select("game_id", "home_id", "away_id"), "game_id")
    return bets.settled(view("slip_legs"), played)


@query(FORECAST + f", e1 AS (SELECT game_id, 'home' AS side, p_home AS p, {implied_sql('CAST(home_ml AS DOUBLE)')} AS implied FROM forecasts JOIN market_odds USING (game_id) WHERE home_ml IS NOT NULL UNION ALL SELECT game_id, 'away', p_away, {implied_sql('CAST(away_ml AS DOUBLE)')} FROM forecasts JOIN market_odds USING (game_id) WHERE away_ml IS NOT NULL) SELECT * FROM (SELECT game_id, side, {R('p')} AS p, {R('implied')} AS implied, {R('p - implied')} AS edge FROM e1) WHERE edge > 0")
def bet14_edges(view):
    return bets.edges(forecasts(view), view("market_odds"))


# ---- tracking -------------------------------------------------------------------------------------------------

TS = lambda s: f"TIMESTAMP '{s}'"
TREND = f""", trend AS (SELECT CAST(ts AS DATE) AS day, {R("avg(CASE WHEN winner_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS accuracy, {R('avg(spread_error)')} AS spread_error, count(*) AS games FROM metrics
    WHERE ts >= {TS('2001-07-02 00:00:00')} AND ts < {TS(AS_OF)} GROUP BY 1)"""


def _trend(view) -> DataFrame:
    return tracking.accuracy_trend(view("metrics"), F.lit(AS_OF).cast("timestamp_ntz"))


@query(TREND + "SELECT * FROM trend")
def agg01_accuracy_trend(view):
    return _trend(view)


@query(TREND + "SELECT CAST(row_number() OVER (ORDER BY day DESC) AS INT) AS place, day FROM trend")
def srt04_newest_first(view):
    from pyspark.sql import Window

    return _trend(view).select(F.row_number().over(Window.orderBy(F.desc("day"))).alias("place"), "day")


@query(TREND + f"SELECT day, {R('accuracy * 100', 2)} AS accuracy_pct, {I('accuracy * games')} AS correct, games - {I('accuracy * games')} AS incorrect FROM trend")
def agg12_dashboard_series(view):
    return tracking.dashboard_series(_trend(view))


DETAIL = f""", detail AS (SELECT p.game_id, p.predicted_winner, r.actual_winner, m.spread_error FROM predictions p JOIN results r ON p.game_id = r.game_id JOIN metrics m ON p.game_id = m.game_id
    WHERE p.ts >= {TS('2001-07-01 00:00:00')} AND p.ts < {TS('2001-08-01 00:00:00')} AND r.actual_winner IS NOT NULL)"""


@query(DETAIL.replace("2001-07-01", "2001-07-31") + "SELECT game_id, predicted_winner, actual_winner, spread_error FROM detail")
def jon04_day_detail(view):
    return tracking.day_detail(view("predictions"), view("results"), view("metrics"), "2001-07-31").select("game_id", "predicted_winner", "actual_winner", "spread_error")


@query(DETAIL.replace("2001-07-01", "2001-07-31") + f"""SELECT count(*) FILTER (WHERE predicted_winner = actual_winner) AS correct, count(*) - count(*) FILTER (WHERE predicted_winner = actual_winner) AS incorrect,
    {R("coalesce(CAST(count(*) FILTER (WHERE predicted_winner = actual_winner) AS DOUBLE) / nullif(count(*), 0), 0)")} AS accuracy, count(*) FILTER (WHERE spread_error BETWEEN 0 AND 5) AS errors_0,
    count(*) FILTER (WHERE spread_error BETWEEN 6 AND 10) AS errors_1, count(*) FILTER (WHERE spread_error BETWEEN 11 AND 15) AS errors_2, count(*) FILTER (WHERE spread_error > 15) AS errors_3 FROM detail""")
def agg02_day_report(view):
    return tracking.day_report(tracking.day_detail(view("predictions"), view("results"), view("metrics"), "2001-07-31"))


@query(""" SELECT b AS bucket, CASE b WHEN '0-5' THEN a WHEN '6-10' THEN c WHEN '11-15' THEN d WHEN '16+' THEN e ELSE n - a - c - d - e END AS games FROM (SELECT count(*) FILTER (WHERE spread_error BETWEEN 0 AND 5) AS a, count(*) FILTER (WHERE spread_error BETWEEN 6 AND 10) AS c,
    count(*) FILTER (WHERE spread_error BETWEEN 11 AND 15) AS d, count(*) FILTER (WHERE spread_error > 15) AS e, count(spread_error) AS n FROM metrics), (VALUES ('0-5'), ('6-10'), ('11-15'), ('16+'), ('unbucketed')) AS t(b)""")
def agg03_error_histogram(view):
    return tracking.error_histogram(view("metrics"))


@query(" SELECT CAST(game_ts AS DATE) AS day, count(*) AS games, string_agg(CAST(game_id AS STRING), ',' ORDER BY game_id) AS game_ids FROM games GROUP BY 1")
def agg08_games_by_date(view):
    return tracking.games_by_date(view("games"))


@query(" SELECT DISTINCT CAST(game_ts AS DATE) AS day FROM games")
def srt03_dates(view):
    return tracking.games_by_date(view("games")).select("day")


def _store(view, **tables: DataFrame) -> TrackingStore:
    """A store that holds these tables; the others are empty."""
    found = {name: tables.get(name, view(name).limit(0)) for name in tracking.TABLES}
    spark = found["metrics"].sparkSession
    store = TrackingStore(spark, f"{scratch(spark)}/tracking", {name: rows.schema for name, rows in found.items()})
    at = store.versions.current()
    store.versions.commit(at, {name: store.versions.write(name, rows, store.part) for name, rows in found.items()})
    return store


NEW = ", fresh AS (SELECT game_id, ts + INTERVAL 1 HOUR AS ts, away_id AS home_id, home_id AS away_id, away_id AS predicted_winner, predicted_spread + 1 AS predicted_spread, win_probability FROM predictions WHERE game_id % 2 = 1), older AS (SELECT * FROM predictions WHERE game_id % 4 < 3)"


def _old_new(view) -> tuple[DataFrame, DataFrame]:
    """Even games and every other odd one are in the table, all odd ones come anew."""
    p = view("predictions")
    fresh = p.filter("game_id % 2 = 1").select("game_id", (F.col("ts") + F.expr("interval 1 hour")).alias("ts"), F.col("away_id").alias("home_id"), F.col("home_id").alias("away_id"), F.col("away_id").alias("predicted_winner"), (F.col("predicted_spread") + 1).alias("predicted_spread"), "win_probability")
    return p.filter("game_id % 4 < 3"), fresh


@query(NEW + " SELECT coalesce(f.game_id, o.game_id) AS game_id, coalesce(f.ts, o.ts) AS ts, coalesce(o.home_id, f.home_id) AS home_id, coalesce(o.away_id, f.away_id) AS away_id, coalesce(f.predicted_winner, o.predicted_winner) AS predicted_winner, coalesce(f.predicted_spread, o.predicted_spread) AS predicted_spread, coalesce(f.win_probability, o.win_probability) AS win_probability FROM older o FULL JOIN fresh f ON o.game_id = f.game_id")
def snk01_upsert_predictions(view):
    old, fresh = _old_new(view)
    store = _store(view, predictions=old)
    store.upsert_predictions(fresh)
    return store.read("predictions").select(*old.columns)


@query(" SELECT game_id, ts, home_score FROM results")
def snk02_insert_results(view):
    r = view("results")
    late = r.withColumns({"ts": F.col("ts") + F.expr("interval 1 day"), "home_score": F.col("home_score") + 1})
    store = _store(view, results=r.filter("game_id % 3 = 0"))
    store.insert_results(late.unionByName(r.filter("game_id % 3 > 0")))
    return store.read("results").select("game_id", "ts", "home_score")


@query(" SELECT game_id, spread_error, winner_correct, ts FROM metrics")
def snk03_derived_metrics(view):
    """Results arrive where predictions are; each brings its metric."""
    store = _store(view, predictions=view("predictions"), results=view("results").limit(0))
    store.insert_results(view("results"))
    return store.read("metrics")


@query(" SELECT game_id, CASE WHEN game_id % 2 = 0 THEN spread_error + 1 ELSE spread_error END AS spread_error, winner_correct, CASE WHEN game_id % 2 = 0 THEN ts + INTERVAL 1 DAY ELSE ts END AS ts FROM metrics")
def snk04_upsert_metrics(view):
    m = view("metrics")
    changed = m.filter("game_id % 2 = 0").withColumns({"spread_error": F.col("spread_error") + 1, "ts": F.col("ts") + F.expr("interval 1 day")})
    store = _store(view, metrics=m)
    store.upsert_metrics(changed)
    return store.read("metrics")


@query(""" SELECT t AS tracked, game_id, CASE WHEN game_id % 6 = 1 THEN x + 100 ELSE x END AS x FROM (SELECT 'predictions' AS t, game_id, predicted_spread AS x FROM predictions UNION ALL SELECT 'results', game_id, final_spread FROM results UNION ALL SELECT 'metrics', game_id, spread_error FROM metrics)""")
def snk05_replace_keys(view):
    """All three tracking tables, written and read again."""
    value = {"predictions": "predicted_spread", "results": "final_spread", "metrics": "spread_error"}
    old = {name: view(name) for name in tracking.TABLES}
    new = {name: t.filter("game_id % 6 = 1").withColumn(value[name], F.col(value[name]) + 100) for name, t in old.items()}
    store = _store(view, **old)
    store.replace(new)
    parts = [store.read(name).select(F.lit(name).alias("tracked"), "game_id", F.col(value[name]).alias("x")) for name in tracking.TABLES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(DETAIL.replace("2001-07-01", "2001-07-31") + TREND + f"""SELECT CAST(t.day AS VARCHAR) AS day, t.accuracy, t.spread_error, t.games, d.correct, d.b11_15, d.first_game, d.last_error FROM trend t, (SELECT count(*) FILTER (WHERE predicted_winner = actual_winner) AS correct, count(*) FILTER (WHERE spread_error BETWEEN 11 AND 15) AS b11_15, min(game_id) AS first_game, arg_max(spread_error, game_id) AS last_error FROM detail) d""")
def snk06_dashboard_document(view):
    """The nested document, written as JSON and read again: the trend's days beside fields of the day's report."""
    detail = tracking.day_detail(view("predictions"), view("results"), view("metrics"), "2001-07-31")
    document = tracking.dashboard(detail, _trend(view))
    spark = document.sparkSession
    landed = feeds.land(document, f"{scratch(spark)}/dashboard")
    read = spark.read.schema(document.schema).json(landed)
    return read.select(F.explode("trend").alias("t"), "day.correct", F.col("day.spread_errors.b11_15").alias("b11_15"), F.get("games", F.lit(0))["game_id"].alias("first_game"), F.try_element_at("games", F.lit(-1))["spread_error"].alias("last_error")).select(F.col("t.day").cast("string").alias("day"), "t.accuracy", "t.spread_error", "t.games", "correct", "b11_15", "first_game", "last_error")


@query(""" SELECT t AS tracked, game_id, ts, x FROM (SELECT 'predictions' AS t, game_id, ts, predicted_spread AS x FROM predictions UNION ALL SELECT 'results', game_id, ts, final_spread FROM results UNION ALL SELECT 'metrics', game_id, ts, spread_error FROM metrics)
    WHERE ts >= TIMESTAMP '2001-06-01' AND ts < TIMESTAMP '2001-08-01'""")
def src08_tracking_reads(view):
    """Two months of all three tables, read from the store, whose other months are not opened."""
    value = {"predictions": "predicted_spread", "results": "final_spread", "metrics": "spread_error"}
    store = _store(view, **{name: view(name) for name in tracking.TABLES})
    parts = [store.read(name, "2001-06", "2001-07").select(F.lit(name).alias("tracked"), "game_id", "ts", F.col(c).alias("x")) for name, c in value.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(" SELECT game_id FROM results WHERE game_id NOT IN (SELECT game_id FROM predictions)")
def jon07_not_predicted(view):
    return view("results").join(view("predictions").select("game_id"), "game_id", "left_anti").select("game_id")


@query(" SELECT a.game_id, count(*) AS others, min(b.game_id) AS first_other FROM games a JOIN games b ON a.sport = b.sport AND CAST(a.game_ts AS DATE) = CAST(b.game_ts AS DATE) AND a.game_id <> b.game_id GROUP BY a.game_id")
def jon08_other_games(view):
    return tracking.other_game_counts(view("games"))


@query(SLIPS + ", firsts AS (SELECT s.slip_id, s.legs, min(l.game_id) AS game_id FROM slips s JOIN slip_legs l ON s.slip_id = l.slip_id GROUP BY ALL) SELECT f.slip_id, p.predicted_winner FROM firsts f LEFT JOIN predictions p ON f.game_id = p.game_id")
def jon09_first_prediction(view):
    firsts = view("slip_legs").groupBy("slip_id").agg(F.min("game_id").alias("game_id"))
    return tracking.first_prediction(firsts, view("predictions")).select("slip_id", "predicted_winner")


# ---- sources --------------------------------------------------------------------------------------------------


def _documents(rows: DataFrame, *columns) -> DataFrame:
    """Rows as documents of a text column, such as request bodies."""
    return rows.select(feeds.as_struct_json(*columns).alias("value"))


def _landed(rows: DataFrame, schema: str, *columns) -> DataFrame:
    """Rows landed as JSON files and read from there, as from a feed."""
    spark = rows.sparkSession
    return feeds.read_json(spark, feeds.land(rows.select(*columns), f"{scratch(spark)}/landed"), schema)


EASTERN = """CAST(make_date(year(u), 4, 1) + CAST((7 - dayofweek(make_date(year(u), 4, 1))) % 7 AS INTEGER) AS TIMESTAMP) + INTERVAL 7 HOUR AS a,
    CAST(make_date(year(u), 10, 31) - CAST(dayofweek(make_date(year(u), 10, 31)) AS INTEGER) AS TIMESTAMP) + INTERVAL 6 HOUR AS b"""


@query(MATCHUPS + f", s AS (SELECT CAST(game_id AS STRING) AS game_id, game_ts AS u, home_name, away_name FROM matchups), z AS (SELECT *, u - to_hours(CASE WHEN u >= a AND u < b THEN 4 ELSE 5 END) AS l FROM (SELECT *, {EASTERN} FROM s)) SELECT game_id, strftime(l, '%Y-%m-%d') AS game_date, strftime(l, '%-I:%M %p') AS game_time, home_name, away_name FROM z")
def src01_scoreboard(view):
    m = forecast.matchups(view("games"), view("teams"))
    side = lambda s: F.struct(F.lit(s).alias("homeAway"), F.struct(F.col(f"{s}_name").alias("name")).alias("team"))
    event = F.struct(F.col("game_id").cast("string").alias("id"), F.date_format("game_ts", "yyyy-MM-dd'T'HH:mm'Z'").alias("date"), F.array(F.struct(F.array(side("away"), side("home")).alias("competitors"))).alias("competitions"))
    return feeds.scoreboard_games(_landed(m, feeds.SCOREBOARD, F.array(event).alias("events")))


@query(MATCHUPS + f"""SELECT game_id, strftime(game_ts, '%Y-%m-%d') AS game_date, strftime(game_ts, '%H:%M:%S') AS game_time, home_name, away_name, {R("CASE WHEN game_id % 5 = 0 THEN 0 ELSE CAST(game_id % 5 AS DOUBLE) / (game_id % 5 + game_id % 7) END")} AS home_win_pct,
    CASE WHEN game_id % 4 = 0 THEN {D(0)} ELSE CAST(home_score AS DOUBLE) END AS home_points_avg, CAST(away_score AS DOUBLE) AS away_points_avg FROM matchups""")
def src02_season_scores(view):
    m = forecast.matchups(view("games"), view("teams"))
    docs = _landed(m, feeds.SEASON, F.col("game_id").alias("GameID"), F.date_format("game_ts", "yyyy-MM-dd'T00:00:00'").alias("Day"), F.date_format("game_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("DateTime"), F.col("home_name").alias("HomeTeam"), F.col("away_name").alias("AwayTeam"), (F.col("game_id") % 5).alias("HomeTeamWins"), (F.col("game_id") % 7).alias("HomeTeamLosses"), F.when(F.col("game_id") % 4 != 0, F.col("home_score")).alias("HomeTeamScore"), F.col("away_score").alias("AwayTeamScore"))
    return feeds.season_games(docs)


@query(""" SELECT CASE WHEN game_id % 9 = 4 THEN 'corrupt' WHEN game_id % 7 = 2 THEN 'HomeTeam missing' WHEN game_id % 5 = 1 THEN 'AwayTeam missing' ELSE 'read' END AS outcome, count(*) AS documents,
    CAST(coalesce(sum(CASE WHEN game_id % 9 <> 4 AND game_id % 7 <> 2 AND game_id % 5 <> 1 THEN game_id END), 0) AS BIGINT) AS ids FROM games GROUP BY 1""")
def prj13_checked_feed(view):
    """A landed feed of season scores with broken lines and missing names: what is read, and what is kept apart and why."""
    g = view("games")
    line = F.to_json(F.struct(F.col("game_id").alias("GameID"), F.when(F.expr("game_id % 7 <> 2"), F.concat(F.lit("T"), F.col("home_id").cast("string"))).alias("HomeTeam"), F.when(F.expr("game_id % 5 <> 1"), F.concat(F.lit("T"), F.col("away_id").cast("string"))).alias("AwayTeam")))
    path = f"{scratch(g.sparkSession)}/landed"
    g.select(F.when(F.expr("game_id % 9 = 4"), F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    rows, rejects = feeds.read_checked(g.sparkSession, path, feeds.SEASON, ("HomeTeam", "AwayTeam"))
    counted = lambda df, outcome, ids: df.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(ids), F.lit(0)).alias("ids"))
    return counted(rows, F.lit("read"), F.col("GameID")).unionByName(counted(rejects, F.col("reason"), F.lit(None).cast("long")))


@query(f" SELECT game_id, CASE WHEN game_id % 11 = 0 THEN 'N/A' ELSE concat('T -', CAST(game_id % 9 AS STRING)) END AS spread, CAST(200 + game_id % 40 AS DOUBLE) AS over_under, CASE WHEN game_id % 13 = 0 THEN NULL ELSE CAST(coalesce(home_ml, 0) AS INT) END AS home_ml, CAST(coalesce(away_ml, 0) AS INT) AS away_ml, 'book' AS provider FROM market_odds")
def src03_odds_quotes(view):
    o = view("market_odds")
    line = lambda c: F.struct(c.alias("moneyLine"))
    home = F.when(F.col("game_id") % 13 == 0, "EVEN").otherwise(F.col("home_ml").cast("string"))
    docs = _landed(o, feeds.QUOTE, "game_id", F.when(F.col("game_id") % 11 != 0, F.concat(F.lit("T -"), (F.col("game_id") % 9).cast("string"))).alias("details"), (F.lit(200.0) + F.col("game_id") % 40).alias("overUnder"), F.struct(line(home).alias("homeTeamOdds"), line(F.col("away_ml").cast("string")).alias("awayTeamOdds")).alias("moneyLine"), F.struct(F.lit("book").alias("name")).alias("provider"))
    return feeds.odds_quotes(docs)


@query(" SELECT team_id, team_name, win_pct, points_avg, points_against_avg FROM teams")
def src04_team_stats(view):
    return view("teams").select("team_id", "team_name", "win_pct", "points_avg", "points_against_avg")


@query(" SELECT s.s_suppkey AS team_id, coalesce(t.team_name, concat('S', CAST(s.s_suppkey AS STRING))) AS full_name FROM supplier s LEFT JOIN teams t ON t.short_name = concat('S', CAST(s.s_suppkey AS STRING))")
def jon01_alias_lookup(view):
    codes = view("supplier").select(F.col("s_suppkey").alias("team_id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("code"))
    return feeds.aliased(codes, view("teams").select("short_name", "team_name"), "code").select("team_id", "full_name")


@query(" SELECT short_name, team_name FROM teams")
def src05_alias_table(view):
    return view("teams").select("short_name", "team_name")


@query(" SELECT g.game_id, h.team_name AS home_name, a.team_name AS away_name FROM games g JOIN teams h ON g.home_id = h.team_id JOIN teams a ON g.away_id = a.team_id")
def jon03_both_codes(view):
    side = lambda s: view("teams").select(F.col("team_id").alias(f"{s}_id"), F.col("team_name").alias(f"{s}_name"))
    return view("games").join(side("home"), "home_id").join(side("away"), "away_id").select("game_id", "home_name", "away_name")


SCHEDULE = "SELECT game_id, CAST(DATE '2025-03-15' + CAST(i // 3 AS INT) AS DATE) AS game_date, CASE WHEN i % 2 = 0 THEN '19:05' ELSE '13:05' END AS game_time FROM (SELECT game_id, row_number() OVER (ORDER BY game_id) - 1 AS i FROM games WHERE sport = 'MLB') WHERE i < 21"


@query(f" {SCHEDULE}")
def src06_dated_schedule(view):
    return feeds.dated_schedule(forecast.supported(view("games"), "MLB").select("game_id"), "game_id", "2025-03-15")


@query(f" SELECT game_date, count(*) AS games FROM ({SCHEDULE}) GROUP BY game_date")
def srt05_schedule_cap(view):
    s = feeds.dated_schedule(forecast.supported(view("games"), "MLB").select("game_id"), "game_id", "2025-03-15")
    return s.groupBy("game_date").agg(F.count(F.lit(1)).alias("games"))


@query(MATCHUPS + "SELECT game_id, home_name, away_name, hw, hp, CASE WHEN game_id % 10 = 0 THEN NULL ELSE ha END AS ha, aw, ap, aa, false AS home_back_to_back, false AS away_back_to_back FROM matchups")
def src07_forecast_requests(view):
    m = forecast.matchups(view("games"), view("teams"))
    allowed = F.when(F.col("game_id") % 10 == 0, "n/a").otherwise(F.col("ha").cast("string"))
    team = lambda s, a: F.struct(F.col(f"{s}_name").alias("name"), F.col(f"{s[0]}w").cast("string").alias("win_pct"), F.col(f"{s[0]}p").cast("string").alias("points_avg"), a.alias("points_against_avg")).alias(f"{s}_team")
    return feeds.forecast_requests(_documents(m, "game_id", team("home", allowed), team("away", F.col("aa").cast("string"))))


@query(" SELECT article_id, team_id, title FROM articles WHERE day_offset < 3")
def src09_article_feed(view):
    return text.recent_articles(view("articles"), 3).select("article_id", "team_id", "title")


@query(r""" SELECT page_id, length(t) AS n_chars, substr(t, 1, 200) AS preview FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS t FROM pages)""")
def src10_page_preview(view):
    return feeds.page_preview(view("pages"))


@query(" SELECT game_id, predicted_spread AS spread, CAST(game_id % 2 AS INT) AS label FROM predictions")
def src11_training_rows(view):
    p = view("predictions").groupBy((F.col("game_id") % 500).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("game_id", F.col("predicted_spread").alias("spread")))).alias("games"))
    return feeds.training_rows(_landed(p, feeds.TRAINING, "games", F.transform("games", lambda g: (g["game_id"] % 2).cast("int")).alias("labels")))


@query(" SELECT day, strftime(day, '%Y%m%d') AS partition, count(g.game_id) AS games FROM (SELECT CAST(unnest(range(DATE '2001-07-30', DATE '2001-08-06', INTERVAL 1 DAY)) AS DATE) AS day) LEFT JOIN games g ON CAST(g.game_ts AS DATE) = day GROUP BY ALL")
def src12_date_partitions(view):
    games = view("games")
    days = feeds.next_days(games.sparkSession, "2001-07-30", 7)
    return days.join(games.select("game_id", F.to_date("game_ts").alias("day")), "day", "left").groupBy("day", "partition").agg(F.count("game_id").alias("games"))


# ---- text -----------------------------------------------------------------------------------------------------

SENTENCES = r", sents AS (SELECT article_id, s.sentence, s.place FROM (SELECT article_id, list_filter(string_split_regex(trim(regexp_replace(content, '([.!?])[ \t\r\n\f\v]+', '\1' || chr(1), 'g')), chr(1)), lambda x: x <> '') AS l FROM articles), LATERAL (SELECT unnest(l) AS sentence, unnest(range(len(l))) AS place) AS s)"


@query(SENTENCES + "SELECT article_id, count(*) AS sentences, CAST(sum(length(sentence)) AS BIGINT) AS chars FROM sents GROUP BY article_id")
def txt01_sentences(view):
    s = view("articles").select("article_id", F.explode(text.sentences(F.col("content"))).alias("s"))
    return s.groupBy("article_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("s")).alias("chars"))


def sentiment_sql(source: str, keys: str, column: str, name: str) -> str:
    return f""", {name}_t AS (SELECT {keys}, unnest(string_split_regex(lower({column}), '[^a-z]+')) AS token FROM {source}),
        {name} AS (SELECT {keys}, t / sqrt(t * t + 15) AS compound FROM (SELECT {keys}, CAST(sum(CAST(round_even(coalesce(valence, 0) * 1000, 0) AS BIGINT)) AS DOUBLE) / 1000 AS t FROM {name}_t LEFT JOIN lexicon USING (token) GROUP BY {keys}))"""


@query(sentiment_sql("articles", "article_id", "content", "c") + f"SELECT article_id, {R('compound')} AS compound FROM c")
def txt02_lexicon_sentiment(view):
    return text.text_sentiment(view("articles"), view("lexicon"), ["article_id"], "content").select("article_id", rounded("compound").alias("compound"))


SCORED = SENTENCES + sentiment_sql("articles", "article_id", "title", "ti") + sentiment_sql("sents", "article_id, place", "sentence", "se") + f""",
    body AS (SELECT article_id, CAST(sum(CAST(round_even(compound * 1e9, 0) AS BIGINT)) AS DOUBLE) / count(*) / 1e9 AS b FROM se GROUP BY article_id),
    scored AS (SELECT article_id, {R(f'compound * {D(0.3)} + coalesce(b, 0) * {D(0.7)}')} AS score FROM ti LEFT JOIN body USING (article_id))"""


@query(SCORED + "SELECT article_id, score, CASE WHEN score > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label, abs(score) AS confidence FROM scored")
def txt03_article_sentiment(view):
    return text.article_sentiment(view("articles"), view("lexicon"))


@query(SCORED + f"SELECT article_id, {R('b')} AS body_score FROM body")
def agg07_sentence_mean(view):
    articles = view("articles")
    some = articles.filter(F.size(text.sentences(F.col("content"))) > 0).select("article_id")
    scored = some.join(text.sentence_scores(articles, view("lexicon")), "article_id", "left")
    return scored.select("article_id", rounded(F.coalesce("body_score", F.lit(0.0))).alias("body_score"))


@query(""" SELECT article_id, regexp_matches(lower(content), 'injury|injured|recovery') AS injury_related, regexp_matches(lower(content), 'strategy|system|approach') AS strategy_change,
    CASE WHEN regexp_matches(lower(content), 'confident|optimistic|positive') THEN 'positive' WHEN regexp_matches(lower(content), 'concerned|worried|frustrated') THEN 'negative' ELSE 'neutral' END AS team_morale,
    CASE WHEN regexp_matches(lower(content), 'improving|better|progress') THEN 'improving' WHEN regexp_matches(lower(content), 'declining|worse|struggling') THEN 'declining' ELSE 'stable' END AS performance_trend FROM articles""")
def txt04_key_information(view):
    return text.key_information(view("articles")).select("article_id", "injury_related", "strategy_change", "team_morale", "performance_trend")


@query(" SELECT article_id, CAST(row_number() OVER (PARTITION BY team_id ORDER BY day_offset, article_id) AS INT) AS recency FROM articles")
def win08_article_recency(view):
    return text.recency_rank(view("articles")).select("article_id", "recency")


FACTORS = SCORED + f""", ranked AS (SELECT a.team_id, s.score, row_number() OVER (PARTITION BY a.team_id ORDER BY a.day_offset, a.article_id) AS recency FROM articles a JOIN scored s USING (article_id)),
    factors AS (SELECT t.team_id, coalesce(f, 0) AS factor FROM teams t LEFT JOIN (SELECT team_id, {R(f"list_reduce(list_prepend({D(0)}, list(score / recency ORDER BY recency)), lambda x, y: x + y) / list_reduce(list_prepend({D(0)}, list({D(1)} / recency ORDER BY recency)), lambda x, y: x + y) * {D(0.1)}", 3)} AS f FROM ranked GROUP BY team_id) r ON t.team_id = r.team_id)"""


def _factors(view) -> DataFrame:
    articles = view("articles")
    scored = articles.select("article_id", "team_id", "day_offset").join(text.article_sentiment(articles, view("lexicon")), "article_id")
    return text.team_sentiment(scored, view("teams"))


@query(FACTORS + "SELECT team_id, factor FROM factors")
def txt05_team_sentiment(view):
    return _factors(view)


@query(FACTORS + "SELECT sign(factor) AS side, count(*) AS teams, min(factor) AS least, max(factor) AS most FROM factors GROUP BY 1")
def agg06_recency_weighted(view):
    return _factors(view).groupBy(F.signum("factor").cast("int").alias("side")).agg(F.count(F.lit(1)).alias("teams"), F.min("factor").alias("least"), F.max("factor").alias("most"))


@query(FACTORS + f"SELECT g.game_id, {R('coalesce(h.factor, 0) - coalesce(a.factor, 0)', 3)} AS advantage FROM games g LEFT JOIN factors h ON g.home_id = h.team_id LEFT JOIN factors a ON g.away_id = a.team_id")
def txt06_sentiment_advantage(view):
    return text.sentiment_advantage(view("games"), _factors(view))


@query(FORECAST + f"""SELECT sport, CAST(game_ts AS DATE) AS day, concat('Compare these forecasts with the market. Name single bets, parlays, inefficiencies, insights and a strategy.', chr(10), string_agg(concat('{{"game_id": ', game_id, ', "home": {{"name": "', home_name, '", "win_probability": "', printf('%.1f%%', {R('p_home * 100', 1)}), '", "moneyline": ', home_odds, '}}, "away": {{"name": "', away_name,
    '", "win_probability": "', printf('%.1f%%', {R('p_away * 100', 1)}), '", "moneyline": ', away_odds, '}}, "spread": "', printf('%.1f', {R('abs(spread)', 1)}), '", "favoured": "', CASE WHEN spread > 0 THEN home_name ELSE away_name END, '", "winner": "', CASE WHEN p_home > p_away THEN home_name ELSE away_name END, '"}}'), chr(10) ORDER BY game_id)) AS brief FROM forecasts GROUP BY 1, 2""")
def txt07_analysis_brief(view):
    return text.brief(forecast.picks(forecasts(view)))


SECTIONS = """, parts AS (SELECT report_id, unnest(string_split(body, chr(10) || chr(10))) AS part, unnest(range(len(string_split(body, chr(10) || chr(10))))) AS place FROM reports),
    sections AS (SELECT * FROM (SELECT *, CASE WHEN contains(upper(part), 'SINGLE BET') THEN 'single' WHEN contains(upper(part), 'PARLAY') THEN 'parlay' WHEN contains(upper(part), 'INEFFICIENC') THEN 'inefficiency' WHEN contains(upper(part), 'INSIGHT') THEN 'insight' WHEN contains(upper(part), 'STRATEGY') THEN 'strategy' END AS kind FROM parts) WHERE kind IS NOT NULL)"""


def field_sql(prefix: str) -> str:
    return f"trim(substr(list_last(list_filter(list_transform(string_split(part, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '{prefix}'))), {len(prefix) + 1}))"


@query(SECTIONS + "SELECT report_id, CAST(place AS INT) AS place, kind, length(part) AS chars FROM sections")
def txt08_report_sections(view):
    return text.report_sections(view("reports")).select("report_id", "place", "kind", F.length("part").cast("long").alias("chars"))


SINGLE = SECTIONS + f", single AS (SELECT report_id, {field_sql('Game:')} AS teams, coalesce(TRY_CAST(replace({field_sql('Confidence:')}, '%', '') AS INT), 75) AS confidence, coalesce(TRY_CAST(replace({field_sql('Value Rating:')}, '%', '') AS INT), 7) AS value FROM sections WHERE kind = 'single')"


@query(SINGLE + "SELECT report_id, teams, confidence, value FROM single WHERE teams IS NOT NULL")
def txt09_single_bet_fields(view):
    return text.single_bet_fields(text.report_sections(view("reports")))


@query(SECTIONS + f"SELECT report_id, array_to_string(list_transform(string_split_regex({field_sql('Games:')}, '\\band\\b'), lambda x: trim(x)), '|') AS legs FROM sections WHERE kind = 'parlay'")
def txt10_parlay_legs(view):
    return text.parlay_legs(text.report_sections(view("reports")))


BULLETS = "array_to_string(list_filter(list_transform(list_filter(list_transform(string_split(part, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '•') OR starts_with(x, '-')), lambda x: trim(regexp_replace(x, '^[•-]+', ''))), lambda x: x <> ''), '|')"


@query(SECTIONS + f"SELECT report_id, {BULLETS} AS points FROM sections WHERE kind = 'insight'")
def txt11_bullets(view):
    return text.bullets(text.report_sections(view("reports")))


@query(SECTIONS + f"SELECT report_id, {field_sql('Approach:')} AS approach, {field_sql('Bankroll:')} AS bankroll, {field_sql('Risk:')} AS risk FROM sections WHERE kind = 'strategy'")
def txt12_strategy_fields(view):
    return text.strategy_fields(text.report_sections(view("reports")))


@query(SINGLE + f", ins AS (SELECT report_id, {BULLETS} AS points FROM sections WHERE kind = 'insight'), par AS (SELECT report_id, array_to_string(list_transform(string_split_regex({field_sql('Games:')}, '\\band\\b'), lambda x: trim(x)), '|') AS legs FROM sections WHERE kind = 'parlay'), strat AS (SELECT report_id, {field_sql('Risk:')} AS risk FROM sections WHERE kind = 'strategy') SELECT r.report_id, coalesce(s.teams, 'none') AS teams, coalesce(s.confidence, 75) AS confidence, coalesce(p.legs, '') AS legs, coalesce(i.points, '') AS points, coalesce(t.risk, 'medium') AS risk FROM reports r LEFT JOIN par p ON r.report_id = p.report_id LEFT JOIN strat t ON r.report_id = t.report_id LEFT JOIN single s ON r.report_id = s.report_id LEFT JOIN ins i ON r.report_id = i.report_id")
def txt13_advice(view):
    return text.advice(view("reports"))


# ---- models, streams, SQL functions ---------------------------------------------------------------------------

P3 = [f"(CAST(game_id * {k} % 100 AS DOUBLE) / 100)" for k in (17, 29, 43)]
MEAN3 = f"(({P3[0]} + {P3[1]} + {P3[2]}) / {D(3)})"
DEV3 = "sqrt((" + " + ".join(f"({p} - {MEAN3}) * ({p} - {MEAN3})" for p in P3) + f") / {D(3)})"


@query(f" SELECT game_id, {R(f'{P3[0]} * {D(0.4)} + {P3[1]} * {D(0.4)} + {P3[2]} * {D(0.2)}')} AS p FROM games")
def ml07_ensemble(view):
    return view("games").select("game_id", rounded(ml.ensemble(*map(F.expr, P3))).alias("p"))


@query(f" SELECT game_id, {R(MEAN3)} AS mean, {R(DEV3)} AS deviation FROM games")
def agg11_mean_deviation(view):
    mean, deviation = ml.mean_and_deviation(*map(F.expr, P3))
    return view("games").select("game_id", rounded(mean).alias("mean"), rounded(deviation).alias("deviation"))


@query(f" SELECT game_id, {R(f'(1 - least(2 * {DEV3}, {D(0.5)})) * 2 * abs({MEAN3} - {D(0.5)})')} AS confidence FROM games")
def ml08_ensemble_confidence(view):
    return view("games").select("game_id", rounded(ml.ensemble_confidence(*map(F.expr, P3))).alias("confidence"))


MOMENTUM = FACTORS + RECENT + f""", mo AS (SELECT team_id, sum(weight * CASE WHEN points > opponent_points THEN {D(1)} ELSE {D(-1)} END * (1 + CAST(points - opponent_points AS DOUBLE) / greatest(points, opponent_points))) / count(*) AS momentum FROM recent GROUP BY team_id)"""
ENHANCED = MOMENTUM + H2H + MATCHUPS + f""", rested AS (SELECT game_id, bool_or(is_home = 1 AND b) AS hb, bool_or(is_home = 0 AND b) AS ab FROM (SELECT game_id, is_home, coalesce({LAG} <= 1, false) AS b FROM team_games) GROUP BY game_id),
    enhanced AS (SELECT m.game_id, {R('x.hw')} AS home_team_win_pct, {R('x.aw')} AS away_team_win_pct, {R('x.hp')} AS home_team_points_avg, {R('x.ap')} AS away_team_points_avg, {R('x.ha')} AS home_team_points_allowed_avg, {R('x.aa')} AS away_team_points_allowed_avg,
        {R('coalesce(hm.momentum, 0)')} AS home_team_momentum, {R('coalesce(am.momentum, 0)')} AS away_team_momentum, {R('coalesce(hm.momentum, 0) - coalesce(am.momentum, 0)')} AS momentum_advantage, coalesce(hi_.impact, 0) AS home_team_injury_impact, coalesce(ai_.impact, 0) AS away_team_injury_impact,
        {R('coalesce(hi_.impact, 0) - coalesce(ai_.impact, 0)')} AS injury_difference, {R("CAST(" + HOME_WINS.replace("home_id", "m.home_id").replace("away_id", "m.away_id") + " AS DOUBLE) / n")} AS head_to_head_advantage, w.impact AS weather_impact, {R('coalesce(hf.factor, 0) - coalesce(af.factor, 0)')} AS sentiment_advantage, hb AS home_team_back_to_back, ab AS away_team_back_to_back
        FROM met m JOIN matchups x ON m.game_id = x.game_id JOIN rested r ON m.game_id = r.game_id LEFT JOIN mo hm ON m.home_id = hm.team_id LEFT JOIN mo am ON m.away_id = am.team_id LEFT JOIN injuries hi_ ON m.home_id = hi_.team_id LEFT JOIN injuries ai_ ON m.away_id = ai_.team_id
        LEFT JOIN weather w ON m.game_id = w.game_id LEFT JOIN factors hf ON m.home_id = hf.team_id LEFT JOIN factors af ON m.away_id = af.team_id)"""


def _enhanced(view) -> DataFrame:
    games = view("games")
    return ml.enhanced_features(forecast.matchups(games, view("teams")), games, view("injuries"), view("weather"), _factors(view))


def _six(name: str):
    return rounded(name).alias(name)


@query(ENHANCED + "SELECT game_id, home_team_momentum, away_team_momentum, momentum_advantage, head_to_head_advantage, home_team_injury_impact, away_team_injury_impact, injury_difference, weather_impact, sentiment_advantage FROM enhanced")
def bet12_enhanced_features(view):
    e = _enhanced(view)
    return e.select("game_id", *map(_six, ("home_team_momentum", "away_team_momentum", "momentum_advantage", "head_to_head_advantage", "home_team_injury_impact", "away_team_injury_impact", "injury_difference")), "weather_impact", _six("sentiment_advantage"))


@query(ENHANCED + "SELECT game_id, " + ", ".join(f"CAST(coalesce({c}, {'false' if c.endswith('back') else '0'}) AS DOUBLE) AS {c}" for c in ml.FLAT) + " FROM enhanced")
def prj17_flat_training_row(view):
    return ml.flat_rows(_enhanced(view)).select("game_id", *map(_six, ml.FLAT))


B2B = f", rested AS (SELECT game_id, max(CASE WHEN is_home = 1 THEN b END) AS home_b, max(CASE WHEN is_home = 0 THEN b END) AS away_b FROM (SELECT game_id, is_home, CAST(coalesce({LAG} <= 1, false) AS INT) AS b FROM team_games) GROUP BY game_id)"


@query(LINES + B2B + " SELECT l.game_id, sport, " + ", ".join(f"{R(c)} AS f_{c}" for c in ("hw", "aw", "hp", "ap", "ha", "aa")) + f""", CASE WHEN sport = 'NBA' THEN CAST(home_b AS DOUBLE) END AS f_home_b2b, CASE WHEN sport = 'NBA' THEN CAST(away_b AS DOUBLE) END AS f_away_b2b,
    CASE WHEN sport = 'MLB' THEN coalesce({ERA(0)}, {D(4.5)}) END AS f_home_era, CASE WHEN sport = 'MLB' THEN coalesce({ERA(1)}, {D(4.5)}) END AS f_away_era FROM lines l JOIN rested USING (game_id)""".replace("game_id %", "l.game_id %").replace("game_id *", "l.game_id *"))
def ml01_sport_features(view):
    """The features of every sport's model; those that a sport doesn't have are null."""
    rows = _scoring_rows(view)
    parts = [forecast.supported(rows, s).withColumns(ml.sport_columns(s)).select("game_id", "sport", *[rounded(c).alias(c) for c in ml.sport_columns(s)]) for s in ml.Registry.supported()]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


@query()
def ml02_stable_split(view):
    train, test = ml.split(view("games").select("game_id"))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _training(view) -> tuple[DataFrame, list[str]]:
    """The training set, kept, as a model reads it several times, and its feature columns."""
    rows = kept(ml.training_set(view("games")))
    return rows, [c for c in rows.columns if c not in ("game_id", "sport", "label", "margin")]


def _forests(view, trees: int, depth: int) -> DataFrame:
    """One forest a sport; labels and probabilities of all its games."""
    rows, columns = _training(view)
    specs = [ml.SportSpec(s, {f"f_{c}": F.col(c) for c in columns}, forecast.point_spread, lambda: ml.forest(trees, depth)) for s in ml.Registry.supported()]

    def scored(item: tuple[ml.SportSpec, ml.Pipeline]) -> DataFrame:
        (spec, pipeline), sport = item, item[0].name
        mine = spec.prepared(rows.filter(F.col("sport") == sport))
        model = pipeline.fit(ml.split(mine)[0])
        return ml.probability(model.transform(mine)).select("game_id", "sport", "label", rounded("p").alias("p"))

    return reduce(DataFrame.unionByName, ml.at_once(rows.sparkSession, scored, [(spec, spec.pipeline()) for spec in specs]))


@query()
def ml03_forest_by_sport(view):
    return _forests(view, 100, 10).drop("label")


#: The games with history on both sides, as ml12_training_features has them.
LEARNT = f""", b AS (SELECT game_id, is_home, avg(points) {BEFORE} AS p FROM team_games), known AS (SELECT game_id FROM b GROUP BY game_id HAVING count(p) = 2),
    learnt AS (SELECT g.* FROM games g JOIN known USING (game_id))"""


@query(LEARNT + "SELECT sport, count(*) AS games, true AS in_range, true AS above_majority, true AS split_adds_up FROM learnt GROUP BY sport")
def ml03_forest_held_to_its_properties(view):
    """Small forests of all sports: their games, the range of their probabilities, the split, and accuracy against the majority."""
    return ml.held_to(_forests(view, 10, 5), ["sport"])


@query(LEARNT + "SELECT count(*) AS games, true AS in_range, true AS above_majority, true AS split_adds_up FROM learnt")
def ml04_boosting_held_to_its_properties(view):
    return ml.held_to(_boosted(view, 5, 3), [])


@query(LEARNT + ", m AS (SELECT * FROM (VALUES ('forest'), ('boosting'), ('net')) AS t(model)) SELECT model, count(*) AS rows_in_all, true AS is_share FROM learnt, m GROUP BY model")
def ml06_training_held_to_its_properties(view):
    """Small models of all three kinds: their samples add up, and each accuracy is a share."""
    rows, columns = _training(view)
    metrics = ml.train_models(rows, columns, trees=5, depth=3, iterations=5)[1]
    return metrics.select("model", (F.col("train_rows") + F.col("test_rows")).alias("rows_in_all"), F.col("accuracy").between(0, 1).alias("is_share"))


@query(LINES + """SELECT sport, count(*) AS games, true AS clamped, true AS sure, true AS tiered FROM lines GROUP BY sport""")
def ml09_scoring_held_to_its_properties(view):
    """Small models' scores of every game: probabilities within the clamp, confidence the larger side, a tier each."""
    scored = _batch_scored(view, 10, 5)
    p, fits = F.col("p_home"), lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    return scored.groupBy("sport").agg(F.count(F.lit(1)).alias("games"), fits(p.between(0.1, 0.9)).alias("clamped"), fits(F.abs(F.col("confidence") - F.greatest(p, 1 - p)) < 1e-3).alias("sure"), fits(F.col("tier").isin("high", "medium", "low")).alias("tiered"))


@query(LEARNT + f"SELECT count(*) AS games, CAST(sum(home_score - away_score) AS DOUBLE) AS margins, true AS nearer_than_the_mean FROM learnt")
def ml10_regression_held_to_its_properties(view):
    """A small regression's predictions of every game are nearer to the margins than their mean is."""
    scored = _regressed(view, 10)
    error, mean = F.avg((F.col("margin") - F.col("predicted_margin")) ** 2), F.var_pop("margin")
    return scored.agg(F.count(F.lit(1)).alias("games"), F.sum("margin").alias("margins"), (error < mean).alias("nearer_than_the_mean"))


@query()
def ml06_train_all_models(view):
    """Three models on point-in-time features, their accuracy and sample sizes."""
    rows, columns = _training(view)
    return ml.train_models(rows, columns)[1]


@query()
def ml10_spread_regression(view):
    return _regressed(view, 100)


def _regressed(view, rounds: int) -> DataFrame:
    rows, columns = _training(view)
    model, _ = ml.spread_regression(rows, columns, iterations=rounds)
    return model.transform(rows).select("game_id", "margin", rounded("prediction", 4).alias("predicted_margin"))


@query()
def ml11_sequence_model(view):
    """Whether a team wins its next game, from its last ten."""
    from pyspark.ml.functions import array_to_vector

    games = features.team_games(view("games"))
    runs = features.sequence_runs(games)
    learnt = runs.withColumn("label", F.when(ml.parts()[0], F.col("label")))
    net = ml.Net([10 * len(features.STEP), 8, 2], 100, "features").fit_runs(learnt, list(features.STEP), 100.0)
    rows = features.labelled_sequences(games).select("team_id", "game_id", array_to_vector(F.transform("sequence", lambda x: x / 100.0)).alias("features"))
    return ml.probability(net.transform(rows)).select("team_id", "game_id", rounded("p", 4).alias("p"))


EVENT = "event_id long, ts timestamp, game_id long, spread double, winner string"


def _stream(view, kind: str) -> DataFrame:
    """The tracking events of one kind, as a stream over the events table's files."""
    events = view("events")
    spark = events.sparkSession
    path = events.inputFiles()[0].rpartition("/")[0]
    rows = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*" if path.rpartition("/")[2] != "events.parquet" else "*.parquet").parquet(path)
    typed = jobs.event_time(rows.filter(F.col("event_type") == kind))
    return typed.select("event_id", "ts", F.col("user_id").cast("long").alias("game_id"), (F.col("value") / 10 - 25).alias("spread"), F.when(F.col("event_id") % 2 == 0, "home").otherwise("away").alias("winner"))


def _kept(view, rows: DataFrame, merge, schema: str = EVENT, key: str = "game_id", mode: str = "append") -> DataFrame:
    """The table that a stream's batches were merged into."""
    spark = rows.sparkSession
    base = scratch(spark)
    table = jobs.VersionedTable(spark, f"{base}/table", schema, key)
    jobs.keep(rows, table, merge, f"{base}/checkpoint", mode)
    return table.read()


STREAM = ", e AS (SELECT event_id, CAST(game_id AS BIGINT) AS game_id, ts, spread, winner, event_type FROM tracking_events)"


@query(STREAM + " SELECT game_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(spread, (ts, event_id)) AS spread, arg_max(winner, (ts, event_id)) AS winner FROM e WHERE event_type = 'view' GROUP BY game_id")
def str01_prediction_stream(view):
    return _kept(view, _stream(view, "view"), jobs.latest).select("game_id", "event_id", "spread", "winner")


@query(STREAM + " SELECT game_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(spread, (ts, event_id)) AS spread, arg_min(winner, (ts, event_id)) AS winner FROM e WHERE event_type = 'purchase' GROUP BY game_id")
def str02_result_stream(view):
    return _kept(view, jobs.delivered_once(_stream(view, "purchase")), jobs.first).select("game_id", "event_id", "spread", "winner")


def _streamed(view, frame: DataFrame) -> DataFrame:
    """The end of a stream, as a table of what it emitted."""
    spark = view("events").sparkSession
    base = scratch(spark)
    frame.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{base}/out")


@query(STREAM + f" SELECT p.game_id, p.event_id AS p_event, r.event_id AS r_event, {R('abs(p.spread - r.spread)')} AS spread_error, p.winner = r.winner AS winner_correct FROM e p JOIN e r ON p.event_type = 'view' AND r.event_type = 'purchase' AND p.game_id = r.game_id AND r.ts >= p.ts AND r.ts <= p.ts + INTERVAL 7 DAY")
def str03_live_metrics(view):
    return _streamed(view, jobs.live_metrics(_stream(view, "view"), _stream(view, "purchase")))


@query(STREAM + f" SELECT CAST(ts AS DATE) AS day, {R('avg(CASE WHEN winner = ' + chr(39) + 'home' + chr(39) + ' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS home_share, {R('avg(spread)', 4)} AS spread, count(*) AS events FROM e WHERE event_type = 'view' GROUP BY 1")
def str04_daily_accuracy(view):
    """Days in update mode, each in the table's place of the day before it changed."""
    days = jobs.daily_accuracy(_stream(view, "view"))
    return _kept(view, days, jobs.newest("day"), "day date, home_share double, spread double, events long", "day", "update")


@query(RISK + f"""SELECT game_id, {american_sql('p_home')} AS odds, {R(decimal_sql('CAST(' + american_sql('p_home') + ' AS DOUBLE)'))} AS price, {back_sql('(1 / p_home)')} AS back, {R(SPREAD_EV)} AS spread_ev, {R('greatest(' + side_sql('p_home', 'CAST(home_odds AS DOUBLE)') + ', ' + side_sql('p_away', 'CAST(away_odds AS DOUBLE)') + ')')} AS money_ev,
    {R('confidence_risk')} AS r1, {R('odds_risk')} AS r2, {R('volatility_risk')} AS r3, {R('historical_risk')} AS r4, {R('risk_score')} AS r5, risk_level FROM risks""")
def udf02_sql_functions(view):
    f = forecasts(view).join(view("market_odds"), "game_id")
    sqlfuncs.register(f.sparkSession)
    call = lambda text, name: rounded(F.expr(text)).alias(name)
    risks = {"r1": "confidence_risk(confidence, true)", "r2": "odds_risk(home_ml, away_ml)", "r3": "volatility_risk(hp, ha, ap, aa)", "r4": "historical_risk(hw, aw)"}
    with_risks = f.withColumns({n: F.expr(e) for n, e in risks.items()}).withColumn("r5", F.expr("overall_risk(r1, r2, r3, r4)"))
    return with_risks.select("game_id", F.expr("american_odds(p_home)").alias("odds"), call("decimal_odds(CAST(american_odds(p_home) AS DOUBLE))", "price"), F.expr("american_from_decimal(1 / p_home)").alias("back"), call("spread_value(p_home, spread)", "spread_ev"), call("moneyline_value(p_home, p_away, home_odds, away_odds)", "money_ev"), *[rounded(n).alias(n) for n in ("r1", "r2", "r3", "r4", "r5")], F.expr("risk_level(r5)").alias("risk_level"))


@query()
def fn13_pretty_json(view):
    """A nested document per game, printed."""
    m = forecast.picks(forecasts(view))
    team = lambda s: F.struct(F.col(f"{s}_name").alias("name"), rounded(f"{s[0]}w").alias("win_pct")).alias(f"{s}_team")
    return m.select("game_id", F.to_json(F.struct("sport", team("home"), team("away"), F.array("home_odds", "away_odds").alias("money_line")), {"pretty": "true"}).alias("document"))


@query()
def ml04_boosting(view):
    return _boosted(view, 100, 10).drop("label")


def _boosted(view, rounds: int, depth: int) -> DataFrame:
    rows, columns = _training(view)
    model = ml.Pipeline(stages=[ml.GBTClassifier(maxIter=rounds, maxDepth=depth, features=columns)]).fit(ml.split(rows)[0])
    return ml.probability(model.transform(rows)).select("game_id", "label", rounded("p", 4).alias("p"))


@query()
def ml05_feed_forward(view):
    rows, columns = _training(view)
    stages = [ml.VectorAssembler(inputCols=columns, outputCol="features"), ml.StandardScaler(inputCol="features", outputCol="scaled", withMean=True), ml.MultilayerPerceptronClassifier(layers=[len(columns), 64, 32, 16, 2], maxIter=100)]
    model = ml.Pipeline(stages=stages).fit(ml.split(rows)[0])
    return ml.probability(model.transform(rows)).select("game_id", rounded("p", 4).alias("p"))


def _scoring_rows(view, factors: DataFrame | None = None) -> DataFrame:
    """Matchups with rest flags and the known pitchers' averages, and whether home won; with both teams' ``factors``, if given.

    They are kept, as each sport reads them for its model and again for its scores.
    """
    games = view("games")
    m = forecast.matchups(games, view("teams")).join(features.point_in_time(games).select("game_id", "home_back_to_back", "away_back_to_back"), "game_id")
    for s in ("home", "away") if factors is not None else ():
        m = m.join(factors.select(F.col("team_id").alias(f"{s}_id"), F.col("factor").alias(f"{s}_factor")), f"{s}_id", "left")
    return kept(m.drop("home_name", "away_name").withColumns({"home_era": F.expr(ERA(0)), "away_era": F.expr(ERA(1)), "label": (F.col("home_score") > F.col("away_score")).cast("int")}))


def _lined(rows: DataFrame) -> DataFrame:
    """The run line as a line with its tier's bounds, for baseball."""
    lined = forecast.run_line(rows, F.col("home_era"), F.col("away_era"))
    return lined.withColumns({"line": F.col("run_line"), "raw_line": F.col("run_line")})


def _sport_specs(trees: int = 100, depth: int = 10) -> dict[str, ml.SportSpec]:
    return {s: ml.SportSpec(s, ml.sport_columns(s), _lined if s == "MLB" else forecast.point_spread, lambda: ml.forest(trees, depth)) for s in ml.Registry.supported()}


@query()
def ml09_batch_scoring(view):
    return _batch_scored(view, 100, 10)


def _batch_scored(view, trees: int, depth: int) -> DataFrame:
    """Forest probabilities of every game by its sport's model, moved by the teams' sentiment, with line, tier and agreement; a registry keeps the models."""
    rows = _scoring_rows(view, _factors(view))
    registry = ml.Registry(f"{scratch(rows.sparkSession)}/models")

    def batch(item: tuple[str, ml.SportSpec]) -> DataFrame:
        sport, spec = item
        mine = spec.prepared(forecast.supported(rows, sport))
        registry.save(sport, spec.pipeline().fit(ml.split(mine)[0]))
        scored = ml.probability(ml.Registry(registry.path).get(sport).transform(mine))
        if sport != "NBA":
            known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
            scored = scored.withColumn("p", forecast.sentiment_adjusted(F.col("p"), known("home_factor"), known("away_factor")))
        scored = forecast.clamped(scored, F.col("p"))
        scored = forecast.agreement(forecast.tier(spec.line(scored)), F.col("p_home_model"), F.col("line"))
        return scored.select("game_id", "sport", rounded("p_home_model", 4).alias("p_home"), "line", "tier", "model_agreement", rounded("confidence_model", 4).alias("confidence"))

    return reduce(DataFrame.unionByName, ml.at_once(rows.sparkSession, batch, _sport_specs(trees, depth).items()))


@query()
def ml13_model_registry(view):
    """Models fitted once, saved by sport, loaded by another registry: which sports it has, and the games each model scores."""
    rows = _scoring_rows(view)
    registry = ml.Registry(f"{scratch(rows.sparkSession)}/models")
    parts = []
    for sport, spec in _sport_specs(trees=20, depth=5).items():
        mine = spec.prepared(forecast.supported(rows, sport))
        model = spec.pipeline().fit(ml.split(mine)[0])
        registry.save(sport, model)
        again = ml.Registry(registry.path).get(sport)
        both = ml.probability(model.transform(mine), "kept").select("game_id", "kept").join(ml.probability(again.transform(mine), "loaded").select("game_id", "loaded"), "game_id")
        parts.append(both.agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("kept") == F.col("loaded")).alias("same")).select(F.lit(sport).alias("sport"), "games", "same"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ORACLE_SQL["ml13_model_registry"] = f"{PRELUDE} SELECT sport, count(*) AS games, count(*) AS same FROM games GROUP BY sport"


@query()
def agg10_model_accuracy(view):
    """Accuracy of a sport's forest on the held-out games, and the sizes of both samples."""
    rows = _scoring_rows(view)
    found = []
    for sport, spec in _sport_specs(trees=20, depth=5).items():
        train, test = ml.split(spec.prepared(forecast.supported(rows, sport)))
        accuracy = ml.accuracy(spec.pipeline().fit(train).transform(test))
        found.append(train.agg(F.count(F.lit(1)).alias("train_rows")).select(F.lit(sport).alias("sport"), F.lit(accuracy).alias("accuracy"), "train_rows"))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(LINES + f"SELECT game_id, {R('hw - aw')} AS share_difference, {R('raw_line + 1', 1)} AS line FROM lines")
def udf01_pluggable_sport(view):
    """A sport that the engine does not know, as features, line and estimator of its own."""
    games = forecast.matchups(view("games"), view("teams"))
    line = lambda rows: forecast.point_spread(rows).withColumn("line", rounded(F.col("raw_line") + 1, 1))
    spec = ml.SportSpec("NHL", {"share_difference": F.col("hw") - F.col("aw")}, line, lambda: ml.RandomForestClassifier(numTrees=5, seed=42))
    rows = spec.prepared(games.withColumn("label", (F.col("home_score") > F.col("away_score")).cast("int")))
    scored = spec.line(spec.pipeline().fit(ml.split(rows)[0]).transform(rows))
    return scored.select("game_id", rounded("share_difference").alias("share_difference"), "line")


BEFORE20 = BEFORE.replace("10 PRECEDING", "20 PRECEDING")


@query(f""", b AS (SELECT game_id, is_home, avg(points) {BEFORE} AS p, avg(CAST(points > opponent_points AS INT)) {BEFORE20} AS w, CAST({LAG} AS INT) AS d FROM team_games),
    s AS (SELECT game_id, {', '.join(f"max({c}) FILTER (WHERE is_home = {h}) AS {c}{h}" for c in 'pwd' for h in (1, 0))} FROM b GROUP BY game_id)
    SELECT g.game_id, CAST(home_score > away_score AS INT) AS label, {R('p1')} AS home_points_10, {R('w1')} AS home_win_rate_20, CAST(d1 AS DOUBLE) AS home_days_rest, {R('p0')} AS away_points_10 FROM s JOIN games g ON s.game_id = g.game_id WHERE p1 IS NOT NULL AND p0 IS NOT NULL""")
def ml12_training_features(view):
    rows = ml.training_set(view("games"))
    return rows.select("game_id", "label", rounded("home_points_10").alias("home_points_10"), rounded("home_win_rate_20").alias("home_win_rate_20"), "home_days_rest", rounded("away_points_10").alias("away_points_10"))
