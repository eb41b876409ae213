"""Views over the driver's tables that stand for the engine's entities; the SQL runs unchanged on Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "teams": """SELECT s_suppkey AS team_id, s_name AS team_name, concat('S', CAST(s_suppkey AS STRING)) AS short_name,
        CAST(2 AS DOUBLE)/100 + CAST(s_suppkey*37 % 97 AS DOUBLE)/100 AS win_pct,
        CAST(105 AS DOUBLE) + CAST(s_suppkey*53 % 180 AS DOUBLE)/10 AS points_avg,
        CAST(105 AS DOUBLE) + CAST(s_suppkey*71 % 180 AS DOUBLE)/10 AS points_against_avg
        FROM supplier WHERE s_suppkey % 7 <> 6""",
    "games": """SELECT o_orderkey AS game_id, CASE o_orderkey % 3 WHEN 0 THEN 'NBA' WHEN 1 THEN 'MLB' ELSE 'NFL' END AS sport,
        o_orderdate AS game_ts, o_custkey % n AS home_id, (o_custkey % n + 1 + o_orderkey % (n-1)) % n AS away_id,
        85 + (o_orderkey*7919 + o_custkey*31) % 51 AS home_score, 85 + (o_orderkey*104729 + o_custkey*17) % 51 AS away_score
        FROM (SELECT *, (SELECT count(*) FROM supplier) AS n FROM orders) o""",
    "team_games": """SELECT game_id, game_ts, home_id AS team_id, away_id AS opponent_id, 1 AS is_home, home_score AS points, away_score AS opponent_points FROM games
        UNION ALL SELECT game_id, game_ts, away_id, home_id, 0, away_score, home_score FROM games""",
    "predictions": """SELECT game_id, game_ts AS ts, home_id, away_id,
        CASE WHEN (game_id*13) % 100 < 55 THEN home_id ELSE away_id END AS predicted_winner,
        CAST((game_id*29) % 241 - 120 AS DOUBLE)/10 AS predicted_spread, CAST(50 + (game_id*17) % 46 AS DOUBLE)/100 AS win_probability
        FROM games WHERE game_id % 10 <> 0""",
    "results": """SELECT game_id, game_ts AS ts, home_score, away_score,
        CASE WHEN home_score>away_score THEN home_id WHEN home_score<away_score THEN away_id END AS actual_winner,
        CAST(home_score-away_score AS DOUBLE) AS final_spread FROM games WHERE game_id % 7 <> 0""",
    "metrics": """SELECT p.game_id, abs(p.predicted_spread-r.final_spread) AS spread_error, p.predicted_winner = r.actual_winner AS winner_correct, p.ts
        FROM predictions p JOIN results r ON p.game_id=r.game_id""",
    "market_odds": """SELECT game_id, CASE WHEN game_id % 11 = 0 THEN NULL WHEN game_id % 2 = 0 THEN 100 + (game_id*7) % 250 ELSE -105 - (game_id*7) % 250 END AS home_ml,
        CASE WHEN game_id % 11 = 0 THEN NULL WHEN game_id % 2 = 0 THEN -110 - (game_id*7) % 250 ELSE 100 + (game_id*7) % 245 END AS away_ml FROM games""",
    "slip_legs": """SELECT l_orderkey AS slip_id, l_linenumber AS leg_no, CASE l_returnflag WHEN 'A' THEN 'spread' WHEN 'N' THEN 'moneyline' ELSE 'parlay' END AS bet_type,
        l_quantity AS amount, (l_orderkey + l_partkey) % m AS game_id, CASE WHEN l_suppkey % 2 = 0 THEN 'home' ELSE 'away' END AS side,
        CASE WHEN l_partkey % 2 = 0 THEN 100 + l_partkey % 250 ELSE -105 - l_partkey % 200 END AS odds,
        CASE WHEN l_returnflag = 'A' THEN CAST(l_partkey % 21 - 10 AS DOUBLE)/2 END AS line
        FROM (SELECT *, (SELECT count(*) FROM orders) AS m FROM lineitem) l""",
    "injuries": "SELECT s_suppkey AS team_id, CAST(s_suppkey*17 % 21 - 10 AS DOUBLE)/100 AS impact FROM supplier WHERE s_suppkey % 5 <> 0",
    "weather": "SELECT game_id, CAST(0 AS DOUBLE) - CAST(game_id*13 % 10 AS DOUBLE)/100 AS impact FROM games WHERE sport = 'NFL' AND game_id % 4 < 3",
    "articles": """SELECT doc_id AS article_id, doc_id % n AS team_id, CAST(doc_id % 30 AS INT) AS day_offset, split_part(text, chr(10), 1) AS title,
        concat(text, ' ', CASE doc_id % 6 WHEN 0 THEN 'The star player is out with an injury.' WHEN 1 THEN 'A new strategy, and the team is confident.' WHEN 2 THEN 'The coach is worried and the team is struggling.'
        WHEN 3 THEN 'Form is improving.' WHEN 4 THEN 'Results got worse but morale is positive.' ELSE '' END) AS content, source
        FROM (SELECT *, (SELECT count(*) FROM supplier) AS n FROM documents) d""",
    "lexicon": """SELECT * FROM (VALUES ('injury',CAST(-2.0 AS DOUBLE)),('confident',CAST(2.2 AS DOUBLE)),('worried',CAST(-1.2 AS DOUBLE)),('struggling',CAST(-1.5 AS DOUBLE)),('improving',CAST(1.8 AS DOUBLE)),('worse',CAST(-2.1 AS DOUBLE)),('positive',CAST(2.6 AS DOUBLE)),('the',CAST(0.1 AS DOUBLE)),('of',CAST(-0.1 AS DOUBLE))) AS t(token,valence)""",
    "reports": """SELECT conv_id*1000+turn AS report_id, concat('SINGLE BET RECOMMENDATIONS:', chr(10), 'Game: T', CAST(conv_id AS STRING), ' vs T', CAST(turn AS STRING), chr(10),
        'Confidence: ', CASE WHEN turn % 3 = 0 THEN '70-95%' ELSE concat(CAST(70+turn AS STRING),'%') END, chr(10), 'Value Rating: ', CAST(7 + turn % 3 AS STRING), chr(10), chr(10),
        'PARLAY OPPORTUNITIES:', chr(10), 'Games: Cleveland and Boston', chr(10), chr(10), 'KEY INSIGHTS:', chr(10), '- ', replace(text,chr(10),' '), chr(10), chr(10), 'BETTING STRATEGY:', chr(10), 'Risk: low') AS body
        FROM conversations""",
    "tracking_events": """SELECT event_id, ts, user_id AS game_id, event_type, value/10 - 25 AS spread, CASE WHEN event_id % 2 = 0 THEN 'home' ELSE 'away' END AS winner
        FROM events WHERE event_type IN ('view','purchase')""",
}

#: The views as a WITH list for one SQL statement.
PRELUDE = "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in VIEWS.items())


def _needs(sql: str) -> set[str]:
    """The tables and views whose names a statement holds."""
    return {w for w in re.findall(r"\w+", sql) if w in VIEWS or w in TABLES}


def open_views(spark: SparkSession, sf_dir: str):
    """view(name) -> DataFrame of a view or a table of ``sf_dir``; only the tables and views that it needs are opened."""
    opened: set[str] = set()

    def table(name: str) -> None:
        if name not in opened:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
            opened.add(name)

    def view(name: str) -> DataFrame:
        if name in TABLES:
            table(name)
            return spark.table(name)
        found, waiting = set(), {name}
        while waiting:
            found |= waiting
            waiting = {n for w in waiting if w in VIEWS for n in _needs(VIEWS[w])} - found
        for needed in sorted(found & set(TABLES)):
            table(needed)
        parts = ",\n".join(f"{v} AS ({sql})" for v, sql in VIEWS.items() if v in found)
        return spark.sql(f"WITH {parts} SELECT * FROM {name}")

    return view
