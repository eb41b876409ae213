"""Values computed by hand from the rules."""

import datetime as dt
from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F

from courtside.functions import formats, odds
from courtside.functions.rounding import rounded, whole
from courtside.operators import bets, features, forecast, ml, risk, text, tracking
from courtside.sources import feeds

GAMES = [  # home (win, for, against), away, exp home, exp away, spread, p_home, total, confidence, odds, integer scores, risk, bet confidence, spread EV, money EV
    ((0.780, 120.8, 109.5), (0.685, 119.2, 114.8), 120.80, 114.35, 6.45, 0.8700, 235.15, 0.7475, -669, 669, 121, 114, 0.479875, 52, 0.045227, 0.000045),
    ((0.710, 116.9, 110.8), (0.520, 116.8, 116.5), 119.7, 113.8, 5.9, 0.8900, 233.5, 0.7950, -809, 809, 120, 114, 0.388500, 61, 0.135909, 0.000012),
    ((0.540, 111.8, 110.5), (0.625, 115.5, 111.2), 114.5, 113.0, 1.5, 0.5325, 227.5, 0.7425, -114, 114, 114, 113, 0.420250, 58, -0.126591, 0.000450),
    ((0.220, 110.2, 121.5), (0.780, 120.8, 109.5), 112.85, 121.15, -8.3, 0.0500, 234.0, 0.9000, 1900, -1900, 113, 121, 0.384250, 62, -1.696818, 0.000000),
    ((0.5, 110.0, 110.0), (0.5, 110.0, 110.0), 113.0, 110.0, 3.0, 0.65, 223.0, 0.70, -186, 186, 113, 110, 0.415, 58, -0.045455, 0.001),
]


@pytest.fixture(scope="module")
def assessed(spark):
    rows = [(i, f"H{i}", f"A{i}", *h, *a) for i, (h, a, *_) in enumerate(GAMES)]
    games = spark.createDataFrame(rows, "game_id int, home_name string, away_name string, hw double, hp double, ha double, aw double, ap double, aa double")
    return risk.assess(forecast.closed_form(games))


def test_forecast_and_risk(assessed):
    priced = assessed.withColumns({"sev": odds.spread_value(F.col("p_home"), F.col("spread")), "mev": odds.moneyline_value(F.col("p_home"), F.col("p_away"), F.col("home_odds"), F.col("away_odds")), "pct": whole((1 - F.col("risk_score")) * 100.0)})
    for r in priced.collect():
        _, _, eh, ea, spread, p, total, conf, ho, ao, hs, as_, score, pct, sev, mev = GAMES[r["game_id"]]
        assert (r["exp_home"], r["exp_away"], r["spread"], r["p_home"], r["total_points"], r["confidence"]) == pytest.approx((eh, ea, spread, p, total, conf), abs=1e-9)
        assert (r["home_odds"], r["away_odds"], r["home_score_int"], r["away_score_int"], r["pct"]) == (ho, ao, hs, as_, pct)
        assert (r["risk_score"], r["sev"], r["mev"]) == pytest.approx((score, sev, mev), abs=2e-6)
        assert r["p_home"] + r["p_away"] == pytest.approx(1)


def test_single_bets_and_reasons(assessed):
    found = {r["game_id"]: r for r in bets.single_bets(assessed).collect()}
    assert found[0]["bet_type"] == "Spread" and found[0]["odds"] == -110
    assert found[3]["bet_type"] == "Moneyline" and "A3 shows stronger offensive performance" in found[3]["reasoning"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "decimal", "american"), [(-110, -110, 3.644628, 264), (150, -200, 3.75, 275), (-400, -500, 1.5, -200), (200, 300, 12.0, 1100)])
def test_parlay_odds(spark, a, b, decimal, american):
    legs = spark.createDataFrame([(1, 1, a), (1, 2, b)], "slip_id int, leg_no int, odds int")
    r = bets.slip_odds(legs).first()
    assert r["decimal_odds"] == pytest.approx(decimal, abs=1e-6) and r["american_odds"] == american


@pytest.mark.parametrize(("ml_", "p"), [(-110, 0.523810), (150, 0.4), (0, 0.0), (-669, 0.869961)])
def test_implied_probability(spark, ml_, p):
    assert one(spark, rounded(odds.implied_probability(F.lit(ml_)))) == pytest.approx(p)


def test_unreadable_odds(spark):
    assert one(spark, odds.decimal_odds(F.lit("evens"))) is None
    assert one(spark, odds.american_from_decimal(F.lit(None).cast("double"))) == -110
    assert one(spark, odds.american_odds(F.lit(1.0))) is None


def test_momentum(spark):
    def games(*rows):
        data = [(i, "NBA", f"2025-01-0{i + 1}", 1, 9, h, a) for i, (h, a) in enumerate(rows)]
        return spark.createDataFrame(data, "game_id int, sport string, game_ts string, home_id int, away_id int, home_score int, away_score int").withColumn("game_ts", F.to_timestamp("game_ts"))

    value = lambda g: features.momentum(features.team_games(g)).filter("team_id = 1").first()["momentum"]
    assert value(games((115, 108))) == pytest.approx(0.530435, abs=1e-6)
    assert value(games((115, 108), (104, 121), (100, 100))) == pytest.approx(-0.371398, abs=1e-6)
    assert value(games((0, 0))) == pytest.approx(-0.5)


def test_ensemble(spark):
    p = lambda *v: [F.lit(x) for x in v]
    assert one(spark, ml.ensemble(*p(0.7, 0.8, 0.6))) == pytest.approx(0.72)
    assert one(spark, ml.ensemble_confidence(*p(0.7, 0.8, 0.6))) == pytest.approx(0.334680, abs=1e-6)
    assert one(spark, ml.ensemble_confidence(*p(0.9, 0.1, 0.5))) == pytest.approx(0.0, abs=1e-12)


def test_normalised_sentiment(spark):
    assert one(spark, text.normalised(F.lit(2.0))) == pytest.approx(0.458831, abs=1e-6)


def test_parlay_legs(spark):
    s = spark.createDataFrame([(1, 0, "Games: Cleveland and Boston", "parlay")], "report_id int, place int, part string, kind string")
    assert text.parlay_legs(s).first()["legs"] == "Cleveland|Boston"
    assert text.parlay_legs(s, compat=True).first()["legs"] == "Clevel||Boston"


@pytest.mark.parametrize(("utc", "day", "time"), [("2025-03-15T23:30Z", "2025-03-15", "7:30 PM"), ("2025-11-02T06:05Z", "2025-11-02", "1:05 AM"), ("bad", None, None)])
def test_eastern(spark, utc, day, time):
    d, t = formats.eastern(F.lit(utc))
    assert (one(spark, d), one(spark, t)) == (day, time)


def test_histogram_gaps(spark):
    m = spark.createDataFrame([(x,) for x in (5.0, 5.5, 6.0, 10.5, 15.0, 15.1)], "spread_error double")
    assert {r["bucket"]: r["games"] for r in tracking.error_histogram(m).collect()} == {"0-5": 1, "6-10": 1, "11-15": 1, "16+": 1, "unbucketed": 2}


def test_dated_schedule(spark):
    rows = feeds.dated_schedule(spark.range(12), "id", "2025-03-15", days=2).orderBy("id").collect()
    assert [(r["game_date"].day, r["game_time"]) for r in rows] == [(15, "19:05"), (15, "13:05"), (15, "19:05"), (16, "13:05"), (16, "19:05"), (16, "13:05")]


def test_unsupported_sport(spark):
    with pytest.raises(ValueError):
        forecast.supported(spark.createDataFrame([("NBA",)], "sport string"), "chess")


def test_upsert_is_idempotent(spark):
    p = spark.createDataFrame([(1, 10, 1, 2, 1, 2.0, 0.6), (2, 10, 3, 4, 4, -1.0, 0.7)], "game_id int, ts int, home_id int, away_id int, predicted_winner int, predicted_spread double, win_probability double")
    n = spark.createDataFrame([(2, 11, 4, 3, 3, 5.0, 0.8), (3, 11, 5, 6, 5, 1.0, 0.5)], p.schema)
    once = tracking.upsert_predictions(p, n).select(*p.columns)
    twice = tracking.upsert_predictions(once, n).select(*p.columns)
    assert sorted(once.collect()) == sorted(twice.collect())
    row = {r["game_id"]: r for r in once.collect()}[2]
    assert (row["home_id"], row["away_id"], row["predicted_winner"], row["predicted_spread"]) == (3, 4, 3, 5.0)


def test_sequences_have_eight_features(spark):
    rows = [(g, "NBA", dt.datetime(2024, 1, 1) + dt.timedelta(days=2 * g), 1, 2, 100 + g, 90) for g in range(12)]
    games = spark.createDataFrame(rows, "game_id long, sport string, game_ts timestamp, home_id long, away_id long, home_score int, away_score int")
    found = {(r["team_id"], r["game_id"]): r["sequence"] for r in features.sequences(features.team_games(games)).collect()}
    assert sorted(found) == [(t, g) for t in (1, 2) for g in (9, 10, 11)] and all(len(s) == 80 for s in found.values())
    assert found[1, 9][:8] == [100, 90, 1, 100, 90, 1, 0, 0] and found[2, 11][-8:] == [90, 111, 0, 90, 106.5, 0, 2, 0]


class Made(Exception):
    pass


@pytest.mark.parametrize("query, model, sizes", [
    ("ml03_forest_by_sport", "RandomForestClassifier", {"numTrees": 100, "maxDepth": 10}),
    ("ml04_boosting", "GBTClassifier", {"maxIter": 100, "maxDepth": 10}),
    ("ml05_feed_forward", "MultilayerPerceptronClassifier", {"maxIter": 100}),
    ("ml06_train_all_models", "RandomForestClassifier", {"numTrees": 100, "maxDepth": 10}),
    ("ml10_spread_regression", "GBTRegressor", {"maxIter": 100}),
])
def test_registered_models_have_the_surveyed_sizes(spark, monkeypatch, query, model, sizes):
    from courtside.plans import queries

    def made(**given):
        raise Made(given)

    monkeypatch.setattr(queries, "_training", lambda view: (MagicMock(), ["a"]))
    monkeypatch.setattr(ml, model, made)
    with pytest.raises(Made) as e:
        getattr(queries, query)(None)
    assert e.value.args[0].items() >= sizes.items()
