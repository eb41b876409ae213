"""Every registered core query against its SQL on the smallest tables, and plan checks."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
import pyarrow.parquet as pq  # noqa: E402

from courtside.plans.fixtures import TABLES, open_views  # noqa: E402
from courtside.plans.queries import ORACLE_SQL, QUERIES, forecasts  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.register(t, pq.read_table(f"{SF}/{t}.parquet"))
    return con


def rows(table, columns):
    return sorted(map(repr, zip(*[table[c].to_pylist() for c in columns])))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    mine = QUERIES[name](spark, SF).toArrow()
    theirs = duck.sql(ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(theirs.column_names)
    assert columns == sorted(mine.column_names)
    assert rows(mine, columns) == rows(theirs, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"ml03_forest_by_sport", "ml04_boosting", "ml06_train_all_models", "ml09_batch_scoring", "ml10_spread_regression"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_forecast_plan_stays_in_the_jvm(spark):
    p = plan(forecasts(open_views(spark, SF)))
    assert "Python" not in p and "Pandas" not in p and "SortMergeJoin" not in p


def test_pair_join_is_a_hash_or_merge_join(spark):
    from courtside.operators import features

    g = open_views(spark, SF)("games")
    p = plan(features.head_to_head(g.filter("game_id % 5 = 0"), g))
    assert "Or (" not in p.partition("Join")[2].split("\n")[0]


def test_parlay_plan_has_no_long_conditions(spark):
    from courtside.operators import bets
    from courtside.plans.queries import assessed

    p = plan(bets.parlays(bets.single_bets(assessed(open_views(spark, SF)))))
    assert max((len(line) for line in p.split("\n") if "PushedFilters" in line or "Filter" in line), default=0) < 4000


def test_only_lexicon_tokens_are_shuffled(spark):
    from courtside.operators import text

    view = open_views(spark, SF)
    lines = plan(text.article_sentiment(view("articles"), view("lexicon"))).split("\n")
    tokens = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    lexicon = max(i for i in range(tokens) if "BroadcastHashJoin" in lines[i])
    assert not any("Exchange hashpartitioning" in line for line in lines[lexicon:tokens])
    assert sum("FileScan" in line and "text" in line for line in lines) == 1


def test_places_of_bets_are_those_of_one_sort(spark):
    from courtside.operators import bets

    rows = spark.range(500).selectExpr("id AS game_id", "CAST(id * 7 % 5 AS DOUBLE) AS value_score", "id * 3 % 4 AS confidence_pct")
    placed = bets.placed_bets(rows).collect()
    want = sorted(placed, key=lambda r: (-r["value_score"], -r["confidence_pct"], r["game_id"]))
    assert [r["place"] for r in want] == list(range(1, 501))


def test_rolling_features_share_one_sort(spark):
    from courtside.operators import features

    p = plan(features.rolling_form(features.team_games(open_views(spark, SF)("games"))))
    assert p.count("hashpartitioning(team_id") == 1


def test_articles_are_split_below_the_explode(spark):
    """Lines of a plan read from the top, so what is below a Generate follows it; texts must not be split above one."""
    from courtside.operators import text

    view = open_views(spark, SF)
    p = text.sentence_scores(view("articles"), view("lexicon"))._jdf.queryExecution().optimizedPlan().toString()
    lines = p.split("\n")
    last = max(i for i, line in enumerate(lines) if "Generate " in line)
    assert not any("split(" in line and "content" in line for line in lines[:last]) and "size(sentences" in "".join(lines[last:])
    first = next(i for i, line in enumerate(lines) if "Generate " in line)
    assert "content" not in "".join(lines[:first])


def test_slices_of_a_large_team_change_nothing(spark):
    """A team with a third of all games, in slices and in one window."""
    from courtside.operators import features

    games = spark.range(900).selectExpr(
        "id AS game_id", "'NBA' AS sport", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id * 7919 % 400 AS int)) AS game_ts",
        "CASE WHEN id % 3 > 0 THEN 1 ELSE id % 40 END AS home_id", "40 + id % 7 AS away_id", "80 + id * 31 % 50 AS home_score", "80 + id * 17 % 50 AS away_score")
    rows = features.team_games(games)
    for make in (features.rolling_form, lambda r, **k: features.rolling_form(r, False, **k), features.sequences):
        plain, sliced = make(rows), make(rows, slice_games=40)
        assert plain.count() > 0 and sorted(map(repr, plain.collect())) == sorted(map(repr, sliced.select(plain.columns).collect()))
    p = plan(features.rolling_form(rows, slice_games=40))
    assert "slice" in p.partition("Window")[2]


def test_places_need_no_window_over_bets(spark):
    from courtside.operators import bets

    rows = spark.range(100).selectExpr("id AS game_id", "1.0D AS value_score", "80 AS confidence_pct")
    placed = bets.placed_bets(rows)
    assert sorted((r["place"], r["game_id"]) for r in placed.collect()) == [(i + 1, i) for i in range(100)]
    windows = [line for line in plan(placed).split("\n") if "Window " in line]
    assert windows and all("_held" in line for line in windows)  # of the partitions' offsets


def test_broken_documents_are_kept_apart(spark, tmp_path):
    from courtside.sources import feeds

    good = ['{"id": 1, "team": {"name": "a"}}', '{"id": 2, "team": {"name": null}}', '{"team": {"name": "c"}}', '{"id": 4, "team": {"name": "d"}, "more": [1]}']
    bad = ['{"id": 5, "team": {"na', "no json", '{"id": "x", "team": {"name": "e"}}', "[1, 2"]
    spark.createDataFrame([(x,) for x in [*good, *bad, "", "  "]], "value string").repartition(3).write.text(str(tmp_path / "in"))
    rows, rejects = feeds.read_checked(spark, str(tmp_path / "in"), "id bigint, team struct<name:string>", ("id", "team.name"))
    assert sorted(r["id"] for r in rows.collect()) == [1, 4]
    assert sorted((r["reason"], r["value"]) for r in rejects.collect()) == sorted([("team.name missing", good[1]), ("id missing", good[2]), *[("corrupt", b) for b in bad]])
