"""What the model queries read: kept rows, dealt to all cores, and sequences that no join shuffles."""

import os
import threading

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from courtside.operators import boosting, features, ml
from courtside.plans import queries
from courtside.plans.fixtures import open_views
from courtside.sources import storage
from courtside.sources.storage import kept

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def reads_files_only(df) -> bool:
    return "FileScan parquet" in plan(df) and not any(x in plan(df) for x in ("Exchange", "Window", "Join", "Aggregate"))


@tables
def test_training_rows_are_kept(spark):
    view = open_views(spark, SF)
    rows, columns = queries._training(view)
    assert reads_files_only(rows) and set(columns) < set(rows.columns)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, ml.training_set(view("games")).collect()))


@tables
@pytest.mark.parametrize("sentiment", [False, True])
def test_scoring_rows_are_kept(spark, sentiment):
    view = open_views(spark, SF)
    rows = queries._scoring_rows(view, queries._factors(view) if sentiment else None)
    assert reads_files_only(rows) and rows.count() == view("games").count()
    if sentiment:
        factors = {r["team_id"]: r["factor"] for r in queries._factors(view).collect()}
        assert any(factors.values())
        assert all((r["home_factor"], r["away_factor"]) == (factors.get(r["home_id"]), factors.get(r["away_id"])) for r in rows.collect())


def test_kept_rows_are_dealt_to_all_cores(spark):
    """One partition before; a file a core after, and the same rows."""
    rows = spark.range(4000).selectExpr("id AS game_id", "id * 7 AS x").coalesce(1)
    files = kept(rows)
    held = [r["n"] for r in files.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(held) == spark.sparkContext.defaultParallelism and max(held) < 2 * min(held)
    assert sorted(files.collect()) == sorted(rows.collect())


def some_games(spark):
    return spark.range(900).selectExpr(
        "id AS game_id", "'NBA' AS sport", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id * 7919 % 400 AS int)) AS game_ts",
        "CASE WHEN id % 3 > 0 THEN 1 ELSE id % 40 END AS home_id", "40 + id % 7 AS away_id", "CASE WHEN id % 50 <> 3 THEN 80 + id * 31 % 50 END AS home_score", "80 + id * 17 % 50 AS away_score")


def test_labelled_sequences_are_those_that_a_join_finds(spark):
    rows = features.team_games(some_games(spark))
    following = F.lead((F.col("points") > F.col("opponent_points")).cast("int")).over(Window.partitionBy("team_id").orderBy("game_ts", "game_id"))
    labels = rows.withColumn("label", following).select("team_id", "game_id", "label")
    want = features.sequences(rows).join(labels, ["team_id", "game_id"]).filter("label is not null").select("team_id", "game_id", "label", "sequence")
    for found in (features.labelled_sequences(rows), features.labelled_sequences(rows, slice_games=40)):
        assert want.count() > 0 and sorted(map(repr, found.select(want.columns).collect())) == sorted(map(repr, want.collect()))


@tables
def test_sequence_model_shuffles_no_sequence(spark):
    p = plan(queries.QUERIES["ml11_sequence_model"](spark, SF))
    assert "Join" not in p.partition("Window")[0] and p.count("hashpartitioning(team_id") == 1


def test_forests_count_few_trees_a_pass(spark):
    """Spark's default of 256 MB counts all trees of a level at once, in far more memory than a core's cache holds."""
    forests = [ml.forest(100, 10), ml.SportSpec("NHL", {}, None).estimator(), *(spec.estimator() for spec in queries._sport_specs().values())]
    assert all(f.getMaxMemoryInMB() <= 8 and (f.getNumTrees(), f.getMaxDepth(), f.getSeed()) == (100, 10, 42) for f in forests)
    rows = ml.VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(spark.range(2000).selectExpr("id % 97 AS x", "id * 31 % 89 AS y", "cast((id % 97 > 40) = (id * 31 % 89 > 30) AS int) AS label"))
    model = ml.forest(30, 6).fit(rows)
    assert model.getNumTrees == 30 and ml.accuracy(model.transform(rows)) > 0.9


def test_lineage_is_cut_without_a_folder_from_the_session(spark, monkeypatch):
    """Without a checkpoint folder the plan of boosting grew by a step every round."""
    made = []

    class Context:
        master = "local[4]"
        getCheckpointDir = staticmethod(lambda: made[-1] if made else None)
        setCheckpointDir = staticmethod(made.append)

    class Session:
        sparkContext = Context()
        conf = spark.conf

    storage.cut_lineage(Session())
    storage.cut_lineage(Session())
    assert len(made) == 1 and made[0].startswith("/")


def test_three_models_train_at_once(spark, monkeypatch):
    """Each fit waits for the two others; one after another, the first would wait in vain."""
    met = threading.Barrier(3, timeout=30)

    class Model:
        def transform(self, rows):
            return rows.withColumn("prediction", F.col("label").cast("double"))

    class Together:
        def __init__(self, stages):
            pass

        def fit(self, rows):
            met.wait()
            return Model()

    monkeypatch.setattr(ml, "Pipeline", Together)
    rows = spark.range(500).selectExpr("id AS game_id", "cast(id % 2 AS double) AS label", "cast(id AS double) AS x")
    models, metrics = ml.train_models(rows, ["x"])
    found = {r["model"]: r for r in metrics.collect()}
    assert list(models) == ["forest", "boosting", "net"] == list(found)
    assert all(r["accuracy"] == 1.0 and r["train_rows"] + r["test_rows"] == 500 and r["test_rows"] > 50 for r in found.values())


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_scored_rows_are_held_to_their_properties_in_one_pass(spark):
    """Three jobs before, each over all scored rows; none now, until the one row is read."""
    scored = spark.range(300).selectExpr("id AS game_id", "id % 3 AS kind", "cast(id % 5 < 2 AS int) AS label", "CASE WHEN id % 5 < 2 THEN 0.9 ELSE 0.2 END AS p")
    found, jobs = jobs_of(spark, "held", lambda: ml.held_to(scored, ["kind"]))
    assert jobs == 0 and sorted(map(tuple, found.collect())) == [(k, 100, True, True, True) for k in range(3)]
    wrong = ml.held_to(scored.withColumn("p", F.expr("CASE WHEN game_id = 7 THEN 1.5 WHEN game_id = 8 THEN null ELSE 0.1 + 0.8 * (1 - label) END")), [])
    assert tuple(wrong.first()) == (300, False, False, True)


def test_regression_errors_wait_until_they_are_read(spark):
    """Two passes over the test rows before, for errors that the query leaves unread; one when they are read now."""
    rows = spark.range(400).selectExpr("id AS game_id", "cast(id % 20 AS double) AS x", "cast(id % 20 * 3 + id % 2 AS double) AS margin")
    model, errors = ml.spread_regression(rows, ["x"], iterations=3)
    scored = model.transform(ml.split(rows)[1]).select("prediction", "margin").collect()
    wrong = [r["prediction"] - r["margin"] for r in scored]
    assert tuple(errors.first()) == pytest.approx((sum(map(abs, wrong)) / len(wrong), sum(x * x for x in wrong) / len(wrong)))


@pytest.mark.parametrize("slice_games,block", [(features.SLICE, 1 << 16), (40, 50)])
def test_runs_hold_each_game_once_and_give_the_labelled_sequences(spark, monkeypatch, slice_games, block):
    """Kept were the 81 numbers of each sequence, ten times what its games are; a run keeps a game's eight and a label, also over slices and blocks."""
    rows = features.team_games(some_games(spark))
    runs = features.sequence_runs(rows, slice_games=slice_games)
    monkeypatch.setattr(boosting, "BLOCK", block)
    held = boosting.run_blocks(runs, list(features.STEP), "label", 10, 100.0).collect()
    found = [(x[:-1], y) for b in held for xs, ys in boosting.windows(*b, 10) for x, y in zip(xs.T, ys)]
    want = features.labelled_sequences(rows).collect()
    line = lambda x, y: tuple(np.float32([*x, y]).tolist())
    assert len(want) > 1000 and sorted(line(*f) for f in found) == sorted(line(np.array(r["sequence"]) / 100, r["label"]) for r in want)
    keys = [tuple(r) for r in runs.filter("label is not null").select("team_id", "game_id", "label").collect()]
    assert sorted(keys) == sorted((r["team_id"], r["game_id"], r["label"]) for r in want)
    if slice_games == features.SLICE:
        assert sum(x.nbytes + y.nbytes for x, y in held) == rows.count() * 36


def test_net_on_runs_is_the_net_on_sequences(spark):
    rows = features.team_games(some_games(spark))
    vectors = features.labelled_sequences(rows).select("label", array_to_vector(F.transform("sequence", lambda x: x / 100.0)).alias("features"))
    plain = ml.Net([80, 4, 2], 8, "features").fit(vectors)
    runs = ml.Net([80, 4, 2], 8, "features").fit_runs(features.sequence_runs(rows), list(features.STEP), 100.0)
    assert runs.getLayers() == [80, 4, 2] and runs.weights.toArray() == pytest.approx(plain.weights.toArray(), abs=2e-3)
    with pytest.raises(Exception, match="follow each other"):
        ml.Net([80, 4, 2], 1, "features").fit_runs(features.sequence_runs(rows).orderBy(F.rand(1)), list(features.STEP))
