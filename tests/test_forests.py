"""Forests over blocks of rows: what a pass counts, Spark's own forest, saved models, and the cuts of all rows."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel, classification
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from courtside.operators import boosting, forests, ml


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(6000).selectExpr("id AS game_id", "cast(id * 7919 % 97 AS double) AS a", "cast(id * 104729 % 89 AS double) AS b", "cast(id * 31 % 11 AS double) AS c")
    return made.selectExpr("*", "cast(CASE WHEN a > 45 THEN b > 30 ELSE c < 4 END AS int) AS label").repartition(3, "game_id").cache()


def test_a_level_counts_what_was_drawn_whether_places_are_remembered_or_not():
    rng = np.random.default_rng(1)
    bins, y = rng.integers(0, 32, (5, 700)).astype("u1"), rng.integers(0, 2, 700).astype("f4")
    trees = [[(rng.integers(0, 5, 1 << l), rng.integers(8, 24, 1 << l).astype("u1")) for l in range(3)] for _ in range(2)]
    choices = [forests.offered(42, t, 3, 5, 3) for t in range(2)]
    block = (bins, y, None)
    found = dict(forests.counted(42, trees, choices)(4, iter([block])))
    known = list(forests.remembered(42, [levels[:2] for levels in trees])(4, iter([block])))
    again = dict(forests.counted(42, [levels[2:] for levels in trees], choices)(4, iter(known)))
    for t in range(2):
        times, place = forests.drawn(42, t, 4, 0, 700), boosting.routed(bins, trees[t])
        for k in range(3):
            for node in range(8):
                mine, of = place == node, bins[choices[t][k, node]]
                want = [np.bincount(of[mine], times[mine] * w, 32) for w in (np.ones(mine.sum()), y[mine])]
                assert (found[t].reshape(2, 3, 8, 32)[:, k, node] == want).all()
        assert (found[t] == again[t]).all()


def test_draws_are_poissons():
    times = forests.drawn(42, 3, 1, 2, 1 << 18)
    assert times.mean() == pytest.approx(1, abs=0.01) and times.var() == pytest.approx(1, abs=0.02) and (times == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    assert (times != forests.drawn(42, 4, 1, 2, 1 << 18)).mean() > 0.5


def test_siblings_of_one_prediction_are_one_leaf():
    values = [np.array([0.55]), np.array([0.4, 0.7]), np.array([0.3, 0.45, 0.9, 0.2])]
    assert forests.leaves_of(values, [np.array([True]), np.array([True, True])]).tolist() == [0.4, 0.4, 0.9, 0.2]
    assert forests.leaves_of(values, [np.array([False]), np.array([True, True])]).tolist() == [0.55] * 4
    assert forests.leaves_of(values, [np.array([True]), np.array([True, False])]).tolist() == [0.4, 0.4, 0.7, 0.7]


@pytest.mark.parametrize("columns", [True, False])
def test_forest_is_like_sparks_and_saves(spark, rows, tmp_path, columns):
    """The same accuracy and spread of probabilities as Spark's own trees; the saved pipeline scores the same."""
    names = ["a", "b", "c"]
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    mine = ml.forest(30, 7)
    model = Pipeline(stages=[mine.over(names)] if columns else [assemble, mine]).fit(rows)
    theirs = Pipeline(stages=[assemble, classification.RandomForestClassifier(numTrees=30, maxDepth=7, seed=42)]).fit(rows)
    mean = lambda m: ml.probability(m.transform(rows)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")), F.avg("p"), F.stddev("p")).first()
    assert tuple(mean(model)) == pytest.approx(tuple(mean(theirs)), abs=0.03) and mean(model)[0] > 0.9
    model.write().overwrite().save(f"{tmp_path}/m")
    scored = lambda m: {r["game_id"]: r["p"] for r in ml.probability(m.transform(rows)).collect()}
    assert scored(PipelineModel.load(f"{tmp_path}/m")) == scored(model)


def test_all_trees_share_a_pass_a_level(spark, rows):
    """One pass finds the cuts, the others are levels; with 4 MB a pass Spark's trainer took 15 jobs for these trees."""
    spark.sparkContext.setJobGroup("forest", "forest")
    try:
        ml.forest(100, 8).over(["a", "b", "c"]).fit(rows)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 10


def test_cuts_are_quantiles_of_all_rows(spark, monkeypatch):
    """Merged over blocks, partitions and a partition's many blocks, ranks are right to 0.001; few values are all kept."""
    monkeypatch.setattr(boosting, "BLOCK", 2000)
    frame = spark.range(0, 400000, 1, 3).selectExpr("sqrt(id * 7919 % 400000) AS x", "cast(id % 7 AS double) AS y")
    x, y = boosting.quantiles(frame, ["x", "y"])
    assert len(x) == 31 and np.abs(x * x / 400000 - np.arange(1, 32) / 32).max() < 0.001
    assert y.tolist() == [0, 1, 2, 3, 4, 5, 6]
    vectors = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(frame)
    assert all((a == b).all() for a, b in zip(boosting.quantiles(vectors, "features"), (x, y)))
