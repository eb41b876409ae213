"""Boosting and nets over blocks of rows: against brute force, Spark's own net, and what a pass counts."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from courtside.operators import boosting, ml, text
from courtside.operators.boosting import Boosting, Net


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(3000).selectExpr("id AS game_id", "cast(id * 7919 % 23 AS double) AS a", "cast(id * 104729 % 19 AS double) AS b", "cast(id * 31 % 11 AS double) AS c")
    labelled = made.selectExpr("*", "cast(CASE WHEN a > 11 THEN b > 7 ELSE c < 4 END AS int) AS label", "a * 2 - b + c AS margin").repartition(3, "game_id")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(labelled).cache()


def brute(x, rest, depth):
    """A regression tree's fitted values, trying every cut of every feature at every node."""
    best = None
    for i in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, i])[:-1]:
            left = x[:, i] <= cut
            gain = rest[left].sum() ** 2 / left.sum() + rest[~left].sum() ** 2 / (~left).sum() - rest.sum() ** 2 / len(rest)
            if gain > 1e-9 * len(rest) and (best is None or gain > best[0] * (1 + 1e-12)):
                best = gain, left
    if best is None:
        return np.full(len(x), rest.mean())
    out = np.empty(len(x))
    for side in (best[1], ~best[1]):
        out[side] = brute(x[side], rest[side], depth - 1)
    return out


@pytest.mark.parametrize("loss,label", [("logistic", "label"), ("squared", "margin")])
def test_boosting_is_what_brute_force_finds(rows, loss, label):
    """Rounds below and above the cut of the lineage, a depth beyond the level where places are kept, cuts at all values."""
    held = rows.orderBy("game_id").select("a", "b", "c", label).toPandas().to_numpy(float)
    x, y = held[:, :3], held[:, 3]
    margin = np.zeros(len(y))
    for step in range(12):
        margin += brute(x, boosting.RESIDUALS[loss](y, margin), 7) * 0.1 if step else brute(x, boosting.FIRST[loss](y, margin), 7)
    scored = Boosting(12, 7, loss, label).fit(rows).transform(rows).orderBy("game_id")
    if loss == "squared":
        found = np.array([r["prediction"] for r in scored.collect()])
        assert np.abs(found - margin).max() < 0.05 * np.abs(y).max() and ((found - y) ** 2).mean() == pytest.approx(((margin - y) ** 2).mean(), rel=0.05, abs=1e-3)
    else:
        found = np.array([r["p"] for r in ml.probability(scored).collect()])
        assert np.abs(found - 1 / (1 + np.exp(-2 * margin))).max() < 1e-3


def test_siblings_that_are_not_counted_are_the_rest_of_their_parent():
    rng = np.random.default_rng(1)
    bins, y, zero = rng.integers(0, 32, (3, 500)).astype("u1"), rng.integers(0, 2, 500).astype("f4"), np.zeros(500, "f4")
    block, rest = (bins, y, zero, np.zeros(500, "u2")), boosting.FIRST["logistic"]
    root = next(boosting.summed(rest, [], np.array([True]), 3)([block]))
    feature, cut, wanted, _ = boosting.best_cuts(root.reshape(2, 3, 1, 32), np.zeros(1))
    assert wanted.sum() == 1
    counted = next(boosting.summed(rest, [(feature, cut)], wanted, 3)([block])).reshape(2, 3, 1, 32)
    both = boosting.with_siblings(counted, root.reshape(2, 3, 1, 32), wanted)
    place = boosting.routed(bins, [(feature, cut)])
    for side in (0, 1):
        for i in range(3):
            mine = bins[i][place == side]
            assert (both[0, i, side] == np.bincount(mine, minlength=32)).all() and np.allclose(both[1, i, side], np.bincount(mine, 2 * y[place == side] - 1, 32))
    assert counted[0, 0].sum() * 2 <= 500


def test_net_is_sparks_with_the_same_loss(rows):
    """The same shape, a loss near that of Spark's trainer or below it, Spark's loss at Spark's weights, and a gradient that finite differences confirm."""
    layers = [3, 6, 4, 2]
    scaled = ml.StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(rows).transform(rows)
    p = F.when(F.col("label") == 1, F.col("p")).otherwise(1 - F.col("p"))
    loss = lambda m: ml.probability(m.transform(scaled)).agg(F.avg(-F.log(p))).first()[0]
    mine = Net(layers, 60).fit(scaled)
    theirs = MultilayerPerceptronClassifier(featuresCol="scaled", layers=layers, maxIter=60, seed=42).fit(scaled)
    assert mine.getLayers() == layers and len(mine.weights) == len(theirs.weights)
    assert loss(mine) < 1.25 * loss(theirs) + 0.01
    x, y = np.vstack([np.random.default_rng(0).normal(size=(3, 40)), np.ones(40)]), np.arange(40) % 2
    w = theirs.weights.toArray() / 3
    value, gradient = boosting.net_loss(w, layers, x, y, 16)
    for i in range(0, len(w), 5):
        step = np.zeros(len(w))
        step[i] = 1e-6
        assert (boosting.net_loss(w + step, layers, x, y)[0] - boosting.net_loss(w - step, layers, x, y)[0]) / 2e-6 == pytest.approx(gradient[i], abs=1e-5)
    want = sum(-np.log(r["p"] if r["label"] else 1 - r["p"]) for r in ml.probability(theirs.transform(scaled)).select("p", "label").collect())
    blocks = boosting.blocks(scaled, "scaled", "label", lambda x: np.vstack([x.T, np.ones(len(x))]).astype("f4")).collect()
    assert sum(boosting.net_loss(theirs.weights.toArray(), layers, *b)[0] for b in blocks) == pytest.approx(want, rel=1e-3, abs=1e-2)


def test_no_pass_only_moves_rows(spark, rows):
    """A job a level, and one that finds the cuts: what moves rows to their places or gives them new margins waits for the next level; five more jobs before."""
    spark.sparkContext.setJobGroup("boosting", "boosting")
    try:
        trees = Boosting(3, 7).fit(rows).trees
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 1 + sum(len(levels) for levels, _ in trees)
