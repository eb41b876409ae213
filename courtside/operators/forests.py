"""Random forests as a Spark ML estimator over blocks of rows: one pass a level for all trees, numpy inside tasks.

What is worked out is Spark's: every tree on a bootstrap of all rows, the square root of the features drawn anew for each
node, Gini's gain, siblings of one prediction merged, probabilities the mean of the trees'. Each level's counts are summed
and cut in a shuffle by tree, so the driver holds the trees alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, exp, factorial, sqrt

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Model, classification
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.operators.boosting import BINS, best_cuts, binned, blocks, quantiles, routed, scores

#: What a row of label 1 weighs besides the 1 of each row: counts below this and sums of labels share a double.
APART = float(1 << 26)
#: Rows after which a task hands over its counts, so that they stay below APART (no row is drawn more than eight times).
ROWS = 1 << 22
#: Levels after which rows remember their places, so that no pass walks down from the root through more.
HALF = 5
#: The least of 65,536 equal chances at which a row is drawn once, twice, ..., by Poisson's law of mean 1.
DRAWS = [round(65536 * sum(exp(-1) / factorial(i) for i in range(k))) for k in range(1, 9)]


def drawn(seed: int, tree: int, part: int, block: int, n: int) -> np.ndarray:
    """How often each of a block's n rows is drawn for a tree, the same at every level."""
    chance = np.random.SFC64([seed, tree, part, block]).random_raw(-(-n // 4)).view("u2")[:n]
    times = (chance >= DRAWS[0]).view("u1")
    for least in DRAWS[1:]:
        times += chance >= least
    return times


def offered(seed: int, tree: int, level: int, features: int, wanted: int) -> np.ndarray:
    """The features among which each node of a level may choose: a line a choice, a column a node."""
    return np.random.default_rng([seed, tree, level, 1]).random((1 << level, features)).argsort(1)[:, :wanted].T


def walked(bins: np.ndarray, rows: np.ndarray, levels: list, before: np.ndarray | None) -> np.ndarray:
    """The places of a block's ``rows`` among the nodes below ``levels``, from those ``before`` on."""
    n, flat = bins.shape[1], bins.ravel()
    place = np.zeros(len(rows), np.intp) if before is None else before.astype(np.intp)
    for feature, cut in levels:
        at = (feature * n).take(place)
        at += rows
        right = flat.take(at) > cut.take(place)
        place += place
        place += right
    return place


def remembered(seed: int, trees: list[list]) -> Callable[[int, Iterator], Iterator[tuple]]:
    """The blocks with the places of each tree's rows below its levels so far, at most eight of them."""

    def places(part: int, held: Iterator) -> Iterator[tuple]:
        for number, (bins, y, _) in enumerate(held):
            yield bins, y, [walked(bins, np.flatnonzero(drawn(seed, t, part, number, len(y)) > 0), levels, None).astype("u1") for t, levels in enumerate(trees)]

    return places


def counted(seed: int, trees: list[list], choices: list[np.ndarray]) -> Callable[[int, Iterator], Iterator[tuple[int, np.ndarray]]]:
    """Each tree's rows and labels of 1 by choice, node and bin, over a task's blocks; ``trees`` have the levels below the places that these know."""

    def counts(part: int, held: Iterator) -> Iterator[tuple[int, np.ndarray]]:
        wanted, nodes = choices[0].shape
        sums, rows_in = np.zeros((len(trees), wanted, nodes * BINS)), 0
        for number, (bins, y, before) in enumerate(held):
            n = len(y)
            flat, labels = bins.ravel(), 1.0 + APART * y.astype("f8")
            for t, levels in enumerate(trees):
                times = drawn(seed, t, part, number, n)
                rows = np.flatnonzero(times > 0)
                place = walked(bins, rows, levels, before and before[t])
                weight = labels.take(rows)
                weight *= times.take(rows)
                first = place * BINS
                for k, choice in enumerate(choices[t] * n):
                    at = choice.take(place)
                    at += rows
                    sums[t, k] += np.bincount(first + flat.take(at), weight, nodes * BINS)
            rows_in += n
            if rows_in >= ROWS:
                yield from _apart(sums)
                sums, rows_in = np.zeros_like(sums), 0
        yield from _apart(sums)

    return counts


def _apart(sums: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for t, both in enumerate(sums):
        ones = np.floor(both / APART)
        yield t, np.stack([both - ones * APART, ones]).astype("i4")


def leaves_of(values: list[np.ndarray], split: list[np.ndarray]) -> np.ndarray:
    """The shares of ones at the places below the last level: each place's own leaf's, siblings of one prediction merged."""
    leaf, below = np.ones(len(values[-1]), bool), values[-1]
    lasting = [(leaf, below)]
    for value, cut in zip(values[-2::-1], split[::-1]):
        alike = leaf[0::2] & leaf[1::2] & ((below[0::2] > 0.5) == (below[1::2] > 0.5))
        leaf, below = ~cut | alike, value
        lasting.append((leaf, below))
    out, ended = lasting[-1][1], lasting[-1][0]
    for leaf, below in lasting[-2::-1]:
        out, ended = np.where(ended.repeat(2), out.repeat(2), below), ended.repeat(2) | leaf
    return out


class RandomForestClassifier(classification.RandomForestClassifier):
    """Spark's classifier of labels 0 and 1 by its own parameters; ``over`` names the columns that a vector would be made of."""

    columns: list[str] | None = None

    def over(self, columns: list[str]) -> RandomForestClassifier:
        self.columns = list(columns)
        return self

    def _fit(self, rows: DataFrame) -> ForestModel:
        features, seed, trees = self.columns or self.getFeaturesCol(), self.getSeed(), [[] for _ in range(self.getNumTrees())]
        edges = quantiles(rows, features)
        packed = blocks(rows, features, self.getLabelCol(), lambda x: binned(x, edges))
        held = packed.map(lambda b: (*b, None)).persist(StorageLevel.MEMORY_AND_DISK)
        wanted, parts = ceil(sqrt(len(edges))), held.getNumPartitions()
        values, split, known = [[] for _ in trees], [[] for _ in trees], 0
        for level in range(self.getMaxDepth()):
            if level == HALF:
                first, known = held, level
                held = first.mapPartitionsWithIndex(remembered(seed, trees)).persist(StorageLevel.MEMORY_AND_DISK)
            choices = [offered(seed, t, level, len(edges), wanted) for t in range(len(trees))]
            before = [v[-1] if v else None for v in values]

            def cuts(part: Iterator, choices=choices, before=before) -> Iterator[tuple]:
                found: dict[int, np.ndarray] = {}
                for t, sums in part:
                    found[t] = found[t] + sums if t in found else sums.astype("f8")
                for t, flat in found.items():
                    sums = flat.reshape(2, wanted, -1, BINS)
                    n, ones = sums[:, 0, 0].sum(1)
                    value = before[t] if before[t] is not None else np.array([ones / n if n else 0.5])
                    choice, cut, _, means = best_cuts(sums, value)
                    yield t, (choices[t][choice, np.arange(len(choice))], cut), value, means

            sums = held.mapPartitionsWithIndex(counted(seed, [levels[known:] for levels in trees], choices)).partitionBy(parts)
            for t, (feature, cut), value, means in sums.mapPartitions(cuts).collect():
                trees[t] = [*trees[t], (feature, cut)]
                values[t] = [*(values[t] or [value]), means]
                split[t].append(cut < BINS)
            if level == HALF:
                first.unpersist()
            if not any(s[-1].any() for s in split):
                break
        held.unpersist()
        return ForestModel([(levels, leaves_of(v, s)) for levels, v, s in zip(trees, values, split)], edges, features)


class ForestModel(Model, MLWritable, MLReadable):
    """Adds prediction and probability (a vector): the mean over the trees of the shares of ones in a row's leaves."""

    def __init__(self, trees: list, edges: list[np.ndarray], features: str | list[str]):
        super().__init__()
        self.trees, self.edges, self.features = trees, edges, features

    @property
    def getNumTrees(self) -> int:  # noqa: N802
        return len(self.trees)

    def _transform(self, rows: DataFrame) -> DataFrame:
        trees = self.trees
        p = F.col("of_ones")
        scored = rows.withColumn("of_ones", scores(self.features, self.edges, lambda bins: sum(leaves.take(routed(bins, levels)) for levels, leaves in trees) / len(trees)))
        return scored.withColumn("probability", array_to_vector(F.array(1 - p, p))).withColumn("prediction", (p > 0.5).cast("double")).drop("of_ones")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        model = self.model
        DefaultParamsWriter.saveMetadata(model, path, self.sparkSession, {"edges": [e.tolist() for e in model.edges], "features": model.features})
        trees = [(t, [f.tolist() for f, _ in levels], [c.tolist() for _, c in levels], leaves.tolist()) for t, (levels, leaves) in enumerate(model.trees)]
        self.sparkSession.createDataFrame(trees, "tree int, features array<array<int>>, cuts array<array<int>>, leaves array<double>").coalesce(1).write.parquet(f"{path}/data")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        known = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        kept = sorted(self.sparkSession.read.parquet(f"{path}/data").collect())
        trees = [([(np.array(f, np.intp), np.array(c, "u1")) for f, c in zip(r["features"], r["cuts"])], np.array(r["leaves"])) for r in kept]
        return ForestModel(trees, [np.array(e) for e in known["edges"]], known["features"])
