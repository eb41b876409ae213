"""Gradient boosting and nets as Spark ML estimators over blocks of rows: one pass over kept blocks a level or gradient, numpy inside tasks.

Spark ML's own trainers walk objects row by row; here a task holds some ten thousand rows as arrays. What is worked out
is the same: Friedman's gradient boosting with Spark's loss and rate, and L-BFGS on Spark's net. All rows take part. The
driver holds one tree's sums or one net's weights, whose size depends on the model alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model, classification
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.sources.storage import cut_lineage

#: Bins of a feature, as Spark's trees have them.
BINS = 32
#: Rows of a block: large enough for numpy, small enough for a core's cache.
BLOCK = 1 << 16
#: Values that stand for a block in the search for quantiles.
SKETCH = 1 << 10
#: Rows that a net works on at a time: what all its layers hold stays in a core's cache.
CHUNK = 1 << 10
#: What later trees weigh; the first weighs 1.
RATE = 0.1
#: Levels after which rows remember their places, so that no pass walks down from the root through more.
HALF = 5
#: Rounds between two cuts of the lineage.
CUT = 10


def inputs(rows: DataFrame, features: str | list[str], *more: Column) -> tuple[DataFrame, Callable[[pa.RecordBatch], np.ndarray]]:
    """rows with what holds the features, then ``more``, and how to take a row a game from a batch of it.

    ``features`` names a vector, or the columns themselves: making vectors of those and arrays of the vectors takes longer
    than all else that is done to a row here.
    """
    if isinstance(features, str):
        return rows.select(vector_to_array(features).alias("x"), *more), lambda batch: batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else None
    d = len(features)
    return rows.select(*[F.col(c).cast("double") for c in features], *more), lambda batch: np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(d)]).T if batch.num_rows else None


def blocks(rows: DataFrame, features: str | list[str], label: str, pack: Callable[[np.ndarray], np.ndarray]) -> RDD:
    """(pack(x), y) of up to BLOCK rows each, x with a row a game."""
    arrays, taken = inputs(rows, features, F.col(label).cast("double").alias("y"))

    def stacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            x, y = taken(batch), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, BLOCK):
                held.append((x[at:at + BLOCK], y[at:at + BLOCK]))
                n += len(held[-1][1])
                if n >= BLOCK // 2:
                    yield _written(held, pack)
                    held, n = [], 0
        if held:
            yield _written(held, pack)

    schema = "kind string, n long, x binary, y binary"
    return arrays.mapInArrow(stacked, schema).rdd.map(lambda r: (np.frombuffer(r["x"], r["kind"]).reshape(-1, r["n"]), np.frombuffer(r["y"], "f4")))


def _written(held: list, pack: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
    packed = np.ascontiguousarray(pack(np.concatenate([x for x, _ in held])))
    y = np.concatenate([y for _, y in held]).astype("f4")
    return pa.RecordBatch.from_arrays([pa.array([packed.dtype.str]), pa.array([len(y)]), pa.array([packed.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["kind", "n", "x", "y"])


def condensed(values: np.ndarray, weights: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``points`` values a feature, in order and of equal weight, whose ranks among all are right to half of one's weight."""
    if values.shape[1] <= points:
        return values, weights
    whole = weights.sum()
    return _at_ranks(values, weights, (np.arange(points) + 0.5) * (whole / points)), np.full(points, whole / points)


def _at_ranks(values: np.ndarray, weights: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """For each feature the least value up to which values weigh so much."""
    out = np.empty((len(values), len(ranks)))
    for i, line in enumerate(values):
        order = line.argsort()
        upto = weights.take(order).cumsum()
        out[i] = line.take(order.take(np.minimum(np.searchsorted(upto, ranks - 1e-9 * upto[-1]), len(order) - 1)))
    return out


def quantiles(rows: DataFrame, features: str | list[str]) -> list[np.ndarray]:
    """The edges of BINS bins of each feature, quantiles of all rows, ranks right to 0.001: one pass, which sorts blocks."""
    arrays, taken = inputs(rows, features)

    def sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, made = [], 0, []
        for batch in batches:
            if batch.num_rows:
                held.append(taken(batch).T)
                n += batch.num_rows
            if n >= BLOCK:
                made.append(condensed(np.hstack(held), np.ones(n), SKETCH))
                held, n = [], 0
            if len(made) >= 64:
                # Each merge adds half a point to the error, so those of many blocks keep many points.
                made = [condensed(*_side_by_side(made), 8 * SKETCH)]
        if held:
            made.append(condensed(np.hstack(held), np.ones(n), SKETCH))
        if made:
            values, weights = condensed(*_side_by_side(made), 2 * SKETCH)
            yield pa.RecordBatch.from_arrays([pa.array([len(weights)]), pa.array([values.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary())], ["n", "x", "w"])

    found = arrays.mapInArrow(sketched, "n long, x binary, w binary").collect()
    values, weights = _side_by_side([(np.frombuffer(r["x"]).reshape(-1, r["n"]), np.frombuffer(r["w"])) for r in found])
    return [np.unique(e) for e in _at_ranks(values, weights, np.arange(1, BINS) * (weights.sum() / BINS))]


def _side_by_side(sketches: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.hstack([values for values, _ in sketches]), np.concatenate([weights for _, weights in sketches])


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """A line of bins a feature: how many edges each value exceeds."""
    return np.stack([np.searchsorted(e, x[:, i]).astype("u1") for i, e in enumerate(edges)])


#: What the first tree is fitted to.
FIRST = {"logistic": lambda y, margin: 2 * y - 1, "squared": lambda y, margin: y}
#: What a later tree is fitted to, as Spark's losses have it: the downhill gradient at a label and a margin.
RESIDUALS = {
    "logistic": lambda y, margin: 2 * (2 * y - 1) / (1 + np.exp(2 * (2 * y - 1) * margin)),
    "squared": lambda y, margin: 2 * (y - margin),
}


def routed(bins: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], place: np.ndarray | None = None) -> np.ndarray:
    """The place of each row among the nodes below ``levels``, from ``place`` on; a level is (features, cuts), and bins above the cut go right."""
    n = bins.shape[1]
    flat, row = bins.ravel(), np.arange(n)
    place = np.zeros(n, np.intp) if place is None else place.astype(np.intp)
    for feature, cut in levels:
        at = (feature * n).take(place)
        at += row
        right = flat.take(at) > cut.take(place)
        place += place
        place += right
    return place


def summed(rest: Callable[[np.ndarray, np.ndarray], np.ndarray], levels: list, wanted: np.ndarray, features: int) -> Callable[[Iterator], Iterator[np.ndarray]]:
    """Counts and sums of residuals by feature, node and bin, over a task's blocks.

    Counted are the rows of ``wanted`` nodes, at most one of two siblings, under their parent's number.
    """
    size = BINS * max(1, len(wanted) // 2)

    def sums(part: Iterator) -> Iterator[np.ndarray]:
        found = np.zeros((2, features, size))
        for bins, y, margin, before in part:
            weight = rest(y, margin)
            if wanted.all():
                # The root: all rows, as they lie.
                for i in range(features):
                    found[0, i] += np.bincount(bins[i], minlength=size)
                    found[1, i] += np.bincount(bins[i], weight, size)
                continue
            place = routed(bins, levels, before)
            rows = np.flatnonzero(wanted.take(place))
            base, weight = place.take(rows), weight.take(rows).astype("f8")
            base >>= 1
            base *= BINS
            for i in range(features):
                at = base + bins[i].take(rows)
                found[0, i] += np.bincount(at, minlength=size)
                found[1, i] += np.bincount(at, weight, size)
        yield found

    return sums


def with_siblings(sums: np.ndarray, parents: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The sums of all nodes of a level: those counted, and what is left of the parent for a sibling; none below a node without gain."""
    both = np.zeros((*parents.shape[:2], len(wanted), BINS))
    left, right = wanted[0::2], wanted[1::2]
    both[:, :, 0::2][:, :, left], both[:, :, 1::2][:, :, left] = sums[:, :, left], (parents - sums)[:, :, left]
    both[:, :, 1::2][:, :, right], both[:, :, 0::2][:, :, right] = sums[:, :, right], (parents - sums)[:, :, right]
    return both


def best_cuts(sums: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature and cut of each node, the children to count next (the smaller ones of cuts that gain), and the children's means.

    A node without gain sends all rows, and its value, left.
    """
    count, total = sums
    left_n, left = count.cumsum(2)[..., :-1], total.cumsum(2)[..., :-1]
    n, whole = count.sum(2)[..., None], total.sum(2)[..., None]
    right_n, right = n - left_n, whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((left_n > 0) & (right_n > 0), left * left / left_n + right * right / right_n - whole * whole / n, -1.0)
        nodes = gain.shape[1]
        flat = gain.transpose(1, 0, 2).reshape(nodes, -1)
        best, node = flat.argmax(1), np.arange(nodes)
        feature, cut = np.divmod(best, BINS - 1)
        gains = flat[node, best] > 1e-9 * n[0, :, 0]
        chosen = feature, node, cut
        means = np.stack([np.where(gains, (left / left_n)[chosen], value), np.where(gains, (right / right_n)[chosen], 0.0)], 1)
    smaller = left_n[chosen] <= right_n[chosen]
    wanted = np.stack([gains & smaller, gains & ~smaller], 1)
    return np.where(gains, feature, 0), np.where(gains, cut, BINS).astype("u1"), wanted.ravel(), means.ravel()


class Boosting(Estimator):
    """Boosted regression trees on ``loss`` ("logistic" for labels 0 and 1, "squared" for numbers), cut at quantiles of all rows."""

    def __init__(self, rounds: int, depth: int, loss: str = "logistic", label: str = "label", features: str | list[str] = "features"):
        super().__init__()
        self.rounds, self.depth, self.loss, self.label, self.features = rounds, depth, loss, label, features

    def _fit(self, rows: DataFrame) -> BoostedModel:
        cut_lineage(rows.sparkSession)
        edges = quantiles(rows, self.features)
        first, rest = FIRST[self.loss], RESIDUALS[self.loss]
        # Beside its label each row keeps what the tree is fitted to, so that no level works it out again.
        fresh = lambda bins, y, margin, target: (bins, np.stack([y, target(y, margin).astype("f4")]), margin, np.zeros(len(y), "u2"))
        state = _Kept(blocks(rows, self.features, self.label, lambda x: binned(x, edges)).map(lambda b: fresh(*b, np.zeros(len(b[1]), "f4"), first)))
        trees = []
        for step in range(self.rounds):
            tree, leaves = self._tree(state, len(edges))
            leaves = leaves * (RATE if step else 1.0)
            trees.append((tree, leaves))
            if step + 1 < self.rounds:
                late, gained = _unwalked(tree), leaves.astype("f4")
                state.move(lambda b, late=late, gained=gained: fresh(b[0], b[1][0], b[2] + gained.take(routed(b[0], late, b[3])), rest), (step + 1) % CUT == 0)
        state.end()
        return BoostedModel(trees, edges, self.loss, self.features)

    def _tree(self, state: _Kept, features: int) -> tuple[list, np.ndarray]:
        """The tree's levels, and the means of its leaves; the blocks then have the places of rows below its first HALF levels."""
        tree, wanted, parents, leaves = [], np.array([True]), None, None
        while len(tree) < self.depth and wanted.any():
            sums = state.total(summed(lambda known, margin: known[1], _unwalked(tree), wanted, features)).reshape(2, features, -1, BINS)
            sums = sums if parents is None else with_siblings(sums, parents, wanted)
            value = leaves if tree else sums[1, 0].sum(1) / sums[0, 0].sum(1)
            feature, cut, wanted, leaves = best_cuts(sums, value)
            tree.append((feature, cut))
            parents = sums
            if len(tree) == HALF:
                state.move(lambda b, top=tuple(tree): (*b[:3], routed(b[0], top).astype("u2")))
        return tree, leaves


class _Kept:
    """Blocks in Spark's store. What moves them waits for the next pass, which keeps the new ones; then those before go."""

    def __init__(self, blocks_of: RDD):
        self.now, self.before = blocks_of.persist(StorageLevel.MEMORY_AND_DISK), []

    def move(self, work: Callable, cut: bool = False) -> None:
        self.before.append(self.now)
        self.now = self.now.map(work).persist(StorageLevel.MEMORY_AND_DISK)
        if cut:
            self.now.checkpoint()

    def total(self, work: Callable[[Iterator], Iterator[np.ndarray]]) -> np.ndarray:
        found = self.now.mapPartitions(work).reduce(np.add)
        self._drop()
        return found

    def _drop(self) -> None:
        for old in self.before:
            old.unpersist()
        self.before = []

    def end(self) -> None:
        self._drop()
        self.now.unpersist()


def _unwalked(tree: list) -> list:
    """The levels below the places that rows remember; a tree that ended above them was walked by no row yet."""
    return tree[HALF:] if len(tree) >= HALF else tree


def scores(features: str | list[str], edges: list[np.ndarray], work: Callable[[np.ndarray], np.ndarray]) -> Column:
    """work of each row's bins: one number a row."""

    @F.arrow_udf("double")
    def scored(*x: pa.Array) -> pa.Array:
        n = len(x[0])
        if not n:
            return pa.array([], pa.float64())
        values = x[0].flatten().to_numpy().reshape(n, -1) if isinstance(features, str) else np.stack([c.to_numpy(zero_copy_only=False) for c in x]).T
        return pa.array(work(binned(values, edges)))

    return scored(vector_to_array(features)) if isinstance(features, str) else scored(*[F.col(c).cast("double") for c in features])


class BoostedModel(Model):
    """Adds prediction, and probability (a vector) for the logistic loss."""

    def __init__(self, trees: list, edges: list[np.ndarray], loss: str, features: str | list[str]):
        super().__init__()
        self.trees, self.edges, self.loss, self.features = trees, edges, loss, features

    def _transform(self, rows: DataFrame) -> DataFrame:
        trees = self.trees
        margin = scores(self.features, self.edges, lambda bins: sum(leaves.take(routed(bins, tree)) for tree, leaves in trees))
        if self.loss == "squared":
            return rows.withColumn("prediction", margin)
        p = 1 / (1 + F.exp(-2 * F.col("margin")))
        return rows.withColumn("margin", margin).withColumn("probability", array_to_vector(F.array(1 - p, p))).withColumn("prediction", (F.col("margin") > 0).cast("double")).drop("margin")


class GBTClassifier(Boosting):
    """Boosting by Spark's names for its sizes."""

    def __init__(self, maxIter: int, maxDepth: int, features: str | list[str] = "features", label: str = "label"):  # noqa: N803
        super().__init__(maxIter, maxDepth, "logistic", label, features)


class GBTRegressor(Boosting):
    """Boosting of numbers by Spark's names for its sizes."""

    def __init__(self, maxIter: int, maxDepth: int, features: str | list[str] = "features", label: str = "label"):  # noqa: N803
        super().__init__(maxIter, maxDepth, "squared", label, features)


def net_loss(weights: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, chunk: int = CHUNK) -> tuple[float, np.ndarray]:
    """Cross-entropy summed over the rows and its gradient; sigmoids inside, softmax at the end, Spark's order of weights.

    x has a column a row and ones below, so that a layer's weights and intercepts are one matrix. Few rows at a time stay
    in a core's cache.
    """
    parts, at = [], 0
    for m, n in zip(layers, layers[1:]):
        parts.append(weights[at:at + (m + 1) * n].reshape(m + 1, n).astype(x.dtype))
        at += (m + 1) * n
    loss, found = 0.0, [np.zeros(p.shape) for p in parts]
    downhill = [-p.T for p in parts[:-1]]
    for start in range(0, x.shape[1], chunk):
        seen, column = [x[:, start:start + chunk]], np.arange(min(chunk, x.shape[1] - start))
        known = y[start:start + chunk].astype(np.intp)
        for w in downhill:
            a = np.ones((len(w) + 1, len(column)), x.dtype)
            z = np.matmul(w, seen[-1], out=a[:-1])
            with np.errstate(over="ignore"):
                np.exp(z, z)
            z += 1
            np.reciprocal(z, z)
            seen.append(a)
        delta = parts[-1].T @ seen[-1]
        delta -= delta.max(0)
        chosen = delta[known, column].sum(dtype="f8")
        np.exp(delta, delta)
        whole = delta.sum(0)
        loss += float(np.log(whole).sum(dtype="f8") - chosen)
        delta /= whole
        delta[known, column] -= 1
        for i in range(len(parts) - 1, -1, -1):
            found[i] += seen[i] @ delta.T
            if i:
                a = seen[i][:-1]
                delta = parts[i][:-1] @ delta
                delta *= a
                delta *= 1 - a
    return loss, np.concatenate([g.ravel() for g in found])


def lbfgs(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """L-BFGS with a line search for the weak Wolfe conditions; ends as Spark's does, on no gain over ten values or after ``steps``."""
    at, pairs = start, []
    f, g = value(at)
    seen, first = [f], f
    for step in range(steps):
        way, used = -g, []
        for s, y in reversed(pairs):
            used.append(s @ way / (s @ y))
            way = way - used[-1] * y
        if pairs:
            s, y = pairs[-1]
            way = way * (s @ y / (y @ y))
        for (s, y), a in zip(pairs, reversed(used)):
            way = way + (a - y @ way / (s @ y)) * s
        slope, low, high, t = g @ way, 0.0, np.inf, 1.0 if pairs else 1 / max(np.linalg.norm(g), 1e-12)
        for _ in range(20):
            new = at + t * way
            f_new, g_new = value(new)
            if not f_new <= f + 1e-4 * t * slope:
                high = t
            elif g_new @ way < 0.9 * slope:
                low = t
            else:
                break
            t = (low + high) / 2 if high < np.inf else 2 * t
        if not f_new < f:
            break
        s, y = new - at, g_new - g
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-memory:]
        at, f, g = new, f_new, g_new
        if len(seen) >= 10 and abs(f - max(seen[-10:])) <= tolerance * abs(first) or np.linalg.norm(g) <= tolerance * max(abs(f), 1e-8):
            break
        seen.append(f)
    return at


class Net(Estimator):
    """Spark's feed-forward net, its weights found by L-BFGS over blocks of rows; the model is Spark's own."""

    def __init__(self, layers: list[int], steps: int, features: str = "scaled", label: str = "label", seed: int = 42):
        super().__init__()
        self.layers, self.steps, self.features, self.label, self.seed = layers, steps, features, label, seed

    def _fit(self, rows: DataFrame) -> Model:
        held = blocks(rows, self.features, self.label, lambda x: np.vstack([x.T, np.ones(len(x))]).astype("f4"))
        return self._found(rows.sparkSession, held, lambda b: [b])

    def fit_runs(self, runs: DataFrame, steps: list[str], unit: float = 1.0) -> Model:
        """The same net on the sequences that ``features.sequence_runs`` holds, each game kept once and not in every sequence that it is part of."""
        length = self.layers[0] // len(steps)
        held = run_blocks(runs, steps, self.label, length, unit)
        return self._found(runs.sparkSession, held, lambda b: windows(*b, length))

    def _found(self, spark: SparkSession, blocks_of: RDD, pieces: Callable[[tuple], Iterable[tuple[np.ndarray, np.ndarray]]]) -> Model:
        layers = self.layers
        one = spark.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], [self.features, self.label])
        # Without a step Spark's trainer hands back the weights it starts from, whatever the rows.
        given = lambda **more: classification.MultilayerPerceptronClassifier(featuresCol=self.features, labelCol=self.label, layers=layers, maxIter=0, seed=self.seed, **more).fit(one)
        held = blocks_of.persist(StorageLevel.MEMORY_AND_DISK)
        n = held.map(lambda b: int((b[1] == b[1]).sum())).sum()

        def value(weights: np.ndarray) -> tuple[float, np.ndarray]:
            def summed(part: Iterator) -> Iterator[np.ndarray]:
                found = np.zeros(len(weights) + 1)
                for block in part:
                    for x, y in pieces(block):
                        loss, gradient = net_loss(weights, layers, x, y)
                        found[0] += loss
                        found[1:] += gradient
                yield found

            found = held.mapPartitions(summed).reduce(np.add) / n
            return float(found[0]), found[1:]

        weights = lbfgs(value, given().weights.toArray(), self.steps)
        held.unpersist()
        return given(initialWeights=Vectors.dense(weights))


def run_blocks(runs: DataFrame, steps: list[str], label: str, length: int, unit: float) -> RDD:
    """(steps, y) of up to BLOCK games each in their order, a line a game, y not a number where no label is; each block starts with the ``length`` games before it."""
    arrays = runs.select(*[(F.col(c) / unit).alias(c) for c in steps], F.coalesce(F.col(label).cast("double"), F.lit(float("nan"))).alias("y"), "place")

    def stacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, len(steps) + 2))
        waiting, n = [], 0
        for batch in batches:
            waiting.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype("f8") for i in range(batch.num_columns)], 1))
            n += batch.num_rows
            if n >= BLOCK:
                held = np.vstack([held, *waiting])
                yield written(held)
                held, waiting, n = held[-length:].copy(), [], 0
                held[:, -2] = np.nan
        if n:
            yield written(np.vstack([held, *waiting]))

    def written(games: np.ndarray) -> pa.RecordBatch:
        y, place = games[:, -2].astype("f4"), games[:, -1]
        at = np.flatnonzero(y == y)
        if len(at) and (at[0] < length or (place[at - length] != place[at] - length).any()):
            raise ValueError("the games of a run do not follow each other")
        return pa.RecordBatch.from_arrays([pa.array([games[:, :-2].astype("f4").tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["x", "y"])

    return arrays.mapInArrow(stacked, "x binary, y binary").rdd.map(lambda r: (np.frombuffer(r["x"], "f4").reshape(-1, len(steps)), np.frombuffer(r["y"], "f4")))


def windows(steps: np.ndarray, y: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sequences before the games with a label, few at a time: a column each, with ones below."""
    at, width = np.flatnonzero(y == y), steps.shape[1]
    if not len(at):
        return
    # A line of steps follows the other in memory, so a sequence is one piece of it.
    pieces = np.lib.stride_tricks.as_strided(steps, (len(steps) - length + 1, length * width), steps.strides[:1] + steps.strides[1:], writeable=False)
    for start in range(0, len(at), CHUNK):
        few = at[start:start + CHUNK]
        x = np.ones((len(few), length * width + 1), steps.dtype)
        x[:, :-1] = pieces[few - length]
        yield x.T, y.take(few)


class MultilayerPerceptronClassifier(Net):
    """Net by Spark's names for its sizes."""

    def __init__(self, layers: list[int], maxIter: int, features: str = "scaled", label: str = "label"):  # noqa: N803
        super().__init__(layers, maxIter, features, label)
