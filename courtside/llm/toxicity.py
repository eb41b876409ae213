"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the bytes of words, one of toxic and one of ordinary labelled
documents. The highest order (six bytes of context, padded at the word's start) has counts of each class; both
back off to the same lower orders, built from the continuation counts of both classes together, so a rare
expression that neither class has seen differs by its back-off weights only. A word's score is the difference
of its two log-likelihoods. A document compares length-normalised sums: the mean difference a word, and the
evidence (what exceeds ``dead_zone`` in each word) as a total and per word; a logistic curve over these, fitted
on labelled documents that the models have not seen, gives the score.

Bounds: at most about ``per_class`` labelled documents of each class are learned from, picked by hash; three
quarters build the models and one quarter the curve. Scoring reads the text only.

Null, blank and letterless texts have no words and get the curve's value at zero. Texts of any length are
scored whole; repeated rows are scored one by one; columns besides id and text are left out; an empty table gives an
empty result. Without labels of both classes every score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm._common import utf8, with_id
from courtside.llm._words import WordTable, joined, words_of

ORDER = 7
DISCOUNT = 0.75
START, END = b"\x02" * (ORDER - 1), b"\x03"


@dataclass
class Model:
    grams: np.ndarray  # sorted keys of ORDER bytes seen in training
    gains: np.ndarray  # log-likelihood difference of each
    contexts: np.ndarray  # sorted keys of ORDER - 1 bytes
    weights: np.ndarray  # difference of the log back-off weights
    curve: np.ndarray  # intercept and slopes of the logistic curve
    dead_zone: float

    def words(self, words: list[bytes]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each word."""
        keys, starts = gram_keys(words)
        if not len(keys):
            return np.zeros(len(words), np.float32)
        gain = look_up(self.grams, self.gains, keys, np.nan)
        unseen = np.isnan(gain)
        gain[unseen] = look_up(self.contexts, self.weights, keys[unseen] >> np.uint64(8), 0.0)
        return np.add.reduceat(gain, starts).astype(np.float32)

    def features(self, gains: np.ndarray) -> np.ndarray:
        n = max(1, len(gains))
        evidence = float(np.maximum(gains - self.dead_zone, 0).sum())
        return np.array([1.0, float(np.clip(gains.sum() / n, -1, 1)), np.log1p(evidence), 10 * evidence / n])

    def score(self, gains: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(gains) @ self.curve, -30, 30))))


def gram_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every run of ORDER bytes that ends in a word or its end marker, as an integer; where each word's begin."""
    flat, starts, lengths = joined(words, START, END)
    wide = flat.astype(np.uint64)
    n = len(flat) - ORDER + 1
    keys = np.zeros(max(n, 0), np.uint64)
    for k in range(ORDER):
        keys |= wide[k : k + n] << np.uint64(8 * (ORDER - 1 - k))
    counts = lengths + 1
    firsts = np.cumsum(counts) - counts
    inside = np.arange(counts.sum()) - np.repeat(firsts, counts) + np.repeat(starts, counts)
    return keys[inside], firsts


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def shared_probability(grams: np.ndarray) -> np.ndarray:
    """P(last byte | the ORDER - 2 bytes before it) of each gram, from pooled continuation counts, interpolated down to uniform."""
    mask = [np.uint64((1 << (8 * k)) - 1) for k in range(ORDER)]
    levels, seen = {}, grams
    for k in range(ORDER - 1, 0, -1):
        levels[k] = seen, counts = np.unique(seen & mask[k], return_counts=True)
    below = None
    for k in range(1, ORDER):
        seen, counts = levels[k]
        _, context = np.unique(seen >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(context, counts), np.bincount(context)
        lower = 1 / 256 if k == 1 else below[np.searchsorted(levels[k - 1][0], seen & mask[k - 1])]
        below = (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * kinds[context] * lower) / total[context]
    return below[np.searchsorted(levels[ORDER - 1][0], grams & mask[ORDER - 1])]


def fit_models(words: list[bytes], ordinary: np.ndarray, toxic: np.ndarray, dead_zone: float) -> Model:
    """The two models, as differences, from word counts of both classes."""
    keys, starts = gram_keys(words)
    of_word = np.repeat(np.arange(len(words)), np.diff([*starts, len(keys)]))
    grams, place = np.unique(keys, return_inverse=True)
    contexts, of_gram = np.unique(grams >> np.uint64(8), return_inverse=True)
    shared = shared_probability(grams)
    logs, backs = [], []
    for counts in (ordinary, toxic):
        own = np.bincount(place, counts[of_word], len(grams))
        total, kinds = np.bincount(of_gram, own, len(contexts)), np.bincount(of_gram, own > 0, len(contexts))
        back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(own - DISCOUNT, 0) / np.maximum(total, 1)[of_gram] + back[of_gram] * shared))
        backs.append(np.log(back))
    return Model(grams, (logs[1] - logs[0]).astype(np.float32), contexts, (backs[1] - backs[0]).astype(np.float32), np.zeros(4), dead_zone)


def fit_curve(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the intercept is not penalised."""
    curve = np.zeros(features.shape[1])
    penalty = ridge * np.diag([1e-6, *[1.0] * (features.shape[1] - 1)])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(features @ curve, -30, 30)))
        slope = features.T @ (weights * (labels - p)) - penalty @ curve
        curve = curve + np.linalg.solve((features * (weights * p * (1 - p) + 1e-9)[:, None]).T @ features + penalty, slope)
    return curve


def sample(labels: DataFrame, per_class: int, id_col: str, label_col: str) -> tuple[DataFrame, dict[int, float]]:
    """id, label, part (0: models, 1: curve) of about ``per_class`` rows of each label, picked by hash; each label's share picked."""
    rows = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropDuplicates(["id"])
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    shares = {k: min(1.0, per_class / n) for k, n in counts.items()}
    spot = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.when(F.col("label") == 1, shares.get(1, 0.0)).otherwise(shares.get(0, 0.0))
    part = (F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(4)) == 0).cast("int")
    return rows.filter(spot < share).select("id", "label", part.alias("part")), shares


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, dead_zone: float = 1.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model from a bounded sample of labelled documents; every row of ``labels`` may be learned from."""
    picked, shares = sample(labels, per_class, id_col, label_col)
    texts = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text")).join(F.broadcast(picked), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[bytes, int], int] = {}
        for batch in batches:
            for data, label in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                for w in words_of(data):
                    counts[w, label] = counts.get((w, label), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.binary()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["word", "label", "n"])

    counted = texts.filter("part = 0").select("text", "label").mapInArrow(count, "word binary, label int, n long")
    rows = counted.groupBy("word").agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("ordinary"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic")).toArrow()
    words = rows["word"].to_pylist()
    model = fit_models(words, rows["ordinary"].to_numpy(), rows["toxic"].to_numpy(), dead_zone) if words else Model(*[np.empty(0, t) for t in (np.uint64, np.float32) * 2], np.zeros(4), dead_zone)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(shared.value.words)
        for batch in batches:
            found = [shared.value.features(table.rows[i]) for i in table.index(utf8(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["label", "features"])

    held = texts.filter("part = 1").select("text", "label").mapInArrow(measure, "label int, features array<double>").toArrow()
    y = held["label"].to_numpy()
    if len(set(y)) == 2:
        weights = np.where(y == 1, 1 / shares[1], 1 / shares[0])
        model.curve = fit_curve(np.array(held["features"].to_pylist()), y, weights / weights.mean())
    else:
        rate = picked.agg(F.avg("label")).first()[0] or 0.0
        model.curve = np.array([np.log((rate + 1e-9) / (1 - rate + 1e-9)), 0, 0, 0])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> id, score: the probability of label 1, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(shared.value.words)
        for batch in batches:
            scores = [shared.value.score(table.rows[i]) for i in table.index(utf8(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    named = docs.select(docs[id_col].alias("id"), F.lower(docs[text_col].cast("string")).alias("text"))
    return named.mapInArrow(run, with_id(named, "score double")).withColumnRenamed("id", id_col)
