"""Language identification by a linear-chain conditional random field over words.

Every word's features are its byte n-grams up to length five with markers at both ends (so they hold prefixes,
suffixes and inner n-grams) and the whole word (the lexicon), hashed into a fixed table of weights for each
language. Transitions between the languages of neighbouring words are learned with them. Training maximises
the conditional likelihood of label sequences spliced from spans of labelled documents, so that languages
switch inside a sequence as they do in mixed text. Forward-backward over the whole text, whatever its length,
gives each word's language probabilities (``label_words`` returns them word by word); a document's language has the
largest mean, which is its score.

Bounds: about ``per_language`` documents of each language are learned from, picked by hash, and ``spans``
spans of their words. Prediction reads the text only.

A null text, or one without a letter, is ``und`` with score 1. Without labelled documents every text is
``und`` with score 0. Among languages of equal mean the one whose name is first in code points wins. Repeated rows are
predicted one by one; further columns, whatever their names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm._common import WORD, mix64, utf8, with_id
from courtside.llm._words import DROPPED, WordTable, joined, words_of

SLOTS = 1 << 17
LONGEST = 5
UNKNOWN = "und"
WORDS = re.compile(WORD)


def feature_slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Weight slots of every word's features, word after word, and where each word's begin."""
    flat, starts, lengths = joined(words, b"\x02", b"\x03")
    wide, size = flat.astype(np.uint64), lengths + 2
    word_of = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(flat)) - starts[word_of]
    parts, owners = [], []
    key = np.zeros(len(flat), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, LONGEST + 1):
            m = len(flat) - n + 1
            if m <= 0:
                break
            key = (key[:m] << np.uint64(8)) | wide[n - 1 :]
            inside = np.flatnonzero(place[:m] + n <= size[word_of[:m]])
            parts.append(mix64(key[inside] + np.uint64(n << 56)))
            owners.append(word_of[inside])
        whole = np.add.reduceat(mix64(wide + (place.astype(np.uint64) << np.uint64(16))), starts)
        parts.append(mix64(whole))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words))
    return (np.concatenate(parts)[order] % np.uint64(SLOTS)).astype(np.int64), np.cumsum(counts) - counts


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # SLOTS x languages
    transitions: np.ndarray  # log scores, from x to

    def words(self, words: list[bytes]) -> np.ndarray:
        """Unnormalised label scores of each word, the largest 1."""
        slots, starts = feature_slots(words)
        scores = np.add.reduceat(self.weights[slots], starts)
        return np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-20)

    def mean_marginals(self, rows: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
        """The mean over each text's words of the label probabilities by forward-backward; rows holds the scores of words."""
        lengths = np.array([len(t) for t in texts], np.int64)
        k = len(self.languages)
        out = np.zeros((len(texts), k))
        order = np.argsort(-lengths, kind="stable")
        order = order[: int((lengths > 0).sum())]
        if not len(order):
            return out
        words = np.concatenate([texts[i] for i in order])
        sizes = lengths[order]
        first = np.cumsum(sizes) - sizes
        active = len(order) - np.searchsorted(sizes[::-1], np.arange(1, sizes[0] + 1), side="left")
        step = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        ahead = np.empty((len(words), k), np.float32)
        alpha = rows[words[first]]
        alpha /= alpha.sum(1, keepdims=True)
        ahead[first] = alpha
        for t in range(1, sizes[0]):
            at = first[: active[t]] + t
            alpha = (alpha[: active[t]] @ step) * rows[words[at]]
            alpha /= alpha.sum(1, keepdims=True)
            ahead[at] = alpha
        total = np.zeros((len(order), k))
        beta = np.full((active[-1], k), 1 / k, np.float32)
        back = np.ascontiguousarray(step.T)
        for t in range(sizes[0] - 1, -1, -1):
            n = active[t]
            at = first[:n] + t
            if len(beta) < n:
                beta = np.concatenate([beta, np.full((n - len(beta), k), 1 / k, np.float32)])
            gamma = ahead[at] * beta
            total[:n] += gamma / gamma.sum(1, keepdims=True)
            beta = (beta * rows[words[at]]) @ back
            beta /= beta.sum(1, keepdims=True)
        out[order] = total / sizes[:, None]
        return out

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """The label probabilities of each word of one text, by forward-backward over all of them."""
        known: dict[bytes, int] = {}
        places = [known.setdefault(w, len(known)) for w in words]
        scores = self.words(list(known))[places].astype(float)
        step = np.exp(self.transitions - self.transitions.max())
        ahead, behind = np.empty_like(scores), np.ones_like(scores)
        for t, score in enumerate(scores):
            x = score if t == 0 else (ahead[t - 1] @ step) * score
            ahead[t] = x / x.sum()
        for t in range(len(scores) - 2, -1, -1):
            x = step @ (behind[t + 1] * scores[t + 1])
            behind[t] = x / x.sum()
        both = ahead * behind
        return both / both.sum(1, keepdims=True)

    def predict(self, table: WordTable, texts: list[bytes | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        means = self.mean_marginals(table.rows, found) if (found := table.index(texts)) and len(table.rows) else np.zeros((len(texts), len(self.languages)))
        out = []
        for text, mean in zip(texts, means):
            if not text or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
                out.append((UNKNOWN, 1.0))
            else:
                best = int(mean.argmax())
                out.append((self.languages[best], float(min(1.0, mean[best]))))
        return out


def spliced(spans: list[tuple[int, list[bytes]]], length: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Sequences of ``length`` words from shuffled spans: word numbers and labels, both sequences x length, and the words."""
    places: dict[bytes, int] = {}
    words, labels = [], []
    for i in random.permutation(len(spans)):
        label, part = spans[i]
        words += [places.setdefault(w, len(places)) for w in part]
        labels += [label] * len(part)
    n = len(words) // length * length
    return np.array(words[:n]).reshape(-1, length), np.array(labels[:n]).reshape(-1, length), list(places)


def fit(languages: list[str], spans: list[tuple[int, list[bytes]]], epochs: int = 5, length: int = 32, batch: int = 128, rate: float = 0.3, seed: int = 7) -> Field:
    """Weights and transitions by Adagrad on the exact gradient of the conditional log-likelihood."""
    random, k = np.random.default_rng(seed), len(languages)
    words, labels, vocabulary = spliced(spans, length, random)
    weights, hopes = np.zeros((SLOTS, k)), np.zeros((k, k))
    past, past_hopes = np.full((SLOTS, k), 1e-2), np.full((k, k), 1e-2)
    if not len(words):
        return Field(languages, weights.astype(np.float32), hopes)
    slots, starts = feature_slots(vocabulary)
    ends = np.append(starts[1:], len(slots))
    for _ in range(epochs):
        for rows in np.array_split(random.permutation(len(words)), max(1, len(words) // batch)):
            used, place = np.unique(words[rows], return_inverse=True)
            place = place.reshape(len(rows), length)
            sizes = ends[used] - starts[used]
            firsts = np.cumsum(sizes) - sizes
            mine = slots[np.arange(sizes.sum()) - np.repeat(firsts, sizes) + np.repeat(starts[used], sizes)]
            scores = np.add.reduceat(weights[mine], firsts)
            e = np.exp(scores - scores.max(1, keepdims=True))[place]
            a = np.exp(hopes - hopes.max())
            ahead, behind = np.empty_like(e), np.empty_like(e)
            ahead[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
            for t in range(1, length):
                x = (ahead[:, t - 1] @ a) * e[:, t]
                ahead[:, t] = x / x.sum(1, keepdims=True)
            behind[:, -1] = 1
            for t in range(length - 2, -1, -1):
                x = (behind[:, t + 1] * e[:, t + 1]) @ a.T
                behind[:, t] = x / x.sum(1, keepdims=True)
            gamma = ahead * behind
            gamma /= gamma.sum(2, keepdims=True)
            pairs = ahead[:, :-1, :, None] * a * (e * behind)[:, 1:, None, :]
            pairs /= pairs.sum((2, 3), keepdims=True)
            truth = np.eye(k)[labels[rows]]
            hope = np.einsum("btx,bty->xy", truth[:, :-1], truth[:, 1:]) - pairs.sum((0, 1))
            error = np.zeros((len(used), k))
            np.add.at(error, place, truth - gamma)
            spread = np.repeat(error, sizes, axis=0)
            slot, which = np.unique(mine, return_inverse=True)
            slope = np.stack([np.bincount(which, spread[:, j], len(slot)) for j in range(k)], 1) / len(rows) - 1e-5 * weights[slot]
            past[slot] += slope**2
            weights[slot] += rate * slope / np.sqrt(past[slot])
            hope = hope / len(rows)
            past_hopes += hope**2
            hopes += rate * hope / np.sqrt(past_hopes)
    return Field(languages, weights.astype(np.float32), hopes)


def train(docs: DataFrame, per_language: int = 300, spans: int = 12_000, longest_span: int = 12, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    """The field from a bounded sample of docs; every row with a language may be learned from."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.lower(text_col).alias("text"))
    counts = {r["lang"]: r["count"] for r in docs.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).count().collect()}
    languages = sorted(counts)
    if not languages:
        return Field([], np.zeros((SLOTS, 0), np.float32), np.zeros((0, 0)))
    shares = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, per_language / counts[name])))])
    spot = F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # Each picked document gives as many spans, at hashed places all over its text.
    each = max(1, spans // (per_language * len(languages)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for id_, lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                words = words_of(data)
                random = np.random.default_rng(abs(hash(id_)) % (1 << 32) if isinstance(id_, int) else len(words))
                for _ in range(each if words else 0):
                    at, n = random.integers(len(words)), random.integers(1, longest_span + 1)
                    langs.append(lang)
                    parts.append(b" ".join(words[at : at + n]))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "part"])

    picked = rows.filter(spot < F.element_at(shares, F.col("lang")))
    found = picked.mapInArrow(cut, "lang string, part binary").orderBy("lang", "part").toArrow()
    return fit(languages, [(languages.index(lang), part.split()) for lang, part in zip(found["lang"].to_pylist(), found["part"].to_pylist())])


def predict(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> id, lang_pred, score, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(shared.value.words) if shared.value.languages else None
        for batch in batches:
            found = shared.value.predict(table, utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"])

    named = docs.select(docs[id_col].alias("id"), F.lower(docs[text_col].cast("string")).alias("text"))
    return named.mapInArrow(run, with_id(named, "lang_pred string, score double")).withColumnRenamed("id", id_col)


def word_places(text: str) -> list[tuple[int, int, bytes]]:
    """Start and end, in code points, of every word that the model sees, and what it sees of it."""
    places = []
    for m in WORDS.finditer(text):
        seen = m[0].lower().encode().translate(None, DROPPED)
        if seen:
            places.append((m.start(), m.end(), seen))
    return places


def label_words(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> id, words array<struct<start, stop, lang, score>>: the language of every word of a text, as in code-switched text.

    A word's score is its label's probability by forward-backward over the whole text; words of digits and punctuation
    only have no label, and neither has any word without a field's languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                places = word_places(text or "") if shared.value.languages else []
                found = shared.value.marginals([w for *_, w in places]) if places else []
                out.append([{"start": a, "stop": b, "lang": shared.value.languages[int(p.argmax())], "score": float(p.max())} for (a, b, _), p in zip(places, found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["id", "words"])

    named = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return named.mapInArrow(run, with_id(named, "words array<struct<start:int,stop:int,lang:string,score:double>>")).withColumnRenamed("id", id_col)
