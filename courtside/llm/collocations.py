"""Phrases whose words keep together: n-grams of 2 to 5 words counted without loss in counting quotient filters.

Words are counted first, by language. Those with ``least`` occurrences or more get ids, for no candidate holds a rarer one.
A second pass counts the pairs of such words, a third one the runs of 3 to 5 of them whose pairs are
all frequent, for no candidate holds a rarer pair. The ids of a run are packed into one number, which is permuted invertibly
(a Feistel network over its two halves), so that any text spreads evenly: the top bits are its bucket, the next the
quotient, and all that is left the remainder. A filter holds a bucket's numbers in order, as a run length for each quotient, the remainders and the
counts, and nothing is lost, as quotient and remainder give the number back. Each task keeps one run of sorted numbers of at
most ``held``, and sends it off by buckets when it is full; the sorted filters of a bucket merge in one task, which passes
on what reached ``least``. The number of buckets follows the number of words, so that a filter's size doesn't.

Every phrase is one number in one bucket, and is counted before it moves, so frequent words, lines and copies are no hot
groups. The words of a text get their ids from a broadcast dictionary while its size allows; beyond that each chunk of texts
is joined with a dictionary of its own words. Which pairs are frequent is a broadcast table of bits, of ``broadcast_bytes``
at most: where pairs share a bit, runs are counted that turn out too rare, and nothing else changes.

Null texts are empty; null languages are "und"; texts of any length are counted whole; repeated rows count as often as they
occur; ties in rank go to the phrase that is first in UTF-8; an empty table gives an empty result; further columns
do not matter. More than 2**25 frequent words in all don't fit the packed numbers and raise.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm._common import BROADCAST_BYTES, column, materialize, mix64, utf8
from courtside.operators.ranking import numbered

LONGEST = 5
#: Pieces end at these; the words of a piece lie between blanks and tabs.
STOPS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + STOPS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(STOPS) + b" ")
ROUNDS = 4


def tokens(text: bytes) -> list[bytes]:
    """The words of a text in order, a newline at each piece's end; empty ones are no words."""
    return text.translate(_FOLD).replace(b"\n", b" \n ").split(b" ")


# ---- packed numbers and filters -------------------------------------------------------------------------------


class Packing:
    """n-grams of up to ``longest`` ids of ``bits`` bits as two halves of a number, permuted and back."""

    def __init__(self, bits: int, longest: int = LONGEST):
        if bits * LONGEST > 128:
            raise ValueError("too many frequent words for the packed numbers")
        self.bits, self.longest, self.half = bits, longest, max(1, -(-bits * longest // 2))
        self.mask = np.uint64((1 << self.half) - 1)

    def packed(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The first id in the lowest bits; fewer than the longest leave zeros, and no word has id 0."""
        left, right = np.zeros(len(ids[0]), np.uint64), np.zeros(len(ids[0]), np.uint64)
        for j, each in enumerate(ids):
            at = j * self.bits
            if at < self.half:
                right |= (each << np.uint64(at)) & self.mask
                if at + self.bits > self.half:
                    left |= each >> np.uint64(self.half - at)
            else:
                left |= each << np.uint64(at - self.half)
        return left, right

    def unpacked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """One row of ids a number."""
        out = np.zeros((len(left), self.longest), np.int64)
        ones = np.uint64((1 << self.bits) - 1)
        for j in range(self.longest):
            at = j * self.bits
            if at < self.half:
                value = right >> np.uint64(at)
                if at + self.bits > self.half:
                    value = value | (left << np.uint64(self.half - at))
            else:
                value = left >> np.uint64(at - self.half)
            out[:, j] = (value & ones).astype(np.int64)
        return out

    def _round(self, half: np.ndarray, number: int) -> np.ndarray:
        return mix64(half + np.uint64(0x9E3779B97F4A7C15 * (number + 1) % (1 << 64))) & self.mask

    def permuted(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            for i in range(ROUNDS):
                left, right = right, left ^ self._round(right, i)
        return left, right

    def restored(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            for i in reversed(range(ROUNDS)):
                left, right = right ^ self._round(left, i), left
        return left, right


def summed(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers in order, each once, with the sums of their counts (1 each, if none are given)."""
    if not len(left):
        return left, right, np.zeros(0, np.int64)
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    totals = np.diff(np.append(first, len(left))) if counts is None else np.add.reduceat(counts[order], first)
    return left[first], right[first], totals


def filter_bytes(left: np.ndarray, right: np.ndarray, counts: np.ndarray, half: int, skip: int) -> bytes:
    """One counting quotient filter of numbers in order whose first ``skip`` bits are the same.

    Head (numbers, quotient bits), the run length of each quotient, the remainders and the counts, the last two in as few
    whole bytes as the largest needs.
    """
    quotient_bits = min(half - skip, max(0, len(left).bit_length() - 1))
    low_bits = half - skip - quotient_bits
    quotients = (left >> np.uint64(low_bits)) & np.uint64((1 << quotient_bits) - 1)
    runs = np.bincount(quotients.astype(np.int64), minlength=1 << quotient_bits).astype("<u4")
    over = left & np.uint64((1 << low_bits) - 1)
    run_bytes = 1 if runs.max(initial=0) < 256 else 4
    parts = [np.array([len(left), quotient_bits, run_bytes], "<u4").tobytes(), _narrow(runs.astype(np.uint64), run_bytes)]
    parts += [_narrow(over, -(-low_bits // 8)), _narrow(right, -(-half // 8))]
    count_bytes = max(1, -(-int(counts.max(initial=0)).bit_length() // 8))
    return b"".join([*parts, bytes([count_bytes]), _narrow(counts.astype(np.uint64), count_bytes)])


def _narrow(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data[: n * width], np.uint8).reshape(n, width)
    return out.view("<u8").ravel().astype(np.uint64)


def filter_numbers(data: bytes, half: int, skip: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers and counts of a filter whose numbers begin with ``prefix``."""
    view = memoryview(data)
    n, quotient_bits, run_bytes = np.frombuffer(view[:12], "<u4").tolist()
    low_bits, at = half - skip - quotient_bits, 12
    runs = _wide(view[at:], 1 << quotient_bits, run_bytes)
    at += run_bytes << quotient_bits
    over = _wide(view[at:], n, -(-low_bits // 8))
    at += n * -(-low_bits // 8)
    right = _wide(view[at:], n, -(-half // 8))
    at += n * -(-half // 8)
    counts = _wide(view[at + 1 :], n, view[at]).astype(np.int64)
    quotients = np.repeat(np.arange(1 << quotient_bits, dtype=np.uint64), runs.astype(np.int64))
    top = (np.uint64(prefix) << np.uint64(half - skip)) if skip else np.uint64(0)
    return top | (quotients << np.uint64(low_bits)) | over, right, counts


# ---- passes over the texts ------------------------------------------------------------------------------------


def _word_counts(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lang, word, n of a task; at most ``held`` words before some are sent off."""
        counts: dict[str, Counter] = defaultdict(Counter)

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, counter in counts.items():
                counter.pop(b"", None)
                counter.pop(b"\n", None)
                if counter:
                    words = pa.array(list(counter.keys()), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words.cast(pa.string()), pa.array(list(counter.values()), pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for i, (lang, text) in enumerate(zip(batch.column(0).to_pylist(), utf8(batch.column(1)))):
                counts[lang].update(tokens(text))
                if i % 64 == 0 and sum(map(len, counts.values())) > held:
                    yield from sent()
        yield from sent()

    return run


class Pairs:
    """Which pairs of ids may be frequent: one bit for each hash."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table, self.shift = bits, table, np.uint64(64 - (8 * len(table)).bit_length() + 1)

    @staticmethod
    def spots(bits: int, shift: np.uint64, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return mix64((first << np.uint64(bits)) | second) >> shift

    def frequent(self, row: np.ndarray) -> np.ndarray:
        """Whether each id and the next may be a frequent pair."""
        out = np.zeros(len(row), bool)
        at = np.flatnonzero((row[:-1] != 0) & (row[1:] != 0))
        spots = self.spots(self.bits, self.shift, row[at], row[at + 1])
        out[at] = (self.table[(spots >> np.uint64(3)).astype(np.int64)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1
        return out


@dataclass(frozen=True)
class Plan:
    """One pass: runs of ``shortest`` words to the packing's longest, in so many buckets, ``held`` in a task."""

    packing: Packing
    shortest: int
    bucket_bits: int
    held: int


class Counts:
    """A task's n-grams: sorted numbers with counts, sent off as one filter a bucket when there are ``held``."""

    def __init__(self, plan: Plan, pairs: np.ndarray | None = None):
        self.packing, self.bucket_bits, self.held, self.shortest = plan.packing, plan.bucket_bits, plan.held, plan.shortest
        self.pairs = None if pairs is None else Pairs(plan.packing.bits, pairs)
        self.sorted: list[tuple] = []
        self.fresh: list[np.ndarray] = []
        self.waiting = 0

    def add(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The ids of a text, 0 where a run of frequent words ends."""
        self.fresh.append(ids)
        self.waiting += len(ids) + 1
        if self.waiting >= self.held // 16:
            yield from self._sort()

    def _sort(self) -> Iterator[pa.RecordBatch]:
        gap = np.zeros(1, np.uint64)
        row = np.concatenate([x for ids in self.fresh for x in (ids, gap)] or [gap])
        self.fresh, self.waiting = [], 0
        # A very long text alone can hold more than is wanted at once; slices overlap by four places.
        step = max(1, self.held // 8)
        for i in range(0, len(row), step):
            self._take(row[i : i + step + LONGEST - 1], min(step, len(row) - i))
            if sum(len(x[0]) for x in self.sorted) >= self.held:
                self._merge()
                if len(self.sorted[0][0]) >= self.held // 2:
                    yield from self.sent()

    def _take(self, row: np.ndarray, starts: int) -> None:
        """All runs that begin at the first ``starts`` places and have words, or frequent pairs, only."""
        linked = self.pairs.frequent(row) if self.pairs else np.append((row[:-1] != 0) & (row[1:] != 0), False)
        begins, parts = np.flatnonzero(row[:starts]), []
        for m in range(2, self.packing.longest + 1):
            begins = begins[linked[np.minimum(begins + m - 2, len(row) - 1)] & (begins + m - 2 < len(row))]
            if m >= self.shortest:
                parts.append(self.packing.permuted(*self.packing.packed([row[begins + j] for j in range(m)])))
        self.sorted.append(summed(*(np.concatenate(x) for x in zip(*parts))))

    def _merge(self) -> None:
        if len(self.sorted) > 1:
            self.sorted = [summed(*(np.concatenate(x) for x in zip(*self.sorted)))]

    def sent(self) -> Iterator[pa.RecordBatch]:
        """Everything held, a filter a bucket."""
        if self.fresh:
            yield from self._sort()
        self._merge()
        if self.sorted and len(self.sorted[0][0]):
            (left, right, counts), half = self.sorted[0], self.packing.half
            buckets = (left >> np.uint64(half - self.bucket_bits)).astype(np.int64)
            numbers, starts = np.unique(buckets, return_index=True)
            blobs = [filter_bytes(left[a:b], right[a:b], counts[a:b], half, self.bucket_bits) for a, b in zip(starts, [*starts[1:], len(left)])]
            yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "filter"])
        self.sorted = []


def _ids(text: bytes, known: Callable) -> np.ndarray:
    """Ids of the words of a text: 0 at rare words and ends of pieces."""
    words = tokens(text)
    ids = np.fromiter((known(w, 0) for w in words), np.int64, len(words))
    return ids[ids >= 0].astype(np.uint64)


def _filters(plan: Plan, shared, pairs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(plan, pairs and pairs.value)
        known = {lang: dict(zip(words, ids)) | {b"": -1} for lang, (words, ids) in shared.value.items()}
        nothing = {b"": -1}.get
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                yield from counts.add(_ids(text, known[lang].get if lang in known else nothing))
        yield from counts.sent()

    return run


def _chunked(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts in chunks of about ``chunk_bytes``, one row each: chunk, langs, texts and their distinct (lang, word)."""
        held: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            words: dict[str, set] = defaultdict(set)
            for lang, text in held:
                words[lang].update(tokens(text))
            pairs = [{"lang": lang, "word": w.decode()} for lang, found in words.items() for w in found - {b"", b"\n"}]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("word", pa.string())]))
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([[x[0] for x in held]], pa.list_(pa.string())), pa.array([[x[1].decode() for x in held]], pa.list_(pa.string())), pa.array([pairs], kind)], ["chunk", "langs", "texts", "words"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                held.append((lang, text))
                size += len(text)
                if size >= chunk_bytes:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    return run


def _chunk_filters(plan: Plan, pairs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks with the ids of their own words."""
        counts = Counts(plan, pairs and pairs.value)
        for batch in batches:
            for langs, texts, words in zip(*(batch.column(c).to_pylist() for c in range(3))):
                known: dict[str, dict] = {}
                for w in words or []:
                    known.setdefault(w["lang"], {b"": -1})[w["word"].encode()] = w["id"]
                for lang, text in zip(langs, texts):
                    yield from counts.add(_ids(text.encode(), known.get(lang, {b"": -1}).get))
        yield from counts.sent()

    return run


def _merged(plan: Plan, least: int):
    packing, bucket_bits = plan.packing, plan.bucket_bits

    def run(rows: pa.Table) -> pa.Table:
        """One bucket's filters, merged pair by pair; the numbers that reached ``least``."""
        prefix = rows.column("bucket")[0].as_py()
        parts = [filter_numbers(x, packing.half, bucket_bits, prefix) for x in rows.column("filter").to_pylist()]
        while len(parts) > 1:
            parts = [summed(*(np.concatenate(x) for x in zip(*parts[i : i + 8]))) for i in range(0, len(parts), 8)]
        left, right, counts = parts[0]
        kept = counts >= least
        ids = packing.unpacked(*packing.restored(left[kept], right[kept]))
        return pa.table({"ids": pa.array([[i for i in r if i] for r in ids.tolist()], pa.list_(pa.int64())), "a": pa.array(counts[kept])})

    return run


BLOCK_BITS = 19


def _spots(bits: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).flatten().to_numpy().astype(np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(Pairs.spots(bits, np.uint64(shift), ids[:, 0], ids[:, 1]).astype(np.int64))], ["spot"])

    return run


def _block(rows: pa.Table) -> pa.Table:
    """The bits of one block of the table of pairs."""
    spots = rows.column("spot").to_numpy()
    marked = np.zeros(1 << BLOCK_BITS, np.uint8)
    marked[spots & ((1 << BLOCK_BITS) - 1)] = 1
    return pa.table({"block": pa.array([int(spots[0]) >> BLOCK_BITS]), "marks": pa.array([np.packbits(marked, bitorder="little").tobytes()], pa.binary())})


def pair_table(pairs: DataFrame, bits: int, most_bytes: int) -> np.ndarray:
    """The bits of the frequent pairs (ids): sixteen a pair, ``most_bytes`` at most, made by blocks."""
    n = pairs.count()
    log = min(max(BLOCK_BITS, (16 * n).bit_length()), max(BLOCK_BITS, (8 * most_bytes).bit_length() - 1))
    table = np.zeros(1 << (log - 3), np.uint8)
    spots = pairs.select("ids").mapInArrow(_spots(bits, 64 - log), "spot long")
    for r in spots.groupBy(F.shiftright("spot", BLOCK_BITS)).applyInArrow(_block, "block long, marks binary").toLocalIterator():
        start = r["block"] << (BLOCK_BITS - 3)
        table[start : start + (1 << (BLOCK_BITS - 3))] = np.frombuffer(r["marks"], np.uint8)
    return table


# ---- counts, scores and ranks ---------------------------------------------------------------------------------


def phrase_counts(docs: DataFrame, least: int = 100, held: int = 1 << 21, broadcast_bytes: int = BROADCAST_BYTES, chunk_bytes: int = 4 << 20, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Totals (lang, n), words (id, lang, word, f) and phrases of 2 to 5 words (ids, a) with ``least`` occurrences or more."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(column(docs, lang_col).cast("string"), F.lit("und")).alias("lang"), column(docs, text_col).cast("string").alias("text")).filter("text is not null")
    each = texts.mapInArrow(_word_counts(held // 4), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    # Rare words count towards the totals and go no further.
    frequent = F.col("f") >= least
    split = materialize(each.groupBy("lang", F.when(frequent, F.col("word")).alias("word")).agg(F.sum("f").alias("f")), "word-counts")
    totals = materialize(split.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
    words = materialize(numbered(split.filter("word is not null"), ["lang", "word"]).select((F.col("place") + 1).alias("id"), "lang", "word", "f"), "words")
    n, frequent_words, size = (totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], *words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word") + 64), F.lit(0))).first())
    bits = max(1, frequent_words.bit_length())

    def plan(shortest: int, longest: int) -> Plan:
        """Every word begins at most one run of each length; a bucket gets about two million of them."""
        packing = Packing(bits, longest)
        return Plan(packing, shortest, min(packing.half, 20, max(6, (n * (longest - shortest + 1) >> 21).bit_length())), held)

    kind = "bucket int, filter binary"
    if size <= broadcast_bytes:
        known: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
        for r in words.select("lang", "word", "id").toLocalIterator():  # broadcast_bytes at most
            known[r["lang"]][0].append(r["word"].encode())
            known[r["lang"]][1].append(r["id"])
        shared = spark.sparkContext.broadcast(dict(known))
        filters = lambda p, pairs: texts.mapInArrow(_filters(p, shared, pairs), kind)
    else:
        chunks = materialize(texts.mapInArrow(_chunked(chunk_bytes), "chunk string, langs array<string>, texts array<string>, words array<struct<lang: string, word: string>>"), "chunks")
        own = chunks.select("chunk", F.inline("words")).join(words.select("lang", "word", "id"), ["lang", "word"])
        own = materialize(own.groupBy("chunk").agg(F.collect_list(F.struct("lang", "word", "id")).alias("words")), "chunk-words")
        filters = lambda p, pairs: chunks.select("chunk", "langs", "texts").join(own, "chunk").select("langs", "texts", "words").mapInArrow(_chunk_filters(p, pairs), kind)

    def counted(p: Plan, pairs, tag: str) -> DataFrame:
        return materialize(filters(p, pairs).groupBy("bucket").applyInArrow(_merged(p, least), "ids array<bigint>, a long"), tag)

    pairs = counted(plan(2, 2), None, "pairs")
    longer = counted(plan(3, LONGEST), spark.sparkContext.broadcast(pair_table(pairs, bits, broadcast_bytes)), "runs")
    return totals, words, pairs.unionByName(longer)


def collocations(docs: DataFrame, least: int = 100, inside: int = 100, top: int = 2000, **options) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score of each language's ``top`` phrases, by the lowest score over their cuts.

    A phrase goes whose words lie inside a longer one that makes up ``inside`` of its hundredths or more. ``options`` are
    those of phrase_counts.
    """
    totals, words, phrases = phrase_counts(docs, least, **options)
    counted = phrases.select("ids", F.col("a").alias("f")).unionByName(words.select(F.array("id").alias("ids"), "f"))
    size = F.size("ids")
    # Longer candidates tell the phrases inside them how often they occur.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("ids", i, m))))
    longer = phrases.filter(size > 2).select(F.explode(spans).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer"))
    kept = phrases.join(longer, "ids", "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside)).drop("longer")
    first = words.select(F.col("id").alias("head"), "lang")
    kept = kept.withColumn("head", F.get("ids", F.lit(0))).join(first, "head").join(totals, "lang").drop("head")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"before": F.slice("ids", F.lit(1), F.col("k")), "after": F.slice("ids", F.col("k") + 1, size)})
    cuts = cuts.join(counted.select(F.col("ids").alias("before"), F.col("f").alias("l")), "before").join(counted.select(F.col("ids").alias("after"), F.col("f").alias("r")), "after")
    score = F.expr("cast(1000 * cast(a as decimal(38, 0)) * n as decimal(38, 0)) div cast(cast(l as decimal(38, 0)) * r as decimal(38, 0))")
    scored = cuts.select("lang", "ids", "a", "n", "k", "l", "r", score.alias("score"))
    lowest = scored.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "ids", "a", "n", "cut.l", "cut.r", "cut.score")

    spelt = lowest.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id").groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("parts"))
    named = lowest.join(spelt.select("ids", F.array_join(F.col("parts.word"), " ").alias("phrase")), "ids")
    # Each language's best of 64 parts come first, so that no language is ranked in one piece.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    parted = named.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
