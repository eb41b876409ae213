"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself an entry takes its
rank from one probe and one comparison. Tier two encodes every other pre-token with a heap of candidate
merges over a linked list of its bytes, so a pre-token of n bytes costs O(n log n) however long it is.

Null texts are empty texts: no ids. Texts of any length are encoded whole; no special tokens exist. Repeated rows are
encoded one by one; columns besides id and text are left out, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from courtside.llm._common import column, with_id

#: Below this every letter is a letter in all versions of Unicode.
PLAIN = "\u0250"
#: Texts that one generation of a memo holds.
MEMO = 250_000
#: Fixed value: the pattern under which texts part at single spaces.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> list[bytes]:
    """The vocabulary file's entries in the order of their ranks; every rank from 0 occurs once."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    vocabulary = [b""] * len(pairs)
    for token, rank in pairs:
        vocabulary[int(rank)] = base64.b64decode(token)
    return vocabulary


class PerfectHash:
    """Minimal perfect hash by displacement: n keys fill n slots.

    A key's 64-bit hash picks a bucket; hashing it again with the bucket's seed moves all keys of the bucket
    to free slots, largest buckets first. Buckets of one key store their slot itself, as -slot - 1.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 3)
        groups: dict[int, list[int]] = {}
        for rank, key in enumerate(keys):
            groups.setdefault(xxhash.xxh3_64_intdigest(key) % self.buckets, []).append(rank)
        self.seeds = [0] * self.buckets
        self.slots = [-1] * n
        singles = []
        for bucket, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                singles.append((bucket, members[0]))
                continue
            seed = 1
            while len({s for rank in members if self.slots[s := xxhash.xxh3_64_intdigest(keys[rank], seed) % n] < 0}) < len(members):
                seed += 1
            self.seeds[bucket] = seed
            for rank in members:
                self.slots[xxhash.xxh3_64_intdigest(keys[rank], seed) % n] = rank
        free = (s for s, rank in enumerate(self.slots) if rank < 0)
        for (bucket, rank), slot in zip(singles, free):
            self.seeds[bucket] = -slot - 1
            self.slots[slot] = rank

    def rank(self, key: bytes) -> int:
        """The rank of a key of the table; some rank for any other bytes, so compare."""
        seed = self.seeds[xxhash.xxh3_64_intdigest(key) % self.buckets]
        return self.slots[-seed - 1 if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % self.n]


class Merges:
    """Byte-pair merging with a heap of candidate merges over linked bytes."""

    def __init__(self, vocabulary: list[bytes], ranks: dict[bytes, int]):
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        # The rank of every adjacent pair of entries that make an entry, by left id * width + right id.
        self.width, find = len(vocabulary), ranks.get
        halves = ((rank, find(token[:k]), find(token[k:])) for rank, token in enumerate(vocabulary) for k in range(1, len(token)))
        self.pairs = {left * self.width + right: rank for rank, left, right in halves if left is not None and right is not None}

    def ids(self, piece: bytes) -> list[int]:
        """Repeatedly join the adjacent pair of lowest rank, leftmost first.

        A heap entry is a rank and a start in one integer, so entries order by rank, then place; it is stale once
        the pair that begins at its start has another rank.
        """
        get, width, n = self.pairs.get, self.width, len(piece)
        shift = n.bit_length()
        place = (1 << shift) - 1
        ids = [self.bytes[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n))
        pair = [get(left * width + right, -1) for left, right in zip(ids, ids[1:])]
        heap = [rank << shift | i for i, rank in enumerate(pair) if rank >= 0]
        pair.append(-1)
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i, rank = entry & place, entry >> shift
            if pair[i] != rank:
                continue
            ids[i] = rank
            middle = after[i]
            after[i] = end = after[middle]
            pair[middle] = pair[i] = -1
            if end < n:
                before[end] = i
                if (joined := get(rank * width + ids[end], -1)) >= 0:
                    pair[i] = joined
                    heapq.heappush(heap, joined << shift | i)
            if i:
                j = before[i]
                pair[j] = joined = get(ids[j] * width + rank, -1)
                if joined >= 0:
                    heapq.heappush(heap, joined << shift | j)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out


class Memo(dict):
    """Text -> its ids as bytes, made when first asked for.

    Two generations of at most ``limit`` texts of at most ``longest`` characters: what is asked for again moves to
    the new one, and once that is full the old one goes. So frequent texts stay, however many rare ones pass by.
    """

    def __init__(self, make: Callable[[str], bytes], limit: int, longest: int):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest
        self.old: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text) or self.make(text)
        if len(text) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary.

    Under the pattern SPACED, texts part at every space between two other non-space characters: a pre-token never
    crosses such a space and always begins with it. So the parts, like the pre-tokens, come from memos. Under any
    other pattern only the pre-tokens do.
    """

    def __init__(self, vocabulary: list[bytes], pattern: str, limit: int = MEMO):
        self.vocabulary = vocabulary
        ranks = {token: rank for rank, token in enumerate(vocabulary)}
        self.hash, self.merges = PerfectHash(vocabulary), Merges(vocabulary, ranks)
        self.cut, self.spaced = regex.compile(pattern).findall, pattern == SPACED
        #: Ids are kept as machine integers, end to end: what a text has joins from what its parts have.
        self.kind = "H" if len(vocabulary) <= 1 << 16 else "I"
        self.pieces, self.parts = Memo(self.piece, limit, 64), Memo(self.part, limit, 32)

    def piece(self, text: str) -> bytes:
        """The ids of a pre-token."""
        if text[0] == " " and (known := self.parts.get(text[1:])):
            return known
        data = text.encode()
        rank = self.hash.rank(data)
        return array(self.kind, (rank,) if self.vocabulary[rank] == data else self.merges.ids(data)).tobytes()

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def part(self, text: str) -> bytes:
        """The ids of a space and the part after it; a part with white space at an end raises."""
        if text.isalpha() and max(text) < PLAIN:  # one pre-token
            return self.piece(" " + text)
        if not text or text[0].isspace() or text[-1].isspace():
            raise ValueError(text)
        return self.plain(" " + text)

    def packed(self, text: str) -> bytes:
        first, *rest = text.split(" ") if self.spaced else [text]
        if not self.spaced or not first or first[-1].isspace():
            return self.plain(text)
        try:
            return self.plain(first) + b"".join(map(self.parts.__getitem__, rest))
        except ValueError:
            return self.plain(text)

    def encode(self, text: str) -> list[int]:
        return memoryview(self.packed(text)).cast(self.kind).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def forget(self) -> None:
        """Empty the memos: a worker that goes on to other work keeps the vocabulary only."""
        for memo in (self.pieces, self.parts):
            memo.clear()
            memo.old = {}


@contextmanager
def at_work(vocabulary, pattern: str, memo: int = MEMO) -> Iterator[Codec]:
    """A codec for one task. What it makes has no cycles, so their collector rests meanwhile; its memos go afterwards."""
    coder = codec(vocabulary, pattern, memo)
    gc.disable()
    try:
        yield coder
    finally:
        gc.enable()
        coder.forget()
        pa.default_memory_pool().release_unused()


_codecs: dict[tuple[str, str, int], Codec] = {}


def codec(vocabulary, pattern: str, memo: int = MEMO) -> Codec:
    """One codec per worker process; ``vocabulary`` is a broadcast of the entries (the file's size bounds it)."""
    key = (str(vocabulary.id if hasattr(vocabulary, "id") else id(vocabulary)), pattern, memo)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary.value, pattern, memo)
    return _codecs[key]


def _named(docs: DataFrame, id_col: str, name: str, kind: str) -> DataFrame:
    return docs.select(column(docs, id_col).alias("id"), column(docs, name).cast(kind).alias("x"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> id, ids array<int>. ``path``: the rank file, read by the driver and broadcast (its size is fixed)."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    named = _named(docs, id_col, text_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with at_work(shared, pattern) as coder:
            for batch in batches:
                packed = [coder.packed(x.as_py() or "") for x in batch.column(1)]
                flat = np.frombuffer(b"".join(packed), coder.kind).astype(np.int32)
                ends = np.cumsum([0, *(len(x) // array(coder.kind).itemsize for x in packed)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    return named.mapInArrow(run, with_id(named, "ids array<int>")).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ids -> id, data binary. Null ids are no ids; an id outside the vocabulary raises."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(path))
    named = _named(encoded, id_col, ids_col, "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = shared.value.__getitem__
        for batch in batches:
            data = [b"".join(map(entry, x or ())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["id", "data"])

    return named.mapInArrow(run, with_id(named, "data binary")).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO) -> DataFrame:
    """docs -> id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass, keeping digests only. ``memo``: texts that one generation of a memo holds."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    named = _named(docs, id_col, text_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with at_work(shared, pattern, memo) as coder:
            decimals = list(map(str, range(len(coder.vocabulary))))
            for batch in batches:
                counts, of_ids, of_data = [], [], []
                for text in batch.column(1):
                    ids = coder.encode(text.as_py() or "")
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(decimals.__getitem__, ids)).encode()).hexdigest())
                    of_data.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_data, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return named.mapInArrow(run, with_id(named, "n_tokens long, ids_sha256 string, decoded_sha256 string")).withColumnRenamed("id", id_col)
