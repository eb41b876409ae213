"""Exact top-k search by inner product over an impact-ordered score-at-a-time index.

Vectors become integers, floor(scale * x). Rows are dealt to blocks of about ``block`` vectors; each block's
index holds, for every dimension, posting segments of the rows whose quantised value (value // step) is the
same. A query's segments are processed by descending impact, the gain of a segment over the dimension's least
one. After some segments every row has a lower and an upper bound; processing stops only when the k-th best
lower bound proves which rows can still be members, and those few are rescored exactly. Blocks return their
own best k, which merge to the query's.

Rows lie in a partition block by block, each block's vectors before the queries, which every block gets a copy of.
So a task holds one block's index and one batch of queries, builds every index once, and streams the queries past it.

Vectors that are null, or hold null or non-finite components, take no part. A query's own row is every row of
its id; repeated rows are rows of their own, as candidates and as queries; vectors of another length than the query's,
and empty ones, have no score with it. Ties go to the smaller id. Components of any finite size count: where the
products of a block could pass 64 bits, its index holds Python's integers instead, and a result whose score no long
can hold raises. Further columns, whatever their names, are left out. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructField, StructType

from courtside.llm._common import materialize

#: Bits that a score may take in 64-bit arithmetic; the largest score that leaves a block.
BITS, WIDEST = 62, 10**38 - 1


def usable(vector: Column) -> Column:
    """The vector as doubles; null for one that takes no part."""
    numbers = vector.cast("array<double>")
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite & (F.size(numbers) > 0), numbers)


def quantised(numbers: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), x as double: int64, or Python's integers where a score of such vectors could pass 64 bits."""
    with np.errstate(over="ignore"):
        product = np.floor(numbers * float(scale))
    largest = float(np.abs(product).max(initial=0))
    if largest * largest * numbers.shape[1] < 2.0**BITS:
        return product.astype(np.int64)
    # A double of 2**53 or more is an integer, so its product is exact among integers.
    exact = [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in numbers.ravel().tolist()]
    return np.array(exact, object).reshape(numbers.shape)


class ImpactIndex:
    """One block: rows x dimensions integers, and each dimension's segments of equal quantised value."""

    def __init__(self, vectors: np.ndarray, step: int):
        self.vectors, self.step = vectors, step
        levels = vectors // step
        dims, values, rows = [], [], []
        for d in range(vectors.shape[1]):
            order = np.argsort(levels[:, d], kind="stable")
            found, starts = np.unique(levels[order, d], return_index=True)
            dims += [d] * len(found)
            values += found.tolist()
            rows += np.split(order, starts[1:])
        self.dims, self.levels, self.rows = np.array(dims), np.array(values, vectors.dtype), rows
        #: Segments of all searches so far, and how many of them were processed before the proof.
        self.segments = self.processed = 0
        self.sizes = np.array(list(map(len, rows)))

    def search(self, query: np.ndarray, k: int, own: np.ndarray, check_every: int = 256, enough: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores that contain the block's k best; ``own`` marks rows that take no part."""
        n = len(self.vectors)
        impact = query[self.dims] * self.levels * self.step
        least = np.array([impact[self.dims == d].min() for d in range(len(query))], impact.dtype)
        gain = impact - least[self.dims]
        order = np.argsort(-gain, kind="stable")
        self.segments += len(order)
        # Beyond its quantised value a component adds up to step - 1 times the query's weight, of either sign.
        slack_low, slack_high = np.minimum(query, 0).sum() * (self.step - 1), np.maximum(query, 0).sum() * (self.step - 1)
        score = np.full(n, least.sum(), impact.dtype)
        score[own] = -(1 << BITS) if impact.dtype != object else -(1 << 4096)
        # What a row can still gain: the largest unprocessed gain of each dimension.
        by_dim = [gain[order[self.dims[order] == d]] for d in range(len(query))]
        done = np.zeros(len(query), int)
        take = min(k, n)
        # Once a quarter of the rows is possible, scoring these exactly costs less than further segments.
        enough = max(64, n // 4) if enough is None else enough
        # Segments are taken in runs of ``check_every`` by descending gain; each run ends with a test for the proof.
        for at in range(0, len(order), check_every):
            run = order[at : at + check_every]
            np.add.at(score, np.concatenate([self.rows[s] for s in run]), np.repeat(gain[run], self.sizes[run]))
            np.add.at(done, self.dims[run], 1)
            self.processed += len(run)
            rest = sum(int(g[x]) for g, x in zip(by_dim, done) if x < len(g))
            bar = np.partition(score, n - take)[n - take] + slack_low
            members = np.flatnonzero(score + rest + slack_high >= bar)
            if len(members) <= max(enough, take):
                break
        members = members[~own[members]]
        return members, self.vectors[members] @ query


class Block:
    """The vectors of one block: an index for each length of vector."""

    def __init__(self, ids: list, vectors: list[np.ndarray], scale: int, step: int):
        self.scale, self.step = scale, step
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.array([len(v) for v in vectors], int)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            held = np.empty(len(rows), object)
            held[:] = [ids[i] for i in rows]
            self.groups[int(size)] = held, np.stack([vectors[i] for i in rows])
        self.indexes: dict[tuple[int, bool], ImpactIndex] = {}

    def index(self, size: int, query: np.ndarray) -> tuple[ImpactIndex, np.ndarray]:
        """The index of the query's length, and the query's integers; both of Python's where 64 bits may not do."""
        numbers = self.groups[size][1]
        wide = (size, True)
        with np.errstate(over="ignore"):
            large = float(np.abs(query).max()) * float(np.abs(numbers).max()) * self.scale**2 * size >= 2.0**BITS / 4
        if not large and (size, False) not in self.indexes:
            rows = quantised(numbers, self.scale)
            self.indexes[wide if rows.dtype == object else (size, False)] = ImpactIndex(rows, self.step)
        key = (size, False) if not large and (size, False) in self.indexes else wide
        if key not in self.indexes:
            self.indexes[key] = ImpactIndex(quantised(numbers, self.scale).astype(object), self.step)
        integers = quantised(query[None], self.scale)[0]
        if key == wide:
            return self.indexes[key], integers.astype(object)
        if integers.dtype == object:  # alone it could overflow, with these vectors it cannot
            integers = integers.astype(np.int64)
        return self.indexes[key], integers

    def best(self, query_id, query: np.ndarray, k: int) -> list[tuple]:
        """(query_id, vec_id, score) of the block's k best for a query."""
        if len(query) not in self.groups:
            return []
        index, integers = self.index(len(query), query)
        ids = self.groups[len(query)][0]
        found, scores = index.search(integers, k, ids == query_id)
        top = sorted(zip((-scores).tolist(), ids[found].tolist()))[:k]
        return [(query_id, vec_id, Decimal(max(-WIDEST, min(WIDEST, -score)))) for score, vec_id in top]


def _search(k: int, scale: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (vb, asked, id, v) in order: a block's vectors, then all queries."""
        number, block, ids, vectors = None, None, [], []
        for batch in batches:
            out: list[tuple] = []
            flat = batch.column(3)
            for i, (vb, asked, id_) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if vb != number:
                    number, block, ids, vectors = vb, None, [], []
                v = flat[i].values.to_numpy(zero_copy_only=False)
                if not asked:
                    ids.append(id_)
                    vectors.append(v.copy())
                    continue
                if block is None:
                    block, ids, vectors = Block(ids, vectors, scale, step), [], []
                out += block.best(id_, v, k)
            kind = batch.schema.field("id").type
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], kind), pa.array(columns[2], pa.decimal128(38, 0))], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, step: int = 32, block: int = 1 << 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best rows (all, if fewer). ``block``: components of one block's vectors, about."""

    def rows_of(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(df[id_col].alias("id"), usable(df[vector_col]).alias("v")).filter("id is not null and v is not null")
        return materialize(rows, name)

    data, asked = rows_of(vectors, "vectors"), rows_of(queries, "queries")
    blocks = max(1, -(-(data.agg(F.sum(F.size("v"))).first()[0] or 0) // block))
    # Rows of the written table are dealt evenly, so that equal rows don't meet in one block.
    data = data.select(F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int").alias("vb"), F.lit(False).alias("asked"), "id", "v")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("vb"), F.lit(True).alias("asked"), "id", "v")
    both = data.unionByName(asked).repartition("vb").sortWithinPartitions("vb", "asked")
    id_type = data.schema["id"].dataType
    best = both.mapInArrow(_search(k, scale, step), StructType([StructField("query_id", id_type), StructField("vec_id", id_type), StructField("score", DecimalType(38, 0))]))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    top = best.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
    fits = F.col("score").between(F.lit(-(1 << 63)), F.lit((1 << 63) - 1))
    return top.withColumn("score", F.when(fits, F.col("score").cast("long")).otherwise(F.raise_error(F.concat(F.lit("a score does not fit a long: "), F.col("score").cast("string"))).cast("long")))
