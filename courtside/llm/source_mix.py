"""Mixing sources to target weights by subset-sum budget fitting.

Sources get a share of all words by weight, never over ``max_repeats`` times their own size. A source
first repeats whole, then fits the rest of its budget: documents are counted by exact length, every
length gives its proportional number, and a bounded-knapsack dynamic programme closes what remains.
Which documents of a length are taken follows a seeded hash.

Only the histogram of lengths of one source (one row per distinct length, summed before the shuffle)
meets in a task; the choice of documents ranks inside hash ranges of about ``range_rows`` rows, so a
source or a length that holds a third of all documents spreads over many tasks.

Null and blank texts have size 0 and only follow the whole repeats; null sources are one source, placed
last; an empty table gives an empty result; repeated rows count as documents of their own; texts of any length are
counted whole; documents of equal hash are taken by id, and equal ones in any order, which changes no result; further columns,
whatever their names, are left out, or kept as they are where whole rows are asked for. Memory of one source's programme is bounded by its distinct lengths and ``dp_limit`` sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm._common import WORD, column, materialize

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """source, source_size -> target: weights repeat over the sources by code point, null last.

    With caps c and weights w the shared level is the largest (total - capped before) / (weight left) in
    the order of c / w; a target is min(c, level * w). One row per source passes through the windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("w"), (F.lit(float(max_repeats)) * F.col("source_size")).alias("cap"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    return rows.withColumn("level", level).select("source", "source_size", F.least("cap", F.max("level").over(everything) * F.col("w")).alias("target"))


def fit_budget(lengths: list[int], counts: list[int], budget: int, dp_limit: int = 1 << 16) -> list[int]:
    """How many documents of each length to take so that their lengths sum as near to ``budget`` as the programme can."""
    total = sum(n * m for n, m in zip(lengths, counts))
    if budget <= 0 or total <= 0:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    take = [m * budget // total for m in counts]
    left = budget - sum(n * k for n, k in zip(lengths, take))
    # One more of each length, those with the largest lost fraction first, down to what the programme closes.
    for i in sorted(range(len(lengths)), key=lambda i: (-(counts[i] * budget % total), lengths[i])):
        if left <= dp_limit:
            break
        if 0 < lengths[i] <= left and take[i] < counts[i]:
            take[i] += 1
            left -= lengths[i]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if left > dp_limit and lengths[i]:
            more = min(counts[i] - take[i], (left - dp_limit) // lengths[i])
            take[i] += more
            left -= more * lengths[i]
    # Give some back, shortest lengths first, so that the programme has room to choose.
    back = True
    while back:
        back = False
        for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
            if lengths[i] and take[i] and left + lengths[i] <= dp_limit:
                take[i] -= 1
                left += lengths[i]
                back = True
    # Bounded knapsack: bit s of a mask says that the sum s can be reached; counts split into powers of two.
    top, parts = left + dp_limit, []
    for i, n in enumerate(lengths):
        free, chunk = (min(counts[i] - take[i], top // n) if 0 < n <= top else 0), 1
        while free > 0:
            parts.append((i, use := min(chunk, free)))
            free, chunk = free - use, chunk * 2
    # Each sum remembers the part that first reached it; the parts before that one reach what is left.
    keep, mask = (1 << (top + 1)) - 1, 1
    first = np.full(top + 1, -1, np.int32)
    for at, (i, k) in enumerate(parts):
        wider = (mask | mask << (lengths[i] * k)) & keep
        if fresh := wider & ~mask:
            bits = np.unpackbits(np.frombuffer(fresh.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little")
            first[np.flatnonzero(bits)] = at
        mask = wider
        if mask >> left & 1:
            break
    # The nearest sum, the lower one of two as near.
    below = (mask & ((1 << (left + 1)) - 1)).bit_length() - 1
    higher = mask >> (left + 1)
    above = left + (higher & -higher).bit_length() if higher else top + left + 1
    rest = above if above - left < left - below else below
    while rest:
        i, k = parts[first[rest]]
        take[i] += k
        rest -= k * lengths[i]
    return take


def _plan(frame: pd.DataFrame) -> pd.DataFrame:
    """One source's histogram (length, count, target) -> whole repeats and documents to take of each length."""
    frame = frame.sort_values("size")
    size, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
    whole = int(target // size) if size else 0
    take = fit_budget(frame["size"].tolist(), frame["n"].tolist(), round(target - whole * size))
    return frame.assign(whole=whole, take=take)[["source", "size", "n", "source_size", "target", "whole", "take"]]


def mix_sources(docs: DataFrame, seed: int = 0, weights=WEIGHTS, max_repeats: int = 3, ranges: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole_rows: bool = False) -> DataFrame:
    """docs -> id, size, source_size, target, repeats (how often the mix takes the document).

    ``whole_rows`` returns every column of docs as struct ``doc`` instead of the id.
    """
    kept = F.struct(*[column(docs, c) for c in docs.columns]) if whole_rows else column(docs, id_col)
    # An unsigned 53-bit fraction of a seeded hash orders the documents of a length.
    spot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), column(docs, id_col), column(docs, text_col)), 11) / F.lit(float(1 << 53))
    rows = docs.select(kept.alias("doc" if whole_rows else "id"), column(docs, source_col).cast("string").alias("source"), word_count(column(docs, text_col)).alias("size"), spot.alias("spot"))
    rows = rows.withColumn("part", F.floor(F.col("spot") * ranges).cast("int"))
    if not whole_rows:
        rows = materialize(rows, "mix-sizes")  # the texts are read once
    parts = materialize(rows.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("m")), "mix-parts")
    lengths = parts.groupBy("source", "size").agg(F.sum("m").alias("n"))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = source_targets(sizes, weights, max_repeats).withColumnRenamed("source", "s")
    joined = lengths.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = joined.groupBy("source").applyInPandas(_plan, "source string, size long, n long, source_size long, target double, whole int, take long")
    plan = materialize(plan, "mix-plan").withColumnsRenamed({"source": "s", "size": "z"})

    # Each hash range of a length learns how many of its documents are still to take.
    earlier = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    quota = F.least(F.col("m"), F.greatest(F.lit(0), F.col("take") - F.coalesce(F.sum("m").over(earlier), F.lit(0))))
    quotas = parts.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).withColumn("quota", quota)
    quotas = quotas.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), "source_size", "target", "whole", "quota")
    left = rows.join(quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p")))
    tie = F.col("doc")[id_col] if whole_rows else F.col("id")
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("spot", tie))
    chosen = (F.col("size") > 0) & (rank <= F.col("quota"))
    out = left.select(F.col("doc") if whole_rows else F.col("id").alias(id_col), "size", "source_size", "target", (F.col("whole") + chosen.cast("int")).alias("repeats"))
    return out
