"""Shards along a Hilbert curve: rows that are near in several metadata dimensions lie in the same files.

Every dimension is quantised to ``2**bits`` levels of about equal numbers of rows: a histogram of its values, in their
order, gives each value the level of the middle of its rows. The levels of a row are a point, whose index along the
Hilbert curve orders the rows; runs of this order are the shards, by the law "rows" (counts at most one apart) or "bytes"
(sums of sizes near equal). Each shard covers a small box of the dimensions, so ranges in any of them prune files.

All of it is DataFrame functions. Places come from range partitions with counted offsets, so no task sees more than a
partition. Rows of one point follow a hash of their id, size and checksum, so a value or a point that holds a third of all
rows spreads over many tasks; a histogram has one row a value, summed before the shuffle.

Null and empty texts have 8 bytes and checksum 0; null dimensions are a value of their own, placed first; texts of any
length count whole; rows that are equal in all that is returned may change places with each other, which changes no
result; an empty table gives an empty result; further columns of docs, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm._common import column, materialize
from courtside.operators.ranking import numbered

#: Bytes that a row counts besides its text.
ROW_BYTES = 8
LAWS = ("rows", "bytes")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """The place of a point along the Hilbert curve; axes are whole numbers of ``bits`` bits, at most 62 together.

    Bit by bit from the top, the point is turned into the frame of the sub-cube that it lies in; then a Gray code links
    the axes, and their bits interleave.
    """
    n = len(axes)
    if not 0 < n * bits <= 62:
        raise ValueError("the bits of all axes must be 1 to 62")
    number = lambda x: F.lit(x).cast("long")
    steps = F.array(*[F.struct(number(1 << q).alias("bit"), F.lit(i).alias("axis")) for q in range(bits - 1, 0, -1) for i in range(n)])

    def turned(point: Column, step: Column) -> Column:
        """One axis at one bit: its bit set mirrors the first axis below that bit, else both axes change places there."""
        first, here, below = F.get(point, F.lit(0)), F.get(point, step["axis"]), step["bit"] - 1
        mirrored = here.bitwiseAND(step["bit"]) != 0
        change = F.struct(F.when(mirrored, below).otherwise(first.bitwiseXOR(here).bitwiseAND(below)).alias("by"), F.when(mirrored, 0).otherwise(step["axis"]).alias("other"))
        return _let(change, lambda c: F.transform(point, lambda v, k: F.when((k == 0) | (k == c["other"]), v.bitwiseXOR(c["by"])).otherwise(v)))

    def linked(point: Column) -> Column:
        """Gray code along the axes: each becomes the parity of itself and those before it."""
        return F.transform(point, lambda v, k: F.aggregate(F.slice(point, F.lit(1), k + 1), number(0), lambda s, x: s.bitwiseXOR(x)))

    def flipped(gray: Column) -> Column:
        last = F.element_at(gray, -1)
        flip = F.aggregate(powers, number(0), lambda s, q: F.when(last.bitwiseAND(q) != 0, s.bitwiseXOR(q - 1)).otherwise(s))
        return _let(flip, lambda f: F.transform(gray, lambda v: v.bitwiseXOR(f)))

    powers = F.array(*[number(1 << q) for q in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<bigint>")
    places = F.array(*[F.struct(F.lit(i).alias("axis"), number(1 << q).alias("bit")) for q in range(bits - 1, -1, -1) for i in range(n)])
    interleaved = lambda coded: F.aggregate(places, number(0), lambda s, p: s * 2 + (F.get(coded, p["axis"]).bitwiseAND(p["bit"]) != 0).cast("long"))
    point = F.array(*[a.cast("long") for a in axes])
    if bits > 1:
        point = F.aggregate(steps, point, turned)
    return _let(_let(_let(point, linked), flipped), interleaved)


def levels(rows: DataFrame, name: str, level: str, bits: int, total: int) -> DataFrame:
    """rows with the level of column ``name``: 0 to 2**bits - 1, in the order of its values, of about equal numbers of rows."""
    counts = rows.groupBy(F.col(name).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    placed = numbered(counts, [F.col("_value").asc_nulls_first()], "_rows", weight="_n")
    middle = F.expr(f"((2 * _rows + _n) * {1 << bits}L) div {2 * max(total, 1)}L")
    return rows.join(placed.select("_value", middle.cast("long").alias(level)), F.col(name).eqNullSafe(F.col("_value"))).drop("_value")


def shard(docs: DataFrame, shards: int = 24, law: str = "rows", dimensions: tuple[str, ...] = ("source", "lang"), bits: int = 8, whole_rows: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> id, size, text_crc32, shard, slot (from 0 in each shard) and curve; ``dimensions`` and the size span the curve.

    ``whole_rows`` returns every column of docs as struct ``doc`` instead of the id.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    data = F.coalesce(column(docs, text_col).cast("string"), F.lit("")).cast("binary")
    id_ = column(docs, id_col)
    kept = F.struct(*[column(docs, c) for c in docs.columns]).alias("doc") if whole_rows else id_.alias("id")
    named = [column(docs, c).alias(f"dim{i}") for i, c in enumerate(dimensions)]
    size, crc = (F.length(data) + ROW_BYTES).cast("long"), F.crc32(data)
    rows = docs.select(kept, *named, size.alias("size"), crc.alias("text_crc32"), F.xxhash64(id_, size, crc).alias("spot"), id_.alias("by_id"))
    rows = materialize(rows, "shard-rows")  # texts are read once
    total, weight = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    axes = [f"dim{i}" for i in range(len(dimensions))] + ["size"]
    pointed = reduce(lambda df, a: levels(df, a, f"level_{a}", bits, total), axes, rows)
    pointed = pointed.withColumn("curve", hilbert_index([F.col(f"level_{a}") for a in axes], bits))
    order = [F.col(c) for c in ("curve", "spot", "by_id", "size", "text_crc32")]
    head = ["doc"] if whole_rows else [F.col("id").alias(id_col)]
    cut = lambda place, whole: F.expr(f"least({shards - 1}L, ({place} * {shards}L) div {max(whole, 1)}L)")
    placed = numbered(pointed.select("doc" if whole_rows else "id", "size", "text_crc32", "curve", "spot", "by_id"), order)
    if law == "rows":
        first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
        out = placed.withColumn("shard", cut("place", total)).withColumn("slot", F.col("place") - first)
    else:
        # A row belongs to the shard in which its middle byte falls, so shards differ from the mean by less than a row.
        weighed = numbered(placed.select("*"), [F.col("place")], "_bytes", weight="size").withColumn("shard", cut("(_bytes + size div 2)", weight))
        firsts = weighed.groupBy("shard").agg(F.min("place").alias("_first"))
        out = weighed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("place") - F.col("_first"))
    return out.select(*head, "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), "curve")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write whole rows by shard, each shard in the order of its slots and in as many files as its ranges take."""
    rows = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.select("doc.*", "shard", "slot").write.partitionBy("shard").parquet(path)


def zones(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """shard, and the least and greatest value of each column in it: one row a shard."""
    rows = spark.read.parquet(path)
    spans = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("least", F.min), ("greatest", F.max))]
    return rows.groupBy("shard").agg(*spans)


def read_shards(spark: SparkSession, path: str, zone: DataFrame, **ranges: tuple) -> DataFrame:
    """The rows within all ``ranges`` (column=(least, greatest)), from those shards only whose zone meets them."""
    meets = reduce(lambda a, b: a & b, [(F.col(f"greatest_{c}") >= low) & (F.col(f"least_{c}") <= high) for c, (low, high) in ranges.items()], F.lit(True))
    wanted = [r["shard"] for r in zone.filter(meets).select("shard").collect()]  # one row a shard
    within = reduce(lambda a, b: a & b, [F.col(c).between(low, high) for c, (low, high) in ranges.items()], F.lit(True))
    return spark.read.parquet(path).filter(F.col("shard").isin(wanted)).filter(within)
