"""Helpers that the corpus operators share: shared storage, table reads, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Tables are broadcast up to this many bytes, by their rows and columns; beyond it Spark shuffles the join.
BROADCAST_BYTES = 32 << 20
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{workspace(df.sparkSession)}/courtside-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again; stores that pyarrow can't reach keep theirs."""
    for path in {f.rpartition("/")[0] for df in tables for f in df.inputFiles()}:
        try:
            store, place = FileSystem.from_uri(path)
            store.delete_dir(place)
        except (OSError, ValueError):
            continue


def small(df: DataFrame, width: int | Column) -> DataFrame:
    """A materialized df, whose rows take about ``width`` bytes, to broadcast where its size is small, else as it is."""
    total = df.count() * width if isinstance(width, int) else df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def fresh(df: DataFrame, tag: str) -> str:
    """A column name that df does not have."""
    return tag if tag not in {c.lower() for c in df.columns} else fresh(df, tag + "_")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(df: DataFrame, name: str) -> Column:
    """The column of that very name, whatever characters it holds."""
    return df[quoted(name)]


def with_id(named: DataFrame, fields: str) -> StructType:
    """The schema of the column id of named, then ``fields``."""
    return StructType([StructField("id", named.schema["id"].dataType), *StructType.fromDDL(fields).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def bucket(column, modulus: int):
    """crc32 of a column's text, modulo ``modulus``; null stays null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def split_words(data: bytes | None) -> list[bytes]:
    """``bytes.split`` cuts at exactly the six ASCII white-space bytes of WORD."""
    return data.split() if data else []


class WordHashes(dict):
    """Memo from a word's bytes to its 64-bit hash; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 1 << 18):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of word hashes behave as fresh hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words, in order."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for k in range(1, width):
            out = mix64(out) + words[k : n + k]
        return mix64(out)
