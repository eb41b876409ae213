"""The tracking tables as streams: upserts, first-write-wins, live metrics and daily accuracy.

Each job takes a streaming (or, for the same result, a static) DataFrame. Sinks write the buckets of keys that a batch
touches anew and switch to them together with the batch's number, so a batch that runs twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.functions.rounding import rounded
from courtside.sources.versions import Versions

TABLE = "rows"


class VersionedTable:
    """A table by key, in buckets of keys; a batch writes the buckets whose keys it has and no others.

    What is current, and which batch of which stream was the last, stands in one manifest; folders of earlier versions go
    after ``keep`` changes. So a batch costs the same however many came before it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 32, keep: int = 3):
        self.key, self.buckets, self.versions = key, buckets, Versions(spark, path, {TABLE: schema}, keep)

    def _bucket(self) -> str:
        return f"cast(pmod(xxhash64({self.key}), {self.buckets}) as int)"

    def read(self) -> DataFrame:
        return self.versions.read(TABLE)

    def merge(self, batch: int, new: DataFrame, merge, stream: str = "") -> None:
        """Put merge(old, new) in place of the buckets that new touches, unless this batch of the stream is in already."""
        at = self.versions.current()
        if at["batches"].get(stream, -1) >= batch:
            return
        touched = [str(r[0]) for r in new.select(F.expr(self._bucket())).distinct().collect()]  # one row a bucket
        rows = merge(self.versions.read(TABLE, touched, at), new.select(self.versions.schemas[TABLE].names))
        self.versions.commit(at, {TABLE: self.versions.rewritten(TABLE, touched, rows, self._bucket())}, (stream, batch))


def latest(old: DataFrame, new: DataFrame) -> DataFrame:
    """The newest event of each game, by time and id."""
    rows = old.unionByName(new)
    return rows.groupBy("game_id").agg(F.max_by(F.struct(*[c for c in old.columns if c != "game_id"]), F.struct("ts", "event_id")).alias("v")).select("game_id", "v.*").select(*old.columns)


def first(old: DataFrame, new: DataFrame) -> DataFrame:
    """The earliest event of each game in the first batch that has one; games already there keep theirs."""
    fresh = new.groupBy("game_id").agg(F.min_by(F.struct(*[c for c in old.columns if c != "game_id"]), F.struct("ts", "event_id")).alias("v")).select("game_id", "v.*").select(*old.columns)
    return old.unionByName(fresh.join(old.select("game_id"), "game_id", "left_anti"))


def newest(key: str):
    """Rows of a batch in place of those of the same key, as an aggregate in update mode sends them."""
    return lambda old, new: old.join(new.select(key), key, "left_anti").unionByName(new)


def keep(stream: DataFrame, table: VersionedTable, merge, checkpoint: str, mode: str = "append"):
    """Run the stream to its end, merging each batch into the table."""
    def batch(rows: DataFrame, number: int) -> None:
        # The batch is read for its buckets and again for its rows.
        rows.persist()
        if not rows.isEmpty():
            table.merge(number, rows, merge, checkpoint)
        rows.unpersist()

    query = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def delivered_once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within ``late`` of its time; a stream forgets events beyond that, and drops rows that come later still.

    What a game's first result is, the table decides (``first``): of one batch the earliest, of several the first batch's.
    """
    if not events.isStreaming:
        return events.dropDuplicates(["game_id", "event_id"])
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["game_id", "event_id"])


def event_time(rows: DataFrame) -> DataFrame:
    """Watermarks want timestamps with a zone; the session's is UTC."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def live_metrics(predictions: DataFrame, results: DataFrame, within: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Each prediction with the results of its game in the following ``within``; later or too late ones are dropped."""
    p = predictions.select(F.col("game_id"), F.col("ts").alias("p_ts"), F.col("spread").alias("p_spread"), F.col("winner").alias("p_winner"), F.col("event_id").alias("p_event"))
    r = results.select(F.col("game_id").alias("r_game"), F.col("ts").alias("r_ts"), F.col("spread").alias("r_spread"), F.col("winner").alias("r_winner"), F.col("event_id").alias("r_event"))
    if predictions.isStreaming:
        p, r = p.withWatermark("p_ts", late), r.withWatermark("r_ts", late)
    joined = p.join(r, F.expr(f"game_id = r_game AND r_ts >= p_ts AND r_ts <= p_ts + interval {within}"))
    return joined.select("game_id", "p_event", "r_event", rounded(F.abs(F.col("p_spread") - F.col("r_spread"))).alias("spread_error"), (F.col("p_winner") == F.col("r_winner")).alias("winner_correct"))


def daily_accuracy(metrics: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling days: share of home winners and mean spread; use update or complete mode to see open days."""
    rows = metrics.withWatermark("ts", late) if metrics.isStreaming else metrics
    return rows.groupBy(F.window("ts", "1 day").alias("w")).agg(rounded(F.avg(F.when(F.col("winner") == "home", 1.0).otherwise(0.0))).alias("home_share"), rounded(F.avg("spread"), 4).alias("spread"), F.count(F.lit(1)).alias("events")).select(F.to_date("w.start").alias("day"), "home_share", "spread", "events")
