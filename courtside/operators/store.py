"""The tracking tables as a store: predictions, results and metrics by month, changed by batches.

A batch reads and rewrites only the months that it touches: those of its rows, and those where its games have rows already,
which a look at the keys and times of the table finds. All tables that a call changes switch together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from courtside.operators import tracking
from courtside.sources.versions import Versions

#: The partition of every table, in SQL: a month of games is some thousand rows.
MONTH = "date_format(ts, 'yyyy-MM')"


class TrackingStore:
    """Keyed upserts and inserts over ``root``; ``schemas`` has the columns of each of tracking.TABLES, game_id and ts among them."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str | StructType], part: str = MONTH, keep: int = 3):
        self.part, self.versions = part, Versions(spark, root, schemas, keep)

    def read(self, table: str, first: str | None = None, last: str | None = None) -> DataFrame:
        """A table's rows, or those from partition ``first`` to ``last``, whose folders alone are opened."""
        at = self.versions.current()
        parts = [p for p in at["tables"].get(table, {}) if (first is None or p >= first) and (last is None or p <= last)]
        return self.versions.read(table, parts, at)

    def _touched(self, table: str, keys: DataFrame, new: DataFrame, at: dict) -> list[str]:
        """The partitions of new, and those where the games of keys are: one row each comes to the driver."""
        held = self.versions.read(table, at=at).select("game_id", "ts").join(keys.select("game_id").distinct(), "game_id", "left_semi")
        part = F.coalesce(F.expr(self.part).cast("string"), F.lit("none")).alias("part")
        return [r["part"] for r in held.select(part).union(new.select(part)).distinct().collect()]

    def _upserted(self, table: str, new: DataFrame, merge, at: dict) -> dict:
        touched = self._touched(table, new, new, at)
        return self.versions.rewritten(table, touched, merge(self.versions.read(table, touched, at), new), self.part)

    def upsert_predictions(self, new: DataFrame) -> None:
        """Latest values by game; the first row's teams stay."""
        at = self.versions.current()
        self.versions.commit(at, {"predictions": self._upserted("predictions", new, tracking.upsert_predictions, at)})

    def upsert_metrics(self, new: DataFrame) -> None:
        """All columns of the newest row of a game."""
        at = self.versions.current()
        self.versions.commit(at, {"metrics": self._upserted("metrics", new, tracking.upsert_all, at)})

    def insert_results(self, new: DataFrame) -> None:
        """Games without a result get the earliest of new, and those with a prediction their metric, in one change.

        Only keys of the table are read, and no old folder is written; partitions of many small folders become one afterwards.
        """
        at = self.versions.current()
        known = self.versions.read("results", at=at).select("game_id")
        fresh = self.versions.write("results", tracking.first_of_each(new).join(known, "game_id", "left_anti"), self.part)
        added = self.versions.read("results", at={"tables": {"results": fresh}})
        metrics = tracking.derived_metrics(self.versions.read("predictions", at=at), added)
        held = at["tables"].get("results", {})
        self.versions.commit(at, {"results": {p: held.get(p, []) + f for p, f in fresh.items()}, "metrics": self._upserted("metrics", metrics, tracking.upsert_all, at)})
        self.versions.compact("results", self.part)

    def replace(self, new: dict[str, DataFrame]) -> None:
        """Replace the games of new in all tables, those that depend on others first: a game that any of them brings goes from all."""
        at, keys = self.versions.current(), None
        for table in tracking.TABLES:
            part = new[table].select("game_id")
            keys = part if keys is None else keys.union(part)
        keys, change = keys.distinct(), {}
        for table in tracking.TABLES:
            touched = self._touched(table, keys, new[table], at)
            old = self.versions.read(table, touched, at)
            change[table] = self.versions.rewritten(table, touched, old.join(keys, "game_id", "left_anti").unionByName(new[table].select(old.columns)), self.part)
        self.versions.commit(at, change)
