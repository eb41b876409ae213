"""Streams end where the batch ends, and a batch that runs twice changes nothing."""

import os

import pytest
from pyspark.sql import functions as F

from courtside.operators import tracking
from courtside.operators.store import TrackingStore
from courtside.sources.versions import Conflict, Versions
from courtside.streaming import jobs

EVENT = "event_id long, ts timestamp, game_id long, spread double, winner string"


def events(spark, *rows):
    return spark.createDataFrame([(e, None, g, float(s), w) for e, _, g, s, w in rows], EVENT).withColumn("ts", F.expr("timestamp '2025-01-01 00:00:00' + make_dt_interval(0, 0, cast(event_id AS int))"))


def streamed(spark, path, *batches):
    """A stream that gets one batch's rows after another."""
    for i, rows in enumerate(batches):
        rows.coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet") and os.stat(f"{path}/{f}").st_mtime > 2_000:
                os.utime(f"{path}/{f}", (1_000 + i, 1_000 + i))
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_versions_are_idempotent(spark, tmp_path):
    table = jobs.VersionedTable(spark, str(tmp_path / "t"), EVENT, "game_id")
    assert table.read().count() == 0
    a = events(spark, (1, 0, 7, 1, "home"), (3, 0, 8, 2, "away"))
    b = events(spark, (5, 0, 7, 3, "away"), (2, 0, 9, 4, "home"))
    table.merge(0, a, jobs.latest)
    before = table.versions.current()
    for _ in range(2):
        table.merge(1, b, jobs.latest)
    assert {r["game_id"]: r["event_id"] for r in table.read().collect()} == {7: 5, 8: 3, 9: 2}
    after = table.versions.current()
    assert after["number"] == before["number"] + 1
    changed = [p for p, f in after["tables"]["rows"].items() if before["tables"]["rows"].get(p) != f]
    assert 1 <= len(changed) <= 2 and table.versions.read("rows", at=before).count() == 2
    # Another stream's batch of that number is another batch.
    table.merge(1, events(spark, (9, 0, 9, 1, "home")), jobs.latest, "other")
    assert table.read().filter("event_id = 9").count() == 1


def test_late_batches_cost_what_early_ones_do(spark, tmp_path):
    table = jobs.VersionedTable(spark, str(tmp_path / "t"), EVENT, "game_id", buckets=2, keep=2)
    folders = []
    for i in range(9):
        table.merge(i, events(spark, (i, 0, i % 4, i, "home"), (i + 50, 0, i % 4 + 4, i, "away")), jobs.latest)
        folders.append(sum(len(d) for _, d, _ in os.walk(tmp_path / "t" / "data")))  # writes and their buckets
    assert max(folders[5:]) <= 3 * 3 and len(os.listdir(tmp_path / "t" / "manifests")) <= 3 * 2  # with checksums
    assert table.read().count() == 8


def test_first_processed_wins(spark):
    a, b = events(spark, (5, 0, 7, 1, "home")), events(spark, (1, 0, 7, 9, "away"), (2, 0, 8, 3, "home"), (3, 0, 8, 4, "away"))
    assert {r["game_id"]: r["event_id"] for r in jobs.first(a, b).collect()} == {7: 5, 8: 2}


def test_stream_equals_batch(spark, tmp_path):
    rows = events(spark, *[(i, 0, i % 5, i, "home" if i % 2 else "away") for i in range(40)])
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    table = jobs.VersionedTable(spark, str(tmp_path / "t"), EVENT, "game_id", buckets=3)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.keep(stream, table, jobs.latest, str(tmp_path / "c"))
    assert table.versions.current()["number"] > 2
    assert sorted(table.read().collect()) == sorted(jobs.latest(rows.limit(0), rows).collect())


def test_results_once_and_first(spark, tmp_path):
    """Deliveries repeat, a game gets another result, and rows beyond the watermark come too late."""
    one = events(spark, (100, 0, 1, 1, "home"), (90, 0, 2, 2, "away"), (95, 0, 2, 3, "home"), (100, 0, 1, 1, "home"))
    two = events(spark, (100, 0, 1, 1, "home"), (80, 0, 2, 9, "home"), (9000, 0, 3, 5, "home"), (8000, 0, 4, 6, "away"))
    three = events(spark, (200, 0, 5, 7, "home"), (8995, 0, 6, 8, "away"), (9000, 0, 3, 5, "home"))
    # What is late is judged by the watermark of the batch before, so a batch of repeats lies between.
    stream = jobs.delivered_once(streamed(spark, str(tmp_path / "in"), one, two, two, three), "10 minutes")
    table = jobs.VersionedTable(spark, str(tmp_path / "t"), EVENT, "game_id", buckets=3)
    query = jobs.keep(stream, table, jobs.first, str(tmp_path / "c"))
    kept = jobs.first(jobs.first(jobs.first(one.limit(0), one), two), three.filter("event_id > 200"))
    assert sorted(table.read().collect()) == sorted(kept.collect())
    assert {r["game_id"]: r["event_id"] for r in table.read().collect()} == {1: 100, 2: 90, 3: 9000, 4: 8000, 6: 8995}
    # What lies before the watermark is forgotten: the state holds no event of the first batch.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_days_are_updated_and_late_rows_end(spark, tmp_path):
    """Update mode: a late row within the watermark changes its day, one beyond it doesn't."""
    day = 24 * 60  # event ids are minutes
    one = events(spark, (10, 0, 1, 1, "home"), (20, 0, 2, 3, "away"))
    two = events(spark, (3 * day, 0, 3, 5, "home"))
    three = events(spark, (3 * day - 2, 0, 4, 7, "away"), (30, 0, 5, 100, "home"))
    stream = streamed(spark, str(tmp_path / "in"), one, two, events(spark, (3 * day, 0, 3, 5, "home")), three)
    schema = "day date, home_share double, spread double, events long"
    table = jobs.VersionedTable(spark, str(tmp_path / "t"), schema, "day", buckets=2)
    jobs.keep(jobs.daily_accuracy(stream), table, jobs.newest("day"), str(tmp_path / "c"), "update")
    found = {str(r["day"]): (r["home_share"], r["spread"], r["events"]) for r in table.read().collect()}
    assert found == {"2025-01-01": (0.5, 2.0, 2), "2025-01-03": (0.0, 7.0, 1), "2025-01-04": (1.0, 5.0, 2)}


def test_live_metrics_drop_what_is_too_late(spark, tmp_path):
    hour = 60  # event ids are minutes
    predictions = streamed(spark, str(tmp_path / "p"), events(spark, (0, 0, 1, 2, "home"), (1, 0, 2, 4, "home")), events(spark, (20 * hour, 0, 3, 1, "away")), events(spark, (20 * hour, 0, 9, 1, "away")), events(spark, (20 * hour + 1, 0, 4, 1, "away")))
    results = streamed(spark, str(tmp_path / "r"), events(spark, (hour, 0, 1, 5, "home")), events(spark, (21 * hour, 0, 3, 4, "home")), events(spark, (21 * hour, 0, 8, 4, "home")), events(spark, (2 * hour, 0, 2, 5, "home"), (20 * hour + 2, 0, 4, 3, "away")))
    metrics = jobs.live_metrics(predictions, results, within="2 hours", late="1 hour")
    metrics.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    found = {r["game_id"]: (r["spread_error"], r["winner_correct"]) for r in spark.read.schema(metrics.schema).parquet(str(tmp_path / "out")).collect()}
    assert found == {1: (3.0, True), 3: (3.0, False), 4: (2.0, True)}  # game 2's result came 18 hours late


# ---- tables of the tracking store ---------------------------------------------------------------------------------

SCHEMAS = {
    "predictions": "game_id long, ts timestamp_ntz, home_id long, away_id long, predicted_winner long, predicted_spread double, win_probability double",
    "results": "game_id long, ts timestamp_ntz, actual_winner long, final_spread double",
    "metrics": "game_id long, spread_error double, winner_correct boolean, ts timestamp_ntz",
}


def table(spark, name, *rows):
    times = [i for i, f in enumerate(SCHEMAS[name].split(", ")) if f.startswith("ts ")]
    plain = spark.createDataFrame(list(rows), SCHEMAS[name].replace("timestamp_ntz", "string"))
    return plain.withColumns({plain.columns[i]: F.col(plain.columns[i]).cast("timestamp_ntz") for i in times})


def predicted(spark, *rows):
    return table(spark, "predictions", *[(g, f"2025-01-{d:02d} 10:00:00", h, a, w, s, 0.6) for g, d, h, a, w, s in rows])


def resulted(spark, *rows):
    return table(spark, "results", *[(g, f"2025-01-{d:02d} 23:00:00", w, s) for g, d, w, s in rows])


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_an_upsert_leaves_other_partitions_alone(spark, tmp_path):
    store = TrackingStore(spark, str(tmp_path), SCHEMAS, "to_date(ts)", keep=9)
    store.upsert_predictions(predicted(spark, (1, 1, 10, 20, 10, 3.0), (2, 2, 30, 40, 30, 4.0), (3, 3, 50, 60, 60, 5.0)))
    before, then = files(tmp_path), store.versions.current()["tables"]["predictions"]
    store.upsert_predictions(predicted(spark, (2, 4, 99, 98, 40, 1.0), (4, 4, 70, 80, 70, 2.0)))
    now = store.versions.current()["tables"]["predictions"]
    assert {p: now.get(p) for p in ("2025-01-01", "2025-01-03")} == {p: then[p] for p in ("2025-01-01", "2025-01-03")}
    assert "2025-01-02" not in now and len(now["2025-01-04"]) == 1  # game 2 moved
    assert {f: t for f, t in files(tmp_path).items() if f in before} == before
    found = {r["game_id"]: (r["home_id"], r["predicted_winner"], r["predicted_spread"]) for r in store.read("predictions").collect()}
    assert found == {1: (10, 10, 3.0), 2: (30, 40, 1.0), 3: (50, 60, 5.0), 4: (70, 70, 2.0)}
    assert store.read("predictions", "2025-01-03", "2025-01-03").count() == 1 and len(store.read("predictions", "2025-01-03", "2025-01-03").inputFiles()) == 1


def test_results_bring_their_metrics_once(spark, tmp_path):
    store = TrackingStore(spark, str(tmp_path), SCHEMAS)
    store.upsert_predictions(predicted(spark, (1, 1, 10, 20, 10, 3.0), (2, 1, 30, 40, 30, 4.0)))
    store.insert_results(resulted(spark, (1, 1, 10, 5.0), (9, 1, 7, 1.0)))
    before = files(tmp_path / "data" / "results")
    store.insert_results(resulted(spark, (1, 2, 20, -5.0), (2, 2, 40, -1.0), (2, 3, 30, 9.0)))
    assert {r["game_id"]: r["final_spread"] for r in store.read("results").collect()} == {1: 5.0, 9: 1.0, 2: -1.0}
    assert {r["game_id"]: (r["spread_error"], r["winner_correct"]) for r in store.read("metrics").collect()} == {1: (2.0, True), 2: (5.0, False)}
    assert {f: t for f, t in files(tmp_path / "data" / "results").items() if f in before} == before


def test_many_appends_are_compacted(spark, tmp_path):
    store = TrackingStore(spark, str(tmp_path), SCHEMAS, keep=1)
    for i in range(8):
        store.insert_results(resulted(spark, (i, 1, 1, float(i))))
    assert store.read("results").count() == 8 and len(store.versions.current()["tables"]["results"]["2025-01"]) == 1
    assert store.versions.sweep() == 0


def test_a_failed_replacement_leaves_all_tables(spark, tmp_path, monkeypatch):
    store = TrackingStore(spark, str(tmp_path), SCHEMAS)
    store.upsert_predictions(predicted(spark, (1, 1, 10, 20, 10, 3.0), (2, 1, 30, 40, 30, 4.0)))
    store.insert_results(resulted(spark, (1, 1, 10, 5.0), (2, 1, 30, 6.0)))
    rows = lambda: [sorted(map(tuple, store.read(t).collect())) for t in tracking.TABLES]
    before = rows()
    new = {"predictions": predicted(spark, (1, 2, 10, 20, 20, 9.0)), "results": resulted(spark, (3, 2, 7, 1.0)), "metrics": table(spark, "metrics", (1, 4.5, True, "2025-01-02 00:00:00"))}
    write, calls = Versions.write, []

    def failing(self, name, *args):
        calls.append(name)
        if len(calls) == 3:
            raise OSError("no space")
        return write(self, name, *args)

    monkeypatch.setattr(Versions, "write", failing)
    with pytest.raises(OSError, match="no space"):
        store.replace(new)
    assert calls == ["metrics", "results", "predictions"] and rows() == before
    monkeypatch.setattr(Versions, "write", write)
    assert store.versions.sweep() == 2 and rows() == before
    store.replace(new)
    metrics, results, predictions = rows()
    assert [(r[0], r[1]) for r in metrics] == [(1, 4.5), (2, 2.0)] and [r[0] for r in results] == [2, 3] and [(r[0], r[4]) for r in predictions] == [(1, 20), (2, 30)]


def test_the_second_of_two_writers_fails(spark, tmp_path):
    versions = Versions(spark, str(tmp_path), {"t": "id long"})
    at = versions.current()
    change = {"t": versions.write("t", spark.range(3), "'a'")}
    versions.commit(at, change)
    with pytest.raises(Conflict):
        versions.commit(at, {"t": versions.write("t", spark.range(5), "'a'")})
    assert versions.read("t").count() == 3


def test_replace_and_insert(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "game_id int, ts int, v string")
    new = spark.createDataFrame([(2, 5, "x"), (3, 6, "y"), (3, 4, "z")], old.schema)
    assert {r["game_id"]: r["v"] for r in tracking.insert_new(old, new).collect()} == {1: "a", 2: "b", 3: "z"}
    assert sorted(r["v"] for r in tracking.replace_keys(old, new).collect()) == ["a", "x", "y", "z"]
