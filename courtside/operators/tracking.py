"""Forecast tracking: accuracy trends and day reports, and keyed maintenance of the tracking tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions.rounding import rounded

ERROR_BUCKETS = (("0-5", 0.0, 5.0), ("6-10", 6.0, 10.0), ("11-15", 11.0, 15.0))


def accuracy_trend(metrics: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Per day of the last ``days``: mean win accuracy (null counts as 0), mean spread error and count, newest first."""
    recent = metrics.filter((F.col("ts") >= as_of - F.expr(f"interval {days} days")) & (F.col("ts") < as_of))
    right = F.when(F.col("winner_correct"), 1.0).otherwise(0.0)
    daily = recent.groupBy(F.to_date("ts").alias("day")).agg(rounded(F.avg(right)).alias("accuracy"), rounded(F.avg("spread_error")).alias("spread_error"), F.count(F.lit(1)).alias("games"))
    return daily.orderBy(F.desc("day"))


def day_detail(predictions: DataFrame, results: DataFrame, metrics: DataFrame, day: str) -> DataFrame:
    """predictions of one day with their results and metrics; the day is a range, so it prunes and pushes down."""
    start = F.lit(day).cast("timestamp_ntz")
    mine = predictions.filter((F.col("ts") >= start) & (F.col("ts") < start + F.expr("interval 1 day")))
    joined = mine.join(results.drop("ts"), "game_id").join(metrics.drop("ts"), "game_id")
    return joined.filter(F.col("actual_winner").isNotNull())


def day_report(detail: DataFrame) -> DataFrame:
    """correct, incorrect, accuracy (0 when empty) and the four error buckets with what falls between them."""
    right = F.count_if(F.col("predicted_winner") == F.col("actual_winner"))
    n = F.count(F.lit(1))
    counts = [F.count_if(F.col("spread_error").between(low, high)).alias(f"errors_{i}") for i, (_, low, high) in enumerate(ERROR_BUCKETS)]
    return detail.agg(right.alias("correct"), (n - right).alias("incorrect"), rounded(F.coalesce(F.try_divide(right.cast("double"), n.cast("double")), F.lit(0.0))).alias("accuracy"), *counts, F.count_if(F.col("spread_error") > 15).alias("errors_3"))


def error_histogram(metrics: DataFrame) -> DataFrame:
    """Counts of errors in the four buckets, which leave gaps, and of what falls in the gaps."""
    counts = [F.count_if(F.col("spread_error").between(low, high)).alias(name) for name, low, high in ERROR_BUCKETS]
    over = F.count_if(F.col("spread_error") > 15)
    total = metrics.agg(*counts, over.alias("16+"), F.count("spread_error").alias("n"))
    known = sum((F.col(f"`{name}`") for name, _, _ in ERROR_BUCKETS[1:]), F.col("`0-5`")) + F.col("`16+`")
    return total.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"`{b}`").alias("games")) for b in ("0-5", "6-10", "11-15", "16+")], F.struct(F.lit("unbucketed").alias("bucket"), (F.col("n") - known).alias("games")))).alias("r")).select("r.*")


def upsert_predictions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Latest winner, spread, probability and time per game; the first row's team ids stay. One aggregation, no join."""
    rows = old.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)))
    order = F.struct("seq", "ts")
    latest = [F.max_by(c, order).alias(c) for c in ("ts", "predicted_winner", "predicted_spread", "win_probability")]
    return rows.groupBy("game_id").agg(*latest, *[F.min_by(c, order).alias(c) for c in ("home_id", "away_id")])


def first_of_each(rows: DataFrame, key: str = "game_id") -> DataFrame:
    """The earliest row of each key; among those of one time the least of the other columns."""
    value = F.struct("ts", *[c for c in rows.columns if c not in (key, "ts")])
    return rows.groupBy(key).agg(F.min(value).alias("v")).select(key, "v.*").select(*rows.columns)


def insert_new(old: DataFrame, new: DataFrame, key: str = "game_id") -> DataFrame:
    """old with the first row (by time) of each key that it lacks."""
    return old.unionByName(first_of_each(new, key).join(old.select(key), key, "left_anti"))


def derived_metrics(predictions: DataFrame, results: DataFrame) -> DataFrame:
    """A metric row for each result that has a prediction."""
    joined = predictions.select("game_id", "predicted_winner", "predicted_spread", "ts").join(results.select("game_id", "actual_winner", "final_spread"), "game_id")
    return joined.select("game_id", F.abs(F.col("predicted_spread") - F.col("final_spread")).alias("spread_error"), (F.col("predicted_winner") == F.col("actual_winner")).alias("winner_correct"), "ts")


def upsert_all(old: DataFrame, new: DataFrame, key: str = "game_id") -> DataFrame:
    """Every column from the newest row of each key; new rows win over old ones."""
    rows = old.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)))
    value = F.struct(*[c for c in old.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(value, F.struct("seq", "ts")).alias("v")).select(key, "v.*").select(*old.columns)


def replace_keys(old: DataFrame, new: DataFrame, key: str = "game_id") -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


#: The tracking tables, those that depend on others first.
TABLES = ("metrics", "results", "predictions")


def dashboard(detail: DataFrame, trend: DataFrame) -> DataFrame:
    """One row, one nested document: the day's report with its error distribution and games, and the trend, newest first."""
    report = day_report(detail)
    buckets = F.struct(*[F.col(f"errors_{i}").alias(name) for i, name in enumerate(("b0_5", "b6_10", "b11_15", "b16"))])
    day = report.select(F.struct("correct", "incorrect", "accuracy", buckets.alias("spread_errors")).alias("day"))
    games = detail.agg(F.array_sort(F.collect_list(F.struct("game_id", "predicted_winner", "actual_winner", "spread_error"))).alias("games"))
    days = trend.agg(F.sort_array(F.collect_list(F.struct("day", "accuracy", "spread_error", "games")), asc=False).alias("trend"))
    # Three tables of one row each become one row.
    parts = day.unionByName(games, allowMissingColumns=True).unionByName(days, allowMissingColumns=True)
    return parts.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("day", "games", "trend")])


def dashboard_series(trend: DataFrame) -> DataFrame:
    """Accuracy as a percentage and right against wrong, per day."""
    right = F.rint(F.col("accuracy") * F.col("games")).cast("long")
    return trend.select("day", rounded(F.col("accuracy") * 100.0, 2).alias("accuracy_pct"), right.alias("correct"), (F.col("games") - right).alias("incorrect"))


def games_by_date(games: DataFrame) -> DataFrame:
    """day, number of games, their ids in order; days ascending."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("game_id")), lambda x: x.cast("string")), ",")
    return games.groupBy(F.to_date("game_ts").alias("day")).agg(F.count(F.lit(1)).alias("games"), ids.alias("game_ids")).orderBy("day")


def other_game_counts(games: DataFrame) -> DataFrame:
    """game_id, others, first_other: how many games of the same sport and day there are besides, and the smallest; games alone on their day are left out.

    One row a sport and day is joined back, so a day's games never meet in pairs.
    """
    day = games.select("game_id", "sport", F.to_date("game_ts").alias("day"))
    least = F.min("game_id")
    one = day.groupBy("sport", "day").agg(F.count(F.lit(1)).alias("n"), least.alias("low"))
    next_ = day.join(one.select("sport", "day", "low"), ["sport", "day"]).filter("game_id > low").groupBy("sport", "day").agg(least.alias("second"))
    known = one.join(next_, ["sport", "day"])
    return day.join(known, ["sport", "day"]).select("game_id", (F.col("n") - 1).alias("others"), F.when(F.col("game_id") == F.col("low"), F.col("second")).otherwise(F.col("low")).alias("first_other"))


def other_games(games: DataFrame) -> DataFrame:
    """Pairs of a game and another of the same sport and day, for a parlay's further legs."""
    day = lambda a: games.select(F.col("game_id").alias(a), "sport", F.to_date("game_ts").alias("day"))
    return day("game_id").join(day("other_id"), ["sport", "day"]).filter(F.col("game_id") != F.col("other_id"))


def first_prediction(bets: DataFrame, predictions: DataFrame) -> DataFrame:
    """bets with the earliest prediction of their game, or null."""
    first = predictions.groupBy("game_id").agg(F.min_by(F.struct("predicted_winner", "ts"), F.struct("ts", "predicted_winner")).alias("p"))
    return bets.join(first, "game_id", "left").select(*bets.columns, F.col("p.predicted_winner").alias("predicted_winner"))
