"""Team history: one row per team per game, rolling form, momentum, rest, sequences and head-to-head.

All rolling features of a team share one shuffle and one sort (partition by sport and team, order by date and
game), however many are asked for; teams of very many games are cut into slices. Head-to-head joins on an unordered pair key, never on an OR of both orders.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from courtside.functions.rounding import rounded
from courtside.operators.ranking import numbered


def team_games(games: DataFrame) -> DataFrame:
    """Each game seen from both teams, in one scan."""
    side = lambda us, them, home: F.struct(F.col(f"{us}_id").alias("team_id"), F.col(f"{them}_id").alias("opponent_id"), F.lit(home).alias("is_home"), F.col(f"{us}_score").alias("points"), F.col(f"{them}_score").alias("opponent_points"))
    return games.select("game_id", "sport", "game_ts", F.explode(F.array(side("home", "away", 1), side("away", "home", 0))).alias("s")).select("game_id", "sport", "game_ts", "s.*")


#: A team of more games than this is worked on in slices of so many.
SLICE = 1 << 16


def by_team(rows: DataFrame, add: Callable[[DataFrame, WindowSpec], DataFrame], carry: int, slice_games: int = SLICE, runs: bool = False) -> DataFrame:
    """add(rows, window) with each team's games in order, no task holding more than a slice of one team.

    ``carry``: how many earlier games the windows of add can reach. Teams of few games, if not all then nearly all, take
    one shuffle. The games of the others are numbered by range partitions and cut into slices; each slice starts with
    the last ``carry`` games of the one before it, which only lend their values and go again. With ``runs`` they stay, and
    rows tell their ``slice`` and whether they are ``lent``.
    """
    if slice_games <= carry:
        raise ValueError("a slice must hold more games than windows reach")
    order = ("game_ts", "game_id")
    plain = Window.partitionBy("team_id").orderBy(*order)
    told = lambda df: df.withColumns({"slice": F.lit(0).cast("long"), "lent": F.lit(False)}) if runs else df
    large = rows.groupBy("team_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > slice_games).select("team_id")
    if large.isEmpty():
        return told(add(rows, plain))
    placed = numbered(rows.join(large, "team_id", "left_semi"), ["team_id", *order])
    first = placed.groupBy("team_id").agg(F.min("place").alias("first"))
    index = F.col("place") - F.col("first")
    own = F.expr(f"index div {slice_games}")
    copies = F.when(index % slice_games >= slice_games - carry, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = placed.join(first, "team_id").withColumn("index", index).withColumn("slice", F.explode(copies.alias("s"))).withColumn("lent", F.col("slice") > own)
    sliced = add(dealt.drop("place", "first", "index"), Window.partitionBy("team_id", "slice").orderBy(*order))
    rest = told(add(rows.join(large, "team_id", "left_anti"), plain))
    return rest.unionByName(sliced if runs else sliced.filter(~F.col("lent")).drop("slice", "lent"))


def rolling_form(rows: DataFrame, include_current: bool = True, slice_games: int = SLICE) -> DataFrame:
    """Adds rolling points and opponent points (10 games), win rate (20), days of rest and the back-to-back flag.

    ``include_current=False`` ends every frame at the previous game, as training needs.
    """
    return by_team(rows, lambda df, ordered: _form(df, ordered, 0 if include_current else -1), 20, slice_games)


def _form(rows: DataFrame, ordered: WindowSpec, end: int) -> DataFrame:
    frame = lambda n: ordered.rowsBetween(end - n + 1, end)
    rest = F.datediff("game_ts", F.lag("game_ts").over(ordered))
    return rows.withColumns({
        "won": (F.col("points") > F.col("opponent_points")).cast("int"),
    }).withColumns({
        "points_10": F.avg("points").over(frame(10)),
        "opponent_points_10": F.avg("opponent_points").over(frame(10)),
        "win_rate_20": F.avg("won").over(frame(20)),
        "days_rest": rest,
        "back_to_back": F.coalesce(rest <= 1, F.lit(False)),
    })


def recent_weights(rows: DataFrame, games: int = 10) -> DataFrame:
    """The last games of each team with linear weights from .5 (oldest) to 1 (newest); a single game weighs .5."""
    latest = Window.partitionBy("team_id").orderBy(F.desc("game_ts"), F.desc("game_id"))
    ranked = rows.withColumn("recency", F.row_number().over(latest)).filter(F.col("recency") <= games)
    n = F.count(F.lit(1)).over(Window.partitionBy("team_id"))
    return ranked.withColumn("n", n).withColumn("weight", F.when(F.col("n") == 1, 0.5).otherwise(0.5 + 0.5 * F.try_divide(F.col("n") - F.col("recency"), F.col("n") - 1)))


def momentum(rows: DataFrame) -> DataFrame:
    """team_id, momentum: weighted mean of signed results times one plus the margin's share of the larger score."""
    top = F.greatest("points", "opponent_points")
    margin = F.coalesce(F.try_divide((F.col("points") - F.col("opponent_points")).cast("double"), top.cast("double")), F.lit(0.0))
    sign = F.when(F.col("points") > F.col("opponent_points"), 1.0).otherwise(-1.0)
    weighted = recent_weights(rows).withColumn("part", F.col("weight") * sign * (1 + margin))
    # The parts are added newest last, so the sum is the same in any partitioning.
    parts = F.array_sort(F.collect_list(F.struct((-F.col("recency")).alias("o"), "part")))
    return weighted.groupBy("team_id").agg((F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["part"]) / F.count(F.lit(1))).alias("momentum"))


#: The features of each step of a sequence, in order.
STEP = ("points", "opponent_points", "is_home", "points_10", "opponent_points_10", "win_rate_20", "days_rest", "back_to_back")


def sequences(rows: DataFrame, length: int = 10, slice_games: int = SLICE) -> DataFrame:
    """Per team and game, the STEP features of the last ``length`` games as a flat array, oldest first; shorter histories are left out.

    A first game has no days of rest and counts as 0.
    """
    steps = lambda df, ordered: _steps(df, ordered, 1 - length, 0)
    return by_team(rows, steps, 20 + length, slice_games).filter(F.size("steps") == length).select("team_id", "game_id", F.flatten("steps").alias("sequence"))


def _steps(rows: DataFrame, ordered: WindowSpec, start: int, end: int) -> DataFrame:
    step = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in STEP])
    return _form(rows, ordered, 0).withColumn("steps", F.collect_list(step).over(ordered.rowsBetween(start, end)))


def labelled_sequences(rows: DataFrame, length: int = 10, slice_games: int = SLICE) -> DataFrame:
    """``sequences`` of the games that another one follows, with ``label``: whether the team won that one; unknown outcomes are left out.

    Each sequence is made at the game that follows it, so label and sequence meet in the shuffle that makes the sequences,
    and no sequence is shuffled.
    """
    before = lambda df, ordered: _steps(df, ordered, -length, -1).withColumn("last_id", F.lag("game_id").over(ordered))
    whole = by_team(rows, before, 21 + length, slice_games).filter((F.size("steps") == length) & F.col("won").isNotNull())
    return whole.select("team_id", F.col("last_id").alias("game_id"), F.col("won").alias("label"), F.flatten("steps").alias("sequence"))


def sequence_runs(rows: DataFrame, length: int = 10, slice_games: int = SLICE) -> DataFrame:
    """What ``labelled_sequences`` are cut from, each game once: its STEP features, and the label of the ``length`` games before it.

    The games of a team (or of a slice of one) lie in one partition, as their window needs, one after another and numbered
    by ``place`` from 1. ``game_id`` is that of the last game before, as in ``labelled_sequences``; label is null where it
    has no row: with fewer games before, an unknown outcome, or games that a slice only borrows.
    """
    known = F.when((F.col("place") > length) & ~F.col("lent"), F.col("won"))

    def add(df: DataFrame, ordered: WindowSpec) -> DataFrame:
        return _form(df, ordered, 0).withColumns({"place": F.row_number().over(ordered), "last_id": F.lag("game_id").over(ordered)})

    sorted_ = by_team(rows, add, 21 + length, slice_games, runs=True).sortWithinPartitions("team_id", "slice", "game_ts", "game_id")
    return sorted_.select("team_id", F.col("last_id").alias("game_id"), "place", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in STEP], known.alias("label"))


def pair_key(home: str = "home_id", away: str = "away_id") -> list:
    return [F.least(home, away).alias("low_id"), F.greatest(home, away).alias("high_id")]


def pair_history(games: DataFrame) -> DataFrame:
    """One row per unordered pair: how many games, wins of each side at home and away, and the summed difference, seen from the lower id."""
    low_home = F.col("home_id") <= F.col("away_id")
    won_home, won_away = F.col("home_score") > F.col("away_score"), F.col("away_score") > F.col("home_score")
    difference = F.when(low_home, F.col("home_score") - F.col("away_score")).otherwise(F.col("away_score") - F.col("home_score"))
    return games.groupBy(*pair_key()).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(low_home & won_home).alias("low_home_wins"),
        F.count_if(~low_home & won_home).alias("high_home_wins"),
        F.count_if(low_home & won_away).alias("high_away_wins"),
        F.count_if(~low_home & won_away).alias("low_away_wins"),
        F.sum(difference).alias("difference"),
    )


def head_to_head(schedule: DataFrame, history: DataFrame) -> DataFrame:
    """schedule with the pair's record, seen from the scheduled home team; zeros without history.

    Wins count only in the same venue arrangement; meetings at the other venue count in the denominator.
    """
    pairs = pair_history(history)
    joined = schedule.withColumns({"low_id": F.least("home_id", "away_id"), "high_id": F.greatest("home_id", "away_id")}).join(pairs, ["low_id", "high_id"], "left")
    low = F.col("home_id") == F.col("low_id")
    n = F.coalesce("n", F.lit(0))
    home_wins = F.coalesce(F.when(low, F.col("low_home_wins")).otherwise(F.col("high_home_wins")), F.lit(0))
    away_wins = F.coalesce(F.when(low, F.col("high_away_wins")).otherwise(F.col("low_away_wins")), F.lit(0))
    signed = F.coalesce(F.when(low, F.col("difference")).otherwise(-F.col("difference")), F.lit(0)).cast("double")
    return joined.select(*schedule.columns, n.alias("meetings"), home_wins.alias("home_wins"), away_wins.alias("away_wins"), rounded(F.coalesce(F.try_divide(signed, n.cast("double")), F.lit(0.0))).alias("average_difference"), rounded(F.coalesce(F.try_divide(home_wins.cast("double"), n.cast("double")), F.lit(0.0))).alias("home_advantage"))


def point_in_time(games: DataFrame) -> DataFrame:
    """Each game with both teams' form as known before it: frames end at the previous game, so nothing leaks."""
    before = rolling_form(team_games(games), include_current=False).select("game_id", "is_home", "points_10", "opponent_points_10", "win_rate_20", "days_rest", "back_to_back")
    # Both sides come from one aggregation by game, so the history is read once.
    pick = lambda c, home: F.max(F.when(F.col("is_home") == home, F.col(c)))
    names = ("points_10", "opponent_points_10", "win_rate_20", "days_rest", "back_to_back")
    return before.groupBy("game_id").agg(*[pick(c, h).alias(f"{s}_{c}") for s, h in (("home", 1), ("away", 0)) for c in names])
