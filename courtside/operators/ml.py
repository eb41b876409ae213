"""Forecast models on Spark ML: features, split, per-sport forests, boosting, nets, ensembles and a registry by sport."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.operators import features
from courtside.operators.boosting import GBTClassifier, GBTRegressor, MultilayerPerceptronClassifier, Net
from courtside.operators.forests import RandomForestClassifier
from courtside.params import ENSEMBLE_WEIGHTS, SPORTS

DEFAULT_ERA = 4.5
#: MB of counts that a core works on at a time, by Spark's parameter. Spark's 256 hold a whole level of 100 deep trees, far more than
#: a core's cache; our trainer counts tree by tree, and a tree of depth 10 takes half a MB.
PASS_MB = 4
#: The columns of the flat training row, in order.
FLAT = (
    "home_team_win_pct", "away_team_win_pct", "home_team_points_avg", "away_team_points_avg", "home_team_points_allowed_avg", "away_team_points_allowed_avg", "home_team_momentum", "away_team_momentum",
    "home_team_injury_impact", "away_team_injury_impact", "head_to_head_advantage", "weather_impact", "sentiment_advantage", "home_team_back_to_back", "away_team_back_to_back",
)


def forest(trees: int, depth: int) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=42, maxMemoryInMB=PASS_MB)


@dataclass(frozen=True)
class SportSpec:
    """A pluggable sport: its feature columns, its line and its estimator."""

    name: str
    columns: dict[str, Column]
    line: Callable[[DataFrame], DataFrame]
    estimator: Callable[[], object] = field(default=lambda: forest(100, 10))

    def pipeline(self) -> Pipeline:
        columns, stage = list(self.columns), self.estimator()
        if isinstance(stage, RandomForestClassifier):
            return Pipeline(stages=[stage.over(columns)])
        return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), stage])

    def prepared(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns(self.columns)


def sport_columns(name: str) -> dict[str, Column]:
    """Feature columns: eight for NBA (with rest flags) and MLB (with ERAs), six for NFL."""
    base = {f"f_{c}": F.col(c).cast("double") for c in ("hw", "aw", "hp", "ap", "ha", "aa")}
    if name == "NBA":
        return base | {f"f_{s}_b2b": F.coalesce(F.col(f"{s}_back_to_back").cast("double"), F.lit(0.0)) for s in ("home", "away")}
    if name == "MLB":
        return base | {f"f_{s}_era": F.coalesce(F.col(f"{s}_era").cast("double"), F.lit(DEFAULT_ERA)) for s in ("home", "away")}
    return base


def parts(key: str = "game_id", percent: int = 80) -> tuple[Column, Column]:
    """Whether a row is one to train on, and whether it is one to test with, by a hash of the key."""
    bucket = F.pmod(F.xxhash64(key), F.lit(100))
    return bucket < percent, bucket >= percent


def split(rows: DataFrame, key: str = "game_id", percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the key: the same rows however the table is partitioned."""
    trained, tested = parts(key, percent)
    return rows.filter(trained), rows.filter(tested)


def probability(scored: DataFrame, name: str = "p") -> DataFrame:
    return scored.withColumn(name, vector_to_array("probability")[1])


def accuracy(scored: DataFrame, label: str = "label") -> float:
    return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy").evaluate(scored)


def at_once(spark: SparkSession, work: Callable, items) -> list:
    """work(item) of all items at once, in their order: the passes of one model are short and follow each other, those of the others fill the cores meanwhile."""
    items = list(items)
    with ThreadPool(len(items)) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items)


def train_models(rows: DataFrame, columns: list[str], trees: int = 100, depth: int = 10, iterations: int = 100) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Forest, boosting and a feed-forward net on the same split; one metrics row a model.

    ``rows`` are read several times by each model, so they should be a stored table (``storage.kept``), not a long plan.
    """
    train, test = split(rows)
    assemble = VectorAssembler(inputCols=columns, outputCol="features")
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    stages = {
        "forest": [forest(trees, depth).over(columns)],
        "boosting": [GBTClassifier(maxIter=iterations, maxDepth=min(depth, 10), features=columns)],
        "net": [assemble, scale, MultilayerPerceptronClassifier(layers=[len(columns), 64, 32, 16, 2], maxIter=iterations)],
    }
    spark = rows.sparkSession

    def trained(name: str) -> tuple[PipelineModel, float]:
        model = Pipeline(stages=stages[name]).fit(train)
        return model, float(accuracy(model.transform(test)))

    found = dict(zip(stages, at_once(spark, trained, stages)))
    sizes = train.count(), test.count()
    models = {name: model for name, (model, _) in found.items()}
    metrics = [(name, share, *sizes) for name, (_, share) in found.items()]
    return models, spark.createDataFrame(metrics, "model string, accuracy double, train_rows long, test_rows long")


def ensemble(forest: Column, boosting: Column, net: Column) -> Column:
    return sum((p * w for p, w in zip((boosting, net), ENSEMBLE_WEIGHTS[1:])), forest * ENSEMBLE_WEIGHTS[0])


def mean_and_deviation(*p: Column) -> tuple[Column, Column]:
    """Mean and population deviation over the columns of a row."""
    mean = sum(p[1:], p[0]) / float(len(p))
    variance = sum(((x - mean) * (x - mean) for x in p[1:]), (p[0] - mean) * (p[0] - mean)) / float(len(p))
    return mean, F.sqrt(variance)


def ensemble_confidence(*p: Column) -> Column:
    mean, deviation = mean_and_deviation(*p)
    return (1 - F.least(2 * deviation, F.lit(0.5))) * 2 * F.abs(mean - 0.5)


def flat_rows(enhanced: DataFrame) -> DataFrame:
    """game_id and the FLAT columns as doubles; missing ones and nulls are 0."""
    have = set(enhanced.columns)
    return enhanced.select("game_id", *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in FLAT])


def enhanced_features(matchups: DataFrame, history: DataFrame, injuries: DataFrame | None = None, weather: DataFrame | None = None, sentiment: DataFrame | None = None) -> DataFrame:
    """Each scheduled game with the FLAT columns and the differences between its teams.

    ``matchups`` has both teams' averages (hw, hp, ha, aw, ap, aa); momentum and head-to-head come from ``history``;
    injuries (team_id, impact), weather (game_id, impact) and sentiment (team_id, factor) are optional tables. Teams and
    games that a table lacks get zeros. The tables by team meet in one table before they join both sides.
    """
    teams = features.momentum(features.team_games(history))
    for table, column, name in ((injuries, "impact", "injury"), (sentiment, "factor", "sentiment")):
        teams = teams.join(table.select("team_id", F.col(column).alias(name)), "team_id", "full") if table is not None else teams.withColumn(name, F.lit(0.0))
    side = lambda s: teams.select(F.col("team_id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in ("momentum", "injury", "sentiment")])
    met = features.head_to_head(matchups, history)
    joined = met.join(side("home"), "home_id", "left").join(side("away"), "away_id", "left")
    if weather is not None:
        joined = joined.join(weather.select("game_id", F.col("impact").alias("weather_impact")), "game_id", "left")
    else:
        joined = joined.withColumn("weather_impact", F.lit(None).cast("double"))
    form = features.point_in_time(history).select("game_id", "home_back_to_back", "away_back_to_back")
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    named = {"win_pct": "w", "points_avg": "p", "points_allowed_avg": "a"}
    rows = joined.join(form, "game_id", "left")
    return rows.withColumns({f"{s}_team_{name}": F.col(f"{s[0]}{c}") for s in ("home", "away") for name, c in named.items()} | {f"{s}_team_{name}": known(f"{s}_{c}") for s in ("home", "away") for name, c in (("momentum", "momentum"), ("injury_impact", "injury"), ("sentiment", "sentiment"))} | {f"{s}_team_back_to_back": F.coalesce(F.col(f"{s}_back_to_back"), F.lit(False)) for s in ("home", "away")} | {"head_to_head_advantage": F.col("home_advantage")}).withColumns({f"{name}_{word}": F.col(f"home_team_{c}") - F.col(f"away_team_{c}") for name, c, word in (("momentum", "momentum", "advantage"), ("injury", "injury_impact", "difference"), ("sentiment", "sentiment", "advantage"))})


def training_set(games: DataFrame) -> DataFrame:
    """Each finished game with both teams' form before it and whether home won; games without history are left out."""
    form = features.point_in_time(games)
    labelled = games.select("game_id", "sport", (F.col("home_score") > F.col("away_score")).cast("int").alias("label"), (F.col("home_score") - F.col("away_score")).cast("double").alias("margin"))
    columns = [c for c in form.columns if c.endswith(("points_10", "win_rate_20", "days_rest"))]
    return form.join(labelled, "game_id").select("game_id", "sport", "label", "margin", *[F.col(c).cast("double").alias(c) for c in columns]).dropna()


def spread_regression(rows: DataFrame, columns: list[str], label: str = "margin", iterations: int = 20) -> tuple[PipelineModel, DataFrame]:
    """The model, and its mae and mse on the test rows: one row, worked out in one pass by whoever reads it."""
    train, test = split(rows)
    model = Pipeline(stages=[GBTRegressor(maxIter=iterations, maxDepth=5, features=columns, label=label)]).fit(train)
    error = F.col("prediction") - F.col(label)
    return model, model.transform(test).agg(F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"))


class Registry:
    """Models by sport under a shared path: fitted once, then loaded by whoever asks."""

    def __init__(self, path: str):
        self.path, self.loaded = path.rstrip("/"), {}

    def save(self, sport: str, model: PipelineModel) -> None:
        if sport not in SPORTS:
            raise ValueError(f"unsupported sport: {sport}")
        model.write().overwrite().save(f"{self.path}/{sport}")
        self.loaded[sport] = model

    def get(self, sport: str) -> PipelineModel:
        if sport not in self.loaded:
            self.loaded[sport] = PipelineModel.load(f"{self.path}/{sport}")
        return self.loaded[sport]

    @staticmethod
    def supported() -> list[str]:
        return sorted(SPORTS)


def held_to(scored: DataFrame, keys: list[str], label: str = "label", p: str = "p") -> DataFrame:
    """keys, games, in_range, split_adds_up and above_majority of scored rows, one row for each value of keys.

    In range: no probability is null or outside 0 to 1. The split adds up: its two parts are all the rows. Above the
    majority: on its training rows a model is right at least as often as whoever names the commoner label there.
    """
    trained, tested = parts()
    right = F.count_if(trained & ((F.col(p) > 0.5).cast("int") == F.col(label)))
    ones, n, rest, games = F.count_if(trained & (F.col(label) == 1)), F.count_if(trained), F.count_if(tested), F.count(F.lit(1))
    in_range = F.bool_and(F.coalesce(F.col(p).between(0, 1), F.lit(False)))
    return scored.groupBy(*keys).agg(games.alias("games"), in_range.alias("in_range"), (right >= F.greatest(ones, n - ones)).alias("above_majority"), (n + rest == games).alias("split_adds_up"))
