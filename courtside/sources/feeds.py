"""Feeds as tables: landed JSON documents with explicit schemas, parsed inside the JVM."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from courtside.functions.formats import clock, eastern, first_where
from courtside.functions.rounding import rounded

SCOREBOARD = "events array<struct<id:string,date:string,competitions:array<struct<competitors:array<struct<homeAway:string,team:struct<name:string>>>>>>>"
SEASON = "GameID bigint, Day string, DateTime string, HomeTeam string, AwayTeam string, HomeTeamWins int, HomeTeamLosses int, HomeTeamScore int, AwayTeamScore int"
QUOTE = "game_id bigint, details string, overUnder double, moneyLine struct<homeTeamOdds:struct<moneyLine:string>,awayTeamOdds:struct<moneyLine:string>>, provider struct<name:string>"
REQUEST = "game_id bigint, home_team struct<name:string,win_pct:string,points_avg:string,points_against_avg:string>, away_team struct<name:string,win_pct:string,points_avg:string,points_against_avg:string>"
TRAINING = "games array<struct<game_id:bigint,spread:double>>, labels array<int>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON documents, by schema, without inference."""
    return spark.read.schema(schema).json(path)


#: The reason of documents that are no JSON of the schema.
CORRUPT = "corrupt"


def read_checked(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Landed documents, one a line, that can be read and have all ``required`` fields; and the others, as they stand, with a reason.

    Each line is in one of the two, blank ones in neither. Fields may be nested (a.b).
    """
    fields = StructType([*StructType.fromDDL(schema).fields, StructField("_corrupt", StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    read = lines.select("value", F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    missing = [F.when(F.col(f"d.{f}").isNull(), F.lit(f"{f} missing")) for f in required]
    reason = F.coalesce(F.when(F.col("d").isNull() | F.col("d._corrupt").isNotNull(), CORRUPT), *missing)
    told = read.withColumn("reason", reason)
    return told.filter("reason is null").select("d.*").drop("_corrupt"), told.filter("reason is not null").select("value", "reason")


def parsed(raw: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Documents of a text column, such as request bodies, by schema."""
    return raw.select(F.from_json(column, schema).alias("d")).select("d.*")


def land(rows: DataFrame, path: str) -> str:
    """Write rows as JSON documents, one a line, as a feed lands them; returns the path."""
    rows.write.json(path)
    return path


def scoreboard_games(raw: DataFrame) -> DataFrame:
    """Scoreboard documents -> one row per event: id, Eastern date and time, both names; the first competition counts."""
    events = raw.select(F.explode("events").alias("e"))
    sides = F.get(F.col("e.competitions"), F.lit(0))["competitors"]
    name = lambda side: first_where(sides, lambda c: c["homeAway"] == side)["team"]["name"]
    day, time = eastern(F.col("e.date"))
    return events.select(F.col("e.id").alias("game_id"), day.alias("game_date"), time.alias("game_time"), name("home").alias("home_name"), name("away").alias("away_name"))


def season_games(raw: DataFrame) -> DataFrame:
    """Season score documents -> games with win percentage and the game's scores as averages; absent numbers are 0."""
    g = raw
    n = lambda c: F.coalesce(c, F.lit(0))
    played = n("HomeTeamWins") + n("HomeTeamLosses")
    share = F.when(played > 0, F.try_divide(n("HomeTeamWins").cast("double"), played.cast("double"))).otherwise(0.0)
    return g.select(F.col("GameID").alias("game_id"), F.substring("Day", 1, 10).alias("game_date"), clock(F.col("DateTime")).alias("game_time"), F.col("HomeTeam").alias("home_name"), F.col("AwayTeam").alias("away_name"), rounded(share).alias("home_win_pct"), n("HomeTeamScore").cast("double").alias("home_points_avg"), n("AwayTeamScore").cast("double").alias("away_points_avg"))


def odds_quotes(raw: DataFrame) -> DataFrame:
    """Quote documents -> spread text, total, money line (absent 0, malformed null) and provider."""
    q = raw
    line = lambda side: F.when(F.col(f"moneyLine.{side}TeamOdds.moneyLine").isNull(), 0).otherwise(F.col(f"moneyLine.{side}TeamOdds.moneyLine").try_cast("int"))
    return q.select("game_id", F.coalesce("details", F.lit("N/A")).alias("spread"), F.coalesce("overUnder", F.lit(0.0)).alias("over_under"), line("home").alias("home_ml"), line("away").alias("away_ml"), F.coalesce("provider.name", F.lit("Unknown")).alias("provider"))


def forecast_requests(raw: DataFrame) -> DataFrame:
    """Request documents -> matchup columns; unreadable numbers are null, back-to-back is false."""
    r = parsed(raw, REQUEST)
    stats = {"w": "win_pct", "p": "points_avg", "a": "points_against_avg"}
    numbers = [F.col(f"{side}_team.{c}").try_cast("double").alias(f"{side[0]}{s}") for side in ("home", "away") for s, c in stats.items()]
    return r.select("game_id", F.col("home_team.name").alias("home_name"), F.col("away_team.name").alias("away_name"), *numbers, F.lit(False).alias("home_back_to_back"), F.lit(False).alias("away_back_to_back"))


def training_rows(raw: DataFrame) -> DataFrame:
    """games[] paired with labels[] by position."""
    d = raw.select(F.explode(F.arrays_zip(F.col("games").alias("game"), F.col("labels").alias("label"))).alias("z"))
    return d.select(F.col("z.game.game_id").alias("game_id"), F.col("z.game.spread").alias("spread"), F.col("z.label").alias("label"))


def dated_schedule(matchups: DataFrame, order: str, as_of: str, days: int = 7, per_day: int = 3) -> DataFrame:
    """Row i gets day i // per_day and 19:05 (even i) or 13:05; at most days * per_day rows, at least one.

    The limit comes before the global numbering, so one task numbers only the rows that stay.
    """
    kept = matchups.orderBy(order).limit(max(days * per_day, 1))
    i = F.row_number().over(Window.orderBy(order)) - 1
    return kept.withColumn("i", i).select(*matchups.columns, F.date_add(F.lit(as_of).cast("date"), F.floor(F.col("i") / per_day).cast("int")).alias("game_date"), F.when(F.col("i") % 2 == 0, "19:05").otherwise("13:05").alias("game_time"))


def next_days(spark: SparkSession, as_of: str, days: int) -> DataFrame:
    """The next days as dates and as yyyyMMdd partitions."""
    day = F.explode(F.sequence(F.lit(as_of).cast("date"), F.date_add(F.lit(as_of).cast("date"), days - 1)))
    return spark.range(1).select(day.alias("day")).select("day", F.date_format("day", "yyyyMMdd").alias("partition"))


def page_preview(pages: DataFrame, length: int = 200) -> DataFrame:
    """page_id, n_chars, preview of the page's text: scripts, styles and tags dropped, white space squeezed."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    text = F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))
    return pages.select("page_id", F.length(text).cast("long").alias("n_chars"), F.substring(text, 1, length).alias("preview"))


def aliased(rows: DataFrame, alias: DataFrame, column: str) -> DataFrame:
    """Adds full_name: the alias table's name of ``column``, or the name itself."""
    return rows.join(alias.withColumnRenamed("short_name", column), column, "left").withColumn("full_name", F.coalesce("team_name", F.col(column))).drop("team_name")


def as_struct_json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns))
