"""Text analytics on articles and reports: lexicon sentiment, keyword flags, and parsing of advice reports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.functions.rounding import rounded

#: What a brief of forecasts asks for.
BRIEF = "Compare these forecasts with the market. Name single bets, parlays, inefficiencies, insights and a strategy.\n"
SENTENCE_END = r"(?<=[.!?])\s+"
#: Keywords of each flag.
KEYWORDS = {
    "injury": ("injury", "injured", "recovery"),
    "strategy": ("strategy", "system", "approach"),
    "positive": ("confident", "optimistic", "positive"),
    "negative": ("concerned", "worried", "frustrated"),
    "improving": ("improving", "better", "progress"),
    "declining": ("declining", "worse", "struggling"),
}
#: Section headers in the order in which they are tested.
HEADERS = (("single", "SINGLE BET"), ("parlay", "PARLAY"), ("inefficiency", "INEFFICIENC"), ("insight", "INSIGHT"), ("strategy", "STRATEGY"))


def sentences(content: Column) -> Column:
    """The non-empty sentences of a text."""
    return F.filter(F.split(F.trim(content), SENTENCE_END), lambda s: s != "")


def normalised(total: Column) -> Column:
    """A sum of valences squeezed into (-1, 1)."""
    return total / F.sqrt(total * total + 15.0)


def text_sentiment(texts: DataFrame, lexicon: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, compound: the normalised sum of the valences of a text's tokens; texts without any score 0.

    Only tokens of the lexicon, which is small, leave the scan of the texts; the keys bring back texts without any.
    """
    hits = _valences(texts, lexicon, keys, F.col(text))
    return texts.select(*keys).join(hits, keys, "left").select(*keys, F.coalesce("compound", F.lit(0.0)).alias("compound"))


def _valences(texts: DataFrame, lexicon: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """keys, compound of the texts that have a token of the lexicon."""
    tokens = texts.select(*keys, F.explode(F.split(F.lower(text), "[^a-z]+")).alias("token"))
    total = F.sum(F.rint(F.coalesce("valence", F.lit(0.0)) * 1000).cast("long"))
    return tokens.join(lexicon, "token").groupBy(*keys).agg(normalised(total / 1000.0).alias("compound"))


def sentence_scores(articles: DataFrame, lexicon: DataFrame) -> DataFrame:
    """article_id, title_score and body_score (mean over the sentences) of the articles that have a token of the lexicon; one scan of the texts.

    The texts are dealt to all cores first: a file is read by one task for each row group, and one may hold them all. The
    sums by sentence and by article then need no shuffle of their own.
    """
    dealt = articles.select("article_id", "title", "content").repartition("article_id")
    split = dealt.select("article_id", "title", sentences(F.col("content")).alias("sentences"))
    parts = F.concat(F.array(F.struct(F.lit(-1).alias("place"), F.col("title").alias("part"))), F.transform("sentences", lambda s, i: F.struct(i.alias("place"), s.alias("part"))))
    # The count stands below the explode, beside the array: above it, each sentence would carry and split its article.
    counted = split.select("article_id", F.size("sentences").alias("n"), parts.alias("parts"))
    # Every article has its title, so the outer form adds nothing; the plain one would filter by the size first, splitting again.
    each = counted.select("article_id", "n", F.inline_outer("parts"))
    hits = _valences(each, lexicon, ["article_id", "n", "place"], F.col("part"))
    body = F.sum(F.when(F.col("place") >= 0, F.rint(F.col("compound") * 1e9).cast("long")).otherwise(0))
    return hits.groupBy("article_id", "n").agg(F.coalesce(F.max(F.when(F.col("place") < 0, F.col("compound"))), F.lit(0.0)).alias("title_score"), body.alias("body")).select("article_id", "title_score", F.coalesce(F.try_divide(F.col("body").cast("double"), F.col("n").cast("double")) / 1e9, F.lit(0.0)).alias("body_score"))


def article_sentiment(articles: DataFrame, lexicon: DataFrame) -> DataFrame:
    """article_id, score (.3 title, .7 mean of sentences), label, confidence."""
    score = rounded(F.coalesce("title_score", F.lit(0.0)) * 0.3 + F.coalesce("body_score", F.lit(0.0)) * 0.7)
    scored = articles.select("article_id").join(sentence_scores(articles, lexicon), "article_id", "left").select("article_id", score.alias("score"))
    return scored.select("article_id", "score", F.when(F.col("score") > 0, "POSITIVE").otherwise("NEGATIVE").alias("label"), F.abs("score").alias("confidence"))


def _any(content: Column, name: str) -> Column:
    return F.lower(content).rlike("|".join(KEYWORDS[name]))


def key_information(articles: DataFrame) -> DataFrame:
    """Adds the keyword flags; a positive word wins over a negative one, improving over declining."""
    c = F.col("content")
    return articles.withColumns({
        "injury_related": _any(c, "injury"),
        "strategy_change": _any(c, "strategy"),
        "team_morale": F.when(_any(c, "positive"), "positive").when(_any(c, "negative"), "negative").otherwise("neutral"),
        "performance_trend": F.when(_any(c, "improving"), "improving").when(_any(c, "declining"), "declining").otherwise("stable"),
    })


def recent_articles(articles: DataFrame, days: int) -> DataFrame:
    """Articles at most ``days`` old (day_offset counts back from as_of)."""
    return articles.filter(F.col("day_offset") < days)


def recency_rank(articles: DataFrame) -> DataFrame:
    order = Window.partitionBy("team_id").orderBy("day_offset", "article_id")
    return articles.withColumn("recency", F.row_number().over(order))


def team_sentiment(scored: DataFrame, teams: DataFrame) -> DataFrame:
    """team_id, factor: recency-weighted mean of article scores times .1, 3 decimals; 0 without articles."""
    ranked = recency_rank(scored)
    parts = F.array_sort(F.collect_list(F.struct("recency", "score")))
    fold = lambda f: F.aggregate(parts, F.lit(0.0), f)
    factor = rounded(fold(lambda s, x: s + x["score"] / x["recency"]) / fold(lambda s, x: s + 1.0 / x["recency"]) * 0.1, 3)
    per_team = ranked.groupBy("team_id").agg(factor.alias("factor"))
    return teams.select("team_id").join(per_team, "team_id", "left").select("team_id", F.coalesce("factor", F.lit(0.0)).alias("factor"))


def sentiment_advantage(games: DataFrame, factors: DataFrame) -> DataFrame:
    """game_id, home minus away sentiment."""
    side = lambda s: factors.select(F.col("team_id").alias(f"{s}_id"), F.col("factor").alias(f"{s}_factor"))
    joined = games.join(side("home"), "home_id", "left").join(side("away"), "away_id", "left")
    return joined.select("game_id", rounded(F.coalesce("home_factor", F.lit(0.0)) - F.coalesce("away_factor", F.lit(0.0)), 3).alias("advantage"))


def report_sections(reports: DataFrame) -> DataFrame:
    """report_id, place, section kind and body: parts between blank lines that hold a known header."""
    parts = reports.select("report_id", F.posexplode(F.split("body", "\n\n")).alias("place", "part"))
    kind = F.lit(None).cast("string")
    for name, header in reversed(HEADERS):
        kind = F.when(F.upper("part").contains(header), name).otherwise(kind)
    return parts.withColumn("kind", kind).filter("kind is not null")


def _last_field(lines: Column, prefix: str) -> Column:
    """The value of the last line that starts with the prefix."""
    found = F.filter(lines, lambda x: x.startswith(prefix))
    return F.trim(F.substring(F.try_element_at(found, F.lit(-1)), len(prefix) + 1, 2**31 - 1))


def single_bet_fields(sections: DataFrame) -> DataFrame:
    """report_id, teams, confidence (75) and value (7): unreadable numbers keep the default, bets without teams go."""
    rows = sections.filter("kind = 'single'").withColumn("lines", F.transform(F.split("part", "\n"), lambda x: F.trim(x)))
    number = lambda prefix, default: F.coalesce(F.regexp_replace(_last_field(F.col("lines"), prefix), "%", "").try_cast("int"), F.lit(default))
    return rows.select("report_id", _last_field(F.col("lines"), "Game:").alias("teams"), number("Confidence:", 75).alias("confidence"), number("Value Rating:", 7).alias("value")).filter("teams is not null")


def parlay_legs(sections: DataFrame, compat: bool = False) -> DataFrame:
    """report_id, legs: split at the word "and"; ``compat`` splits at the letters wherever they stand."""
    rows = sections.filter("kind = 'parlay'").withColumn("games", _last_field(F.transform(F.split("part", "\n"), lambda x: F.trim(x)), "Games:"))
    legs = F.transform(F.split("games", "and" if compat else r"\band\b"), lambda x: F.trim(x))
    return rows.filter("games is not null").select("report_id", F.array_join(legs, "|").alias("legs"))


def bullets(sections: DataFrame, kind: str = "insight") -> DataFrame:
    """report_id, points: bullet lines without their markers, empty ones dropped."""
    lines = F.filter(F.transform(F.split("part", "\n"), lambda x: F.trim(x)), lambda x: x.startswith("•") | x.startswith("-"))
    points = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^[•-]+", ""))), lambda x: x != "")
    return sections.filter(F.col("kind") == kind).select("report_id", F.array_join(points, "|").alias("points"))


def strategy_fields(sections: DataFrame) -> DataFrame:
    rows = sections.filter("kind = 'strategy'").withColumn("lines", F.transform(F.split("part", "\n"), lambda x: F.trim(x)))
    return rows.select("report_id", *[_last_field(F.col("lines"), f"{name}:").alias(name.lower()) for name in ("Approach", "Bankroll", "Risk")])


def advice(reports: DataFrame) -> DataFrame:
    """One document per report: bets, legs, points and risk; reports without sections get the defaults."""
    sections = report_sections(reports)
    per_kind = [single_bet_fields(sections), parlay_legs(sections), bullets(sections), strategy_fields(sections).select("report_id", "risk")]
    out = reports.select("report_id")
    for part in per_kind:
        out = out.join(part, "report_id", "left")
    return out.select("report_id", F.coalesce("teams", F.lit("none")).alias("teams"), F.coalesce("confidence", F.lit(75)).alias("confidence"), F.coalesce("legs", F.lit("")).alias("legs"), F.coalesce("points", F.lit("")).alias("points"), F.coalesce("risk", F.lit("medium")).alias("risk"))


def brief(forecasts: DataFrame) -> DataFrame:
    """sport, day, brief: the instruction, then the day's forecasts in order of their games; one row a sport and day keeps groups small."""
    percent = lambda p: F.format_string("%.1f%%", rounded(p * 100.0, 1))
    side = lambda s, p: F.concat(F.lit(f'"{s}": {{"name": "'), F.col(f"{s}_name"), F.lit('", "win_probability": "'), percent(F.col(p)), F.lit('", "moneyline": '), F.col(f"{s}_odds").cast("string"), F.lit("}"))
    row = F.concat(F.lit('{"game_id": '), F.col("game_id").cast("string"), F.lit(", "), side("home", "p_home"), F.lit(", "), side("away", "p_away"), F.lit(', "spread": "'), F.col("spread_text"), F.lit('", "favoured": "'), F.col("favoured"), F.lit('", "winner": "'), F.col("winner"), F.lit('"}'))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("game_id", row.alias("row")))), lambda x: x["row"])
    return forecasts.groupBy("sport", F.to_date("game_ts").alias("day")).agg(F.concat(F.lit(BRIEF), F.array_join(ordered, "\n")).alias("brief"))
