"""Bet selection, parlays, slips and settlement."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.functions.odds import STANDARD_ODDS, american_from_decimal, decimal_odds, implied_probability, moneyline_value, payout_multiplier, spread_value
from courtside.functions.rounding import rounded, whole
from courtside.operators.ranking import numbered
from courtside.params import RISK_LEVELS


#: The texts of a bet's reasons.
STRONG, MODERATE, EDGE = "Strong value opportunity with ", "Moderate value with ", "%.1f%% edge"
OFFENCE, LOW_RISK, MEDIUM_RISK = " shows stronger offensive performance", "Historical data suggests consistent performance patterns", "Moderate volatility in recent performances"


def reasoning() -> Column:
    """The reasons that hold, joined by a bar."""
    value, gap = F.col("value"), F.col("hp") - F.col("ap")
    edge = F.format_string(EDGE, rounded(value * 100.0, 1))
    return F.concat_ws(
        " | ",
        F.when(value > 0.15, F.concat(F.lit(STRONG), edge)).when(value > 0.05, F.concat(F.lit(MODERATE), edge)),
        F.when(F.abs(gap) > 5, F.concat(F.when(gap > 0, F.col("home_name")).otherwise(F.col("away_name")), F.lit(OFFENCE))),
        F.when(F.col("risk_level") == "low", LOW_RISK).when(F.col("risk_level") == "medium", MEDIUM_RISK),
    )


def single_bets(assessed: DataFrame) -> DataFrame:
    """One bet per game of acceptable risk: the better of spread and moneyline, with odds, confidence, value and reasons."""
    priced = assessed.filter(F.col("risk_score") < RISK_LEVELS["high"]).withColumns({
        "spread_ev": spread_value(F.col("p_home"), F.col("spread")),
        "money_ev": moneyline_value(F.col("p_home"), F.col("p_away"), F.col("home_odds"), F.col("away_odds")),
    })
    by_spread = (F.col("spread_ev") > F.col("money_ev")) & (F.abs("spread") > 0)
    chosen = priced.withColumns({"bet_type": F.when(by_spread, "Spread").otherwise("Moneyline"), "value": F.when(by_spread, F.col("spread_ev")).otherwise(F.col("money_ev"))})
    return chosen.withColumns({
        "odds": F.when(F.col("bet_type") == "Spread", F.lit(STANDARD_ODDS).cast("long")).otherwise(F.col("home_odds")),
        "confidence_pct": whole((1 - F.col("risk_score")) * 100.0),
        "value_score": rounded("value", 2),
        "reasoning": reasoning(),
    })


def placed_bets(bets: DataFrame) -> DataFrame:
    """Every bet with its place, from 1, in the order of ranked_bets: range partitions with counted offsets, however many bets share a value and a confidence."""
    placed = numbered(bets, [F.desc("value_score"), F.desc("confidence_pct"), F.col("game_id")])
    return placed.withColumn("place", F.col("place") + 1)


def ranked_bets(bets: DataFrame) -> DataFrame:
    """By value and confidence, highest first; the game breaks ties."""
    return bets.orderBy(F.desc("value_score"), F.desc("confidence_pct"), "game_id")


def parlays(bets: DataFrame, limit: int = 3) -> DataFrame:
    """Adjacent pairs of the best bets (value above 0, confidence above 70): odds, mean value, payouts and leg texts.

    Only limit + 1 bets are ranked across the table; the sort before them is a top-k. Whether a bet will do is the
    first key of that sort and is asked again of the few that leave it, so that no condition over all the inputs of
    value and confidence is pushed down to the tables.
    """
    fit = (F.col("value_score") > 0) & (F.col("confidence_pct") > 70)
    best = bets.withColumn("fit", F.coalesce(fit, F.lit(False))).orderBy(F.desc("fit"), F.desc("value_score"), F.desc("confidence_pct"), "game_id").limit(limit + 1).filter("fit")
    order = Window.orderBy(F.desc("value_score"), F.desc("confidence_pct"), "game_id")
    leg = F.concat(F.col("home_name"), F.lit(" vs "), F.col("away_name"), F.lit(": "), F.col("bet_type"), F.lit(" ("), F.col("odds").cast("string"), F.lit(")"))
    ranked = best.withColumns({"place": F.row_number().over(order), "leg": leg, "price": decimal_odds(F.col("odds"))})
    following = {f"next_{c}": F.lead(c).over(order) for c in ("leg", "price", "value_score")}
    pairs = ranked.withColumns(following).filter(F.col("next_leg").isNotNull() & (F.col("place") <= limit))
    combined = american_from_decimal(F.col("price") * F.col("next_price"))
    return pairs.select(
        F.col("place").cast("long").alias("parlay_id"),
        F.lit("2-Game Value Parlay").alias("name"),
        combined.alias("combined_odds"),
        rounded(combined * 1.5, 2).alias("potential_payout"),
        rounded(F.col("price") * F.col("next_price"), 6).alias("decimal_payout"),
        rounded((F.col("value_score") + F.col("next_value_score")) / 2.0, 2).alias("value_score"),
        F.concat_ws("; ", "leg", "next_leg").alias("bets"),
    )


def slip_odds(legs: DataFrame) -> DataFrame:
    """slip_id, legs, decimal and American odds: the product in leg order, so it is the same in any partitioning."""
    in_order = F.array_sort(F.collect_list(F.struct("leg_no", decimal_odds(F.col("odds")).alias("price"))))
    product = F.aggregate(in_order, F.lit(1.0), lambda s, x: s * x["price"])
    return legs.groupBy("slip_id").agg(F.count(F.lit(1)).alias("legs"), product.alias("combined")).select("slip_id", "legs", rounded("combined").alias("decimal_odds"), american_from_decimal(F.col("combined")).alias("american_odds"))


def slip_payouts(slips: DataFrame) -> DataFrame:
    """slips (kind, amount, odds, legs) with the potential payout."""
    return slips.withColumn("payout", rounded(F.col("amount") * payout_multiplier(F.col("kind"), F.col("odds"), F.col("legs")), 4))


def checked_slips(slips: DataFrame) -> DataFrame:
    """Adds reject_reason, null for a slip that may be placed: type, amount, a team for singles, a leg for parlays."""
    reason = (
        F.when(F.col("kind").isNull(), "type required")
        .when(~(F.coalesce(F.col("amount"), F.lit(0)) > 0), "amount must be positive")
        .when(F.col("kind").isin("spread", "moneyline") & F.col("side").isNull(), "team required")
        .when((F.col("kind") == "parlay") & ~(F.coalesce(F.col("legs"), F.lit(0)) >= 1), "parlay needs a leg")
    )
    return slips.withColumn("reject_reason", reason)


def settled(legs: DataFrame, results: DataFrame) -> DataFrame:
    """slip_id, kind, legs, won, stake, payout, profit: a slip wins when all its legs do; legs without a result leave it open (null).

    A spread leg wins if the picked side's margin plus its line is above 0, another leg if the picked side wins. A slip
    of one leg pays by the leg's type, a slip of more as a parlay.
    """
    home = F.col("side") == "home"
    margin = F.when(home, F.col("final_spread")).otherwise(-F.col("final_spread"))
    right = F.when(F.col("bet_type") == "spread", margin + F.coalesce("line", F.lit(0.0)) > 0).otherwise(F.when(home, F.col("home_id")).otherwise(F.col("away_id")) == F.col("actual_winner"))
    joined = legs.join(results.select("game_id", "home_id", "away_id", "actual_winner", "final_spread"), "game_id", "left").withColumn("leg_won", F.when(F.col("home_id").isNotNull(), F.coalesce(right, F.lit(False))))
    per_slip = joined.groupBy("slip_id").agg(F.count(F.lit(1)).alias("legs"), F.min("bet_type").alias("bet_type"), F.max("odds").alias("odds"), F.count("leg_won").alias("known"), F.bool_and("leg_won").alias("all_won"), F.max_by("amount", F.struct("amount", "leg_no")).cast("double").alias("stake"))
    per_slip = per_slip.withColumn("kind", F.when(F.col("legs") > 1, "parlay").otherwise(F.col("bet_type")))
    won = F.when(~F.col("all_won"), False).when(F.col("known") == F.col("legs"), F.col("all_won"))
    payout = F.when(won, F.col("stake") * payout_multiplier(F.col("kind"), F.col("odds"), F.col("legs"))).when(~won, 0.0)
    return per_slip.select("slip_id", "kind", "legs", won.alias("won"), "stake", rounded(payout, 4).alias("payout"), rounded(payout - F.col("stake"), 4).alias("profit"))


def edges(forecasts: DataFrame, odds: DataFrame) -> DataFrame:
    """Market odds against the forecast: sides whose probability exceeds the implied one."""
    joined = forecasts.select("game_id", "p_home", "p_away").join(odds.filter("home_ml is not null and away_ml is not null"), "game_id")
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"p_{s}").alias("p"), implied_probability(F.col(f"{s}_ml")).alias("implied")) for s in ("home", "away")]))
    return joined.select("game_id", sides.alias("s")).select("game_id", "s.side", rounded("s.p").alias("p"), rounded("s.implied").alias("implied"), rounded(F.col("s.p") - F.col("s.implied")).alias("edge")).filter(F.col("edge") > 0)
