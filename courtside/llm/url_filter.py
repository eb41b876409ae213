"""URL filters: fixed host/path rules, and logistic regression on hashed character n-grams of host and path.

The model is trained by Spark's own LogisticRegression on a small labelled table; scoring is one expression: the
hashes of a URL's n-grams index an array literal of weights, so nothing leaves the JVM, no row is shuffled, and
the work grows with the URLs only.

A null URL, or one without "://", has an empty host and path and gets the model's verdict on those. URLs of any
length are scored whole; repeated rows are judged one by one; of rules that are as long, which cannot both fit, none goes
first; columns besides id and url are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm._common import column

#: Rules as (host suffix / path prefix, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Words of the hosts of the small labelled table: subjects to block, what stands beside them, and ordinary ones in four languages.
BAD = """casino poker roulette blackjack slots jackpot betting bets gambling lottery bingo porn xxx sex adult nude escort erotic webcams hentai viagra cialis pharmacy pills steroids
    slimming payday loans forex crypto doubler replica fake warez crack keygen torrent malware spyware phishing virus ransom adserver ads adclick banner popunder tracker tracking
    spam spamming linkfarm doorway clickbait hotgirls hookup camgirl moneymaker getrich sweepstakes miracle""".split()
BESIDE = "best free online top hot cheap buy win live club zone world shop now hub king city star mega fast super real great my the".split()
GOOD = """library museum weather news theatre garden recipes history physics school university archive travel music painting cinema health nature science railway ocean letters poetry
    maps cycling football chess kitchen parish village river mountain bridge harbour market farm forest island lighthouse orchard castle church council court doctor dentist engine
    factory gallery hotel hospital journal language lecture lessons literature mathematics medicine newspaper observatory orchestra parliament philosophy photography planet pottery
    printing publisher radio research review sailing station student teacher television tourism training transport water wildlife winter wood writing yearbook zoo
    nation education information tradition collection edition question action mention option the other another mother father brother thing think thought there then than
    through north south method faith health hearing reading meeting building evening morning learning standing letter better water winner dinner manner render under
    hand land sand stand brand hands ready bread thread ahead heat seat great area idea sea tea any many only early really family finally lovely
    buch garten kueche schule wetter zeitung verein stadt wald fluss berg reise bahn arbeit familie freunde gesundheit handwerk heimat
    livre jardin cuisine ecole meteo journal ville foret fleuve montagne voyage travail famille sante marche maison
    libro jardin cocina escuela tiempo ciudad bosque montana viaje trabajo familia salud mercado casa tierra""".split()
#: Places of a host name: what comes before it, its zone, and a path.
PLACES = (("www.", "com", "/en/1"), ("", "org", "/page/22.html"), ("m.", "info", "/es/3?page=2"), ("blog.", "eu", "/2024/05/notes"), ("", "net", ""), ("shop.", "co.uk", "/item?id=9"), ("", "de", "/de/745#top"), ("www.", "fr", "/fr/"), ("", "io", "/index.php"))
#: Words of paths that tell by themselves, on hosts that do not.
BAD_PATHS, GOOD_PATHS = "free-casino-bonus xxx/adult-videos cheap-viagra-pills warez/crack.exe poker/signup porn/index online-betting/odds payday-loans/apply".split(), "news/today science/oceans travel/maps.html recipes/cheap-dinners about/contact library/opening-times de/garten/rosen fr/cuisine/soupe".split()


def labelled() -> tuple[tuple[str, int], ...]:
    """The small labelled table: (url, 1 to block or 0 to allow). Every subject stands alone and beside other words, in changing places."""
    rows = []
    for words, label in ((BAD, 1), (GOOD, 0)):
        for k, word in enumerate(words):
            others = [BESIDE[(3 * k + j) % len(BESIDE)] for j in (0, 7)] + [words[(5 * k + 11) % len(words)]]
            names = [word, f"{word}-{others[0]}", f"{others[1]}{word}", f"{others[2]}-{word}"]
            # A name stands in three places; each place is as frequent among both labels.
            rows += [(f"https://{before}{name}.{zone}{path}", label) for j, name in enumerate(names) for m in (0, 3, 6) for before, zone, path in [PLACES[(k + j) % 3 + m]]]
    rows += [(f"http://{before}downloads.{zone}/{path}", label) for paths, label in ((BAD_PATHS, 1), (GOOD_PATHS, 0)) for path in paths for before, zone, _ in PLACES[:2]]
    return tuple(rows)


LABELLED = labelled()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or end; A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or end."""
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _grams(text: Column, tag: str, sizes: tuple[int, ...]) -> Column:
    """The n-grams of a marked text, each with its part's tag; a run of digits counts as one 0."""
    marked = F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]+", "0"), F.lit("$"))

    def of(n: int) -> Column:
        # A second parameter of the function would be the place in the array.
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1))), lambda i: F.concat(F.lit(tag), F.substring(marked, i, F.lit(n))))

    return F.concat(*map(of, sizes))


def slots(host: Column, path: Column, size: int, sizes: tuple[int, ...]) -> Column:
    """Hashed slot, from 1, of every n-gram of host and path."""
    grams = F.array_distinct(F.concat(_grams(host, "h", sizes), _grams(path, "p", sizes)))
    return F.transform(grams, lambda g: (F.pmod(F.xxhash64(g), F.lit(size)) + 1).cast("int"))


def train(spark: SparkSession, labelled=LABELLED, size: int = 8192, sizes: tuple[int, ...] = (3, 4, 5), ridge: float = 0.0005) -> tuple[list[float], float]:
    """Weights of every slot and the intercept, from (url, label) rows; the labelled table is small by contract. Both labels weigh as much."""
    quoted = ", ".join("('" + url.replace("'", "''") + f"', {float(label)}D)" for url, label in labelled)
    rows = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(url, label)")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    blocked = sum(label for _, label in labelled)
    weight = F.when(F.col("label") == 1, len(labelled) / (2 * max(1, blocked))).otherwise(len(labelled) / (2 * max(1, len(labelled) - blocked)))
    counted = rows.select("label", weight.alias("weight"), slots(host, path, size, sizes).cast("array<string>").alias("s"))
    sparse = CountVectorizerModel.from_vocabulary([str(i) for i in range(1, size + 1)], inputCol="s", outputCol="features").setBinary(True)
    fitted = LogisticRegression(maxIter=60, regParam=ridge, standardization=False, weightCol="weight").fit(sparse.transform(counted.coalesce(1)))
    return [float(w) for w in fitted.coefficients], float(fitted.intercept)


def probability(host: Column, path: Column, weights: list[float], intercept: float, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """The model's probability that a URL is to be blocked."""
    literal = F.split(F.lit(",".join(repr(w) for w in weights)), ",").cast("array<double>")
    total = F.aggregate(slots(host, path, len(weights), sizes), F.lit(intercept), lambda s, i: s + F.element_at(literal, i))
    return 1 / (1 + F.exp(-total))


def judge(pages: DataFrame, weights: list[float], intercept: float, rules=RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """pages -> id, host, path, rule, verdict (allow or block: the rule's, else the model's), block_probability."""
    parts = pages.select(column(pages, id_col).alias("id"), host_of(column(pages, url_col)).alias("host"), path_of(column(pages, url_col)).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    scored = parts.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), probability(F.col("host"), F.col("path"), weights, intercept).alias("p"))
    method = F.when(F.col("p") >= threshold, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.col("p").alias("block_probability"))
