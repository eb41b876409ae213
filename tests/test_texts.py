"""Texts of articles are scored by all cores."""

from courtside.operators import text


def test_texts_of_one_row_group_are_scored_by_all_cores(spark):
    """The plan had no shuffle of the texts: one task split and scored them all."""
    articles = spark.range(400).selectExpr("id AS article_id", "'Bad. Good day.' AS title", "concat('good ', id, '. bad!') AS content").coalesce(1)
    lexicon = spark.sql("SELECT * FROM VALUES ('good', 1.5D), ('bad', -2.5D) AS t(token, valence)")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scored = text.sentence_scores(articles, lexicon)
        assert scored.rdd.getNumPartitions() == 4 and scored.count() == 400
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning(article_id")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
