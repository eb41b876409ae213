"""The queries opN_<name>: thin applications of the operators to the driver's tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm import byte_bpe, collocations, html_extraction, language_id, minhash_dedup, quality_rules, secret_scan, sharding, source_mix, topk_search, toxicity, url_filter, whitening
from courtside.llm._common import bucket, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), *url_filter.train(spark))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "v1")
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.policy_mask("base"))) != 0
    return entries.select("doc_id", *quality_rules.MEASURES[:5], base.alias("base_failed"), "kept", "fail_bits")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = language_id.train(docs.filter(bucket(F.col("doc_id"), 4) != 2))
    found = language_id.predict(docs, field)
    return found.select("doc_id", F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, threshold=80)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(secret_scan.listed(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), digest, secret_scan.listed(F.col("spans")).alias("spans"), count("random"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(bucket(F.col("doc_id"), 5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A deviation that no long holds raises.
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=24, law="rows")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_topk_search, op3_quality_rules, op4_language_id, op5_html_extraction, op6_minhash_dedup, op7_secret_scan, op8_toxicity, op9_byte_bpe, op10_source_mix, op11_whitening, op12_sharding, op13_collocations)}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": r"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        words AS (SELECT doc_id, i, w[i] AS word, w[i + 1] AS next, CASE WHEN i + 7 <= len(w) THEN array_to_string(w[i:i + 7], ' ') END AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs)),
        runs AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM words WHERE run IS NOT NULL),
        repeats AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM runs, range(0, 8) AS r(o) WHERE n > 1 GROUP BY doc_id),
        tops AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, word, count(*) AS n FROM words GROUP BY ALL) GROUP BY doc_id),
        echoes AS (SELECT doc_id, count(*) FILTER (WHERE word = next) AS n FROM words GROUP BY doc_id),
        lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
        m AS (
            SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
                length(regexp_replace(t, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_upper,
                length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs, coalesce(tops.n, 0) AS n_top_word, coalesce(echoes.n, 0) AS n_echoes
            FROM docs LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN tops USING (doc_id) LEFT JOIN echoes USING (doc_id)),
        b AS (
            SELECT *, CAST(n_words < 20 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS BIGINT) + 4 * CAST(100 * n_symbols > 25 * n_words AS BIGINT)
                + 8 * CAST(100 * n_upper > 40 * n_letters AND 2 * n_letters >= word_chars AS BIGINT) + 16 * CAST(100 * n_bangs > 30 * n_words AS BIGINT) + 32 * CAST(n_words >= 20 AND 100 * n_top_word > 40 * n_words AS BIGINT)
                + 64 * CAST(word_chars < 2 * n_words OR word_chars > 14 * n_words AS BIGINT) + 128 * CAST(n_words > 0 AND 8 * n_dup_lines > n_words AS BIGINT) + 256 * CAST(100 * n_echoes > 25 * n_words AS BIGINT) AS fail_bits
            FROM m)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
            CAST(n_repeat_words AS BIGINT) AS n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b""",
    "op2_topk_search": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score
            FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v) AND len(q.v) > 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10""",
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
            FROM documents WHERE text IS NOT NULL),
        totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
        runs AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces), range(1, 6) AS t(m) WHERE i + m - 1 <= len(w)),
        f AS (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
        candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS p FROM f WHERE m > 1),
        inner_runs AS (SELECT lang, a, array_to_string(p[i:i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM candidates), range(2, 5) AS t(k) WHERE k < m AND i + k - 1 <= m),
        longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_runs GROUP BY ALL),
        kept AS (SELECT c.* FROM candidates c LEFT JOIN longer o ON c.lang = o.lang AND c.phrase = o.phrase WHERE o.longer IS NULL OR 100 * o.longer < 100 * c.a),
        cuts AS (SELECT *, array_to_string(p[1:k], ' ') AS before, array_to_string(p[k + 1:m], ' ') AS after FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
        scored AS (
            SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, k, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
            FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.before JOIN f y ON y.lang = c.lang AND y.phrase = c.after JOIN totals t ON t.lang = c.lang),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000""",
}
