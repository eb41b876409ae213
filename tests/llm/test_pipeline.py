"""The pipeline's rows on the smallest tables against a plain version of every stage."""

import hashlib
import os
import sys
from collections import Counter

import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from courtside.llm import quality_rules  # noqa: E402
from courtside.llm._common import WordHashes  # noqa: E402
from tests.llm.test_dedup_secrets import brute_components, brute_spans  # noqa: E402
from tests.llm.test_rules_mix_bpe import brute_targets, reference_encoding, words  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def masked(text):
    out, at = [], 0
    for start, _, end in brute_spans(text):
        if end > at:
            out += [text[at:start], "[secret]"] if start >= at else []
            at = end
    return "".join(out) + text[at:]


def sums(lengths):
    reach = {0}
    for n in lengths:
        reach |= {x + n for x in reach}
    return reach


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    memo, kept = WordHashes(), {}
    for i, r in rows.items():
        values = dict(zip(quality_rules.MEASURES, quality_rules.measure(r["text"].encode(), memo)))
        if not any(eval(rule, {}, values) for _, _, rule in quality_rules.RULES):  # the rules are plain comparisons
            kept[i] = r["text"]
    stage = dict(corpus_pipeline.STAGES)
    first = stage["quality_rules"](spark, docs, SF)
    assert first.columns == columns and {r["doc_id"]: r["text"] for r in first.collect()} == kept

    second = stage["minhash_dedup"](spark, first, SF)
    alone = {i: kept[i] for i, (_, c) in brute_components(list(kept.items()), 5, 80).items() if c == i}
    assert second.columns == columns and {r["doc_id"]: r["text"] for r in second.collect()} == alone

    third = stage["secret_scan"](spark, second, SF)
    texts = {r["doc_id"]: r for r in third.collect()}
    assert third.columns == columns and {i: r["text"] for i, r in texts.items()} == {i: masked(t) for i, t in alone.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())

    sizes = Counter()
    for i, r in texts.items():
        sizes[r["source"]] += len(words(r["text"]))
    taken, repeats, targets = Counter(), Counter(), brute_targets(sizes)
    fourth = stage["source_mix"](spark, third, SF)
    assert fourth.columns == columns
    for r in fourth.collect():
        assert r["text"] == texts[r["doc_id"]]["text"]
        repeats[r["doc_id"]] += 1
        taken[r["source"]] += len(words(r["text"]))
    assert max(repeats.values()) <= 3
    for s, target in targets.items():
        lengths = [len(words(r["text"])) for r in texts.values() if r["source"] == s]
        whole = int(target // sizes[s])
        nearest = min((abs(x + whole * sizes[s] - round(target)) for x in sums(lengths)), default=0)
        assert abs(taken[s] - round(target)) == nearest

    encoding = reference_encoding()
    last = stage["byte_bpe"](spark, fourth, SF).collect()
    assert Counter(r["doc_id"] for r in last) == repeats
    for r in last:
        ids = encoding.encode_ordinary(texts[r["doc_id"]]["text"])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert public_tokenizers.PATTERN


def test_odd_tables(spark):
    """Empty table, repeated ids, nulls in every column, and columns whose names clash or hold a dot."""
    names = "doc_id long, text string, lang string, source string, n_chars int, `a.b` int, __kept string, doc string, found string, kept string"
    good = "the old red barn near the river was quiet on that day while rain fell softly over every roof in our small town tonight"
    rows = [(1, good, "en", "s", 1, 1, "k", "d", "f", "x"), (1, good + " again", "en", "s", 1, 1, "k", "d", "f", "x"), (None,) * 10, (2, None, None, None, None, None, None, None, None, None), (3, good.upper().lower() + " with password = hunter2222", None, None, 5, 2, None, None, None, None)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, names)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == spark.createDataFrame([], names).columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= (len(data) > 0)
