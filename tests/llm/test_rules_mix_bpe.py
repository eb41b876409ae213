"""Quality rules, source mixing and byte-level BPE against brute force, with nulls, blanks, ties and clashes."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from courtside.llm import byte_bpe, quality_rules, source_mix
from courtside.llm._common import WordHashes

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, id string"
WS = " \t\n\x0b\x0c\r"


def docs(spark, texts, sources=None):
    sources = sources or [None] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, "y") for i, (t, s) in enumerate(zip(texts, sources))], DOCS)


def words(text):
    out, word = [], ""
    for c in text or "":
        if c in WS:
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


def brute_measures(text):
    w = words(text)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t ", "a b", "x\x1cy\x85z\xa0q", "é ß 漢字 *** $$", "a b c d e f g h " * 3, "line one\nline one\n \n \nline", "w " * 20, "the quick brown fox jumps over the lazy dog near the old red barn while it rains on every roof in town", "A" * 100_000, ("lorem ipsum dolor " * 9000),
]


def test_measures_match_brute_force():
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["a", "bb", "the", "*x", "é\n"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    memo = WordHashes(limit=4)
    for t in texts:
        assert quality_rules.measure(t.encode() if t is not None else None, memo)[:5] == brute_measures(t)


def test_ledger_and_policies(spark):
    entries = quality_rules.ledger(docs(spark, TEXTS)).cache()
    rows = {r["doc_id"]: r for r in quality_rules.apply_policy(entries).collect()}
    assert len(rows) == len(TEXTS) and not rows[0]["kept"] and rows[9]["kept"]
    assert rows[6]["fail_bits"] & 2 and rows[8]["fail_bits"] & 256
    ablated = {r["dropped_rule"]: (r["n_docs"], r["n_kept"]) for r in quality_rules.ablations(entries).collect()}
    bits = [r["fail_bits"] for r in rows.values()]
    for bit, name, _ in quality_rules.RULES:
        mask = quality_rules.policy_mask("v1") & ~(1 << bit)
        assert ablated[name] == (len(bits), sum(b & mask == 0 for b in bits))
    assert ablated[None][1] == sum(r["kept"] for r in rows.values())


def test_capitals_and_repeated_rows(spark):
    greek = "οι λέξεις ενός κειμένου με ένα NATO " * 8
    shout = "THESE WORDS ARE ALL IN CAPITALS and some are not " * 4
    rows = docs(spark, [greek, shout, greek, greek])
    found = quality_rules.apply_policy(quality_rules.ledger(rows.unionByName(rows))).collect()
    assert len(found) == 8
    assert {(r["doc_id"] == 1, bool(r["fail_bits"] & 8)) for r in found} == {(False, False), (True, True)}


def test_ledger_of_nothing(spark):
    assert quality_rules.ledger(docs(spark, [])).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Reshare the excess by weight until none is above its cap, in exact fractions."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: Fraction(weights[i % 3]) for i, s in enumerate(order)}
    total, done, out = Fraction(sum(sizes.values())), set(), {}
    while len(done) < len(order):
        free = [s for s in order if s not in done]
        left, share = total - sum(out[s] for s in done), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / share > cap * sizes[s]]
        if not over:
            return out | {s: left * w[s] / share for s in free}
        for s in over:
            out[s] = Fraction(cap * sizes[s])
            done.add(s)
    return out


def test_targets_match_repeated_resharing(spark):
    rng = random.Random(5)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 7, 50, 400, 3000]) for s in rng.sample(["a", "b", "ä", "Z", "zz", None, "", "q", "r"], 6)}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        want = brute_targets(sizes)
        for r in source_mix.source_targets(rows).collect():
            assert r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12, abs=1e-9)


def best_sum(lengths, counts, budget):
    reach = {0}
    for n, c in zip(lengths, counts):
        reach = {s + n * k for s in reach for k in range(c + 1)}
    return min(reach, key=lambda s: (abs(s - budget), s))


def test_fit_budget_is_the_best_sum():
    rng = random.Random(9)
    for _ in range(60):
        lengths = rng.sample(range(1, 40), 5)
        counts = [rng.randrange(1, 5) for _ in lengths]
        budget = rng.randrange(0, sum(a * b for a, b in zip(lengths, counts)) + 10)
        take = source_mix.fit_budget(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        got = sum(a * b for a, b in zip(lengths, take))
        assert abs(got - budget) == abs(best_sum(lengths, counts, budget) - budget)


def test_fit_budget_holds_no_table_of_all_sums():
    """Even lengths and an odd budget: no sum fits, so the programme sees every length."""
    import tracemalloc

    lengths = [2 * k for k in range(1, 3001)]
    tracemalloc.start()
    take = source_mix.fit_budget(lengths, [3] * len(lengths), 1_000_001)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(sum(n * k for n, k in zip(lengths, take)) - 1_000_001) == 1 and peak < 20e6


def test_mix_of_very_long_texts(spark):
    d = docs(spark, ["w " * 200_000, "w", "w " * 10], ["a", "a", "b"])
    assert {r["doc_id"]: r["size"] for r in source_mix.mix_sources(d).collect()} == {0: 200_000, 1: 1, 2: 10}


def test_mix(spark):
    rng = random.Random(1)
    texts = [" ".join("w" for _ in range(rng.choice([0, 1, 5, 5, 5, 40]))) for _ in range(600)] + [None]
    sources = [rng.choice(["s1", "s1", "s1", "s2", None]) for _ in texts]
    d = docs(spark, texts, sources)
    once = {r["doc_id"]: r for r in source_mix.mix_sources(d, ranges=8).collect()}
    again = {r["doc_id"]: r for r in source_mix.mix_sources(d.repartition(7), ranges=8).collect()}
    assert once == again and len(once) == len(texts)
    taken, target = Counter(), {}
    for i, r in once.items():
        assert r["size"] == len(words(texts[i])) and 0 <= r["repeats"] <= 3
        taken[sources[i]] += r["repeats"] * r["size"]
        target[sources[i]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1
    whole = source_mix.mix_sources(d, ranges=8, whole_rows=True).select("doc.*", "repeats")
    assert {r["doc_id"]: r["repeats"] for r in whole.collect()} == {i: r["repeats"] for i, r in once.items()}


def test_mix_of_nothing(spark):
    assert source_mix.mix_sources(docs(spark, [])).count() == 0
    assert [r["repeats"] for r in source_mix.mix_sources(docs(spark, [None, ""])).collect()] == [0, 0]


ODD = ["", "a  b", " a b ", "a \n b c", "x\ty z  ", "a\xa0b", "a\x1c\x1d b\x85\xa0 c \u2028\u200b\u3000 x", "   \n\n  ", "ab" * 3000, "é" * 1000 + " ٣٤ Ⅷ ² ", "it's 'LL 're''ve", "\x00\ufffe🎉🎉 👨\u200d👩\u200d👧", "<|endoftext|> x", "don't  stop\n\n\nnow!!"]


def reference_encoding():
    ranks = {t: i for i, t in enumerate(byte_bpe.load_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_equals_the_library(spark):
    enc, rng = reference_encoding(), random.Random(2)
    alphabet = list("abcdeéñß漢 \n\t'.,!1²") + ["  ", "'s", "The", "ing"]
    texts = [None, *ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(300))]
    d = docs(spark, texts)
    for r in byte_bpe.round_trip(d, PATH, public_tokenizers.PATTERN).collect():
        text = texts[r["doc_id"]] or ""
        ids = enc.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    encoded = byte_bpe.encode(d, PATH, public_tokenizers.PATTERN)
    back = {r["doc_id"]: bytes(r["data"]).decode() for r in byte_bpe.decode(encoded, PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(999)] + [b""]
    table = byte_bpe.PerfectHash(keys)
    assert [table.rank(k) for k in keys] == list(range(len(keys))) and sorted(table.slots) == list(range(len(keys)))


def test_clashing_columns(spark):
    d = docs(spark, ["a b c"]).withColumn("repeats", F.lit("z")).withColumn("row", F.lit("z")).withColumn("a.b", F.lit(1)).withColumn("found", F.lit(2))
    assert source_mix.mix_sources(d, whole_rows=True).select("doc.*").columns == d.columns
    assert quality_rules.ledger(d, whole_rows=True).select("doc.*").columns == d.columns
    assert byte_bpe.round_trip(d, PATH, public_tokenizers.PATTERN).count() == 1


def test_bpe_of_nothing_and_repeated_rows(spark):
    assert byte_bpe.round_trip(docs(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
    d = docs(spark, ["one two", None])
    assert byte_bpe.round_trip(d.union(d), PATH, public_tokenizers.PATTERN).distinct().count() == 2


def test_memos_of_any_size_give_the_same_ids():
    """With memos that turn over all the time, and under a pattern that lets pre-tokens cross spaces."""
    rng, enc = random.Random(7), reference_encoding()
    vocabulary = byte_bpe.load_ranks(PATH)
    small = byte_bpe.Codec(vocabulary, public_tokenizers.PATTERN, limit=2)
    texts = [" ".join(rng.choice(["the", "ofthing", "x" * 70, "eau.", "\n"]) for _ in range(rng.randrange(30))) for _ in range(60)]
    for text in texts:
        assert small.encode(text) == enc.encode_ordinary(text)
        assert len(small.parts) <= 2 and len(small.parts.old) <= 2
    other = r"[^\n]+|\n+"
    wide = byte_bpe.Codec(vocabulary, other)
    library = tiktoken.Encoding("other", pat_str=other, mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})
    assert all(wide.encode(t) == library.encode_ordinary(t) for t in texts)
    small.forget()
    assert not small.parts and not small.pieces.old
