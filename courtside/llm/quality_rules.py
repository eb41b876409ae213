"""Quality rules as a bitmask ledger.

Every rule is evaluated once over a document's measurements; the ledger keeps the measurements and one
bit per failed rule. A policy is a versioned mask of bits that reject, so a new policy, a dropped rule
or an ablation reads the ledger only, never the texts.

Null and empty texts count as texts without words: all measurements are 0 and the length rule fails.
Texts of any length are measured whole. Repeated rows are measured one by one; an empty table gives an empty ledger;
further columns of docs, whatever their names, are left out, or kept as they are where whole rows are asked for.

Capitals and letters are those of ASCII and Latin-1, so the rule on capitals holds only where they make up half of a text's
characters in words: a text in another script with an acronym in Latin letters passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm._common import WordHashes, column, fresh, utf8, window_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_bangs", "n_top_word", "n_echoes")

#: Bit number, name and failing condition of every rule. Bits are never reused.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "too_few_words", "n_words < 20"),
    (1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    (2, "many_symbols", "100 * n_symbols > 25 * n_words"),
    (3, "mostly_capitals", "100 * n_upper > 40 * n_letters and 2 * n_letters >= word_chars"),
    (4, "many_exclamations", "100 * n_bangs > 30 * n_words"),
    (5, "one_word_dominates", "n_words >= 20 and 100 * n_top_word > 40 * n_words"),
    (6, "word_length_out_of_range", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    (7, "duplicate_lines", "n_words > 0 and 8 * n_dup_lines > n_words"),
    (8, "echoed_words", "100 * n_echoes > 25 * n_words"),
)

#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(name for _, name, _ in RULES),
}


def policy_mask(policy: str) -> int:
    return sum(1 << bit for bit, name, _ in RULES if name in POLICIES[policy])


def _repeat_words(hashes: np.ndarray, words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words which occurs at least twice."""
    runs = window_hashes(hashes, WINDOW)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    ranked = runs[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(runs), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(data: bytes | None, memo: WordHashes) -> tuple[int, ...]:
    """The MEASURES of one UTF-8 text."""
    words = data.split() if data else []
    if not words:
        return (0,) * len(MEASURES)
    raw = np.frombuffer(b"".join(words), np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    hashes = memo.of(words)
    lines = [line for line in data.split(b"\n") if line.split()] if b"\n" in data else []
    ascii_upper, ascii_lower = int(by_byte[65:91].sum()), int(by_byte[97:123].sum())
    # Two-byte letters of Latin-1: C3 80..9E upper, C3 9F..BF lower (the times and divide signs apart).
    after = raw[1:][raw[:-1] == 0xC3]
    upper = ascii_upper + int(((after >= 0x80) & (after <= 0x9E) & (after != 0x97)).sum())
    lower = ascii_lower + int(((after >= 0x9F) & (after != 0xB7)).sum())
    top = int(np.unique(hashes, return_counts=True)[1].max())
    continuation = int(by_byte[0x80:0xC0].sum())
    return (
        len(words),
        len(raw) - continuation,
        sum(int(by_byte[b]) for b in SYMBOLS),
        len(lines) - len(set(lines)),
        _repeat_words(hashes, words),
        upper + lower,
        upper,
        int(by_byte[33]),
        top,
        int((hashes[1:] == hashes[:-1]).sum()),
    )


def _measured(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    memo = WordHashes()
    for batch in texts:
        rows = np.array([measure(x, memo) for x in utf8(batch)], np.int64).reshape(-1, len(MEASURES))
        yield pa.StructArray.from_arrays([pa.array(c) for c in rows.T], list(MEASURES))


def fail_bits() -> Column:
    """One bit for each failing rule of RULES."""
    return sum((F.when(F.expr(when), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, _, when in RULES[1:]), F.when(F.expr(RULES[0][2]), F.lit(1 << RULES[0][0])).otherwise(F.lit(0))).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """docs -> id, the MEASURES (long), fail_bits (long). ``whole_rows``: every column of docs as struct ``doc`` instead of the id."""
    kept = F.struct(*[column(docs, c) for c in docs.columns]).alias("doc") if whole_rows else column(docs, id_col)
    found = fresh(docs, "found")
    # Only the text goes to Python; a function marked as not deterministic is run once, whatever reads its result.
    measured = docs.withColumn(found, F.arrow_udf(_measured, ", ".join(f"{m} long" for m in MEASURES)).asNondeterministic()(column(docs, text_col).cast("string")))
    return measured.select(kept, *[F.col(found)[m].alias(m) for m in MEASURES]).select("*", fail_bits().alias("fail_bits"))


def apply_policy(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds kept: no bit of the policy is set."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablations(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """dropped_rule (null: none), n_docs, n_kept: what the policy keeps without each of its rules.

    The ledger shrinks to one row per distinct bitmask first, then every ablation is a mask over those rows.
    """
    histogram = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    mask = policy_mask(policy)
    options = [F.struct(F.lit(None).cast("string").alias("dropped_rule"), F.lit(mask).alias("mask"))]
    options += [F.struct(F.lit(name).alias("dropped_rule"), F.lit(mask & ~(1 << bit)).alias("mask")) for bit, name, _ in RULES if name in POLICIES[policy]]
    each = histogram.select("fail_bits", "n", F.explode(F.array(*options)).alias("o")).select("n", "o.dropped_rule", F.col("fail_bits").bitwiseAND(F.col("o.mask")).alias("bits"))
    return each.groupBy("dropped_rule").agg(F.sum("n").alias("n_docs"), F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"))
