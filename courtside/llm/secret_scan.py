"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

The patterns give the base spans. The battery then looks at every other run of 20 or more token characters:
its encoding is inferred from its alphabet (hex, base32, base64, letters), and three tests ask whether it is a
uniform random string of that alphabet: chi-squared uniformity of the symbols, the number of runs of digits,
upper and lower case against what the class sizes allow, and the serial correlation of neighbours. The smallest
of the three p-values, times three, is the run's p-value; a run under LEAST is not random.

Each run that passes is held against ordinary runs: words, numbers and names made of them, which keep to one
class of symbols for a while and follow the letter pairs of ordinary words. A run's likelihood as an ordinary run
over its likelihood as a random string is a p-value of "this run is ordinary" (by Markov's inequality it is under
t with a chance of t at most), however few runs there are. Benjamini and Hochberg's procedure then picks the
random runs of each encoding and length band at the share ``fdr`` of ordinary ones. Copies of a run count once.
So a strong run passes alone, and a weak one only where many others are strong. The histogram has at most
4 encodings * 7 bands * (TOP_BITS + 1) rows, however large the corpus.

Null texts are empty texts: no spans. Texts of any length are scanned whole; repeated rows are scanned one by
one; further columns, whatever their names, are left out of a scan and kept by ``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm._common import column, fresh, materialize, quoted

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
#: The least p-value of a random run, so that one random run in a thousand is lost; p-values of ordinary runs are kept in bits, up to TOP_BITS.
LEAST, TOP_BITS = 0.001, 200
#: Lower ends of the length bands.
BANDS = (20, 24, 32, 40, 64, 128, 256)

SPAN = "array<struct<kind:string,start:int,stop:int>>"
RUNS = "array<struct<start:int,stop:int,encoding:string,band:int,bits:int,mark:bigint>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
RUN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("encoding", pa.string()), ("band", pa.int32()), ("bits", pa.int32()), ("mark", pa.int64())]))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind as listed."""
    found = []
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    # Runs shorter than 32 fail; a run of 32 or more is found whole by asking for 32 at once.
    if max(map(len, text.split()), default=0) >= 32:
        found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return [(start, KINDS[kind], end) for start, kind, end in sorted(found)]


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_tail(x: float, freedom: int) -> float:
    """Wilson and Hilferty's approximation of the upper tail."""
    scale = 2 / (9 * freedom)
    return normal_tail(((max(x, 0) / freedom) ** (1 / 3) - (1 - scale)) / math.sqrt(scale))


def encoding(run: str) -> tuple[str, str]:
    """The smallest usual alphabet that holds the run, and its symbols."""
    body = run.rstrip("=")
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body):
        return "hex", "0123456789abcdef"
    if re.fullmatch(r"[A-Z2-7]+", body) and re.search(r"[2-7]", body):
        return "base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    if re.fullmatch(r"[A-Za-z]+", body):
        return "letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    return "base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def randomness(run: str) -> tuple[str, float]:
    """The inferred encoding and the battery's p-value under uniform symbols."""
    kind, alphabet = encoding(run)
    body = run.rstrip("=").translate({ord("-"): "+", ord("_"): "/"})
    if kind == "hex":
        body = body.lower()
    codes = [alphabet.index(c) for c in body]
    n, m = len(codes), len(alphabet)
    if n < 4:
        return kind, 0.0
    counts: dict[int, int] = {}
    for c in codes:
        counts[c] = counts.get(c, 0) + 1
    uniform = chi_squared_tail(sum(k * k for k in counts.values()) * m / n - n, m - 1)
    classes = [0 if c.isdigit() else 1 if c.isupper() else 2 for c in body]
    shares = [alphabet_class / m for alphabet_class in (sum(c.isdigit() for c in alphabet), sum(c.isupper() for c in alphabet), sum(c.islower() or c in "+/" for c in alphabet))]
    same = sum(p * p for p in shares)
    runs = 1 + sum(a != b for a, b in zip(classes, classes[1:]))
    spread = math.sqrt((n - 1) * same * (1 - same)) if 0 < same < 1 else 0
    by_runs = 2 * normal_tail(abs(runs - 1 - (n - 1) * (1 - same)) / spread) if spread else 1.0
    # Each class must occur about as often as its share, or the run is a word with a digit.
    by_class = min(2 * normal_tail(abs(classes.count(k) - n * p) / math.sqrt(n * p * (1 - p))) if 0 < p < 1 else 1.0 for k, p in enumerate(shares))
    mean = sum(codes) / n
    variance = sum((c - mean) ** 2 for c in codes)
    serial = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / variance if variance else 1.0
    by_serial = 2 * normal_tail(abs(serial + 1 / n) * math.sqrt(n))
    return kind, min(1.0, 3 * min(uniform, min(by_runs, 2 * by_class), by_serial))


#: Words whose letter pairs stand for ordinary runs.
WORDS = """the and that have with this from they would there their what about which when make can like time just know take people into year your good some
could them other than then now look only come over think also back after use two how our work first well way even new want because any these give day most
name value user index file data list table config server client request response number string object array message service account address version update
der die und ist nicht mit sich des auf eine als werden oder aber durch nach einer wenn noch zwischen gegen ohne schon immer wieder jahr
le les des est dans pour que qui pas une sur plus par avec tout mais comme nous vous leur bien aussi entre sans encore autre
el los las una por con para como pero sus entre cuando muy sin sobre tiene desde todo nos durante contra ese esto hasta donde quien""".split()
#: The share of pairs of WORDS in a letter's chance; the rest is even.
PAIRS = 0.5
#: Chances of the next symbol's class (lower, upper, digit, sign) after each class, in plain words and numbers and in names of capitalised words.
CLASSES = "luds"
CHAINS = (
    {"l": (0.79, 0.07, 0.07, 0.07), "u": (0.45, 0.45, 0.05, 0.05), "d": (0.07, 0.07, 0.79, 0.07), "s": (0.07, 0.07, 0.07, 0.79)},
    {"l": (0.65, 0.25, 0.05, 0.05), "u": (0.6, 0.3, 0.05, 0.05), "d": (0.15, 0.3, 0.5, 0.05), "s": (0.45, 0.35, 0.15, 0.05)},
)
#: Alphabets among which encoding() picks: hex in two cases, base32, letters, base64 with two sets of signs.
ALPHABETS = 6


def _pair_bits() -> dict[str, float]:
    """-log2 of each letter's chance after each letter, pairs of WORDS mixed with equal chances; the key '?x' stands for a first letter."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    counts: dict[str, int] = {}
    for word in WORDS:
        for pair in zip("?" + word, word):
            counts["".join(pair)] = counts.get("".join(pair), 0) + 1
    out = {}
    for before in "?" + letters:
        total = sum(counts.get(before + x, 0) for x in letters)
        for x in letters:
            seen = counts.get(before + x, 0) / total if total else 1 / 26
            out[before + x] = -math.log2(PAIRS * seen + (1 - PAIRS) / 26)
    return out


PAIR_BITS = _pair_bits()
STEP_BITS = [{before + kind: -math.log2(p) for before, row in chain.items() for kind, p in zip(CLASSES, row)} for chain in CHAINS]


def ordinary_bits(run: str) -> float:
    """-log2 of the run's chance as an ordinary run: the better chain of symbol classes, letters by pairs, digits and signs evenly."""
    steps, symbols, before, last = [0.0] * len(CHAINS), 0.0, "", "?"
    for c in run.rstrip("="):
        kind = "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s"
        if before:
            steps = [bits + chain[before + kind] for bits, chain in zip(steps, STEP_BITS)]
        if kind in "lu":
            x = c.lower()
            symbols += PAIR_BITS[("?" if before == "l" and kind == "u" else last) + x]
            last = x
        else:
            symbols += math.log2(10) if kind == "d" else 1.0
            last = "?"
        before = kind
    return math.log2(len(CLASSES)) + math.log2(len(CHAINS)) + min(steps) + symbols


def evidence(run: str) -> tuple[str, int]:
    """The inferred encoding, and how many bits speak against an ordinary run; 0 if the battery finds it not random."""
    kind, p = randomness(run)
    if p < LEAST:
        return kind, 0
    random_bits = len(run.rstrip("=")) * math.log2(len(encoding(run)[1])) + math.log2(ALPHABETS)
    return kind, max(0, min(TOP_BITS, math.floor(ordinary_bits(run) - random_bits)))


def _scan(text: str) -> tuple[list[dict], list[dict]]:
    base = base_spans(text)
    spans = [{"kind": kind, "start": start, "stop": end} for start, kind, end in base]
    runs = []
    if max(map(len, text.split()), default=0) >= 20:
        for m in RUN.finditer(text):
            if any(start < m.end() and m.start() < end for start, _, end in base):
                continue
            kind, bits = evidence(m[0])
            band = sum(len(m[0]) >= least for least in BANDS) - 1
            runs.append({"start": m.start(), "stop": m.end(), "encoding": kind, "band": band, "bits": bits, "mark": int.from_bytes(hashlib.blake2b(m[0].encode(), digest_size=8).digest(), "big", signed=True)})
    return spans, runs


def cutoffs(histogram: list[tuple[str, int, int, int]], fdr: float) -> dict[tuple[str, int], int]:
    """(encoding, band, bits, count of distinct runs) rows -> the fewest bits of a random run of each encoding and band, by Benjamini and Hochberg."""
    counts: dict[tuple[str, int], dict[int, int]] = {}
    for kind, band, bits, n in histogram:
        row = counts.setdefault((kind, band), {})
        row[bits] = row.get(bits, 0) + n
    out = {}
    for key, row in counts.items():
        total, above = sum(row.values()), 0
        for bits in sorted(row, reverse=True):
            above += row[bits]
            if bits and 0.5**bits * total <= fdr * above:
                out[key] = bits
    return out


def _found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        found = [_scan(x.as_py() or "") for x in batch]
        yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], SPAN_TYPE), pa.array([f[1] for f in found], RUN_TYPE)], ["base", "runs"])


def found(text: Column) -> Column:
    """struct<base, runs>: a text's base spans, and its other runs with what speaks for them."""
    return F.arrow_udf(_found, f"struct<base:{SPAN},runs:{RUNS}>").asNondeterministic()(text.cast("string"))


def learned(runs: DataFrame, fdr: float) -> dict[tuple[str, int], int]:
    """The cut-offs from a column ``runs``, over all rows."""
    bins = runs.select(F.explode("runs").alias("r")).select("r.encoding", "r.band", "r.bits", "r.mark").distinct().groupBy("encoding", "band", "bits").count()
    return cutoffs([tuple(x) for x in bins.collect()], fdr)


def scan(docs: DataFrame, fdr: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> id, spans array<struct<kind, start, stop>> in code points, by start, then kind; base spans and random runs."""
    each = docs.select(column(docs, id_col).alias("id"), found(column(docs, text_col)).alias("f"))
    scanned = materialize(each.select("id", "f.base", "f.runs"), "secrets")
    cuts = learned(scanned, fdr)
    least = F.create_map(*[F.lit(x) for (k, b), c in sorted(cuts.items()) for x in (f"{k}:{b}", c)]) if cuts else F.create_map(F.lit(""), F.lit(TOP_BITS))
    random = F.filter("runs", lambda r: F.coalesce(r["bits"] >= F.try_element_at(least, F.concat_ws(":", r["encoding"], r["band"].cast("string"))), F.lit(False)))
    added = F.transform(random, lambda r: F.struct(F.lit("random").alias("kind"), r["start"].alias("start"), r["stop"].alias("stop")))
    by_start = F.transform(F.array_sort(F.transform(F.concat("base", added), lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"), s["kind"].alias("kind"), s["stop"].alias("stop")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return scanned.select(F.col("id").alias(id_col), by_start.alias("spans"))


def listed(spans) -> "F.Column":
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[secret]", fdr: float = 0.05, text_col: str = "text") -> DataFrame:
    """docs with every found span of the text replaced by ``mark``; n_chars, where there is one, follows the new text."""
    source = column(docs, text_col)
    # The texts are scanned once for the cut-offs and once to be masked, which costs less than to keep them in between.
    cuts = learned(docs.select(found(source).alias("f")).select("f.runs"), fdr)

    def masked(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([None if text is None else mask(text, cuts, mark) for text in batch.to_pylist()], pa.string())

    new = fresh(docs, "masked")
    done = docs.withColumn(new, F.arrow_udf(masked, "string").asNondeterministic()(source.cast("string")))
    return done.select(*[F.col(new).alias(c) if c == text_col else F.length(new).cast(t).alias(c) if c == "n_chars" and t in ("int", "bigint") else F.col(quoted(c)) for c, t in docs.dtypes])


def mask(text: str, cuts: dict[tuple[str, int], int], mark: str) -> str:
    """The text with ``mark`` in place of every base span and random run; what overlaps is masked once."""
    spans, runs = _scan(text)
    places = [(s["start"], s["stop"]) for s in spans] + [(r["start"], r["stop"]) for r in runs if r["bits"] >= cuts.get((r["encoding"], r["band"]), TOP_BITS + 1)]
    parts, at = [], 0
    for start, stop in sorted(places):
        if stop <= at:
            continue
        if start >= at:
            parts += [text[at:start], mark]
        at = stop
    return "".join(parts) + text[at:]
