"""Whitening, sharding and collocations against plain versions, with nulls, blanks, ties, repeats and clashing names."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.llm import collocations, sharding, whitening


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()

# ---- whitening ----------------------------------------------------------------------------------------------------


def matrices():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 60):
        a = rng.standard_normal((n, n))
        q = np.linalg.qr(rng.standard_normal((n, n)))[0]
        close = np.concatenate([[5, 5, 5 + 1e-13, 3, 3], np.ones(n)])[:n]
        yield from (a @ a.T, np.eye(n) * 7, np.zeros((n, n)), np.diag(np.arange(n) // 3 * 1.0), np.outer(np.arange(n), np.arange(n)) * 1.0, (q * close) @ q.T, (a @ a.T) * 1e12)


def test_leading_eigenvectors():
    for a in matrices():
        a = (a + a.T) / 2
        values, vectors = whitening.eigen(a, 8)
        want = np.sort(np.linalg.eigvalsh(a))[::-1][:8]
        scale = max(abs(want).max(), 1e-300)
        assert len(values) == min(8, len(a)) and np.abs(values - want).max() <= 1e-13 * scale
        assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-13 * scale
        assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() <= 1e-13


def test_sturm_counts():
    d, e = np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.5, 0.0, 0.25])
    all_ = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    points = np.linspace(0, 5, 50)
    assert whitening.below(d, e, points).tolist() == [(all_ < p).sum() for p in points]


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for reach in (1 << 8, 1 << 30, 1 << 52):
        y = rng.integers(-reach, reach, (700, 4))
        y[0], y[1] = -reach, reach - 1
        assert (whitening.products(y) == y.astype(object).T @ y.astype(object)).all()


SCHEMA = "vec_id long, embedding array<float>, id int, v string, n long, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], SCHEMA)


def exact(rows):
    """Sums, deviations and the covariance as fractions."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows]
    n, dims = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dims)]
    deviations = [sum((n * r[d] - sums[d]) ** 2 for d in range(dims)) for r in x]
    covariance = [[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3)) for j in range(dims)] for i in range(dims)]
    return np.array(x, float), np.array(sums) / n, deviations, np.array(covariance)


@pytest.mark.parametrize("reach", [1.0, 3e9])
def test_whitening_equals_a_plain_version(spark, reach):
    rng = np.random.default_rng(int(reach))
    rows = [(i // 2, (rng.standard_normal(10) * reach * np.arange(1, 11)).tolist()) for i in range(300)] + [(None, [1.0] * 10), (7, [1.0] * 10), (7, [1.0] * 10)]
    bad = [(1, None), (2, []), (3, [float("nan")] * 10), (4, [1.0] * 9 + [None]), (5, [float("inf")] * 10), (6, [1.0, 2.0]), (8, [3e38] * 10)]
    found = whitening.whiten(vectors(spark, rows + bad).repartition(5)).collect()
    x, mean, deviations, covariance = exact(rows)
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1][:8], basis[:, ::-1][:, :8]
    assert len(found) == 8 * len(rows) and {r["n"] for r in found} == {len(rows)} and Counter(r["vec_id"] for r in found)[7] == 32
    assert Counter(int(r["deviation"]) for r in found if r["component"] == 1) == Counter(deviations)
    want = (x - mean) @ basis / np.sqrt(values)
    for k in range(8):
        got = np.sort([r["whitened"] for r in found if r["component"] == k + 1])
        plain = min((np.sort(s * want[:, k]) for s in (1, -1)), key=lambda w: np.abs(w - got).max())
        assert np.abs(plain - got).max() < 1e-9
        assert all(r["explained"] == pytest.approx(values[k] / np.trace(covariance), rel=1e-9) for r in found if r["component"] == k + 1)
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None)])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    line = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])])).collect()
    assert {r["component"] for r in line} == {1} and {r["explained"] for r in line} == {1.0}
    with pytest.raises(ValueError, match="max_dims"):
        whitening.whiten(vectors(spark, [(1, [1.0, 2.0])]), max_dims=1)


def test_whitening_agrees_in_any_partitioning(spark):
    rng = np.random.default_rng(1)
    df = vectors(spark, [(i, rng.standard_normal(6).tolist()) for i in range(200)])
    columns = ["vec_id", "component", "deviation", "explained"]
    one, many = (sorted(whitening.whiten(df.repartition(n)).select(columns).collect()) for n in (1, 7))
    assert one == many


# ---- sharding -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("axes", "bits"), [(1, 4), (2, 1), (2, 4), (3, 2), (4, 2)])
def test_curve_visits_neighbours(spark, axes, bits):
    points = spark.range(1 << (axes * bits)).select(*[F.shiftright("id", bits * i).bitwiseAND((1 << bits) - 1).alias(f"a{i}") for i in range(axes)])
    rows = points.withColumn("h", sharding.hilbert_index([F.col(f"a{i}") for i in range(axes)], bits)).collect()
    rows.sort(key=lambda r: r["h"])
    assert [r["h"] for r in rows] == list(range(1 << (axes * bits)))
    assert all(sum(abs(a[i] - b[i]) for i in range(axes)) == 1 for a, b in zip(rows, rows[1:]))


DOCS = "doc_id long, text string, lang string, source string, shard int, slot string, place long, size int, curve int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], DOCS)


def some(n=500):
    rng = random.Random(4)
    rows = [(i, "é" * rng.randrange(400), rng.choice(["en", "de", None]), "hot" if rng.random() < 0.4 else f"s{rng.randrange(30)}") for i in range(n)]
    return rows + [(None, None, None, None), (7, "", "en", "hot"), (7, "x" * 200_000, "en", "hot")] + [(9, "same", "en", "hot")] * 5


@pytest.mark.parametrize("law", sharding.LAWS)
def test_shards_keep_their_law(spark, law):
    rows = some()
    found = sharding.shard(documents(spark, rows), law=law).collect()
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, len(b) + 8, zlib.crc32(b)) for i, b in data)
    shards = defaultdict(list)
    for r in found:
        shards[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards.values()) and set(shards) <= set(range(24))
    if law == "rows":
        counts = [len(shards[s]) for s in range(24)]
        assert max(counts) - min(counts) <= 1
    else:
        longest, total = max(len(b) + 8 for _, b in data), sum(len(b) + 8 for _, b in data)
        assert all(abs(sum(r["size"] for r in shards[s]) - total / 24) <= longest for s in range(24))
    in_order = sorted(found, key=lambda r: (r["shard"], r["slot"]))
    assert all(a["curve"] <= b["curve"] for a, b in zip(in_order, in_order[1:]))


def test_shards_agree_in_any_partitioning(spark):
    df = documents(spark, some())
    one, many = (sorted(map(repr, sharding.shard(df.repartition(n)).collect())) for n in (1, 9))
    assert one == many


def test_levels_halve_the_rows_in_the_order_of_values(spark):
    rows = spark.createDataFrame([(v,) for v in ["b"] * 4 + ["a"] * 2 + [None] * 2], "dim0 string")
    found = {r["dim0"]: r["l"] for r in sharding.levels(rows, "dim0", "l", 3, 8).distinct().collect()}
    assert found == {None: 1, "a": 3, "b": 6}


def test_few_and_no_documents(spark):
    assert sharding.shard(documents(spark, [])).collect() == []
    found = sharding.shard(documents(spark, [(1, "a", "en", "s"), (2, "b", "en", "s")])).collect()
    assert len({r["shard"] for r in found}) == 2 and {r["slot"] for r in found} == {0}
    with pytest.raises(ValueError, match="law"):
        sharding.shard(documents(spark, []), law="key")


def test_files_are_pruned(spark, tmp_path):
    rows = [(i, "x" * (i % 90), "en", f"s{i % 8}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    path = str(tmp_path / "shards")
    sharding.write_shards(sharding.shard(docs, shards=16, whole_rows=True), path)
    zone = sharding.zones(spark, path, ["source", "n_chars"])
    narrow = sharding.read_shards(spark, path, zone, source=("s3", "s3"), n_chars=(0, 20))
    assert sorted(r["doc_id"] for r in narrow.collect()) == [i for i in range(800) if i % 8 == 3 and i % 90 <= 20]
    assert zone.filter("least_source <= 's3' and greatest_source >= 's3' and least_n_chars <= 20").count() <= 6  # of 16
    assert "shard#" in plan(narrow).partition("PartitionFilters: ")[2].split("]")[0]
    assert spark.read.parquet(path).count() == 800


def test_sharding_stays_in_the_jvm(spark):
    assert "Python" not in plan(sharding.shard(documents(spark, some(20))))


# ---- collocations -------------------------------------------------------------------------------------------------


def brute(rows, least, inside, top):
    f, n, out = defaultdict(Counter), Counter(), []
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inner = {q[i : i + m] for q, b in candidates.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * b >= inside * c[q[i : i + m]]}
        ranked = []
        for p, a in candidates.items():
            if p not in inner:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


TEXTS = "doc_id long, text string, lang string, ids string, word int, n int"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2) for i, (t, lang) in enumerate(rows)], TEXTS)


def prose(n=300):
    rng = random.Random(8)
    words = ["New", "york", "é", "ß\x1cx", "the", "of", "A", "漢字", "rare%d"]
    rows = [(None, "en"), ("", "en"), (" .\t!? ", None), ("new york new york new york", None)]
    for _ in range(n):
        t = "".join(rng.choice(words).replace("%d", str(rng.randrange(500))) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(rng.randrange(40)))
        rows.append((t + rng.choice(["", "New York is the city of the day", "YES"]), rng.choice(["en", "en", "de", None, "und"])))
    return rows + [("the of " * 3000 + "a new york", "en")] + rows[:50]


@pytest.mark.parametrize("options", [{}, {"held": 300}, {"broadcast_bytes": 0, "chunk_bytes": 2000}])
@pytest.mark.parametrize(("least", "inside", "top"), [(5, 100, 2000), (3, 70, 40)])
def test_collocations_equal_brute_force(spark, options, least, inside, top):
    rows = prose()
    found = collocations.collocations(texts(spark, rows).repartition(5), least, inside, top, **options).collect()
    assert sorted(map(tuple, found)) == brute(rows, least, inside, top)


def test_no_collocations(spark):
    assert collocations.collocations(texts(spark, [])).collect() == []
    assert collocations.collocations(texts(spark, [(None, None), ("a b", "en")])).collect() == []


def test_scores_pass_64_bits(spark):
    row = spark.createDataFrame([(3 * 10**12, 10**13, 3 * 10**12 + 1, 3 * 10**12 + 7)], "a long, n long, l long, r long")
    score = F.expr("cast(1000 * cast(a as decimal(38, 0)) * n as decimal(38, 0)) div cast(cast(l as decimal(38, 0)) * r as decimal(38, 0))")
    assert row.select(score).first()[0] == 1000 * 3 * 10**12 * 10**13 // ((3 * 10**12 + 1) * (3 * 10**12 + 7))


@pytest.mark.parametrize("bits", [1, 7, 12, 13, 20, 25])
def test_numbers_return_from_the_permutation_and_the_filter(bits):
    rng = np.random.default_rng(bits)
    packing = collocations.Packing(bits)
    ids = [rng.integers(0, 1 << bits, 900).astype(np.uint64) for _ in range(5)]
    left, right = packing.permuted(*packing.packed(ids))
    assert (packing.unpacked(*packing.restored(left, right)) == np.array(ids).T).all()
    left, right, counts = collocations.summed(left, right)
    counts *= rng.integers(1, 1 << 40, len(counts))
    for skip in {0, 1, min(6, packing.half)}:
        prefix = left >> np.uint64(packing.half - skip) if skip else np.zeros_like(left)
        for p in np.unique(prefix):
            mine = prefix == p
            blob = collocations.filter_bytes(left[mine], right[mine], counts[mine], packing.half, skip)
            back = collocations.filter_numbers(blob, packing.half, skip, int(p))
            assert all((a == b[mine]).all() for a, b in zip(back, (left, right, counts)))


def test_frequent_pairs_are_never_missed(spark):
    rng = np.random.default_rng(3)
    ids = rng.integers(1, 1 << 12, (5000, 2))
    pairs = spark.createDataFrame([(r.tolist(),) for r in ids], "ids array<bigint>")
    for most in (1 << 16, 1 << 22):
        table = collocations.pair_table(pairs, 12, most)
        found = collocations.Pairs(12, table)
        row = np.concatenate([ids, np.zeros((5000, 1), int)], axis=1).ravel().astype(np.uint64)
        assert found.frequent(row).reshape(-1, 3).tolist() == [[True, False, False]] * 5000
        others = rng.integers(1, 1 << 12, 30_000).astype(np.uint64)
        assert found.frequent(others).mean() < 0.2


def test_too_many_words_raise():
    with pytest.raises(ValueError, match="frequent words"):
        collocations.Packing(26)
