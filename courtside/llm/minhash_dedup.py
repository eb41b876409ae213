"""MinHash near-duplicates by an inverted join over signature coordinates.

A document is the set of its distinct word shingles. Documents with equal sets form a class first, so
copies never multiply. Every class posts its id under (coordinate, value) pairs of its signature of
``coordinates`` minima. Two signatures agree on at least ``matches`` coordinates only if they share one of the
``coordinates - matches + 1`` rarest pairs of either (the prefix), so only prefix pairs are posted; any
global order of pairs would do, and a sketch of bounded size tells the common ones. The longer lists that the
prefix skips are probed from the signatures' bit planes, which never show fewer agreeing coordinates than
there are. Pairs above the match threshold are confirmed on the full sets.

A posting list of n classes never yields n * n pairs: classes first meet leaders of their lists, for a few
rounds, confirmed links merge into components, and only across components do classes of a list pair up, where
their sizes without the shingles that one candidate has alone still allow a link.
A pair is retained when its signatures agree on ``matches`` coordinates, counted one by one, and linked when its full
sets are similar enough. With similarity 0.8 the chance that two signatures of 64 agree on fewer than 38 coordinates is
about 5e-5, and falls fast above; nothing else loses a link.

Results: documents without words, and rows without an id, link with nothing (n_shingles 0 for the former); repeated
rows of an id share its component, so that an id with different texts links what each of them is like; texts are
shingled whole, whatever their length; columns besides id and text are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm._common import WordHashes, column, discard, fresh, materialize, mix64, small, utf8, window_hashes, with_id

ONE = np.uint64(0x9E3779B97F4A7C15)
#: Shingles that one numpy pass holds at a time.
CHUNK = 1 << 19
SKETCH = 1 << 18
PLANES = 3
#: Longs of the bit map that stands for a candidate's shared shingles.
WORDS = 16


def shingle_set(data: bytes | None, width: int, memo: WordHashes) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles, A-Z lower-cased."""
    words = data.lower().split() if data else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = memo.of(words)
    if len(words) < width:
        with np.errstate(over="ignore"):
            return mix64(window_hashes(hashes, len(words)) + ONE)
    return np.unique(window_hashes(hashes, width))


def set_hash(found: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of shingles, whatever its order; zeros for the empty set."""
    with np.errstate(over="ignore"):
        return int(np.sum(mix64(found)).view(np.int64)), int(np.sum(mix64(found ^ ONE)).view(np.int64))


def _minima(sets: list[np.ndarray], salts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The top 32 bits of each non-empty set's minimum under each permutation: one row a set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(salts)), np.uint32)
    for k in range(len(salts)):
        out[:, k] = np.minimum.reduceat((flat ^ salts[k]) * factors[k], starts) >> np.uint64(32)
    return out


def signatures(docs: DataFrame, width: int = 5, coordinates: int = 64, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> id, n_shingles, set_a, set_b (a 128-bit hash of the set), signature array<int> (null for an empty set)."""
    random = np.random.default_rng(seed)
    salts = random.integers(0, 1 << 64, coordinates, np.uint64)
    factors = random.integers(0, 1 << 64, coordinates, np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            counts, a, b, rows = [], [], [], []
            held, n_held = [], 0

            def flush():
                if held:
                    rows.extend(_minima(held, salts, factors).view(np.int32))
                    held.clear()

            filled = []
            for data in utf8(batch.column(1)):
                found = shingle_set(data, width, memo)
                counts.append(len(found))
                first, second = set_hash(found) if len(found) else (0, 0)
                a.append(first)
                b.append(second)
                filled.append(len(found) > 0)
                if len(found):
                    held.append(found)
                    n_held += len(found)
                    if n_held > CHUNK:
                        flush()
                        n_held = 0
            flush()
            each = iter(rows)
            lists = [next(each) if f else None for f in filled]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], ["id", "n_shingles", "set_a", "set_b", "signature"])
        pa.default_memory_pool().release_unused()

    named = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"))
    return named.mapInArrow(run, with_id(named, "n_shingles long, set_a long, set_b long, signature array<int>"))


def _text_bytes(name: str) -> Column:
    """The bytes of an id of any type, as text."""
    return F.octet_length(F.col(name).cast("string"))


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """node, signature, shingles array<long>: the full sets of the classes in nodes, each from a row of its smallest id.

    Rows of that id with another text have another set, by which they are told apart.
    """
    wanted = classes.join(small(nodes, 8), "node", "left_semi").select("id", "node", "set_a", "set_b", "signature")
    named = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"))
    named = named.join(small(wanted, _text_bytes("id") + 320), "id").select("node", "text", "set_a", "set_b", "signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            same, lists = [], []
            for data, *key in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = shingle_set(data, width, memo)
                same.append(set_hash(found) == tuple(key))
                if same[-1]:
                    lists.append(found.view(np.int64))
            kept = batch.filter(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(4), pa.array(lists, pa.list_(pa.int64()))], ["node", "signature", "shingles"])

    return named.mapInArrow(run, "node long, signature array<int>, shingles array<long>").dropDuplicates(["node"])


def _frequencies(classes: DataFrame) -> np.ndarray:
    """How many postings fall in each of SKETCH slots: a size-bounded sketch that tells common pairs from rare ones."""
    slot = F.pmod(F.xxhash64("k", "v"), F.lit(SKETCH))
    rows = classes.select(F.posexplode("signature").alias("k", "v")).select(slot.alias("slot")).groupBy("slot").count().toArrow()
    out = np.zeros(SKETCH, np.int64)
    out[rows["slot"].to_numpy()] = rows["count"].to_numpy()
    return out


def _prefixes(classes: DataFrame, length: int) -> DataFrame:
    """Each class's ``length`` rarest pairs as keys, and its signature's PLANES lowest bit planes (one bit a coordinate)."""
    slots = F.expr(f"transform(signature, (v, k) -> pmod(xxhash64(k, v), {SKETCH}L))")
    shared = classes.sparkSession.sparkContext.broadcast(_frequencies(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(2).flatten().to_numpy().view(np.uint32).reshape(batch.num_rows, -1)
            keys = values.astype(np.int64) | np.arange(values.shape[1], dtype=np.int64) << 32
            rare = shared.value[batch.column(3).flatten().to_numpy().reshape(values.shape)]
            order = np.lexsort((keys, rare))[:, :length]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, order.shape[1]), pa.int32()), pa.array(np.take_along_axis(keys, order, 1).ravel()))
            weights = np.uint64(1) << np.arange(values.shape[1], dtype=np.uint64)
            planes = [pa.array(((values >> p & 1).astype(np.uint64) * weights).sum(1, dtype=np.uint64).view(np.int64)) for p in range(PLANES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, *planes], ["node", "n", "keys", *[f"p{p}" for p in range(PLANES)]])

    return classes.select("node", "n", "signature", slots.alias("slots")).mapInArrow(run, "node long, n long, keys array<long>, " + ", ".join(f"p{p} long" for p in range(PLANES)))


def components(edges: DataFrame) -> DataFrame:
    """Undirected edges (a, b) -> node, component: the smallest node reachable. Labels pass along edges, then jump, until none changes."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "other", "component": "c"}), "other").groupBy("node").agg(F.min("c").alias("c"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "c").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("to"))
        lower = materialize(lower.join(jump, "component").select("node", F.least("component", "to").alias("component"), "was"), "labels")
        discard(labels)
        labels = lower.select("node", "component")
        if lower.filter("component <> was").isEmpty():
            discard(both)
            return labels


def _bounds(sets: DataFrame) -> DataFrame:
    """node, u, extra, w0, w1, ...: how many shingles of a candidate other candidates have too, and these as a bit map.

    Two candidates have at most the smaller u in common, and at most the bits that both maps have and the smaller
    ``extra``, which counts the shingles of a candidate beyond one for each of its bits.
    """
    single = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).filter("c = 1").groupBy("node").agg(F.collect_list("s").alias("own"))
    names = ["u", "extra", *[f"w{k}" for k in range(WORDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, bits = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 64 * WORDS), bool)
            for k, (shingles, own) in enumerate(zip(batch.column(1), batch.column(2))):
                shared = shingles.values.to_numpy()
                if own.is_valid:
                    shared = np.setdiff1d(shared, own.values.to_numpy(), assume_unique=True)
                u[k] = len(shared)
                bits[k, shared & (64 * WORDS - 1)] = True
            maps = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, [u, u - bits.sum(1), *maps.T])], ["node", *names])

    return sets.join(single, "node", "left").select("node", "shingles", "own").mapInArrow(run, "node long, " + ", ".join(f"{c} long" for c in names))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80, coordinates: int = 64, matches: int = 38, rounds: int = 3, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> id, n_shingles, component_id, kept: links need 100 * intersection >= threshold * union.

    ``coordinates`` is at most 64: a bit plane is one long.
    """
    if not 0 < matches <= coordinates <= 64:
        raise ValueError("matches <= coordinates <= 64")
    signed = materialize(signatures(docs, width, coordinates, seed, id_col, text_col), "signatures")
    classes = signed.filter("n_shingles > 0 and id is not null").groupBy("set_a", "set_b").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    # The node of a class is a number of its own: an id with different texts is in several classes.
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    prefix = materialize(_prefixes(classes, coordinates - matches + 1), "prefix")
    planes = [f"p{p}" for p in range(PLANES)]

    def possible(left: str, right: str):
        """Sizes and agreeing coordinates (never fewer than the planes show differing) allow a link."""
        differ = "|".join(f"({left}.{p} ^ {right}.{p})" for p in planes)
        return F.expr(f"100 * least({left}.n, {right}.n) >= {threshold} * greatest({left}.n, {right}.n) and bit_count({differ}) <= {coordinates - matches}")

    # Posting lists of two classes or more, each with a leader picked by hash.
    posted = prefix.select(F.explode("keys").alias("key"), "node", "n", *planes).repartition("key")
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.max(F.struct(F.xxhash64("node").alias("h"), "node", "n", *planes)).alias("l")).filter("df > 1").drop("df")
    near = F.when(possible("p", "l") & (F.col("p.node") != F.col("l.node")), F.expr(f"{coordinates} - bit_count(" + "|".join(f"(p.{p} ^ l.{p})" for p in planes) + ")"))
    listed = posted.alias("p").join(lists, "key").select("key", "p.node", "p.n", *[f"p.{p}" for p in planes], F.col("l.node").alias("b"), near.alias("agree"))
    listed = materialize(listed, "listed")
    discard(prefix)

    # First every class meets the leader with which it agrees most.
    first = listed.filter("agree is not null").groupBy(F.col("node").alias("a")).agg(F.max_by("b", F.struct("agree", F.col("b").alias("tie"))).alias("b"))
    first = materialize(first, "pairs")
    nodes = materialize(first.select(F.col("a").alias("node")).union(first.select("b")).distinct(), "nodes")
    sets = materialize(_sets(docs, classes, nodes, width, id_col, text_col), "sets")

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose signatures collide on enough coordinates and whose full sets are similar enough."""
        left = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x", "signature": "s"}), "a")
        full = left.join(sets.withColumnsRenamed({"node": "b", "shingles": "y", "signature": "t"}), "b")
        collisions = F.expr("aggregate(zip_with(s, t, (u, v) -> int(u = v)), 0, (n, e) -> n + e)")
        full = full.filter(collisions >= matches)
        common = full.select("a", "b", (F.size("x") + F.size("y")).alias("both"), F.size(F.array_intersect("x", "y")).alias("common"))
        return common.filter(100 * F.col("common") >= threshold * (F.col("both") - F.col("common"))).select("a", "b")

    done = [materialize(confirmed(first, sets), "links")]
    # Classes that an id shares are linked as well.
    by_id = signed.filter("n_shingles > 0 and id is not null").join(classes.select("set_a", "set_b", "node"), ["set_a", "set_b"])
    lowest = by_id.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a <> last").select("id", "a")
    done.append(materialize(by_id.join(lowest, "id").select("a", F.col("node").alias("b")).filter("a <> b").distinct(), "links"))
    every = lambda: reduce(DataFrame.unionByName, done)
    labels = components(every())

    bounds = materialize(_bounds(sets), "bounds")
    bound = lambda left, right: F.expr(f"100 * least({left}.u, {right}.u) >= {threshold} * ({left}.n + {right}.n - least({left}.u, {right}.u))")

    # Then candidates still apart from a list's leading component meet other leaders, which have few shingles of their own.
    # A candidate with too few shared shingles for its own size is like nothing else.
    counts = small(bounds.select("node", "u"), 16)
    hot = materialize(listed.select("key", "node", "n", *planes, "b").join(counts, "node").filter(f"100 * u >= {threshold} * n"), "hot")
    for turn in range(1, rounds):
        rows = hot.join(small(labels, 16), "node", "left").withColumn("component", F.coalesce("component", "node"))
        lead = F.max(F.struct(F.round(F.col("u") / F.col("n"), 2).alias("q"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "u", "component", *planes))
        leaders = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), lead.alias("l")).filter("low <> high").select("key", "l")
        apart = rows.alias("p").join(leaders, "key").filter((F.col("p.component") != F.col("l.component")) & possible("p", "l") & bound("p", "l"))
        chosen = apart.groupBy(F.col("p.node").alias("a")).agg(F.slice(F.collect_set("l.node"), 1, 4).alias("best")).select("a", F.explode("best").alias("b"))
        chosen = materialize(chosen, "pairs")
        done.append(materialize(confirmed(chosen, sets), "links"))
        discard(chosen, labels)
        labels = components(every())

    # What lists still mix. A class without a bound meets the classes of other components in its lists.
    label = small(labels, 16)
    rows = listed.drop("agree").join(label.withColumnsRenamed({"component": "ca"}), "node", "left").join(label.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left")
    rows = rows.join(counts, "node", "left").select("key", "node", "n", *planes, "u", F.coalesce("ca", "node").alias("component"), F.coalesce("cb", "b").alias("leading"))
    outer = rows.filter("component <> leading")
    apart = (F.col("p.component") != F.col("l.component")) & ((F.col("l.component") == F.col("l.leading")) | (F.col("p.node") < F.col("l.node")))
    across = outer.alias("p").join(rows.alias("l"), "key").filter(apart & (F.col("p.u").isNull() | F.col("l.u").isNull()) & possible("p", "l"))
    # Two candidates leave the join only if their shared shingles may be enough. Lists are long and most of their pairs
    # end here, so the test is arithmetic on longs.
    maps = [f"w{k}" for k in range(WORDS)]
    full = hot.join(label.withColumnsRenamed({"component": "ca"}), "node", "left").join(label.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left")
    full = full.join(small(bounds.drop("u"), 16 + 8 * WORDS), "node").select("key", "node", "n", *planes, "u", "extra", *maps, F.coalesce("ca", "node").alias("component"), F.coalesce("cb", "b").alias("leading"))
    common = " + ".join(f"bit_count(p.{w} & l.{w})" for w in maps) + " + least(p.extra, l.extra)"
    enough = F.expr(f"{100 + threshold} * ({common}) >= {threshold} * (p.n + l.n)")
    within = full.filter("component <> leading").alias("p").join(full.alias("l"), "key").filter(apart & possible("p", "l") & bound("p", "l") & enough)
    last = across.select(F.col("p.node").alias("a"), F.col("l.node").alias("b")).unionByName(within.select(F.col("p.node").alias("a"), F.col("l.node").alias("b")))
    last = materialize(last.distinct(), "pairs")
    wanted = materialize(last.select(F.col("a").alias("node")).union(last.select("b")).distinct(), "nodes")
    more = materialize(_sets(docs, classes, materialize(wanted.join(nodes, "node", "left_anti"), "nodes"), width, id_col, text_col), "sets")
    done.append(materialize(confirmed(last, sets.join(small(wanted, 8), "node", "left_semi").unionByName(more)), "links"))
    discard(labels)
    labels = components(every())
    discard(first, nodes, sets, listed, hot, bounds, last, wanted, more, *done)

    # A component is named after its smallest id. Only linked classes have one, and the names are a table of their own,
    # so that Spark can split what joins a large component.
    linked = labels.join(classes.select("node", "id"), "node")
    names = materialize(linked.groupBy("component").agg(F.min("id").alias("name")), "names")
    named = classes.select("set_a", "set_b", "node", "id").join(small(labels, 16), "node", "left").join(small(names, 16), "component", "left")
    named = named.select("set_a", "set_b", F.coalesce("name", "id").alias("name"))
    grouped = signed.select("id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("name")).otherwise(F.col("id"))
    return grouped.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the smallest id of each group only; rows without an id all stay.

    Of repeated rows of an id one stays: that of the smallest text, then of the smallest hash of the whole row.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter("kept").groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    found = materialize(found.filter("id is not null"), "kept")
    key = column(docs, id_col)

    def rows_of(ids: DataFrame) -> DataFrame:
        mark = fresh(docs, "kept")
        ids = small(ids.select(F.col("id").alias(mark)), _text_bytes(mark) + 8)
        return docs.join(ids, key == F.col(mark), "left_semi")

    kept = rows_of(found.filter("rows = 1")).unionByName(docs.filter(key.isNull()))
    many = found.filter("rows > 1")
    if many.isEmpty():
        return kept
    place = fresh(docs, "place")
    order = Window.partitionBy(key).orderBy(column(docs, text_col), F.xxhash64(*[column(docs, c) for c in docs.columns]))
    return kept.unionByName(rows_of(many).withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place))
