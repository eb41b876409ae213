"""URL filters, search, language, toxicity and page extraction on small fixtures."""

import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from courtside.llm import html_extraction, language_id, topk_search, toxicity, url_filter


# ---- url filters ----------------------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/en/x?q=1", "https://a.example.net/en/", "https://a.example.net/fr/", "https://xexample.net/en/", "http://b.example.com/de/1#t", "http://b.example.com/de", "https://ORG/fr/", "https://x.org/fr/a://b", "a://b://c/d?e", "https://net", "https://net/", "https://Éx.NET/x", "https://casino-win.example.org/en/1", "https://library.example.org/en/1"]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        cut = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
        path = tail[:cut]
    best = None
    for text, verdict in url_filter.RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[0])):
            best = (text, verdict)
    return host, path, best


@pytest.fixture(scope="module")
def url_model(spark):
    return url_filter.train(spark)


def test_url_rules_and_model(spark, url_model):
    rows = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    weights, intercept = url_model
    judged = url_filter.judge(rows, weights, intercept)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    hashed = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "i long, url string").select("i", url_filter.slots(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), len(weights), (3, 4, 5)).alias("s"))
    slots = {r["i"]: r["s"] for r in hashed.collect()}
    for r in judged.collect():
        host, path, rule = brute_rule(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0])
        p = 1 / (1 + math.exp(-intercept - sum(weights[s - 1] for s in slots[r["page_id"]])))
        assert r["block_probability"] == pytest.approx(p, rel=1e-9)
        assert r["verdict"] == (rule[1] if rule else "block" if p >= 0.6 else "allow")
    found = {URLS[r["page_id"]]: r["verdict"] for r in judged.collect()}
    assert found["https://casino-win.example.org/en/1"] == "block" and found["https://library.example.org/en/1"] == "allow"


# ---- search ---------------------------------------------------------------------------------------------------


def test_ngrams_are_those_of_the_marked_text(spark):
    texts = ["", "a", "ab12c-ä漢", "casino"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, r in zip(texts, d.select(url_filter._grams(F.col("t"), "h", (3, 4)).alias("g")).collect()):
        marked = "^" + re.sub("[0-9]+", "0", t) + "$"
        assert r["g"] == ["h" + marked[k : k + n] for n in (3, 4) for k in range(max(1, len(marked) - n + 1))]


def test_url_model_on_held_out_hosts(spark):
    """Hosts whose names are not in the training rows."""
    name = lambda url: re.sub(r"^(www|m|blog|shop)\.", "", url.split("/")[2]).split(".")[0]
    held = lambda url: zlib.crc32(name(url).encode()) % 4 == 0
    model = url_filter.train(spark, [r for r in url_filter.LABELLED if not held(r[0])])
    rows = [(i, *r) for i, r in enumerate(r for r in url_filter.LABELLED if held(r[0]))]
    assert len(rows) > 500
    d = spark.createDataFrame(rows, "page_id int, url string, label int")
    found = {r["page_id"]: r["verdict"] == "block" for r in url_filter.judge(d, *model, rules=()).collect()}
    right = sum(found[i] and label for i, _, label in rows)
    assert right >= 0.95 * sum(found.values()) and right >= 0.8 * sum(label for *_, label in rows)


def test_urls_of_nothing_and_repeated_rows(spark, url_model):
    d = spark.createDataFrame([(1, "https://casino.example/"), (1, "https://casino.example/"), (None, None)], "page_id long, url string").withColumns({"host": F.lit("x"), "a.b": F.lit(1), "p": F.lit(2), "s": F.lit(3)})
    assert url_filter.judge(d.limit(0), *url_model).count() == 0
    assert [r["verdict"] for r in url_filter.judge(d, *url_model).orderBy(F.desc("page_id")).collect()][:2] == ["block"] * 2


def brute_top(rows, k):
    """Repeated rows are rows of their own, as candidates and as queries."""
    usable = [(i, tuple(math.floor(1024 * Fraction(x)) for x in v)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, v in usable:
        if i % 100 == 0:
            out.setdefault(i, []).extend((-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != i and len(w) == len(v))
    return {i: [(r + 1, j, -s) for r, (s, j) in enumerate(sorted(x)[:k])] for i, x in out.items() if x}


def found_top(d, **options):
    found = {}
    for r in topk_search.top_k(d, d.filter("vec_id % 100 = 0"), **options).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in found.items()}


@pytest.mark.parametrize("block", [400, 1 << 20])
def test_top_k_is_exact(spark, block):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.0, 0.5, 1.0, float(np.float32(rng.gauss(0, 1)))]) for _ in range(8)]) for i in range(400)]
    rows += [(i, list(rows[7][1])) for i in range(400, 420)] + [(rows[i][0], list(rows[i][1])) for i in (0, 7, 7)]
    rows += [(500, None), (501, [1.0, None] * 4), (600, [float("nan")] + [0.0] * 7), (601, [float("inf")] * 8), (700, []), (800, [1.0, 2.0]), (801, [1.0, 2.0]), (None, [0.0] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "score": F.lit("x"), "v": F.lit("y"), "vb": F.lit(3)})
    assert found_top(d, block=block) == brute_top(rows, 10)


@pytest.mark.parametrize("block", [6, 1 << 20])
def test_top_k_of_large_components(spark, block):
    rows = [(0, [8.0, 1.0]), (1, [1e11, 1.0]), (2, [-1e14, 0.3]), (100, [2.5, -7.0]), (3, [2.0, 5.0]), (4, [1e9, 2.0**39]), (6, [3.0, 2.0]), (7, [1e12, -1.0]), (200, [2.0**-60, 1e-300]), (5, [1e300, 0.0]), (200, [0.0, 0.25])]
    d = spark.createDataFrame([r for r in rows if r[0] != 5], "vec_id long, embedding array<double>")
    assert found_top(d, k=3, block=block) == brute_top([r for r in rows if r[0] != 5], 3)
    with pytest.raises(Exception, match="does not fit a long"):
        found_top(spark.createDataFrame(rows, d.schema), k=3, block=block)


def test_top_k_of_nothing(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(d, d).count() == 0


def test_index_stops_early_with_proof():
    rng = np.random.default_rng(0)
    vectors = rng.normal(0, 300, (2000, 16)).astype(np.int64)
    vectors[5] = vectors[7] * 3
    index = topk_search.ImpactIndex(vectors, 32)
    members, scores = index.search(vectors[7], 1, np.arange(2000) == 7, check_every=8)
    assert len(members) < 2000 and members[scores.argmax()] == 5


# ---- language and toxicity ------------------------------------------------------------------------------------

SYLLABLES = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ein", "ber"], "cc": ["eau", "oui", "ère", "ç"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_held_out(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, lang, rng.randrange(1, 60)), lang, "x") for i, lang in enumerate(rng.choices(["aa", "bb", "cc"], k=600))]
    rows += [(1000, None, "aa", "x"), (1001, "", "bb", "x"), (1002, "12 !?", "aa", "x"), (1003, "ka to ra", None, "x"), (1004, sentence(rng, "bb", 30_000), None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    field = language_id.train(d.filter("doc_id % 4 <> 2 and doc_id < 1000"), spans=3000)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(d, field).collect()}
    held = [(found[i][0] == lang) for i, _, lang, _ in rows if i < 1000 and i % 4 == 2]
    assert sum(held) / len(held) >= 0.97
    assert [found[i][0] for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= s <= 1 for _, s in found.values())
    assert len(found) == len(rows)


def test_words_of_mixed_text_have_their_own_language(spark):
    """Code-switched texts, spliced from two languages: every word has a label."""
    rng = random.Random(3)
    d = spark.createDataFrame([(i, sentence(rng, lang, 40), lang) for i, lang in enumerate(rng.choices(["aa", "bb", "cc"], k=400))], "doc_id long, text string, lang string")
    field = language_id.train(d)
    texts, truth = [None, "", "12 !"], [[], [], []]
    for _ in range(40):
        parts = [(lang, sentence(rng, lang, rng.randrange(4, 12))) for lang in rng.sample(["aa", "bb", "cc"], 2)]
        texts.append(" ".join(p for _, p in parts))
        truth.append([lang for lang, p in parts for _ in p.split()])
    mixed = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"lang": F.lit("x"), "words": F.lit(1)})
    rows = {r["doc_id"]: r["words"] for r in language_id.label_words(mixed, field).collect()}
    assert [rows[i] for i in range(3)] == [[]] * 3
    found = [(w["lang"], want) for i, t in enumerate(truth) for w, want in zip(rows[i], t, strict=True)]
    assert all(texts[i][w["start"] : w["stop"]] == part for i in range(3, len(texts)) for w, part in zip(rows[i], texts[i].split()))
    assert all(0 <= w["score"] <= 1.001 for ws in rows.values() for w in ws)
    assert sum(a == b for a, b in found) >= 0.95 * len(found)


def test_language_of_nothing_and_repeated_rows(spark):
    d = spark.createDataFrame([(1, "ka to mi", "aa"), (1, "ka to mi", "aa"), (2, "sch ung", "bb")], "doc_id long, text string, lang string")
    field = language_id.train(d)
    assert language_id.predict(d.limit(0), field).count() == 0
    assert language_id.predict(d, field).filter("doc_id = 1").distinct().count() == 1 and language_id.predict(d, field).count() == 3


def test_language_forward_backward_matches_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    field = language_id.Field(["a", "b", "c"], np.zeros((language_id.SLOTS, 3), np.float32), rng.normal(0, 1, (3, 3)))
    rows = np.exp(rng.normal(0, 1, (6, 3))).astype(np.float32)
    texts = [np.array([0, 1, 2, 3]), np.array([], np.int64), np.array([5]), np.array([4, 4, 1])]
    got = field.mean_marginals(rows, texts)
    for t, g in zip(texts, got):
        want = np.zeros(3)
        total = 0.0
        for labels in itertools.product(range(3), repeat=len(t)):
            p = np.prod([rows[w, y] for w, y in zip(t, labels)]) * np.exp(sum(field.transitions[a, b] for a, b in zip(labels, labels[1:])))
            total += p
            for y in labels:
                want[y] += p
        if len(t):
            assert g == pytest.approx(want / total / len(t), abs=1e-5)
        else:
            assert not g.any()


def test_language_without_labels(spark):
    d = spark.createDataFrame([(1, "ka to", None)], "doc_id long, text string, lang string")
    assert language_id.predict(d, language_id.train(d)).first()["lang_pred"] == "und"


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    bad = ["blorgh", "snarfel", "grubbin"]
    rows, labels = [], []
    for i in range(900):
        text, toxic = sentence(rng, rng.choice(["aa", "bb"]), rng.randrange(5, 200)).split(), int(rng.random() < 0.2)
        for _ in range(rng.randrange(1, 4) * toxic):
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    rows += [(2000, None), (2001, ""), (2002, "123 !!"), (2003, "ka to " * 50_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    y = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(d, y.filter("doc_id % 5 <> 0"))
    found = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    held = [(found[i] >= 0.5) == bool(t) for i, t in labels if i % 5 == 0]
    assert sum(held) / len(held) >= 0.95
    assert all(0 <= s <= 1 for s in found.values()) and found[2000] == found[2001] == found[2002] and found[2003] < 0.5


def test_models_are_normalised_differences():
    words = [b"abc", b"abd", b"xyz"]
    model = toxicity.fit_models(words, np.array([5, 1, 0]), np.array([0, 1, 7]), 1.0)
    gains = dict(zip(words, model.words(words)))
    assert gains[b"xyz"] > 0 > gains[b"abc"] and abs(model.words([b"qqq"])[0]) < 5


def plain_kneser_ney(words, counts, byte, context, shared, order=7, discount=0.75):
    """P(byte | context) of one class by plain dictionaries: own counts at the top, continuation counts of all words below."""
    def grams(n, of):
        out = {}
        for w, c in zip(words, of):
            padded = b"\x02" * (order - 1) + w + b"\x03"
            for i in range(len(padded) - order + 1):
                key = padded[i : i + order][order - n :]
                out[key] = out.get(key, 0) + c
        return out

    top = grams(order, counts)
    whole = set(grams(order, shared))
    kinds = {n: {} for n in range(1, order)}
    for n in range(order - 1, 0, -1):
        for g in whole if n == order - 1 else set(kinds[n + 1]):
            kinds[n][g[1:]] = kinds[n].get(g[1:], 0) + 1

    def lower(n, ctx):
        rows = {g: c for g, c in kinds[n].items() if g[:-1] == ctx}
        below = 1 / 256 if n == 1 else lower(n - 1, ctx[1:])
        total = sum(rows.values())
        return (max(rows.get(ctx + byte, 0) - discount, 0) + discount * len(rows) * below) / total

    rows = {g: c for g, c in top.items() if g[:-1] == context and c > 0}
    total = sum(rows.values())
    back = discount * len(rows) / total if total else 1.0
    return (max(rows.get(context + byte, 0) - discount, 0) / total if total else 0.0) + back * lower(order - 1, context[1:])


def test_models_match_plain_kneser_ney():
    words = [b"abc", b"abd", b"xbc", b"b", b"abcabc"]
    ordinary, toxic = np.array([3, 1, 0, 2, 1]), np.array([0, 4, 2, 0, 1])
    model = toxicity.fit_models(words, ordinary, toxic, 1.5)
    checked = 0
    for gram, gain in zip(model.grams.tolist(), model.gains.tolist()):
        data = gram.to_bytes(8, "big")[1:]
        p, q = (plain_kneser_ney(words, c, data[-1:], data[:-1], ordinary + toxic) for c in (ordinary, toxic))
        assert gain == pytest.approx(math.log(q) - math.log(p), abs=1e-5)
        checked += 1
    assert checked > 10


def test_toxicity_of_nothing_and_repeated_rows(spark):
    d = spark.createDataFrame([(i, "bad word" if i % 2 else "good day") for i in range(80)] + [(1, "bad word"), (200, ""), (201, None)], "doc_id long, text string").withColumns({"score": F.lit("x"), "a.b": F.lit(1)})
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    assert toxicity.score(d.limit(0), model).count() == 0
    rows = toxicity.score(d, model).collect()
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == 83 and scores[200] == scores[201] and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1


def test_toxicity_of_a_very_long_text(spark):
    d = spark.createDataFrame([(i, ("vile " if i % 2 else "calm ") * 9 + f"w{i}") for i in range(80)] + [(200, "calm " * 200_000), (201, "vile " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(d, toxicity.train(d, labels)).collect()}
    assert 0 <= scores[200] < 0.5 < scores[201] <= 1


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    y = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(d, toxicity.train(d, y)).first()["score"] == pytest.approx(0, abs=1e-6)


# ---- pages ----------------------------------------------------------------------------------------------------


def page(rng, k, paragraphs):
    items = "".join(f"<li><a href='/{rng.random()}'>menu{rng.randrange(99)}</a></li>" for _ in range(rng.randrange(2, 6)))
    body = "".join(f"<p>para {k} {j} <b>bold</b>&amp;more\n  {rng.random()}" for j in range(paragraphs))
    aside = "<aside>side words here</aside>" if rng.random() < 0.5 else ""
    return f"<!DOCTYPE html><html><head><title>t</title><script>var x='</p>';</script></head><body><nav><ul>{items}</ul></nav><header>Site</header><div class='ad'>Buy {rng.random()}</div><div class='content'><h1>Title {k}</h1>{body}</div>{aside}<section class='comments'><p>reader {rng.random()} says quite a lot of words here, more than the text itself maybe</p></section><footer>&copy; foot {rng.random()}</footer></body></html>"


def test_extraction_by_wrapper(spark):
    rng = random.Random(5)
    rows = [(i, f"https://h{i % 2}.example/{i}", page(rng, i, rng.randrange(1, 9))) for i in range(40)]
    rows += [(100, None, None), (101, "https://h0.example/x", ""), (102, "x", "plain text"), (103, "https://h9.example/", "<article><h1>A</h1><p>B<nav>menu</nav><p>C &lt;d&gt;</article>"), (104, "https://h8.example", "<p>open <b>bold <p>next<br>line <!-- gone"), (0, rows[0][1], rows[0][2])]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    found = {r["page_id"]: r for r in html_extraction.extract(d).collect()}
    assert html_extraction.extract(d).count() == len(rows)
    for i in range(40):
        text = found[i]["text"]
        assert text.startswith(f"Title {i} para {i} 0 bold&more") and "menu" not in text and "Buy" not in text and "foot" not in text and "reader" not in text and "side" not in text and "Site" not in text
        assert text.count("para") == rows[i][2].count("<p>para")
    assert [found[i]["text"] for i in (100, 101, 102, 103, 104)] == ["", "", "plain text", "A B C <d>", "open bold next line"]


def folded(page):
    return html_extraction.tree(page)[0]


def wrapper_of(pages):
    out = None
    for page in pages:
        out = folded(page) if out is None else html_extraction.align(out, folded(page))
    return out


def as_regex(nodes):
    """A wrapper as a regular expression of Python over flat streams."""
    out = ""
    for n in nodes:
        inner = "#" if n.label == "#" else as_regex(n.kids) if not n.label else f"<{re.escape(n.label)}>{as_regex(n.kids)}</{re.escape(n.label)}>"
        out += f"(?:{inner})" + ("*" if n.many and n.optional else "+" if n.many else "?" if n.optional else "")
    return out


def flat(page):
    """The stream of a page without folding."""
    out = []
    for kind, value in html_extraction.events(page):
        if kind in ("open", "close"):
            out.append(f"<{'/' * (kind == 'close')}{value}>")
        elif kind != "gap" and not value.isspace() and out[-1:] != ["#"]:
            out.append("#")
    return "".join(out)


def random_markup(rng, depth=0):
    parts = []
    for _ in range(rng.randrange(1, 5)):
        tag = rng.choice(["div", "ul", "section class=x", "h2"])
        inner = "words" if depth > 2 or rng.random() < 0.4 else random_markup(rng, depth + 1)
        parts += [f"<{tag}>{inner}</{tag.split()[0]}>"] * rng.choice([1, 1, 1, 2, 3])
    return "".join(parts) * rng.choice([1, 1, 2])


def test_wrappers_are_union_free():
    a, b = "<ul><li>a</li><li>b</li></ul>", "<ul><li>c</li></ul><p>d</p>"
    assert as_regex(folded(a)) == "(?:<ul>(?:<li>(?:#)</li>)+</ul>)"
    assert as_regex(wrapper_of([a, b])) == "(?:<ul>(?:<li>(?:#)</li>)+</ul>)(?:<p>(?:#)</p>)?"
    pair = "<dt>x</dt><dd>y</dd>"
    assert as_regex(wrapper_of([pair * 3, pair])) == "(?:(?:<dt>(?:#)</dt>)(?:<dd>(?:#)</dd>))+"
    assert html_extraction.written(html_extraction.read(html_extraction.written(folded(a + b)))) == html_extraction.written(folded(a + b))


def test_a_wrapper_accepts_all_its_streams():
    rng = random.Random(4)
    for _ in range(40):
        pages = [random_markup(rng) for _ in range(rng.randrange(2, 7))]
        wrapper = wrapper_of(pages)
        expression, matcher = re.compile(as_regex(wrapper)), html_extraction.Matcher(html_extraction.read(html_extraction.written(wrapper)))
        for page in pages:
            assert expression.fullmatch(flat(page))
            stream = folded(page)
            found = matcher.match(stream)
            assert found is not None and set(found) == {t.slot for t in html_extraction.texts_of(stream)}
        for page in (random_markup(rng) for _ in range(5)):
            assert (matcher.match(folded(page)) is None) or expression.fullmatch(flat(page))


def test_long_and_deep_pages_align_like_short_ones(spark):
    block = lambda k: f"<div class=x{'abcdefghij'[k % 10]}{'y' * (k // 10)}>t{k}</div>"
    wrapper = wrapper_of(["".join(block(k) for k in range(600)), "".join(block(k) for k in range(600) if k % 7)])
    assert len(wrapper) == 600 and sum(n.optional for n in wrapper) == 86
    deep = "<div>" * 3000 + "<p>bottom" + "</div>" * 3000
    long = "<article><p>" + "word " * 100_000 + "</article>"
    assert pages_of(spark, [deep, long, deep]) == {0: "bottom", 1: "word " * 99_999 + "word", 2: "bottom"}


def test_slots_are_told_apart_by_their_place_in_the_wrapper(spark):
    """Menu, notice, post and links below have the same path; only the alignment tells their slots apart."""
    rng = random.Random(2)
    notice = "<div><p>This site is moving soon</p></div>"
    below = lambda k: f"<div><p><a href=x>other {k}</a></p></div>"
    texts, pages = {}, []
    for i in range(12):
        words = [f"text {i} {j} {rng.random()}" for j in range(rng.randrange(2, 5))]
        texts[i] = " ".join([f"title {i}", *words])
        pages.append((notice if i % 2 else "") + f"<div><h2>title {i}</h2>" + "".join(f"<p>{w}</p>" for w in words) + "</div>" + below(i))
    assert pages_of(spark, pages) == texts


def test_pages_of_nothing_and_repeated_rows(spark):
    d = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extraction.extract(d).count() == 0
    d = spark.createDataFrame([(1, None, "<p>a")] * 3 + [(2, None, None), (None, "http://x/", "")], d.schema).withColumns({"stream": F.lit(1), "a.b": F.lit(2), "host": F.lit("z")})
    assert sorted((r["page_id"] or 0, r["text"]) for r in html_extraction.extract(d).collect()) == [(0, ""), (1, "a"), (1, "a"), (1, "a"), (2, "")]


def pages_of(spark, texts):
    d = spark.createDataFrame([(i, "https://h.example/", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_extraction.extract(d).collect()}


def hosted(spark, texts, urls=None):
    """Texts of pages of one host, each of its own url."""
    d = spark.createDataFrame([(i, (urls or "https://h.example/{}").format(i), t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_extraction.extract(d).collect()}


@pytest.mark.parametrize("body", [
    "<p><a href=x>linked paragraph {0}, all of it a link</a></p><p>plain {0}</p>", "<div class='legal'><p>The court ruled {0} so</p></div>", "<div class='case-legal'><p>case {0}</p></div>", "<div class='related-work'><p>work {0}</p></div>",
    "<section class='discussion'><p>we discuss {0}</p></section>", "<div id='rail-transport'><p>rails {0}</p></div>", "<div class='search-results-analysis'><p>results {0}</p></div>", "<p class='share-price'>the price {0}</p>", "<div class='alert'><p>an alert {0}</p></div>",
])
def test_names_and_links_alone_drop_no_text(spark, body):
    found = hosted(spark, [f"<nav><a>menu</a></nav><article><h1>t{i}</h1>{body.format(i)}</article>" for i in range(4)])
    assert found == {i: " ".join(re.sub("<[^>]*>", " ", f"t{i} {body.format(i)}").split()).replace(" ,", ",") for i in range(4)}


def test_names_with_structure_drop_text(spark):
    around = "<article><h1>t{0}</h1><p>text {0}</p><div class='share'><p>Tell your friends</p></div><div class='related'><p><a>other story {0} with words</a></p></div><ul class=tags><li><a>tag{0}</a></li><li><a>tag</a></li></ul><div class='comment-list'><p>reader {0}</p></div><div class='ad_box2'>buy {0}</div></article>"
    assert hosted(spark, [around.format(i) for i in range(4)]) == {i: f"t{i} text {i}" for i in range(4)}


def test_repeated_rows_are_one_url(spark):
    assert hosted(spark, ["<div><p>a text</p><p>and more</p></div>"] * 4, "https://h.example/") == {i: "a text and more" for i in range(4)}


def test_planted_articles_are_found(spark):
    """Random articles within random chrome: what was planted is the text."""
    rng = random.Random(12)
    names = ["", " class='legal'", " class='notice-board'", " id='reply'", " class='story related'", " class='share-index'"]
    pages, want = [], {}
    for i in range(80):
        parts, blocks = [], []
        for j in range(rng.randrange(1, 7)):
            words = f"w{i}x{j} " + " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(1, 30)))
            linked = rng.random() < 0.15 and j > 0
            parts.append(f"<div{rng.choice(names)}><p>{f'see <a>{words}</a> for more of it, as told at length before' if linked else words}</p></div>")
            blocks.append(f"see {words} for more of it, as told at length before" if linked else words)
        chrome = [f"<nav><ul><li><a>m{rng.random()}</a></li></ul></nav>", f"<div class='ad'>buy {rng.random()}</div>", "<header>site</header>", f"<aside>side {rng.random()}</aside>", f"<div class='comments'><p>me {rng.random()}</p></div>"]
        rng.shuffle(chrome)
        cut = rng.randrange(6)
        pages.append("<body>" + "".join(chrome[:cut]) + f"<article><h1>t{i}</h1>{''.join(parts)}</article>" + "".join(chrome[cut:]) + "<footer>foot</footer></body>")
        want[i] = " ".join([f"t{i}", *blocks])
    assert hosted(spark, pages) == want


def test_an_unaccepted_stream_keeps_its_slots(spark, monkeypatch):
    rows = [("h", 1, html_extraction.written(folded("<nav><p>m</p></nav><article><p>a</p></article>")), html_extraction.written(folded("<main><p>x</p></main>")))]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], ["host", "stream", "shape", "wrapper"])
    found = pa.Table.from_batches(html_extraction._matched(iter([batch]))).to_pylist()
    assert [(r["slot"], r["place"]) for r in found] == [(0, html_extraction.BARRED), (1, html_extraction.LOOSE)]


def test_optional_wrappers_keep_every_layout(spark):
    ways = ["<article><p>{}</p></article>", "<article><div class=body><p>{}</p></div></article>", "<article>{}</article>", "<article><section><p>{}</p></section><blockquote><p>q{}</p></blockquote></article>"]
    found = pages_of(spark, ["<nav>menu</nav>" + ways[i % 4].format(f"text {i}", i) for i in range(24)])
    assert found == {i: f"text {i} q{i}" if i % 4 == 3 else f"text {i}" for i in range(24)}


def test_nested_equal_tags_keep_their_text(spark):
    assert pages_of(spark, ["<div><div><p>deep</p></div></div>"]) == {0: "deep"}


def test_every_layout_of_a_host_has_text(spark):
    shared = "<nav>menu</nav><div class='{0}'><p>text {1}</p><p>more {1}</p></div>"
    found = pages_of(spark, [shared.format("content" if i % 3 else "post", i) for i in range(30)])
    assert found == {i: f"text {i} more {i}" for i in range(30)}
    rare = "<main><p>text {0}</p></main>"
    found = pages_of(spark, [rare.format(i) if i % 20 == 0 else f"<main><article><p>text {i}</p></article></main>" for i in range(40)])
    assert found == {i: f"text {i}" for i in range(40)}
    titled = "<div class='content'><h1>t{0}</h1>{1}</div>{2}"
    found = pages_of(spark, [titled.format(i, f"<p>long text of page {i}</p>", "") if i % 4 else titled.format(i, "", f"<div class='post'><p>long text of page {i}</p></div>") for i in range(40)])
    assert found == {i: f"t{i} long text of page {i}" for i in range(40)}
