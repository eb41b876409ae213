"""Main text of web pages by union-free regular-expression inference.

A page becomes a stream of structural tags and text slots, kept as a tree. Adjacent equal groups of siblings fold into
repeated groups. The distinct streams of a host are aligned one after another: what matches stays, what only one side
has becomes optional, one occurrence of a repeated group matches the group, texts are slots. The result is the host's
wrapper, a union-free regular expression over tags and slots that accepts every one of its streams.

Every stream is then matched against its host's wrapper, which tells the wrapper's slot of each of its texts. Over all
pages of the host a slot has a size, blocks that are links for the most part, and either varying text or the same text
everywhere. The main region is an element of the wrapper: the deepest article or main element with MARKED_SHARE of the
marked text, or without such elements the deepest element with MOST of the varying text. Not main text are:
- elements that are navigation, footers, asides, forms and the like by tag, and headers outside an article or main;
- elements whose name is one of NEVER_WORDS, alone or with words of arrangement (comment-list, ad_box2);
- link lists, slots of short blocks nearly all of which are links; a slot with other text stays whole;
- elements with a doubtful word (legal, related-work, share-price) only where their text is nearly all links, or the same on
  SAME_PAGES urls or more; such unvarying text goes in unmarked regions whatever its name.
A page's main text is what fills the remaining slots; a stream that has less than MOST of its own text there keeps all
its slots outside what is listed above. A stream that its wrapper should not accept keeps all slots but those that tags
and names rule out.

Only distinct streams and sums over slots are shuffled, the streams of a host in groups of MERGED that shrink to one
wrapper round by round, so a host with a third of all pages is no larger a task than another.

A null or empty html has empty text; a null url has the empty host; malformed markup is closed where HTML closes it;
texts of any length and depth are kept whole; repeated rows are extracted one by one; columns besides id, url and html
are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm._common import column, materialize, small, with_id

#: Streams or wrappers of a host that one task aligns.
MERGED = 32
#: The share of a host's marked text that a marked main region holds at least, and the share of varying text that a region holds at least, on its host (unmarked) and on each stream.
MARKED_SHARE, MOST = 0.9, 0.6
#: Urls with the same text in a slot that make it template text, the share of link text that makes a block a link, and the share of such blocks, of so many characters at most on average, that makes a slot a link list.
SAME_PAGES, LINKS, LISTED, SHORT = 3, 0.5, 0.9, 100
#: Trees are walked by plain calls, one for each level.
DEPTH = 1_000_000

#: Tag groups of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select option button".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dd dt".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
#: Elements that are never main text.
DROPPED_TAGS = frozenset("head nav footer aside form dialog menu".split())
#: Words of class or id that say so if they are the whole name but for words of arrangement, and words that only hint at it.
NEVER_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr popup modal newsletter sidebar widget widgets nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus pagination pager login signup".split())
DOUBTFUL_WORDS = frozenset("banner promo promotion notice notices alert overlay subscribe subscription rail menu respond reply replies discussion share sharing social related recommended recommendations search copyright legal".split())
ARRANGING = frozenset("area block body bottom box card center col column container content div fixed global group holder inner item items left link links list main outer page panel primary right row secondary section site slot top unit wrap wrapper zone".split())
PAGE_HEADER = frozenset(["header", "head"])

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.DOTALL)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


def label_of(tag: str, attributes: str) -> str:
    """The tag with its class, id and role; runs of digits count as one 0."""
    if not attributes or "=" not in attributes:
        return tag
    words = [w for m in NAMED.finditer(attributes) for w in re.sub(r"\d+", "0", (m[2] or m[3] or m[4] or "").lower()).split()]
    return ".".join([tag, *sorted(set(words))]).replace("/", "-")


def events(page: str) -> Iterator[tuple[str, str]]:
    """('open', label), ('close', label), ('text', raw), ('link', raw) and ('gap', '') of a page, balanced; inline tags vanish."""
    stack: list[tuple[str, str]] = []
    at, kind = 0, "text"
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            if at < len(page):
                yield kind, page[at:]
            break
        if m.start() > at:
            yield kind, page[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "a":
            kind = "text" if m[1] else "link"
        elif tag not in INLINE:
            kind = "text"
        if m[1]:
            if tag not in INLINE and any(t == tag for t, _ in stack):
                while True:
                    open_tag, label = stack.pop()
                    yield "close", label
                    if open_tag == tag:
                        break
            elif tag not in INLINE:
                yield "gap", ""
        elif tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif tag in VOID:
            if tag in ("br", "hr"):
                yield "gap", ""
        elif tag not in INLINE:
            while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                yield "close", stack.pop()[1]
            label = label_of(tag, m[3])
            stack.append((tag, label))
            yield "open", label
    while stack:
        yield "close", stack.pop()[1]


class Node:
    """An element, a text ("#") or a group (""), its quantifier ("", "?", "+" or "*"), and a hash that ignores the quantifier."""

    __slots__ = ("label", "many", "optional", "kids", "key", "slot", "blocks")

    def __init__(self, label: str, kids: list["Node"], many: bool = False, optional: bool = False):
        self.label, self.kids, self.many, self.optional = label, kids, many, optional
        self.key = hash((label, *[k.key for k in kids]))
        self.slot, self.blocks = -1, []

    def marks(self) -> str:
        """What two alike siblings share."""
        return self.label or "(" + " ".join(k.marks() for k in self.kids) + ")"


TEXT = "#"


def texts_of(nodes: list[Node]) -> list[Node]:
    """The text slots in order, numbered."""
    out, waiting = [], list(reversed(nodes))
    while waiting:
        node = waiting.pop()
        if node.label == TEXT:
            node.slot = len(out)
            out.append(node)
        waiting += reversed(node.kids)
    return out


def written(nodes: list[Node]) -> str:
    """Nodes as lines: a quantifier and a label open a node, an empty line closes it."""
    lines: list[str] = []
    waiting: list[Node | None] = list(reversed(nodes))
    while waiting:
        node = waiting.pop()
        if node is None:
            lines.append("")
            continue
        lines.append(" ?+*"[node.optional + 2 * node.many] + node.label)
        waiting.append(None)
        waiting += reversed(node.kids)
    return "\n".join(lines)


def read(text: str) -> list[Node]:
    """Nodes of what ``written`` wrote."""
    if not text:
        return []
    stack: list[tuple[str, list[Node]]] = [("", [])]
    for line in text.split("\n"):
        if line:
            stack.append((line, []))
        else:
            line, kids = stack.pop()
            stack[-1][1].append(Node(line[1:], kids, line[0] in "+*", line[0] in "?*"))
    return stack[0][1]


def absorb(node: Node, other: Node) -> None:
    """other's texts join those of node, which has the same structure but for what repeats in it."""
    node.blocks += other.blocks
    node.many |= other.many
    for mine, its in zip(node.kids, other.kids):
        absorb(mine, its)


def fold(nodes: list[Node]) -> list[Node]:
    """Adjacent equal groups of siblings become one repeated group, shortest groups first, until none is left."""
    size = 1
    while 2 * size <= len(nodes):
        keys = [n.key for n in nodes]
        if len(set(keys)) == len(keys):
            break
        out, at = [], 0
        while at < len(nodes):
            end = at + size
            while end + size <= len(nodes) and keys[end] == keys[at] and keys[end : end + size] == keys[at : at + size]:
                end += size
            if end == at + size:
                out.append(nodes[at])
                at += 1
                continue
            group = nodes[at : at + size]
            for k in range(at + size, end):
                absorb(group[(k - at) % size], nodes[k])
            if size == 1:
                group[0].many = True
                out += group
            else:
                out.append(Node("", group, many=True))
            at = end
        if len(out) == len(nodes):
            size += 1
        else:
            nodes, size = out, 1
    return nodes


def tree(page: str) -> tuple[list[Node], list[tuple[str, int]]]:
    """A page's folded tree, and its blocks of text (decoded, white space squeezed) with their characters in links; a text knows its blocks."""
    stack: list[tuple[str, list[Node]]] = [("", [])]
    blocks: list[tuple[str, int]] = []
    parts: list[str] = []
    linked = 0

    def settle() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                kids[-1].blocks.append(len(blocks))
                blocks.append((text, min(linked, len(text))))
            parts.clear()
            linked = 0

    for kind, value in events(page):
        kids = stack[-1][1]
        if kind in ("text", "link"):
            if not value.isspace():
                if not parts and not (kids and kids[-1].label == TEXT):
                    kids.append(Node(TEXT, []))
                parts.append(value)
                linked += len(value.strip()) if kind == "link" else 0
            elif parts:
                parts.append(value)
            continue
        settle()
        if kind == "open":
            stack.append((value, []))
        elif kind == "close":
            label, inner = stack.pop()
            stack[-1][1].append(Node(label, fold(inner)))
    kids = stack[-1][1]
    settle()
    return fold(kids), blocks


def collapsed(nodes: list[Node], groups: list[Node]) -> list[Node]:
    """nodes in which every run of siblings that looks like one occurrence of a group is that group, once."""
    for group in groups:
        wanted = [k.marks() for k in group.kids]
        out, at, marks = [], 0, [n.marks() for n in nodes]
        while at < len(nodes):
            if marks[at : at + len(wanted)] == wanted:
                out.append(Node("", nodes[at : at + len(wanted)]))
                at += len(wanted)
            else:
                out.append(nodes[at])
                at += 1
        nodes = out
    return nodes


def pairs(a: list, b: list, *names) -> Iterator[tuple[int, int]]:
    """Places of a and b that match, in order: by the first naming, and in the gaps between by the next ones."""
    i = j = 0
    for x, y, n in SequenceMatcher(None, list(map(names[0], a)), list(map(names[0], b)), False).get_matching_blocks():
        if len(names) > 1 and i < x and j < y:
            yield from ((i + p, j + q) for p, q in pairs(a[i:x], b[j:y], *names[1:]))
        yield from ((x + k, y + k) for k in range(n))
        i, j = x + n, y + n


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """The wrapper of both: equal siblings match first, then alike ones, which are aligned in turn; what one side has alone becomes optional."""
    a, b = collapsed(a, [n for n in b if not n.label]), collapsed(b, [n for n in a if not n.label])
    loose = lambda nodes: [Node(n.label, n.kids, n.many, True) for n in nodes]
    out, i, j = [], 0, 0
    for x, y in [*pairs(a, b, lambda n: n.key, lambda n: n.marks()), (len(a), len(b))]:
        out += loose(a[i:x]) + loose(b[j:y])
        if x < len(a):
            p, q = a[x], b[y]
            out.append(Node(p.label, align(p.kids, q.kids), p.many or q.many, p.optional or q.optional))
        i, j = x + 1, y + 1
    return out


class Matcher:
    """Matches streams against a wrapper; each list of siblings is an automaton whose states are its elements and texts."""

    def __init__(self, wrapper: list[Node]):
        self.wrapper = wrapper
        self.slots = texts_of(wrapper)
        self.automata: dict[int, tuple] = {}

    def automaton(self, nodes: list[Node]) -> tuple:
        """States, whether none is needed, those that may come first, last, and after each."""
        if id(nodes) in self.automata:
            return self.automata[id(nodes)]
        states: list[Node] = []
        after: list[dict[int, None]] = []

        def run(nodes: list[Node]) -> tuple[bool, list[int], list[int]]:
            empty, first, last = True, [], []
            for node in nodes:
                if node.label:
                    none, begin, end = False, [len(states)], [len(states)]
                    states.append(node)
                    after.append({})
                else:
                    none, begin, end = run(node.kids)
                if node.many:
                    for k in end:
                        after[k].update(dict.fromkeys(begin))
                for k in last:
                    after[k].update(dict.fromkeys(begin))
                none |= node.optional
                first += begin if empty else []
                last = last + end if none else end
                empty &= none
            return empty, first, last

        empty, first, last = run(nodes)
        self.automata[id(nodes)] = found = states, empty, first, set(last), after
        return found

    def match(self, stream: list[Node], nodes: list[Node] | None = None) -> dict[int, int] | None:
        """The wrapper's slot of each of the stream's slots, or None if the wrapper does not accept the stream."""
        if nodes is None:
            texts_of(stream)
            nodes = self.wrapper
        states, empty, first, last, after = self.automaton(nodes)
        word: list[Node] = []

        def spell(items: list[Node]) -> None:
            # A repeated group stands for two occurrences.
            for item in items:
                for _ in range(1 + item.many):
                    if item.label:
                        word.append(item)
                    else:
                        spell(item.kids)

        spell(stream)
        if not word:
            return {} if empty else None
        known: dict[tuple[int, int], dict[int, int] | None] = {}

        def fits(state: int, item: Node) -> bool:
            node = states[state]
            if node.label != item.label:
                return False
            key = (state, id(item))
            if key not in known:
                known[key] = {item.slot: node.slot} if item.label == TEXT else self.match(item.kids, node.kids)
            return known[key] is not None

        steps: list[dict[int, int]] = [{s: -1 for s in first if fits(s, word[0])}]
        for item in word[1:]:
            steps.append({})
            for s in steps[-2]:
                for t in after[s]:
                    if t not in steps[-1] and fits(t, item):
                        steps[-1][t] = s
        ends = [s for s in steps[-1] if s in last]
        if not ends:
            return None
        state, out = min(ends), {}
        for item, step in zip(reversed(word), reversed(steps)):
            out |= known[state, id(item)]
            state = step[state]
        return out


NEVER, DOUBTFUL, FINE = 2, 1, 0


@lru_cache(maxsize=4096)
def verdict(path: str) -> int:
    """What the tags and names of the elements of a path say of its text."""
    inside, found = False, FINE
    for label in path.split("/"):
        tag, *names = label.split(".")
        split = [set(filter(None, re.split(r"[^a-z]+", n))) for n in names]
        words = set().union(*split)
        if tag in DROPPED_TAGS or (not inside and (tag == "header" or words & PAGE_HEADER)):
            return NEVER
        if any(w & NEVER_WORDS and w <= NEVER_WORDS | ARRANGING for w in split):
            return NEVER
        if words & (NEVER_WORDS | DOUBTFUL_WORDS):
            found = DOUBTFUL
        inside |= is_marked(label)
    return found


@dataclass(frozen=True)
class Seen:
    """A slot over the pages of a host: urls, characters, those in links, blocks, those that are links, and whether its text varies."""

    urls: int
    chars: int
    links: int
    blocks: int
    linked: int
    varies: bool

    @property
    def listed(self) -> bool:
        """A link list."""
        return self.blocks > 0 and self.linked >= LISTED * self.blocks and self.chars <= SHORT * self.blocks

    @property
    def template(self) -> bool:
        return not self.varies and self.urls >= SAME_PAGES


def main_slots(wrapper: list[Node], seen: dict[int, Seen]) -> tuple[list[int], list[int]]:
    """The slots of the main region, and all usable ones."""
    paths: dict[int, tuple[tuple[int, str], ...]] = {}
    waiting = [(n, ()) for n in wrapper]
    numbers = {id(n): k for k, n in enumerate(_all(wrapper))}
    while waiting:
        node, above = waiting.pop()
        if node.label == TEXT:
            paths[node.slot] = above
        below = (*above, (numbers[id(node)], node.label)) if node.label else above
        waiting += [(k, below) for k in node.kids]

    def fits(s: int) -> bool:
        said, it = verdict("/".join(name for _, name in paths[s])), seen.get(s)
        if said == NEVER or (it and it.listed):
            return False
        return not (said == DOUBTFUL and it and (it.template or it.links >= LISTED * it.chars))

    usable = sorted(filter(fits, paths))
    weights = {s: seen[s].chars if s in seen and seen[s].varies else 0 for s in usable}
    if not any(weights.values()):  # nothing varies, as on a host with one text
        weights = {s: seen[s].chars if s in seen else 0 for s in usable}
    held: dict[int, int] = {}
    depth: dict[int, int] = {}
    names: dict[int, str] = {}
    slots: dict[int, list[int]] = {}
    for s in usable:
        for level, (node, name) in enumerate(paths[s]):
            held[node] = held.get(node, 0) + weights[s]
            depth[node], names[node] = level, name
            slots.setdefault(node, []).append(s)
    marked = [n for n in held if is_marked(names[n])]
    if marked:
        inside = sorted({s for n in marked for s in slots[n]})
        total = sum(weights[s] for s in inside)
        full = [n for n in marked if held[n] >= MARKED_SHARE * total]
        return (sorted(slots[max(full, key=lambda n: (depth[n], -n))]) if full else inside), usable
    varying = [s for s in usable if s not in seen or not seen[s].template]
    total = sum(weights.values())
    full = [n for n in held if total and held[n] >= MOST * total and (len(slots[n]) > 1 or paths[slots[n][0]][-1][0] != n)]
    region = slots[max(full, key=lambda n: (depth[n], held[n], -n))] if full else usable
    return sorted(set(region) & set(varying)) or sorted(region), usable


def _all(nodes: list[Node]) -> Iterator[Node]:
    waiting = list(reversed(nodes))
    while waiting:
        node = waiting.pop()
        yield node
        waiting += reversed(node.kids)


def is_marked(label: str) -> bool:
    """An element that is the main region by its name."""
    tag, *words = label.split(".")
    return tag in ("article", "main") or "main" in words or "article" in words


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, url, host, html -> id, url, host, stream (hash), shape (where it is new in the batch), blocks, slots."""
    sys.setrecursionlimit(DEPTH)
    for batch in batches:
        shapes, streams, all_blocks, all_slots = [], [], [], []
        met: set[tuple[str, int]] = set()
        for host, page in zip(batch.column(2).to_pylist(), batch.column(3)):
            nodes, blocks = tree(page.as_py() or "")
            shape = written(nodes)
            stream = xxhash.xxh3_64_intdigest(shape) - (1 << 63)
            of_block, slots = [0] * len(blocks), []
            for text in texts_of(nodes):
                for k in text.blocks:
                    of_block[k] = text.slot
                inside = [blocks[k] for k in text.blocks]
                slots.append({"slot": text.slot, "chars": sum(len(t) for t, _ in inside), "links": sum(n for _, n in inside), "blocks": len(inside), "linked": sum(n > LINKS * len(t) for t, n in inside), "mark": xxhash.xxh3_64_intdigest("\0".join(t for t, _ in inside)) - (1 << 63)})
            streams.append(stream)
            shapes.append(None if (host, stream) in met else shape)
            met.add((host, stream))
            all_blocks.append([{"slot": s, "text": t} for s, (t, _) in zip(of_block, blocks)])
            all_slots.append(slots)
        columns = [pa.array(streams, pa.int64()), pa.array(shapes, pa.string()), pa.array(all_blocks, BLOCKS), pa.array(all_slots, SLOTS)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["id", "url", "host", "stream", "shape", "blocks", "slots"])


BLOCKS = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string())]))
SLOTS = pa.list_(pa.struct([("slot", pa.int32()), ("chars", pa.int64()), ("links", pa.int64()), ("blocks", pa.int64()), ("linked", pa.int64()), ("mark", pa.int64())]))


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page's stream, blocks of text and sizes of slots; a stream's shape is there at least once a host."""
    url = column(pages, url_col)
    named = pages.select(column(pages, id_col).alias("id"), url.cast("string").alias("url"), _host(url).alias("host"), column(pages, html_col).cast("string").alias("html"))
    fields = "url string, host string, stream long, shape string, blocks array<struct<slot:int,text:string>>, slots array<struct<slot:int,chars:long,links:long,blocks:long,linked:long,mark:long>>"
    return materialize(named.mapInArrow(_parsed, with_id(named, fields)), "parsed")


def _aligned(frame: pd.DataFrame) -> pd.DataFrame:
    """One wrapper of some streams or wrappers of a host, most frequent first."""
    sys.setrecursionlimit(DEPTH)
    wrapper: list[Node] | None = None
    for shape in frame.sort_values(["pages", "shape"], ascending=[False, True])["shape"]:
        wrapper = read(shape) if wrapper is None else align(wrapper, read(shape))
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "shape": [written(wrapper)], "pages": [int(frame["pages"].sum())]})


def wrappers(shapes: DataFrame) -> DataFrame:
    """host, stream, shape, pages -> host, shape: one wrapper a host; a line of it opens a node ("?", "+" or "*" before its label; "#" is text), an empty line closes one."""
    rest = shapes.select("host", "shape", "pages")
    while True:
        counted = rest.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = counted.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return rest.select("host", "shape")
        salted = rest.join(counted, "host").withColumn("salt", F.pmod(F.xxhash64("shape"), F.ceil(F.col("n") / MERGED)))
        merged = salted.groupBy("host", "salt").applyInPandas(_aligned, "host string, shape string, pages long")
        rest = materialize(merged, "wrappers")


#: Places of slots that no wrapper has.
LOOSE, BARRED = -1, -2


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, stream, shape, wrapper -> host, stream, slot, place: the wrapper's slot of every slot; of a stream that it does not accept, LOOSE or, by tags and names, BARRED."""
    sys.setrecursionlimit(DEPTH)
    held: tuple[str | None, Matcher | None] = (None, None)
    for batch in batches:
        rows: list[tuple] = []
        for host, stream, shape, wrapper in zip(*(c.to_pylist() for c in batch.columns)):
            if held[0] != wrapper:
                held = wrapper, Matcher(read(wrapper))
            nodes = read(shape)
            found = held[1].match(nodes)
            if found is None:
                fine = set(main_slots(nodes, {})[1])
                found = {t.slot: LOOSE if t.slot in fine else BARRED for t in texts_of(nodes)}
            rows += [(host, stream, slot, place) for slot, place in found.items()]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32()))], ["host", "stream", "slot", "place"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, shape, seen -> host, places of the main region, usable places."""
    sys.setrecursionlimit(DEPTH)
    for batch in batches:
        found = []
        for shape, seen in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            wrapper = read(shape)
            texts_of(wrapper)
            found.append(main_slots(wrapper, {r["place"]: Seen(r["urls"], r["chars"], r["links"], r["blocks"], r["linked"], r["varies"]) for r in seen}))
        lists = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in range(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["host", "main", "usable"])


def kept_slots(pages: DataFrame) -> DataFrame:
    """parsed pages -> host, stream, kept: the slots of main text of every stream, by its host's wrapper."""
    shapes = pages.groupBy("host", "stream").agg(F.count(F.lit(1)).alias("pages"), F.max("shape").alias("shape"))
    shapes = materialize(shapes.filter("shape <> ''"), "shapes")
    sums = ("chars", "links", "blocks", "linked")
    seen = pages.select("host", "stream", F.coalesce("url", F.lit("")).alias("url"), F.explode("slots").alias("s")).groupBy("host", "stream", "s.slot")
    # Repeated rows are one url; the smallest sketch tells few urls exactly, and more than few is all that matters.
    seen = seen.agg(F.hll_sketch_agg("url", 4).alias("urls"), *[F.sum(f"s.{c}").alias(c) for c in sums], F.min("s.mark").alias("low"), F.max("s.mark").alias("high"))
    wrapper = wrappers(shapes)
    pairs = shapes.select("host", "stream", "shape").join(wrapper.withColumnRenamed("shape", "wrapper"), "host")
    places = pairs.mapInArrow(_matched, "host string, stream long, slot int, place int")
    placed = materialize(seen.join(places, ["host", "stream", "slot"]), "slots")
    whole = placed.groupBy("host", "place").agg(F.hll_sketch_estimate(F.hll_union_agg("urls")).alias("urls"), *[F.sum(c).alias(c) for c in sums], F.min("low").alias("low"), F.max("high").alias("high"))
    varies = (F.col("urls") < 2) | (F.col("low") != F.col("high"))
    listed = whole.groupBy("host").agg(F.collect_list(F.struct("place", "urls", *sums, varies.alias("varies"))).alias("seen"))
    chosen = wrapper.join(listed, "host").select("host", "shape", "seen").mapInArrow(_chosen, "host string, main array<int>, usable array<int>")
    marked = placed.join(chosen, "host").select("host", "stream", "slot", "chars", *[(F.array_contains(c, F.col("place")) | (F.col("place") == LOOSE)).alias(c) for c in ("main", "usable")])
    of = lambda name: F.sort_array(F.collect_list(F.when(F.col(name), F.col("slot"))))
    total = lambda name: F.sum(F.when(F.col(name), F.col("chars")).otherwise(0))
    each = marked.groupBy("host", "stream").agg(of("main").alias("main"), of("usable").alias("usable"), total("main").alias("inside"), total("usable").alias("all"))
    kept = F.when((F.col("inside") > 0) & (F.col("inside") >= MOST * F.col("all")), F.col("main")).otherwise(F.col("usable"))
    return each.select("host", "stream", kept.alias("kept"))


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages -> id, url, text: the main text of every page by its host's wrapper."""
    found = parsed(pages, id_col, url_col, html_col)
    kept = materialize(kept_slots(found), "kept")
    joined = found.join(small(kept, F.octet_length("host") + F.size("kept") * 4 + 64), ["host", "stream"], "left")
    blocks = F.filter("blocks", lambda b: F.array_contains("kept", b["slot"]))
    text = F.coalesce(F.array_join(F.transform(blocks, lambda b: b["text"]), " "), F.lit(""))
    return joined.select(F.col("id").alias(id_col), "url", text.alias("text"))
