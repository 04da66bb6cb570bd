"""Main text of web pages by a tree-structured graphical model.

Each element that can hold a block of text is a node of the page's tree, content or not. A node's own evidence
(kind of element, class words, links, length, section) gives its unary potential, and parent-child potentials
say how likely a child of its kind is content below a content or other parent. Sum-product messages pass
upward from the leaves and downward from the root; nodes whose marginal is above one half make up the text.

Potentials are counted on labelled pages: of a bounded sample (``TRAIN_PAGES``) of pages that mark their
article, the nodes in it but not in boilerplate elements are content; what stands at or below a class of boilerplate there
has no label and is not counted. The mark itself, which gives the labels, is no trained
evidence: its weight is a fixed prior, and kinds, class words, links, lengths and edges are learned without it. The
tests score the model on held-out pages whose marks were taken away. Prior counts stand for kinds that the sample
lacks.

Class, id and role words are evidence, not a verdict. A token made of boilerplate and layout words alone
("related-posts") speaks against its element and puts what is below in doubt; boilerplate words beside others
("related-work"), or vague ones in an id, are a weak sign; a heading's id repeats its text and says nothing.

Defined cases: a null or empty page, or one without content, has the empty text. Repeated rows are extracted
row by row and count once in training; an empty table gives an empty result; other columns are ignored. Pages are read whole. Broken
markup is read as browsers do: unclosed elements end with their parent, stray end tags are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.common import table

TRAIN_PAGES = 500
#: Weight of the prior counts.
PRIOR = 10

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:\s++|/|[^\s\"'>/=][^\s>/=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+))?+|[\"'=])*+)(?P<close>>|\Z)",
    re.S,
)
#: One attribute with its value, so that nothing inside a value is read as a name.
_ATTR = re.compile(r"([^\s\"'>/=][^\s>/=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+)))?+")
_WORD = re.compile(r"[a-z]+|[0-9]+")

#: Element names by kind, as the HTML standard uses them.
KINDS = {
    "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "para": "p blockquote pre li dd dt td th caption figcaption address summary center",
    "box": "html body div section main article figure details fieldset table tbody thead tfoot tr ul ol dl hr",
    "aside": "nav aside footer header menu dialog",
    "form": "form button input select textarea label option optgroup datalist output legend",
    "hidden": "head title meta link script style template noscript iframe svg math object embed audio video canvas map frameset",
}
KIND = {name: kind for kind, names in KINDS.items() for name in names.split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
#: An opening of the first closes an open one of the second, up to its container.
CLOSES = {
    "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tr": {"tr", "td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
CONTAINERS = frozenset("ul ol dl table select body div section article".split())
#: Class and id words of boilerplate, those of them that also name parts of an article, and of layout.
BAD = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "sidebar aside footer comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended "
    "recommendations breadcrumb breadcrumbs pagination pager toolbar login search form copyright legal disclaimer "
    "masthead topbar skip teaser outbrain taboola contentinfo complementary".split()
)
VAGUE = frozenset("alert banner comment discussion form legal menu notice notices promotion related reply search share sharing social teaser".split())
LAYOUT = frozenset(
    "area bar block bottom box button buttons col column container content group icons inner item items left line link links list "
    "main outer page panel post posts right row section site slot title top unit widget wrap wrapper".split()
)
GOOD = frozenset("article content post entry story main body text prose".split())
LENGTHS, LINKS = (1, 25, 80, 250), (0.05, 0.33, 0.66)
#: How far one kind of evidence can move the log odds, down and up.
CAPS = {"kind": (-6.0, 2.0), "class": (-4.0, 3.0), "section": (-6.0, 4.0), "links": (-2.0, 2.0), "length": (-1.5, 1.5)}
#: Prior log odds in and below elements of boilerplate, and at and below a class of boilerplate.
BOILERPLATE, DOUBT = -9.0, -7.0


@dataclass
class Node:
    parent: int
    name: str
    kind: str
    classes: str
    section: str
    chars: int = 0
    linked: int = 0
    #: Runs of text, as (order of the block on the page, text).
    runs: list[tuple[int, str]] = field(default_factory=list)


def _attributes(attrs: str) -> dict[str, str]:
    """Attributes by name, each with its first value."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _hidden(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true"


def _class_kind(name: str, found: dict[str, str]) -> str:
    """What class, id and role say: none, other, good, weak (a sign of boilerplate) or bad."""
    if name in ("html", "body"):  # their classes tell what the page has somewhere
        return "none"
    kinds = set()
    for attr in ("class", "id", "role"):
        if attr == "id" and KIND.get(name) == "heading":
            continue
        for token in html.unescape(found.get(attr, "")).lower().split():
            words = set(_WORD.findall(token))
            bad, rest = words & BAD, {w for w in words - BAD - LAYOUT if not w.isdigit()}
            if bad:
                kinds.add("weak" if rest or (attr == "id" and bad <= VAGUE) else "bad")
            elif words & GOOD:
                kinds.add("good")
            elif words == {"header"} or words == {"site", "header"} or words == {"page", "header"}:
                kinds.add("bad")
            elif words:
                kinds.add("other")
    if "bad" in kinds:
        return "weak" if "good" in kinds else "bad"
    return next((k for k in ("good", "weak", "other") if k in kinds), "none")


def parse(page: str) -> list[Node]:
    """The page's nodes in order; a parent comes before its children. Inline elements add to the node around."""
    nodes = [Node(-1, "#root", "box", "none", "none")]
    # open elements: (name, node they write to, whether they opened it, the block to go on with afterwards or -1)
    stack: list[tuple[str, int, bool, int]] = [("#root", 0, True, -1)]
    links = block = blocks = at = 0

    def write(text: str) -> None:
        if not text:
            return
        own = nodes[stack[-1][1]]
        own.runs.append((block, text))

    def close(depth: int) -> None:
        nonlocal block, blocks, links
        while len(stack) > depth:
            name, _, opened, back = stack.pop()
            links -= name == "a"
            if back >= 0:
                block = back
            elif opened:
                blocks += 1
                block = blocks

    def weigh(text: str) -> None:
        own = nodes[stack[-1][1]]
        n = len(text) - text.count(" ")
        own.chars += n
        own.linked += n if links > 0 else 0

    while m := _TAG.search(page, at):  # goes on behind what was read, so nothing inside a raw element is a tag
        if m.start() > at:
            text = page[at : m.start()]
            write(text)
            weigh(text)
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if not m["close"]:  # the page ends inside a tag
            break
        if m["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
            continue
        if name == "br":
            write(" ")
            continue
        kind = KIND.get(name)
        if kind and kind != "form" and name not in ("td", "th"):
            for depth in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] in CONTAINERS:
                    break
        if name in CLOSES:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in CLOSES[name]:
                    close(depth)
                elif stack[depth][0] in CONTAINERS:
                    break
        found = _attributes(m["attrs"]) if m["attrs"] else {}
        classes, hidden = _class_kind(name, found) if found else "none", bool(found) and _hidden(found)
        opened = kind is not None or classes == "bad" or hidden
        own, back = stack[-1][1], block if kind is None and opened else -1
        if opened:
            above = nodes[own].section
            kind = kind or "box"
            if kind in ("aside", "form", "hidden") or hidden or above == "bad":
                section = "bad"
            elif classes == "bad" or above == "doubt":
                section = "doubt"
            elif name in ("article", "main"):
                section = "article"
            else:
                section = above
            nodes.append(Node(own, name, kind, classes, section))
            own = len(nodes) - 1
            blocks += 1
            block = blocks
        if name in VOID:
            if opened:
                blocks += 1
                block = blocks if back < 0 else back
            continue
        stack.append((name, own, opened, back))
        links += name == "a"
        if name in RAW:
            end = re.compile(f"(?i)</{re.escape(name)}(?=[\\s/>]|\\Z)").search(page, at)
            at = end.start() if end else len(page)
    if at < len(page) and not page.startswith("<", at):
        write(page[at:])
        weigh(page[at:])
    return nodes


def _bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def evidence(nodes: list[Node]) -> list[dict[str, str]]:
    """What is seen of each node; the section says nothing on pages that mark no article."""
    chars, linked = [n.chars for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        linked[nodes[i].parent] += linked[i]
    marked = any(n.section == "article" for n in nodes)
    out = []
    for n, c, a in zip(nodes, chars, linked):
        seen = {"kind": n.kind, "class": n.classes}
        if marked or n.section in ("bad", "doubt"):
            seen["section"] = n.section
        if n.kind in ("para", "heading", "box"):
            seen["length"] = str(_bucket(c, LENGTHS))
            if c:
                seen["links"] = str(_bucket(a / c, LINKS))
        out.append(seen)
    return out


def labels(nodes: list[Node]) -> list[int | None]:
    """Labels of a page that marks its article: content stands in it and in no boilerplate element. Whether what stands
    at or below a class of boilerplate belongs to it is not known."""
    return [None if n.section == "doubt" else int(n.section == "article") for n in nodes]


class Model:
    """Unary log odds of each piece of evidence, and child potentials given the parent, from counts."""

    def __init__(self, seen: Counter | None = None, edges: Counter | None = None):
        # prior counts: (evidence, label) and (kind, parent label, label)
        own: Counter = Counter(
            {
                ("kind=aside", 0): 40, ("kind=form", 0): 40, ("kind=hidden", 0): 80, ("class=bad", 0): 40, ("section=bad", 0): 40,
                ("section=none", 0): 10, ("section=article", 1): 10, ("kind=para", 1): 6, ("kind=para", 0): 3,
                ("kind=heading", 1): 3, ("kind=heading", 0): 1, ("kind=box", 0): 5, ("kind=box", 1): 5, ("class=good", 1): 6,
                ("class=none", 0): 10, ("class=none", 1): 10, ("class=weak", 0): 6, ("class=weak", 1): 3, ("class=other", 0): 3, ("class=other", 1): 3,
                ("links=0", 1): 10, ("links=0", 0): 4, ("links=1", 1): 3, ("links=2", 0): 3, ("links=3", 0): 10,
                ("length=0", 0): 3, ("length=1", 0): 4, ("length=2", 1): 1, ("length=3", 1): 4, ("length=4", 1): 6,
            }
        )
        below: Counter = Counter()
        for kind in KINDS:
            inner = kind in ("para", "heading", "box")
            below[kind, 1, 1], below[kind, 1, 0] = (8, 1) if inner else (0, 4)
            below[kind, 0, 1], below[kind, 0, 0] = (2, 4) if inner else (0, 8)
        own, below = (Counter({k: PRIOR * n for k, n in c.items()}) for c in (own, below))
        own.update(seen or {})
        below.update(edges or {})
        totals: Counter = Counter()
        for (what, label), n in own.items():
            totals[what.split("=")[0], label] += n
        self.odds = {}
        for what in {w for w, _ in own}:
            name = what.split("=")[0]
            ratio = math.log((own[what, 1] + 0.5) / (totals[name, 1] + 3)) - math.log((own[what, 0] + 0.5) / (totals[name, 0] + 3))
            low, high = CAPS[name]
            self.odds[what] = max(low, min(high, ratio))
        self.odds |= {"section=bad": BOILERPLATE, "section=doubt": DOUBT}  # never learned, as the section gives the labels
        self.child = {}
        for kind in KINDS:
            for parent in (0, 1):
                yes, no = below[kind, parent, 1] + 0.5, below[kind, parent, 0] + 0.5
                self.child[kind, parent] = max(0.01, min(0.99, yes / (yes + no)))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for each node, by messages up to the root and down again."""
        n = len(nodes)
        unary = []
        for seen in evidence(nodes):
            odds = sum(self.odds.get(f"{k}={v}", 0.0) for k, v in seen.items())
            p = 1 / (1 + math.exp(-odds))
            unary.append((1 - p, p))
        inside = [list(u) for u in unary]  # own evidence and all messages from below
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            node, (a, b) = nodes[i], inside[i]
            low, high = self.child[node.kind, 0], self.child[node.kind, 1]
            m0, m1 = (1 - low) * a + low * b, (1 - high) * a + high * b
            total = m0 + m1
            up[i] = (m0 / total, m1 / total)
            above = inside[node.parent]
            above[0] *= up[i][0]
            above[1] *= up[i][1]
            total = above[0] + above[1]
            above[0] /= total
            above[1] /= total
        belief = [(1.0, 0.0)] * n  # the root is not content itself
        out = [0.0] * n
        for i in range(1, n):
            node = nodes[i]
            b0, b1 = belief[node.parent][0] / up[i][0], belief[node.parent][1] / up[i][1]
            low, high = self.child[node.kind, 0], self.child[node.kind, 1]
            d0, d1 = b0 * (1 - low) + b1 * (1 - high), b0 * low + b1 * high
            p0, p1 = inside[i][0] * d0, inside[i][1] * d1
            total = p0 + p1
            belief[i] = (p0 / total, p1 / total)
            out[i] = belief[i][1]
        return out


def extract(page: str | None, model: Model) -> str:
    """The page's main text: content blocks in page order, one line each."""
    if not page:
        return ""
    nodes = parse(page)
    kept: dict[int, list[str]] = {}
    for node, p in zip(nodes, model.marginals(nodes)):
        if p > 0.5:
            for block, text in node.runs:
                kept.setdefault(block, []).append(html.unescape(text) if "&" in text else text)
    lines = (" ".join("".join(kept[b]).split()) for b in sorted(kept))
    return "\n".join(x for x in lines if x)


def train(pages: DataFrame, sample: int = TRAIN_PAGES, id_col: str = "page_id", html_col: str = "html") -> Model:
    """Count potentials on at most ``sample`` distinct pages that mark their article, chosen by a hash of id and page."""
    named = pages.select(F.xxhash64(F.col(id_col), F.col(html_col)).alias("name"), F.col(html_col).alias("html"))
    marked = named.filter(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select("name").distinct()
    chosen = [r["name"] for r in marked.orderBy("name").limit(sample).collect()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                nodes = parse(page)
                own = labels(nodes)
                for node, what, label in zip(nodes[1:], evidence(nodes)[1:], own[1:]):
                    if label is None or own[node.parent] is None:
                        continue
                    for k, v in what.items():
                        if k != "section":  # that is where the label comes from
                            seen[f"{k}={v}", -1, label] += 1
                    seen[node.kind, own[node.parent], label] += 1
        rows = [(w, p, y, n) for (w, p, y), n in seen.items()]
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["what", "parent", "label", "n"])

    if not chosen:
        return Model()
    counted = named.filter(F.col("name").isin(chosen)).dropDuplicates(["name"]).select("html").mapInArrow(count, "what string, parent int, label int, n long")
    rows = counted.groupBy("what", "parent", "label").agg(F.sum("n").alias("n")).collect()  # a few dozen rows
    seen = Counter({(r["what"], r["label"]): r["n"] for r in rows if r["parent"] < 0})
    edges = Counter({(r["what"], r["parent"], r["label"]): r["n"] for r in rows if r["parent"] >= 0})
    return Model(seen, edges)


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = model or train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py(), model) for p in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
