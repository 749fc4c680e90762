"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks (one run of text between block-level tags). A linear classifier over a block's surroundings
and text gives the cost of calling it content and of calling it boilerplate: these are the capacities to the terminals.
Neighbouring blocks, and blocks of one container, are joined by smoothness edges that weaken with their distance in the
tree. The minimum cut of this graph, found by max-flow, is the labelling of least total cost; content blocks are kept.

The weights of a block's text (length, links, sentence, running words, commas, heading) are learned: blocks whose markup
tells what they are (inside ``article`` or ``main``, or inside ``nav``, ``footer`` and the like) label themselves, on at
most TRAIN_PAGES pages chosen by a hash; they are counted by their traits, a bounded table, and a logistic regression is
fitted to the counts. So pages without such markup are judged by their text and their neighbours. The weights of the
markup are fixed. Without pages of both labels DEFAULT_TEXT is used.

Character references are decoded, white space within a block becomes one space, blocks are trimmed and joined in page
order by two line feeds. Scripts, styles, comments, hidden and form elements never give text, nor does what browsers
show only if they cannot show an element (inside ``object``, ``canvas``, ``audio``, ``video``, ``iframe``), nor drawings.
Formulas do, but for their ``annotation``. ``<br>`` is white space.

Defined cases: null and empty html give the empty text; tags that are never closed, closed without being open, or cut off
at the end are tolerated as browsers do; plain text is one block; repeated pages repeat; extra columns stay out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACES = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg annotation annotation-xml iframe object title textarea select option xmp canvas audio video".split())
_FORMULA = "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics"
_INLINE = frozenset(f"{_FORMULA} a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_BOILER_TAGS = frozenset("nav footer aside form button menu dialog fieldset label datalist output head".split())
_CONTENT_TAGS = frozenset("article main".split())
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BOILER_NAME = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|side-?bar\w*|foot\w*|masthead|banner|cookie\w*|consent|notices?|notification|alert|ads?|advert\w*|adslot|promo\w*"
    r"|sponsor\w*|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|repl(?:y|ies)|respond|newsletter|subscri\w*|signup|breadcrumbs?|widget|popup|modal"
    r"|overlay|login|search\w*|pagination|pager|skip\w*|legal|copyright|gdpr|toolbar|trending|popular|paywall|hidden)(?:$|[\s_-])",
    re.I,
)
_CONTENT_NAME = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story\w*|body|text|prose)(?:$|[\s_-])", re.I)
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form note".split())

#: names that an article's own parts have as well
_WEAK_NAME = re.compile(r"(?:^|[\s_-])(?:header|tags?)(?:$|[\s_-])", re.I)

#: the weights of the markup in favour of content
MARKUP = {"inside": 3.0, "boiler": -9.0, "named": -6.0, "weak": -2.0, "weak_inside": -3.0, "content": 1.5}
#: bounds of the traits' classes; without labels: weights by (trait, class), and of no trait
LENGTHS, LINKED, RUNNING = (25, 80, 200), (0.01, 0.5), (0.4, 0.7)
DEFAULT_TEXT = {None: -1.0, (0, 1): 0.5, (0, 2): 1.2, (0, 3): 2.0, (1, 1): -0.5, (1, 2): -3.0, (2, 1): 0.8, (5, 1): 0.5}
TRAIN_PAGES, TEXT_BOUND = 2000, 4.0
ADJACENT, SIBLING, SCALE = 0.5, 0.5, 1000


class _Element:
    __slots__ = ("boiler", "content", "depth", "inside", "link", "name", "named", "number", "parent", "weak")

    def __init__(self, name: str, parent: _Element | None, number: int) -> None:
        self.name, self.parent, self.number = name, parent, number
        self.boiler, self.named, self.weak, self.inside, self.content, self.link, self.depth = False, False, False, False, False, False, 0
        if parent is not None:
            self.boiler, self.named, self.weak, self.inside, self.content, self.link = parent.boiler, parent.named, parent.weak, parent.inside, parent.content, parent.link
            self.depth = parent.depth + (name not in _INLINE)


def _open(name: str, attributes: str, parent: _Element, number: int) -> _Element:
    e = _Element(name, parent, number)
    e.link = e.link or name == "a"
    e.boiler = e.boiler or name in _BOILER_TAGS or name == "header" and not parent.inside
    e.inside = e.inside or name in _CONTENT_TAGS
    if attributes and "=" in attributes or "hidden" in attributes:
        at = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        label = f"{at.get('class', '')} {at.get('id', '')}"
        role = at.get("role", "").lower()
        if role in _BOILER_ROLES or "hidden" in at or at.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", "")):
            e.boiler = True
        if name not in ("html", "body"):
            if _BOILER_NAME.search(label) and name not in _CONTENT_TAGS:
                e.named = True
            elif _WEAK_NAME.search(label) and name not in _CONTENT_TAGS:
                e.weak = True
            elif _CONTENT_NAME.search(label) or "articlebody" in at.get("itemprop", "").lower():
                e.content = True
        e.inside = e.inside or role in ("main", "article")
    return e


class Block:
    __slots__ = ("at", "heading", "linked", "text")

    def __init__(self, text: str, linked: int, at: _Element) -> None:
        self.text, self.linked, self.at = text, linked, at
        self.heading = len(at.name) == 2 and at.name[0] == "h" and at.name[1].isdigit()


def blocks(source: str) -> list[Block]:
    """The text blocks of a page, in page order."""
    out: list[Block] = []
    root = _Element("#root", None, 0)
    stack = [root]
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = 0
    home: _Element | None = None  # the innermost block element around the first text of the block

    def flush() -> None:
        nonlocal linked, home
        if parts:
            text = _SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, linked, home or root))
            parts.clear()
        linked, home = 0, None

    def add(text: str) -> None:
        nonlocal linked, home
        if home is None and not text.isspace():
            home = stack[-1]
            while home.name in _INLINE and home.parent is not None and home.named == home.parent.named and home.boiler == home.parent.boiler:
                home = home.parent
        parts.append(text)
        if stack[-1].link:
            linked += len(text)

    def close(name: str) -> None:
        while stack[-1].name != name:
            opened[stack.pop().name] -= 1
        opened[stack.pop().name] -= 1

    position, number = 0, 0
    while True:
        m = _TOKEN.search(source, position)
        if m is None:
            if position < len(source):
                add(source[position:])
            break
        if m.start() > position:
            add(source[position : m.start()])
        position = m.end()
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if slash:
            if name not in _INLINE:
                flush()
            if opened.get(name):
                if stack[-1].named != stack[-2].named:
                    flush()
                close(name)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _RAW:
            if attributes.endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(name)}(?:\s[^>]*)?>", re.I).search(source, position)
            if end is None:
                if name not in ("object", "svg", "math", "canvas", "audio", "video"):
                    break
                continue
            position = end.end()
            continue
        if name not in _INLINE:
            flush()
            if name in _CLOSES_P and opened.get("p"):
                close("p")
            for other in _SELF_CLOSING.get(name, ()):
                if opened.get(other) and stack[-1].name == other:
                    close(other)
        if name in _VOID or attributes.endswith("/") and name not in _INLINE and name not in _CLOSES_P:
            continue
        number += 1
        e = _open(name, attributes, stack[-1], number)
        if name in _INLINE and (e.named, e.boiler) != (stack[-1].named, stack[-1].boiler):
            flush()
        stack.append(e)
        opened[name] = opened.get(name, 0) + 1
    flush()
    return out


def traits(b: Block) -> tuple[int, ...]:
    """Classes of what the text alone tells: length, share of links, end of a sentence, small words, commas, heading."""
    n, words = len(b.text), b.text.split()
    classes = lambda v, bounds: sum(v >= x for x in bounds)
    running = sum(w[0].islower() for w in words) / len(words)
    return classes(n, LENGTHS), classes(b.linked / n, LINKED), int(b.text[-1] in ".!?…\"”»:;" and n > 20), classes(running, RUNNING), int("," in b.text), int(b.heading)


def weak_label(b: Block) -> int | None:
    """What the markup alone tells, if it does."""
    at = b.at
    if at.boiler or at.named:
        return 0
    return 1 if at.inside and not at.weak else None


def text_evidence(seen: tuple[int, ...], text: dict) -> float:
    return max(-TEXT_BOUND, min(TEXT_BOUND, text[None] + sum(text.get((i, v), 0.0) for i, v in enumerate(seen))))


def evidence(b: Block, text: dict) -> float:
    """The classifier: positive speaks for content."""
    w, at = MARKUP, b.at
    named = w["named"] if at.named else (w["weak_inside"] if at.inside else w["weak"]) if at.weak else 0.0
    return text_evidence(traits(b), text) + w["inside"] * at.inside + w["boiler"] * at.boiler + named + w["content"] * at.content


def fit_text(counts: dict[tuple[tuple[int, ...], int], int], ridge: float = 1.0) -> dict:
    """The weights of DEFAULT_TEXT's form from {(traits, label): blocks}: a logistic regression by Newton steps. Both labels
    weigh the same, as a block's chances should not depend on how many menu entries a site has."""
    total = [sum(n for (_, y), n in counts.items() if y == k) for k in (0, 1)]
    if not all(total):
        return DEFAULT_TEXT
    names = sorted({(i, v) for seen, _ in counts for i, v in enumerate(seen) if v})
    x = np.array([[1.0, *[float(seen[i] == v) for i, v in names]] for seen, _ in counts])
    y = np.array([float(label) for _, label in counts])
    weight = np.array([n / total[label] for (_, label), n in counts.items()]) * min(sum(total), 10_000) / 2
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag([1e-6, *np.ones(len(names))])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return {None: float(w[0])} | {n: float(v) for n, v in zip(names, w[1:], strict=True)}


def learn(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> dict:
    """Text weights from at most about ``train_pages`` pages; a few hundred counts reach the driver."""
    share = min(1.0, train_pages / max(1, pages.count()))
    sample = pages.select("html").where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < int(share * 1_000_000))

    def make():
        def apply(rows: dict) -> dict:
            c: Counter = Counter()
            for h in rows["html"]:
                c.update((traits(b), y) for b in blocks(h or "") if (y := weak_label(b)) is not None)
            return {"seen": [list(t) for t, _ in c], "label": [y for _, y in c], "n": list(c.values())}

        return apply

    found = map_rows(sample, make, "seen array<int>, label int, n bigint").groupBy("seen", "label").agg(F.sum("n")).collect()
    return fit_text({(tuple(t), y): n for t, y, n in found})


def _container(e: _Element) -> _Element:
    while e.parent is not None and (e.name in _INLINE or e.name in _LEAVES):
        e = e.parent
    return e


def _tree_distance(a: _Element, b: _Element) -> int:
    n = 0
    while a is not b:
        if a.number >= b.number and a.parent is not None:
            n += a.name not in _INLINE
            a = a.parent
        else:
            n += b.name not in _INLINE
            b = b.parent
    return n


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the source side: the cost is ``sink`` of those, ``source`` of the others and the edges
    between the sides. Augmenting paths by breadth-first levels (Dinic); what both terminals give cancels first."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    left: list[int] = []
    of: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: int, back: int) -> None:
        of[a].append(len(to))
        of[b].append(len(to) + 1)
        to.extend((b, a))
        left.extend((there, back))

    for i, (a, b) in enumerate(zip(source, sink, strict=True)):
        if a > b:
            link(s, i, a - b, 0)
        elif b > a:
            link(i, t, b - a, 0)
    for a, b, c in edges:
        link(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for k in of[a]:
                if left[k] and level[to[k]] < 0:
                    level[to[k]] = level[a] + 1
                    queue.append(to[k])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        nexts = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(left[k] for k in path)
                for i, k in enumerate(path):
                    left[k] -= least
                    left[k ^ 1] += least
                cut = next(i for i, k in enumerate(path) if not left[k])
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nexts[a] < len(of[a]):
                k = of[a][nexts[a]]
                if left[k] and level[to[k]] == level[a] + 1:
                    break
                nexts[a] += 1
            else:
                if a == s:
                    break
                k = path.pop()
                a = to[k ^ 1]
                nexts[a] += 1
                continue
            path.append(k)
            a = to[k]


def label(found: list[Block], text: dict = DEFAULT_TEXT) -> list[bool]:
    """True for content blocks."""
    source, sink = [], []
    for b in found:
        z = max(-20.0, min(20.0, evidence(b, text)))
        # negative log likelihoods: calling it boilerplate costs log(1 + e^z), content log(1 + e^-z)
        source.append(int(SCALE * math.log1p(math.exp(z))))
        sink.append(int(SCALE * math.log1p(math.exp(-z))))
    edges, last_of = [], {}
    for i, b in enumerate(found):
        home = _container(b.at)
        if i:
            distance = _tree_distance(home, _container(found[i - 1].at))
            edges.append((i - 1, i, int(SCALE * ADJACENT / 2**distance)))
        before = last_of.get(home.number)
        if before is not None:
            edges.append((before, i, int(SCALE * SIBLING)))
        last_of[home.number] = i
    return minimum_cut(source, sink, [e for e in edges if e[2]])


def main_text(source: str | None, text: dict = DEFAULT_TEXT) -> str:
    if not source:
        return ""
    found = blocks(source)
    return "\n\n".join(b.text for b, keep in zip(found, label(found, text), strict=True) if keep)


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), text: dict | None = None) -> DataFrame:
    """The key columns with text (empty if there is none) and n_chars of every page's whole html. ``text``: weights of a
    block's text, by default learned from the pages themselves."""
    kinds = dict(pages.dtypes)
    weights = learn(pages) if text is None else text

    def make():
        def apply(rows: dict) -> dict:
            texts = [main_text(h, weights) for h in rows["html"]]
            return {**{k: rows[k] for k in keys}, "text": texts, "n_chars": [len(t) for t in texts]}

        return apply

    return map_rows(pages.select(*keys, "html"), make, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "text string, n_chars bigint"]))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
