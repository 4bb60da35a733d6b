"""Main text of HTML pages by a minimum cut between content and boilerplate blocks."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Elements that begin and end a block of text; others are inline.
BLOCK = frozenset(
    "html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page: up to their end tag, and those of markup, which may be nested.
RAW = "script|style|noscript|iframe|title|textarea"
SKIP = frozenset("template object svg canvas audio video annotation annotation-xml".split())
#: Elements that ``/>`` closes, and those that a block of the page ends if they are still open.
SELF_CLOSING = frozenset({"svg", "annotation", "annotation-xml"})
#: Elements that another start of their kind ends, up to the element that bounds them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog select option button fieldset label".split())
CONTENT_TAGS = frozenset({"article", "main"})
_BAD_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|nav(?:bar|igation)?|menu|breadcrumbs?|"
    r"foot(?:er)?|header|masthead|sidebar|side|widget|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|"
    r"sign-?up|login|share|sharing|social|related|recommended|comments?|disqus|replies|respond|pagination|pager|toolbar|search|"
    r"copyright|legal|disclaimer|skip|tags)(?:$|[\s_-])"
)
#: Inside an article a hint counts where it is the last word of a name, or one of these follows.
_PLACE = (
    "area|bar|block|body|bottom|box|button|buttons|column|container|content|element|form|grid|group|inner|item|items|label|left|line|"
    "link|links|list|main|menu|module|outer|panel|placeholder|posts|right|row|section|slot|text|thread|top|unit|wrap|wrapper|\\d+"
)
_STRICT_HINT = re.compile(_BAD_HINT.pattern.removesuffix(r"(?:$|[\s_-])") + rf"(?=(?:[_-](?:{_PLACE}))*(?:\s|$))")
_GOOD_HINT = re.compile(r"(?:^|[\s_-])(?:article|content|entry|post|story|main|body|text|blog|page)(?:$|[\s_-])")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_HINTS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)


@dataclass(frozen=True)
class Costs:
    """Evidence for content (above 0) or boilerplate of a block, and the cost of telling neighbours apart.

    ``smooth`` is the capacity between blocks next to each other on the page with one parent; it is divided
    by 1 + the number of DOM steps beyond that. ``kin``: between blocks that follow each other under
    one parent with others in between.
    """

    content_tag: float = 3.0
    boilerplate_tag: float = -8.0
    page_header: float = -5.0
    good_hint: float = 1.0
    bad_hint: float = -8.0
    heading: float = 0.5
    long_text: float = 1.0
    short_text: float = -0.5
    sentence: float = 0.5
    links: float = -3.0
    smooth: float = 0.8
    kin: float = 0.4


@dataclass
class Block:
    text: str
    path: tuple[int, ...]
    weight: float
    linked: int
    heading: bool = False


class _Parser:
    """Cuts a page into blocks with the DOM path and the weight of the elements they stand in."""

    def __init__(self, costs: Costs):
        self.costs = costs

    def blocks(self, html: str) -> list[Block]:
        self.stack: list[tuple[str, int, float, bool]] = []
        #: open elements of ``SKIP``, and blocks opened inside them
        self.skipped, self.within = [], []
        self.count, self.parts, self.linked, self.links = 0, [], 0, 0
        self.found: list[Block] = []
        end = 0
        for m in _TOKEN.finditer(html):
            if m.start() > end:
                self.words(html[end : m.start()])
            end = m.end()
            name = (m.group(3) or m.group(6) or "").lower()
            if name:
                if m.group(2) or m.group(5):
                    self.close(name)
                else:
                    self.open(name, m.group(4) or m.group(7) or "")
        if end < len(html):
            self.words(html[end:])
        self.flush()
        return self.found

    def words(self, raw: str) -> None:
        if self.skipped:
            return
        self.parts.append(raw)
        if self.links:
            self.linked += len(raw.split()) and len(raw)

    def flush(self) -> None:
        text = " ".join(unescape("".join(self.parts)).split())
        if text and not any(hidden for *_, hidden in self.stack):
            weight = sum(w for _, _, w, _ in self.stack)
            heading = any(t in ("h1", "h2", "h3", "h4", "h5", "h6") for t, *_ in self.stack)
            self.found.append(Block(text, tuple(k for _, k, _, _ in self.stack), weight, self.linked, heading))
        self.parts, self.linked = [], 0

    def open(self, name: str, attributes: str) -> None:
        if name in SKIP and not (name in SELF_CLOSING and attributes.rstrip().endswith("/")):
            self.skipped.append(name)
        if self.skipped:
            # a picture that is never closed ends where the page goes on
            if name not in BLOCK or set(self.skipped) - {"svg"}:
                self.within += [name] * (name in BLOCK and name not in VOID)
                return
            self.skipped, self.within = [], []
        if name == "br":
            self.parts.append(" ")
        if name == "a":
            self.links += 1
        if name not in BLOCK:
            return
        self.flush()
        if any(t == "p" for t, *_ in self.stack) and name not in ("html", "head", "body"):
            self.pop("p")
        if name in CLOSES:
            ends, bounds = CLOSES[name]
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at][0] in bounds:
                    break
                if self.stack[at][0] in ends:
                    del self.stack[at:]
        if name in VOID:
            return
        self.count += 1
        self.stack.append((name, self.count, self.weigh(name, attributes), bool(attributes and _HIDDEN.search(attributes))))

    def weigh(self, name: str, attributes: str) -> float:
        costs, inside = self.costs, {t for t, *_ in self.stack}
        weight = 0.0
        if name in CONTENT_TAGS and not inside & CONTENT_TAGS:
            weight += costs.content_tag
        elif name in BOILERPLATE_TAGS:
            weight += costs.boilerplate_tag
        elif name == "header" and not inside & CONTENT_TAGS:
            weight += costs.page_header
        if attributes and name not in ("html", "body", "article", "main"):
            hints = " ".join(a or b or c for a, b, c in _HINTS.findall(attributes))
            hints = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", hints).lower()
            bad = _STRICT_HINT if inside & CONTENT_TAGS else _BAD_HINT
            if hints and bad.search(hints):
                weight += costs.bad_hint
            elif hints and _GOOD_HINT.search(hints):
                weight += costs.good_hint
        return weight

    def pop(self, name: str) -> bool:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == name:
                del self.stack[at:]
                return True
        return False

    def close(self, name: str) -> None:
        if self.skipped:
            if name in self.skipped:
                del self.skipped[len(self.skipped) - 1 - self.skipped[::-1].index(name) :]
                self.within = self.within if self.skipped else []
                return
            if name in self.within:
                self.within.remove(name)
                return
            if not any(t == name for t, *_ in self.stack):
                return
            self.skipped, self.within = [], []
        if name == "a":
            self.links = max(0, self.links - 1)
        if name in BLOCK:
            self.flush()
            self.pop(name)


def evidence(block: Block, costs: Costs) -> float:
    """Classifier score of one block: above 0 it looks like content."""
    score, size = block.weight, len(block.text)
    if block.heading:
        score += costs.heading
    else:
        score += costs.long_text if size >= 80 else costs.short_text if size < 20 else 0.0
        if block.text[-1] in ".!?…。\"”'»:;":
            score += costs.sentence
    if 2 * block.linked > size:
        score += costs.links
    return score


def neighbours(blocks: list[Block], costs: Costs) -> list[tuple[int, int, float]]:
    """Smoothness edges: page neighbours by their distance in the DOM, and next of kin under one parent."""
    edges, last = [], {}
    for i, block in enumerate(blocks):
        parent = block.path[:-1]
        if i:
            a, b = blocks[i - 1].path, block.path
            common = 0
            while common < min(len(a), len(b)) and a[common] == b[common]:
                common += 1
            steps = max(0, len(a) - common - 1) + max(0, len(b) - common - 1)
            edges.append((i - 1, i, costs.smooth / (1 + steps)))
        if parent in last and last[parent] < i - 1:
            edges.append((last[parent], i, costs.kin))
        last[parent] = i
    return edges


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the content side of a minimum cut.

    A node's score is the capacity from the content terminal if above 0, else to the boilerplate terminal;
    edges have one capacity both ways. Flow is sent along shortest paths, by levels, until none is left.
    """
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            join(source, i, s, 0.0)
        elif s < 0:
            join(i, sink, -s, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(i for i, e in enumerate(path) if room[e] <= tiny)
                a = to[path[full] ^ 1]
                del path[full:]
                continue
            while place[a] < len(out[a]):
                e = out[a][place[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                place[a] += 1
            if place[a] < len(out[a]):
                path.append(e)
                a = to[e]
            elif path:
                a = to[path.pop() ^ 1]
                place[a] += 1
            else:
                break


def main_text(html: str | None, costs: Costs = Costs()) -> str:
    """Content blocks of a page in page order, joined by two line ends; empty if there are none."""
    blocks = _Parser(costs).blocks(html or "")
    if not blocks:
        return ""
    keep = minimum_cut([evidence(b, costs) for b in blocks], neighbours(blocks, costs))
    return "\n\n".join(b.text for b, own in zip(blocks, keep) if own)


class _Extract:
    def __init__(self, costs: Costs):
        self.costs = costs

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = [main_text(h, self.costs) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*batch.schema.names[:-1], "text", "n_chars"],
            )


def extract(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url"), html: str = "html", costs: Costs = Costs()) -> DataFrame:
    """``carry``, text and n_chars for every page, from its whole html; a page is a small graph in one task, pages are independent.

    Null and empty html, and pages without content, have an empty text. Markup that is never closed ends with
    the page. Repeated rows come back as often as they occur.
    """
    rows = pages.select(*carry, F.col(html).alias("html_"))
    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], "text string, n_chars long"])
    return rows.mapInArrow(_Extract(costs), shape)
