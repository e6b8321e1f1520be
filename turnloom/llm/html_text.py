"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every block of text is a node that is main text or not. Node potentials
come from its tag, attributes, length, links and punctuation; potentials between parent and child
say how likely a child is main text given its parent, one table for parents whose name or
attributes mark them as beside the text, one for those marked as text, one for all others. Sum-product messages go from the leaves up
and from the root down, and a block of text is kept when its marginal is at least one half.

Null html is an empty page; a page without main text gives the empty text. Broken markup is read as
browsers do it: unclosed paragraphs end where the next block starts, stray end tags are ignored,
a page may stop anywhere. Whole pages of any length are read. Repeated rows get equal texts; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_pages import labelled_pages

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_STOP = re.compile("[>\"']")
#: elements whose content is no markup, and their end tags
_RAW = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style", "textarea", "title")}
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|data-main)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_PART = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements that count only when the next tag of their name is their end tag: forgotten end tags must not hide what follows
NEEDS_END = frozenset("button canvas iframe math noscript object select svg template".split())
#: of these, the ones that stand beside the text
CONTROLS = NEEDS_END - {"math", "object"}
_NEXT = {name: re.compile(rf"<(/?){name}(?=[\s/>])", re.I) for name in NEEDS_END}
CLOSED_BY_BLOCK = frozenset(["p"])
#: an element that ends when another of its kind starts
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: attribute words that mark parts beside the text, and the text itself
BESIDE = frozenset("nav navigation menu navbar header masthead foot footer side sidebar aside ad ads advert advertisement sponsor sponsored promo promotion banner cookie cookies notice consent gdpr popup modal overlay alert share sharing social related recommended recommendations comment comments reply replies respond disqus discussion form login signin signup subscribe subscription newsletter search breadcrumb breadcrumbs pagination pager tags meta widget copyright legal hidden contentinfo complementary toolbar skip".split())
TEXT = frozenset("article content main post entry story body text".split())


@dataclass
class Page:
    tag: list[str]
    marks: list[frozenset[str]]
    parent: list[int]
    owner: list[int]  # of each block of text: its element
    text: list[str]
    linked: list[float]  # share of its characters inside links


class Scanner:
    """Where the tags of a page end. Every part of a page is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.dead: set[int] = set()  # quotes from which no tag end is found

    def end(self, at: int) -> int:
        """The closing sign of the tag that stands at `at`, -1 if there is none.

        A sign inside a quoted value does not count, unless no other is found.
        """
        if at > self.last[">"]:
            return -1
        seen, to = [], at
        while found := _STOP.search(self.page, to):
            k, sign = found.start(), found[0]
            if sign == ">":
                return k
            if k in self.dead:
                break
            seen.append(k)
            to = self.page.find(sign, k + 1) + 1 if k < self.last[sign] else k + 1
        self.dead.update(seen)
        return self.page.find(">", at)

    def tags(self) -> Iterator[tuple[int, int, str | None, bool, str]]:
        """First and last place (exclusive) of each piece of markup; name, whether it is an end tag, and attributes.

        The name is None for what stands for nothing, and empty for content that is no markup.
        """
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            name = _NAME.match(page, start + 1) or page.startswith("/", start + 1) and _NAME.match(page, start + 2)
            if name:
                stop = self.end(name.end())
                if stop < 0:
                    at = start + 1
                    continue
                at, word, closes = stop + 1, name[0].lower(), page[start + 1] == "/"
                if word in _RAW and not closes:
                    over = _RAW[word].search(page, at)
                    at, word = over.end() if over else len(page), ""
                yield start, at, word, closes, page[name.end() : stop]
                continue
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                at = stop + 3 if stop >= 0 else len(page)
            elif page[start + 1 : start + 2] in ("!", "?", "/") and start < self.last[">"]:
                at = page.find(">", start) + 1
            else:
                at = start + 1
                continue
            yield start, at, None, False, ""


def parse(page: str) -> Page:
    """Block elements and blocks of text, in page order; element 0 is the root."""
    out = Page(["root"], [frozenset()], [-1], [], [], [])
    stack: list[list] = [["root", 0, 0]]  # open blocks: name, number, links open in them
    opened: Counter = Counter()  # how many blocks of a name are open
    pieces: list[str] = []
    links = chars = in_link = 0

    def flush() -> None:
        nonlocal links, chars
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.owner.append(stack[-1][1])
                out.text.append(text)
                out.linked.append(links / max(chars, 1))
        links = chars = 0

    def close() -> str:
        nonlocal in_link
        flush()
        name, _, own = stack.pop()
        in_link -= own
        opened[name] -= 1
        return name

    def add(piece: str) -> None:
        nonlocal chars, links
        pieces.append(piece)
        size = len(piece.strip())
        chars += size
        if in_link:
            links += size

    last = 0
    for start, stop, name, closes, attributes in Scanner(page).tags():
        if start > last:
            add(page[last:start])
        last = stop
        if name is None:
            continue
        if not name:
            pieces.append(" ")
            continue
        if name == "head":  # its end tag may be missing; of what it holds only raw text shows, and that is skipped
            flush()
            continue
        if name in NEEDS_END and not closes:
            following = _NEXT[name].search(page, last)
            if name in ("math", "svg") and attributes.endswith("/") or not (following and following[1]):
                continue
        if name in INLINE:
            if name == "br" and not closes:
                pieces.append(" ")
            elif name == "a" and not closes:
                in_link += 1
                stack[-1][2] += 1
            elif name == "a" and stack[-1][2]:
                in_link -= 1
                stack[-1][2] -= 1
            continue
        flush()
        if closes:  # an end tag closes the nearest open element of its name
            while opened[name] and close() != name:
                pass
            continue
        while stack[-1][0] in CLOSED_BY_BLOCK or stack[-1][0] in SIBLINGS.get(name, ()):  # what a block's start ends
            if close() in SIBLINGS.get(name, ()):
                break
        if name in VOID:
            continue
        marks = set()
        if attributes and not attributes.isspace():
            for a in _ATTRIBUTE.finditer(attributes):
                key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if key in ("class", "id", "role"):
                    marks |= {w for w in _PART.findall(value)}
                elif key == "data-main":
                    marks.add("data-main")
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                    marks.add("hidden")
        out.tag.append(name)
        out.marks.append(frozenset(marks))
        out.parent.append(stack[-1][1])
        stack.append([name, len(out.tag) - 1, 0])
        opened[name] += 1
    if last < len(page):
        add(page[last:])
    flush()
    return out


KINDS = ("beside", "text", "other")
BESIDE_TAGS = CONTROLS | {"nav", "aside", "footer", "form"}
TEXT_TAGS = frozenset(["article", "main"])


def kind(tag: str, marks: frozenset[str]) -> int:
    """What an element's tag and attributes say of it, as a place in KINDS."""
    return 0 if tag in BESIDE_TAGS or marks & BESIDE else 1 if tag in TEXT_TAGS or marks & TEXT else 2


def element_features(tag: str, marks: frozenset[str]) -> list[str]:
    own = kind(tag, marks)
    return ["element", f"tag={tag}"] if own == 2 else ["element", f"tag={tag}", KINDS[own]]


def block_features(tag: str, text: str, linked: float) -> list[str]:
    ends = text[-1] in ".!?:;\"'”…。"
    return ["block", f"in={tag}", f"size={min(len(text).bit_length(), 10)}", f"links={0 if linked == 0 else 1 if linked < 0.5 else 2}", f"ends={ends}"]


class TreeModel:
    """Log-odds of nodes and potentials between parent and child, for each kind of parent (or one for all)."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray, root: float):
        self.weights = weights
        self.root = root
        self.pairs = np.broadcast_to(pairs, (len(KINDS), 2, 2)).tolist()  # kind, parent, child
        self.cache: dict = {}

    def node(self, features: tuple[str, ...] | list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)

    def unary(self, page: Page) -> tuple[list[float], list[float]]:
        cache = self.cache
        elements, blocks = [], []
        for tag, marks in zip(page.tag, page.marks, strict=True):
            key = (tag, marks)
            if key not in cache:
                if len(cache) > 50_000:
                    cache.clear()
                cache[key] = self.node(element_features(tag, marks))
            elements.append(cache[key])
        for at, text, linked in zip(page.owner, page.text, page.linked, strict=True):
            blocks.append(self.node(block_features(page.tag[at], text, linked)))
        return elements, blocks

    def marginals(self, page: Page) -> list[float]:
        """Probability of every block of text to be main text.

        Messages are log ratios (main text over not). Elements come after their parents, so one
        backward pass sends all upward messages and one forward pass all downward ones.
        """
        elements, blocks = self.unary(page)
        kinds = [kind(tag, marks) for tag, marks in zip(page.tag, page.marks, strict=True)]
        belief = list(elements)
        belief[0] += self.root
        up = [0.0] * len(elements)
        block_up = []
        for at, own in zip(page.owner, blocks, strict=True):
            message = self._up(own, kinds[at])
            block_up.append(message)
            belief[at] += message
        for k in range(len(elements) - 1, 0, -1):
            up[k] = self._up(belief[k], kinds[page.parent[k]])
            belief[page.parent[k]] += up[k]
        for k in range(1, len(elements)):
            belief[k] += self._down(belief[page.parent[k]] - up[k], kinds[page.parent[k]])
        out = []
        for at, own, message in zip(page.owner, blocks, block_up, strict=True):
            total = own + self._down(belief[at] - message, kinds[at])
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))))
        return out

    def _up(self, odds: float, of: int) -> float:
        (p00, p01), (p10, p11) = self.pairs[of]
        e = math.exp(max(-30.0, min(30.0, odds)))
        return math.log((p10 + p11 * e) / (p00 + p01 * e))

    def _down(self, odds: float, of: int) -> float:
        (p00, p01), (p10, p11) = self.pairs[of]
        e = math.exp(max(-30.0, min(30.0, odds)))
        return math.log((p01 + p11 * e) / (p00 + p10 * e))

    def main_text(self, page: str | None) -> str:
        found = parse(page or "")
        return "\n".join([t for t, p in zip(found.text, self.marginals(found), strict=True) if p >= 0.5])


def _message(odds: np.ndarray, both: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, both + odds) - np.logaddexp(0, odds)


class Forest:
    """Nodes of many labelled pages, level by level, so that messages of a level are sent at once."""

    def __init__(self, pages: list[str]):
        rows: list[Counter] = []
        parents: list[int] = []
        labels: list[int] = []
        kinds: list[int] = []
        for text in pages:
            page = parse(text)
            marked = [False] * len(page.tag)
            for k in range(1, len(page.tag)):
                marked[k] = marked[page.parent[k]] or "data-main" in page.marks[k]
            marks = [m - {"data-main"} for m in page.marks]
            size: defaultdict = defaultdict(Counter)
            for at, block in zip(page.owner, page.text, strict=True):
                label, k = int(marked[at]), at
                while k >= 0:
                    size[k][label] += len(block)
                    k = page.parent[k]
            labels += [int(marked[k] or size[k][1] > size[k][0]) for k in range(len(page.tag))] + [int(marked[at]) for at in page.owner]
            own = [kind(tag, m) for tag, m in zip(page.tag, marks, strict=True)]
            features = [Counter(dict.fromkeys(element_features(tag, m), 1.0)) for tag, m in zip(page.tag, marks, strict=True)]
            features += [Counter(dict.fromkeys(block_features(page.tag[at], block, linked), 1.0)) for at, block, linked in zip(page.owner, page.text, page.linked, strict=True)]
            for child, parent in enumerate(page.parent[1:] + page.owner, 1):
                features[child][f"child of {KINDS[own[parent]]}"] += 1
                features[parent][f"parent {KINDS[own[parent]]}"] += 1
            base = len(rows)
            rows += features
            parents += [-1] + [base + p for p in page.parent[1:] + page.owner]
            kinds += [0] + [own[p] for p in page.parent[1:] + page.owner]
        self.names = sorted({f for r in rows for f in r})
        place = {f: k for k, f in enumerate(self.names)}
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.array([place[f] for r in rows for f in r])
        self.value = np.array([v for r in rows for v in r.values()])
        self.parent, self.label, self.kind = np.array(parents), np.array(labels), np.array(kinds)
        depth = np.zeros(len(rows), int)
        for k, p in enumerate(parents):
            depth[k] = depth[p] + 1 if p >= 0 else 0
        self.levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]

    def gradient(self, weights: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood: labels less their expectations, by sum-product up and down."""
        belief = np.bincount(self.row, weights=self.value * weights[self.column], minlength=len(self.parent))
        up = np.zeros(len(belief))
        pair = both[self.kind]
        for nodes in reversed(self.levels):
            up[nodes] = _message(belief[nodes], pair[nodes])
            np.add.at(belief, self.parent[nodes], up[nodes])
        whole = belief.copy()
        for nodes in self.levels:
            whole[nodes] += _message(whole[self.parent[nodes]] - up[nodes], pair[nodes])
        expected = 1 / (1 + np.exp(-np.clip(whole, -30, 30)))
        edges = np.flatnonzero(self.parent >= 0)
        child, parent = belief[edges], whole[self.parent[edges]] - up[edges]
        each = np.stack([np.zeros(len(edges)), child, parent, child + parent + pair[edges]])
        on = np.exp(each[3] - np.logaddexp.reduce(each, axis=0))
        of = np.bincount(self.column, weights=self.value * (self.label - expected)[self.row], minlength=len(weights))
        of_both = np.bincount(self.kind[edges], weights=self.label[edges] * self.label[self.parent[edges]] - on, minlength=len(both))
        return of, of_both


def train(pages: list[str], steps: int = 300, rate: float = 0.1, ridge: float = 0.5) -> TreeModel:
    """Fits node weights and parent-child potentials together, by the likelihood of the pages' labels.

    The potentials of a kind of parent are log-linear in three weights: child is main text, parent is,
    both are. The likelihood is concave; steps are Adam's.
    """
    forest = Forest(pages)
    n = len(forest.names)
    at, first, second = np.zeros(n + len(KINDS)), np.zeros(n + len(KINDS)), np.zeros(n + len(KINDS))
    for t in range(1, steps + 1):
        g = np.concatenate(forest.gradient(at[:n], at[n:])) - ridge * at
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        at += rate * (1 - t / (steps + 1)) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weights = dict(zip(forest.names, at[:n].tolist(), strict=True))
    pairs = np.ones((len(KINDS), 2, 2))
    for k, name in enumerate(KINDS):
        child, parent = weights.pop(f"child of {name}", 0.0), weights.pop(f"parent {name}", 0.0)
        pairs[k] = np.exp([[0.0, child], [parent, child + parent + at[n + k]]])
    return TreeModel(weights, pairs, 0.0)


_MODEL: list[TreeModel] = []


def model() -> TreeModel:
    """The model trained on the labelled pages; once in a process, always the same."""
    if not _MODEL:
        _MODEL.append(train(labelled_pages()))
    return _MODEL[0]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", trained: TreeModel | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row. No shuffle."""
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kind = slim.schema["page_id"].dataType.simpleString()
    sent = slim.sparkSession.sparkContext.broadcast(trained or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            found = [own.main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return slim.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
