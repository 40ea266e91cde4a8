"""Main text of web pages by inference in a tree-structured graphical model.

Every element of a page has a hidden label, main text or not. Its potential comes from what can be seen of it (tag, names
in class, id and role, amount of text, share of links); a potential joins each element to its parent. Both are counts from
labelled pages. Sum-product message passing, upward and then downward, gives every element's exact marginal; a block's text
is kept if its element is more likely content than not.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from colweave.llm import labelled_pages
from colweave.llm.common import with_arrow_columns

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|</?([a-zA-Z][^\s/>]*)([^>]*)>|</[^>]*>|<[/a-zA-Z!?][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
_RAW = {tag: re.compile(rf"</{tag}\b[^>]*>|\Z", re.I) for tag in ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "xmp", "noembed")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body button caption dd dt html legend li optgroup option tbody tfoot thead tr".split())
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
_KINDS = dict.fromkeys("article main section div body html td table tbody tr center form fieldset header footer aside nav".split(), 0)
_KINDS |= dict.fromkeys("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt figcaption ul ol dl figure".split(), 1)


@dataclass
class Page:
    """Elements in page order, parents before children, and the blocks of text with the element that holds each."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    attributes: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    blocks: list[tuple[int, str]] = field(default_factory=list)
    text: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])


def parse(html: str) -> Page:
    """The element tree, with the usual repairs: implied ends, stray ends, open ends; scripts and the like hold no text.

    Text of one element up to the next start or end of a block is a block; text in inline elements belongs to the nearest
    block around it. Character references are decoded and white space is one space.
    """
    page = Page()
    stack, owner, run = [0], [0], []
    tags, parents = page.tags, page.parents

    def flush() -> None:
        if run:
            text = " ".join(unescape("".join(run)).split())
            run.clear()
            if text:
                page.blocks.append((owner[-1], text))

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            if node == owner[-1] and len(owner) > 1:
                flush()
                owner.pop()

    def add_text(piece: str) -> None:
        run.append(piece)
        size = len(piece.strip())
        page.text[stack[-1]] += size
        if size and any(tags[i] == "a" for i in stack[-4:]):
            page.linked[stack[-1]] += size

    at, end = 0, len(html)
    while at < end:
        found = _TOKEN.search(html, at)
        if found is None:
            add_text(html[at:])
            break
        if found.start() > at:
            add_text(html[at : found.start()])
        at = found.end()
        raw = found[1] or found[3]
        if not raw:
            continue
        tag = raw.lower()
        if html.startswith("</", found.start()):
            for depth in range(len(stack) - 1, 0, -1):
                if tags[stack[depth]] == tag:
                    close(depth)
                    break
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in _RAW:
            at = _RAW[tag].search(html, at).end()
            continue
        if tag in ("html", "head", "body") and tag in [tags[i] for i in stack]:
            continue
        if tag == "body" and len(stack) > 1 and tags[stack[1]] == "head":
            close(1)
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if tags[stack[depth]] == "p":
                    close(depth)
                    break
                if tags[stack[depth]] in BLOCK:
                    break
        if tag in SIBLINGS:
            ends, scope = SIBLINGS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if tags[stack[depth]] in ends:
                    close(depth)
                if depth >= len(stack):
                    continue
                if tags[stack[depth]] in scope:
                    break
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in ("td", "th"):
            run.append(" ")
        node = len(tags)
        tags.append(tag)
        page.attributes.append(found[2] or found[4] or "")
        parents.append(stack[-1])
        page.text.append(0)
        page.linked.append(0)
        if tag in BLOCK or tag in ("td", "th"):
            flush()
            owner.append(node)
        stack.append(node)
    close(0)
    flush()
    return page


def _bucket(size: int) -> int:
    return min(12, size.bit_length())


def features(page: Page) -> list[list[str]]:
    """What can be seen of every element: tag, names, amount of text below it and share of it in links."""
    text, linked, parents = list(page.text), list(page.linked), page.parents
    for i in range(len(parents) - 1, 0, -1):
        text[parents[i]] += text[i]
        linked[parents[i]] += linked[i]
    out = []
    for i, tag in enumerate(page.tags):
        seen = ["t:" + tag, f"s:{_kind(tag)}:{_bucket(text[i])}", f"l:{_kind(tag)}:{4 * linked[i] // text[i] if text[i] else 'none'}"]
        raw = page.attributes[i]
        if raw:
            names = set()
            for m in _ATTRIBUTE.finditer(raw):
                if m[1].lower() != "data-y":
                    names.update(_NAME.findall((m[2] or m[3] or m[4] or "").lower()))
            seen += ["n:" + n for n in sorted(names)]
        out.append(seen)
    return out


def _kind(tag: str) -> int:
    return _KINDS.get(tag, 2)


@dataclass
class Model:
    """prior: P(root is content). moves: kind of child -> parent label -> P(child is content). evidence: likelihood ratios."""

    prior: float
    moves: dict[int, tuple[float, float]]
    evidence: dict[str, float]


def train(pages: list[str] | None = None, smoothing: float = 0.5, name_smoothing: float = 0.001) -> Model:
    """Potentials from labelled pages (HTML with data-y attributes); by default from the layouts of this package.

    Names tell more than their counts do, since a page's author chose them to: they are smoothed less.
    """
    pages = labelled_pages.pages() if pages is None else pages
    move: dict[tuple[int, int], list[float]] = defaultdict(lambda: [smoothing, smoothing])
    seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    totals: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    values: dict[str, set[str]] = defaultdict(set)
    roots = [1.0, 1.0]
    for html in pages:
        page = parse(html)
        labels: list[int] = []
        for i, raw in enumerate(page.attributes):
            own = [m[2] or m[3] or m[4] for m in _ATTRIBUTE.finditer(raw) if m[1].lower() == "data-y"]
            labels.append(int(own[0]) if own else labels[page.parents[i]] if i else 0)
        for i, found in enumerate(features(page)):
            y = labels[i]
            if i:
                move[_kind(page.tags[i]), labels[page.parents[i]]][y] += 1
            else:
                roots[y] += 1
            for f in found:
                group = f.rpartition(":")[0] if f[0] in "sl" else f[0]
                seen[f][y] += 1
                totals[group][y] += 1
                values[group].add(f)
    evidence = {}
    for f, n in seen.items():
        group = f.rpartition(":")[0] if f[0] in "sl" else f[0]
        size = len(values[group])
        add = name_smoothing if group == "n" else smoothing
        p = [(n[y] + add) / (totals[group][y] + add * size) for y in (0, 1)]
        evidence[f] = math.log(p[1] / p[0])
    moves = {k: tuple(move[k, y][1] / sum(move[k, y]) for y in (0, 1)) for k in (0, 1, 2)}
    return Model(roots[1] / sum(roots), moves, evidence)


def marginals(page: Page, model: Model) -> list[float]:
    """P(content) of every element: messages from the leaves to the root, then from the root to the leaves."""
    get, moves, parents = model.evidence.get, model.moves, page.parents
    size = len(parents)
    kinds = [_kind(t) for t in page.tags]
    no, yes = [1.0] * size, [1.0] * size
    for i, found in enumerate(features(page)):
        # Bounded, so that products of a page of any size stay within a float's range after scaling.
        yes[i] = math.exp(max(-60.0, min(60.0, sum(get(f, 0.0) for f in found))))
    up = [(1.0, 1.0)] * size
    for i in range(size - 1, 0, -1):
        total = no[i] + yes[i]
        a, b = no[i] / total, yes[i] / total
        p0, p1 = moves[kinds[i]]
        up[i] = m0, m1 = (1 - p0) * a + p0 * b, (1 - p1) * a + p1 * b
        parent = parents[i]
        no[parent] *= m0
        yes[parent] *= m1
        scale = no[parent] + yes[parent]
        if not 1e-100 < scale < 1e100:
            no[parent] /= scale
            yes[parent] /= scale
    out = [0.0] * size
    n, y = no[0] * (1 - model.prior), yes[0] * model.prior
    out[0] = y / (n + y)
    for i in range(1, size):
        parent = parents[i]
        m0, m1 = up[i]
        # The parent's belief without what this child told it.
        b0, b1 = (1 - out[parent]) / max(m0, 1e-300), out[parent] / max(m1, 1e-300)
        p0, p1 = moves[kinds[i]]
        n = no[i] * (b0 * (1 - p0) + b1 * (1 - p1))
        y = yes[i] * (b0 * p0 + b1 * p1)
        out[i] = y / (n + y) if n + y > 0 else 0.5
    return out


def main_text(html: str | None, model: Model) -> str:
    """Blocks of content elements in page order, joined by an empty line; empty for null."""
    if not html:
        return ""
    page = parse(html)
    belief = marginals(page, model)
    return "\n\n".join(text for node, text in page.blocks if belief[node] > 0.5)


def extract(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """Adds text and n_chars (code points) to all columns; null, empty and textless pages get an empty text."""
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        texts = [main_text(h, held.value) for h in columns[0].to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return with_arrow_columns(pages, [html], {"text": "string", "n_chars": "bigint"}, run, rows=256)
