"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A logistic classifier over each block's markup and wording gives the log odds that it is
content; those are the capacities to the two terminals. Neighbouring blocks are joined by edges that weigh more the nearer they
are in the document tree, and so are blocks of one container that something else interrupts. A maximum flow finds the
labels of least total cost. Weights and edge capacities are fitted on the labelled pages of ``training_pages``.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .min_cut import min_cut

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I | re.S)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_WORDS = re.compile(r"[a-z]+")

# Elements by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes".split())
NO_TEXT = set("head script style noscript template svg math iframe object audio video canvas select option datalist button title textarea".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - set("body html head caption tbody td tfoot th thead tr option optgroup legend summary".split())
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS_AT = set("ul ol dl table select menu article section div body".split())
BOILER_TAGS = set("nav footer aside form menu dialog fieldset label".split())
# Words of class, id and role. Weak ones count only where none of the good ones stands beside them.
BOILER_NAMES = set("ad ads advert advertisement adverts advertising adsense adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar comment comments commentlist disqus replies reply respond reactions share sharing social related recommended recommendations pagination pager search skip toolbar masthead contentinfo complementary".split())
WEAK_NAMES = set("header footer head foot top bottom side notice notices notification alert widget tags tag meta author byline links copyright legal disclaimer info".split())
GOOD_NAMES = set("article entry post content story main body text page".split())

#: Steps in the document tree up to which blocks are near, and close.
NEAR_STEPS, CLOSE_STEPS = 2, 4

_ARTICLE, _MAIN, _BAD_TAG, _BAD_NAME, _UNSEEN, _SILENT, _LINK, _HEAD = (1 << k for k in range(8))


def _flags(tag: str, attributes: str, above: int) -> int:
    out = above & ~_HEAD if tag in BLOCK else above
    if tag in NO_TEXT:
        return out | _SILENT
    if tag == "article":
        out |= _ARTICLE
    elif tag == "main":
        out |= _MAIN
    elif tag in BOILER_TAGS or tag == "header" and not above & (_ARTICLE | _MAIN):
        out |= _BAD_TAG
    elif tag == "a":
        out |= _LINK
    elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
        out |= _HEAD
    if attributes and tag not in ("body", "html"):
        if "=" in attributes:
            names = {w for m in _NAMES.finditer(attributes) for w in _WORDS.findall((m[2] or m[3] or m[4] or "").lower())}
            if names & BOILER_NAMES or names & WEAK_NAMES and not names & GOOD_NAMES and tag != "article":
                out |= _BAD_NAME
        if "hid" in attributes or "none" in attributes:
            out |= _UNSEEN * bool(_HIDDEN.search(attributes))
    return out


class Node:
    """A block element: what it stands in, and how deep."""

    __slots__ = ("parent", "depth")

    def __init__(self, parent: Node | None):
        self.parent, self.depth = parent, parent.depth + 1 if parent else 0


Block = tuple[str, int, float, Node]


def blocks(page: str) -> list[Block]:
    """(text, flags, share of linked characters, innermost open block element) of each text block.

    Character references are decoded and white space is one space. Unclosed and stray tags are read as browsers do in the main:
    a block start ends an open paragraph, an item ends the item before it, an end tag closes what is open inside it.
    """
    found: list[Block] = []
    stack: list[tuple[str, int, Node]] = [("", 0, Node(None))]
    open_: dict[str, int] = {}
    parts: list[str] = []
    linked = total = 0
    state: tuple[int, Node] | None = None

    def flush() -> None:
        nonlocal linked, total, state
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text and state:
                found.append((text, state[0], linked / total if total else 0.0, state[1]))
            parts.clear()
        linked, total, state = 0, 0, None

    def close(depth: int) -> None:
        while len(stack) > depth:
            open_[stack.pop()[0]] -= 1

    def say(text: str) -> None:
        nonlocal linked, total, state
        flags = stack[-1][1]
        if flags & _SILENT:
            return
        parts.append(text)
        if not text.isspace():
            n = len(text)
            total += n
            linked += n * bool(flags & _LINK)
            state = state or (flags & ~_LINK, stack[-1][2])

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        block = tag in BLOCK
        if m[1]:
            if block:
                flush()
            if open_.get(tag):
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag == "br" or tag == "hr":
            parts.append("\n")
        if block:
            flush()
            if tag in ENDS_P and open_.get("p"):
                k = len(stack) - 1
                while k and stack[k][0] != "p" and stack[k][0] not in STOPS_AT:
                    k -= 1
                if stack[k][0] == "p":
                    close(k)
            ended = SAME_ENDS.get(tag)
            if ended and any(open_.get(x) for x in ended):
                k = len(stack) - 1
                while k and stack[k][0] not in ended and stack[k][0] not in STOPS_AT:
                    k -= 1
                if stack[k][0] in ended:
                    close(k)
        if tag in VOID:
            continue
        _, above, node = stack[-1]
        if block:
            node = Node(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            if not end:
                break
        stack.append((tag, _flags(tag, m[3], above), node))
        open_[tag] = open_.get(tag, 0) + 1
    if at < len(page):
        say(page[at:])
    flush()
    return found


# Wording of notices; it counts in blocks of few words.
_NOTICE = re.compile(r"©|\bcopyright\b|\ball rights reserved\b|\bcookies?\b|\bprivacy policy\b|\bterms of (?:use|service)\b", re.I)
NOTICE_WORDS = 25

_ENDS = tuple(".!?…:;\"'”»)")


def features(found: list[Block]) -> np.ndarray:
    """What the classifier sees of each block: [blocks, FEATURES]."""
    good = [b for b in found if not b[1] & (_BAD_TAG | _BAD_NAME | _UNSEEN)]
    has_article, has_main = any(b[1] & _ARTICLE for b in good), any(b[1] & _MAIN for b in good)
    out = np.zeros((len(found), FEATURES))
    for row, (text, flags, linked, _) in zip(out, found, strict=True):
        long, ends = min(text.count(" ") + 1, 100) ** 0.5 / 5, float(text.endswith(_ENDS))
        inside = bool(flags & _ARTICLE) if has_article else bool(flags & _MAIN) if has_main else None
        bad = (bool(flags & _BAD_TAG), bool(flags & _BAD_NAME), bool(flags & _UNSEEN))
        # Length, end and heading speak for text only where nothing in the markup says more.
        free = inside is None and not any(bad)
        notice = text.count(" ") < NOTICE_WORDS and inside is not True and bool(_NOTICE.search(text))
        row[:] = (1, notice, long * free, ends * free, linked, bool(flags & _HEAD) * free, inside is True, inside is False, has_main and not flags & _MAIN, any(bad), *bad)
    return out


FEATURES = 13


def _steps(a: Node, b: Node) -> int:
    """From one element to the other through the tree. Neighbours on a page are as far apart as tags stand between them, so all
    the steps of a page are no more than its tags."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a, steps = a.parent, steps + 1
        else:
            b, steps = b.parent, steps + 1
    return steps


def _pairs(found: list[Block]) -> Iterator[tuple[int, int, int]]:
    """(block, block, kind) of the edges; kinds: near, close, far, and in one container with something between."""
    last: dict[Node, int] = {}
    for i, (_, _, _, node) in enumerate(found):
        if i:
            steps = _steps(found[i - 1][3], node)
            yield i - 1, i, 0 if steps <= NEAR_STEPS else 1 if steps <= CLOSE_STEPS else 2
        container = node.parent or node
        before = last.get(container)
        if before is not None and before < i - 1:
            yield before, i, 3
        last[container] = i


@dataclass(frozen=True)
class Costs:
    """Weights of the features, and capacities of the four kinds of edges, in hundredths of log odds."""

    weights: tuple[float, ...]
    edges: tuple[int, int, int, int]


def training_pages(n: int = 250, seed: int = 20240101) -> list[str]:
    """Made-up pages to learn from. Words of content begin with c, others with b; the classifier never looks at letters.

    Layouts: an article, a main part, an article in a main part, a named division, divisions without names. The content is headings,
    paragraphs of 1 to 90 words, lists, quotations and tables. Boilerplate stands around it and in it: menus, headers, footers,
    sidebars, notices, adverts, forms, comments, and, for half of the pages, some of these without any telling name.
    """
    r = random.Random(seed)

    def words(kind: str, low: int, high: int, end: str = "") -> str:
        return " ".join(kind + "".join(r.choice("aeioulnrst") for _ in range(r.randint(1, 8))) for _ in range(r.randint(low, high))) + end

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li><a href=#>{words('b', 1, 3)}</a></li>" for _ in range(n)) + "</ul>"

    def content() -> str:
        short, long = lambda: f"<p>{words('c', 1, 9, r.choice(['.', '.', '!', '']))}</p>", lambda: f"<p>{words('c', 10, 90, '.')}</p>"
        kinds = [long, long, long, short, lambda: f"<h2>{words('c', 1, 7)}</h2>", lambda: "<ul>" + "".join(f"<li>{words('c', 1, 14, r.choice(['', '.']))}</li>" for _ in range(r.randint(1, 6))) + "</ul>"]
        kinds += [lambda: f"<blockquote>{words('c', 5, 40, '.')}</blockquote>", lambda: f"<table><tr><td>{words('c', 1, 4)}</td><td>{words('c', 1, 4)}</td></tr></table>", lambda: f"<p>{words('c', 4, 30)} <a href=#>{words('c', 1, 3)}</a> {words('c', 1, 20, '.')}</p>"]
        return r.choice(kinds)()

    def inside() -> str:
        kinds = [f"<aside><p>{words('b', 4, 40, '.')}</p></aside>", f"<div class=ad>{words('b', 3, 30, '.')}</div>", f'<div class="share-buttons">{links(3)}</div>', f"<p class=byline>{words('b', 2, 6)}</p>"]
        kinds += [f'<section id=comments><p>{words("b", 3, 60, ".")}</p><article class=comment><p>{words("b", 3, 60, ".")}</p></article></section>', f'<div class="newsletter">{words("b", 5, 25, ".")}<form><label>{words("b", 1, 3)}</label></form></div>']
        return r.choice(kinds)

    def around() -> str:
        kinds = [f"<nav>{links(r.randint(2, 9))}</nav>", f"<header><h1>{words('b', 1, 4)}</h1>{links(4)}</header>", f"<footer><p>{words('b', 3, 30, '.')}</p></footer>", f'<div class="sidebar"><h3>{words("b", 1, 4)}</h3><p>{words("b", 5, 60, ".")}</p></div>']
        kinds += [f'<div id="cookie-notice">{words("b", 5, 40, ".")}</div>', f"<form><p>{words('b', 2, 20, '.')}</p></form>", f"<div style='display:none'><p>{words('b', 2, 40, '.')}</p></div>", f"<div class=advert><p>{words('b', 3, 40, '.')}</p></div>"]
        bare = [f"<div>© {words('b', 1, 9, r.choice(['.', '']))}</div>", f"<p>{words('b', 1, 9)}. All rights reserved.</p>", f"<div>{links(r.randint(2, 7))}</div>", f"<div>{words('b', 2, 9)}</div>", f"<div><p><a href=#>{words('b', 2, 8)}</a></p></div>", f"<div><h3>{words('b', 1, 3)}</h3>{links(3)}</div>"]
        return r.choice(kinds + bare * (r.random() < 0.5))

    out = []
    for _ in range(n):
        body = [f"<h1>{words('c', 1, 10)}</h1>"] + [content() for _ in range(r.randint(1, 14))]
        for _ in range(r.randint(0, 2)):
            body.insert(r.randint(1, len(body)), inside())
        text = "".join(body)
        layout = r.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class=content>{}</div>", "<div>{}</div>", "<div><div><div>{}</div></div></div>"])
        out.append("<body>" + "".join(around() for _ in range(r.randint(1, 4))) + layout.format(text) + "".join(around() for _ in range(r.randint(1, 4))) + "</body>")
    return out


@cache
def fitted(ridge: float = 1.0, rounds: int = 12) -> Costs:
    """Weights and capacities of most pseudo-likelihood over the training pages: a logistic regression (Newton's method) of each block's
    label on its features and on the labels (1 or -1) of the blocks that edges join it to, by kind."""
    seen = [blocks(page) for page in training_pages()]
    labels = [np.array([b[0][0] == "c" for b in found], float) for found in seen]
    beside = [np.zeros((len(found), 4)) for found in seen]
    for found, y, out in zip(seen, labels, beside, strict=True):
        for i, j, kind in _pairs(found):
            out[i, kind] += 2 * y[j] - 1
            out[j, kind] += 2 * y[i] - 1
    x, y = np.hstack((np.concatenate([features(found) for found in seen]), np.concatenate(beside))), np.concatenate(labels)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return Costs(tuple(100 * w[:FEATURES]), tuple(int(max(c, 0)) for c in 100 * w[FEATURES:]))


def main_text(page: str, costs: Costs | None = None) -> str:
    """The content blocks in page order, joined by a space; empty if there are none."""
    found = blocks(page)
    if not found:
        return ""
    costs = costs or fitted()
    terminal = np.rint(features(found) @ np.array(costs.weights)).astype(int).tolist()
    edges = [(i, j, costs.edges[kind]) for i, j, kind in _pairs(found)]
    content = min_cut([max(c, 0) for c in terminal], [max(-c, 0) for c in terminal], edges)
    return " ".join(b[0] for b, kept in zip(found, content, strict=True) if kept)


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with ``out_col``: the main text of the whole page. A null or empty page has an empty text.

    Rows are read on their own, so repeated rows get equal texts. A column named ``out_col`` is replaced. Pages may be of any length
    and nest at any depth: elements are linked to their parents, and nothing is cut off. Of equally good labellings the one
    with the fewest content blocks counts.
    """
    costs = fitted()
    pages = pages.drop(out_col) if out_col != html_col else pages
    at, names = pages.columns.index(html_col), [*pages.columns, out_col]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py() or "", costs) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=names)

    from pyspark.sql import types as T

    return pages.mapInArrow(of, T.StructType([*pages.schema.fields, T.StructField(out_col, T.StringType())]))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    return extract_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
