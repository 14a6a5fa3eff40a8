"""Main text of HTML pages by tag-path ratios.

A page is read once into blocks: runs of text that no block-level tag interrupts, each
with its root-to-leaf path of tags and classes. By path, text length and punctuation are
summed: the text ratio is characters a block, the punctuation ratio marks a block, link
text counting against both. Either ratio is brought to 0..1, their product, weighted by the path's
share of text, smoothed over the blocks in page order, near blocks counting by how much of their path they share, and
averaged by path. That is fused with what a block's elements tell: a factor for the tags of
menus, headers, footers, sidebars and forms, a weaker one for names (class, id, role) of
such, for adverts and comments, and one for standing outside the article or main elements.
The more of the page's text a header, form or named frame holds, the less its factor counts,
and a name around the only article doesn't count. A block passes whose fused score reaches
PASS of the page's best.

Every block that passes is returned, with what else stands in the content nodes: the article
or main elements around such blocks; without these the smallest element that holds the
surest blocks and the top headings. There, blocks below the threshold are the article's
short parts, such as titles, unless an element's factor speaks against them. All in page
order and unshortened.

Null and empty pages, and pages without text, give the empty text. Unclosed and
stray tags, comments, quotes and character references are read as far as they go. Pages
are read one by one: rows that repeat an id or a page get the same text each, and a very
long page takes memory in proportion to its own length, some 40 times.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._spark import table

#: Share of the page's best score that a block must reach, and what counts as the least best.
PASS = 0.5
LEAST = 1 / 40
#: Characters and marks a block at which a ratio is half of what it can be.
CHARS, MARKS = 120.0, 1.0
MASS = 0.25
#: Score of a block without any text ratio.
FLOOR = 0.05
#: Factors of tags and names of what isn't the article, and of what stands outside articles.
BY_TAG, BY_NAME, OUTSIDE = 0.01, 0.1, 0.2
#: An element with a factor below speaks against its blocks.
AGAINST = 0.5
#: Part of all content text that the element must hold which the content node is looked for around.
HELD = 0.85
SMOOTHING = (4.0, 2.0, 1.0)
#: Tags from a leaf on among which a common path is looked for.
CLIMB = 64

_TOKEN = re.compile(r"""<!--(?:.*?-->|>|->|.*\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|</?[a-zA-Z][^>]*+\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?""")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: Their text isn't the page's: scripts, styles, controls and what else is drawn in another way.
_SILENT = frozenset("script style noscript template select button iframe svg head title object canvas textarea noembed noframes xmp audio video".split())
#: Menus, footers and sidebars, whatever they hold; headers and forms may be around all of a page.
_NEVER = frozenset("nav aside footer menu".split())
_MAYBE = frozenset("form dialog".split())
#: Parts of class, id and role names of what isn't the article: frames of the page, and what is put into or after texts.
_FRAME = re.compile(r"sidebar\w*|side|aside|menu\w*|nav|navbar|navigation|breadcrumb\w*|footer|foot|header|masthead|notice\w*|alert|popup\w*|modal\w*|overlay|signup|login|widget\w*|toolbar|pagination|pager|complementary|contentinfo|search", re.I)
_INSERT = re.compile(r"ad|ads|adv|advert|adverts|advertis\w*|adsense|adsbygoogle|sponsor\w*|promo\w*|banner\w*|comment|comments|commentlist|disqus\w*|respond|replies|reply|cookie\w*|consent|newsletter\w*|subscri\w*|related\w*|recommend\w*|share|sharing|social\w*", re.I)
#: Parts that leave such a name what it is; others, as in has-sidebar or related-work, make it another.
_PLAIN = re.compile(
    r"\d+(?:x\d+)?|area|article|articles|bar|block|bottom|box|button|buttons|container|dropdown|entry|fixed|form|global|google|group|inline|inner|item|items|left|link|links|list|local|main|mobile|module|outer|page|policy|post|posts|primary|right|secondary|section|site|slot|sticky|tertiary|thread|title|top|unit|wrap|wrapper|zone", re.I
)
#: A start tag ends open elements of the second kind, not beyond one of the third.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_CLOSES_P = _BLOCK - {"br", "button", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "col", "colgroup", "option", "optgroup", "noscript", "template", "title", "textarea", "select", "legend"}
_P_SCOPE = frozenset("button td th caption table html template object".split())
#: Elements that are part of what stands around them.
_PART = frozenset("p b i em strong span a h1 h2 h3 h4 li td blockquote ul ol dl dt dd pre code table thead tbody section".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Marks that end a part of a sentence, not those in figures and addresses.
_PUNCTUATION = re.compile(r"[.,;:!?…](?=\s|$)|[。、，；：！？]")


@lru_cache(1 << 14)
def _kind(name: str, inner: bool) -> int:
    """1 for the name of a frame, 2 for that of an insert, else 0. inner: in an article. Headers of articles are their own."""
    parts = [x for x in re.split("[-_]+", name) if x]
    low = {x.lower() for x in parts}
    if low & {"header", "masthead"} and (inner or low & {"article", "entry", "post", "story"}):
        return 0
    kinds = [2 if _INSERT.fullmatch(x) else 1 if _FRAME.fullmatch(x) else 0 for x in parts]
    return max(kinds, default=0) if all(k or _PLAIN.fullmatch(x) for k, x in zip(kinds, parts)) else 0


@dataclass
class Page:
    """Blocks (element, text, characters in links), and elements by number, children after their parents.

    path: of the element; above and depth: by path, the path without its last tag and its tags. speaks: 1 and 2 for
    names of frames and inserts, 3 for headers and forms, 4 for menus, footers and sidebars. weight: characters
    outside links.
    """

    blocks: list[tuple[int, str, int]]
    parent: list[int]
    tag: list[str]
    path: list[int]
    speaks: list[int]
    weight: list[int]
    above: list[int]
    depth: list[int]


def read(page: str) -> Page:
    out: list[tuple[int, str, int]] = []
    parent, tag, path, speaks, weight, above, depth = [-1], [""], [0], [0], [0], [-1], [0]
    known: dict[tuple[int, str, int], int] = {}
    stack: list[tuple[str, int]] = [("", 0)]
    open_: dict[str, int] = defaultdict(int)
    text: list[str] = []
    owner = linked = silent = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((owner, joined, linked))
            text.clear()
        linked = 0

    def close(k: int) -> None:
        """Ends the open elements from place k on."""
        nonlocal silent
        for name, _ in stack[k:]:
            if name in _BLOCK:
                flush()
            open_[name] -= 1
            silent -= name in _SILENT
        del stack[k:]

    def last(names: tuple[str, ...] | frozenset[str], scope: tuple[str, ...] | frozenset[str]) -> int:
        if any(open_[n] for n in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    return k
                if stack[k][0] in scope:
                    break
        return 0

    def add(piece: str) -> None:
        nonlocal owner, linked
        if not piece or silent:
            return
        k = stack[-1][1]
        if not open_["a"]:
            weight[k] += len(piece.strip())
        if not text:
            owner = k
        text.append(piece)
        if open_["a"]:
            linked += len(piece)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m.group(2) or m.group(5)
        if name is None:
            continue
        name, closing, rest = name.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
        if closing:
            if name == "p" or name not in _VOID:
                if k := last((name,), ("table", "td", "th") if name not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html", "article", "main", "div", "section") else ()):
                    close(k)
            elif name == "br":
                flush()
            continue
        if name in _BLOCK:
            flush()
        if name in _CLOSES_P and (k := last(("p",), _P_SCOPE)):
            close(k)
        if name in _IMPLIED and (k := last(*_IMPLIED[name])):
            close(k)
        if name == "a" and (k := last(("a",), _P_SCOPE | {"article", "main", "div", "section"})):
            close(k)
        if name in _VOID or rest.endswith("/") and name in ("svg", "path"):
            continue
        up = stack[-1][1]
        attributes = [(a[1].lower(), (a[2] or a[3] or a[4] or "").split()) for a in _ATTRIBUTE.finditer(rest)] if rest else []
        attributes = [(a, v) for a, v in attributes if a in ("class", "id", "role")]
        inner = open_["article"] or open_["main"]
        kind = 4 if name in _NEVER else 3 if name in _MAYBE or (name == "header" and not inner) else 0
        if attributes and not kind and name not in ("html", "body", "main", "article"):
            kind = max((_kind(x, bool(inner)) for a, v in attributes if a != "id" or name not in _HEADING for x in v), default=0)
        classes = [x for a, v in attributes if a == "class" for x in v]
        label = (path[up], f"{name}.{classes[0]}" if classes else name, kind)
        if label not in known:
            known[label] = len(above)
            above.append(path[up])
            depth.append(depth[path[up]] + 1)
        parent.append(up)
        tag.append(name)
        path.append(known[label])
        speaks.append(kind)
        weight.append(0)
        stack.append((name, len(parent) - 1))
        open_[name] += 1
        silent += name in _SILENT
        if name in _RAW:
            m = _RAW[name].search(page, at)
            at = end if m is None else m.start()
    close(1)
    flush()
    return Page(out, parent, tag, path, speaks, weight, above, depth)


def ratios(p: Page) -> dict[int, float]:
    """By path, text and punctuation a block, either in 0..1, and the path's text as a part of the largest path's to the power MASS, multiplied."""
    totals: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
    for owner, text, linked in p.blocks:
        t = totals[p.path[owner]]
        t[0] += max(0, len(text) - 2 * linked)
        t[1] += len(_PUNCTUATION.findall(text)) if 2 * linked < len(text) else 0
        t[2] += 1
    most = max(1, max(chars for chars, _, _ in totals.values()))
    return {k: FLOOR + (1 - FLOOR) * chars / (chars + CHARS * n) * (marks + MARKS * n / 4) / (marks + MARKS * n) * (chars / most) ** MASS for k, (chars, marks, n) in totals.items()}


def alike(p: Page, a: int, b: int) -> float:
    """The square of the share of the longer path that two paths have in common from the root."""
    most, steps = max(p.depth[a], p.depth[b]), 0
    while a != b and steps < CLIMB:
        if p.depth[a] >= p.depth[b]:
            a = p.above[a]
        else:
            b = p.above[b]
        steps += 1
    return (p.depth[a] / most) ** 2 if a == b and most else float(a == b)


def smoothed(p: Page, ratio: dict[int, float]) -> dict[int, float]:
    """By path, the mean over its blocks of ratios smoothed over near blocks."""
    at = np.array([p.path[owner] for owner, _, _ in p.blocks])
    own = np.array([ratio[k] for k in at.tolist()])
    total, weight = own * SMOOTHING[0], np.full(len(own), SMOOTHING[0])
    known: dict[tuple[int, int], float] = {}
    for step, w in enumerate(SMOOTHING[1:], 1):
        near = np.ones(max(0, len(at) - step))
        for i in np.flatnonzero(at[step:] != at[:-step]).tolist():
            pair = int(at[i]), int(at[i + step])
            if pair not in known:
                known[pair] = alike(p, *pair)
            near[i] = known[pair]
        near *= w
        total[step:] += near * own[:-step]
        weight[step:] += near
        total[:-step] += near * own[step:]
        weight[:-step] += near
    smooth = total / weight
    keys, place = np.unique(at, return_inverse=True)
    return dict(zip(keys.tolist(), (np.bincount(place, smooth) / np.bincount(place)).tolist()))


def factors(p: Page) -> tuple[list[float], list[int]]:
    """By element, what its tags and names, and those around it, make of a score; and the outermost article or main around it, or 0."""
    n = len(p.parent)
    under, around = p.weight[:], [0] * n
    free = False
    clear = [True] * n
    for k in range(1, n):
        clear[k] = clear[p.parent[k]] and not p.speaks[k]
    for k in range(n - 1, 0, -1):
        if p.tag[k] in ("article", "main") and under[k]:
            around[k] |= 1 if p.tag[k] == "article" else 2
            free |= clear[k]
        under[p.parent[k]] += under[k]
        around[p.parent[k]] |= around[k]
    factor, article = [1.0] * n, [0] * n
    for k in range(1, n):
        kind, base = p.speaks[k], BY_TAG if p.speaks[k] > 2 else BY_NAME
        own = base if kind else 1.0
        if kind in (1, 2) and not free and (around[k] & 2 or kind == 1 and around[k]):
            own = 1.0
        elif kind in (1, 3) and under[0]:
            own = base + (1 - base) * (under[k] / under[0]) ** 8
        factor[k] = min(own, factor[p.parent[k]])
        article[k] = article[p.parent[k]] or (k if p.tag[k] in ("article", "main") and factor[k] >= AGAINST and under[k] else 0)
    return factor, article


def scores(p: Page) -> tuple[list[float], list[float], list[int]]:
    """By block its fused score; and factors()."""
    factor, article = factors(p)
    smooth, outside = smoothed(p, ratios(p)), OUTSIDE if any(article) else 1.0
    return [smooth[p.path[k]] * factor[k] * (1.0 if article[k] else outside) for k, _, _ in p.blocks], factor, article


def extract(page: str, share: float = PASS) -> str:
    p = read(page)
    if not p.blocks:
        return ""
    score, factor, article = scores(p)
    limit = share * max(LEAST, max(score))
    passes = [x >= limit for x in score]
    if not any(passes):
        return ""
    if any(article):
        node = {article[k] for (k, _, _), ok in zip(p.blocks, passes) if ok and article[k]}
        added = lambda k: article[k] in node
    else:
        added = _around(p, passes, factor)
    return "\n".join(text for (k, text, _), ok in zip(p.blocks, passes) if ok or factor[k] >= AGAINST and added(k))


def _around(p: Page, passes: list[bool], factor: list[float]) -> Callable[[int], bool]:
    """Whether an element is of the content node of a page without articles."""
    n = len(p.parent)
    held, sure, text, links = [0] * n, [0] * n, [0] * n, [0] * n
    for (k, words, linked), ok in zip(p.blocks, passes):
        held[k] += max(1, len(words) - 2 * linked) if ok else 0
        sure[k] += ok or p.tag[k] == "h1" and factor[k] >= AGAINST
        text[k] += len(words)
        links[k] += linked
    for k in range(n - 1, 0, -1):
        for x in (held, sure, text, links):
            x[p.parent[k]] += x[k]
    node = max(k for k in range(n) if sure[k] == sure[0] and held[k] >= HELD * held[0])
    while node and p.tag[node] in _PART:
        node = p.parent[node]
    whole = p.tag[node] in ("", "html", "body")
    inside = [False] * n
    for k in range(n):
        if k == node:
            inside[k] = True
        elif p.parent[k] == node:  # of a page's body only what reads like an article's part
            inside[k] = held[k] > 0 or 2 * links[k] < text[k] and (not whole or p.tag[k] in _PART or p.tag[k] in _HEADING)
        elif k:
            inside[k] = inside[p.parent[k]]
    return lambda k: inside[k]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in T.slices(b.column("html")):
            texts = [extract(s.text(i).decode()) for i in range(s.rows)]
            rest = [b.column(c).slice(s.first, s.rows) for c in ("page_id", "url")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
