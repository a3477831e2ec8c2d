"""Main text of web pages by tag-path ratios.

A page becomes blocks: runs of text between block-level tags, each with its tag path (the
block-level elements from the root, classes included). Blocks of one path share their statistics:
text length and punctuation a block, and the share of text in links. Both ratios are smoothed over
the page's blocks, near blocks of similar paths counting most, and fused to their geometric mean,
less what links take. Blocks whose fused ratio reaches a share of the page's mean are content.

The paths' names take part in the fusion: a path through an element that says it is a menu, a
sidebar, an advert, a form, reader comments and so on has ratio 0. What the content nodes have in
common, an article element or the smallest element that holds nearly all of them, is the article;
everything in it goes out whole, short lines and headings too.

Pages are independent: a task streams them, nothing moves between tasks, and the work and memory
for a page are linear in its length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import textkit as K

#: HTML's elements that begin a block, and those whose content is not text of the page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag ends, if it is open below the boundary named.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements and roles that are no part of an article wherever they stand.
ASIDE = frozenset("nav aside footer menu dialog button select template svg canvas object audio video search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that say the same: whole words, and beginnings of words.
WORDS = frozenset("ad ads adv nav menu foot share sharing social rail aside toolbar topbar promo promos promotion widget widgets pager pagination search login signin signup register form overlay toast gdpr ccpa notice notices notification notifications alert alerts banner banners respond replies reply tags tagcloud byline teaser teasers outbrain taboola copyright skip toc side sidecol popular trending responses reactions disclaimer privacy legal imprint menus menubar topmenu topnav sidenav mainnav subnav adbox adslot adunit adsense adwrap".split())
BEGINNINGS = ("advert", "breadcrumb", "comment", "consent", "cookie", "disqus", "footer", "header", "masthead", "modal", "navbar", "navigation", "newsletter", "paywall", "popup", "recommend", "related", "sidebar", "sponsor", "subscri", "submenu", "feedback", "discussion")
#: Words that make such a name harmless: it speaks of the article itself, or of what the page has.
HARMLESS = frozenset("article entry post story content main has with no without".split())

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS = re.compile(r"\d+")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MARKS = re.compile(r"[.,;:!?…。，、；：！？¿¡]")

#: Elements whose text belongs to an article that they begin or end.
PROSE = frozenset("p li dd dt td th pre blockquote figcaption caption".split())

#: Blocks on either side that smooth a block, the share of the mean that content reaches, and the share
#: of the content that the element holds in which all of it is sought.
REACH, SHARE, WHOLE = 3, 0.4, 0.9
_GAUSS = [math.exp(-(d * d) / 4.5) for d in range(REACH + 1)]


def _says_aside(names: str) -> bool:
    """Whether class and id names say that an element is no part of the article."""
    for name in names.split():
        words = [w.lower() for w in _NAME_WORD.findall(name)]
        if any(w in WORDS or w.startswith(BEGINNINGS) for w in words):
            layout = [w for w in words if w in HARMLESS]
            about = [w for w in words if w.startswith(("header", "sidebar"))]
            if not (layout and about and layout[0] == words[0]):
                return True
    return False


class _Element:
    """An open element: its path, instance and nearest block-level tag, and what holds for the text within."""

    __slots__ = ("at", "block", "depth", "form", "header", "link", "path", "shut", "tag", "whole")

    def __init__(self, tag: str, above: _Element | None):
        self.tag = tag
        self.path, self.at, self.depth, self.block = (above.path, above.at, above.depth, above.block) if above else (0, 0, 0, "")
        self.shut, self.form, self.header, self.link, self.whole = (above.shut, above.form, above.header, above.link, above.whole) if above else (False, False, False, False, 0)


class _Block:
    __slots__ = ("at", "depth", "heading", "link", "marks", "path", "prose", "size", "text", "whole")


def blocks(page: str) -> tuple[list[_Block], list[int], list[tuple[int, int]], set[int]]:
    """The blocks of a page in order, the parents of its elements, and of its paths (parent, depth), and the elements that frame it.

    Text of elements that are no part of an article is left out. A form is, unless it wraps more
    text than there is beside it; then it is the frame of the page.
    """
    out: list[_Block] = []
    formed: list[bool] = []
    parents, paths, known, frames = [0], [(0, 0)], {}, {0}
    stack = [_Element("", None)]
    buffer: list[str] = []
    linked, standing = 0, Counter()  # of open elements by tag

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            top = stack[-1]
            if text and not top.shut and not (top.header and top.block not in HEADINGS):
                b = _Block()
                b.text, b.size, b.marks, b.link = text, len(text), len(_MARKS.findall(text)), min(linked, len(text))
                b.path, b.at, b.depth, b.whole, b.heading = top.path, top.at, top.depth, top.whole, top.block in HEADINGS
                b.prose = top.block in PROSE
                out.append(b)
                formed.append(top.form)
            buffer.clear()
        linked = 0

    def opened(tag: str, rest: str) -> None:
        e = _Element(tag, stack[-1])
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest else {}
        role = found.get("role", "").lower()
        if tag in BLOCKS:
            label = (e.path, tag, _DIGITS.sub("0", found["class"]) if "class" in found else "")
            if label not in known:
                known[label] = len(paths)
                paths.append((e.path, paths[e.path][1] + 1))
            parents.append(e.at)
            if tag in ("html", "body"):
                frames.add(len(parents) - 1)
            e.path, e.at, e.depth, e.block = known[label], len(parents) - 1, e.depth + 1, tag
        e.link = e.link or tag == "a"
        e.form = e.form or tag == "form"
        inner = tag == "article" or bool(e.whole)
        e.header = e.header or (tag == "header" and inner)
        e.shut = e.shut or tag in ASIDE or (tag == "header" and not inner)
        if found and not e.shut:
            e.shut = role in ROLES or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
        if not e.shut and ("class" in found or "id" in found) and tag not in ("html", "body", "main"):
            e.shut = _says_aside(f"{found.get('class', '')} {found.get('id', '')}")
        if tag == "article":
            e.whole = e.at
        elif not e.whole and (tag == "main" or role == "main" or found.get("itemprop", "").lower() == "articlebody") and tag in BLOCKS:
            e.whole = -e.at
        stack.append(e)
        standing[tag] += 1

    def closed(to: int) -> None:
        if buffer and any(e.tag in BLOCKS for e in stack[to:]):
            flush()
        for e in stack[to:]:
            standing[e.tag] -= 1
        del stack[to:]

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        text = page[at : start if start >= 0 else end]
        if text:
            text = html.unescape(text) if "&" in text else text
            buffer.append(text)
            if stack[-1].link:
                linked += len(text)
        if start < 0:
            break
        m = _TOKEN.match(page, start)
        if m is None:  # a lone "<" is text
            buffer.append("<")
            at = start + 1
            continue
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if standing[tag] else ():
                if stack[k].tag == tag:
                    closed(k)
                    break
            continue
        if tag in BLOCKS:
            flush()
            if tag not in ("html", "body"):
                if tag in ENDS:
                    ends, within = ENDS[tag]
                else:
                    ends, within = {"p"} | (HEADINGS if tag in HEADINGS else set()), {"td", "th", "li", "div", "section", "article", "main", "body", "button"}
                for k in range(len(stack) - 1, 0, -1) if any(standing[t] for t in ends) else ():
                    if stack[k].tag in ends:
                        closed(k)
                        break
                    if stack[k].tag in within:
                        break
        elif tag == "br":
            buffer.append(" ")
        if tag in RAW:
            shut = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = shut.end() if shut else end
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCKS):
            opened(tag, m[3])
    flush()
    inside = sum(b.size for b, f in zip(out, formed) if f)
    if 2 * inside <= sum(b.size for b in out):
        out = [b for b, f in zip(out, formed) if not f]
    return out, parents, paths, frames


def ratios(found: list[_Block], paths: list[tuple[int, int]]) -> list[float]:
    """The fused, smoothed tag-path ratio of each block."""
    sums: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for b in found:
        s = sums[b.path]
        s[0], s[1], s[2], s[3] = s[0] + 1, s[1] + b.size, s[2] + b.marks, s[3] + b.link

    def shared(a: int, b: int) -> float:
        """How much of the longer of two paths both begin with; long paths are compared by their ends' depth only."""
        da, db = paths[a][1], paths[b][1]
        longest = max(da, db)
        if a == b or not longest:
            return 1.0
        if longest > 64:
            return min(da, db) / longest / 2
        while da > db:
            a, da = paths[a][0], da - 1
        while db > da:
            b, db = paths[b][0], db - 1
        while a != b:
            a, b, da = paths[a][0], paths[b][0], da - 1
        return da / longest

    near: dict[tuple[int, int], float] = {}
    out = []
    for k, b in enumerate(found):
        weight = text = marks = 0.0
        for j in range(max(0, k - REACH), min(len(found), k + REACH + 1)):
            pair = (b.path, found[j].path)
            if pair not in near:
                near[pair] = shared(*pair)
            w = _GAUSS[abs(j - k)] * near[pair]
            n, size, seen, _ = sums[found[j].path]
            weight, text, marks = weight + w, text + w * size / n, marks + w * seen / n
        n, size, _, link = sums[b.path]
        out.append(math.sqrt(text * (marks + 0.1)) / weight * (1 - link / size))
    return out


def main_text(page: str) -> str:
    """The article of one page; empty if there is none."""
    found, parents, paths, frames = blocks(page)
    fused = ratios(found, paths)
    total = sum(b.size for b in found)
    mean = sum(f * b.size for f, b in zip(fused, found)) / total if total else 0.0
    content = [f > 0 and f >= SHARE * mean for f in fused]
    weight: dict[int, int] = defaultdict(int)
    for b, c in zip(found, content):
        if c:
            weight[b.whole] += b.size
    chosen = sum(weight.values())
    articles = {w: n for w, n in weight.items() if w > 0}
    mains = {w: n for w, n in weight.items() if w < 0}
    for whole in (articles, {**articles, **mains}):
        if whole and 10 * sum(whole.values()) >= 3 * chosen:
            most = max(whole.values())
            return "\n".join(b.text for b in found if 5 * whole.get(b.whole, 0) >= most)
    if not chosen:
        return ""
    below = [0] * len(parents)
    for b, c in zip(found, content):
        if c:
            below[b.at] += b.size
    for k in range(len(parents) - 1, 0, -1):
        below[parents[k]] += below[k]
    heart = 0
    for k in range(1, len(parents)):  # a child comes after its parent, and at most one child holds so much
        if parents[k] == heart and below[k] >= WHOLE * chosen:
            heart = k
    inside = [k == 0 for k in range(len(parents))]
    above = set()
    for k in range(1, len(parents)):
        inside[k] = k == heart or inside[parents[k]] if heart else True
    k = heart
    while k:
        k = parents[k]
        above.add(k)
    inside[0] = heart == 0
    last = max(k for k, c in enumerate(content) if c)
    first = min(k for k, c in enumerate(content) if c)
    kept = []
    for k, b in enumerate(found):
        title = b.heading and (inside[b.at] or (parents[b.at] in above and k < first)) and k < last
        within = inside[b.at] and 2 * b.link < b.size and (first < k < last or (b.prose and heart not in frames))
        if (content[k] and inside[b.at]) or title or within:
            kept.append(b.text)
    return "\n".join(kept)


def extracted(pages: DataFrame, source: str = "html") -> DataFrame:
    """pages with text (the article) and n_chars (its code points) instead of the page in column `source`.

    A null or empty page has an empty text; so has one without text outside menus and the like.
    Plain text without tags is one block. Unclosed elements, comments and quotes end with the page.
    Very long and very deep pages are read whole, in linear time. Repeated rows give repeated rows;
    all other columns stay as they are, but columns named text or n_chars are replaced.
    """
    K.small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars") or c == source]
    rest = [c for c in kept if c != source]
    read = pages.select(*(pages[f"`{c}`"] for c in kept))
    place, back = kept.index(source), [kept.index(c) for c in rest]
    schema = read.select(*(read[f"`{c}`"] for c in rest)).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "") for p in batch.column(place).to_pylist()]
            columns = [batch.column(k) for k in back] + [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            K.trim()

    return read.mapInArrow(run, schema)
