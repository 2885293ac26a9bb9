"""Main text of web pages by line-block distribution.

1. Markup is stripped: comments, scripts, styles, forms and the head go with their content. Block elements cut the
   page into lines; character references are decoded and white space inside a line becomes one blank.
2. Each line has a weight: its length, or nothing where its elements say it is not article text (menus, page
   headers, footers, sidebars, notices, adverts, reader comments, by element name or by the words of class, id and
   role). Where the page marks an article, lines outside it weigh nothing; where it marks none, lines that are
   mostly link text weigh nothing.
3. Words of class, id and role are hints only. They say nothing on html and body, nor on the heaviest article and
   what encloses it; without an article, nor on an element beside which less than ``LEAST_SHARE`` of its own text
   would be left (a wrapper named after the sidebar it makes room for).
4. Weights are summed over sliding windows of ``WINDOW`` lines. A surge point is where the sum rises from nothing,
   a dive point where it falls back to nothing; the lines between are a region. A marked article keeps all its
   regions; otherwise a region is dropped if it has less than ``LEAST_SHARE`` of the heaviest region's weight and no
   line in the element that holds most of that region.

Pages are independent: no shuffle, and a task holds one batch of pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
LEAST_SHARE = 0.25
LINK_SHARE = 0.5

# HTML element names by role.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HOLDER = set("article body blockquote details div fieldset figure html main section td".split())
CONTAINER = set("article aside body details dialog div fieldset figure footer form header html main menu nav ol section table ul a h1 h2 h3 h4 h5 h6 p li td button select".split())
WHOLE = set("script style noscript template iframe object svg math canvas audio video map textarea select button head datalist".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = set("nav footer aside form menu dialog".split())
# Words of class, id and role attributes that mark text beside the article.
OUTSIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion promoted "
    "comment comments commentlist disqus replies respond sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations widget widgets toolbar search contentinfo complementary copyright legal skip".split()
)
ARTICLE_WORDS = set("articlebody".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
_CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "option", "optgroup", "title", "legend"}


@dataclass
class _Line:
    parts: list[str] = field(default_factory=list)
    link: int = 0
    outside: bool = False
    article: int = 0
    hint: int = 0
    holder: int = 0


def _marks(name: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """(text beside the article, a hint of such text, the article itself) by name and attributes."""
    article, hint = name in ("article", "main"), False
    outside = name in OUTSIDE or (name == "header" and not in_article)
    if attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id", "role"):
                words = {w.lower() for w in _WORD.findall(value)}
                hint |= bool(words & OUTSIDE_WORDS) or (bool(words & {"header"}) and not in_article and name in ("div", "section", "header"))
                article |= key == "role" and value.strip().lower() in ("main", "article")
            elif key == "itemprop":
                article |= value.strip().lower() in ARTICLE_WORDS
            elif key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                outside = True
    return outside, hint and name not in ("html", "body"), article and not outside


@dataclass
class _Open:
    """An open element: its number, and what it says of the text in it."""

    name: str = ""
    outside: bool = False
    article: int = 0  # the number of the outermost article around the text
    hint: int = 0  # the innermost hinted element around the text; 0: none
    holder: int = 0


def _lines(page: str) -> tuple[list[_Line], dict[int, int], dict[int, int]]:
    """The lines, the hinted element around each hinted one, and the innermost one at or above each outermost article."""
    lines, line = [], _Line()
    stack: list[_Open] = []
    open_names: Counter[str] = Counter()
    endless: set[str] = set()  # elements without a further end tag
    above: dict[int, int] = {}
    enclosing: dict[int, int] = {}
    links, at, n, number = 0, 0, len(page), 0

    def cut() -> None:
        nonlocal line
        if line.parts:
            lines.append(line)
        top = stack[-1] if stack else _Open()
        line = _Line(outside=top.outside, article=top.article, hint=top.hint, holder=top.holder)

    def close() -> str:
        name = stack.pop().name
        open_names[name] -= 1
        return name

    def say(text: str) -> None:
        if text:
            line.parts.append(text)
            if links:
                line.link += len(text)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        tag = _TAG.match(page, lt)
        if not tag:
            if not (page[lt + 1 : lt + 2].isalpha() or page[lt + 1 : lt + 2] == "/"):
                say("<")
                at = lt + 1
                continue
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        at = tag.end()
        closing, name, attributes = tag[1], tag[2].lower(), tag[3]
        if name in WHOLE and not closing:
            # Only foreign elements end with a slash.
            if not (name in ("svg", "math") and attributes.rstrip().endswith("/")) and name not in endless:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in ("script", "style", "textarea", "template"):
                    at = n
                else:
                    endless.add(name)
            continue
        if name == "br":
            say(" ")
            continue
        if name == "a":
            links = 0 if closing else links + 1
        if closing:
            if open_names[name] > 0:
                while close() != name:
                    pass
            if name in BLOCK:
                cut()
            continue
        if name in _CLOSES_P and stack and stack[-1].name == "p":
            close()
        if name == "li" and stack and stack[-1].name == "li":
            close()
        if name in CONTAINER or (name in BLOCK and name not in VOID):
            before = stack[-1] if stack else _Open()
            outside, hint, article = _marks(name, attributes, bool(before.article)) if name != "a" else (False, False, False)
            number += 1
            now = _Open(name, before.outside or outside, before.article, before.hint, number if name in HOLDER else before.holder)
            if hint:
                now.hint, above[number] = number, before.hint
            if article and not now.article and not now.outside:
                now.article = number
                enclosing[number] = now.hint
            stack.append(now)
            open_names[name] += 1
        if name in BLOCK:
            cut()
    cut()
    return lines, above, enclosing


def _beside(found: list[tuple[str, _Line]], above: dict[int, int], enclosing: dict[int, int]) -> set[int]:
    """Hinted elements whose text is beside the article, by their own hint or by one around them."""
    inside: Counter[int] = Counter()
    for text, x in found:
        if x.article and not x.outside:
            inside[x.article] += len(text)
    beside: set[int] = set()
    if inside:
        # The heaviest article, the first of equals: hints at and above it say nothing.
        free, hint = set(), enclosing[max(inside, key=lambda k: (inside[k], -k))]
        while hint:
            free.add(hint)
            hint = above[hint]
        for hint in sorted(above):
            if hint not in free or above[hint] in beside:
                beside.add(hint)
        return beside
    own: Counter[int] = Counter()
    for text, x in found:
        if not x.outside and x.link <= LINK_SHARE * len(text):
            own[x.hint] += len(text)
    whole = Counter(own)
    for hint in sorted(above, reverse=True):
        whole[above[hint]] += whole[hint]
    rest = own[0]
    for hint in sorted(above):  # outer elements first
        if above[hint] in beside or rest >= LEAST_SHARE * whole[hint]:
            beside.add(hint)
        else:
            rest += own[hint]
    return beside


def main_text(page: str | None) -> str:
    """The article's lines joined by one line feed; empty for a null or empty page or one without text."""
    found = []
    lines, above, enclosing = _lines(page or "")
    for line in lines:
        text = " ".join(html.unescape("".join(line.parts)).split())
        if text:
            found.append((text, line))
    if not found:
        return ""
    beside = _beside(found, above, enclosing)
    for _, x in found:
        x.outside = x.outside or x.hint in beside
    marked = any(x.article and not x.outside for _, x in found)
    weight = np.zeros(len(found), np.int64)
    for i, (text, x) in enumerate(found):
        linked = not marked and x.link > LINK_SHARE * len(text)
        weight[i] = 0 if x.outside or linked or (marked and not x.article) else len(text)
    if not weight.any():
        return ""
    padded = np.concatenate([np.zeros(WINDOW, np.int64), weight, np.zeros(WINDOW, np.int64)])
    blocks = np.convolve(padded, np.ones(WINDOW, np.int64), "valid")  # the window that ends at each line
    busy = np.concatenate([[False], blocks > 0, [False]])
    edge = np.flatnonzero(busy[1:] != busy[:-1])
    surges, dives = edge[::2], edge[1::2]
    regions = [(a - 1, b - WINDOW) for a, b in zip(surges.tolist(), dives.tolist())]
    regions = [(max(a, 0), min(b, len(found))) for a, b in regions]
    totals = [int(weight[a:b].sum()) for a, b in regions]
    least = 0 if marked else LEAST_SHARE * max(totals)
    holders: Counter[int] = Counter()
    for i in range(*regions[int(np.argmax(totals))]):
        holders[found[i][1].holder] += int(weight[i])
    holder = max(holders, key=lambda k: (holders[k], -k))
    near = [total >= least or any(weight[i] > 0 and found[i][1].holder == holder for i in range(a, b)) for (a, b), total in zip(regions, totals)]
    keep = [i for (a, b), good in zip(regions, near) if good for i in range(a, b) if weight[i] > 0]
    return "\n".join(found[i][0] for i in keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of ``pages``; other columns are ignored.

    Null ids and urls stay as they are, repeated rows give repeated results, pages of any length are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
