"""Main text of web pages by two passes over blocks.

A page is cut into blocks at block-level tags.  The first pass looks at each block alone:

* blocks inside menus, headers of the page, footers, sidebars, notices, adverts, forms and
  reader comments (told by tag or role, or by a class or id that is or ends in such a word, or
  begins with one before words for a box, unless it tells a category or a layout or stands on
  an article; an article of class ``comment`` is one by a reader) are bad; a page that has no
  text then is read once more without names that begin with "content" (``content-sidebar``);
* blocks mostly made of links are bad, short ones inside an article ambiguous;
* long blocks with enough stop words are good; long ones with hardly any are bad, unless
  they stand inside an article;
* all others are ambiguous.

On a page without an article whose blocks have hardly any stop words in all, which is one in a
language that is not listed, long blocks are good by their length and links alone.  A sign of a
script that writes no blanks counts as three characters of length.

In the second pass ambiguous blocks inherit the label of the nearest decided neighbour of
the same part of the page (an article, or what stands outside all articles); on a tie, or if
nothing there is decided, a block inside an article, or on a page without one, is good and any
other bad.

Scripts, styles, comments and markup never reach a block.  Character references are decoded,
white space becomes one blank, blocks are joined by an empty line.  Null and empty pages have
the text "".  Unclosed and stray tags are tolerated.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.llm.shared import chunks

LONG, STOP_HIGH, STOP_LOW, LINKS_MOST = 140, 0.15, 0.03, 0.5

# Frequent function words of the languages pages come in.
STOP_WORDS = frozenset("""
    the of and to in a is that for it as was with be by on not he his but at are this have
    from or had an they which one you were all her she there would their we him been has when
    der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es
    an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen
    de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il
    sont avec ou son aux cette ses mais comme on elle leur
    el y a los del las por con una su para es al lo como más o pero sus le ha me si sin sobre
    este ya entre cuando todo esta ser dos también fue era muy hasta desde no se
    """.split())

SECTIONS = frozenset(("article", "main"))
BOILERPLATE = frozenset((
    "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset"))
RAW = frozenset((
    "script", "style", "title", "textarea", "noscript", "template", "iframe", "svg",
    "object", "canvas", "audio", "video", "noframes", "xmp"))
TO_THE_END = frozenset(("script", "style", "title", "textarea", "xmp"))  # of the page, if left open
CONTAINERS = frozenset((
    "div", "section", "ul", "ol", "dl", "table", "figure", "header", "blockquote", "details",
    "body", "html", "head", "p", "li", "span", "td", "tr", "tbody", "thead"
    )) | SECTIONS | BOILERPLATE
BLOCKS = CONTAINERS - {"span", "label", "button"} | frozenset((
    "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "pre", "hr", "figcaption", "caption",
    "summary", "address", "th", "center", "hgroup", "option", "legend", "optgroup", "tfoot"))
VOID = frozenset(("br", "hr", "img", "input", "meta", "link", "area", "base", "col", "wbr",
                  "embed", "source", "track", "param"))
HINTS = frozenset((
    "nav", "navbar", "navigation", "menu", "header", "masthead", "footer", "sidebar", "aside",
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored",
    "promo", "promotion", "banner", "notice", "notices", "notification", "alert", "cookie",
    "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "paywall", "signup", "login", "comment", "comments", "commentlist",
    "reply", "replies", "respond", "disqus", "share", "sharing", "social", "related",
    "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "widget", "toolbar",
    "copyright", "disclaimer", "skip", "search"))
READERS = frozenset(("comment", "comment-body", "reply"))  # classes of articles in comments
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog",
                   "alert", "alertdialog", "form", "menu", "menubar", "toolbar"))
# Words that make a compound a category of the text or a layout: "tag-cookies", "no-sidebar".
CATEGORIES = frozenset(("category", "cat", "tag", "topic", "type", "format"))
LAYOUTS = frozenset(("no", "not", "without", "has", "with", "layout"))
# Words for a box: "comment-list" is one of comments, "header-large" is no header.
BOXES = frozenset((
    "left", "right", "top", "bottom", "list", "area", "container", "bar", "inner", "outer",
    "wrapper", "wrap", "box", "block", "section", "holder", "panel", "links", "items", "group",
    "row", "col", "column", "slot", "unit", "primary", "secondary"))
OPEN_TO_HINTS = frozenset(("div", "section", "ul", "ol", "dl", "p", "span", "table", "li",
                           "article", "figure", "details", "td", "header", "blockquote"))

_TAG = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|[!?][^>]*>?"
    r"|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<more>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<more2>[^>]*+)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(
    r"(?<![\w-])(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CONTENT = re.compile(r"\bcontent[-_]", re.I)
_HREF = re.compile(r"(?<![\w-])href\s*=", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_DENSE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff66-\uff9f]")


@dataclass
class Block:
    text: str
    link_chars: int
    bad: bool
    section: int  # which article, 0 outside


def _names(token: str, around: bool) -> bool:
    """Whether a class or id names an unwanted element: as a whole, by its last word, or by its
    first one if the others are words for a box.  ``around``: not if it begins with "content"."""
    parts = [x for x in re.split(r"[-_]+", token) if x]
    if not parts or parts[0] in CATEGORIES or LAYOUTS & set(parts[:-1]):
        return False
    if around and parts[0] == "content":
        return False
    return parts[-1] in HINTS or parts[0] in HINTS and BOXES.issuperset(parts[1:])


def _unwanted(name: str, more: str, in_article: bool, around: bool) -> bool:
    """Whether an element holds no main text, by its tag and attributes."""
    if name in BOILERPLATE or (name == "header" and not in_article):
        return True
    if name not in OPEN_TO_HINTS or not more:
        return False
    for attribute, *values in _ATTRIBUTE.findall(more):
        value = "".join(values).lower()
        kind = attribute.lower()
        if kind == "hidden" and not value:
            return True
        if kind == "role" and value in ROLES:
            return True
        if kind in ("class", "id"):
            tokens = value.split()
            if name != "article" and any(_names(x, around) for x in tokens):
                return True
            if name == "article" and not READERS.isdisjoint(tokens):
                return True
    return False


def blocks(page: str, around: bool = False) -> list[Block]:
    """The blocks of a page with what the first pass needs to know of them."""
    out: list[Block] = []
    parts: list[str] = []
    links, in_link, bad, articles, section, sections = 0, 0, 0, 0, 0, 0
    stack: list[tuple[str, bool, bool]] = []  # name, unwanted, article
    opened: Counter = Counter()  # names on the stack
    link_at = 0  # elements that were open where the link began

    def close() -> str:
        nonlocal bad, articles, in_link
        name, unwanted, article = stack.pop()
        opened[name] -= 1
        bad -= unwanted
        articles -= article
        if len(stack) < link_at:  # the end of what holds a link ends it
            in_link = 0
        return name

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                links += len("".join(text.split()))

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, links, bad > 0, section if articles else 0))
        parts.clear()
        links = 0

    at, size = 0, len(page)
    no_end: dict[str, int] = {}  # raw elements that no tag closes from there on
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            if name in BLOCKS:
                flush()
            if name == "a":
                in_link = 0
            if name in CONTAINERS and opened[name]:
                flush()
                while close() != name:
                    pass
            continue
        more = m["more"] or m["more2"] or ""
        if name in RAW:
            if not more.rstrip().endswith("/") or name in ("script", "style"):
                end = None if no_end.get(name, size) <= at else re.compile(
                    rf"</{name}\b[^>]*>", re.I).search(page, at)
                if end is not None:
                    at = end.end()
                else:  # looked for once only
                    no_end[name] = min(at, no_end.get(name, size))
                    at = size if name in TO_THE_END else at
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCKS:
            flush()
        if name == "a":
            in_link, link_at = int(bool(_HREF.search(more))), len(stack)
        if name in CONTAINERS and name not in VOID:
            if name in ("p", "li", "td", "tr"):  # opening one closes the one before
                while stack and stack[-1][0] == name:
                    close()
            unwanted = _unwanted(name, more, articles > 0, around)
            article = name in SECTIONS and not unwanted
            if article and not articles:
                sections += 1
                section = sections
            if unwanted or article or name in ("header", "div", "section"):
                flush()
            stack.append((name, unwanted, article))
            opened[name] += 1
            bad += unwanted
            articles += article
    flush()
    return out


def _length(text: str) -> int:
    return len(text) + 2 * len(_DENSE.findall(text))


def _links(b: Block) -> float:
    return b.link_chars / max(1, len(b.text.replace(" ", "")))


def _stop_words(text: str) -> tuple[int, int]:
    found = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in found), len(found)


def unlisted(found: list[Block]) -> bool:
    """Whether a page without an article is in a language whose stop words are not listed."""
    if any(b.section for b in found):
        return False
    counts = [_stop_words(b.text) for b in found if not b.bad and _links(b) <= LINKS_MOST]
    return sum(c for c, _ in counts) < STOP_LOW * max(1, sum(n for _, n in counts))


def first_pass(b: Block, by_length: bool = False) -> bool | None:
    """True: main text; False: not; None: ambiguous."""
    if b.bad:
        return False
    if _links(b) > LINKS_MOST and not b.section:
        return False
    if _length(b.text) < LONG:
        return None
    if by_length:
        return True
    n, words = _stop_words(b.text)
    share = n / max(1, words)
    if share >= STOP_HIGH:
        return True
    return False if share < STOP_LOW and not b.section else None


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Ambiguous blocks take the label of their nearest decided neighbour in their part."""
    out = [bool(x) for x in labels]
    by_part: dict[int, list[int]] = {}
    no_article = not any(b.section for b in found)
    for i, b in enumerate(found):
        if not b.bad:
            by_part.setdefault(b.section, []).append(i)
    for part, places in by_part.items():
        far = len(places) + 1
        before, after, last = [], [far] * len(places), (far, None)
        for k, i in enumerate(places):
            last = (0, labels[i]) if labels[i] is not None else (last[0] + 1, last[1])
            before.append(last)
        last, ahead = (far, None), []
        for i in reversed(places):
            last = (0, labels[i]) if labels[i] is not None else (last[0] + 1, last[1])
            ahead.append(last)
        after = ahead[::-1]
        for k, i in enumerate(places):
            if labels[i] is None:
                (d, x), (e, y) = before[k], after[k]
                if x is None and y is None:
                    out[i] = part > 0 or no_article
                elif d == e and x is not y:
                    out[i] = part > 0
                else:
                    out[i] = bool(y if x is None or (y is not None and e < d) else x)
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    text = _main_text(blocks(page))
    # "content-sidebar" is a sidebar of the content, or a layout with both: then all stands in it
    return text or (_main_text(blocks(page, around=True)) if _CONTENT.search(page) else "")


def _main_text(found: list[Block]) -> str:
    by_length = unlisted(found)
    keep = second_pass(found, [first_pass(b, by_length) for b in found])
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
