"""Main text: common markup by example, and all given pages by a parser of another kind."""

import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from keysieve.llm import html_text

LONG = "The cat sat on the mat and it was the best of all that we have in this house. " * 3
L = LONG.strip()
RUSSIAN = ("Это длинный абзац текста на русском языке, который рассказывает о чём-то важном и "
           "интересном для читателя, и он продолжается ещё долго, чтобы быть длиннее порога.")
CHINESE = "这是一个很长的中文段落，" * 12


@pytest.mark.parametrize("page, text", [
    (f"<ul><li><a href=/x>меню</a></li></ul><p>{RUSSIAN}</p>", RUSSIAN),
    (f"<div><p>{CHINESE}</p></div>", CHINESE),
    (f"<article><a name=top><p>{LONG}</p><p>More text.</p></article>", f"{L}\n\nMore text."),
    (f"<article><p><a href=/x>Link</p><p>{LONG}</p></article>", f"Link\n\n{L}"),
    *[(f"<article><p>{LONG}</p><{x}><p>Then more.</p></article>", f"{L}\n\nThen more.")
      for x in ("canvas", "object", "svg", "noscript")],
    ("<p>Just a short text.</p>", "Just a short text."),
    (f"<article><p>{LONG}</p><label>Name</label><p>x<math><mi>y</mi></math></p><ul><li>"
     "<a href=/q>One link</a></li></ul></article>", f"{L}\n\nName\n\nxy\n\nOne link"),
    *[(f"<div><p>{LONG}</p></div><div class='{c}'><p>{LONG}bad</p></div>", L)
      for c in ("sidebar-left", "comment-list", "comments-area", "ad-container", "cookie-bar",
                "footer-inner", "content-sidebar")],
    (f"<div class='content-sidebar'><div><p>{LONG}</p></div><div class='sidebar'><p>{LONG}bad</p></div>"
     "</div>", L),
    (f"<article><p>{LONG}</p></article><article class='comment'><p>{LONG}bad</p></article>", L),
    *[(f"<div class='{c}'><p>{LONG}</p></div>", L)
      for c in ("post category-social", "hentry tag-cookies", "main with-sidebar",
                "header-large post", "search-engines-explained")],
    (f"<article><p>{LONG}</p><script>if (a</script><p>End.</p><script>never closed", f"{L}\n\nEnd."),
    ("", ""), (None, ""),
])
def test_common_markup(page, text):
    assert html_text.main_text(page) == text


def test_time_grows_with_the_page():
    for page in ("<div>" * 60_000 + "</span>" * 60_000 + "<p>x</p>", "<svg>" * 60_000,
                 "<a href=x>" * 60_000, "<p><li>" * 30_000):
        start = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - start < 10


class Article(HTMLParser):
    """The blocks inside <article>, without elements of class "ad" and the like."""

    CUT = {"p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "div", "blockquote", "pre", "table", "tr",
           "td", "th", "section", "article", "aside", "nav", "header", "footer", "figure", "hr"}
    GONE = {"script", "style", "aside", "nav", "footer", "form", "button"}
    EMPTY = {"br", "img", "hr", "input", "meta", "link"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.gone, self.text, self.out = 0, [], [], []

    def cut(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.out.append(text)

    def handle_starttag(self, name, attrs):
        if name in self.CUT and not self.gone:
            self.cut()
        if name == "article":
            self.inside += 1
        classes = (dict(attrs).get("class") or "").split()
        if self.gone:
            self.gone += [name] * (name == self.gone[0])
        elif name not in self.EMPTY and (name in self.GONE or {"ad", "comment", "notice"} & set(classes)):
            self.gone = [name]
        if name == "br" and not self.gone and self.inside:
            self.text.append(" ")

    def handle_endtag(self, name):
        if self.gone:
            if name == self.gone[0]:
                self.gone.pop()
            return
        if name in self.CUT:
            self.cut()
        if name == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.gone:
            self.text.append(data)


def test_all_given_pages(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    want = {}
    for page in pq.read_table(path).to_pylist():
        parser = Article()
        parser.feed(page["html"] or "")
        parser.close()
        parser.cut()
        want[page["page_id"]] = "\n\n".join(parser.out)
    got = {r.page_id: r.text for r in html_text.extract(spark.read.parquet(path)).collect()}
    differ = [k for k in want if want[k] != got[k]]
    assert not differ, (len(differ), want[differ[0]][:300], got[differ[0]][:300])


def test_rows_of_all_kinds(spark):
    """Repeated rows, nulls, an empty table, columns of other names."""
    rows = [(1, "u", f"<p>{LONG}</p>", "t", 5)] * 2 + [(None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted(map(tuple, html_text.extract(pages).collect()), key=str)
    assert got == [(1, "u", L, len(L)), (1, "u", L, len(L)), (None, None, "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0
