from __future__ import annotations

import random
import re
from html.parser import HTMLParser

import pytest

from barsmith.llm import html as X
from barsmith.llm.common import read


def text_of(page: str) -> str:
    texts, kept, _ = X.blocks(page)
    return " ".join(t for t, k in zip(texts, kept, strict=True) if k)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<body><nav>menu</nav><article><h1>T</h1><p>a<b>b</b> c<br>d &lt;x&gt;</p></article><footer>f</footer>", "T ab c d <x>"),
        ("<article><p>one<p>two<div class='ad-box'>buy</div><section id=comments><p>nice</p></section></article>", "one two"),
        ("<article><header>by me</header>text<aside>more</aside><form><input>send</form></article>", "text"),
        ("<main><p>x</p><script>if (a < b) { '</p>' }</script>y</main>z", "x y"),
        ("<div class='header'>h</div><p>body  text\n\tmore</p><!-- <p>no</p> --><style>p{}</style>", "body text more"),
        ("<article>a < b <a href='x>y'>link</a></article>", "a < b link"),
        ("<article>unclosed <b>bold <p>next", "unclosed bold next"),
        ("<article><textarea>raw</textarea>&nbsp;kept &copy;</article><article class='comment'>no</article>", "kept ©"),
        ("<p hidden>no</p><p style='display: none'>no</p><p class='breadcrumbs'>no</p><p class='header-less'>no</p><p class='reader'>yes</p>", "yes"),
    ],
)
def test_blocks(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p class='ad'>buy<p>real text</article>", "real text"),
        ("<div class='page-with-sidebar header'><article>whole</article></div>", "whole"),
        ("<form id='page'><article>in a form</article></form><div class='comments'><article>nice</article></div>", "in a form"),
        ("<article>\u0130 a<script>x</SCRIPT>after</article>", "\u0130 a after"),
        ("<article>a<select><option>x</article><p>tail", "a"),
        ("<div><noscript>enable</div><p>tail</p>", "tail"),
        ("<article>a<object>x<object>y</object>z</object>b</article>", "a b"),
        (f"<article>a<i title='{'v>' * 4200}'>b</i>c</article>", "abc"),
        ("<article><ul><li class='share'>s<li>real item</ul></article>", "real item"),
        ("<article>x <span class=ad>buy</span> more</article>", "x more"),
        ("<article><p title='a hidden gem'>kept</p><h2 class='menu'>head</h2></article>", "kept head"),
        ("<div class='has-sidebar'>kept</div>", "kept"),
        ("<article><table><tr><td class=ad>no<td>yes<tr><td>too</table></article>", "yes too"),
        ("<article><dl><dt class=ad>no<dd>yes</dl></article>", "yes"),
        ("<article>a<img src=x>b<!--> c", "ab c"),
        ("<article>1 <a href='x>2 it's</article>", "1"),
    ],
)
def test_awkward_markup(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><section class='side-effects'>kept</section></article>", "kept"),
        ("<article><div class='ad-hoc query'>kept</div><section id='social-history'>too</section></article>", "kept too"),
        ("<article><section id='history-of-advertising'>kept</section><p class='form-factor'>too</article>", "kept too"),
        ("<article>now read <a class='related-link'>the study</a> again</article>", "now read the study again"),
        ("<article><p>a <em class='notice'>mark</em></p><p><b class='comment'>Some</b> remark</p></article>", "a mark Some remark"),
        ("<article><p>x</p><a class='related-link'>other story</a></article>", "x"),
        ("<article>x<ins class='adsbygoogle'>buy</ins><p class='advertorial'>buy</p><div class='cookiebanner'>ok?</div>y</article>", "x y"),
        ("<article>x<div class='acme-sidebar-inner'>s</div><div class='relatedPosts'>r</div><div id='comments_2'>c</div></article>", "x"),
        ("<article><div class='no-sidebar'>a</div><div class='page-without-ads'>b</div><div class='searchable'>c</div></article>", "a b c"),
        ("<article><div class='site-header__inner ad-300x250'>no</div><div class='wp-navigation'>no</div>yes</article>", "yes"),
    ],
)
def test_names_rule_out_whole_elements_only(page, want):
    assert text_of(page) == want


def plain_extract(rows, run=X.RUN, least=X.MIN_PAGES):
    pages = {i: [b.split(" ") for b, k in zip(*X.blocks(h)[:2], strict=True) if k] for i, h in rows}
    streams = {i: [w for b in p for w in b] for i, p in pages.items()}
    where = {}
    for s in streams.values():
        for j in range(len(s) - run + 1):
            where.setdefault(tuple(s[j : j + run]), set()).add(tuple(s))
    out = {}
    for i, p in pages.items():
        s, at, words = streams[i], 0, []
        mask = [any(len(where[tuple(s[j : j + run])]) >= least for j in range(max(0, k - run + 1), min(k, len(s) - run) + 1)) for k in range(len(s))]
        for b in p:
            m = mask[at : at + len(b)]
            at += len(b)
            if not all(m):
                text = "".join("x" if x else "." for x in m)
                gone = {k for g in re.finditer(f"x{{{run},}}", text) for k in range(g.start(), g.end())}
                words += [w for k, w in enumerate(b) if k not in gone]
        out[i] = " ".join(words)
    return out


def test_one_large_host_by_brute_force(spark):
    r = random.Random(3)
    line = " ".join(f"s{k}" for k in range(20))
    rows = []
    for i in range(900):
        p = [f"w{r.randrange(3000)}" for _ in range(30)]
        parts = [" ".join(p[:10]), line if i % 150 == 0 else " ".join(line.split()[: r.randrange(9)]), " ".join(p[10:])]
        rows.append((i, "".join(f"<p>{x}</p>" for x in parts)))
    df = spark.createDataFrame([(i, "http://hot.example/x", h) for i, h in rows], "page_id long, url string, html string")
    got = {x.id: x.text for x in X.extract(df).collect()}
    assert got == plain_extract(rows)
    assert "s19" not in got[0], "a line on 6 of 900 pages of one host"


def test_boilerplate_without_markup(spark):
    line = "read all our other stories in the weekly paper edition today"
    rows = [(i, f"http://h.example/{i}", f"<div>{line}</div><p>story number {i} tells {i * 7} things</p>") for i in range(5)]
    rows += [(9, "http://other.example/", f"<div>{line}</div>"), (10, None, None), (11, "bad url", "<p>x</p>"), (11, "bad url", "<p>x</p>")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    out = sorted(((r.id, r.text) for r in X.extract(df).collect()), key=str)
    assert out == sorted([(i, f"story number {i} tells {i * 7} things") for i in range(5)] + [(9, line), (10, ""), (11, "x"), (11, "x")], key=str)
    assert X.extract(df.limit(0)).count() == 0


def test_copies_without_markup_keep_their_text(spark):
    r = random.Random(5)
    story = [f"w{r.randrange(500)}" for _ in range(300)]
    texts = [story] * 3 + [story[:k] + ["edited"] + story[k + 1 :] for k in (50, 120, 200, 299)]
    line = "read all our other stories in the weekly paper edition today"
    rows = [(i, f"http://h.example/{i}", f"<div>{line}</div><p>{' '.join(t)}</p>") for i, t in enumerate([*texts, ["one", "short", "page"], ["another", "short", "page"]])]
    got = {x.id: x.text for x in X.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(t) for i, t in enumerate([*texts, ["one", "short", "page"], ["another", "short", "page"]])}


def shared_words(rows, run=X.RUN, least=X.MIN_PAGES):
    """For each page which words of its blocks lie in runs that pages of any markup share, by brute force."""
    streams = {i: [w for t, k in zip(*X.blocks(h)[:2], strict=True) if k for w in t.split(" ")] for i, h in rows}
    where = {}
    for s in streams.values():
        for j in range(len(s) - run + 1):
            where.setdefault(tuple(s[j : j + run]), set()).add(tuple(s))
    return {i: [any(len(where[tuple(s[j : j + run])]) >= least for j in range(max(0, k - run + 1), min(k, len(s) - run) + 1)) for k in range(len(s))] for i, s in streams.items()}


def test_shared_runs_of_every_page_by_brute_force(spark):
    r = random.Random(8)
    lines = [" ".join(f"s{n}x{k}" for k in range(14)) for n in range(20)]
    rows = []
    for i in range(120):
        own = [" ".join(f"w{r.randrange(5000)}" for _ in range(r.randrange(1, 30))) for _ in range(3)]
        parts = [own[0], " ".join(r.choice(lines).split()[r.randrange(6) :]), own[1], r.choice(lines), own[2]]
        body = "".join(f"<p>{x}</p>" for x in parts)
        rows.append((i, [f"<nav>menu</nav><article>{body}</article><p>after</p>", f"<main>{body}</main>", body][i % 3]))
    df = spark.createDataFrame([(i, f"http://hot.example/{i}", h) for i, h in rows], "page_id long, url string, html string")
    got = {x.id: x for x in X.extract(df).collect()}
    want, plain = shared_words(rows), plain_extract(rows)
    assert {i: x.host_words for i, x in got.items()} == {i: sum(m) for i, m in want.items()}
    assert sum(sum(m) for i, m in want.items() if i % 3 == 0) > 100, "runs in articles that markup names are found too"
    for i, h in rows:
        assert got[i].text == (text_of(h) if i % 3 < 2 else plain[i])
        assert got[i].dropped_words == len(want[i]) - len(got[i].text.split())


def test_shared_menus_of_named_articles_go(spark):
    menu = "<ul><li><a href=/1>World news</a></li><li><a href=/2>All of our sports</a></li><li><a href=/3>Weather and maps</a></li></ul>"
    line = "as the charter of the united nations says in full"
    title = "<h1><a href=/x>A long title of nine words on each part</a></h1>"

    def page(i, extra=""):
        return f"<article>{title}{menu}<p>story {i} begins <a href=/y>here</a></p>{extra}<p>{line}</p></article>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(3)]
    rows += [(3, "http://h.example/3", page(3, "<p><a href=/4>Weather</a> and <a href=/5>maps</a></p><p><a href=/6>My own list of links</a></p>"))]
    rows += [(9, "http://other.example/9", page(9)), (10, "http://h.example/10", None)]
    got = {x.id: x for x in X.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    head = "A long title of nine words on each part"
    assert {i: got[i].text for i in range(3)} == {i: f"{head} story {i} begins here {line}" for i in range(3)}
    assert got[3].text == f"{head} story 3 begins here Weather and maps My own list of links {line}"
    assert got[9].text == f"{head} World news All of our sports Weather and maps story 9 begins here {line}", "one page shares nothing"
    assert [(got[i].host_words, got[i].dropped_words) for i in (0, 9, 10)] == [(31, 9), (0, 0), (0, 0)], "the title, the menu and a word after it, the line and two words before it"


class Plain(HTMLParser):
    """Text inside article, outside asides and elements of class ad, a space at every tag that is not inline."""

    def __init__(self):
        super().__init__()
        self.open, self.text = [], []

    def handle_starttag(self, tag, attrs):
        self.text.append("" if tag in X.INLINE else " ")
        if tag not in X.VOID:
            self.open.append((tag, tag in X.ASIDE | {"script", "style", "form"} or dict(attrs).get("class") == "ad"))

    def handle_endtag(self, tag):
        self.text.append("" if tag in X.INLINE else " ")
        while self.open and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(aside for _, aside in self.open):
            self.text.append(data)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = X.op10_html(spark, sf).collect()
    pages = {r.page_id: r.html for r in read(spark, sf, "pages").collect()}
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        plain = Plain()
        plain.feed(pages[r.page_id])
        assert r.text == " ".join("".join(plain.text).split())
        assert len(r.text) == r.n_chars
