import time
from html.parser import HTMLParser

import pytest

from tarnflow.llm import htmltext as h

from .helpers import clashing

LONG = "the cat sat on the mat and it was good for all of them in the house, " * 4
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>no</article>";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-banner">We use cookies</div>
<article><h1>A &amp; B&nbsp;C</h1><p>{LONG}</p><p>Short&hellip;</p><div class="ad">buy now</div><p>One<br>line <b>bold</b>
 text</p><form><input name="q"><button>Go</button></form><p><a href="x">related one two</a> <a href="y">three</a></p><p>{LONG}</p>
<aside>side</aside><section id="comments"><p>first!</p></section></article><footer>&copy; 2024</footer></body></html>"""


def test_article():
    got = h.extract(PAGE).split("\n")
    long = " ".join(LONG.split())
    assert got == ["A & B C", long, "Short…", "One line bold text", long]


def test_pages_without_an_article_are_judged_by_their_blocks():
    page = f"<body><div><a href=1>Home page</a> <a href=2>All products</a></div><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><div><a href=3>imprint of the site</a></div><div>© 2020 The Company and all of its friends, all rights reserved for the owners of this</div></body>"
    assert h.extract(page).split("\n") == [LONG.strip(), "Yes.", LONG.strip()]


def test_pages_of_other_languages_without_an_article():
    frame = "<body><div><a href=1>{0}</a> <a href=2>{0}</a></div><p>{1}</p><p>{2}</p><div><a href=3>{0}</a></div><div>© 2020 {0}</div></body>"
    russian = "Кошка сидела на коврике и смотрела в окно, где медленно падал снег и загорались первые огни. "
    for nav, one, two in (
        ("главная страница", russian * 4, russian * 3),
        ("главная страница", russian.strip(), russian.strip() + " Вечер."),
        ("首頁", "貓坐在墊子上望著窗外，雪慢慢地落下，街上的燈一盞一盞亮了起來，屋裡很安靜。" * 2, "孩子們在院子裡堆了一個很大的雪人，然後回家喝熱茶，聽祖母講很久以前的故事。" * 2),
    ):
        assert h.extract(frame.format(nav, one, two)).split("\n") == [one.strip(), two.strip()]
    assert h.extract(f"<body><div><a href=1>Home</a></div><p>{LONG}</p><div>{russian}</div></body>") == LONG.strip()


def test_content_by_class_and_nested_parts():
    page = f'<body><div class="site-header">Name</div><div id="main-content"><div class="post-header"><h2>Head</h2></div><div>Two <span>wo</span>rds</div><div class="sidebar">no<div>no</div></div><p>x</p></div><div>out</div></body>'
    assert h.extract(page).split("\n") == ["Head", "Two words", "x"]
    page = "<main><p>in</p><div role='search'>no</div><section hidden>no</section><p style='display: none'>no<p>more</main><p>out</p>"
    assert h.extract(page).split("\n") == ["in", "more"]
    assert h.extract("<article><p>a</p><article class='comment'><p>no</p></article><p>b</p></article><div class='content'>out</div>").split("\n") == ["a", "b"]


def test_cut_off_and_broken_pages():
    assert h.extract("<article><p>one two</p><p>three &am") == "one two\nthree &am"
    assert h.extract("<article><p>one</p><p cla") == "one"
    assert h.extract("<article><p>one<!-- x <p>two</p>") == "one"
    assert h.extract("<article><p>a < b and b > c</p><p title='x>y'>two</p></article>") == "a < b and b > c\ntwo"
    assert h.extract("<article>one<p>two<p>three<br><br>four</article>") == "one\ntwo\nthree\nfour"
    assert h.extract("") == "" and h.extract(None) == "" and h.extract("<nav>x</nav>") == "" and h.extract("plain words") == "plain words"
    assert h.extract("<main><p>" + "x " * 50_000 + "</p></main>") == ("x " * 50_000).strip()
    assert isinstance(h.extract("<article>" + '<p a="' * 3000), str)


def test_table_of_pages(spark):
    data = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")]
    got = h.main_text(clashing(spark.createDataFrame(data, "page_id long, url string, html string"))).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, len(h.extract(PAGE))), (1, len(h.extract(PAGE))), (2, 0)]
    assert h.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


class Plain(HTMLParser):
    """The article's blocks by the standard library's parser, without any rules: for pages whose markup says what is what."""

    def __init__(self, page):
        super().__init__()
        self.blocks, self.skip, self.article = [""], [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if self.skip or tag in ("nav", "footer", "script", "style", "title", "head") or dict(attrs).get("class") in ("ad", "sidebar", "comments"):
            self.skip += [tag] if tag not in h.VOID else []
        self.article += tag == "article"
        self.blocks += [""] if tag in h.BLOCKS else []
        self.blocks[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        if tag in self.skip:
            while self.skip.pop() != tag:
                pass
        self.article -= tag == "article"
        self.blocks += [""] if tag in h.BLOCKS else []

    def handle_data(self, data):
        if self.article and not self.skip:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(t for t in (" ".join(b.split()) for b in self.blocks) if t)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_pages_of_the_tables_against_another_parser(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet").select("page_id", "url", "html").collect()
    want = {(r["page_id"], r["url"]): Plain(r["html"]).text() for r in rows}
    got = h.QUERIES["op5_html_text"](spark, f"/root/testdata/sf{sf}")
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    got = got.collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {(r["page_id"], r["url"]): r["text"] for r in got} == want


@pytest.mark.parametrize(
    "page",
    [
        '<div class="layout with-sidebar"><article><p>{0}</p></article><div class="sidebar">{0}</div></div>',
        '<div id="page" class="no-sidebar"><article><p>{0}</p></article></div>',
        '<div class="js-hidden-ready"><article><p>{0}</p></article></div>',
        '<form id="aspnetForm"><input name="state"><article><p>{0}</p></article></form>',
        '<nav><ul><li><a href="1">Home page</a></li></ul><article><p>{0}</p></article><footer>foot</footer>',
        '<article>A teaser</article><div class="post"><p>{0}</p></div>',
        '<article>A teaser</article><div><p>{0}</p><p hidden>no</p></div>',
        '<div class="sidebar-layout"><div><p>{0}</p></div></div><footer>foot</footer>',
        '<form><p>{0}</p></form>',
        '<header><a href="1">Home page</a><p>{0}</p></header>',
        '<main class="widget"><p>{0}</p></main>',
        '<article class="post ad-free"><div class="popup-ready"><p>{0}</p></div></article>',
        '<div class="comments"><article><p>No. {0} {0} {0} {0}</p></article></div><article><p>{0}</p></article>',
        '<div class="comments"><p>No. {0} {0} {0} {0}</p></div><p>{0}</p>',
        '<section class="related"><article>Another article</article></section><div class="content"><p>{0}</p></div>',
        '<article><p>{0}</p><aside>{0}</aside></article>',
        '<a href="1">unclosed<p>{0}</p>',
        '<iframe src="x"><article><p>{0}</p></article>',
    ],
)
def test_no_mark_takes_what_holds_the_content(page):
    long = " ".join((LONG * 2).split())
    assert long in h.extract(f"<html><body>{page.format(long)}</body></html>").split("\n")
    assert "No. " not in h.extract(page.format(long)) and "sidebar" not in h.extract(page.format(long))


def test_broken_tags_take_linear_time_and_leak_no_markup():
    many = " ".join(f'a{i}="{i}"' for i in range(5000))
    for page, want in (
        (f"<article><p>ok</p><div {many}", "ok"),
        (f"<article><p>ok</p><div {many} <p>more</p>", "ok\nmore"),
        ('<article><p>ok</p><p title="one>two</p><p>three</p>', "ok\ntwo\nthree"),
        ("<article><p title=it's>one don't</p></article>", "one don't"),
        ("<article>x" + '<p a="' * 20_001, "x"),
        ("<article>x" + "<a b='<p \"x" * 20_000, None),
        ("<title>" * 50_000 + "x", "x"),
        ("<i>" * 50_000 + "</b>" * 50_000 + "x", "x"),
        ("<div>" * 50_000 + "x" + "</span>" * 50_000, "x"),
        ("x" + "<!--" * 50_000, "x"),
        ("x" + "<a " * 100_000, "x"),
    ):
        began = time.time()
        got = h.extract(page)
        assert time.time() - began < 5
        assert want is None or got == want
