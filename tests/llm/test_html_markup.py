"""Tags as browsers read them: foreign elements, quotes, comments, unclosed elements; speed on pathological pages."""

import time

import pytest

pytest.importorskip("cellqtl.llm")
from cellqtl.llm import html  # noqa: E402


def main(page):
    return " ".join(t for k, t, _ in html.blocks(page) if k in ("main", "doubt"))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><svg/><p>after</p></article>", "after"),
        ("<article><svg viewBox='0 0 1 1'><path d='M0'/><svg><text>x</text></svg><circle/></svg><p>after</p></article>", "after"),
        ("<article><math><mi>x</mi></math><p>after</p></article>", "after"),
        ("<article><p title=it's>lost</p><p>kept</p><p>isn't</p></article>", "lost kept isn't"),
        ("<article><p class=\"a\"\">text</p><p class=\"b\">kept</p></article>", "text kept"),
        ("<article><p title='a > b'>one</p><p title = \"c > d\" hidden=x>two</p></article>", "one"),
        ("<article><p data-x=\"open>one</p><p>two</p></article>", "one two"),
        ("<article><iframe src=x><p>three</p></article>", "three"),
        ("<article><iframe src=x><p>in</p></iframe><noscript><p>no</p></noscript><p>four</p></article>", "four"),
        ("<article><script>var a = '<p>x</p>';</script ><style>p{}</style><template><p>t</p></template>five</article>", "five"),
        ("<article><br/><img src=a alt='>'/><p/>six</article>", "six"),
        ("<article><div class='commentList'>great post</div><p>seven</p></article>", "seven"),
        ("<article><div class='user-comments'>great post</div><div id=comments_area>y</div><p>eight</p></article>", "eight"),
        ("<article><div class='post comments-open'>nine</div></article>", "nine"),
        ("<article class=x class='menu'>ten</article>", "ten"),
        ("<main><p>a<p>b</main><footer>c</footer>", "a b"),
    ],
)
def test_markup(page, text):
    assert main(page) == text


def test_a_name_without_article():
    assert [(k, t) for k, t, _ in html.blocks("<div class='copyright'>c</div><div>text</div>")] == [("out", "c"), ("other", "text")]


def test_no_time_is_lost_on_broken_pages():
    pages = ["<article>" + "<b>x</i>" * 60_000, "<article>" + "<p a=\"" * 40_000, "<article>" + "<" * 200_000, "<a " + "x=' " * 50_000, "<article>" + "<iframe>" * 20_000 + "end", "<article>" + "<svg/>" * 60_000 + "end"]
    for p in pages:
        began = time.time()
        html.blocks(p)
        assert time.time() - began < 10, p[:30]


def test_odd_columns_and_long_pages(spark):
    long = "<article>" + "".join(f"<p>w{i} é</p>" for i in range(60_000)) + "</article>"
    rows = [(1, None, long, "k", 1), (2, "http://a.b/c", "<div class='teaser'>x</div><article>t<div class='teaser'>once</div></article>", "k", 2), (2, "http://a.b/c", None, None, 3)]
    got = {r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, kind string, row long")).collect()}
    assert got == {" ".join(f"w{i} é" for i in range(60_000)), "t once", ""}
