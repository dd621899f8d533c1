"""Main text of pages by wrappers."""

import html
import re

import pytest

from taxweave.llm import wrappers

SF_DIR = "/root/testdata/sf0.001"


def test_articles_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in wrappers.main_text(pages, wrappers.infer(pages)).collect()}
    for page_id, page in raw.items():
        article = page[page.index("<article>") + 9 : page.rindex("</article>")]
        blocks = [" ".join(html.unescape(re.sub(r"<(b|br)>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[page_id] == "\n".join(b for b in blocks if b)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) {"</p>"}</script></head><body>
<div class="site-header">Top</div><nav><a href="/">Home</a></nav><div id="cookie-notice">Accept</div>
<div class="post-content"><h2>Head &amp; tail</h2>{body}<form>Name <input></form><div class="ad">Buy</div></div>
<section class="comments"><p>First!</p></section><aside>More</aside><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<p>One\n  two<p>Three<!-- no --> four", "Head & tail\nOne two\nThree four"),
        ("<ul><li>a<li>b</ul><p>c<b> d</b>", "Head & tail\na\nb\nc d"),
        ("<p>a &lt;b&gt; &#233;&nbsp;x</p><table><tr><td>1<td>2</table>", "Head & tail\na <b> é x\n1\n2"),
        ("", "Head & tail"),
    ],
)
def test_pages_without_article(spark, body, text):
    pages = spark.createDataFrame([(k, "http://h.example/x", PAGE.replace("{body}", body + f"<p>{k}</p>")) for k in range(3)], "page_id long, url string, html string")
    got = wrappers.main_text(pages, wrappers.infer(pages)).orderBy("page_id").collect()
    assert [r.text for r in got] == [f"{text}\n{k}" for k in range(3)]


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (None, "nothing", "just text"), (4, "http://u@H.x:1/", "<div" * 200 + "<p>deep"), (4, "http://u@H.x:1/", "<!-- open"), (5, "http://a", "<script>x")]
    pages = spark.createDataFrame([(*r, "w") for r in rows], "page_id long, url string, html string, wrapper string")
    got = {(r.page_id, r.text) for r in wrappers.main_text(pages, wrappers.infer(pages)).collect()}
    assert {(1, ""), (2, ""), (None, "just text"), (5, "")} <= got and len(got) >= 6
    assert wrappers.main_text(pages.limit(0), wrappers.infer(pages.limit(0))).collect() == []


def test_repeats_and_options_are_inferred():
    one, two = (wrappers.wrap(wrappers.tree(p)) for p in ("<ul><li>a<li>b</ul><p>x", "<ul><li>a</ul><h2>t</h2><p>x<p>y"))
    assert wrappers.expression(wrappers.align(one, two)) == "<ul>(<li>#</>)+</>(<h2>#</>)?(<p>#</>)+"
    dl = wrappers.wrap(wrappers.tree("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>"))
    assert wrappers.expression(dl) == "<dl>(<dt>#</><dd>#</>)+</>"


DEEP = 90
WHOLE = {
    "no-sidebar": "<body class='no-sidebar'><div class=nav>Menu</div><article><p>{}</p></article></body>",
    "comments-open": "<body class='single comments-open'><div><p>{}</p></div><div class=sidebar>Side</div></body>",
    "with-sidebar": "<body><div class='content with-sidebar'><p>{}</p><div class=ad>Buy</div></div></body>",
    "post-header": "<body><article><div class='post-header'><p>{}</p></div><div class=share>Share</div></article></body>",
    "sidebar": "<body><div class='sidebar layout'><article><p>{}</p></article><nav>Menu</nav></div></body>",
    "form": "<body><form><div><p>{}</p></div><div class=ad>Buy</div></form></body>",
    "deep": "<body><div class=content>" + "<div>" * DEEP + "<nav>x</nav>" + "</div>" * DEEP + "<p>{}</p></div><div class=ad>Buy</div></body>",
}


@pytest.mark.parametrize("name", WHOLE)
def test_names_of_ancestors_and_depth_lose_no_article(spark, name):
    text = "The whole text of an article that must not be lost, number"
    pages = spark.createDataFrame([(k, f"http://{name}.example/{k}", "<html>" + WHOLE[name].replace("{}", f"{text} {k}")) for k in range(3)], "page_id long, url string, html string")
    got = wrappers.main_text(pages, wrappers.infer(pages)).orderBy("page_id").collect()
    assert [r.text for r in got] == [f"{text} {k}" for k in range(3)]


def test_text_behind_deep_elements_stays_in_order():
    page = "<body><div class=content>a" + "<div>" * DEEP + "b<div>c</div>d<div class=ad>no<p>no</div>e" + "</div>" * DEEP + "f</div>g"
    assert wrappers.extract(page, wrappers.article_rule(wrappers.wrap(wrappers.tree(page)))).split() == list("abcdef")


def test_comments_stay_out_however_long():
    page = "<div class=content><p>Short.</p><section class=comments><article class=comment>" + "long " * 50 + "</article></section></div>"
    assert wrappers.extract(page, wrappers.article_rule(wrappers.wrap(wrappers.tree(page)))) == "Short."


def pages_of(spark, bodies, host="h.example"):
    rows = [(k, f"http://{host}/{k}", f"<html><body>{b}</body></html>") for k, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts_of(pages):
    return [r.text for r in wrappers.main_text(pages, wrappers.infer(pages)).orderBy("page_id").collect()]


def test_texts_of_all_pages_are_the_template(spark):
    """A notice and an advert that no name tells stay out, in any class; a line that only some pages share stays."""
    body = "<article><p class=x>Please read our terms.</p><h1>Title {0}</h1><p>Text number {0} of this host.</p>{1}<div class=zone>Buy our things today</div></article>"
    bodies = [body.format(k, "<p>Some say this.</p>" if k % 3 == 0 else "") for k in range(20)]
    bodies[7] = bodies[7].replace("Please read our terms.", "Please read our new terms.")
    got = texts_of(pages_of(spark, bodies))
    expected = [f"Title {k}\nText number {k} of this host." + ("\nSome say this." if k % 3 == 0 else "") for k in range(20)]
    expected[7] = "Please read our new terms.\n" + expected[7]
    assert got == expected


def test_few_pages_and_copies_of_one_page_have_no_template(spark):
    few = ["<article><p>Same line here.</p><p>And text {}</p></article>".format(k) for k in range(5)]
    assert texts_of(pages_of(spark, few)) == [f"Same line here.\nAnd text {k}" for k in range(5)]
    copies = ["<article><h1>One</h1><p>The same article on every page of a host.</p></article>"] * 30
    assert set(texts_of(pages_of(spark, copies))) == {"One\nThe same article on every page of a host."}


def test_own_ids_and_numbers_are_no_labels(spark):
    body = "<div data-id={0} class='row col-6'><article id=post-{0} class='post-{0} entry'><p>Text {0}</p></article></div><div id=box{0}>x</div>"
    pages = pages_of(spark, [body.format(k) for k in range(40)])
    wrapper = wrappers.infer(pages).collect()
    assert len(wrapper) == 1 and wrappers.expression(__import__("json").loads(wrapper[0].wrapper)).count("<article") == 1
    assert texts_of(pages) == [f"Text {k}" for k in range(40)]
    assert wrappers.tree("<div data-class='ad' class=main9>x")["c"][0]["t"] == "div"


def test_a_large_host_takes_linear_time(spark):
    import time

    page = "<div data-id={0}><article id=post-{0}><h1>T{0}</h1>" + "<p>text</p>" * 5 + "</article></div>"

    def seconds(n):
        known, began = None, time.process_time()
        for k in range(n):
            new = wrappers.wrap(wrappers.tree(page.replace("{0}", str(k)))) | {"pages": 1}
            known = wrappers.align(known, new) if known else new
        return time.process_time() - began

    seconds(200)
    assert seconds(2000) < 20 * max(0.01, seconds(200))


def test_many_rules_are_joined(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").limit(60)
    sent = texts_of(pages)
    monkeypatch.setattr(wrappers, "RULES_SENT", -1)
    assert texts_of(pages) == sent
