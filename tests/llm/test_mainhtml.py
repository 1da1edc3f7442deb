"""Extraction on hand-made pages and, by a second way, on the whole table."""

import html
import re

from tessera.llm import mainhtml, queries


def text(page, **kw):
    return mainhtml.main_text(mainhtml.parse(page), **kw)


def test_page_parts():
    page = """<html><head><title>t</title></head><body><header><a>Logo</a></header><div id="cookie-banner">We use cookies</div><nav>m</nav>
    <main><article><header><h1>Ti &amp; tle</h1><span>by x</span></header><p>One
 two<p>three <b>four</b><div class="ad-slot">buy</div><ul><li>a<li>b</ul><!-- c --><script>if(a<b){}</script><form>q</form>
    <table><tr><td>x<td>y</table></article><section id="comments"><p>nice!</p></section></main><aside>s</aside><footer>f</footer></body></html>"""
    assert text(page) == "Ti & tle\nOne two\nthree four\na\nb\nx\ny"


def test_broken_markup():
    assert text("a < b <b>c</b> & d &lt;p&gt;<p title=\"x>y\">z") == "a < b c & d <p>\nz"
    assert text("") == "" and text("<") == "<" and text("<p") == ""
    assert text("<div>" * 3000 + "deep") == "deep"
    assert text("<script>x") == "" and text("<!-- never closed <p>x") == ""
    assert text("<p>a<br>b&nbsp;c</p>") == "a b c"


def test_whole_table(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op3_mainhtml(spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_templates_both_ways(spark):
    rows = [(i, f"http://h.com/{i}", f"<body><div><div>Menu here</div></div><div>text {i} body</div></body>") for i in range(8)]
    rows += [(99, None, None), (None, "x", ""), (7, "http://h.com/7", rows[7][2]), (50, "http://other.com/", "<body><div>Menu here</div><p>own</p></body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as host")
    want = sorted([(i, f"text {i} body") for i in range(8)] + [(99, ""), (-1, ""), (7, "text 7 body"), (50, "Menu here\nown")])
    for shipped in (1000, 0):
        got = mainhtml.extract(df, shipped=shipped).collect()
        assert sorted((-1 if r.page_id is None else r.page_id, r.text) for r in got) == want
    assert mainhtml.extract(df.where("false")).count() == 0


def extracted(spark, pages):
    df = spark.createDataFrame([(i, url, page) for i, (url, page) in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in mainhtml.extract(df).collect()}


def test_templates_decide(spark, monkeypatch):
    """Boxes without a telling tag or name, outside and inside the article, and on pages without any article element."""
    bare = lambda i: f"<body><div>Site of things<ul><li>one<li>two</ul></div><div><h2>T{i}</h2><p>Body of {i}</p></div><div>All about us</div></body>"
    inside = lambda i: f"<body><article><h1>T{i}</h1><p>Body of {i}</p><div>Read more of it here</div><p>End {i}</p></article></body>"
    pages = [(f"http://a.org/{i}", bare(i)) for i in range(6)] + [(f"http://b.org/{i}", inside(i)) for i in range(6)]
    got = extracted(spark, pages)
    assert [got[i] for i in range(6)] == [f"T{i}\nBody of {i}" for i in range(6)]
    assert [got[6 + i] for i in range(6)] == [f"T{i}\nBody of {i}\nEnd {i}" for i in range(6)]
    none = mainhtml.templates_of
    monkeypatch.setattr(mainhtml, "templates_of", lambda rows, least: none(rows, 1 << 30))
    got = extracted(spark, pages)
    assert "Site of things" in got[0] and "Read more of it here" in got[6]


def test_a_large_host_has_no_other_bar(spark):
    pages = [(f"http://a.org/{i}", f"<body><div>Text {i} alone</div>{'<div>On some pages</div>' if i < 5 else ''}</body>") for i in range(3000)]
    got = extracted(spark, pages)
    assert set(got.values()) == {f"Text {i} alone" for i in range(3000)}


def test_names_inside_the_article():
    page = "<article><h1>A</h1><div class='notice'>Mind the gap</div><section id='related-work'><p>Others</p></section><p class='login-help'>Log in</p><div class='comments'>hi</div><div class='ad-box'>buy</div></article>"
    assert text(page) == "A\nMind the gap\nOthers\nLog in"


def test_deep_nesting_is_linear():
    import time

    def took(n):
        t = time.perf_counter()
        mainhtml.parse("<p><button>" + "<div></span></i>" * n + "x")
        return time.perf_counter() - t

    took(1000)
    assert took(40_000) < 20 * max(took(8000), 0.02)


def test_copies_make_no_template(spark):
    rows = [(i, f"http://h.com/{i}", "<body><div class='x'>Same article</div><div>and more</div></body>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in mainhtml.extract(df).collect()} == {"Same article\nand more"}
