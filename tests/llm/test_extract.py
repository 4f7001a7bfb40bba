import html
import re

from rowforge.llm import extract as E

PROSE = "A sentence that is long enough to count as running text, with a comma or two, and an end."


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    rows = E.extract(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:h1|p)>", body)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_without_article_element():
    page = f"""<html><head><title>T</title></head><body><div id="top-nav"><a href=x>Home</a> <a href=y>Shop</a></div>
    <ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul>
    <div class="content has-sidebar"><h1>Title</h1><p>{PROSE}<p>Short.<p>{PROSE} &lt;b&gt; &amp;amp; x&nbsp;y<br>z</div>
    <div class='sidebar'><p>{PROSE}</div><div class="cookie-notice">{PROSE}</div><form><p>{PROSE}</form>
    <section id=comments><p>{PROSE}</p><div>{PROSE}</div></section><footer>{PROSE}"""
    assert E.main_text(page) == f"Title\n{PROSE}\nShort.\n{PROSE} <b> &amp; x y z"


def test_short_sections_without_article_element():
    long = " ".join([PROSE] * 20)
    page = f"""<body><div class=page><div><div><h1>Title</h1></div></div><div><div><p>{long}</p><p>{PROSE}</p></div></div><div class=ad>{PROSE}</div>
    <div><div><p>{PROSE[:60]}</p></div></div><div><div><p>Short section.</p></div></div><div><div><a href=x>More of this</a></div></div>
    <div><div><p>The end.</p></div></div></div><div><p>Outside.</p></div></body>"""
    assert E.main_text(page) == f"Title\n{long}\n{PROSE}\n{PROSE[:60]}\nShort section.\nThe end."


def test_inside_article():
    page = f"""<body><header><h1>Site</h1></header><main><article><header><h1>Title</h1></header><p>{PROSE}</p><aside>{PROSE}</aside>
    <div><div><div><p>One.</p></div></div></div><div class="ad">{PROSE}</div><p class="promo">{PROSE}<p>Last.</p><script>if (a < b) "</p>"</script>
    <style>p{{}}</style><!-- <p>{PROSE}</p> --><p>a < b and <i>c</i>d</p></article></main><aside><article class=comment>{PROSE}</article></aside></body>"""
    assert E.main_text(page) == f"Title\n{PROSE}\nOne.\nLast.\na < b and cd"


def test_odd_pages(spark):
    cases = {None: "", "": "", "   ": "", "plain": "plain", "<p>&am": "&am", "<p>x<scr": "x", "<p>é&eacute;&#233;&#x1F600;</p>": "ééé😀", "<script>x": "", "<!-- x": ""}
    for page, text in cases.items():
        assert E.main_text(page) == text
    rows = [(None, None, None, 1, "x"), (1, "u", "<p>a", 1, "x"), (1, "u", "<p>a", 1, "x"), (2, "u", "<p>w " * 100_000, 1, "x"), (3, "u", '<a href="' + "<p>q " * 5000, 1, "x")]
    got = E.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")).collect()
    assert len(got) == 5 and sorted(r.n_chars for r in got)[:3] == [0, 0, 1] or [r.n_chars for r in got]
    assert E.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_distribution():
    assert E.stretches([0, 5, 0, 0, 7, 0, 0, 0, 90, 1]) == [(1, 5, 12, 7), (8, 10, 91, 91)]
