import html
import re
import time

from quillgraph.llm import html_tree as ht
from quillgraph.llm import html_wrapper as hw

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- x --><div class="ad">Buy</div>
<div id="cookie-notice">We use cookies</div>
<article><header><h1>Head&amp;line</h1><span>by me</span></header><p>One <b>two</b>\n three&nbsp;four<p>Open <i>para<br>graph
<div class="share-box">Share</div><ul><li>x<li>y</ul><form><input value="q">Send</form>{body}</article>
<section class="comments"><p>Great read, thanks a lot for this very long and very kind comment on all of it</p></section>
<aside>Side</aside><footer>&copy; us</footer></body></html>"""


def test_article_of_a_page():
    want = "Head&line\nOne two three four\nOpen para graph\nx\ny\nlast"
    assert hw.article(PAGE.replace("{body}", "<p>last"), None) == want


def test_pages_without_an_article_element():
    page = "<body><div id=menu>a b c</div><div class=wrap><div class=text><p>First paragraph of the text here.</p><p>Second paragraph of it.</p></div><div class=sidebar>Links</div></div></body>"
    assert hw.article(page, None) == "First paragraph of the text here.\nSecond paragraph of it."


def wrapper(pages):
    out = None
    for p in pages:
        items = ht.items_of(ht.parse(p))
        own = ["html", 0, items, sum(i[3] for i in items), 1]
        out = ht.merge_item(out, own) if out else own
    return out


def test_mismatches_become_optional_repeated_and_slots():
    got = ht.expression(wrapper(["<div><h2>A</h2><p>x</p></div>", "<div><h2>B</h2><p>y</p><p>z</p></div>", "<div><h2>C</h2><ul><li>1</ul><p>w</p></div>"])[2])
    assert got == "<div><h2>#</>(<ul><li>'1'</></>)?(<p>#</>)+</>"


def test_template_text_of_a_host_goes():
    pages = [f"<body><article><h1>Title {i}</h1><div>Read more on our site</div><p>Text number {i} of it</p></article></body>" for i in range(9)]
    rule = hw.Rule(wrapper(pages))
    assert hw.article(pages[3], rule) == "Title 3\nText number 3 of it"
    copies = hw.Rule(wrapper([pages[0]] * 9))
    assert hw.article(pages[0], copies) == "Title 0\nRead more on our site\nText number 0 of it"


def test_strange_pages():
    for page in [None, "", "<", "<<<>>>", "<p", "text only", "</div></p>", "<div " * 50, '<a href="x>broken <p>q</p>', "<div>" * 3000 + "deep" + "</div>" * 3000, "<script>never closed", "&#0;&bogus;&lt;b&gt;"]:
        assert isinstance(hw.article(page, None), str)
    assert hw.article("text only", None) == "text only"
    assert hw.article("<div>" * 3000 + "deep", None) == "deep"


def plain(page):
    """The articles of the test tables, which have one article element each, read with patterns alone."""
    inner = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    blocks = re.split(r"</?(?:p|h1|div|ul|li)[^>]*>", inner)
    return "\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split())))


def test_all_pages_of_the_table(spark, sf_dir, monkeypatch):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = hw.query(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == plain(rows[r.page_id]) and r.n_chars == len(r.text)
    monkeypatch.setattr(hw, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(hw, "GROUP", 3)
    monkeypatch.setattr(hw, "FAN", 2)
    assert {r.page_id: r.text for r in hw.query(spark, sf_dir).collect()} == {r.page_id: r.text for r in got}


def test_null_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (2, None, "<p>a"), (None, "http://h/x", "<article>b"), (None, "http://h/x", "<article>b")], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.text) for r in hw.extract(pages).collect()) == [("1", ""), ("2", "a"), ("None", "b"), ("None", "b")]
    assert hw.extract(pages.limit(0)).count() == 0


def test_depth_loses_nothing():
    for n in (10, 100, 3000):
        body = "<div>" * n + "<p>one</p><div>two</div><div>three</div><div class=ad>Buy</div><nav>Menu</nav><b>bold</b> text" + "</div>" * n
        page = f"<body><div class=page><article>{body}<p>rest</p></article></div><p>outside</p></body>"
        assert hw.article(page, None) == "one\ntwo\nthree\nbold text\nrest", n
    deep = "<div>" * 100 + "<div>around</div><article><header><h1>Head</h1>by me</header><p>text</article>" + "</div>" * 100
    assert hw.article(deep, None) == "Head\ntext"


def neutral(i, classes=False):
    """A page without telling names: the third box is the article, with a line that all pages have; on every fifth page another box is larger."""
    words = lambda k, m: " ".join(f"w{k}x{j}" for j in range(m))
    aside = words(f"s{i}", 200 if i % 5 == 0 else 12)
    body = "".join(f"<z>{words(f'b{i}q{j}', 6 if i % 5 == 0 else 60)}</z>" for j in range(1 + i % 3))
    boxes = ["<a href=x>One</a> <a href=y>Two</a>", aside, f"<z>Title {i}</z><z>Kept by all of us here</z>{body}"]
    if i % 4 == 1 and classes:
        boxes.insert(1, f"<z>{words(f'o{i}', 3)}</z>")
    return "<body>" + "".join(f"<div>{b}</div>" for b in boxes) + "</body>", [f"Title {i}", *[words(f"b{i}q{j}", 6 if i % 5 == 0 else 60) for j in range(1 + i % 3)]]


def test_place_and_boilerplate_come_from_the_pages_of_the_host():
    for classes in (False, True):
        pages = [neutral(i, classes) for i in range(20)]
        sources = [p.replace("<z", "<p").replace("</z", "</p") for p, _ in pages]
        if classes:
            sources = [s.replace("<div><p>Title", "<div class='q7 k'><p>Title").replace("<div>w", "<div class=r>w") for s in sources]
        rule = hw.Rule(wrapper(sources))
        for s, (_, want) in zip(sources, pages, strict=True):
            assert hw.article(s, rule) == "\n".join(want)
        alone = [hw.article(s, None) for s in sources]
        assert sum(a == "\n".join(w) for a, (_, w) in zip(alone, pages, strict=True)) == 0  # the line of all pages stays
        assert sum("Title" not in a for a in alone) == 4  # and another box is taken


def test_both_ways_to_the_pages_agree(spark, monkeypatch):
    rows = [(100 * h + i, f"http://h{h}.x/{i}", neutral(i + h)[0].replace("<z", "<p").replace("</z", "</p")) for h in range(3) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    want = {r.page_id: r.text for r in hw.extract(pages).collect()}
    for held, fan, group in ((1, 2, 1), (2, 3, 7), (5000, 32, 256)):
        for name, value in (("HELD", held), ("FAN", fan), ("GROUP", group), ("BROADCAST_BYTES", 1)):
            monkeypatch.setattr(hw, name, value)
        assert {r.page_id: r.text for r in hw.extract(pages).collect()} == want


def test_long_pages_take_time_in_proportion():
    n = 1_000_000
    pages = ["<a " * (n // 3), "<a " * (n // 3) + ">", "<a>" * (n // 3), "<div>" * (n // 5), "<p><b>" * (n // 6), "<!" * (n // 2), "<a x='" * (n // 6), "<p><div>" + "<center>" * (n // 8), "<ul>" + "<li>x" * (n // 5), "x " * (n // 2), "&amp;" * (n // 5), "".join(f"<div class=c{chr(97 + i % 26)}>x</div><p>y</p>" for i in range(n // 30))]
    for page in pages:
        began = time.process_time()
        assert isinstance(hw.article(page, None), str)
        hw.Rule(wrapper([page, page]))
        assert time.process_time() - began < 90, page[:30]
