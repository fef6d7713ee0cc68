from html.parser import HTMLParser

from pyspark.sql import functions as F

from pagescout.functions import html as H
from pagescout.functions.steps import settle
from pagescout.operators import links as L
from pagescout.operators import signals as SG
from queryset import corpus as C


def signals(spark, html, url="https://h/x"):
    df = spark.createDataFrame([(1, url, html)], "page_id BIGINT, url STRING, html STRING")
    return SG.page_signals(df).first()


def flags(spark, cases, name):
    df = spark.createDataFrame([(i, "https://h/x", h) for i, (h, _) in enumerate(cases)], "page_id BIGINT, url STRING, html STRING")
    rows = SG.page_signals(df, signals={name: SG.SIGNALS[name]}).orderBy("page_id").collect()
    return [r[f"sig_{name}"] for r in rows]


def check(spark, cases, name):
    assert [(h, f) for (h, _), f in zip(cases, flags(spark, cases, name))] == cases


# url, html, score, product at 50, product at 15
PAGE_CASES = [
    ("https://example.com/product/123", '<html><head><meta property="og:type" content="product"></head><body></body></html>', 35, False, True),
    ("https://example.com/item/456", '<html><script type="application/ld+json">{"@type":"Product"}</script></html>', 40, False, True),
    ("https://example.com/about", "<html><body>About Us</body></html>", 0, False, False),
    ("https://example.com/p/789", '<html><body><div class="breadcrumb">Home > Products > Product Name</div></body></html>', 30, False, True),
]


def test_page_cases_at_both_thresholds(spark):
    df = spark.createDataFrame([(i, u, h) for i, (u, h, *_) in enumerate(PAGE_CASES)], "page_id BIGINT, url STRING, html STRING")
    at50 = SG.page_signals(df).orderBy("page_id").collect()
    at15 = SG.page_signals(df, threshold=15).orderBy("page_id").collect()
    got = [(u, h, a.score, a.is_product, b.is_product) for (u, h, *_), a, b in zip(PAGE_CASES, at50, at15)]
    assert got == PAGE_CASES
    without = SG.page_signals(df, weights={"structured_data": 0}).orderBy("page_id").collect()
    assert [r.score for r in without] == [35, 20, 0, 30]


def test_meta(spark):
    check(spark, [
        ('<meta property="og:type" content="Product">', True),
        ("<META content='product' Property='og:type'/>", True),
        ("<meta property=og:type content=product>", True),
        ('<meta property="og:type" content="website"><meta property="og:type" content="product">', False),
        ('<meta property="og:type" content="&#112;roduct">', True),
        ('<meta name="description" content="product">', False),
        ('<meta name="Product:price">', True),
        ('<meta property="x-product">', True),
        ('<!-- <meta property="og:type" content="product"> -->', False),
        ('<script>"<meta name=product>"</script>', False),
        ('<title><meta name=product></title>', False),
        ('<meta data-name="product" content="x">', False),
        ('<meta title=" name=product" content="x">', False),
        ("<metadata name=product>", False),
    ], "meta")


def test_breadcrumb(spark):
    check(spark, [
        ('<div class="breadcrumb">Home &gt; Products</div>', True),
        ("<ol class='x bc y'><li>Item</li></ol>", True),
        ("<nav class=breadcrumb-trail>all details</nav>", True),
        ('<div class="breadcrumbs-x">product</div>', False),
        ('<div class="Breadcrumb">product</div>', False),
        ('<div class="breadcrumb"><div>Home</div></div><div>product</div>', False),
        ('<div class="breadcrumb"><div>Home</div> &gt; <b>Pro</b>duct</div>', True),
        ('<div class="bc">a <span class="bc">b</span> product</div>', True),
        ('<div class="bc"><script>{"item": "<a>"}</script></div>', True),
        ('<div class="bc">home</div><p>product</p>', False),
        ("<div title='a > b' class='bc'>product</div>", True),
        ("<p>product</p>", False),
    ], "breadcrumb")


def test_anchor_text(spark):
    check(spark, [
        ("<button>BUY NOW</button>", True),
        ('<a href="#">Add to <b>Cart</b></a>', True),
        ("<a>view product", True),
        ("<p>buy now</p><a>x</a>", False),
        ("<a>buy</a> now", False),
        ("<a title='a > buy now'>x</a>", False),
        ("<abbr>buy now</abbr>", False),
        ("<!-- <a>buy now</a> -->", False),
        ("<a>Buy\nNow</a>", False),
        ("<a>shop now</a>", True),
    ], "anchor_text")


def test_structured_data(spark):
    ld = '<script type="application/ld+json">%s</script>'
    check(spark, [
        (ld % '{ "@type" : "Product" }', True),
        (ld % "{'@type':'product'}", True),
        (ld % '{"@type":"ProductGroup"}', False),
        (ld % '{"@type":"Offer"}', False),
        ('<script>{"@type":"Product"}</script>', False),
        ("<!--" + ld % '{"@type":"Product"}' + "-->", False),
        (ld % "{}" + ld % '{"@type":"Product"}', True),
        ("<SCRIPT id=x TYPE=application/ld+json>{\"@type\":\"Product\"}</SCRIPT>", True),
        ('<p>application/ld+json "@type":"product"</p>', False),
    ], "structured_data")


def test_canonical(spark):
    check(spark, [
        ('<link rel="canonical" href="https://h/product/1">', True),
        ("<link href=/shop/ rel=canonical>", True),
        ('<link rel="canonical" href="https://h/shop">', False),
        ('<link rel="stylesheet" href="/product/x.css">', False),
        ('<link rel="canonical" href="/a"><link rel="canonical" href="/p/1">', False),
        ('<link rel="canonical">', False),
    ], "canonical")


def test_anchor_density_is_strict(spark):
    # html, head, body + 3 a of 10 elements is exactly 0.3; one element less is above it.
    body = "<html><head></head><body>%s</body></html>"
    exact = body % ("<a>x</a>" * 3 + "<p>y</p>" * 4)
    above = body % ("<a>x</a>" * 3 + "<p>y</p>" * 3)
    check(spark, [(exact, False), (above, True), ("<a>x</a><a>y</a>", True), ("", False)], "anchor_density")
    assert signals(spark, exact).anchor_density == 0.3
    assert signals(spark, "<a>x</a>").anchor_density == 0.25


def test_hrefs_and_pagination(spark):
    html = """<a href="/a?x=1&amp;y=2">1</a><A HREF='/b'>2</A><a href=/c>3</a><a name=x>4</a><a href>5</a>
      <!-- <a href="/no"> --><script>'<a href="/no">'</script><a data-href="/no" href="/d">n</a><noscript><a href="/no"></noscript>
      <a title="x > y" href="/e">Next page</a><a rel="nofollow next" href="/f">6</a><a href="/a?x=1&amp;y=2">again</a>"""
    df = spark.createDataFrame([(1, "https://h/d/", html)], "page_id BIGINT, url STRING, html STRING")
    got = [r.href for r in L.anchor_hrefs(df).orderBy("pos").collect()]
    assert got == ["/a?x=1&y=2", "/b", "/c", "", "/d", "/e", "/f", "/a?x=1&y=2"]
    links = [(r.pos, r.dst) for r in L.page_links(df).orderBy("pos").collect()]
    assert links == [(0, "https://h/a?x=1&y=2"), (1, "https://h/b"), (2, "https://h/c"), (4, "https://h/d"), (5, "https://h/e"), (6, "https://h/f")]
    assert {r.reject_reason: r.links for r in L.rejection_counts(L.judged_links(df)).collect()} == {"invalid_link": 1}
    assert {r.dst for r in L.next_page_links(df).collect()} == {"https://h/e", "https://h/f"}


def test_entities(spark):
    text = "a&amp;b &lt;x&gt; &#65;&#x42; &#8364;; &#xD800; &#; &nbsp;| &amp;lt; &unknown;"
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(H.decode_entities(F.col("t"))).first()[0] == "a&b <x> AB €; \ufffd &#; \xa0| &lt; &unknown;"


def test_long_broken_page_costs_no_stack(spark):
    html = "<a " + "x='y\" " * 200_000 + "<!-- " + "<" * 100_000 + "<div class='"
    assert signals(spark, html).score == 0


class _Anchors(HTMLParser):
    """Independent count of elements and links with the parser of the standard library."""

    RAW = {"script", "style", "title", "textarea", "noscript", "iframe"}

    def __init__(self):
        super().__init__()
        self.hrefs, self.tags, self.raw = [], 0, None

    def handle_starttag(self, tag, attrs):
        if self.raw:
            return
        self.tags += 1
        self.raw = tag if tag in self.RAW else None
        if tag == "a":
            self.hrefs += [v or "" for k, v in attrs if k == "href"][:1]

    def handle_endtag(self, tag):
        if tag == self.raw:
            self.raw = None


def test_pages_agree_with_a_parser(spark):
    """All pages of the small data set: links and element counts equal to a parser's."""
    pages = C.pages(spark, "/root/testdata/sf0.001")
    rows = SG.with_markup(pages).select("html", H.anchor_hrefs(F.col("_tags")).alias("hrefs"), F.size("_tags").alias("tags")).collect()
    differ = 0
    for r in rows:
        parser = _Anchors()
        parser.feed(r.html)
        differ += (parser.hrefs, parser.tags) != (r.hrefs, r.tags)
    assert (len(rows), differ) == (300, 0)


def test_signal_registry_accepts_new_signals(spark):
    df = spark.createDataFrame([(1, "https://h/x", "<p>price: 5</p>")], "page_id BIGINT, url STRING, html STRING")
    own = {**SG.SIGNALS, "price": lambda p: p.markup.contains("price")}
    row = SG.page_signals(df, own, {"price": 60}).first()
    assert (row.sig_price, row.score, row.is_product) == (True, 60, True)


def test_html_is_read_once(spark):
    """The scan reads the columns of the query only, and the text is cleaned one time."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = SG.product_pages(SG.page_signals(pages))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("noembed") <= 2 * 3  # markup once; the breadcrumb branch has its own form
    assert "Exchange" not in plan
    narrow = SG.page_signals(pages, signals={"url_pattern": SG.SIGNALS["url_pattern"]})
    assert "ReadSchema: struct<page_id:bigint,url:string>" in narrow._jdf.queryExecution().executedPlan().toString()


def test_references_are_decoded_once_and_like_the_standard_library(spark):
    import html as lib

    texts = ["/caf&eacute;", "&#38;lt;", "&#38;amp;x", "&#150;", "&#x80;", "a&b&c", "&", "&&amp;&", "&notit;", "&copy=1", "&nosuch;", "&#0;", "&#xD800;",
             "&#1114112;", "&#99999999999999;", "&#x1F600;", "&#;", "&#x;", "&#00065", "&amp;lt;", "&CounterClockwiseContourIntegral;", "&NotEqualTilde;", "", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(H.decode_entities(F.col("t"))).collect()]
    assert got == [lib.unescape(t) for t in texts]


def test_breadcrumbs_of_a_long_page_take_linear_time(spark):
    import time

    from pagescout.operators import signals as SG

    def page(n, last):
        return "<html><body>" + "".join(f'<div class="bc"><img class="bc"><span>crumb {i}</span></div>' for i in range(n)) + last + "</body></html>"

    rows = [(1, "https://e.com/x", page(4000, "")), (2, "https://e.com/y", page(4000, "<nav class=bc><nav>a</nav> product</nav>")), (3, "https://e.com/z", page(3, "<p>product</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").cache()
    df.count()

    def run():
        return {r[0]: r[1] for r in SG.page_signals(df, {"breadcrumb": SG.SIGNALS["breadcrumb"]}).select("page_id", "sig_breadcrumb").collect()}

    assert run() == {1: False, 2: True, 3: False}
    start = time.time()
    run()
    print("seconds", time.time() - start)
    assert time.time() - start < 6


def test_breadcrumbs_end_where_html_ends_them(spark):
    cases = [
        ("<ul><li class=breadcrumb>Home<li>Rest<li class=breadcrumb>Shop</ul>after", ["Home", "Shop"]),
        ("<ul><li class=breadcrumb>Home<li class=breadcrumb>Shop</li></ul>after", ["Home", "Shop"]),
        ("<ul><li class=breadcrumb>a<ul><li>b<li>c</ul>d</li><li>e</ul>", ["abcd"]),
        ("<ul><li class=breadcrumb>a<ol><li>b</li></ol>c<li>d</ul>", ["abc"]),
        ("<ul><li>x<ul><li class=breadcrumb>a</ul>b</ul>", ["a"]),
        ("<p class=breadcrumb>Home<p>Rest", ["Home"]),
        ("<div><p class=breadcrumb>Home <b>Shop</b></div>Rest", ["Home Shop"]),
        ("<p class=breadcrumb>Home<br><img src=x>Shop<hr>Rest", ["HomeShop"]),
        ("<dl><dt class=breadcrumb>Home<dd class=breadcrumb>Shop</dl>Rest", ["Home", "Shop"]),
        ("<select><option class=breadcrumb>Home<option>Rest</select>", ["Home"]),
        ("<table><tr><td class=breadcrumb>Home<td>Rest</table>", ["Home"]),
        ("<table><tr><td class=breadcrumb>a<table><tr><td>b<td>c</table>d<tr><td>e</table>", ["abcd"]),
        ("<table><tr class=breadcrumb><td>Home<td>Shop<tr><td>Rest</table>", ["HomeShop"]),
        ("<ul class=breadcrumb><li>Home<li>Shop</ul>Rest", ["HomeShop"]),
        ("<div class=breadcrumb><p>Home<p>Shop</div>Rest", ["HomeShop"]),
        ("<div class=breadcrumb>never closed<p>at all", ["never closedat all"]),
    ]
    df = spark.createDataFrame([(i, page) for i, (page, _) in enumerate(cases)], "i INT, html STRING")
    pieces = H.breadcrumb_pieces(F.col("html"), F.array(F.col("html"), F.lit("<x class=breadcrumb>")))
    df = settle(df.withColumn("pieces", pieces), "pieces")
    df = settle(df.withColumn("spans", H.breadcrumb_spans(F.col("pieces"))), "spans")
    got = {r.i: r.texts for r in df.select("i", H.breadcrumb_texts(F.col("pieces"), F.col("spans")).alias("texts")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_an_attribute_is_read_by_one_match(spark):
    tags = ["<a href=\"/x\">", "<a href='/y'>", "<a href=/z\">", "<a href=\"/open>", "<a href=''>", "<a href>", "<a title=\"href=/t\" HREF = /u>", "<a href=\"it's &amp; more\">", "<a title='a > b' href=/v'\">"]
    df = spark.createDataFrame([(t,) for t in tags], "tag string")
    got = [r[0] for r in df.select(H.attribute(F.col("tag"), "href")).collect()]
    assert got == ["/x", "/y", "/z", "", "", "", "/u", "it's & more", "/v'"]
    # A lambda computes an expression as often as it is written: once where references are read, once where there are none.
    written = str(H.attribute(F.col("tag"), "href"))
    assert written.count("regexp_extract(tag") + written.count("regexp_replace(regexp_extract(tag") == 2
