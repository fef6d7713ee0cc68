import random

import pytest
from pyspark.sql import functions as F

from pagescout import settings as S
from pagescout.functions import urls as U


def normal(spark, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i INT, url STRING")
    return [r.key for r in U.with_normal_url(df, "url", "key").orderBy("i").collect()]


NORMAL = {
    "https://H.com/": "https://h.com",
    "https://h.com": "https://h.com",
    "HTTP://u:Pw@Example.COM:80/a/./b//../c/?b=2&a=1&a=0#x": "http://u:Pw@example.com:80/a/c?a=1&a=0&b=2",
    "https://h/für": "https://h/f%C3%BCr",
    "https://h/a%2Fb": "https://h/a%2Fb",
    "https://h/a%2Fb/": "https://h/a/b",
    "https://h/a(b)": "https://h/a(b)",
    "https://h/x?": "https://h/x",
    "https://h/x?q=a b*~;c&z": "https://h/x?z=",
    "https://h/x?q=a b*~&z": "https://h/x?q=a+b%2A~&z=",
    "https://h/x?a=%zz&b=1": "https://h/x?b=1",
    "http://h:ABC/": "http://h:abc/",
    "https://H/%zz": "https://h/%zz",
    "1A:b": "1a:b",
    "mailto:X@y": "mailto:X@y",
    "//H/x/": "//h/x",
    "../x/./y": "../x/y",
    "http://münchen.de/x": "http://m%C3%BCnchen.de/x",
    "https://h/../../q": "https://h/q",
    "https://h/.well-known/x": "https://h/.well-known/x",
    "https://h/the,": "https://h/the,",
    "": "",
}


def test_normal_form(spark):
    assert dict(zip(NORMAL, normal(spark, NORMAL))) == NORMAL


def test_normal_form_properties(spark):
    rng = random.Random(7)
    chars = ["a", "B", "7", "/", "//", ".", "..", "/./", "/../", "ü", "%20", "%2F", "é", ",", "(", "*", "~"]
    urls = []
    for _ in range(400):
        path = "/" + "".join(rng.choice(chars) for _ in range(rng.randrange(9)))
        params = [f"{rng.choice('abc')}={rng.choice(['', '1', 'ü', '%41', 'x y'])}" for _ in range(rng.randrange(4))]
        urls.append((f"HTTPS://Shop{rng.randrange(5)}.example.com{path}", params))
    plain = normal(spark, [u + ("?" + "&".join(p) if p else "") for u, p in urls])
    assert normal(spark, plain) == plain
    assert normal(spark, [u + ("?" + "&".join(p) if p else "") + "#frag" for u, p in urls]) == plain
    # Order of parameters with different names does not matter.
    by_name = [sorted(p, key=lambda x: x[0], reverse=True) for _, p in urls]
    swapped = [u + ("?" + "&".join(p) if p else "") for (u, _), p in zip(urls, by_name)]
    assert normal(spark, swapped) == plain


def test_normal_form_without_query(spark):
    urls = ["//H.com/a/?x=1#f", "h.com/a", "https://H.com/A/?q", "http://H/für", "http://h:x/Y"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i INT, url STRING")
    got = [r.key for r in df.select("i", U.normalize_url_no_query(F.col("url")).alias("key")).orderBy("i").collect()]
    assert got == ["https://h.com/a/", "https://h.com/a", "https://h.com/A/", "http://h/f%C3%BCr", "http://h:x/y"]


# url, matched by pattern, matched by pattern or parameter
URL_CASES = [
    ("https://example.com/product/123", True, True),
    ("https://example.com/item/456", True, True),
    ("https://example.com/p/789", True, True),
    ("https://example.com/about", False, False),
    ("https://example.com/page?product_id=123", False, True),
    ("https://example.com/x-PROD12", True, True),
    ("https://example.com/x-prod", False, False),
    ("https://example.com/product.html", True, True),
    ("https://example.com/productahtml", False, False),
    ("https://example.com/x?next=/shop/", True, True),
    ("https://example.com/x?%73ku=1", False, True),
    ("https://example.com/x#?item=1", False, False),
]


def test_product_url_cases(spark):
    df = spark.createDataFrame([(u,) for u, _, _ in URL_CASES], "url STRING")
    col = F.col("url")
    rows = df.select("url", U.matches_product_url(col), U.url_looks_like_product(col)).collect()
    assert [tuple(r) for r in rows] == URL_CASES


def test_product_sitemap(spark):
    cases = [("https://h/sitemap.xml", True, False), ("https://h/products.xml", True, True), ("https://h/pages.xml", False, False)]
    df = spark.createDataFrame([(u,) for u, _, _ in cases], "url STRING")
    col = F.col("url")
    rows = df.select("url", U.is_product_sitemap(col), U.is_product_sitemap(col, strict=True)).collect()
    assert [tuple(r) for r in rows] == cases


BASE = "https://b.com:80/d/e?k=v"
LINKS = [
    ("x", "https://b.com:80/d/x", None),
    ("?q=1", "https://b.com:80/d/e?q=1", None),
    ("?", "https://b.com:80/d/e", None),
    ("#a", "https://b.com:80/d/e?k=v", None),
    ("#", None, "invalid_link"),
    ("  ", None, "invalid_link"),
    ("javascript:void(0)", None, "invalid_link"),
    ("JavaScript:void(0)", None, "invalid_scheme"),
    ("mailto:a@b", None, "invalid_scheme"),
    ("TEL:1", None, "invalid_scheme"),
    ("ftp://b.com:80/x", None, "invalid_scheme"),
    ("\t/p q\n", "https://b.com:80/p%20q", None),
    ("http://e.com/", None, "external_domain"),
    ("https://b.com/x", None, "external_domain"),
    ("https://www.b.com:80/x", None, "external_domain"),
    ("//B.com:80/z/", "https://b.com:80/z", None),
    ("../../u", "https://b.com:80/u", None),
    ("/w/../z/.", "https://b.com:80/z", None),
    ("für", "https://b.com:80/d/f%C3%BCr", None),
    ("http://[bad", None, "unparsable_link"),
    ("1:2", None, "unparsable_link"),
    ("/a%2eJPG", None, "non_html_resource"),
    ("/v1.5/list", "https://b.com:80/v1.5/list", None),
    ("/x.pdf?download=1", None, "non_html_resource"),
] + [(f"/file{e.upper()}", None, "non_html_resource") for e in S.ASSET_EXTENSIONS]


def test_links(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _, _) in enumerate(LINKS)], "i INT, href STRING")
    based = U.with_base_parts(df.withColumn("base", F.lit(BASE)), "base")
    rows = U.with_link_target(based, "href").orderBy("i").collect()
    assert [(r.href, r.dst, r.reject_reason) for r in rows] == LINKS


@pytest.mark.parametrize("bad", ["dst is not null", "dst like 'https%'"])
def test_filter_on_link_target_keeps_a_small_plan(spark, bad):
    """A filter on the last column of the chain must not repeat the chain."""
    df = spark.createDataFrame([("x",)], "href STRING").withColumn("base", F.lit(BASE))
    plan = U.with_link_target(U.with_base_parts(df, "base"), "href").where(bad)
    assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 200_000
