from pagescout.operators import frontier as FR
from pagescout.operators import sitemaps as SM

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def urlset(*locs):
    return f"<?xml version='1.0'?><!-- x --><urlset {NS}>" + "".join(f"<url><loc>{u}</loc><priority>1</priority></url>" for u in locs) + "</urlset>"


def index(*locs):
    return f"<sitemapindex {NS}>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in locs) + "</sitemapindex>"


DOCUMENTS = [
    ("https://a/sitemap.xml", 200, urlset(" https://a/1 \n", "https://a/x.jpg", "https://other/2?a=1&amp;b=2")),
    ("https://a/sitemap-index.xml", 200, index("https://a/products.xml", "https://a/pages.xml", "https://a/sitemap-index.xml", "https://a/broken-item.xml", "https://a/gone-item.xml")),
    ("https://a/products.xml", 200, urlset("https://a/p/3", "https://a/1")),
    ("https://a/pages.xml", 200, urlset("https://a/about")),
    ("https://a/broken-item.xml", 200, "<urlset><url><loc>https://a/no</loc>"),
    ("https://b/sitemap.xml", 404, urlset("https://b/no")),
    ("https://b/sitemap_index.xml", 200, '<s:urlset xmlns:s="x"><s:url><s:loc>https://b/4</s:loc></s:url></s:urlset>'),
    ("https://c/sitemap.xml", 200, "<html><url><loc>https://c/no</loc></url></html>"),
    ("https://d/sitemap.xml", 200, ""),
]


def run(spark, strict=False):
    seeds = spark.createDataFrame([("https://a/",), ("https://b",), ("https://c",), ("https://d//",)], "url STRING")
    maps = spark.createDataFrame(DOCUMENTS, "url STRING, status INT, body STRING")
    rows = SM.sitemap_products(FR.seed_frontier(seeds), maps, strict).collect()
    return {(r.domain, r.url) for r in rows}


def test_sitemap_products(spark):
    assert run(spark) == {
        ("a", "https://a/1"), ("a", "https://a/x.jpg"), ("a", "https://other/2?a=1&b=2"),
        ("a", "https://a/p/3"), ("b", "https://b/4"),
    }


def test_strict_sitemaps_skip_plain_names(spark):
    assert run(spark, strict=True) == {("a", "https://a/p/3"), ("a", "https://a/1")}


def test_the_spelling_of_a_seed_does_not_matter(spark):
    maps = spark.createDataFrame([("https://shop1.com/sitemap.xml", 200, urlset("https://shop1.com/p/1")), ("https://x:8443/sitemap-index.xml", 200, index("HTTPS://X:8443/item.xml#a")), ("https://x:8443/item.xml", 200, urlset("https://x/p"))], "url STRING, status INT, body STRING")
    for seed in ("https://shop1.com/", "https://SHOP1.com/", "HTTPS://shop1.com", "https://shop1.com/#top", "https://Shop1.com#x"):
        seeds = FR.seed_frontier(spark.createDataFrame([(seed,)], "url STRING"))
        assert [r.url for r in SM.sitemap_products(seeds, maps).collect()] == ["https://shop1.com/p/1"], seed
    seeds = FR.seed_frontier(spark.createDataFrame([("https://X:8443",)], "url STRING"))
    assert [r.url for r in SM.sitemap_products(seeds, maps).collect()] == ["https://x/p"]


def test_default_ports_do_not_hide_a_sitemap(spark):
    seeds = spark.createDataFrame([("https://a:443/",), ("http://b:80",), ("https://c",), ("https://d:80",), ("http://e:8080",)], "url STRING")
    maps = [("https://a/sitemap.xml", 200, ""), ("http://b/sitemap.xml", 200, ""), ("https://c:443/sitemap.xml", 200, ""), ("https://d/sitemap.xml", 200, ""), ("http://e:80/sitemap.xml", 200, "")]
    found = SM.scan_sitemaps(FR.seed_frontier(seeds), spark.createDataFrame(maps, "url STRING, status INT, body STRING"))
    assert {r.sitemap_url for r in found.collect()} == {m[0] for m in maps[:3]}
    listing = ("https://a:443/sitemap_index.xml", 200, index("https://a:443/item.xml"))
    maps = [listing, ("https://a/item.xml", 200, urlset("https://a/p/1"))]
    rows = SM.sitemap_products(FR.seed_frontier(seeds), spark.createDataFrame(maps, "url STRING, status INT, body STRING")).collect()
    assert [r.url for r in rows] == ["https://a/p/1"]
