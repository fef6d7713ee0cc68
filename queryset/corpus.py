"""Web data derived from the given tables.

The ``pages`` table holds articles: no shop pages, robots files or sitemaps. A web of shops is
therefore derived row by row from ``part``, ``supplier`` and ``customer`` and joined to the
given pages, so that every row of those tables takes part and all inputs grow with them. Each
supplier runs a shop with a home page and four category pages, each part has a page in a shop,
and each customer stands for one untidy URL and one untidy link.

Every document is one scalar SQL expression, used word for word by both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS_PER_SHOP = 20
CATEGORIES = 4


def concat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def q(text: str) -> str:
    """SQL literal; quotes and line breaks become chr() so that both engines read the same."""
    for char, code in (("'", 39), ("\n", 10), ("\r", 13)):
        text = text.replace(char, f"\x00{code}\x00")
    pieces = text.split("\x00")
    out = [f"'{p}'" if i % 2 == 0 else f"chr({p})" for i, p in enumerate(pieces)]
    out = [p for p in out if p != "''"] or ["''"]
    return out[0] if len(out) == 1 else concat(*out)


def choose(key: str, modulus: int, options: dict[int, str], other: str = "''") -> str:
    cases = " ".join(f"WHEN {n} THEN {text}" for n, text in options.items())
    return f"CASE {key} % {modulus} {cases} ELSE {other} END"


# --- addresses --------------------------------------------------------------------------

SHOP_OF_PART = f"CAST(floor(p_partkey / {PARTS_PER_SHOP}) AS BIGINT)"


def host(shop: str) -> str:
    return concat(q("shop"), shop, q(".example.com"), choose(shop, 7, {3: q(":8443")}))


def origin(shop: str) -> str:
    return concat(choose(shop, 4, {1: q("http://")}, q("https://")), host(shop))


def part_path(key: str) -> str:
    return choose(
        key,
        8,
        {
            0: concat(q("/product/"), key),
            1: concat(q("/item/"), key, q("/")),
            2: concat(q("/p/"), key, q("?utm=x")),
            3: concat(q("/catalog/thing-prod"), key),
            4: concat(q("/buy/"), key, q("?sku="), key, q("&a=1")),
            5: concat(q("/c/x?product_id="), key, q("&b=2")),
            6: concat(q("/goods/"), key),
        },
        concat(q("/goods/"), key, q(".html")),
    )


def escaped(text: str) -> str:
    return f"replace({text}, '&', '&amp;')"


# --- pages ------------------------------------------------------------------------------

_K = "p_partkey"


def part_html() -> str:
    k, shop = _K, SHOP_OF_PART
    head = [
        q('<!DOCTYPE html><html lang="en"><head><title>'),
        "p_name",
        q(' <a href="/in-title"></title>'),
        choose(
            k,
            4,
            {
                0: q('<meta property="og:type" content="Product">'),
                1: q("<META CONTENT='product' PROPERTY='og:type'/>"),
                2: q('<meta name="description" content="product"><meta property="og:type" content="website">'),
            },
            q("<meta name=keywords content=x>"),
        ),
        choose(k, 7, {0: q('<meta name="Product:price" content="1">')}),
        q('<!-- <meta property="og:type" content="product"><a href="/in-comment">buy now</a> -->'),
        choose(
            k,
            3,
            {
                0: concat(q('<link rel="canonical" href="'), origin(shop), q("/product/"), k, q('">')),
                1: concat(q("<link rel=canonical href=/goods/"), k, q(">")),
            },
            q('<link rel="stylesheet" href="/product/style.css">'),
        ),
        choose(
            k,
            5,
            {
                0: q('<script type="application/ld+json">{ "@type" : "Product", "name": "<a href=x>" }</script>'),
                1: q('<script type="application/ld+json">{"@type":"BreadcrumbList"}</script>'),
                2: q('<script>var x = {"@type":"Product"};</script>'),
            },
        ),
    ]
    body = [
        q("</head><body>"),
        choose(
            k,
            6,
            {
                0: q('<div class="nav breadcrumb"><div>Home</div> &gt; <div><b>Pro</b>ducts</div></div>'),
                1: concat(q("<ol class='breadcrumbs'><li>Home</li><li>Item "), k, q("</li></ol>")),
                2: q('<div class="breadcrumb"><div>Home</div></div><div>a product</div>'),
                3: q("<nav class=bc>All details</nav>"),
                4: q('<div class="breadcrumb-x">product</div>'),
            },
        ),
        q("<h1>"),
        "p_name",
        q("</h1>"),
        choose(
            k,
            9,
            {
                0: q('<button type="submit">Buy Now</button>'),
                1: q('<a href="#">Add to <b>Cart</b></a>'),
                2: q("<p>buy now</p>"),
                3: q('<a title="a > b" href="/help">View&nbsp;product</a>'),
                4: concat(q('<a href="/details/'), k, q('">Product details</a>')),
            },
        ),
        q('<a href="/">Home</a><a href="'),
        escaped(part_path(f"({k} + 1)")),
        q('">more</a><a href=\'/c/'),
        f"CAST(floor(({k} % {PARTS_PER_SHOP}) / 5) AS BIGINT)",
        q("/#list'>up</a>"),
        choose(k, 10, {3: q('<a rel="nofollow next" href="?page=2">2</a>'), 4: q('<a href="?page=3">Next</a>')}),
        f"CASE WHEN {k} % 10 < 5 THEN repeat({q('<a href=/about>x</a>')}, 12) ELSE repeat({q('<p>text</p>')}, {k} % 10 * 4) END",
        q('<a href="https://other.example.net/p/1">ext</a><a href="/img/'),
        k,
        q('.JPG">img</a><a href="mailto:a@example.com">m</a><a href=" javascript:void(0)">j</a>'),
        q('<a href="../up/./x#frag">u</a><a name="top">no link</a><p>'),
        "p_type",
        q("</p></body></html>"),
    ]
    return concat(*head, *body)


def home_html(shop: str) -> str:
    links = [concat(q('<li><a href="/c/'), str(j), q('">part '), str(j), q("</a></li>")) for j in range(CATEGORIES)]
    return concat(
        q('<html><head><meta charset="utf-8"></head><body><ul>'),
        *links,
        q('</ul><a href="about.html">about</a><a href="/caf&eacute;">r</a><a href="/a&#38;lt;b">r</a><a href="/x&#150;y&copy=1">r</a><a href="'),
        escaped(part_path(f"({PARTS_PER_SHOP} * {shop} + 19)")),
        q('">offer</a><a href="//'),
        host(f"({shop} + 1)"),
        q('/">neighbour</a><a href="/files/list.pdf">pdf</a><p>'),
        "s_name",
        q("</p></body></html>"),
    )


def category_html(shop: str, j: str) -> str:
    first = f"({PARTS_PER_SHOP} * {shop} + 5 * {j}"
    links = [concat(q('<a href="'), escaped(part_path(f"{first} + {i})")), q('">see</a>')) for i in range(5)]
    return concat(
        q("<html><body><nav><a href='/'>home</a></nav><h1>"),
        "s_name",
        q("</h1>"),
        *links,
        q('<a href="/c/'),
        f"(({j} + 1) % {CATEGORIES})",
        q('">Next page</a></body></html>'),
    )


PART_PAGE = {
    "page_id": f"1000000000 + {_K}",
    "url": concat(origin(SHOP_OF_PART), part_path(_K), choose(_K, 11, {0: q("#reviews")})),
    "html": part_html(),
    "status": f"CASE WHEN {_K} % 17 = 0 THEN 404 ELSE 200 END",
}
HOME_PAGE = {
    "page_id": "2000000000 + s_suppkey",
    "url": concat(origin("s_suppkey"), q("/")),
    "html": home_html("s_suppkey"),
    "status": "200",
}
CATEGORY_PAGE = {
    "page_id": f"3000000000 + {CATEGORIES} * s_suppkey + j",
    "url": concat(origin("s_suppkey"), q("/c/"), "j"),
    "html": category_html("s_suppkey", "j"),
    "status": "200",
}
GIVEN_PAGE = {"page_id": "page_id", "url": "url", "html": "html", "status": "200"}


# --- robots, sitemaps, seeds ------------------------------------------------------------

_S = "s_suppkey"

ROBOTS = {
    "host": host(_S),
    "status": f"CASE {_S} % 10 WHEN 8 THEN 404 WHEN 9 THEN 503 ELSE 200 END",
    "body": choose(
        _S,
        10,
        {
            0: q("User-agent: *\nDisallow: /goods/\nCrawl-delay: 2\n"),
            1: q("# rules\nUser-agent: otherbot\nUser-agent: PageScout\nDisallow: /c/1 # no\nAllow: /c/1$\n\nUser-agent: *\nDisallow: /\n"),
            2: q("User-agent: *\nDisallow:\n"),
            3: q("User-agent: *\r\nDisallow: /*.html$\r\nDisallow: /*?\r\nAllow: /*?sku=\r\n"),
            4: q("User-agent: *\nDisallow: /item\nAllow: /item\n"),
            5: q("User-agent: pagescout\nCrawl-delay: 0.5\nUser-agent: *\nDisallow: /p/\nCrawl-delay: 3"),
            6: q("User-agent: nobot\nDisallow: /\n"),
            7: q("Disallow: /lost\nUser-agent: *\nDisallow: /\nAllow: /c/\nAllow: /product/\nSitemap: /s.xml\n"),
        },
        q("User-agent: *\nDisallow: /\n"),
    ),
}

SITEMAP_NAMES = [
    "/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml",
    "/product-sitemap.xml", "/pages.xml", "/broken-items.xml",
]


def _loc(path: str, pad: str = "") -> str:
    return concat(q(f"<loc>{pad}"), origin(_S), escaped(path), q(f"{pad}</loc>"))


def _urlset(*locs: str) -> str:
    urls = [concat(q("<url>"), loc, q("</url>")) for loc in locs]
    return concat(
        q('<?xml version="1.0"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
        *urls,
        q("</urlset>\n"),
    )


def _part(i: int) -> str:
    return part_path(f"({PARTS_PER_SHOP} * {_S} + {i})")


_INDEX = concat(
    q('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
    *[
        concat(q("<sitemap>"), _loc(q(name)), q("<lastmod>2024-01-01</lastmod></sitemap>"))
        for name in ("/product-sitemap.xml", "/pages.xml", "/broken-items.xml", "/sitemap_index.xml")
    ],
    q("</sitemapindex>"),
)
_SITEMAP_BODY = (
    f"CASE j WHEN 0 THEN {_urlset(_loc(_part(1), '  '), _loc(_part(6)))} "
    f"WHEN 1 THEN {_INDEX} "
    f"WHEN 2 THEN {concat(q('<s:urlset xmlns:s=' + chr(34) + 'urn:x' + chr(34) + '><s:url><s:loc>'), origin(_S), escaped(_part(12)), q('</s:loc></s:url></s:urlset>'))} "
    f"WHEN 3 THEN {_urlset(_loc(_part(4)), _loc(_part(7)), _loc(_part(0)))} "
    f"WHEN 4 THEN {_urlset(_loc(q('/about.html')))} "
    f"ELSE {concat(q('<urlset><url>'), _loc(_part(2)))} END"
)
_SITEMAP_MISSING = (
    f"(j = 0 AND {_S} % 3 = 1) OR (j = 1 AND {_S} % 3 <> 1) OR (j = 2 AND {_S} % 6 <> 2)"
)
SITEMAP = {
    "url": concat(
        origin(_S),
        "CASE j " + " ".join(f"WHEN {i} THEN {q(n)}" for i, n in enumerate(SITEMAP_NAMES)) + " END",
    ),
    "status": f"CASE WHEN {_SITEMAP_MISSING} THEN 404 ELSE 200 END",
    "body": f"CASE WHEN {_SITEMAP_MISSING} THEN 'not found' ELSE {_SITEMAP_BODY} END",
}

SHOP_SEED = {
    "url": f"CASE WHEN {_S} % 13 = 12 THEN {concat(q('ht tp://shop'), _S)} ELSE "
    + choose(
        _S,
        5,
        {
            1: f"replace({origin(_S)}, 'shop', 'SHOP')",
            2: origin(_S),
            3: concat(origin(_S), q("/#top")),
        },
        concat(origin(_S), q("/")),
    )
    + " END"
}

# --- untidy URLs and links --------------------------------------------------------------

_C = "c_custkey"


def _site(path: str, tail: bool = False) -> str:
    return concat(q("https://shop"), _C, q(".example.com" + path), *([_C] if tail else []))


MESSY_URL = {
    "url": choose(
        _C,
        18,
        {
            0: concat(q("HTTPS://Shop"), _C, q(".Example.COM/")),
            1: _site(""),
            2: _site(":8080//a//b/./c/../d/"),
            3: _site("/x?"),
            4: _site("/x?b=2&a=1&a=0&sku=", True),
            5: _site("/a b/für?q=ü c*~"),
            6: _site("/x?Product_ID=1#frag"),
            7: _site("/x;y=1/(z)/?a;b&c"),
            8: _site("/%7Euser/%C3%A9t%C3%A9/"),
            9: concat(q("shop"), _C, q(".example.com/P/1")),
            10: _site("/p/1/../../../q"),
            11: _site(":port/"),
            12: _site("/%zz"),
            13: concat(q("mailto:"), _C, q("@example.com")),
            14: concat(q("https://user:pw@shop"), _C, q(".example.com/Item/1")),
            15: _site("/..//./x/?=v&k=&%70rod=1&bad=%&a+b=c%20d"),
            16: concat(q("//shop"), _C, q(".example.com/shop/?Item=1")),
        },
        concat(q("3:shop"), _C),
    ),
}

MESSY_LINK = {
    "base": concat(q("https://shop"), _C, q(".example.com/d/e?k=v")),
    "href": choose(
        _C,
        26,
        {
            0: q(""),
            1: q("#"),
            2: concat(q("#note"), _C),
            3: q(" javascript:void(0)"),
            4: q("JavaScript:void(0)"),
            5: q("mailto:a@example.com"),
            6: q("tel:123"),
            7: q("data:text/html,x"),
            8: q("chrome-extension://x/y"),
            9: q("ftp://example.com/x"),
            10: concat(q("https://www.shop"), _C, q(".example.com/x")),
            11: concat(q("//SHOP"), _C, q(".example.com/y/")),
            12: concat(q("page"), _C, q(".html")),
            13: q("?q=2&p=1"),
            14: q("?"),
            15: q("../../up/./z/.."),
            16: q("/img/a.b.PNG"),
            17: q("/docs/file.pdf?download=1"),
            18: q("/archive.tar.gz#x"),
            19: q("/v1.5/list"),
            20: q("/für/the,"),
            21: q("1:2"),
            22: q("./"),
            23: concat(q("\n /item/"), _C, q("/ ")),
            24: q("/style.css"),
        },
        concat(q("https://shop"), _C, q(".example.com/p/1?b=1&a=2")),
    ),
}


# --- Spark side -------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before each becomes a document a hundred times its size.

    A table that is read in at least that many splits stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(sql).alias(name) for name, sql in columns.items()])


def _each(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, html, status)``: given pages, part, home and category pages."""
    supplier = spread(table(spark, sf_dir, "supplier"))
    return (
        derive(table(spark, sf_dir, "pages"), GIVEN_PAGE)
        .unionByName(derive(spread(table(spark, sf_dir, "part")), PART_PAGE))
        .unionByName(derive(supplier, HOME_PAGE))
        .unionByName(derive(_each(supplier, CATEGORIES), CATEGORY_PAGE))
    )


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spread(table(spark, sf_dir, "supplier")), ROBOTS)


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(_each(spread(table(spark, sf_dir, "supplier")), len(SITEMAP_NAMES)), SITEMAP)


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    shops = derive(table(spark, sf_dir, "supplier"), SHOP_SEED)
    return shops.unionByName(table(spark, sf_dir, "pages").select("url"))


def messy_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(url)``: untidy URLs and the URLs of all pages."""
    untidy = derive(table(spark, sf_dir, "customer"), MESSY_URL)
    return untidy.unionByName(pages(spark, sf_dir).select("url"))


def messy_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(base, href)``"""
    return derive(table(spark, sf_dir, "customer"), MESSY_LINK)


# --- chains of pages ---------------------------------------------------------------------

LISTS, SAME = "https://lists.example.com/", "https://same.example.com/"
#: Series of 1, 2, 4, ... pages: a part's series is the number of binary digits of its key.
_DIGITS = f"length(bin({_K}))"
SERIES_PART = {"src": concat(q(LISTS), _DIGITS, q("/"), _K), "dst": f"CASE WHEN length(bin({_K} + 1)) = {_DIGITS} THEN {concat(q(LISTS), _DIGITS, q('/'), f'({_K} + 1)')} END"}
#: Loops of five pages.
SERIES_LOOP = {"src": concat(q(LISTS + "loop/"), _S), "dst": concat(q(LISTS + "loop/"), f"(CASE WHEN {_S} % 5 = 4 THEN {_S} - 4 ELSE {_S} + 1 END)")}
_SAME_PART = concat(q(SAME), _K)
#: Chains of up to four hops, pages that name themselves, and ones that name a page that is not stored.
SAME_PART = {
    "src": _SAME_PART,
    "dst": f"CASE {_K} % 7 WHEN 0 THEN NULL WHEN 6 THEN {_SAME_PART} WHEN 5 THEN {concat(q('https://gone.example.com/'), f'CAST(floor({_K} / 7) AS BIGINT)')} ELSE {concat(q(SAME), f'({_K} - 1)')} END",
}
#: Copies of some of these pages that name another one.
SAME_COPY = {"src": _SAME_PART, "dst": concat(q(SAME), f"({_K} - 2)")}
_COPIED = f"{_K} % 49 = 3"
#: Loops of three pages, each with a page that leads into it.
SAME_LOOP = {"src": concat(q(SAME + "loop/"), _S), "dst": concat(q(SAME + "loop/"), f"(CASE {_S} % 4 WHEN 2 THEN {_S} - 2 WHEN 3 THEN {_S} - 1 ELSE {_S} + 1 END)")}


def _as_pages(links: dict[str, str], before: str, after: str) -> dict[str, str]:
    """Documents that hold one link, or none where it is NULL."""
    html = concat(q("<html><head><title>x</title>"), f"coalesce({concat_or_null(q(before), links['dst'], q(after))}, '')", q("</head><body></body></html>"))
    return {"page_id": "CAST(0 AS BIGINT)", "url": links["src"], "html": html, "status": "200"}


def concat_or_null(*parts: str) -> str:
    return "(" + " || ".join(parts) + ")"


def series_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, html, status)``: pages of lists that link to their next page."""
    around = ('<a rel="next" href="', '">Next</a>')
    parts = derive(spread(table(spark, sf_dir, "part")), _as_pages(SERIES_PART, *around))
    return parts.unionByName(derive(table(spark, sf_dir, "supplier"), _as_pages(SERIES_LOOP, *around)))


def same_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, html, status)``: pages that name their canonical URL."""
    around = ('<link rel="canonical" href="', '">')
    part = spread(table(spark, sf_dir, "part"))
    return (
        derive(part, _as_pages(SAME_PART, *around))
        .unionByName(derive(part.where(_COPIED), _as_pages(SAME_COPY, *around)))
        .unionByName(derive(table(spark, sf_dir, "supplier"), _as_pages(SAME_LOOP, *around)))
    )


# --- SQL side ---------------------------------------------------------------------------


def _select(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + f" FROM {source}"


def _times(source: str, n: int) -> str:
    return f"{source} CROSS JOIN (SELECT unnest(range({n})) AS j)"


SQL = {
    "web": " UNION ALL ".join(
        [
            _select(GIVEN_PAGE, "pages"),
            _select(PART_PAGE, "part"),
            _select(HOME_PAGE, "supplier"),
            _select(CATEGORY_PAGE, _times("supplier", CATEGORIES)),
        ]
    ),
    "robots": _select(ROBOTS, "supplier"),
    "sitemaps": _select(SITEMAP, _times("supplier", len(SITEMAP_NAMES))),
    "seeds": _select(SHOP_SEED, "supplier") + " UNION ALL SELECT url FROM pages",
    "messy_urls": _select(MESSY_URL, "customer") + " UNION ALL SELECT url FROM web",
    "messy_links": _select(MESSY_LINK, "customer"),
    "series": _select(SERIES_PART, "part") + " UNION ALL " + _select(SERIES_LOOP, "supplier"),
    "same": " UNION ALL ".join([_select(SAME_PART, "part"), _select(SAME_COPY, f"part WHERE {_COPIED}"), _select(SAME_LOOP, "supplier")]),
}
