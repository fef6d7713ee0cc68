import json
import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagescout.operators import reports as RP
from pagescout.plans.crawl import CrawlOptions, crawl_closure
from pagescout.sources import sinks

PRODUCT = '<html><head><meta property="og:type" content="product"></head></html>'


def crawl(spark, seeds, pages, robots=(), sitemaps=(), **options):
    return crawl_closure(
        spark.createDataFrame([(u,) for u in seeds], "url STRING"),
        spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id BIGINT, url STRING, html STRING"),
        spark.createDataFrame(list(robots), "host STRING, status INT, body STRING"),
        spark.createDataFrame(list(sitemaps), "url STRING, status INT, body STRING"),
        CrawlOptions(**options),
    )


def product_urls(result):
    return {(r.domain, r.url) for r in result.products.collect()}


@pytest.mark.parametrize("threshold, found", [(50, set()), (15, {("h:8080", "http://h:8080/product/1")})])
def test_basic_site(spark, threshold, found):
    pages = [("http://h:8080/", '<html><body><a href="/product/1">Product 1</a></body></html>'), ("http://h:8080/product/1", PRODUCT)]
    assert product_urls(crawl(spark, ["http://h:8080"], pages, threshold=threshold, max_depth=3)) == found


def test_robots_site(spark):
    pages = [("http://h/allowed", PRODUCT), ("http://h/disallowed/product", PRODUCT)]
    robots = [("h", 200, "User-agent: *\nDisallow: /disallowed/")]
    result = crawl(spark, ["http://h/allowed", "http://h/disallowed/product"], pages, robots, threshold=15, max_depth=1)
    assert product_urls(result) == {("h", "http://h/allowed")}
    assert [r.url for r in result.excluded.collect()] == ["http://h/disallowed/product"]


def test_depth_products_and_sitemaps(spark):
    def page(*links):
        return "".join(f'<a href="{u}">x</a>' for u in links)

    pages = [
        ("http://h/", page("/1", "/product/a", "/gone")),
        ("http://h/1", page("/2", "/")),
        ("http://h/2", page("/3")),
        ("http://h/3", page("/4")),
        ("http://h/4", page()),
        ("http://h/product/a", PRODUCT + page("/hidden")),
        ("http://h/hidden", page()),
        ("http://h/listed", page("/below")),
        ("http://h/below", page()),
        ("http://h/1/", page("/never")),  # same key as /1 with a larger page_id
    ]
    maps = [("http://h/sitemap.xml", 200, "<urlset><url><loc>http://h/listed</loc></url><url><loc>http://far/x</loc></url></urlset>")]
    result = crawl(spark, ["http://h/"], pages, (), maps, threshold=15, max_depth=3)
    visited = {r.url_key: (r.depth, r.domain, r.fetched) for r in result.visited.collect()}
    assert visited == {
        "http://h": (0, "h", True),
        "http://h/1": (1, "h", True),
        "http://h/product/a": (1, "h", True),
        "http://h/gone": (1, "h", False),
        "http://h/listed": (1, "h", True),
        "http://far/x": (1, "h", False),
        "http://h/2": (2, "h", True),
        "http://h/below": (2, "h", True),
        "http://h/3": (3, "h", True),
    }
    report = {r.domain: r for r in RP.crawl_report(result.visited.where("depth = 0"), result.visited, result.products, 2.0).collect()}
    assert (report["h"].visited, report["h"].errors, report["h"].products, report["h"].urls_per_s) == (9, 2, 1, 4.5)
    assert report[None].coverage == 1.0


def test_random_graph_against_breadth_first_search(spark):
    rng = random.Random(3)
    links = {i: [rng.randrange(120) for _ in range(rng.choice([0, 1, 2, 5]))] for i in range(100)}
    products = {i for i in range(100) if rng.random() < 0.15}
    pages = [
        (f"http://h/{i}", (PRODUCT if i in products else "") + "".join(f'<a href="/{j}">x</a>' for j in links[i]))
        for i in range(100)
    ]
    seeds = [0, 1, 2]
    depth = {i: 0 for i in seeds}
    level = list(seeds)
    for d in range(1, 5):
        below = {j for i in level if i in links and i not in products for j in links[i]} - set(depth)
        depth.update({j: d for j in below})
        level = sorted(below)
    for cap, buckets in ((None, None), (10**6, 3)):
        result = crawl(spark, [f"http://h/{i}" for i in seeds], pages, threshold=15, max_depth=4, frontier_cap=cap, buckets=buckets)
        got = {int(r.url_key.rsplit("/", 1)[1]): r.depth for r in result.visited.collect()}
        assert got == depth
        assert product_urls(result) == {("h", f"http://h/{i}") for i in products & set(depth)}


def exchanges(df):
    """Columns by which the plan shuffles, and what it reads below each shuffle."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line], plan


def test_only_the_frontier_is_shuffled(spark):
    from pagescout.operators import frontier as FR
    from pagescout.plans import crawl as C
    from pagescout.storage import materialize, materialize_bucketed

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        key = F.concat(F.lit("http://h/"), F.col("id")).alias("url_key")
        edges = materialize_bucketed(spark.range(1000).select(key, F.lit("http://h/x").alias("dst")), "t", "url_key")
        visited = materialize_bucketed(
            spark.range(10).select(key, F.lit(1).alias("depth"), F.lit("h").alias("domain"), F.lit(True).alias("fetched"), F.lit(False).alias("is_product")),
            "v", "url_key",
        )
        shuffles, _ = exchanges(C._next_frontier(visited, edges, None, 1))
        assert shuffles == []
        frontier = materialize(
            spark.range(10).select(key.alias("url"), F.lit(1).alias("depth"), F.lit("h").alias("domain"), key, F.lit("s").alias("src")), "f"
        )
        shuffles, plan = exchanges(FR.not_in_rounds(frontier, [visited, visited]))
        assert len(shuffles) == 1 and plan.count("Bucketed: true") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_pages_of_other_hosts_are_not_parsed(spark):
    from pagescout.operators import frontier as FR
    from pagescout.plans.crawl import within_reach

    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(["http://H/1", "http://other/1", "http://listed/x", "no url", "http://[bad"])], "page_id BIGINT, url STRING, html STRING")
    seeds = FR.seed_frontier(spark.createDataFrame([("http://h/",)], "url STRING"))
    listed = spark.createDataFrame([("h", "http://listed/y")], "domain STRING, url STRING")
    kept = {r.url for r in within_reach(pages, seeds, listed).select("url").collect()}
    assert "http://other/1" not in kept and {"http://H/1", "http://listed/x", "no url"} <= kept


def test_copies_of_a_page_give_its_links_once(spark):
    from pagescout.plans import crawl as C

    copies = spark.range(20_000).select(
        F.lit("http://h").alias("url_key"), F.col("id").alias("page_id"), F.lit(0).alias("score"), F.lit(False).alias("is_product"), F.array(F.lit("/a"), F.lit("/b"), F.lit("/a#x")).alias("hrefs")
    )
    facts = C.page_facts(copies)
    standing = copies.join(facts.select("url_key", "page_id"), ["url_key", "page_id"], "left_semi")
    assert {r.dst for r in C.page_edges(standing).collect()} == {"http://h/a", "http://h/b"} and C.page_edges(standing).count() == 2


def test_listing_counts_when_it_has_a_weight(spark):
    pages = [("http://h/", '<a href="/product/plain">x</a>'), ("http://h/product/plain", "x"), ("http://h/product/listed", "x")]
    maps = [("http://h/sitemap.xml", 200, "<urlset><url><loc>http://h/product/listed</loc></url></urlset>")]
    base = {r.url_key: r.score for r in crawl(spark, ["http://h/"], pages, (), maps).visited.collect()}
    more = {r.url_key: r.score for r in crawl(spark, ["http://h/"], pages, (), maps, weights={"in_sitemap": 25}).visited.collect()}
    assert more["http://h/product/listed"] == base["http://h/product/listed"] + 25
    assert more["http://h/product/plain"] == base["http://h/product/plain"]


def test_a_closed_crawl_leaves_nothing(spark):
    from pagescout.storage import shared_dir

    def left():
        folder = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")) / "pagescout"
        return {p.name for p in folder.glob("*")} | {t.name for t in spark.catalog.listTables()}

    before = left()
    result = crawl(spark, ["http://h/"], [("http://h/", PRODUCT)], threshold=15)
    assert product_urls(result) == {("h", "http://h")} and left() > before
    result.close()
    assert left() == before


def test_job_from_files_to_document(spark, tmp_path):
    from pagescout import job

    (tmp_path / "seeds.txt").write_text("# shops\nHTTP://H/\n")
    spark.createDataFrame([(1, "http://h/", '<a href="/product/1">x</a>'), (2, "http://h/product/1", PRODUCT)], "page_id BIGINT, url STRING, html STRING").write.parquet(str(tmp_path / "pages"))
    job.main(["--seeds", str(tmp_path / "seeds.txt"), "--pages", str(tmp_path / "pages"), "--output", str(tmp_path / "out"), "--threshold", "15"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert json.loads(text) == {"h": ["http://h/product/1"]}


PRODUCTS = [("b.com", "https://b.com/p/2"), ("a.com", "https://a.com/p/1?x=1&y=<\"é"), ("b.com", "https://b.com/p/1"), ("b.com", "https://b.com/p/1")]


def test_json_document(spark, tmp_path):
    df = spark.createDataFrame(PRODUCTS, "domain STRING, url STRING")
    sinks.write_product_json(df, str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in sorted(Path(tmp_path / "doc").glob("part-*")))
    expected = defaultdict(list)
    for domain, url in sorted(set(PRODUCTS)):
        expected[domain].append(url)
    plain = json.dumps(expected, indent=2, ensure_ascii=False) + "\n"
    assert text == plain.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")
    assert json.loads(text) == expected


def test_json_lines_and_chunks(spark, tmp_path):
    df = spark.createDataFrame([("a", f"u{i:03}") for i in range(25)] + [("b", "u")], "domain STRING, url STRING")
    sinks.write_product_documents(df, str(tmp_path / "lines"), chunk=10)
    rows = spark.read.json(str(tmp_path / "lines")).orderBy("domain", "chunk").collect()
    assert [(r.domain, r.chunk, len(r.product_urls)) for r in rows] == [("a", 0, 10), ("a", 1, 10), ("a", 2, 5), ("b", 0, 1)]
    assert [u for r in rows for u in r.product_urls] == [f"u{i:03}" for i in range(25)] + ["u"]
    small = RP.product_map(RP.product_urls_by_domain(df)).first().products
    assert {k: len(v) for k, v in small.items()} == {"a": 25, "b": 1}
    assert {k: len(v) for k, v in RP.product_map(RP.product_urls_by_domain(df, 10)).first().products.items()} == {"a": 25, "b": 1}
    assert RP.product_map(RP.product_urls_by_domain(df, 10)).first().products["a"] == [f"u{i:03}" for i in range(25)]
    with pytest.raises(RP.TooLargeForOneRow) as too_large:
        RP.product_map(RP.product_urls_by_domain(df, 10), limit=100)
    size = RP.product_map_bytes(RP.product_urls_by_domain(df, 10))
    assert (too_large.value.size, too_large.value.limit) == (size, 100) and size == RP.product_map_bytes(RP.product_urls_by_domain(df)) + 2


def test_no_products_give_an_empty_object(spark, tmp_path):
    sinks.write_product_json(spark.createDataFrame([], "domain STRING, url STRING"), str(tmp_path / "none"))
    assert "".join(p.read_text() for p in sorted(Path(tmp_path / "none").glob("part-*"))) == "{}\n"


def _counted_frontier(spark):
    """Frontier rows, and how many were computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(300).selectExpr("concat('https://h/', id) AS url_key", "cast(id % 3 AS int) AS depth", "'h' AS domain")
    return rows.mapInPandas(count, rows.schema), seen


def test_a_frontier_is_computed_once(spark, monkeypatch):
    from pagescout import settings as S
    from pagescout.operators import frontier as FR

    pages = spark.range(0, 600, 2).selectExpr("id AS page_id", "concat('https://h/', id) AS url_key")
    for limit in (S.BROADCAST_LIMIT_BYTES, 0):
        monkeypatch.setattr(S, "BROADCAST_LIMIT_BYTES", limit)
        frontier, seen = _counted_frontier(spark)
        assert FR.fetch_join(frontier, pages).count() == 150
        assert seen.value == 300
    frontier, seen = _counted_frontier(spark)
    kept, dropped = FR.round_bound(frontier, 120, ranges=10, at_once=20)
    assert (kept.count(), dropped.count()) == (120, 180)
    assert seen.value == 300


@pytest.mark.parametrize("max_depth, resolved", [(0, set()), (1, {"http://h/a"}), (2, {"http://h/a", "http://h/b", "http://h/c"})])
def test_only_links_that_can_be_followed_are_resolved(spark, monkeypatch, max_depth, resolved):
    from pagescout.plans import crawl as CR

    seen, page_edges = set(), CR.page_edges

    def noted(parsed):
        seen.update(r.url_key for r in parsed.collect())
        return page_edges(parsed)

    monkeypatch.setattr(CR, "page_edges", noted)
    pages = [("http://h/a", '<a href="/b">b</a>'), ("http://h/b", '<a href="/c">c</a>'), ("http://h/c", "")]
    result = crawl(spark, ["http://h/a", "http://h/a"], pages, max_depth=max_depth)
    depths = {(r.url_key, r.depth) for r in result.visited.collect()}
    assert depths == {(f"http://h/{p}", d) for d, p in enumerate("abc") if d <= max_depth}
    assert seen == resolved


def test_plain_links_have_the_targets_that_resolving_gives(spark):
    from pagescout.functions import urls as U

    hrefs = ["/", "/a", "/a/", "/a/b.html", "/a.PNG", "/x.pdf?d=1", "//other/x", "/a//b", "/.", "/../a", "/a/..b", "/a/.b", "/%41", "/für", "/a?b=1", "/a#f", " /a", "/a:b", "/:a", "/a\\b", "/a\n", "a", "", None]
    keys = ["https://h:8080/d/e", "http://h", "http://H/x", "ftp://h/x", "https://u@h/x", "https://h/%zz", "no url", "http://[::1]/x", "mailto:a"]
    rows = spark.createDataFrame([(k, h) for k in keys for h in hrefs], "url_key string, href string")
    judged = U.with_link_target(U.with_base_parts(rows, "url_key").withColumn("plain", U.plain_target(F.col("href"))), "href").select("url_key", "href", "plain", "dst").collect()
    plain = [r for r in judged if r.plain is not None]
    assert all(r.plain == r.dst for r in plain)
    assert {r.href for r in plain if r.url_key == "http://h"} == {"/", "/a", "/a/b.html", "/a:b", "/:a"}


def test_pages_of_the_shops_are_derived_by_all_cores(spark, tmp_path):
    from queryset import corpus

    spark.range(40).selectExpr("id AS s_suppkey", "'n' AS s_name").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(40).selectExpr("id AS p_partkey", "'n' AS p_name", "'t' AS p_type").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, "http://h/", "")], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    cores = spark.sparkContext.defaultParallelism
    for df, tables in ((corpus.pages(spark, str(tmp_path)), 3), (corpus.robots(spark, str(tmp_path)), 1), (corpus.sitemaps(spark, str(tmp_path)), 1)):
        assert df.rdd.getNumPartitions() >= tables * cores
