"""The bounded crawl over stored pages.

Every page is read once: :func:`parse_pages` reduces it to its decision and its links. The
rounds of the crawl only join narrow tables, bucketed by the normalized URL, so that only the
frontier moves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescout import settings as S
from pagescout.functions import html as H
from pagescout.functions import urls as U
from pagescout.functions.steps import settle
from pagescout.operators import frontier as FR
from pagescout.operators.bits import key_bits, may_match
from pagescout.operators.robots import host_policy, robots_verdict, rule_index
from pagescout.operators.signals import SIGNALS, SignalBuilder, scored_pages
from pagescout.operators.sitemaps import sitemap_products
from pagescout.sources.tables import scan_pages, scan_robots
from pagescout.operators.skew import fits_broadcast, lookup_join
from pagescout.storage import Scratch, materialize, materialize_bucketed, scratch


@dataclass(frozen=True)
class CrawlOptions:
    max_depth: int = S.MAX_DEPTH
    threshold: int = S.PRODUCT_THRESHOLD
    weights: dict[str, int] = field(default_factory=dict)
    signals: dict[str, SignalBuilder] = field(default_factory=lambda: dict(SIGNALS))
    user_agent: str = S.USER_AGENT_TOKEN
    crawl_delay: float = S.CRAWL_DELAY_SECONDS
    strict_sitemaps: bool = False
    frontier_cap: int | None = None
    buckets: int | None = None


@dataclass(frozen=True)
class CrawlResult:
    """``visited(url, depth, domain, url_key, src, allowed, fetched, page_id, score, is_product)``."""

    visited: DataFrame
    dropped: DataFrame | None = None
    scratch: Scratch | None = None

    def close(self) -> None:
        """Remove all tables of the crawl, these results among them."""
        if self.scratch:
            self.scratch.release()

    @property
    def products(self) -> DataFrame:
        """``(domain, url, depth, score)`` of the product pages; ``url`` is normalized."""
        return self.visited.where("is_product").select(
            "domain", F.col("url_key").alias("url"), "depth", "score"
        )

    @property
    def excluded(self) -> DataFrame:
        return self.visited.where(~F.col("allowed"))


def parse_pages(
    pages: DataFrame, options: CrawlOptions | None = None, listed: DataFrame | None = None
) -> DataFrame:
    """``(url_key, page_id, score, is_product, hrefs)``, one row per stored page.

    A narrow stage, and the only one that reads the text. Product pages carry no hrefs, since
    they are never expanded. With a weight for ``in_sitemap`` the URLs ``listed`` by product
    sitemaps score it as well.
    """
    o = options or CrawlOptions()
    scored = scored_pages(
        scan_pages(pages), o.signals, o.weights, o.threshold, ["page_id"], with_links=True
    )
    weight = o.weights.get("in_sitemap", 0)
    if weight and listed is not None:
        keys = U.with_normal_url(listed.select("url"), "url", "url_key").select("url_key").distinct()
        score = F.col("score") + F.when(F.col("_listed"), weight).otherwise(0)
        scored = (
            lookup_join(scored, keys.withColumn("_listed", F.lit(True)), "url_key")
            .withColumn("score", score)
            .withColumn("is_product", F.col("score") >= o.threshold)
        )
    followed = F.when(~F.col("is_product"), F.array_distinct(H.hrefs_of(F.col("links"))))
    return scored.select("url_key", "page_id", "score", "is_product", followed.alias("hrefs"))


def page_facts(parsed: DataFrame) -> DataFrame:
    """``(url_key, page_id, score, is_product)``, one row per normalized URL.

    Where several stored pages share a normalized URL, the one with the smallest ``page_id``
    stands. Copies are combined before the shuffle.
    """
    first = F.min(F.struct("page_id", "score", "is_product")).alias("page")
    return parsed.groupBy("url_key").agg(first).select("url_key", "page.*")


def page_edges(parsed: DataFrame) -> DataFrame:
    """``(url_key, dst)``, the different accepted links of the pages that may be expanded."""
    anchors = U.with_base_parts(parsed.where(~F.col("is_product")), "url_key").select(
        "url_key", *U.BASE_COLUMNS, F.explode("hrefs").alias("href")
    )
    plain = settle(anchors.withColumn("plain", U.plain_target(F.col("href"))), "plain")
    other = plain.withColumn("href", F.when(F.col("plain").isNull(), F.col("href")))
    judged = U.with_link_target(other, "href").withColumn("dst", F.coalesce("plain", "dst"))
    return judged.where(F.col("dst").isNotNull()).select("url_key", "dst").distinct()


def within_reach(pages: DataFrame, seeds: DataFrame, listed: DataFrame) -> DataFrame:
    """The pages a crawl can get to: those on the hosts of seeds and of sitemap entries.

    Followed links stay on their host. Pages without a host stay too, since a listed URL that
    cannot be parsed may equal theirs. A set of hosts that is too large to broadcast becomes a bit
    filter; the few pages of other hosts that pass it are parsed, and no round ever reaches them.
    """
    hosts = seeds.select("domain").union(listed.select(U.url_host(F.col("url")))).union(
        seeds.sparkSession.createDataFrame([("",)], "domain string")
    )
    hosts = materialize(hosts.where(F.col("domain").isNotNull()).distinct(), "hosts")
    keyed = pages.withColumn("_host", F.coalesce(U.url_host(F.col("url")), F.lit("")))
    if not fits_broadcast(hosts, S.BROADCAST_LIMIT_BYTES):
        return may_match(keyed, "_host", materialize(key_bits(hosts, "domain"), "host-bits")).drop("_host")
    return keyed.join(F.broadcast(hosts.withColumnRenamed("domain", "_host")), "_host", "left_semi").drop("_host")


def crawl_closure(
    seeds: DataFrame,
    pages: DataFrame,
    robots: DataFrame,
    sitemaps: DataFrame,
    options: CrawlOptions | None = None,
) -> CrawlResult:
    """All pages within ``max_depth`` links of the seeds, with their product decision.

    Product pages are recorded and not expanded; pages at the maximum depth are scored and
    not expanded; disallowed URLs are visited and not fetched; sitemaps are read for the
    allowed seeds, fetched or not. A URL is visited once, at its smallest depth.

    The driver only decides whether another round is needed. Each round writes its visited
    rows to the shared folder, bucketed like the pages; the frontier is derived from them.
    ``close()`` of the result removes what the crawl has written.
    """
    with scratch(seeds.sparkSession) as own:
        visited, dropped = _crawl(seeds, pages, robots, sitemaps, options or CrawlOptions())
    return CrawlResult(visited, dropped, own)


def _crawl(seeds, pages, robots, sitemaps, o: CrawlOptions) -> tuple[DataFrame, DataFrame | None]:
    policy = materialize(rule_index(host_policy(scan_robots(robots), o.user_agent)), "policy")
    policy_fits = fits_broadcast(policy)
    frontier = materialize(FR.seed_frontier(seeds), "seeds")
    listed = materialize(sitemap_products(frontier, sitemaps, o.strict_sitemaps), "listed")
    parsed = materialize(parse_pages(within_reach(pages, frontier, listed), o, listed), "parsed")
    buckets = o.buckets or bucket_count(parsed)
    facts = materialize_bucketed(page_facts(parsed), "facts", "url_key", buckets)
    # Of the copies of a URL only the standing one is expanded; the join spreads them by page.
    standing = parsed.join(facts.select("url_key", "page_id"), ["url_key", "page_id"], "left_semi")
    if o.max_depth < 2:
        # Pages found in the first round are the last: only seeds are expanded, if any page is.
        expanded = frontier.select("url_key").distinct() if o.max_depth else frontier.select("url_key").limit(0)
        standing = standing.join(expanded, "url_key", "left_semi")
    edges = materialize_bucketed(page_edges(standing), "edges", "url_key", buckets)

    rounds: list[DataFrame] = []
    dropped: list[DataFrame] = []
    for depth in range(o.max_depth + 1):
        new = FR.not_in_rounds(frontier, rounds)
        if o.frontier_cap is not None:
            new = materialize(new, f"new-{depth}")
            new, rest = FR.frontier_cap(new, o.frontier_cap)
            dropped.append(rest)
        judged = _visit(new, policy, policy_fits, facts, o)
        visited = materialize_bucketed(judged, f"visited-{depth}", "url_key", buckets)
        if visited.isEmpty():
            break
        rounds.append(visited)
        if depth < o.max_depth:
            frontier = _next_frontier(visited, edges, listed, depth)
    result = FR.frontier_union(*(rounds or [visited]))
    return result, FR.frontier_union(*dropped) if dropped else None


def bucket_count(parsed: DataFrame) -> int:
    """Buckets of the tables that the rounds join: by rows, and no fewer than shuffles have partitions."""
    least = int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-parsed.count() // S.ROWS_PER_TASK))


def _visit(new: DataFrame, policy: DataFrame, policy_fits: bool, facts: DataFrame, o: CrawlOptions):
    """Verdict, fetch and score of one round; every new URL stays, with what became of it."""
    judged = robots_verdict(new, policy, o.crawl_delay, fits=policy_fits)
    page = facts.select("url_key", "page_id", "score", F.col("is_product").alias("_product"))
    fetched = F.col("allowed") & F.col("_product").isNotNull()
    return judged.join(page, "url_key", "left").select(
        *FR.COLUMNS,
        "allowed",
        fetched.alias("fetched"),
        F.when(fetched, F.col("page_id")).alias("page_id"),
        F.when(fetched, F.col("score")).alias("score"),
        (fetched & F.col("_product")).alias("is_product"),
    )


def _next_frontier(visited, edges, listed, depth: int) -> DataFrame:
    open_pages = visited.where(F.col("fetched") & ~F.col("is_product")).select("url_key", "depth", "domain")
    links = FR.link_frontier(open_pages.join(edges, "url_key"))
    if depth > 0:
        return links
    allowed = visited.where("allowed").select("domain").distinct()
    return FR.frontier_union(links, FR.sitemap_frontier(listed.join(allowed, "domain", "left_semi")))
