"""Frontier operators.

A frontier row is ``(url, depth, domain)`` plus ``url_key``, its normalized URL, and ``src``,
the page it was found on (NULL for seeds and sitemap entries).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescout import settings as S
from pagescout.functions import urls as U
from pagescout.functions.steps import count_up_to
from pagescout.operators.bits import key_bits, may_match
from pagescout.operators.skew import first_n_per_group, fits_broadcast, rank_in_group, salted_join
from pagescout.storage import materialize

COLUMNS = ["url", "depth", "domain", "url_key", "src"]


def seed_frontier(seeds: DataFrame) -> DataFrame:
    """Seed URLs at depth 0 under their lower-cased host; seeds that are no URL drop out."""
    rows = seeds.select(
        "url", F.lit(0).alias("depth"), U.url_host(F.col("url")).alias("domain")
    ).where(F.col("domain").isNotNull())
    return U.with_normal_url(rows, "url", "url_key").withColumn("src", F.lit(None).cast("string"))


def link_frontier(followed: DataFrame) -> DataFrame:
    """Link targets of expanded pages, one level deeper, in the domain of the page's task.

    ``followed`` has ``url_key``, ``depth`` and ``domain`` of the page and ``dst``, the
    normalized target.
    """
    return followed.select(
        F.col("dst").alias("url"),
        (F.col("depth") + 1).alias("depth"),
        "domain",
        F.col("dst").alias("url_key"),
        F.col("url_key").alias("src"),
    )


def sitemap_frontier(listed: DataFrame, depth: int = 1) -> DataFrame:
    """Pages listed by the sitemaps of a domain, as frontier rows."""
    rows = listed.select("url", F.lit(depth).alias("depth"), "domain")
    return U.with_normal_url(rows, "url", "url_key").withColumn("src", F.lit(None).cast("string"))


def frontier_union(*parts: DataFrame) -> DataFrame:
    """The frontiers of several producers as one."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def first_discovery(frontier: DataFrame) -> DataFrame:
    """One row per URL, the discovery with the smallest depth, then domain, source, spelling.

    A minimum and not a window: rows of a URL that half the web links to are combined before
    the shuffle.
    """
    # A struct minimum sorts NULL first, so seeds and sitemap entries win over links.
    best = F.min(F.struct("depth", "domain", "src", "url")).alias("best")
    return frontier.groupBy("url_key").agg(best).select(
        "best.url", "best.depth", "best.domain", "url_key", "best.src"
    )


def unvisited(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """Frontier rows whose URL was not visited before, each URL once."""
    return _without(first_discovery(frontier), visited)


def not_in_rounds(frontier: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """J1 for a crawl: frontier rows of no earlier round, each URL once.

    One join a round: a round that is bucketed by ``url_key`` is read in place, which a union of
    rounds would not be.
    """
    new = first_discovery(frontier)
    for visited in rounds:
        new = _without(new, visited)
    return new


def _without(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    return frontier.join(visited.select("url_key"), "url_key", "left_anti")


def fetch_join(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier rows joined with their pages. "Fetching" is a join on the normalized URL.

    ``frontier`` has each ``url_key`` once. A frontier that is measured as small is broadcast and
    the pages do not move. Beyond that, a bit filter of the frontier's keys cuts the pages down in place,
    and what passes is joined with a URL stored many times spread over tasks. The frontier, often the links of all pages, and
    the pages that pass are written once, as each of these steps reads them again.
    """
    frontier = materialize(frontier, "wanted")
    wanted = frontier.withColumn("_wanted", F.lit(True))
    if fits_broadcast(frontier, S.BROADCAST_LIMIT_BYTES):
        return pages.join(F.broadcast(frontier), "url_key")
    near = may_match(pages, "url_key", materialize(key_bits(frontier.select("url_key"), "url_key"), "frontier-bits"))
    near = materialize(near, "near")
    found = salted_join(near, wanted, "url_key", S.ROWS_PER_TASK).where(F.col("_wanted"))
    return found.drop("_wanted")


def unfetched(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier rows without a page. They stay visited and are not tried again."""
    return frontier.join(pages.select("url_key").distinct(), "url_key", "left_anti")


def max_urls_per_domain(products: DataFrame, n: int = S.MAX_URLS_PER_DOMAIN) -> DataFrame:
    """At most ``n`` product URLs per domain, the shallowest first, then by URL."""
    return first_n_per_group(products, ["domain"], [F.col("depth"), F.col("url")], n)


def frontier_cap(frontier: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """``(kept, dropped)`` with at most ``n`` frontier rows per domain, shallowest first.

    A bound on one round's work. It loses pages, so the crawl uses it only on request, and
    reports what was dropped.
    """
    kept = first_n_per_group(frontier, ["domain"], [F.col("depth"), F.col("url_key")], n)
    return kept, frontier.join(kept.select("url_key", "domain"), ["url_key", "domain"], "left_anti")


def round_bound(frontier: DataFrame, n: int, ranges: int = 1000, at_once: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """``(kept, dropped)`` with the first ``n`` rows of a whole round by depth, then URL.

    ``frontier`` has each ``url_key`` once. The last key that stays is found by counting: rows by depth, then the rows of
    the deciding depth in ``ranges`` ranges of URLs, then those of the deciding range again, until at most
    ``at_once`` URLs are left to be sorted. What stays is one filter on the rows, which are written once; nothing is sorted as a whole.
    """
    frontier = materialize(frontier, "round")
    keys = frontier.select("depth", "url_key")
    left, last_depth = n, None
    for row in keys.groupBy("depth").count().orderBy("depth").collect():  # as many as the crawl has depths
        last_depth = row["depth"]
        if left <= row["count"]:
            break
        left -= row["count"]
    else:
        return frontier, frontier.where("false")
    keys, last_key = keys.where(F.col("depth") == last_depth).select("url_key"), None
    while left > 0:
        size = keys.count()
        if size <= at_once:
            last_key = keys.orderBy("url_key").limit(left).collect()[-1][0]
            break
        sample = keys.orderBy(F.xxhash64("url_key"), "url_key").limit(ranges).collect()
        bounds = sorted((r[0] for r in sample), key=lambda k: k.encode())
        # Range i holds the keys from bound i on; a bound's own key is in the range it starts.
        ranged = keys.withColumn("_range", count_up_to(F.lit(bounds), F.col("url_key")))
        for row in ranged.groupBy("_range").count().orderBy("_range").collect():
            if left <= row["count"]:
                break
            left -= row["count"]
        keys = materialize(ranged.where(F.col("_range") == row["_range"]).drop("_range"), "round-keys")
    in_last = F.lit(False) if last_key is None else F.col("url_key") <= last_key
    stays = (F.col("depth") < last_depth) | ((F.col("depth") == last_depth) & in_last)
    return frontier.where(stays), frontier.where(~stays)


def politeness_plan(judged: DataFrame) -> DataFrame:
    """Earliest start of each fetch, ``(rank in host - 1) * delay`` seconds.

    ``judged`` has distinct ``(host, depth, url)`` and ``delay_s``.
    """
    return rank_in_group(judged, "host", ["depth", "url"], "rank_in_host").withColumn(
        "start_s", (F.col("rank_in_host") - 1) * F.col("delay_s")
    )
