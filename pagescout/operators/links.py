"""Links of pages.

The text of a page stops at its list of hrefs; from there on only narrow link rows move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescout.functions import html as H
from pagescout.functions import urls as U
from pagescout.functions.steps import settle
from pagescout.operators.signals import with_markup


def anchor_hrefs(pages: DataFrame) -> DataFrame:
    """H9: ``(src, pos, href)``, every anchor of every page in document order."""
    return _page_hrefs(pages).select(
        F.col("url_key").alias("src"), F.posexplode("hrefs").alias("pos", "href")
    )


def _page_hrefs(pages: DataFrame) -> DataFrame:
    hrefs = H.anchor_hrefs(F.col("_tags")).alias("hrefs")
    return settle(with_markup(pages).select("url_key", hrefs), "hrefs")


def judged_links(pages: DataFrame) -> DataFrame:
    """``(src, pos, href, dst, reject_reason)`` of every anchor.

    Links are resolved against the normalized page URL, that is without its trailing slash.
    """
    based = U.with_base_parts(_page_hrefs(pages), "url_key")
    anchors = based.select(
        F.col("url_key").alias("src"), *U.BASE_COLUMNS, F.posexplode("hrefs").alias("pos", "href")
    )
    return U.with_link_target(anchors, "href").select("src", "pos", "href", "dst", "reject_reason")


def page_links(pages: DataFrame) -> DataFrame:
    """L1: ``(src, pos, dst)``, each accepted target of a page once, at its first position.

    The links of a page leave its row together, so almost all duplicates fall to the partial
    aggregation before the shuffle.
    """
    return (
        judged_links(pages)
        .where(F.col("dst").isNotNull())
        .groupBy("src", "dst")
        .agg(F.min("pos").alias("pos"))
        .select("src", "pos", "dst")
    )


def rejected_links(links: DataFrame) -> DataFrame:
    """L2: the links that are not followed, with the reason."""
    return links.where(F.col("reject_reason").isNotNull())


def rejection_counts(links: DataFrame) -> DataFrame:
    """L2: rejected links per reason."""
    return rejected_links(links).groupBy("reject_reason").agg(F.count("*").alias("links"))


def next_page_links(pages: DataFrame) -> DataFrame:
    """Accepted links that lead to the next page of a list, ``(src, dst)``."""
    followed = F.filter(
        H.anchors(F.col("_markup")), lambda a: H.is_next_link(a["rel"], a["text"])
    )
    found = with_markup(pages).select("url_key", followed["href"].alias("hrefs"))
    based = U.with_base_parts(settle(found, "hrefs"), "url_key")
    anchors = based.select(
        F.col("url_key").alias("src"), *U.BASE_COLUMNS, F.explode("hrefs").alias("href")
    )
    return (
        U.with_link_target(anchors, "href")
        .where(F.col("dst").isNotNull())
        .select("src", "dst")
        .distinct()
    )
