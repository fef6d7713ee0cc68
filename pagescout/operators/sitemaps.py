"""Sitemap discovery.

Input: ``sitemaps(url, status, body)``. Listed URLs take over the domain of the seed whose
sitemap lists them and are not filtered by host or extension here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescout import settings as S
from pagescout.functions import urls as U
from pagescout.functions import xml as X
from pagescout.functions.steps import settle


def sitemap_probes(seeds: DataFrame) -> DataFrame:
    """``(url, domain, sitemap_url)``, the places where a seed's sitemap may be.

    A fragment of the seed is no part of the place, and a trailing slash does not lead to a
    doubled one.
    """
    root = F.regexp_replace(F.regexp_replace(F.col("url"), "#.*$", ""), "/+$", "")
    places = F.array(*[F.concat(root, F.lit(path)) for path in S.SITEMAP_PATHS])
    return seeds.select("url", "domain", F.explode(places).alias("sitemap_url"))


def scan_sitemaps(seeds: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """The sitemap documents that exist for the seeds, ``(domain, sitemap_url, body)``.

    Places are compared as normalized URLs without the default port, so neither the spelling of a
    seed's host nor a written ``:443`` matters; ``sitemap_url`` is the document's own.
    """
    found = _keyed(sitemaps.where(F.col("status") == 200)).select("_key", F.col("url").alias("sitemap_url"), "body")
    probes = _keyed(sitemap_probes(seeds), "sitemap_url").select("domain", "_key").distinct()
    return probes.join(found, "_key").drop("_key")


def _keyed(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``_key``, the normalized place without the port its scheme has anyway."""
    key = F.col("_key")
    for scheme, port in S.DEFAULT_PORTS.items():
        key = F.regexp_replace(key, rf"^({scheme}://[^/?#]*):{port}(?=[/?#]|$)", "$1")
    return U.with_normal_url(df, url, "_key").withColumn("_key", key)


def sitemap_index_locs(documents: DataFrame, strict: bool = False) -> DataFrame:
    """M2: ``(domain, sitemap_url, loc)``, the product sitemaps an index names."""
    indexes = documents.where(X.is_sitemap_index(F.col("body"))).select(
        "domain", "sitemap_url", X.index_locs(F.col("body")).alias("locs")
    )
    return (
        settle(indexes, "locs")
        .select("domain", "sitemap_url", F.explode("locs").alias("loc"))
        .where(U.is_product_sitemap(F.col("loc"), strict))
    )


def sitemap_urls(documents: DataFrame) -> DataFrame:
    """M1: one row per page URL ``loc`` that a urlset document lists, in place of ``body``."""
    listed = documents.withColumn("locs", X.urlset_locs(F.col("body"))).drop("body")
    return settle(listed, "locs").withColumn("loc", F.explode("locs")).drop("locs")


def sitemap_children(index_locs: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """``(domain, loc)``, the pages listed by the sitemaps that indexes name.

    Each child document is parsed once, however many indexes name it. A nested index lists no
    pages and is not followed.
    """
    children = _keyed(index_locs, "loc").select("_key", "domain").distinct()
    wanted = children.select("_key").distinct()
    documents = _keyed(sitemaps).select("_key", "body").join(wanted, "_key", "left_semi")
    return sitemap_urls(documents).join(children, "_key").select("domain", "loc")


def sitemap_products(seeds: DataFrame, sitemaps: DataFrame, strict: bool = False) -> DataFrame:
    """``(domain, url)``, all pages that the product sitemaps of the seeds list.

    A broken document is skipped and costs the others nothing.
    """
    documents = scan_sitemaps(seeds, sitemaps)
    plain = documents.where(
        ~X.is_sitemap_index(F.col("body")) & U.is_product_sitemap(F.col("sitemap_url"), strict)
    )
    listed = sitemap_urls(plain).select("domain", F.col("loc").alias("url"))
    nested = sitemap_children(sitemap_index_locs(documents, strict), sitemaps)
    return listed.unionByName(nested.withColumnRenamed("loc", "url")).distinct()
