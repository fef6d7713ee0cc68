"""Sitemap documents as Column expressions (M1, M2).

``from_xml`` gives NULLs for malformed input and tolerates name spaces; ``xpath`` would fail
the whole job on the first broken document.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPTIONS = {"ignoreNamespace": "true"}
_PROLOG = r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*"
_URLSET_ROOT = _PROLOG + r"<(?:[\w.\-]+:)?urlset[\s/>]"


def is_sitemap_index(body: Column) -> Column:
    """The document is an index of sitemaps and not a list of pages."""
    return body.contains("<sitemapindex")


def urlset_locs(body: Column) -> Column:
    """M1: page URLs of a ``urlset`` document; empty for anything else."""
    locs = F.from_xml(body, "url ARRAY<STRUCT<loc: STRING>>", _OPTIONS)["url"]["loc"]
    return F.when(body.rlike(_URLSET_ROOT), _trimmed(locs)).otherwise(_none())


def index_locs(body: Column) -> Column:
    """M2: sitemap URLs of an index document; empty for anything else."""
    locs = F.from_xml(body, "sitemap ARRAY<STRUCT<loc: STRING>>", _OPTIONS)["sitemap"]["loc"]
    return F.when(is_sitemap_index(body), _trimmed(locs)).otherwise(_none())


def _trimmed(locs: Column) -> Column:
    kept = F.filter(F.transform(locs, lambda u: F.trim(u, F.lit(" \t\r\n"))), lambda u: u != "")
    return F.coalesce(kept, _none())


def _none() -> Column:
    return F.array().cast("array<string>")
