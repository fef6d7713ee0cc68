"""Signals, score and product decision of each page.

One narrow stage: no shuffle, and the wide ``html`` column ends where the signals begin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescout import settings as S
from pagescout.functions import html as H
from pagescout.functions import urls as U
from pagescout.functions.steps import settle
from pagescout.operators.skew import salted_join
from pagescout.storage import materialize


class PageColumns:
    """What a signal may look at; every column is computed once per page, and only if used.

    ``url`` normalized URL, ``html`` page as stored, ``markup`` page without comments and
    script text, ``tags`` array of start tags, ``metas`` array of ``meta`` facts,
    ``breadcrumbs`` array of breadcrumb texts, ``canonical`` href of the canonical link,
    ``anchor_share`` links per element.
    """

    _NAMES = {
        "url": "url_key",
        "html": "html",
        "markup": "_markup",
        "tags": "_tags",
        "metas": "_metas",
        "breadcrumbs": "_crumbs",
        "canonical": "_canonical",
        "anchor_share": "_share",
    }

    def __init__(self) -> None:
        self.used: set[str] = set()

    def __getattr__(self, name: str) -> Column:
        if name not in self._NAMES:
            raise AttributeError(name)
        self.used.add(name)
        return F.col(self._NAMES[name])

    def reads_markup(self) -> bool:
        return bool(self.used - {"url", "html"})


SignalBuilder = Callable[[PageColumns], Column]

# The registry. Pass a changed copy to add, replace or leave out a signal.
SIGNALS: dict[str, SignalBuilder] = {
    "url_pattern": lambda p: U.matches_product_url(p.url),
    "meta": lambda p: H.meta_signal(p.metas),
    "breadcrumb": lambda p: H.breadcrumb_signal(p.breadcrumbs),
    "query_param": lambda p: U.has_product_param(p.url),
    "anchor_text": lambda p: H.anchor_text_signal(p.markup),
    "structured_data": lambda p: H.structured_data_signal(p.html),
    "canonical": lambda p: H.canonical_signal(p.canonical),
    "anchor_density": lambda p: H.anchor_density_signal(p.anchor_share),
}

def with_url_key(pages: DataFrame) -> DataFrame:
    """Adds the normalized URL unless it is there already."""
    if "url_key" in pages.columns:
        return pages
    return U.with_normal_url(pages, "url", "url_key")


def with_markup(pages: DataFrame) -> DataFrame:
    """Adds ``url_key`` and the intermediate results all HTML features share."""
    read = with_url_key(pages).withColumn("_markup", H.markup(F.col("html")))
    tags = F.col("_tags")
    return (
        settle(read.withColumn("_tags", H.start_tags(F.col("_markup"))), "_markup", "_tags")
        .withColumns(
            {
                "_metas": H.meta_facts(tags),
                "_crumb_pieces": H.breadcrumb_pieces(F.col("html"), tags),
                "_canonical": H.canonical_href(tags),
                "_share": H.anchor_share(tags),
            }
        )
        .withColumn("_crumb_spans", H.breadcrumb_spans(F.col("_crumb_pieces")))
        .withColumn("_crumbs", H.breadcrumb_texts(F.col("_crumb_pieces"), F.col("_crumb_spans")))
    )


def page_signals(
    pages: DataFrame,
    signals: dict[str, SignalBuilder] | None = None,
    weights: dict[str, int] | None = None,
    threshold: int = S.PRODUCT_THRESHOLD,
    keep: list[str] | None = None,
) -> DataFrame:
    """One ``sig_*`` flag per signal, ``anchor_density``, ``score`` and ``is_product``.

    ``weights`` overrides single weights; a signal without a weight counts 0. ``keep`` names
    columns of ``pages`` to carry along (default: all but ``html``). Without a signal that
    needs it the text is not read, and there is no ``anchor_density``.
    """
    return scored_pages(pages, signals, weights, threshold, keep or _narrow(pages))


def scored_pages(
    pages: DataFrame,
    signals: dict[str, SignalBuilder] | None,
    weights: dict[str, int] | None,
    threshold: int,
    keep: list[str],
    with_links: bool = False,
) -> DataFrame:
    """:func:`page_signals`, on request with the array ``links``, the different link tags, from the same pass."""
    chosen = SIGNALS if signals is None else signals
    page = PageColumns()
    computed = {f"sig_{name}": build(page) for name, build in chosen.items()}
    if "anchor_density" in chosen:
        computed["anchor_density"] = page.anchor_share
    if with_links:
        computed["links"] = F.array_distinct(H.link_tags(page.tags))
    marked = with_markup(pages) if page.reads_markup() else with_url_key(pages)
    flags = marked.select(
        *keep,
        "url_key",
        *[column.alias(name) for name, column in computed.items()],
    )
    return with_score(settle(flags, *computed), list(chosen), weights, threshold)


def _narrow(pages: DataFrame) -> list[str]:
    return [c for c in pages.columns if c not in ("html", "url_key")]


def with_score(
    flags: DataFrame,
    names: list[str] | None = None,
    weights: dict[str, int] | None = None,
    threshold: int = S.PRODUCT_THRESHOLD,
) -> DataFrame:
    """Weighted sum of the ``sig_*`` flags and the decision."""
    weight = {**S.SIGNAL_WEIGHTS, **(weights or {})}
    score = F.lit(0)
    for name in names or list(SIGNALS):
        score = score + F.when(F.col(f"sig_{name}"), weight.get(name, 0)).otherwise(0)
    return flags.withColumn("score", score).withColumn("is_product", F.col("score") >= threshold)


def with_sitemap_signal(flags: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """Optional ninth signal: adds ``sig_in_sitemap``, true for pages a product sitemap lists.

    ``flags`` is the result of :func:`page_signals`, so the join moves narrow rows only;
    ``with_score(flags, [*SIGNALS, "in_sitemap"], {"in_sitemap": ...})`` then counts it.
    ``sitemap_urls`` has a column ``url``.
    """
    listed = (
        U.with_normal_url(sitemap_urls.select("url"), "url", "url_key")
        .select("url_key")
        .distinct()
        .withColumn("_listed", F.lit(True))
    )
    return (
        salted_join(materialize(flags, "flags"), listed, "url_key", S.ROWS_PER_TASK)
        .withColumn("sig_in_sitemap", F.coalesce(F.col("_listed"), F.lit(False)))
        .drop("_listed")
    )


def product_pages(scored: DataFrame) -> DataFrame:
    """The pages that reached the threshold."""
    return scored.where(F.col("is_product"))


def pages_to_expand(scored: DataFrame, max_depth: int = S.MAX_DEPTH) -> DataFrame:
    """Pages whose links are followed: no product page, not at the maximum depth."""
    return scored.where(~F.col("is_product") & (F.col("depth") < max_depth))


def score_histogram(scored: DataFrame) -> DataFrame:
    """Pages per score."""
    return scored.groupBy("score").agg(F.count("*").alias("pages"))


def signal_rates(scored: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Pages for which each signal is true, one row per signal, from one aggregation."""
    names = names or list(SIGNALS)
    hits = scored.agg(*[F.count_if(f"sig_{n}").alias(n) for n in names], F.count("*").alias("pages"))
    return hits.unpivot("pages", names, "signal", "hits")


def canonical_urls(pages: DataFrame) -> DataFrame:
    """``url_key`` and the resolved canonical URL of every page that declares one."""
    hrefs = with_markup(pages).select("url_key", F.col("_canonical").alias("href"))
    declared = settle(hrefs, "href").where(F.col("href").isNotNull())
    resolved = U.with_resolved_url(U.with_base_parts(declared, "url_key"), "href")
    return U.with_normal_url(resolved, "abs_url", "canonical").select("url_key", "canonical")


def shared_canonicals(canonicals: DataFrame) -> DataFrame:
    """Pages that name the same canonical URL, counted."""
    return canonicals.groupBy("canonical").agg(
        F.count("*").alias("pages"), F.min("url_key").alias("first_page")
    )
