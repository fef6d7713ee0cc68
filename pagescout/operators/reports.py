"""Results and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescout import settings as S
from pagescout.operators.skew import rank_in_group, salted_join
from pagescout.storage import materialize


def distinct_products(products: DataFrame) -> DataFrame:
    """A1: each product URL once per domain."""
    return products.select("domain", "url").distinct()


def product_count(products: DataFrame) -> DataFrame:
    """A2: distinct product URLs over all domains."""
    return distinct_products(products).agg(F.count("*").alias("products"))


def product_count_by_domain(products: DataFrame) -> DataFrame:
    """A2: distinct product URLs per domain."""
    return distinct_products(products).groupBy("domain").agg(F.count("*").alias("products"))


def visited_urls(visited: DataFrame) -> DataFrame:
    """All visited normalized URLs."""
    return visited.select("url_key").distinct()


def visited_count(visited: DataFrame, approximate: bool = False) -> DataFrame:
    """A3: number of visited URLs; the approximate form needs no shuffle of the URLs."""
    count = F.approx_count_distinct("url_key") if approximate else F.count_distinct("url_key")
    return visited.agg(count.alias("visited"))


def visited_sketches(visited: DataFrame, by: list[str], precision: int = S.SKETCH_PRECISION) -> DataFrame:
    """A3: ``(*by, sketch)``, a distinct sketch of the visited URLs of each group, a few KiB each.

    Kept with a round, sketches answer later questions without the URLs: :func:`sketched_count` unites them.
    """
    return visited.groupBy(*by).agg(F.hll_sketch_agg("url_key", precision).alias("sketch"))


def sketched_count(sketches: DataFrame, by: list[str]) -> DataFrame:
    """A3: ``(*by, visited)``, distinct URLs over all rounds and groups that are united, about.

    The standard error is ``1.04 / sqrt(2^precision)``, 1.6 percent at 12; three of them, 5 percent, hold 99.7
    percent of all answers.
    """
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("visited"))


def product_urls_by_domain(products: DataFrame, chunk: int = S.URLS_PER_DOCUMENT) -> DataFrame:
    """``(domain, chunk, product_urls)`` with sorted, distinct URLs.

    A domain with up to ``chunk`` URLs has a single row, chunk 0. A larger one continues in
    further rows, so no task ever holds all URLs of a domain.
    """
    ranked = rank_in_group(distinct_products(products), "domain", ["url"], "rank")
    chunk_no = F.floor((F.col("rank") - 1) / chunk).cast("int")
    return (
        ranked.groupBy("domain", chunk_no.alias("chunk"))
        .agg(F.array_sort(F.collect_list("url")).alias("product_urls"))
    )


class TooLargeForOneRow(ValueError):
    """The result does not fit one row; ``size`` and ``limit`` are bytes."""

    def __init__(self, size: int, limit: int):
        super().__init__(f"the products take {size} bytes and one row at most {limit}: use product_urls_by_domain or write_product_json")
        self.size, self.limit = size, limit


def product_map_bytes(by_domain: DataFrame) -> int:
    """Bytes of the domains and URLs of a result, summed where the rows are."""
    urls = F.aggregate("product_urls", F.lit(0).cast("long"), lambda n, u: n + F.octet_length(u) + 8)
    return by_domain.agg(F.coalesce(F.sum(F.octet_length("domain") + urls), F.lit(0))).first()[0]


def product_map(by_domain: DataFrame, limit: int = S.ONE_ROW_BYTES) -> DataFrame:
    """The whole result as one ``MAP<STRING, ARRAY<STRING>>`` row, all chunks of a domain in order.

    One row by definition, so it is measured first and built up to ``limit`` bytes only; beyond that
    :class:`TooLargeForOneRow` tells the size. Results of any size are rows of :func:`product_urls_by_domain`.
    """
    size = product_map_bytes(by_domain)
    if size > limit:
        raise TooLargeForOneRow(size, limit)
    chunks = F.array_sort(F.collect_list(F.struct("chunk", "product_urls")))
    whole = F.flatten(F.transform(chunks, lambda c: c["product_urls"])).alias("product_urls")
    entries = F.collect_list(F.struct("domain", "product_urls"))
    return by_domain.groupBy("domain").agg(whole).agg(F.map_from_entries(entries).alias("products"))


def crawl_report(
    seeds: DataFrame, visited: DataFrame, products: DataFrame, seconds: float | None = None
) -> DataFrame:
    """A5: pages, products, errors and rates per domain, and for all domains together.

    ``visited`` has ``domain`` and ``fetched``. The row with ``domain`` NULL is the total.
    ``covered`` counts seed domains with at least one product.
    """
    domains = seeds.select("domain").distinct()
    pages = visited.groupBy("domain").agg(
        F.count("*").alias("visited"), F.count_if(~F.col("fetched")).alias("errors")
    )
    found = product_count_by_domain(products)
    per_domain = domains.join(pages, "domain", "left").join(found, "domain", "left").na.fill(0)
    total = per_domain.rollup("domain").agg(
        F.sum("visited").alias("visited"),
        F.sum("errors").alias("errors"),
        F.sum("products").alias("products"),
        F.count_if(F.col("products") > 0).alias("covered"),
        F.count("*").alias("domains"),
    )
    report = total.withColumn("error_rate", _ratio("errors", "visited")).withColumn(
        "coverage", _ratio("covered", "domains")
    )
    if seconds is not None:
        report = report.withColumn("urls_per_s", F.col("visited") / F.lit(float(seconds)))
    return report


def _ratio(part: str, whole: str) -> Column:
    return F.col(part) / F.nullif(F.col(whole), F.lit(0))


def detection_accuracy(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Confusion counts and rates of ``is_product`` against labelled URLs.

    ``labels`` has each ``url_key`` once, with ``label`` (boolean).
    """
    said, true = F.col("is_product"), F.col("label")
    labelled = salted_join(
        materialize(scored.select("url_key", "is_product"), "decisions"), labels, "url_key", S.ROWS_PER_TASK
    ).where(true.isNotNull())
    counts = labelled.agg(
        F.count_if(said & true).alias("true_pos"),
        F.count_if(said & ~true).alias("false_pos"),
        F.count_if(~said & true).alias("false_neg"),
        F.count_if(~said & ~true).alias("true_neg"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("true_pos", "false_pos", "false_neg", "true_neg"))
    zero = F.lit(0)
    return (
        counts.withColumn("accuracy", (tp + tn) / F.nullif(tp + fp + fn + tn, zero))
        .withColumn("precision", tp / F.nullif(tp + fp, zero))
        .withColumn("recall", tp / F.nullif(tp + fn, zero))
    )


def stall_monitor(
    progress: DataFrame,
    tick_seconds: int = S.MONITOR_SECONDS,
    count: Column | None = None,
) -> DataFrame:
    """``(tick, visited, stalled)``, the cumulated count at each tick of the run.

    ``progress`` has ``ts``, one row per visited URL, or pre-counted rows with ``count``. A
    tick is stalled when nothing was added since the tick before; before the first tick the
    count is 0. The running sum goes by day: inside a day, plus the total of earlier days, so
    only one row per day ever meets in a single task.
    """
    seconds = F.unix_timestamp(F.col("ts"))
    at = F.timestamp_seconds(F.ceil((seconds + 1) / tick_seconds).cast("long") * tick_seconds)
    added = progress.groupBy(at.alias("tick")).agg(
        F.coalesce(F.sum(count if count is not None else F.lit(1)), F.lit(0)).alias("added")
    )
    step = F.make_dt_interval(secs=F.lit(tick_seconds))
    bounds = added.agg(F.min("tick").alias("lo"), F.max("tick").alias("hi"))
    day_step = F.make_dt_interval(days=F.lit(1))
    days = bounds.select(
        "lo",
        "hi",
        F.explode(
            F.sequence(F.date_trunc("day", "lo"), F.date_trunc("day", "hi"), day_step)
        ).alias("day"),
    )
    day_ticks = F.sequence(
        F.greatest("lo", _first_tick(F.col("day"), tick_seconds)),
        F.least(F.col("hi"), F.col("day") + day_step - F.make_dt_interval(secs=F.lit(1))),
        step,
    )
    spine = (
        days.repartition("day")
        .where(F.col("hi") >= _first_tick(F.col("day"), tick_seconds))
        .where(_first_tick(F.col("day"), tick_seconds) < F.col("day") + day_step)
        .select("day", F.explode(day_ticks).alias("tick"))
    )
    counts = spine.join(added, "tick", "left").select(
        "day", "tick", F.coalesce("added", F.lit(0)).alias("added")
    )
    earlier_days = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    in_day = Window.partitionBy("day").orderBy("tick")
    before = (
        counts.groupBy("day")
        .agg(F.sum("added").alias("day_total"))
        .select("day", F.coalesce(F.sum("day_total").over(earlier_days), F.lit(0)).alias("before"))
    )
    return counts.join(before, "day").select(
        "tick",
        (F.col("before") + F.sum("added").over(in_day)).alias("visited"),
        (F.col("added") == 0).alias("stalled"),
    )


def _first_tick(day: Column, tick_seconds: int) -> Column:
    start = F.unix_timestamp(day)
    return F.timestamp_seconds(F.ceil(start / tick_seconds).cast("long") * tick_seconds)
