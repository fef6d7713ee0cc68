"""From stored pages to the product URLs: ``spark-submit pagescout/job.py --help``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagescout import settings as S
from pagescout.plans.crawl import CrawlOptions, crawl_closure
from pagescout.sources.sinks import write_product_json
from pagescout.sources.tables import ROBOTS_SCHEMA, SITEMAPS_SCHEMA, read_seeds, read_table


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Finds the product pages of the seeds' shops among stored pages.")
    p.add_argument("--seeds", required=True, help="text file, one URL a line")
    p.add_argument("--pages", required=True, help="table page_id, url, html, optionally status")
    p.add_argument("--robots", help="table host, status, body")
    p.add_argument("--sitemaps", help="table url, status, body")
    p.add_argument("--output", required=True, help="folder of the JSON document")
    p.add_argument("--format", default="parquet")
    p.add_argument("--max-depth", type=int, default=S.MAX_DEPTH)
    p.add_argument("--threshold", type=int, default=S.PRODUCT_THRESHOLD)
    p.add_argument("--user-agent", default=S.USER_AGENT_TOKEN)
    o = p.parse_args(args)
    spark = SparkSession.builder.appName("pagescout").getOrCreate()

    def table(path: str | None, schema: str):
        return read_table(spark, path, o.format) if path else spark.createDataFrame([], schema)

    result = crawl_closure(
        read_seeds(spark, o.seeds),
        read_table(spark, o.pages, o.format),
        table(o.robots, ROBOTS_SCHEMA),
        table(o.sitemaps, SITEMAPS_SCHEMA),
        CrawlOptions(max_depth=o.max_depth, threshold=o.threshold, user_agent=o.user_agent),
    )
    try:
        write_product_json(result.products, o.output)
    finally:
        result.close()


if __name__ == "__main__":
    main()
