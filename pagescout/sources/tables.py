"""Readers for the input tables.

Any format Spark reads will do; Parquet keeps the wide ``html`` column out of the scans that
do not need it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES_SCHEMA = "page_id BIGINT, url STRING, html STRING"
FETCHED_SCHEMA = PAGES_SCHEMA + ", status INT, fetched_at TIMESTAMP"
ROBOTS_SCHEMA = "host STRING, status INT, body STRING"
SITEMAPS_SCHEMA = "url STRING, status INT, body STRING"
SEEDS_SCHEMA = "url STRING"


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None):
    reader = spark.read.format(format)
    return (reader.schema(schema) if schema else reader).load(path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed URLs from a text file, one per line; blank lines and ``#`` comments are skipped."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("url")).where(
        (F.col("url") != "") & ~F.col("url").startswith("#")
    )


def scan_pages(pages: DataFrame) -> DataFrame:
    """Pages that were fetched. A status other than 200 means there is no page."""
    return pages.where("status = 200") if "status" in pages.columns else pages


def scan_robots(robots: DataFrame) -> DataFrame:
    """S3: one robots document per lower-cased host.

    Should a host have several, the smallest status and text win, so that the choice does not
    depend on the order of rows.
    """
    best = F.min(F.struct("status", "body")).alias("best")
    return robots.groupBy(F.lower("host").alias("host")).agg(best).select(
        "host", "best.status", "best.body"
    )
