"""JSON output of the product URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescout import settings as S
from pagescout.operators.reports import distinct_products, product_urls_by_domain
from pagescout.operators.skew import lookup_join
from pagescout.storage import materialize


def product_json_lines(products: DataFrame) -> DataFrame:
    """``(domain, url, text)``: the pieces of one pretty-printed JSON document.

    The texts, joined by line breaks in the order of domain and URL, form the object
    ``{domain: [urls]}`` with an indent of two. First and last rows are found by grouped
    minima and maxima, so the document is never assembled anywhere, and a domain with a large
    part of all URLs is spread over tasks. Without products the document is ``{}``.
    """
    rows = materialize(distinct_products(products), "products")
    ends = rows.groupBy("domain").agg(
        F.min("url").alias("first_url"),
        F.max("url").alias("last_url"),
    )
    first_domain, last_domain = ends.agg(F.min("domain"), F.max("domain")).first()
    if first_domain is None:
        return rows.sparkSession.createDataFrame([(None, None, "{}")], "domain string, url string, text string")
    first, last = F.col("url") == F.col("first_url"), F.col("url") == F.col("last_url")
    opens = first & (F.col("domain") == first_domain)
    closes = last & (F.col("domain") == last_domain)
    text = F.concat(
        F.when(opens, "{\n").otherwise(""),
        F.when(first, F.concat(F.lit("  "), json_string(F.col("domain")), F.lit(": [\n"))).otherwise(""),
        F.lit("    "),
        json_string(F.col("url")),
        F.when(closes, "\n  ]\n}").when(last, "\n  ],").otherwise(","),
    )
    return lookup_join(rows, ends, "domain").select("domain", "url", text.alias("text"))


def json_string(text: Column) -> Column:
    """JSON string literal in which ``&``, ``<`` and ``>`` are escaped as well."""
    quoted = F.to_json(F.array(text))
    inner = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    for char, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        inner = F.replace(inner, F.lit(char), F.lit(code))
    return inner


def write_product_json(products: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Text files whose concatenation, in file order, is the JSON document; ``{}`` without products."""
    product_json_lines(products).orderBy("domain", "url").select("text").write.mode(mode).text(path)


def write_product_documents(
    products: DataFrame, path: str, mode: str = "overwrite", chunk: int = S.URLS_PER_DOCUMENT
) -> None:
    """JSON lines ``{"domain", "chunk", "product_urls"}``, written by all tasks at once."""
    product_urls_by_domain(products, chunk).write.mode(mode).json(path)
