"""Search-result scan (S4) and next-link extraction (C12) over Bundle pages.

The reference pages through a server one request at a time; here the pages
are data (files or a table of Bundle JSON), so every page is read in
parallel and entries are exploded with a generator — a narrow operation.
A page that is not a Bundle, or has no ``entry`` array, yields nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def next_link(page: Column) -> Column:
    """Url of the first ``link`` whose relation is ``next`` (NULL if none)."""
    links = F.try_variant_get(page, "$.link", "array<variant>")
    nxt = F.filter(links, lambda l: F.coalesce(F.try_variant_get(l, "$.relation", "string") == "next", F.lit(False)))
    url = F.try_variant_get(F.try_element_at(nxt, F.lit(1)), "$.url", "string")
    return F.when(url != "", url)


def bundle_resources(pages: DataFrame, page_col: str = "page", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per ``entry[].resource`` that exists, with its page and position."""
    p = F.col(page_col)
    is_bundle = F.coalesce(F.try_variant_get(p, "$.resourceType", "string") == "Bundle", F.lit(False))
    entries = F.try_variant_get(p, "$.entry", "array<variant>")
    ok = pages.where(is_bundle & entries.isNotNull())
    ex = ok.select(*[F.col(c) for c in keep], F.posexplode(F.try_variant_get(p, "$.entry", "array<variant>"))
                   .alias("entry_pos", "entry"))
    res = F.try_variant_get(F.col("entry"), "$.resource", "variant")
    return ex.where(res.isNotNull() & ~F.is_variant_null(res)).select(
        *[F.col(c) for c in keep], "entry_pos", res.alias("resource"))


def read_bundle_pages(spark: SparkSession, path: str) -> DataFrame:
    """Bundle pages from JSON files: one page per file, one per line, or any
    pages after each other.  Text that isn't JSON gives a null page."""
    from weft.sources.records import values_of_text

    pages = spark.read.text(path, wholetext=True).select(F.explode(values_of_text(F.col("value"))).alias("text"))
    return pages.select(F.try_parse_json("text").alias("page"))
