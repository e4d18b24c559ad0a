"""HTML source: tags as ELEMENT rows, CONTAINS from the document, links and style imports, by regular expressions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = r"<([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>"


def elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, ord, tag): opening tags in order."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(TAG), F.lit(1))).alias("ord", "tag")).withColumn("tag", F.lower("tag"))


def attributes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, ord, tag, attrs): opening tags in order with a map of their attributes; names in lower case, the first of equal names counts."""
    tags = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(TAG), F.lit(0))).alias("ord", "_tag"))
    pair = r"""([^\s"'>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    found = F.regexp_extract_all("_tag", F.lit(pair), F.lit(0))
    pairs = F.transform(found, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("k"), F.regexp_replace(F.regexp_replace(x, r"^[^=]*=\s*", ""), r"""^["']|["']$""", "").alias("v")))
    first = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda y: y["k"] == x["k"]))
    return tags.select(key, "ord", F.lower(F.regexp_extract("_tag", TAG, 1)).alias("tag"), F.map_from_entries(first).alias("attrs"))


def graph(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, source, relation_type, target): CONTAINS from the document to each element, LINKS_TO of web addresses, IMPORTS_STYLE of style sheets."""
    e = attributes(pages, key, html).withColumn("href", F.try_element_at("attrs", F.lit("href")))
    element = F.concat(F.col("tag"), F.lit("#"), F.col("ord").cast("string"))
    style = (F.col("tag") == "link") & F.array_contains(F.split(F.lower(F.try_element_at("attrs", F.lit("rel"))), r"\s+"), "stylesheet")
    kinds = F.array(
        F.struct(F.lit("document").alias("source"), F.lit("CONTAINS").alias("relation_type"), element.alias("target")),
        F.when((F.col("tag") == "a") & F.rlike("href", F.lit("^(https?:)?//")), F.struct(element.alias("source"), F.lit("LINKS_TO").alias("relation_type"), F.col("href").alias("target"))),
        F.when(style & F.col("href").isNotNull(), F.struct(F.lit("document").alias("source"), F.lit("IMPORTS_STYLE").alias("relation_type"), F.col("href").alias("target"))),
    )
    return e.select(key, F.inline(F.array_compact(kinds)))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, href, kind): LINKS_TO for absolute and protocol-relative targets, else LOCAL."""
    hrefs = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))
    return hrefs.withColumn("kind", F.when(F.rlike("href", F.lit(r"^(https?:)?//")), "LINKS_TO").otherwise("LOCAL"))
