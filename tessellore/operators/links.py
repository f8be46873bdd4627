"""Links between pages: discovery, classification, and the crawl's frontier as rounds of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellore.functions.text import KINDS, SEGMENTS
from tessellore.runtime import broadcast_if_small, checkpoint

# Link patterns and the shape of a slug.
MARKDOWN_LINK = r"(?<!!)\[(?:[^\]]*?)\]\(([^)\s]+)\)"
HREF = r"""\bhref=["']([^"'\s<>]+)["']"""
MACRO_LINK = r"^(doc|ref|changelog):([A-Za-z0-9][A-Za-z0-9._-]*)$"
SLUG = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
MOST_PAGES = 1000


def _resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b: str | None, x: str | None) -> str | None:
        try:
            return urljoin(b or "", x) if x is not None else None
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link)], dtype=object)


def raw_links(body: Column, html: Column) -> Column:
    """The targets of Markdown links in the body, then of all href attributes of the page, in order."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(F.regexp_extract_all(body, F.lit(MARKDOWN_LINK), F.lit(1)), none), F.coalesce(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), none))


def link_body(props: Column) -> Column:
    """All bodies that embedded JSON may hold, joined by blank lines."""
    several = F.from_json(F.get_json_object(props, "$.changelogs"), "array<struct<body:string>>")
    bodies = F.concat(
        F.array(F.get_json_object(props, "$.doc.body"), F.get_json_object(props, "$.changelog.body")),
        F.coalesce(F.transform(several, lambda c: c["body"]), F.array().cast("array<string>")),
        F.array(F.get_json_object(props, "$.custompage.body")),
    )
    return F.array_join(F.filter(bodies, lambda b: b.isNotNull() & (b != "")), "\n\n")


def internal_links(pages: DataFrame) -> DataFrame:
    """The internal links of pages (source_url, body, html, base_url, section): one row per page and target, in order seen.

    A macro with an anchor is not a link here; a target counts if it lies under base and section with a
    known segment and a slug.
    """
    seen = pages.select("source_url", "base_url", "section", F.posexplode(raw_links(F.col("body"), F.col("html"))).alias("position", "raw"))
    raw = F.regexp_replace(F.col("raw"), r"(?U)^\s+|\s+$", "")
    prefix = F.concat(F.regexp_replace("base_url", "/+$", ""), F.lit("/"), F.col("section"), F.lit("/"))
    macro = F.regexp_extract(raw, MACRO_LINK, 1)
    segment = F.element_at(F.create_map(*(F.lit(x) for pair in SEGMENTS.items() for x in pair)), macro)
    seen = seen.select("source_url", "position", prefix.alias("prefix"), raw.alias("raw"), macro.alias("macro"), F.when(macro != "", F.concat(prefix, segment, F.lit("/"), F.regexp_extract(raw, MACRO_LINK, 2))).alias("by_macro"))
    absolute = F.pandas_udf(_resolve, "string")(F.col("source_url"), F.col("raw"))
    bare = F.regexp_replace(absolute, r"(?s)[#?].*$", "")
    found = seen.withColumn("url", F.coalesce("by_macro", F.when(F.col("macro") == "", bare))).filter(F.col("url").isNotNull() & F.startswith("url", "prefix"))
    tail = F.split(F.regexp_replace(F.expr("substring(url, length(prefix) + 1)"), "/+$", ""), "/")
    known = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    found = found.withColumn("tail", tail).filter(F.size("tail") == 2).withColumn("kind", F.try_element_at(known, F.col("tail")[0])).withColumn("slug", F.col("tail")[1])
    found = found.filter(F.col("kind").isNotNull() & F.col("slug").rlike(SLUG))
    return found.groupBy("source_url", "url").agg(F.min(F.struct("position", "kind", "slug")).alias("first")).select("source_url", "url", "first.kind", "first.slug", "first.position")


def new_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """Targets that are not known yet, each once, with the first page that showed them."""
    fresh = links.join(known.select("url").distinct(), "url", "left_anti")
    return fresh.groupBy("url").agg(F.min(F.struct("source_url", "position", "kind", "slug")).alias("first")).select("url", "first.kind", "first.slug", F.col("first.source_url").alias("found_on"))


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], most_pages: int | None = MOST_PAGES, limit: int | None = None) -> DataFrame:
    """All pages reachable from the seeds (url): breadth first in rounds until no new page is found, each fetched once.

    ``fetch`` turns rows of url into pages with source_url, body, html, base_url, section and is_page;
    links are only followed from rows that gave a page. The frontier stops growing at ``most_pages`` (None:
    never). With ``limit`` only that many seeds are fetched and no links are followed.
    """
    if limit is not None:
        return seeds.select("url").distinct().orderBy("url").limit(limit).select("url", F.lit(0).alias("round"))
    known = checkpoint(seeds.select("url", F.lit(0).alias("round")).dropDuplicates(["url"]))
    todo, count, number = known, known.count(), 0
    while most_pages is None or count < most_pages:
        number += 1
        found = new_links(internal_links(fetch(todo.select("url")).filter("is_page")), known)
        if most_pages is not None:
            found = found.orderBy("found_on", "url").limit(most_pages - count)
        todo = checkpoint(found.select("url", F.lit(number).alias("round")))
        if (fresh := todo.count()) == 0:
            break
        known, count = checkpoint(known.unionByName(todo)), count + fresh
    return known


def page_links(records: DataFrame, sites: DataFrame) -> DataFrame:
    """The internal links of page records: their bodies, resolved against their own address."""
    known = sites.select(F.col("site_key").alias("source"), "base_url", F.col("section_prefix").alias("section"))
    rows = records.select("page_id", "source", F.col("url").alias("source_url"), F.col("body_md").alias("body")).join(broadcast_if_small(known), "source")
    return internal_links(rows.withColumn("html", F.lit(None).cast("string")))
