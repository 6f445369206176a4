"""HTML pages to article records, as joins over a ``pages(url, html)`` table.

``sources(source, adapter, enabled, base_url, max_articles, selectors)`` is the registry, with selectors as a map.
``starts(source, start_idx, url)`` lists each source's start pages.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window, functions as F, types as T

from ..functions import text as X
from ..functions.markup import (Outline, extract_links, outline_attr, outline_text, page_outline, stored_attr, stored_links,
                                stored_text)
from ..functions.storage import cut
from .articles import normalize_articles, wall_time

SOURCES_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("adapter", T.StringType()),
    T.StructField("enabled", T.BooleanType()), T.StructField("base_url", T.StringType()),
    T.StructField("max_articles", T.IntegerType()),
    T.StructField("selectors", T.MapType(T.StringType(), T.StringType())),
])

_FIELDS = ["parse_error", "title", "publish_raw", "content", "channel"]


def read_list_detail(html, selectors):
    """Default adapter: ``(title, publish time text, content, channel)`` of one article page."""
    page = Outline(html)
    time = selectors.get("publish_time_selector") or ""
    channel = selectors.get("channel_selector") or ""
    published = (outline_attr(page, time, "datetime") or outline_text(page, time)) if time else ""
    return (outline_text(page, selectors["title_selector"]), published,
            outline_text(page, selectors["content_selector"], "\n"), outline_text(page, channel) if channel else "")


ADAPTERS = {"html_list_detail": read_list_detail}


def enabled_sources(sources, adapters=None):
    """Registry rows that are switched on and have a known adapter."""
    return sources.where(F.coalesce("enabled", F.lit(True)) & F.col("adapter").isin(list(adapters or ADAPTERS)))


def unknown_adapters(sources, adapters=None):
    """Switched-on registry rows that no adapter can read."""
    return sources.where(F.coalesce("enabled", F.lit(True)) & ~F.col("adapter").isin(list(adapters or ADAPTERS)))


def outline_pages(pages, known=None):
    """``pages`` with their ``outline``, stored. Pages whose HTML is in ``known``, an earlier result, are not parsed again."""
    if known is None:
        return cut(pages.withColumn("outline", page_outline("html")))
    seen = known.select(F.sha2("html", 256).alias("_hash"), F.col("outline").alias("_seen")).dropDuplicates(["_hash"])
    both = pages.join(seen, F.sha2("html", 256) == F.col("_hash"), "left")
    fresh = page_outline(F.when(F.col("_hash").isNull(), F.col("html")))
    return cut(both.select(*pages.columns, F.coalesce("_seen", fresh).alias("outline")))


def listing_links(pages, sources, starts, spread=64):
    """Article links per source: unique by first appearance over its start pages, the first ``max_articles`` of them.

    Links resolve against the source's ``base_url``, else its first start URL. Repeats shrink map-side. The first rows
    are taken per slice of a source and then per source, so a large source is never sorted in one task; sources with no
    limit (0 or NULL) are not ranked at all. An ``outline`` column of ``pages`` is used instead of parsing them.
    """
    first = starts.groupBy("source").agg(F.min_by("url", "start_idx").alias("_first"))
    plan = starts.join(first, "source").join(
        sources.select("source", "base_url", "max_articles",
                       F.col("selectors")["article_link_selector"].alias("_selector")), "source")
    base = F.coalesce(X.null_if_blank("base_url"), F.col("_first"))
    page = "outline" if "outline" in pages.columns else "html"
    hrefs = stored_links(F.col(page), F.col("_selector"), base) if page == "outline" else extract_links(page, "_selector", base)
    found = plan.join(pages.select("url", page), "url").select(
        "source", "start_idx", "max_articles", F.posexplode(hrefs).alias("pos", "link"))
    unique = found.groupBy("source", "link").agg(
        F.min(F.struct("start_idx", "pos")).alias("_at"), F.first("max_articles").alias("max_articles"))
    limit = F.coalesce("max_articles", F.lit(0))
    part = F.pmod(F.xxhash64("link"), F.lit(spread))
    sliced = Window.partitionBy("source", "_part").orderBy("_at")
    whole = Window.partitionBy("source").orderBy("_at")
    bounded = unique.where(limit > 0).withColumn("_part", part)
    bounded = bounded.withColumn("_rank", F.row_number().over(sliced)).where(F.col("_rank") <= limit)
    bounded = bounded.withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= limit)
    kept = bounded.drop("_rank", "_part").unionByName(unique.where(limit <= 0))
    return kept.select("source", "link", "_at.start_idx", "_at.pos")


def fetch_details(links, pages):
    """Links with the page they point to, and its ``outline`` if ``pages`` has it."""
    found = [c for c in ("html", "outline") if c in pages.columns]
    return links.join(pages.select(F.col("url").alias("link"), *found), "link")


def missing_details(links, pages):
    """Links without a page."""
    return links.join(pages.select(F.col("url").alias("link")), "link", "left_anti")


def _stored_fields():
    """``read_list_detail`` on the columns ``outline`` and ``selectors``."""
    page, chosen = F.col("outline"), lambda name: F.try_element_at("selectors", F.lit(f"{name}_selector"))
    error = F.coalesce(*[F.when(chosen(name).isNull(), F.lit(f"KeyError: '{name}_selector'")).when(
        F.trim(chosen(name)) == "", F.lit(f"ValueError: {name}_selector is blank")) for name in ("title", "content")])
    when = F.coalesce(X.null_if_blank(stored_attr(page, chosen("publish_time"), "datetime")), stored_text(page, chosen("publish_time")))
    fields = {"title": stored_text(page, chosen("title")), "publish_raw": when,
              "content": stored_text(page, chosen("content"), "\n"), "channel": stored_text(page, chosen("channel"))}
    return [error.alias("parse_error"), *[F.when(error.isNull(), c).alias(name) for name, c in fields.items()]]


def parse_articles(details, sources, crawl_time=None, adapters=None, zone="Asia/Shanghai"):
    """Article records of fetched pages, with ``parse_error`` and ``reject_reason``; nothing is dropped.

    ``crawl_time`` is one NTZ timestamp column for the run (default: now). A ``publish_time`` column of ``details``
    stands in when the page has no time. With an ``outline`` column the default adapter reads that and parses nothing;
    other adapters get the HTML. The fields read so are stored.
    """
    readers = dict(adapters or ADAPTERS)
    joined = details.join(sources.select("source", "adapter", "selectors"), "source")
    kept = [c for c in details.columns if c not in ("html", "outline")]
    schema = T.StructType([details.schema[c] for c in kept] + [T.StructField(c, T.StringType()) for c in _FIELDS])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for html, adapter, selectors in zip(frame["html"], frame["adapter"], frame["selectors"]):
                try:
                    rows.append((None, *readers[adapter](html, dict(selectors))))
                except Exception as error:  # a page that cannot be read is reported, not fatal
                    rows.append((f"{type(error).__name__}: {error}", None, None, None, None))
            found = pd.DataFrame(rows, columns=_FIELDS, index=frame.index, dtype=object)
            yield pd.concat([frame[kept], found], axis=1)

    stored = [k for k, reader in readers.items() if reader is read_list_detail] if "outline" in details.columns else []
    others = joined.where(~F.col("adapter").isin(stored)) if stored else joined
    parsed = others.select(*kept, "html", "adapter", "selectors").mapInPandas(run, schema)
    if stored:
        native = cut(joined.where(F.col("adapter").isin(stored)).select(*kept, *_stored_fields()))  # fields are used many times
        parsed = native if len(stored) == len(readers) else native.unionByName(parsed)
    published = wall_time("publish_raw", zone)
    if "publish_time" in kept:
        published = F.coalesce(published, F.col("publish_time"))
    now = F.current_timestamp().cast("timestamp_ntz") if crawl_time is None else crawl_time
    titled = parsed.withColumns({"publish_time": published, "crawl_time": now, "url": F.col("link")})
    titled = titled.withColumn("news_id", F.when(
        F.col("title") != "", X.news_id("source", "url", "publish_time", "title")))
    extra = [c for c in kept if c not in ("source", "link", "publish_time")]
    out = titled.select("news_id", "source", "url", "title", "publish_time", "content", "crawl_time", "channel",
                        "parse_error", *[c for c in extra if c not in ("start_idx", "pos")])
    return normalize_articles(out, zone)
