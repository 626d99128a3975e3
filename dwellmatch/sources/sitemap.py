"""Sitemaps and link discovery → detail page candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellmatch.functions.text import let
from dwellmatch.functions.urls import canonical_url, external_id, is_rent_search_url, resolve_url, same_origin, url_path
from dwellmatch.operators.skew import latest_per_key


def sitemap_entries(maps: DataFrame, max_urls: int | None = None) -> DataFrame:
    """(map_url, pos, loc, lastmod) of the url or sitemap entries; order of the file.

    ``maps``: map_url, xml. The budget applies per map.
    """
    entry = F.regexp_extract_all("xml", F.lit(r"<(?:url|sitemap)>((?:[^<]++|<(?!/(?:url|sitemap)>))*+)</(?:url|sitemap)>"), 1)
    tag = lambda n: F.trim(F.nullif(F.regexp_extract("e", rf"<{n}>\s*([^<]*?)\s*</{n}>", 1), F.lit("")))
    entries = F.slice(entry, 1, max_urls) if max_urls else entry
    rows = maps.select("map_url", F.posexplode(entries).alias("pos", "e"))
    loc = F.replace(tag("loc"), F.lit("&amp;"), F.lit("&"))
    return rows.select("map_url", "pos", loc.alias("loc"), tag("lastmod").try_cast("timestamp").alias("lastmod")).filter(
        "loc is not null"
    )


def read_sitemap_files(spark, path: str) -> DataFrame:
    """Large sitemap files through the XML source, one row per url element."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod timestamp").load(path)


def expand_index(index_url: str, entries: DataFrame, patterns: list[str], base: str) -> DataFrame:
    """Entries of the maps named by an index: maps of the first pattern before the second.

    ``entries``: sitemap_entries of the index and of all fetched maps. With no listed
    map of any pattern, the index's own entries count.
    """
    index = entries.filter(F.col("map_url") == index_url)
    path = F.coalesce(url_path(F.col("loc")), F.lit(""))
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(patterns))):
        rank = F.when(path.contains(p), i).otherwise(rank)
    listed = (
        index.filter(same_origin(F.col("loc"), base))
        .select(F.col("loc").alias("map_url"), rank.alias("priority"), F.col("pos").alias("map_pos"))
        .filter("priority is not null")
        .dropDuplicates(["map_url"])
    )
    found = entries.join(listed, "map_url")
    # One row that tells whether the index named any map.
    named = listed.agg(F.count("*").alias("_named")).withColumn("_one", F.lit(1))
    own = (
        index.withColumn("priority", F.lit(0))
        .withColumn("map_pos", F.lit(0))
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(named), "_one")
        .filter("_named = 0")
    )
    return found.unionByName(own.drop("_one", "_named"))


def not_older(lastmod: Column, since: Column | None) -> Column:
    """Entries without a date are kept."""
    return F.lit(True) if since is None else lastmod.isNull() | (lastmod >= since)


def detail_url(link: Column, base: str, shape: str = "expose") -> Column:
    """Canonical detail URL of a same-origin link with an id in it, else null."""
    url = canonical_url(resolve_url(link, base), strip_query=True)
    return let(url, lambda u: F.when(same_origin(u, base) & external_id(u, shape).isNotNull(), u))


def page_links(parsed: DataFrame, base: str, shape: str = "expose") -> DataFrame:
    """Distinct detail links per page in page order: (page_id, url, pos)."""
    # Worked out before the links become rows: a filter on what a row's projection makes would make it again.
    details = F.transform("links", lambda link: detail_url(link, base, shape))
    found = parsed.select("page_id", F.posexplode(details).alias("pos", "url")).filter("url is not null")
    return found.groupBy("page_id", "url").agg(F.min("pos").alias("pos"))


def candidates(entries: DataFrame, links: DataFrame, base: str, since: Column | None = None, limit: int | None = None, max_search_pages: int | None = None) -> DataFrame:
    """Detail pages to read: first discovery per URL wins, in discovery order, up to a limit.

    ``entries``: expand_index output. ``links``: page_url, url, pos of search pages. An
    entry is a detail page itself, or a search page for rent whose links count.
    """
    live = entries.filter(not_older(F.col("lastmod"), since))
    # Lists of none or one: a filter would be moved below, to both sides of the join, and work it out at each place.
    one = lambda c: F.explode(F.array_compact(F.array(c)))
    detail = detail_url(F.col("loc"), base)
    direct = live.select(
        one(detail).alias("url"), "priority", "map_pos", "pos", F.lit(0).alias("sub"), F.col("loc").alias("found_at"), "lastmod"
    )
    searched = is_rent_search_url(canonical_url(resolve_url(F.col("loc"), base)))
    pages = live.select("priority", "map_pos", "pos", "lastmod", one(F.when(searched & detail.isNull(), F.col("loc"))).alias("loc"))
    if max_search_pages is not None:
        pages = pages.orderBy("priority", "map_pos", "pos").limit(max_search_pages)
    via = pages.join(
        links.select(F.col("page_url").alias("loc"), F.col("url").alias("link_url"), F.col("pos").alias("sub")), "loc"
    ).select(F.col("link_url").alias("url"), "priority", "map_pos", "pos", "sub", F.col("loc").alias("found_at"), "lastmod")
    found = direct.unionByName(via)
    order = F.struct(*[-F.col(c) for c in ("priority", "map_pos", "pos", "sub")])
    first = latest_per_key(found.withColumn("_o", order), ["url"], ["_o"]).drop("_o")
    return first if limit is None else first.orderBy("priority", "map_pos", "pos", "sub").limit(limit)
