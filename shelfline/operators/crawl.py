"""Walks over documents and answers that were stored: site maps breadth first, searches until one is sure enough.

Every site walks at once.  A step joins the head of each site's queue to its document and puts what that names behind
the queue, so steps are as many as the documents a site may read, whatever the number of sites.  A site's state is a
row: its queue and what it has seen, both bounded by that limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.sources.files import stored

#: Site maps that are read and addresses that are kept of each site, and how much of a map tells its kind.
MOST_MAPS, MOST_URLS, HEAD = 12, 3000, 2000
#: Keys that are asked of each merchant, merchants of each product, and the confidence that ends a search.
MOST_KEYS, MOST_SITES, SURE = 6, 8, 90


def _map_parts(documents: DataFrame) -> DataFrame:
    """(url, locations, is_index) of every document; null bodies name nothing."""
    body = F.coalesce("body", F.lit(""))
    locations = F.regexp_extract_all(body, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return documents.select("url", locations.alias("locations"), F.contains(F.lower(F.substring(body, 1, HEAD)), F.lit("<sitemapindex")).alias("is_index"))


def sitemap_roots(sites: DataFrame, documents: DataFrame) -> DataFrame:
    """(site, roots): the site maps that each site's robots.txt declares, else its /sitemap.xml."""
    robots = documents.select(F.col("url").alias("robots"), F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?im)^[ \t]*sitemap:\s*(\S+)"), F.lit(1)).alias("told"))
    home = F.regexp_extract("base_url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    asked = sites.select("site", home.alias("home")).withColumn("robots", F.concat("home", F.lit("/robots.txt"))).join(robots, "robots", "left")
    return asked.select("site", F.when(F.size("told") > 0, F.col("told")).otherwise(F.array(F.concat("home", F.lit("/sitemap.xml")))).alias("roots"))


def _wanted(url: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(not patterns)
    for p in patterns:
        found = found | F.contains(F.lower(url), F.lit(p.lower()))
    return found


def sitemap_urls(sites: DataFrame, documents: DataFrame, patterns: tuple[str, ...] = (), most_maps: int = MOST_MAPS, most_urls: int = MOST_URLS) -> DataFrame:
    """(site, step, place, url) of the addresses that each site's maps declare, breadth first, circles read once.

    `sites` have site and base_url, `documents` url and body: each url once.  A map that isn't there, or is null,
    counts as read.  As many maps as `most_maps` are read of a site, and as many addresses kept as `most_urls`.
    """
    maps = stored(_map_parts(documents), "maps")
    state = sitemap_roots(sites, documents).select(
        "site", F.col("roots").alias("queue"), F.array().cast("array<string>").alias("seen"), F.lit(0).alias("read"), F.lit(0).alias("kept"), F.array().cast("array<string>").alias("found"), F.lit(0).alias("step")
    )
    steps = []
    while True:
        # Heads that were read before are dropped when their turn comes, and not earlier: until then they fill the queue.
        turn = F.array_min(F.filter(F.transform("queue", lambda u, i: F.when(~F.array_contains("seen", u), i)), lambda i: i.isNotNull()))
        going = state.withColumn("turn", turn).filter((F.col("read") < most_maps) & (F.col("kept") < most_urls) & F.col("turn").isNotNull())
        ahead = going.select("site", "seen", "read", "kept", "step", F.get("queue", F.col("turn")).alias("url"), F.slice("queue", F.col("turn") + 2, F.greatest(F.lit(0), F.size("queue") - F.col("turn") - 1)).alias("queue"))
        parts = ahead.join(maps, "url", "left").withColumn("locations", F.coalesce("locations", F.array().cast("array<string>")))
        nested = lambda u: F.coalesce(F.col("is_index"), F.lit(False)) | F.lower(u).endswith(".xml") | F.lower(u).endswith(".xml.gz")
        room = F.greatest(F.lit(0), F.lit(most_maps) - F.size("queue") - F.col("read") - 1)
        more = F.slice(F.filter("locations", nested), F.lit(1), room)
        pages = F.slice(F.filter("locations", lambda u: ~nested(u) & _wanted(u, patterns)), F.lit(1), F.lit(most_urls) - F.col("kept"))
        state = stored(
            parts.withColumn("found", pages).select(
                "site", F.concat("queue", more).alias("queue"), F.array_append("seen", F.col("url")).alias("seen"), (F.col("read") + 1).alias("read"),
                (F.col("kept") + F.size("found")).alias("kept"), "found", (F.col("step") + 1).alias("step"),
            ),
            "crawl",
        )
        if not state.limit(1).count():
            break
        steps.append(state.select("site", "step", F.posexplode("found").alias("place", "url")))
    found = steps[0] if steps else state.select("site", "step", F.posexplode("found").alias("place", "url"))
    for more in steps[1:]:
        found = found.unionByName(more)
    return found


def searches_made(answers: DataFrame, known: DataFrame, most_keys: int = MOST_KEYS, most_sites: int = MOST_SITES, sure: int = SURE) -> DataFrame:
    """The searches of `answers` that are made: key by key at each merchant until it is sure, or fails.

    `answers` have product_uuid, site, seq (the order of keys), status and confidence: what each search would find.
    An error ends a merchant's turn, as does an answer of `sure` or more; an unsupported key or one without results
    doesn't.  Merchants where the product is `known` (product_uuid, site) already are not asked, in any case.
    """
    had = known.select("product_uuid", F.lower("site").alias("__site")).distinct()
    open_ = answers.join(had, (answers["product_uuid"] == had["product_uuid"]) & (F.lower(answers["site"]) == had["__site"]), "left_anti")
    sites = open_.select("product_uuid", "site").distinct()
    few = sites.withColumn("__n", F.row_number().over(Window.partitionBy("product_uuid").orderBy("site"))).filter(F.col("__n") <= most_sites).drop("__n")
    turn = Window.partitionBy("product_uuid", "site").orderBy("seq")
    ends = (F.col("status") == "error") | ((F.col("status") == "found") & (F.col("confidence") >= sure))
    asked = open_.join(few, ["product_uuid", "site"]).withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= most_keys)
    over = F.max(F.coalesce(ends, F.lit(False))).over(turn.rowsBetween(Window.unboundedPreceding, -1))
    return asked.withColumn("__over", over).filter("__over IS NULL OR NOT __over").drop("__over")


def search_reports(made: DataFrame) -> DataFrame:
    """A report for each product: merchants asked, keys tried, candidates, best confidence, errors, searches to repeat."""
    site = made.groupBy("product_uuid", "site").agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(F.col("status") == "found").alias("found"), F.max(F.when(F.col("status") == "found", F.col("confidence"))).alias("best"),
        F.max(F.col("status") == "error").alias("failed"), F.max(F.col("status") == "unsupported").alias("unsupported"),
    )
    return site.groupBy("product_uuid").agg(
        F.count(F.lit(1)).alias("sites_queried"), F.sum("keys").alias("keys_tried"), F.sum("found").alias("candidates_found"), F.max("best").alias("best_confidence"),
        F.count_if("failed").alias("errors"), F.count_if((F.col("found") == 0) & ~F.col("unsupported")).alias("retries_scheduled"),
    )
