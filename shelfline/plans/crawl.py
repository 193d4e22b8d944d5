"""Queries of walks over site maps and of searches, with SQL that takes one document after another."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.operators import crawl as K
from shelfline.plans import sql as S
from shelfline.plans.register import query, with_ctes
from shelfline.sources import adapters as A

S.ADAPTERS["sites"] = "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS site, min(url) AS base_url FROM pages GROUP BY 1"
_OWN = "(SELECT site, regexp_extract(base_url, '^([a-z]+://[^/]+)', 1) AS home, length(site) % 4 AS kind FROM sites)"
S.ADAPTERS["site_documents"] = f"""SELECT o.home || '/map-' || p.part || '.xml' AS url, '<urlset>' || CASE WHEN p.part = 1 THEN '<url><loc>' || o.home || '/Extra.XML</loc></url>' ELSE '' END || p.locs || '</urlset>' AS body
  FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS site, page_id % 5 AS part, string_agg('<url><loc>' || replace(url, '&', '%26') || '</loc></url>', chr(10) ORDER BY page_id) AS locs FROM pages GROUP BY 1, 2) p JOIN {_OWN} o ON o.site = p.site
  UNION ALL SELECT home || '/sitemap.xml', '<?xml?><SitemapIndex><url><loc>' || home || '/sitemap.xml</loc></url>' || array_to_string(list_transform([3, 0, 9, 1, 4, 2], lambda i: '<url><loc>' || home || '/map-' || i || '.xml</loc></url>'), '') || '</SitemapIndex>' FROM {_OWN}
  UNION ALL SELECT home || '/Extra.XML', '<urlset><url><loc>' || home || '/special</loc></url><url><loc>' || home || '/sitemap.xml</loc></url></urlset>' FROM {_OWN}
  UNION ALL SELECT home || '/robots.txt', CASE WHEN kind = 1 THEN 'User-agent: *' || chr(10) || '  SITEMAP: ' || home || '/map-2.xml' || chr(10) || 'Sitemap: ' || home || '/sitemap.xml' || chr(10) || 'sitemap:' || home || '/map-2.xml' ELSE 'User-agent: *' END FROM {_OWN} WHERE kind <> 0"""
S.NEEDS["site_documents"] = ["sites"]
S.ADAPTERS["answers"] = "SELECT product_uuid, site, key_kind, seq, CASE WHEN seq % 11 = 0 THEN 'unsupported' ELSE status END AS status, confidence, found_url FROM tries"
S.NEEDS["answers"] = ["tries"]

#: Limits that the pages of the smallest site reach; the operator's own are those of a crawl.
MAPS, URLS, PATTERNS = 5, 12, ("/4", "page=", "/SPECIAL", "/fr/")
_MATCHES = " OR ".join(f"contains(lower(u), '{p.lower()}')" for p in PATTERNS)
_CRAWL = f"""maps AS (SELECT url, regexp_extract_all(body, '(?i)<loc>\\s*([^<\\s]+)\\s*</loc>', 1) AS locs, contains(lower(substr(body, 1, 2000)), '<sitemapindex') AS is_index FROM site_documents),
starts AS (SELECT s.site, CASE WHEN len(d.told) > 0 THEN d.told ELSE [s.home || '/sitemap.xml'] END AS queue FROM {_OWN} s LEFT JOIN (SELECT url, regexp_extract_all(body, '(?im)^[ \\t]*sitemap:\\s*(\\S+)', 1) AS told FROM site_documents) d ON d.url = s.home || '/robots.txt'),
crawl_rec(site, queue, seen, read, kept, found, step) AS (
  SELECT site, queue, CAST([] AS VARCHAR[]), 0, 0, CAST([] AS VARCHAR[]), 0 FROM starts
  UNION ALL
  SELECT site, list_concat(rest, more), list_append(seen, head), read + 1, kept + len(pages), pages, step + 1
  FROM (SELECT *, list_filter(locs, lambda u: nested OR ends_with(lower(u), '.xml') OR ends_with(lower(u), '.xml.gz'))[1:greatest(0, {MAPS} - len(rest) - read - 1)] AS more,
      list_filter(locs, lambda u: NOT (nested OR ends_with(lower(u), '.xml') OR ends_with(lower(u), '.xml.gz')) AND ({_MATCHES}))[1:{URLS} - kept] AS pages
    FROM (SELECT c.*, c.queue[c.turn] AS head, c.queue[c.turn + 1:] AS rest, coalesce(m.locs, []) AS locs, coalesce(m.is_index, false) AS nested
      FROM (SELECT *, list_min(list_filter(range(1, len(queue) + 1), lambda i: NOT list_contains(seen, queue[i]))) AS turn FROM crawl_rec WHERE read < {MAPS} AND kept < {URLS}) c LEFT JOIN maps m ON m.url = c.queue[c.turn] WHERE c.turn IS NOT NULL)))"""


@query(*with_ctes("sites site_documents", _CRAWL, "SELECT site, step, CAST(place - 1 AS INTEGER) AS place, url FROM (SELECT site, step, unnest(found) AS url, unnest(range(1, len(found) + 1)) AS place FROM crawl_rec)"))
def sitemap_walk(spark, d):
    return K.sitemap_urls(A.sites(spark, d), A.site_documents(spark, d), PATTERNS, MAPS, URLS)


@query(*with_ctes("sites site_documents", _CRAWL.replace(f"1:{URLS} - kept", f"1:{K.MOST_URLS} - kept").replace(f"kept < {URLS}", f"kept < {K.MOST_URLS}").replace(f"{MAPS} - len", f"{K.MOST_MAPS} - len").replace(f"read < {MAPS}", f"read < {K.MOST_MAPS}").replace(f"AND ({_MATCHES})", ""), "SELECT site, count(*) AS urls, count(DISTINCT url) AS distinct_urls, max(step) AS last_step FROM (SELECT site, step, unnest(found) AS url FROM crawl_rec) GROUP BY site"))
def sitemap_sizes(spark, d):
    found = K.sitemap_urls(A.sites(spark, d), A.site_documents(spark, d))
    return found.groupBy("site").agg(F.count(F.lit(1)).alias("urls"), F.countDistinct("url").alias("distinct_urls"), F.max("step").alias("last_step"))


def _known(spark, d):
    """Where a product has a monitored offer already."""
    return A.offer_events(spark, d).filter("monitored_uuid IS NOT NULL").select("product_uuid", F.upper("site").alias("site"))


_MADE = """had AS (SELECT DISTINCT product_uuid, site FROM offer_events WHERE monitored_uuid IS NOT NULL),
asked AS (SELECT a.*, dense_rank() OVER (PARTITION BY product_uuid ORDER BY site) AS nth, row_number() OVER (PARTITION BY product_uuid, site ORDER BY seq) AS turn FROM answers a WHERE NOT EXISTS (SELECT 1 FROM had h WHERE h.product_uuid = a.product_uuid AND h.site = a.site)),
made AS (SELECT * FROM asked a WHERE nth <= 8 AND turn <= 6 AND NOT EXISTS (SELECT 1 FROM asked b WHERE b.product_uuid = a.product_uuid AND b.site = a.site AND b.turn < a.turn AND (b.status = 'error' OR (b.status = 'found' AND b.confidence >= 90))))"""


@query(*with_ctes("answers offer_events", _MADE, "SELECT product_uuid, site, CAST(turn AS INTEGER) AS turn, key_kind, status, confidence FROM made"))
def searches_made(spark, d):
    return K.searches_made(A.answers(spark, d), _known(spark, d)).select("product_uuid", "site", "turn", "key_kind", "status", "confidence")


@query(*with_ctes("answers offer_events", _MADE, """SELECT product_uuid, count(*) AS sites_queried, sum(keys) AS keys_tried, sum(found) AS candidates_found, max(best) AS best_confidence, count(*) FILTER (failed) AS errors,
  count(*) FILTER (found = 0 AND NOT unsupported) AS retries_scheduled FROM (SELECT product_uuid, site, count(*) AS keys, count(*) FILTER (status = 'found') AS found, max(confidence) FILTER (status = 'found') AS best,
    bool_or(status = 'error') AS failed, bool_or(status = 'unsupported') AS unsupported FROM made GROUP BY ALL) GROUP BY 1"""))
def search_reports(spark, d):
    return K.search_reports(K.searches_made(A.answers(spark, d), _known(spark, d)))
