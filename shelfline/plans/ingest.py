"""Queries of the ingest of listings and of merges, with SQL that takes one listing or merge after another."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.operators import ingest as I
from shelfline.operators import merges as M
from shelfline.plans import sql as S
from shelfline.plans.register import query, with_ctes
from shelfline.sources import adapters as A

S.ADAPTERS["listed_products"] = """SELECT 'p' || p_partkey AS uuid, p_name AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 2 = 0 THEN 'E' || p_partkey END AS ean,
  CASE WHEN p_partkey % 5 = 0 THEN 'M' || (p_partkey // 2) END AS mpn, CAST(NULL AS VARCHAR) AS manufacturer_sku, p_partkey AS created_seq FROM part WHERE p_partkey % 3 = 0"""
S.ADAPTERS["arrivals"] = """SELECT 'a/' || p_partkey || '/' || shop AS draft_id, seq, 'Neuf ' || CASE WHEN shop % 2 = 0 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ') ELSE p_name END AS name,
  CASE WHEN shop % 3 <> 2 THEN p_brand END AS brand, CASE WHEN shop IN (0, 3, 6, 7) THEN 'E' || p_partkey END AS ean, CASE WHEN shop IN (1, 3) THEN 'M' || (p_partkey // 2) END AS mpn,
  CASE WHEN shop IN (2, 6, 7) THEN 'S' || p_partkey END AS manufacturer_sku, p_partkey
  FROM (SELECT l_partkey, l_suppkey % 8 AS shop, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = l_partkey"""
S.ADAPTERS["merges"] = "SELECT id, product_uuid AS source, candidate_uuid AS target FROM suggestions WHERE status = 'accepted' AND product_uuid <> candidate_uuid"
S.NEEDS["merges"] = ["suggestions"]

#: Listings meet only within p_partkey // 2, since no other parts share an identifier; each such group is taken in order.
_WALK = """queue AS (SELECT *, p_partkey // 2 AS grp, row_number() OVER (PARTITION BY p_partkey // 2 ORDER BY seq) AS turn FROM arrivals),
walk_rec(grp, turn, known, draft_id, seq, product, score, method) AS (
  SELECT q.grp, CAST(0 AS BIGINT), coalesce(c.known, []), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR) FROM (SELECT DISTINCT grp FROM queue) q
  LEFT JOIN (SELECT created_seq // 2 AS grp, list({'product': uuid, 'ean': ean, 'mpn': mpn, 'sku': manufacturer_sku} ORDER BY created_seq) AS known FROM listed_products GROUP BY 1) c ON c.grp = q.grp
  UNION ALL
  SELECT grp, turn, CASE WHEN hit IS NULL THEN list_append(known, {'product': 'n:' || draft_id, 'ean': ean, 'mpn': mpn, 'sku': sku})
      ELSE list_transform(known, lambda x: CASE WHEN x.product = hit.product THEN {'product': x.product, 'ean': coalesce(x.ean, ean), 'mpn': coalesce(x.mpn, mpn), 'sku': coalesce(x.sku, sku)} ELSE x END) END,
    draft_id, seq, coalesce(hit.product, 'n:' || draft_id), hit.score, hit.method
  FROM (SELECT *, CASE WHEN len(e) > 0 THEN {'product': e[1].product, 'score': 100, 'method': 'ean'} WHEN len(m) > 0 THEN {'product': m[1].product, 'score': 95, 'method': 'mpn'}
        WHEN len(s) > 0 THEN {'product': s[1].product, 'score': 92, 'method': 'manufacturer_sku'} END AS hit
    FROM (SELECT w.grp, q.turn, w.known, q.draft_id, q.seq, q.ean, q.mpn, q.manufacturer_sku AS sku, list_filter(w.known, lambda x: coalesce(x.ean = q.ean, false)) AS e,
        list_filter(w.known, lambda x: coalesce(x.mpn = q.mpn, false)) AS m, list_filter(w.known, lambda x: coalesce(x.sku = q.manufacturer_sku, false)) AS s
      FROM walk_rec w JOIN queue q ON q.grp = w.grp AND q.turn = w.turn + 1))),
placed AS (SELECT draft_id, seq, product, score, method, score IS NULL AS created FROM walk_rec WHERE draft_id IS NOT NULL)"""
_NAMED = f"""made AS (SELECT uuid AS product, name, {S.name_key('name')} AS k, CAST(-1 AS BIGINT) AS since, 0 AS kind, created_seq AS at_seq FROM listed_products
  UNION ALL SELECT p.product, a.name, {S.name_key('a.name')}, a.seq, 1, a.seq FROM placed p JOIN arrivals a USING (draft_id) WHERE p.created),
brands AS (SELECT product, arg_min(brand, since) AS brand, min(since) AS since FROM (SELECT uuid AS product, lower(trim(brand)) AS brand, -1 AS since FROM listed_products WHERE brand <> ''
  UNION ALL SELECT p.product, lower(trim(a.brand)), a.seq FROM placed p JOIN arrivals a USING (draft_id) WHERE a.brand <> '') GROUP BY product),
asked AS (SELECT p.draft_id, p.seq, {S.name_key('a.name')} AS k, lower(trim(a.brand)) AS brand FROM placed p JOIN arrivals a USING (draft_id) WHERE p.created),
hits AS (SELECT a.draft_id, 85 AS score, 'name_brand' AS method, m.product, m.kind, m.at_seq FROM asked a JOIN made m ON m.k = a.k JOIN brands b ON b.product = m.product AND b.brand = a.brand AND b.since < a.seq
  UNION ALL SELECT a.draft_id, 70, 'name_only', m.product, m.kind, m.at_seq FROM asked a JOIN made m ON m.k = a.k AND m.since < a.seq),
proposed AS (SELECT draft_id, score, method, product FROM hits QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY score DESC, kind, at_seq, product) = 1),
outcomes AS (SELECT p.draft_id, p.seq, p.product, p.created, coalesce(p.score, o.score) AS score, coalesce(p.method, o.method) AS method, CASE WHEN p.created THEN o.product ELSE p.product END AS candidate,
  CASE WHEN NOT p.created THEN 'merge' WHEN o.score IS NOT NULL THEN 'suggest' ELSE 'new' END AS decision,
  CASE WHEN NOT p.created THEN 'rattaché à « ' || m.name || ' » (' || p.method || ', confiance ' || p.score || ')' WHEN o.score IS NOT NULL THEN 'nouveau produit — fusion possible proposée (confiance ' || o.score || ')' ELSE 'nouveau produit' END AS summary
  FROM placed p LEFT JOIN proposed o ON o.draft_id = p.draft_id LEFT JOIN made m ON m.product = p.product)"""
_INPUTS = "listed_products arrivals"


@query(*with_ctes(_INPUTS, f"{_WALK},\n{_NAMED}", "SELECT * FROM outcomes"))
def ingest_outcomes(spark, d):
    return I.ingested(A.arrivals(spark, d), A.listed_products(spark, d))


@query(*with_ctes(_INPUTS, f"{_WALK},\n{_NAMED}", "SELECT draft_id, 'catalog_product_created' AS kind, product, NULL AS detail FROM outcomes WHERE created UNION ALL SELECT draft_id, 'catalog_match_pending', product, candidate FROM outcomes WHERE decision = 'suggest' UNION ALL SELECT draft_id, 'catalog_offer_linked', product, summary FROM outcomes"))
def ingest_events(spark, d):
    return I.events_of(I.ingested(A.arrivals(spark, d), A.listed_products(spark, d)))


@query(*with_ctes(_INPUTS, _WALK, """SELECT x.product, count(p.draft_id) AS listings, x.ean, x.mpn, x.sku AS manufacturer_sku FROM (SELECT grp, unnest(known) AS x FROM walk_rec QUALIFY turn = max(turn) OVER (PARTITION BY grp))
  LEFT JOIN placed p ON p.product = x.product GROUP BY ALL UNION ALL SELECT uuid, 0, ean, mpn, manufacturer_sku FROM listed_products WHERE created_seq // 2 NOT IN (SELECT grp FROM queue)"""))
def ingested_products(spark, d):
    drafts, catalog = A.arrivals(spark, d), A.listed_products(spark, d)
    return I.products_after(drafts, catalog, I.placements(drafts, catalog), ["ean", "mpn", "manufacturer_sku"])


#: What a merge moved, from merge to merge.
_FOLLOW = """follow_rec(start, source, id, target, hops) AS (
  SELECT id, source, id, target, 1 FROM merges
  UNION ALL SELECT f.start, f.source, n.id, n.target, f.hops + 1 FROM follow_rec f JOIN later l ON l.id = f.id JOIN merges n ON n.id = l.next),
ends AS (SELECT start AS id, source, CAST(hops AS BIGINT) AS hops, target AS final FROM follow_rec QUALIFY row_number() OVER (PARTITION BY start ORDER BY hops DESC) = 1)"""
_LATER = "later AS (SELECT m.id, min(n.id) AS next FROM merges m JOIN merges n ON n.source = m.target AND n.id > m.id GROUP BY m.id)"


@query(*with_ctes("merges", f"{_LATER},\n{_FOLLOW}", "SELECT e.id, m.source, m.target, e.final, e.hops FROM ends e JOIN merges m ON m.id = e.id"))
def merge_chains(spark, d):
    return M.chains(A.merges(spark, d))


@query(*with_ctes("merges offer_events", f"{_LATER},\n{_FOLLOW}", "SELECT o.canonical_url, o.seq, coalesce(h.final, o.product_uuid) AS product_uuid, CASE WHEN o.monitored_uuid IS NOT NULL THEN coalesce(h.final, o.product_uuid) END AS group_uuid FROM offer_events o LEFT JOIN (SELECT source, arg_min(final, id) AS final FROM ends GROUP BY source) h ON h.source = o.product_uuid"))
def offers_after_merges(spark, d):
    return M.rehomed(A.offer_events(spark, d), A.merges(spark, d)).select("canonical_url", "seq", "product_uuid", "group_uuid")


@query()
def fields_after_merges(spark, d):
    return M.learnt(A.catalog_products(spark, d), A.merges(spark, d), ["ean", "mpn", "brand", "asin"])
