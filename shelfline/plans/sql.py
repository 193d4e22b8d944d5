"""The adapters and the expected results of the queries as DuckDB SQL."""

from __future__ import annotations

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
ADAPTERS = {
    "products": "SELECT DISTINCT 'u' || user_id AS uuid, 'site_' || (user_id % 4) AS site, (user_id % 5) <> 0 AS enabled FROM events",
    "checks": f"""SELECT event_id AS id, 'u' || user_id AS product_uuid, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
  CASE event_type WHEN 'view' THEN 'unknown' WHEN 'click' THEN 'unavailable' WHEN 'signup' THEN 'preorder' WHEN 'purchase' THEN 'in_stock' END AS availability,
  CAST(floor(value * 20) AS INTEGER) AS response_time_ms, CASE WHEN {_K} % 3 = 0 THEN 'browser' ELSE 'http' END AS fetch_source,
  CASE WHEN {_K} < 6 THEN 403 WHEN {_K} < 9 THEN 429 WHEN {_K} < 14 THEN 404 WHEN {_K} < 18 THEN 503 ELSE 200 END AS http_status,
  CASE WHEN event_type <> 'error' THEN {_K} END AS confidence, ts AS checked_at FROM events""",
    "engine_events": f"""SELECT event_id AS id, 'site_' || (user_id % 4) AS source,
  CASE {_K} % 6 WHEN 0 THEN 'http_error' WHEN 1 THEN 'network_error' WHEN 2 THEN 'blocked' WHEN 3 THEN 'unknown_state' WHEN 4 THEN 'browser_fallback' ELSE 'page_missing' END AS kind,
  CASE WHEN {_K} % 6 < 3 THEN 'error' ELSE 'warning' END AS severity, 'u' || user_id AS product_uuid, 'k=' || {_K} AS detail,
  CASE WHEN event_type = 'signup' THEN CAST(floor(value * 10) AS INTEGER) END AS duration_ms, ts AS created_at
  FROM events WHERE event_type = 'error' OR {_K} >= 90""",
    "readings": """SELECT 'u' || user_id AS product_uuid, event_id AS id, ts AS checked_at,
  CASE event_type WHEN 'view' THEN 'unknown' WHEN 'click' THEN 'unavailable' WHEN 'signup' THEN 'preorder' WHEN 'purchase' THEN 'in_stock' ELSE 'not_listed' END AS availability,
  CASE WHEN event_id % 5 <> 0 THEN (CAST(round(value * 100) AS BIGINT) // 100) || ',' || lpad(CAST(CAST(round(value * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') || ' €' END AS price,
  event_type <> 'error' AS page_exists,
  CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'request_invite' ELSE 'preorder' END WHEN event_type = 'purchase' THEN 'add_to_cart' ELSE 'none' END AS action,
  CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN event_id % 3 = 0 THEN 'third_party' ELSE 'official' END AS seller_type,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'seller ' || (event_id % 10) ELSE 'shop' END AS seller_name FROM events""",
    "offer_events": """SELECT 'p' || l_partkey AS product_uuid, 'shop' || (l_suppkey % 8) AS site, l_partkey || '/' || (l_suppkey % 8) AS canonical_url,
  CASE WHEN l_linenumber % 4 <> 0 THEN (CAST(round(l_extendedprice * 100) AS BIGINT) // 100) || ',' || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') || ' €' END AS price,
  CASE WHEN l_linenumber % 5 <> 0 THEN CASE WHEN l_linestatus = 'O' THEN 'in_stock' WHEN l_returnflag = 'R' THEN 'unavailable' ELSE 'preorder' END END AS availability,
  CASE WHEN l_quantity > 40 THEN 'm' || l_orderkey END AS monitored_uuid, l_quantity <> 13 AS page_exists, CAST(l_shipdate AS TIMESTAMP) AS seen_at, l_orderkey * 10 + l_linenumber AS seq FROM lineitem""",
    "alerts": """SELECT o_orderkey AS id, 'u' || (o_custkey * 2) AS product_uuid, o_orderpriority AS change_type, o_orderstatus = 'F' AS notified,
  CASE WHEN o_orderkey % 3 = 0 THEN '/shots/' || o_orderkey END AS screenshot_path, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders""",
    "gtin12": "SELECT p_partkey, lpad(CAST(p_partkey * 7919 + 300000000000 AS VARCHAR), 12, '0') AS b FROM part",
    "catalog": """SELECT 'p' || part.p_partkey AS uuid, p_name AS name, CASE WHEN part.p_partkey % 6 <> 0 THEN p_brand END AS brand,
  CASE WHEN part.p_partkey % 3 <> 0 THEN b || (10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(b, i, 1) AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 END AS ean,
  CASE WHEN part.p_partkey % 4 = 0 THEN 'MPN-' || part.p_partkey END AS mpn, CASE WHEN part.p_partkey % 5 = 0 THEN 'SKU-' || part.p_partkey END AS manufacturer_sku,
  CASE WHEN part.p_partkey % 7 = 0 THEN 'B0' || lpad(CAST(part.p_partkey AS VARCHAR), 8, '0') END AS asin,
  CASE WHEN part.p_partkey % 8 = 0 THEN 'M' || part.p_partkey END AS model_number, CASE WHEN part.p_partkey % 9 = 0 THEN lpad(CAST(part.p_partkey AS VARCHAR), 12, '0') END AS upc,
  CASE WHEN part.p_partkey % 11 = 0 THEN '978' || lpad(CAST(part.p_partkey AS VARCHAR), 10, '0') END AS isbn, CASE WHEN part.p_partkey % 13 = 0 THEN 'REF-' || part.p_partkey END AS manufacturer_ref, p_type AS collection,
  '2024-0' || (part.p_partkey % 9 + 1) || '-15' AS release_date, part.p_partkey AS created_seq FROM part JOIN gtin12 g ON g.p_partkey = part.p_partkey""",
    "drafts": """SELECT 'd/' || l_partkey || '/' || shop AS draft_id,
  'The ' || CASE WHEN shop % 2 = 0 THEN array_to_string(list_reverse(string_split(name, ' ')), ' ') ELSE upper(name) END AS name,
  CASE WHEN shop % 3 <> 2 THEN brand END AS brand, CASE WHEN shop % 4 = 0 THEN ean END AS ean, CASE WHEN shop % 4 = 1 THEN mpn END AS mpn,
  CASE WHEN shop % 4 = 2 THEN manufacturer_sku END AS manufacturer_sku, CASE WHEN shop = 5 THEN asin END AS asin, CASE WHEN shop = 6 THEN model_number END AS model_number,
  CASE WHEN shop = 3 THEN upc END AS upc, CASE WHEN shop = 7 THEN isbn END AS isbn, CASE WHEN shop IN (3, 7) THEN manufacturer_ref END AS manufacturer_ref,
  CASE WHEN shop = 2 THEN release_date END AS release_date, CASE WHEN shop = 5 THEN ' ' || upper(collection) END AS collection
  FROM (SELECT DISTINCT l_partkey, l_suppkey % 8 AS shop FROM lineitem) JOIN catalog ON l_partkey = created_seq""",
    "discoveries": """SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS site, 1 AS seq FROM pages
  UNION ALL SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=x', '', regexp_extract(url, '^[a-z]+://([^/]+)', 1), 2 FROM pages WHERE page_id % 3 = 0""",
    "search_attempts": """SELECT 'p' || c_custkey AS product_uuid, CASE c_custkey % 4 WHEN 0 THEN 'not_found' WHEN 1 THEN 'error' WHEN 2 THEN 'found' ELSE 'pending' END AS status,
  CAST(c_custkey % 8 AS INTEGER) AS attempts, 'shop' || s AS site FROM customer, range(0, 3) t(s)""",
    "first_pages": "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS site, md5(url) AS fingerprint, min(page_id) AS page_id FROM pages GROUP BY 1, 2",
    "known_discoveries": "SELECT fingerprint, site, CASE page_id % 10 WHEN 0 THEN 'imported' WHEN 1 THEN 'ignored' WHEN 2 THEN 'blocked' ELSE 'pending' END AS status FROM first_pages",
    "scanned_pages": "SELECT site, fingerprint FROM first_pages WHERE page_id % 4 <> 1 AND length(site) % 3 <> 0",
    "codes": """SELECT p_partkey AS key, t.kind - 1 AS kind, t.code FROM (SELECT p_partkey, b, b || ((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(b, i, 1) AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10) AS f FROM gtin12),
  LATERAL (SELECT unnest([f, b || ((CAST(substr(f, 13, 1) AS INTEGER) + 1) % 10), '0' || f, '1' || f, b, substr(f, 6, 8), '0000000000000', '11111116', substr(f, 1, 3) || '-' || substr(f, 4, 5) || ' ' || substr(f, 9, 5),
    lpad(CAST(p_partkey AS VARCHAR), 10, '0'), 'ISBN ' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || 'x', '', NULL]) AS code, unnest(range(1, 14)) AS kind) t""",
    "tries": """SELECT 'p' || l_partkey AS product_uuid, 'shop' || (l_suppkey % 8) AS site, CASE WHEN l_linenumber % 2 = 0 THEN 'ean' ELSE 'mpn' END AS key_kind, 'k' || l_partkey AS key_value,
  CASE WHEN l_quantity > 45 THEN 'found' WHEN l_quantity < 8 THEN 'error' ELSE 'not_found' END AS status, CAST(l_quantity * 2 AS INTEGER) AS confidence,
  CASE WHEN l_quantity > 45 THEN 'https://shop/' || l_orderkey WHEN l_linenumber = 1 THEN '' END AS found_url, CAST(l_shipdate AS TIMESTAMP) AS tried_at, l_orderkey * 10 + l_linenumber AS seq FROM lineitem""",
    "identities": """SELECT uuid, brand, ean, upc, isbn, asin, mpn, model_number, CASE WHEN created_seq % 10 = 0 THEN ean END AS gtin, manufacturer_sku AS sku, manufacturer_ref AS manufacturer_part_number, name AS canonical_name,
  CASE WHEN created_seq % 12 = 0 THEN ' Maker' END AS manufacturer, CASE created_seq % 3 WHEN 0 THEN [name, 'alias 1 ' || created_seq, 'alias 2 ' || created_seq, 'alias 3 ' || created_seq] WHEN 1 THEN ['alias 1 ' || created_seq] END AS aliases FROM catalog""",
    "watch_list": """SELECT 's' || s_suppkey AS uuid, s_name AS name, 'shop' || (s_suppkey % 8) AS site, 'https://shop/' || s_suppkey AS url,
  CASE s_suppkey % 3 WHEN 0 THEN '["Drop","a' || (s_suppkey % 5) || '"]' WHEN 1 THEN '[]' ELSE 'not json' END AS tags, s_suppkey % 4 <> 0 AS enabled,
  CASE s_suppkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'normal' WHEN 2 THEN 'high' ELSE 'critical' END AS priority, CAST(s_suppkey % 50 + 10 AS INTEGER) AS check_interval,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(s_suppkey AS INTEGER)) AS created_at FROM supplier""",
    "discovered": """SELECT 'f' || o_orderkey AS fingerprint, 'shop' || (o_custkey % 8) AS site, 'https://shop/x/Fiche-' || o_orderkey || '.html' AS url, 'Fiche ' || o_orderpriority || ' ' || o_orderkey AS title,
  CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 900) || ',50 €' END AS price, CASE o_orderkey % 5 WHEN 0 THEN 'imported' WHEN 1 THEN 'pending' WHEN 2 THEN 'ignored' WHEN 3 THEN 'blocked' ELSE 'gone' END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN 's' || (o_orderkey % 100) END AS product_uuid, CAST(o_orderdate AS TIMESTAMP) AS first_seen_at FROM orders""",
    "suggestions": """SELECT o_orderkey AS id, 'p' || o_custkey AS product_uuid, 'p' || (o_orderkey % 200) AS candidate_uuid, CAST(o_orderkey % 50 + 50 AS INTEGER) AS score,
  CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders""",
    "stored_attempts": """SELECT *, 'ean' AS key_kind, CASE WHEN status IN ('not_found', 'error') THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(substr(product_uuid, 2) AS INTEGER)) END AS next_retry_at FROM search_attempts""",
    "fetches": f"""SELECT event_id AS id, CASE {_K} % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'browser' WHEN 2 THEN 'api' END AS source, CASE WHEN {_K} < 6 THEN 403 END AS blocked_status,
  CASE WHEN {_K} % 7 = 0 THEN 404 ELSE 200 END AS status_code, CASE WHEN {_K} % 5 = 0 THEN true WHEN {_K} % 5 <> 1 THEN false END AS fallback FROM events""",
    "catalog_events": """SELECT event_id AS id, 'u' || user_id AS product_uuid, ['catalog_created', 'catalog_merged', 'catalog_pending', 'discovery_found', 'discovery_imported', 'http_error', 'screenshot'][event_id % 7 + 1] AS kind,
  CASE WHEN event_id % 7 <> 2 THEN 'e=' || event_id END AS detail, ts AS created_at FROM events""",
    "resightings": """SELECT 'f' || (l_orderkey + CASE WHEN l_linenumber % 5 = 0 THEN 1000000000 ELSE 0 END) AS fingerprint, 'shop' || (l_suppkey % 8) AS site, CASE WHEN l_linenumber % 3 <> 0 THEN 'Titre ' || l_partkey ELSE '' END AS title,
  CASE WHEN l_quantity > 25 THEN 'https://i.example/' || l_partkey END AS image_url, CASE WHEN l_quantity < 20 THEN l_suppkey || ',00 €' END AS price, CAST(l_shipdate AS TIMESTAMP) AS seen_at, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 8 * 60 + CAST(l_quantity AS INTEGER) AS seq FROM lineitem""",
    "now": "SELECT max(ts) AS t FROM events",
}
NEEDS = {
    "catalog": ["gtin12"], "drafts": ["gtin12", "catalog"], "codes": ["gtin12"], "identities": ["gtin12", "catalog"],
    "stored_attempts": ["search_attempts"], "known_discoveries": ["first_pages"], "scanned_pages": ["first_pages"],
}

STOP = "'le','la','les','de','du','des','un','une','et','the','of','neuf','nouveau','new','edition','ed','version','pack','lot','officiel','official','fr','france','francais','vf','produit','article','reference','ref'"


def name_norm(column: str) -> str:
    folded = f"regexp_replace(strip_accents(lower({column})), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
    return f"array_to_string(list_filter(regexp_split_to_array({folded}, '\\s+'), lambda w: w <> '' AND w NOT IN ({STOP})), ' ')"


def name_key(column: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(string_split({name_norm(column)}, ' '), lambda w: w <> ''))), ' ')"


def canonical(u: str = "url") -> str:
    noise = "'^(utm_|gclid|fbclid|msclkid|mc_|_ga|ref|source|cmpid|sessionid|sid|affiliate|partner|campaign)'"
    bare = f"regexp_replace(trim({u}), '#.*$', '')"
    rest = f"regexp_replace({bare}, '^[A-Za-z][A-Za-z0-9+.-]*:', '')"
    scheme = f"lower(regexp_extract({bare}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
    host = f"regexp_replace(lower(regexp_extract({rest}, '^//([^/?]*)', 1)), '^www\\.', '')"
    path = f"regexp_replace(regexp_extract(regexp_replace({rest}, '^//[^/?]*', ''), '^([^?]*)', 1), '/{{2,}}', '/', 'g')"
    path = f"CASE WHEN length({path}) > 1 THEN regexp_replace({path}, '/+$', '') ELSE {path} END"
    query = f"array_to_string(list_sort(list_filter(string_split(regexp_extract({rest}, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(string_split(p, '=')[1], {noise}, 'i'))), '&')"
    return f"CASE WHEN {scheme} = '' THEN 'https' ELSE {scheme} END || '://' || {host} || {path} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"


def slug(c: str) -> str:
    return f"lower(regexp_replace(coalesce(list_filter(string_split(regexp_replace(regexp_replace({c}, '\\?.*$', ''), '^[a-z0-9+.-]+://[^/]*', ''), '/'), lambda s: s <> '')[-1], ''), '\\.(html?|php|aspx?)$', '', 'i'))"


def using(names: str, query: str) -> str:
    wanted: list[str] = []
    for name in [*names.split(), "now"]:
        for n in [*NEEDS.get(name, []), name]:
            if n not in wanted:
                wanted.append(n)
    if "drafts" in wanted and "catalog" not in wanted:
        wanted.insert(0, "catalog")
    head = "WITH RECURSIVE " if "_rec(" in query else "WITH "
    return head + ",\n".join(f"{n} AS ({ADAPTERS[n]})" for n in wanted) + "\n" + query


SITE_AGG = """count(*) AS checks, count(*) FILTER (status = 'error') AS errors, avg(response_time_ms) FILTER (status = 'ok') AS avg_response_ms,
  count(*) FILTER (availability = 'unknown') AS unknown_states, count(*) FILTER (fetch_source = 'browser') AS browser_checks, avg(confidence) AS avg_confidence,
  count(*) FILTER (http_status = 403) AS http_403, count(*) FILTER (http_status = 429) AS http_429, count(*) FILTER (http_status = 404) AS http_404,
  count(*) FILTER (http_status >= 500) AS http_5xx, count(*) FILTER (http_status BETWEEN 400 AND 499) AS http_4xx"""
STATS = f"stats AS (SELECT site, {SITE_AGG} FROM checks JOIN products ON product_uuid = uuid, now WHERE checked_at >= t - INTERVAL 168 HOUR GROUP BY site)"
EVENTS_N = "ev AS (SELECT source AS site, count(*) FILTER (kind = 'blocked') AS blocked, count(*) FILTER (kind = 'browser_fallback') AS browser_fallback, count(*) FILTER (kind = 'network_error') AS network_error, count(*) FILTER (kind = 'http_error') AS http_error, count(*) FILTER (kind = 'page_missing') AS page_missing FROM engine_events, now WHERE created_at >= t - INTERVAL 168 HOUR GROUP BY source)"


def scored(source: str) -> str:
    """CTE text that adds penalties, score, score_status and main_issue to `source`."""
    rates = {
        0: "errors / checks / 0.10 * 30", 1: "(http_403 + http_429 + blocked) / checks / 0.05 * 25", 2: "unknown_states / checks / 0.20 * 20",
        3: "browser_checks / checks / 0.30 * 10", 4: "coalesce(least(1.0, avg_response_ms / 8000.0), 0.0) / 1.0 * 8",
        5: "coalesce(greatest(0.0, (50.0 - avg_confidence) / 50.0), 0.0) / 1.0 * 7",
    }
    weights = (30, 25, 20, 10, 8, 7)
    labels = ("erreurs", "blocages", "états indéterminés", "bascules navigateur", "lenteur", "confiance")
    pens = ", ".join(f"CASE WHEN checks >= 10 THEN CAST(round_even(CAST(least({weights[i]}.0, {r.replace('/ checks', '/ CAST(checks AS DOUBLE)')}) AS DOUBLE), 0) AS INTEGER) ELSE 0 END AS penalty_{i}" for i, r in rates.items())
    names = ", ".join(f"penalty_{i}" for i in range(6))
    issue = " ".join(f"WHEN penalty_{i} = greatest({names}) THEN '{label}'" for i, label in enumerate(labels))
    return f"""pen AS (SELECT *, {pens} FROM {source}),
sc AS (SELECT *, greatest(0, 100 - ({names.replace(', ', ' + ')})) AS score FROM pen),
scored AS (SELECT *, CASE WHEN checks < 10 THEN 'observation' WHEN score >= 90 THEN 'healthy' WHEN score >= 70 THEN 'degraded' ELSE 'unhealthy' END AS score_status,
  CASE WHEN greatest({names}) = 0 THEN NULL {issue} END AS main_issue FROM sc)"""


CARDS = f"""{STATS}, {EVENTS_N},
lastc AS (SELECT site, max(checked_at) AS last_check_at FROM checks JOIN products ON product_uuid = uuid GROUP BY site),
wat AS (SELECT site, count(*) FILTER (enabled) AS products FROM products GROUP BY site),
base AS (SELECT site, coalesce(checks, 0) AS checks, coalesce(errors, 0) AS errors, avg_response_ms, coalesce(unknown_states, 0) AS unknown_states, coalesce(browser_checks, 0) AS browser_checks,
  avg_confidence, coalesce(http_403, 0) AS http_403, coalesce(http_429, 0) AS http_429, coalesce(http_404, 0) AS http_404, coalesce(http_5xx, 0) AS http_5xx, coalesce(http_4xx, 0) AS http_4xx,
  coalesce(blocked, 0) AS blocked, coalesce(browser_fallback, 0) AS browser_fallback, coalesce(network_error, 0) AS network_error, coalesce(http_error, 0) AS http_error, coalesce(page_missing, 0) AS page_missing,
  last_check_at, coalesce(products, 0) AS products
  FROM (SELECT DISTINCT site FROM products UNION SELECT 'site_new') LEFT JOIN stats USING (site) LEFT JOIN ev USING (site) LEFT JOIN lastc USING (site) LEFT JOIN wat USING (site)),
{scored('base')}"""

WINDOWS = """win AS (SELECT site, """ + ", ".join(
    f"count(*) FILTER ({w}) AS {n}_checks, count(*) FILTER ({w} AND fetch_source = 'browser') AS {n}_browser_checks, count(*) FILTER ({w} AND availability = 'unknown') AS {n}_unknown_states, count(*) FILTER ({w} AND http_status = 403) AS {n}_http_403, avg(response_time_ms) FILTER ({w} AND status = 'ok') AS {n}_ms, avg(confidence) FILTER ({w}) AS {n}_confidence"
    for n, w in (("recent", "checked_at >= t - INTERVAL 24 HOUR"), ("baseline", "checked_at < t - INTERVAL 24 HOUR"))
) + " FROM checks JOIN products ON product_uuid = uuid, now WHERE checked_at >= t - INTERVAL 168 HOUR GROUP BY site)"


def _drift(key: str) -> str:
    rate, base = f"recent_{key} / CAST(recent_checks AS DOUBLE)", f"baseline_{key} / CAST(baseline_checks AS DOUBLE)"
    return f"SELECT site AS source, '{key}' AS kind FROM win WHERE recent_checks >= 20 AND {rate} >= 0.1 AND CASE WHEN baseline_checks >= 20 THEN {rate} >= {base} * 2 ELSE {rate} >= 0.1 * 3 END"


_SEEN = "conc AS (SELECT *, " + ", ".join(
    f"lag({c}) OVER w AS o_{c}" for c in ("id", "availability", "price", "page_exists", "action", "seller_type", "seller_name")
) + " FROM readings WHERE availability <> 'unknown' WINDOW w AS (PARTITION BY product_uuid ORDER BY checked_at, id))"
_D = "concat_ws(' · ', {p}availability, {p}price, 'vendu par ' || {p}seller_name)"
_ACT = "('add_to_cart','preorder','request_invite','buy_now')"
CHANGES = f"""{_SEEN},
c AS (SELECT *, NOT o_page_exists AND page_exists AS appeared, o_availability <> availability AS moved FROM conc WHERE o_id IS NOT NULL),
ch AS (
  SELECT product_uuid, id, checked_at, 'product_appeared' AS change_type, {_D.format(p='o_')} AS old_value, {_D.format(p='')} AS new_value FROM c WHERE appeared
  UNION ALL SELECT product_uuid, id, checked_at, CASE availability WHEN 'in_stock' THEN 'back_in_stock' WHEN 'preorder' THEN CASE WHEN action = 'request_invite' THEN 'invitation_opened' ELSE 'preorder_opened' END
    WHEN 'unavailable' THEN 'went_out_of_stock' WHEN 'not_listed' THEN 'product_delisted' ELSE 'status_changed' END, {_D.format(p='o_')}, {_D.format(p='')} FROM c WHERE NOT appeared AND moved
  UNION ALL SELECT product_uuid, id, checked_at, CASE WHEN seller_type = 'official' THEN 'seller_became_official' ELSE 'seller_left_buybox' END,
    coalesce(o_seller_name, CASE WHEN seller_type = 'official' THEN 'revendeur tiers' ELSE 'vendeur officiel' END), coalesce(seller_name, CASE WHEN seller_type = 'official' THEN 'vendeur officiel' ELSE 'revendeur tiers' END)
    FROM c WHERE action IN {_ACT} AND o_action IN {_ACT} AND seller_type <> 'unknown' AND o_seller_type <> 'unknown' AND seller_type <> o_seller_type
  UNION ALL SELECT product_uuid, id, checked_at, 'price_appeared', NULL, price FROM c WHERE NOT moved AND NOT appeared AND price IS NOT NULL AND o_price IS NULL
  UNION ALL SELECT product_uuid, id, checked_at, 'price_changed', o_price, price FROM c WHERE NOT moved AND NOT appeared AND price <> o_price)"""
LABEL = "CASE change_type WHEN 'product_appeared' THEN 'Produit découvert' WHEN 'product_delisted' THEN 'Fiche retirée' WHEN 'price_appeared' THEN 'Prix détecté' WHEN 'price_changed' THEN 'Prix modifié' WHEN 'preorder_opened' THEN 'Précommande ouverte' WHEN 'invitation_opened' THEN 'Invitation ouverte' WHEN 'back_in_stock' THEN 'Retour en stock' WHEN 'went_out_of_stock' THEN 'Rupture de stock' WHEN 'status_changed' THEN 'Disponibilité modifiée' ELSE change_type END"

RUNS = """runs AS (SELECT *, last_value(price IGNORE NULLS) OVER w AS new_price, last_value(availability IGNORE NULLS) OVER w AS new_availability, first_value(monitored_uuid IGNORE NULLS) OVER w AS first_monitored,
  last_value(price IGNORE NULLS) OVER b AS old_price, last_value(availability IGNORE NULLS) OVER b AS old_availability, row_number() OVER (PARTITION BY canonical_url ORDER BY seen_at, seq) AS rn FROM offer_events
  WINDOW w AS (PARTITION BY canonical_url ORDER BY seen_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY canonical_url ORDER BY seen_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
hist AS (SELECT canonical_url, seen_at, seq, new_price AS price, new_availability AS availability FROM runs
  WHERE rn = 1 OR (price IS NOT NULL AND price IS DISTINCT FROM old_price) OR (availability IS NOT NULL AND availability IS DISTINCT FROM old_availability)),
state AS (SELECT canonical_url, arg_max(product_uuid, rn) AS product_uuid, arg_max(site, rn) AS site, max(new_price) FILTER (rn = n) AS price, max(new_availability) FILTER (rn = n) AS availability, max(first_monitored) FILTER (rn = n) AS monitored_uuid,
  min(seen_at) AS first_seen_at, max(seen_at) AS last_checked_at FROM (SELECT *, count(*) OVER (PARTITION BY canonical_url) AS n FROM runs) GROUP BY canonical_url)"""

#: The longest common substring of a and b, first in a, as 1000 * length - place; null if there is none.
_LONGEST = "list_max(list_transform(list_filter(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda n: {'n': n, 'i': i}))), lambda s: contains(b, substr(a, s.i, s.n))), lambda s: s.n * 1000 - s.i))"


def similarities(pairs: str) -> str:
    """CTEs that end in sims (l, r, similarity) of the rows of the CTE `pairs` (l, r): matching blocks left and right of the longest one, again and again."""
    return f"""blocks_rec(l, r, a, b, hit) AS (SELECT l, r, l, r, CAST(0 AS BIGINT) FROM {pairs}
  UNION ALL SELECT l, r, x.a, x.b, x.hit FROM (SELECT l, r, unnest([{{'a': substr(a, 1, i - 1), 'b': substr(b, 1, j - 1), 'hit': n}}, {{'a': substr(a, i + n), 'b': substr(b, j + n), 'hit': CAST(0 AS BIGINT)}}]) AS x
    FROM (SELECT *, strpos(b, substr(a, i, n)) AS j FROM (SELECT *, n * 1000 - best AS i FROM (SELECT *, (best + 999) // 1000 AS n FROM (SELECT *, {_LONGEST} AS best FROM blocks_rec WHERE a <> '' AND b <> '') WHERE best IS NOT NULL))))),
sims AS (SELECT l, r, CASE WHEN l = r THEN 1e0 ELSE (len(list_intersect(list_distinct(string_split(l, ' ')), list_distinct(string_split(r, ' ')))) / CAST(len(list_distinct(string_split(l || ' ' || r, ' '))) AS DOUBLE) + 2e0 * sum(hit) / (length(l) + length(r))) / 2 END AS similarity
  FROM blocks_rec GROUP BY l, r)"""


_RUNGS = " UNION ALL ".join(
    f"SELECT draft_id, uuid, created_seq, {s} AS score, '{f}' AS method FROM d JOIN c ON d.{f} = c.{f} WHERE d.{f} <> ''"
    for f, s in (("ean", 100), ("upc", 98), ("isbn", 96), ("mpn", 95), ("asin", 93), ("manufacturer_sku", 92), ("manufacturer_ref", 90), ("model_number", 88))
)
_CLOSE = " UNION ALL ".join(
    f"SELECT draft_id, uuid, created_seq, {s}, '{m}' FROM d JOIN c ON d.{f} = c.{f} JOIN sims ON l = d.nn AND r = c.nn WHERE d.{f} <> '' AND similarity >= 0.82"
    for m, f, s in (("name_release_date", "release_date", 80), ("name_collection", "coll", 75))
)
LADDER = f"""d AS (SELECT *, {name_norm('name')} AS nn, {name_key('name')} AS k, lower(trim(brand)) AS b, lower(trim(collection)) AS coll FROM drafts),
c AS (SELECT *, {name_norm('name')} AS nn, {name_key('name')} AS k, lower(trim(brand)) AS b, lower(trim(collection)) AS coll FROM catalog),
named AS (SELECT DISTINCT d.nn AS l, c.nn AS r FROM (SELECT DISTINCT nn FROM d) d, (SELECT DISTINCT nn FROM c) c WHERE d.nn <> '' AND c.nn <> ''),
{similarities('named')},
hits AS ({_RUNGS} UNION ALL SELECT draft_id, uuid, created_seq, 85, 'name_brand' FROM d JOIN c ON d.k = c.k AND d.b = c.b WHERE d.b <> ''
  UNION ALL {_CLOSE}
  UNION ALL SELECT draft_id, f.uuid, f.created_seq, 70, 'name_only' FROM d JOIN (SELECT k, arg_min(uuid, (created_seq, uuid)) AS uuid, min(created_seq) AS created_seq FROM c GROUP BY k) f ON d.k = f.k),
best AS (SELECT draft_id, uuid, score, method FROM (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY score DESC, created_seq, uuid, method) AS n FROM hits) WHERE n = 1)"""
SIMILAR = f"""c AS (SELECT uuid, {name_norm('name')} AS nn, release_date, lower(trim(collection)) AS coll FROM catalog),
named AS (SELECT DISTINCT x.nn AS l, y.nn AS r FROM (SELECT DISTINCT nn FROM c) x, (SELECT DISTINCT nn FROM c) y WHERE x.nn <> '' AND y.nn <> ''),
{similarities('named')}"""


def _event(old: str, new: str) -> str:
    """The signature of the changes between two readings: sorted changes, '' for none."""
    def said(x: str) -> str:
        return f"concat_ws(' · ', {x}.availability, {x}.price, 'vendu par ' || {x}.seller_name)"

    appeared, moved = f"(NOT {old}.page_exists AND {new}.page_exists)", f"({old}.availability <> {new}.availability)"
    official = f"{new}.seller_type = 'official'"
    seller = f"({old}.action IN {_ACT} AND {new}.action IN {_ACT} AND 'unknown' NOT IN ({old}.seller_type, {new}.seller_type) AND {old}.seller_type <> {new}.seller_type)"
    found = [
        f"CASE WHEN {appeared} THEN 'product_appeared=' || {said(new)} WHEN {moved} THEN CASE {new}.availability WHEN 'in_stock' THEN 'back_in_stock' WHEN 'preorder' THEN CASE WHEN {new}.action = 'request_invite' THEN 'invitation_opened' ELSE 'preorder_opened' END WHEN 'unavailable' THEN 'went_out_of_stock' WHEN 'not_listed' THEN 'product_delisted' ELSE 'status_changed' END || '=' || {said(new)} END",
        f"CASE WHEN {seller} THEN CASE WHEN {official} THEN 'seller_became_official=' ELSE 'seller_left_buybox=' END || coalesce({new}.seller_name, CASE WHEN {official} THEN 'vendeur officiel' ELSE 'revendeur tiers' END) END",
        f"CASE WHEN NOT {appeared} AND NOT {moved} AND {new}.price IS NOT NULL AND {new}.price IS DISTINCT FROM {old}.price THEN CASE WHEN {old}.price IS NULL THEN 'price_appeared=' ELSE 'price_changed=' END || {new}.price END",
    ]
    return "concat_ws('|', " + ", ".join(found) + ")"


#: Readings in order; each step looks at the confirmed reading (st), the next one and the one after it.
CONFIRM = f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY product_uuid ORDER BY checked_at, id) AS rn FROM readings),
walk_rec(product_uuid, rn, st, outcome, told, was) AS (
  SELECT DISTINCT product_uuid, CAST(1 AS BIGINT), CAST(NULL AS BIGINT), '', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM readings
  UNION ALL SELECT product_uuid,
    CASE WHEN outcome IN ('confirmed', 'unstable') THEN rn + 2 ELSE rn + 1 END,
    CASE outcome WHEN 'skip' THEN st WHEN 'unstable' THEN st WHEN 'confirmed' THEN rn + 1 ELSE rn END, outcome,
    CASE WHEN outcome IN ('confirmed', 'unstable') THEN rn + 1 ELSE rn END, CASE outcome WHEN 'confirmed' THEN st WHEN 'unstable' THEN rn END
  FROM (SELECT w.product_uuid, w.rn, w.st, CASE WHEN n.availability = 'unknown' THEN 'skip' WHEN w.st IS NULL THEN 'baseline' WHEN {_event('o', 'n')} = '' THEN 'same' WHEN s.rn IS NULL THEN 'waits'
      WHEN s.availability <> 'unknown' AND {_event('o', 'n')} = {_event('o', 's')} THEN 'confirmed' ELSE 'unstable' END AS outcome
    FROM walk_rec w JOIN ordered n ON n.product_uuid = w.product_uuid AND n.rn = w.rn LEFT JOIN ordered o ON o.product_uuid = w.product_uuid AND o.rn = w.st LEFT JOIN ordered s ON s.product_uuid = w.product_uuid AND s.rn = w.rn + 1))
SELECT w.product_uuid, r.id, w.outcome, CASE WHEN w.was IS NOT NULL THEN concat_ws(' · ', o.availability, o.price) END AS old_value, concat_ws(' · ', r.availability, r.price) AS new_value
FROM walk_rec w JOIN ordered r ON r.product_uuid = w.product_uuid AND r.rn = w.told LEFT JOIN ordered o ON o.product_uuid = w.product_uuid AND o.rn = w.was WHERE w.outcome IN ('baseline', 'confirmed', 'unstable')"""

_DIGITS = "regexp_replace(coalesce(code, ''), '[^0-9]', '', 'g')"
CODES = f"""dig AS (SELECT *, {_DIGITS} AS dd, upper(regexp_replace(coalesce(code, ''), '[^0-9Xx]', '', 'g')) AS raw FROM codes),
v AS (SELECT *, length(dd) IN (8, 12, 13, 14) AND length(replace(left(dd, length(dd) - 1), left(dd, 1), '')) > 0
  AND (10 - list_sum(list_transform(range(1, length(dd)), lambda i: CAST(substr(dd, length(dd) - i, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10 = CAST(right(dd, 1) AS INTEGER) AS valid FROM dig WHERE dd <> ''
  UNION ALL SELECT *, false FROM dig WHERE dd = '')
SELECT key, kind, coalesce(valid, false) AS valid,
  CASE WHEN valid THEN CASE WHEN length(dd) = 12 THEN '0' || dd WHEN length(dd) = 14 AND left(dd, 1) = '0' THEN substr(dd, 2) ELSE dd END END AS ean,
  CASE WHEN valid AND length(dd) = 12 THEN dd WHEN valid AND length(dd) = 13 AND left(dd, 1) = '0' THEN substr(dd, 2) END AS upc,
  CASE WHEN length(raw) = 13 AND NOT contains(raw, 'X') AND valid THEN raw WHEN length(raw) = 10 THEN raw END AS isbn FROM v"""
