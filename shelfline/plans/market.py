"""Queries over what marketplaces show, each over a text of its own for every page or line, with SQL that reads it too."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.functions import html as H
from shelfline.functions import listing as L
from shelfline.functions import market as M
from shelfline.functions import text as X
from shelfline.plans import pages as P
from shelfline.plans import sql as S
from shelfline.plans.register import query, with_ctes
from shelfline.sources import adapters as A


def _literal(value) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _case(rows: list, at: int) -> str:
    """The expected value of column `at` by the number of the form."""
    return "CASE p_partkey % " + str(len(rows)) + " " + " ".join(f"WHEN {i} THEN {_literal(r[at])}" for i, r in enumerate(rows)) + " END"


def _expected(rows: list, *names: str) -> str:
    return "SELECT p_partkey AS key, " + ", ".join(f"{_case(rows, i + 1)} AS {n}" for i, n in enumerate(names)) + " FROM part"


def _forms(spark, d, rows: list, *names: str):
    """The parts, each with one of the forms in turn."""
    own = A.spread(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("key"))
    pick = lambda i: F.element_at(F.array(*[F.lit(r[i] if len(names) > 1 else r[0]) for r in rows]), (F.col("key") % len(rows) + 1).cast("int"))
    return own.select("key", *[pick(i).alias(n) for i, n in enumerate(names)])


_PATH_ASIN = "regexp_extract(url, '(?i)/(?:dp|gp/product|gp/aw/d|product|-)/([A-Z0-9]{10})(?:[/?#]|$)', 1)"
_ASIN = f"upper(coalesce(nullif({_PATH_ASIN}, ''), nullif(regexp_extract(url, '(?i)[?&]asin=([A-Z0-9]{{10}})', 1), '')))"
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


def _market(column: int) -> str:
    return "CASE " + " ".join(f"WHEN h = '{m[0]}' OR ends_with(h, '.{m[0]}') THEN '{m[column]}'" for m in M.MARKETS) + " END"


S.ADAPTERS["market_links"] = f"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://WWW.Amazon.' || tld || '/Coffret-Rare/dp/' || lower(a) || '/ref=x?th=1#top' WHEN 1 THEN 'http://amazon.' || tld || '/gp/product/' || a
  WHEN 2 THEN 'https://www.amazon.' || tld || '/s?k=' || page_id || '&asin=' || a || '#f' WHEN 3 THEN 'https://www.amazon.' || tld || '/dp/SHORT' || page_id || '?language=es_US' WHEN 4 THEN url ELSE 'https://notamazon.' || tld || '/dp/' || a END AS url
  FROM (SELECT page_id, url, 'B0' || lpad(CAST(page_id AS VARCHAR), 8, '0') AS a, {A.MARKET_TLDS}[page_id % {len(A.MARKET_TLDS)} + 1] AS tld FROM pages)"""


@query("market_links", f"""SELECT page_id, article, CASE WHEN article IS NOT NULL THEN root || '/dp/' || article ELSE root || path END AS article_url, {_market(0)} AS domain,
  CASE WHEN regexp_matches(base, '[?&]language=') THEN url ELSE base || CASE WHEN contains(base, '?') THEN '&' ELSE '?' END || 'language=' || coalesce({_market(2)}, 'fr_FR') || fragment END AS localised
  FROM (SELECT *, {_ASIN} AS article, h, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || h AS root, regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '^([^?#]*)', 1) AS path,
    regexp_replace(url, '#.*$', '') AS base, regexp_extract(url, '(#.*)$', 1) AS fragment FROM (SELECT *, {_HOST} AS h FROM market_links))""")
def market_addresses(spark, d):
    url = F.col("url")
    return A.market_links(spark, d).select("page_id", M.asin(url).alias("article"), M.article_url(url).alias("article_url"), M.market(url, 0).alias("domain"), M.with_language(url).alias("localised"))


S.ADAPTERS["market_texts"] = f"""SELECT page_id, title, CASE page_id % 7 WHEN 0 THEN 'Prix : 1 ' || (page_id % 900 + 100) || ',99 € le ' || (page_id % 28 + 1) || '/' || (page_id % 12 + 1) || '/2026' WHEN 1 THEN title || ' $' || page_id % 97 || '.50, release 2026-08-' || (page_id % 20 + 10) || ' or 1.2.2020'
  WHEN 2 THEN '£' || page_id % 97 || '.99 on ' || (page_id % 9 + 1) || '-4-2025' WHEN 3 THEN title WHEN 4 THEN 'Vendu par : ' || title || ' ' || title || ' Expédié par Autre' WHEN 5 THEN 'sans prix ' || page_id || ' €' ELSE md5(title) END AS text
  FROM (SELECT page_id, {P._TITLE} AS title FROM pages)"""
_DATE = "regexp_extract(text, '(\\d{{1,2}})[/\\s.-](\\d{{1,2}})[/\\s.-](\\d{{4}})', {})"


@query("market_texts", f"""SELECT page_id, CASE WHEN a <> '' THEN replace(regexp_replace(a, '[ ]', '', 'g'), '.', ',') || ' €' END AS amount, CASE WHEN contains(text, '€') THEN 'EUR' WHEN contains(text, '$') THEN 'USD' WHEN contains(text, '£') THEN 'GBP' END AS currency,
  CASE WHEN iso <> '' THEN iso WHEN {_DATE.format(3)} <> '' THEN {_DATE.format(3)} || '-' || lpad({_DATE.format(2)}, 2, '0') || '-' || lpad({_DATE.format(1)}, 2, '0') END AS released
  FROM (SELECT *, regexp_extract(text, '(\\d{{1,4}}(?:[ ]?\\d{{3}})*[.,]\\d{{2}})', 1) AS a, regexp_extract(text, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS iso FROM market_texts)""")
def market_amounts(spark, d):
    text = F.col("text")
    return A.market_texts(spark, d).select("page_id", M.amount(text).alias("amount"), M.currency(text).alias("currency"), M.iso_date(text).alias("released"))


_SAID = "list_filter(regexp_split_to_array(regexp_split_to_array(regexp_replace(regexp_extract(text, '(?is)vendu par(.*)$', 1), '^[ :•|\\n\\t-]+', ''), " + P._SELLER_STOP + ")[1], '\\s+'), lambda w: w <> '')"


@query("market_texts", f"SELECT page_id, nullif(substr(array_to_string(list_filter(w, lambda x, i: i = 1 OR lower(x) <> lower(w[i - 1])), ' '), 1, 80), '') AS seller, {P._READABLE} AS readable FROM (SELECT page_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, {_SAID} AS w FROM market_texts)")
def market_sellers(spark, d):
    text = F.col("text")
    return A.market_texts(spark, d).select("page_id", M.seller(text, "vendu par").alias("seller"), M.readable(text).alias("readable"))


S.ADAPTERS["delivery_labels"] = f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Livrer à ' || name WHEN 1 THEN 'Deliver to : ' || upper(name) WHEN 2 THEN '  Livraison à ' || (10000 + page_id * 37 % 90000) || ' ' || word WHEN 3 THEN 'Livrer à 75001 ' || name ELSE 'vers ' || word || ' ' || name || ' demain' END AS label
  FROM (SELECT page_id, {P._dealt([n for n, _ in M.COUNTRIES])} AS name, string_split({P._TITLE}, ' ')[1] AS word FROM pages)"""
_LEAD = "|".join(M.DELIVERY_LEADS)
_FOREIGN = "\\b(?:" + "|".join(n for n, c in M.COUNTRIES if c != "FR") + ")\\b"


@query("delivery_labels", f"""SELECT page_id, coalesce(CASE {' '.join(f"WHEN bare = '{n}' THEN '{c}'" for n, c in M.COUNTRIES)} END, CASE WHEN regexp_matches(bare, '\\b(?:0[1-9]|[1-8]\\d|9[0-8])\\d{{3}}\\b') AND NOT regexp_matches(bare, '{_FOREIGN}') THEN 'FR' END,
  CASE {' '.join(f"WHEN regexp_matches(bare, '{chr(92)}b{n}{chr(92)}b') THEN '{c}'" for n, c in M.COUNTRIES)} END) AS country
  FROM (SELECT page_id, CASE WHEN regexp_matches(f, '^(?:{_LEAD})') THEN regexp_replace(regexp_replace(f, '^(?:{_LEAD})', ''), '^[ :,-]+|[ :,-]+$', '', 'g') ELSE f END AS bare
    FROM (SELECT page_id, trim(regexp_replace(lower(strip_accents(label)), '\\s+', ' ', 'g')) AS f FROM delivery_labels))""")
def market_destinations(spark, d):
    rows = A.delivery_labels(spark, d).withColumn("folded", X.normalise(F.col("label")))
    return rows.select("page_id", M.destination(F.col("folded")).alias("country"))


_ACTIONS = ", ".join(f"'{a}'" for a in M.STATES)
S.ADAPTERS["analysed_offers"] = f"""SELECT l_orderkey * 10 + l_linenumber AS id, [{_ACTIONS}][(l_orderkey + l_linenumber) % {len(M.STATES)} + 1] AS action, CASE l_suppkey % 3 WHEN 0 THEN 'Amazon EU' WHEN 1 THEN 'Boutique ' || l_suppkey ELSE '' END AS seller,
  CAST(l_quantity * 2 AS INTEGER) AS confidence, CASE l_linenumber % 4 WHEN 0 THEN 'FR' WHEN 1 THEN 'US' WHEN 2 THEN 'FR' END AS country FROM lineitem"""
_PAIRS = lambda of, column: "CASE " + column + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in of.items()) + " END"


@query("analysed_offers", f"""SELECT id, state, CASE WHEN seller = '' THEN 'unknown' WHEN official THEN 'official' ELSE 'third_party' END AS seller_type, CASE WHEN confidence < 60 OR country <> 'FR' THEN 'unknown' ELSE state END AS guarded,
  CASE WHEN country <> 'FR' THEN 'locale' WHEN confidence < 60 THEN 'confidence' WHEN state = 'unknown' THEN 'unknown' END AS reason, {_PAIRS(H.AVAILABILITY, 'action')} AS availability
  FROM (SELECT *, CASE WHEN action IN ('add_to_cart', 'buy_now') AND seller <> '' AND NOT official THEN 'third_party_only' ELSE {_PAIRS(M.STATES, 'action')} END AS state FROM (SELECT *, contains(lower(seller), 'amazon') AS official FROM analysed_offers))""")
def market_states(spark, d):
    rows = A.analysed_offers(spark, d)
    official, country = F.contains(F.lower("seller"), F.lit("amazon")), F.col("country")
    state = M.native_state(F.col("action"), F.col("seller"), official)
    elsewhere = F.coalesce(country != "FR", F.lit(False))
    availability = F.coalesce(F.create_map(*[F.lit(x) for p in H.AVAILABILITY.items() for x in p])[F.col("action")], F.lit("unknown"))
    return rows.select(
        "id", state.alias("state"), M.seller_type(F.col("seller"), official).alias("seller_type"), M.guarded(state, F.col("confidence"), country, F.lit("FR")).alias("guarded"),
        M.blocked_reason(F.lit(None).cast("string"), elsewhere, F.col("confidence"), state).alias("reason"), availability.alias("availability"),
    )


@query("market_pages", "SELECT page_id, CASE WHEN contains(lower(html), 'cf-browser-verification') OR contains(lower(html), 'cloudflare') THEN 'cloudflare' WHEN contains(lower(html), 'captcha') THEN 'captcha' WHEN length(text) < 200 THEN 'error' END AS block FROM (SELECT page_id, html, trim(regexp_replace(html, '<[^>]*>', '', 'g')) AS text FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN left(html, 150 + page_id % 300) WHEN 1 THEN html || '<!-- CloudFlare ' || page_id || ' -->' ELSE html END AS html FROM market_pages))")
def market_blocks(spark, d):
    n = F.col("page_id")
    cut = F.when(n % 5 == 0, F.expr("substring(html, 1, 150 + page_id % 300)")).when(n % 5 == 1, F.concat("html", F.lit("<!-- CloudFlare "), n, F.lit(" -->"))).otherwise(F.col("html"))
    rows = A.market_pages(spark, d).select("page_id", cut.alias("html"))
    text = F.trim(F.regexp_replace("html", "<[^>]*>", ""))
    return rows.select("page_id", M.blocked(F.col("html"), text).alias("block"))


_SLUG = "regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(strip_accents(title)), '\\s+', ' ', 'g')), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60), '_+$', '')"


@query(*with_ctes("market_links", f"t AS (SELECT page_id, {P._TITLE} AS title FROM pages), u AS (SELECT page_id, {S.slug(S.canonical('url'))} AS s FROM pages)", f"SELECT t.page_id, coalesce(nullif({_SLUG}, ''), 'produit') AS slug, array_to_string(list_transform(list_filter(regexp_split_to_array(s, '[-_]+'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM t JOIN u USING (page_id)"))
def slugs_and_titles(spark, d):
    pages = A.table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), X.product_slug(X.canonical_url(F.col("url"))).alias("path"))
    return pages.select("page_id", X.slugify(F.col("title")).alias("slug"), X.title_from_url(F.col("path")).alias("title"))


@query("sites site_documents", "SELECT url AS map, unnest(regexp_extract_all(body, '<loc>\\s*([^<\\s]+)\\s*</loc>', 1)) AS url FROM site_documents")
def sitemap_pages(spark, d):
    return A.site_documents(spark, d).select(F.col("url").alias("map"), F.explode(H.sitemap_urls(F.col("body"))).alias("url"))


# --- listings ------------------------------------------------------------------------------------------------

#: Links of a page with the element `up` levels above them, whose text and pictures belong to them.
_LINKS = """own_text AS (SELECT e.page_id, e.n, coalesce((SELECT string_agg(t.said, ' ' ORDER BY t.at_text) FROM texts t WHERE t.page_id = e.page_id AND list_contains(t.holders, e.n)), '') AS text FROM elements e),
links AS (SELECT e.page_id, e.n, regexp_extract(w.tok, '\\shref="([^"]*)"', 1) AS href, t.text AS title, CASE WHEN len(e.anc) >= {up} THEN e.anc[len(e.anc) - {up} + 1] ELSE 0 END AS box, p.url AS base
  FROM elements e JOIN walk_rec w ON w.page_id = e.page_id AND w.n = e.n AND w.kind = 'open' JOIN own_text t ON t.page_id = e.page_id AND t.n = e.n JOIN market_pages p ON p.page_id = e.page_id WHERE e.tag = 'a' AND contains(w.tok, 'href=') AND length(t.text) BETWEEN {short} AND {long}),
images AS (SELECT e.page_id, e.n, e.anc, regexp_extract(w.tok, '\\ssrc="([^"]*)"', 1) AS src FROM elements e JOIN walk_rec w ON w.page_id = e.page_id AND w.n = e.n AND w.kind = 'open' WHERE e.tag = 'img')"""
_IMAGE = "(SELECT arg_min(i.src, i.n) FROM images i WHERE i.page_id = l.page_id AND (l.box = 0 OR list_contains(i.anc, l.box)))"
_BOX_TEXT = "CASE WHEN l.box = 0 THEN (SELECT string_agg(t.said, ' ' ORDER BY t.at_text) FROM texts t WHERE t.page_id = l.page_id) ELSE (SELECT b.text FROM own_text b WHERE b.page_id = l.page_id AND b.n = l.box) END"
LISTED = ("/t", "/dp/", "/X")
_EUR = "coalesce(nullif(regexp_extract(box_text, '(\\d{1,4}[.,]\\d{2})\\s*€', 1), ''), nullif(regexp_extract(box_text, '€\\s*(\\d{1,4}[.,]\\d{2})', 1), ''))"


@query(*with_ctes("market_pages", f"{P.TABLES},\n{_LINKS.format(up=3, short=3, long=200)}", f"""SELECT page_id, url, arg_min(title, n) AS title, arg_min(image_url, n) AS image_url, arg_min(price, n) AS price FROM (
  SELECT *, replace({_EUR}, '.', ',') || ' €' AS price FROM (SELECT l.page_id, l.n, l.title, regexp_extract(l.base, '^(https://[^/]+)', 1) || trim(l.href) AS url, {_IMAGE} AS image_url, {_BOX_TEXT} AS box_text FROM links l))
  WHERE {' OR '.join(f"contains(lower(url), '{x.lower()}')" for x in LISTED)} GROUP BY page_id, url"""))
def listing_products(spark, d):
    found = L.listing_products(A.market_pages(spark, d).withColumnRenamed("page_id", "key"), LISTED)
    return found.select(F.col("key").alias("page_id"), "url", "title", "image_url", "price")


_MARKED = "(SELECT arg_min(t.text, e.n) FROM elements e JOIN own_text t ON t.page_id = e.page_id AND t.n = e.n WHERE e.page_id = l.page_id AND (l.box = 0 OR list_contains(e.anc, l.box)) AND contains(e.class, 'a-offscreen') AND EXISTS (SELECT 1 FROM elements a WHERE a.page_id = e.page_id AND list_contains(e.anc, a.n) AND list_contains(string_split(a.class, ' '), 'a-price')))"


@query(*with_ctes("market_pages", f"{P.TABLES},\n{_LINKS.format(up=4, short=5, long=250)}", f"""SELECT page_id, 'https://www.amazon.fr/dp/' || asin AS url, arg_min(title, n) AS title, arg_min(image_url, n) AS image_url, arg_min(price, n) AS price FROM (
  SELECT *, replace(regexp_replace(regexp_extract(marked, '(\\d{{1,4}}(?:[ ]?\\d{{3}})*[.,]\\d{{2}})', 1), ' ', '', 'g'), '.', ',') || ' €' AS price FROM (
    SELECT l.page_id, l.n, l.title, {_PATH_ASIN.replace('url', 'l.href')} AS asin, {_IMAGE} AS image_url, {_MARKED} AS marked FROM links l)) WHERE asin <> '' GROUP BY page_id, asin"""))
def market_listing(spark, d):
    found = L.market_listing(A.market_pages(spark, d).withColumnRenamed("page_id", "key"))
    return found.select(F.col("key").alias("page_id"), "url", "title", "image_url", "price")


# --- details ---------------------------------------------------------------------------------------------------

_DETAILS = """cells AS (SELECT e.page_id, r.n AS row_n, t.text, row_number() OVER (PARTITION BY e.page_id, r.n ORDER BY e.n) AS nth FROM elements r JOIN elements e ON e.page_id = r.page_id AND list_contains(e.anc, r.n) AND e.tag IN ('th', 'td')
    JOIN own_text t ON t.page_id = e.page_id AND t.n = e.n WHERE r.tag = 'tr'),
said_rows AS (SELECT a.page_id, a.row_n, trim(regexp_replace(lower(strip_accents(a.text)), '^[ :]+|[ :]+$', '', 'g')) AS label, b.text AS value FROM cells a JOIN cells b ON b.page_id = a.page_id AND b.row_n = a.row_n AND b.nth = 2 WHERE a.nth = 1 AND a.text <> '' AND b.text <> ''),
named AS (SELECT *, CASE WHEN starts_with(label, 'upc') THEN 'upc' WHEN starts_with(label, 'ean') OR starts_with(label, 'code ean') THEN 'ean' WHEN starts_with(label, 'numero de piece fabricant') THEN 'mpn' WHEN starts_with(label, 'marque') THEN 'brand' WHEN starts_with(label, 'date de sortie') THEN 'release_date' END AS field FROM said_rows),
digits AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS dd FROM named WHERE field IS NOT NULL),
facts AS (SELECT page_id, row_n, field, CASE field WHEN 'brand' THEN trim(value) WHEN 'mpn' THEN regexp_replace(upper(trim(value)), '[\\s_]+', '-', 'g') WHEN 'release_date' THEN regexp_extract(value, '(\\d{4})$', 1) || '-' || lpad(regexp_extract(value, '/(\\d+)/', 1), 2, '0') || '-' || lpad(regexp_extract(value, '(\\d+)/', 1), 2, '0')
    ELSE CASE WHEN length(dd) = 13 AND (10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(dd, i, 1) AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 = CAST(right(dd, 1) AS INTEGER) THEN dd END END AS value FROM digits
  UNION ALL SELECT page_id, -1, 'asin', upper(regexp_extract(url, '/dp/([A-Z0-9]{10})', 1)) FROM market_pages),
believed AS (SELECT page_id, field, arg_min(value, row_n) AS value, CASE field WHEN 'asin' THEN 98 WHEN 'ean' THEN 100 WHEN 'mpn' THEN 92 WHEN 'release_date' THEN 88 ELSE 85 END AS confidence FROM facts WHERE value <> '' GROUP BY page_id, field)"""
_OWN_TEXT = _LINKS.split(",\nlinks AS")[0]


@query(*with_ctes("market_pages", f"{P.TABLES},\n{_OWN_TEXT},\n{_DETAILS}", "SELECT * FROM believed"))
def market_details(spark, d):
    return L.detail_facts(A.market_pages(spark, d).withColumnRenamed("page_id", "key")).withColumnRenamed("key", "page_id")


@query(*with_ctes("market_pages", f"{P.TABLES},\n{_OWN_TEXT},\n{_DETAILS}", """SELECT page_id, field, value, confidence FROM (SELECT *, 0 AS rank FROM believed UNION ALL
  SELECT page_id, 'brand', 'Marque ' || page_id, 90, 1 FROM market_pages WHERE page_id % 12 = 11 UNION ALL SELECT page_id, 'mpn', 'DATA-' || page_id, 95, 1 FROM market_pages WHERE page_id % 12 = 11)
  QUALIFY row_number() OVER (PARTITION BY page_id, field ORDER BY confidence DESC, rank DESC) = 1"""))
def identity_chain(spark, d):
    """What structured data and detail tables tell of a page, field by field the one believed more."""
    pages = A.market_pages(spark, d).withColumnRenamed("page_id", "key")
    return L.chained(L.markup_facts(pages), L.detail_facts(pages)).withColumnRenamed("key", "page_id")


# --- site scans --------------------------------------------------------------------------------------------------

_SCAN = f"""{P.TABLES},
{_LINKS.format(up=3, short=3, long=200)},
homes AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS site FROM pages),
shown AS (SELECT h.site, l.page_id, l.base, l.url, arg_min(l.title, l.n) AS title, min(l.n) AS pos FROM (SELECT *, regexp_extract(base, '^(https://[^/]+)', 1) || trim(href) AS url FROM links) l JOIN homes h ON h.page_id = l.page_id
  WHERE {' OR '.join(f"contains(lower(url), '{x.lower()}')" for x in LISTED)} GROUP BY ALL),
maps AS (SELECT o.site, unnest(regexp_extract_all(d.body, '<loc>\\s*([^<\\s]+)\\s*</loc>', 1)) AS url FROM site_documents d JOIN (SELECT site, regexp_extract(base_url, '^([a-z]+://[^/]+)', 1) AS home FROM sites) o ON starts_with(d.url, o.home || '/')),
mapped AS (SELECT DISTINCT site, url FROM maps WHERE {' OR '.join(f"contains(lower(url), '{x.lower()}')" for x in LISTED)}),
said AS (SELECT site, url, substr(array_to_string(list_transform(list_filter(regexp_split_to_array({S.slug(S.canonical('url'))}, '[-_]+'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' '), 1, 200) AS t FROM mapped),
scanned AS (SELECT site, url, title, base AS source, 0 AS kind, CAST(page_id AS VARCHAR) AS place, pos FROM shown UNION ALL SELECT site, url, coalesce(nullif(t, ''), url), 'sitemap', 1, '', 0 FROM said)"""


def _scan(spark, d):
    """The scan of every site: its pages as listings, its documents as site maps."""
    site = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    home = A.table(spark, d, "pages").select(F.col("page_id").alias("key"), site.alias("site"))
    listings = A.market_pages(spark, d).withColumnRenamed("page_id", "key").join(home, "key").select("site", "key", "url", "html")
    own = A.sites(spark, d).select("site", F.regexp_extract("base_url", "^([a-z]+://[^/]+/)", 1).alias("home"))
    documents = A.site_documents(spark, d).withColumn("home", F.regexp_extract("url", "^([a-z]+://[^/]+/)", 1))
    return L.site_scan(listings, documents.join(own, "home").select("site", "body"), LISTED)


@query(*with_ctes("market_pages sites site_documents", _SCAN, "SELECT site, url, arg_min(title, (kind, place, pos)) AS title, arg_min(source, (kind, place, pos)) AS source FROM scanned GROUP BY site, url QUALIFY row_number() OVER (PARTITION BY site ORDER BY min((kind, place, pos))) <= 300"))
def site_scan_products(spark, d):
    return _scan(spark, d)[0]


@query(*with_ctes("market_pages sites site_documents", _SCAN, """SELECT site, bool_and(filled) AS complete, count(*) AS sources_scanned FROM (
  SELECT h.site, h.page_id IN (SELECT page_id FROM shown) AS filled FROM homes h UNION ALL SELECT site, site IN (SELECT site FROM mapped) FROM sites) GROUP BY site"""))
def site_scan_reports(spark, d):
    return _scan(spark, d)[1]
