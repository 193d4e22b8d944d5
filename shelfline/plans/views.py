"""Queries of lookups, lists, sinks and dashboard bundles, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.functions import text as X
from shelfline.operators import catalog as C
from shelfline.operators import changes as G
from shelfline.operators import relational as R
from shelfline.operators import resolution as E
from shelfline.operators import telemetry as T
from shelfline.operators import stories as Y
from shelfline.operators import views as V
from shelfline.plans import sql as S
from shelfline.plans.register import query, with_ctes
from shelfline.sources import adapters as A


def _now(spark, d):
    return T.latest(A.table(spark, d, "events"), "ts")


def _listed(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _offers(spark, d):
    return C.offer_state(A.offer_events(spark, d))


def _changes(spark, d):
    return G.change_events(A.readings(spark, d))


_CH = S.CHANGES + f",\nlab AS (SELECT *, {S.LABEL} AS label FROM ch)"
_DAY = "{} >= (SELECT max({}) FROM {}) - INTERVAL 24 HOUR"

# --- lookups and lists -------------------------------------------------------------------------------------


@query("alerts", "SELECT id, product_uuid, change_type FROM alerts WHERE id IN (1, 7, 7000000)")
def alerts_by_id(spark, d):
    return V.lookup(A.alerts(spark, d), "id", [1, 7, 7000000]).select("id", "product_uuid", "change_type")


@query("watch_list", "SELECT uuid, name, created_at FROM watch_list ORDER BY created_at")
def products_in_order(spark, d):
    return A.watch_list(spark, d).select("uuid", "name", "created_at").orderBy("created_at")


@query("checks", "SELECT id, status, checked_at FROM checks WHERE product_uuid = 'u1' ORDER BY checked_at DESC, id DESC LIMIT 20")
def recent_checks(spark, d):
    return R.recent(A.checks(spark, d).filter("product_uuid = 'u1'"), "checked_at", "id", 20).select("id", "status", "checked_at")


@query(*with_ctes("offer_events watch_list", S.RUNS, "SELECT product_uuid, string_agg(canonical_url, ',' ORDER BY site, canonical_url) AS items, count(*) AS n FROM state WHERE product_uuid IN (SELECT 'p' || substr(uuid, 2) FROM watch_list) GROUP BY 1"))
def offers_of_products(spark, d):
    wanted = A.watch_list(spark, d).select(F.concat(F.lit("p"), F.substring("uuid", 2, 20)).alias("product_uuid"))
    return V.grouped(_offers(spark, d), wanted, "product_uuid", "canonical_url", "site")


@query(*with_ctes("offer_events", S.RUNS, "SELECT monitored_uuid, canonical_url FROM state WHERE monitored_uuid IN ('m1', 'm2', 'm3', 'm32')"))
def offers_by_monitored(spark, d):
    return V.lookup(_offers(spark, d), "monitored_uuid", ["m1", "m2", "m3", "m32"]).select("monitored_uuid", "canonical_url")


@query("discovered", "SELECT fingerprint FROM discovered WHERE status = 'blocked'")
def blocked_fingerprints(spark, d):
    return V.lookup(A.discovered(spark, d), "status", ["blocked"]).select("fingerprint")


@query("alerts", "SELECT id, created_at FROM alerts WHERE change_type = '1-URGENT' AND product_uuid IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 100")
def alerts_history(spark, d):
    rows = R.filtered(A.alerts(spark, d), {"change_type": "1-URGENT"}).filter("product_uuid is not null")
    return R.recent(rows, "created_at", "id", 100).select("id", "created_at")


@query("checks", "SELECT id, status, response_time_ms FROM checks WHERE status = 'ok' ORDER BY response_time_ms ASC, id LIMIT 50 OFFSET 100")
def checks_page(spark, d):
    rows = R.filtered(A.checks(spark, d), {"status": "ok"}).select("id", "status", "response_time_ms")
    return R.page(rows, V.sorts("checks"), "checked_at", "id", sort="response_time_ms", order="asc", number=3, size=50)


@query(*with_ctes("readings", _CH, "SELECT product_uuid, id, change_type AS event_type, label, checked_at AS created_at FROM lab ORDER BY created_at DESC, id, change_type LIMIT 40"))
def timeline_page(spark, d):
    rows = _changes(spark, d).select("product_uuid", "id", F.col("change_type").alias("event_type"), "label", F.col("checked_at").alias("created_at"))
    return rows.orderBy(F.desc("created_at"), "id", "event_type").limit(40)


@query("discovered", "SELECT fingerprint, title, site, status FROM discovered WHERE status = 'pending' AND title ILIKE '%urg%' ORDER BY title DESC, fingerprint LIMIT 25")
def discoveries_page(spark, d):
    rows = R.filtered(A.discovered(spark, d), {"status": "pending"}, ("title", "urg")).select("fingerprint", "title", "site", "status", "first_seen_at")
    return R.page(rows, V.sorts("discoveries"), "first_seen_at", "fingerprint", sort="title", size=25).drop("first_seen_at")


@query("catalog", "SELECT uuid, name, brand, release_date FROM catalog WHERE name ILIKE '%bolt%' ORDER BY release_date DESC, uuid LIMIT 50 OFFSET 50")
def catalog_page(spark, d):
    rows = R.filtered(A.catalog_products(spark, d), None, ("name", "bolt")).select("uuid", "name", "brand", "release_date")
    return R.page(rows, V.sorts("catalog"), "release_date", "uuid", sort="release_date", number=2, size=50)


@query("watch_list", "SELECT uuid, name, tags FROM watch_list WHERE tags LIKE '%\"Drop\"%'")
def products_with_tag(spark, d):
    return V.tagged(A.watch_list(spark, d), "tags", "DROP").select("uuid", "name", "tags")


_SNAP = "snap AS (SELECT product_uuid, arg_max(coalesce(availability, 'unknown'), (checked_at, id)) AS availability, max(checked_at) AS updated_at FROM checks GROUP BY 1)"


def _snapshots(spark, d):
    newest = F.struct("checked_at", "id")
    return A.checks(spark, d).groupBy("product_uuid").agg(F.max_by(F.coalesce("availability", F.lit("unknown")), newest).alias("availability"), F.max("checked_at").alias("updated_at"))


@query(*with_ctes("products checks", _SNAP, "SELECT site, availability, count(*) AS n FROM products JOIN snap ON product_uuid = uuid GROUP BY ALL"))
def availability_by_site(spark, d):
    joined = A.products(spark, d).join(_snapshots(spark, d), F.col("uuid") == F.col("product_uuid"))
    return joined.groupBy("site", "availability").agg(F.count(F.lit(1)).alias("n"))


@query(*with_ctes("products checks", _SNAP, "SELECT uuid, site, availability, updated_at FROM (SELECT * FROM products WHERE enabled ORDER BY site, uuid LIMIT 30) LEFT JOIN snap ON product_uuid = uuid"))
def products_page_with_state(spark, d):
    """The page is cut first, and only then joined to the latest states."""
    rows = R.page(R.filtered(A.products(spark, d), {"enabled": True}), {"site": "site"}, "site", "uuid", order="asc", size=30)
    return rows.join(_snapshots(spark, d), F.col("uuid") == F.col("product_uuid"), "left").select("uuid", "site", "availability", "updated_at")


@query(*with_ctes("catalog offer_events", S.RUNS, "SELECT uuid, name, items, coalesce(n, 0) AS n FROM (SELECT uuid, name FROM catalog ORDER BY name, uuid LIMIT 40) LEFT JOIN (SELECT product_uuid, string_agg(canonical_url, ',' ORDER BY site, canonical_url) AS items, count(*) AS n FROM state GROUP BY 1) ON product_uuid = uuid"))
def catalog_page_with_offers(spark, d):
    rows = R.page(A.catalog_products(spark, d).select("uuid", "name"), V.sorts("catalog"), "name", "uuid", sort="name", order="asc", size=40)
    wanted = rows.select(F.col("uuid").alias("product_uuid"))
    own = V.grouped(_offers(spark, d), wanted, "product_uuid", "canonical_url", "site").withColumnRenamed("product_uuid", "uuid")
    return rows.join(own, "uuid", "left").withColumn("n", F.coalesce("n", F.lit(0)))


# --- predicates, labels and texts --------------------------------------------------------------------------


@query("readings", "SELECT id, availability <> 'unknown' AS conclusive, action IN ('add_to_cart', 'preorder', 'request_invite', 'buy_now') AS actionable FROM readings")
def reading_predicates(spark, d):
    return V.predicates(A.readings(spark, d)).select("id", "conclusive", "actionable")


_BUTTONS = "SELECT id, CASE id % 5 WHEN 0 THEN 'button_changed' WHEN 1 THEN 'page_changed' WHEN 2 THEN 'price_changed' WHEN 3 THEN 'back_in_stock' ELSE 'button_changed' END AS change_type, CASE WHEN id % 3 = 0 THEN 'Ajouter au PANIER' END AS old_value, CASE WHEN id % 2 = 0 THEN 'PRÉCOMMANDER vite' ELSE 'voir' END AS new_value FROM alerts"
_HINTS = "[" + ", ".join(f"'{h}'" for h in V.BUY_HINTS) + "]"


def _buys(column: str) -> str:
    return f"len(list_filter({_HINTS}, lambda h: contains(lower(coalesce({column}, '')), h))) > 0"


@query("alerts", f"SELECT id, change_type IN {_listed(V.IMPORTANT)} AS important, change_type NOT IN {_listed(V.RETIRED)} AS alert_worthy, change_type IN {_listed(V.IMPORTANT)} OR (change_type = 'button_changed' AND {_buys('new_value')} AND NOT {_buys('old_value')}) AS screenshot FROM ({_BUTTONS})")
def screenshot_policy(spark, d):
    i = F.col("id")
    kinds = F.element_at(F.array(*map(F.lit, ("button_changed", "page_changed", "price_changed", "back_in_stock", "button_changed"))), (i % 5 + 1).cast("int"))
    rows = A.alerts(spark, d).select(
        "id", kinds.alias("change_type"), F.when(i % 3 == 0, "Ajouter au PANIER").alias("old_value"), F.when(i % 2 == 0, "PRÉCOMMANDER vite").otherwise("voir").alias("new_value")
    )
    return V.screenshot_worthy(rows).select("id", "important", "alert_worthy", "screenshot")


_SITE = "coalesce(upper(site[1]) || lower(substr(site, 2)), 'Le marchand')"


@query(*with_ctes("readings products", _CH, f"SELECT product_uuid, id, change_type, CASE change_type WHEN 'seller_became_official' THEN {_SITE} || ' devient vendeur' WHEN 'seller_left_buybox' THEN {_SITE} || ' quitte la Buy Box' ELSE label END AS label FROM lab LEFT JOIN products ON uuid = product_uuid"))
def timeline_labels(spark, d):
    return V.merchant_labels(_changes(spark, d), A.products(spark, d)).select("product_uuid", "id", "change_type", "label")


@query(*with_ctes("readings", _CH, "SELECT product_uuid, id, change_type, concat_ws(' · ', coalesce(old_value, '—') || ' → ' || coalesce(new_value, '—'), CASE WHEN change_type LIKE 'price%' THEN new_value END) AS transition FROM ch"))
def change_transitions(spark, d):
    price = F.when(F.col("change_type").startswith("price"), F.col("new_value"))
    return _changes(spark, d).select("product_uuid", "id", "change_type", V.transition(F.col("old_value"), F.col("new_value"), price).alias("transition"))


_LABELS = "CASE kind " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in V.EVENT_LABELS.items()) + " ELSE kind END"
_SEVERITY = f"coalesce(severity, CASE WHEN kind IN {_listed(V.ERRORS)} THEN 'error' WHEN kind IN {_listed(V.WARNINGS)} THEN 'warning' ELSE 'info' END)"


@query("engine_events", f"SELECT id, source, kind, {_LABELS} AS label, {_SEVERITY} AS severity, left(repeat(detail, 200), 500) AS detail, product_uuid, created_at FROM (SELECT id, source, CASE WHEN id % 9 = 0 THEN 'strange' ELSE kind END AS kind, CASE WHEN id % 4 <> 0 THEN severity END AS severity, detail, product_uuid, created_at FROM engine_events) ORDER BY created_at DESC, id DESC LIMIT 200")
def engine_history(spark, d):
    """Events as they are appended: severities default by kind, details are cut, labels looked up."""
    i = F.col("id")
    rows = A.engine_events(spark, d).withColumns({
        "kind": F.when(i % 9 == 0, "strange").otherwise(F.col("kind")), "severity": F.when(i % 4 != 0, F.col("severity")), "detail": F.repeat("detail", F.lit(200)),
    })
    return R.recent(V.labelled(rows), "created_at", "id", 200).select("id", "source", "kind", "label", "severity", "detail", "product_uuid", "created_at")


# --- sinks -------------------------------------------------------------------------------------------------


@query("alerts", "SELECT id, notified OR id % 6 = 0 AS notified, CASE WHEN id % 4 = 0 THEN '/new/' || id ELSE screenshot_path END AS screenshot_path FROM alerts")
def alert_flags(spark, d):
    alerts = A.alerts(spark, d)
    sent = alerts.filter("id % 6 = 0").select("id").union(alerts.filter("id % 12 = 0").select("id"))
    pictures = alerts.filter("id % 4 = 0").select("id", F.concat(F.lit("/new/"), "id").alias("path"))
    return V.notified(alerts, sent, pictures).select("id", "notified", "screenshot_path")


@query("discovered watch_list", "SELECT fingerprint, CASE WHEN length(title) % 4 = 0 THEN 'ignored' ELSE status END AS status, CASE WHEN length(title) % 8 = 0 THEN 'doublon' END AS decision_reason, CASE WHEN product_uuid NOT IN (SELECT uuid FROM watch_list WHERE NOT enabled) THEN product_uuid END AS product_uuid FROM discovered")
def discovery_decisions(spark, d):
    found = A.discovered(spark, d)
    n = F.length("title")
    decisions = found.filter(n % 4 == 0).select("fingerprint", F.lit("ignored").alias("decision"), F.when(n % 8 == 0, "doublon").otherwise("").alias("reason"))
    return V.decided_discoveries(found, decisions, A.watch_list(spark, d).filter("not enabled").select("uuid"))


@query("suggestions drafts", "SELECT product_uuid, candidate_uuid, score, 'pending' AS status FROM (SELECT product_uuid, candidate_uuid, max(score) AS score FROM (SELECT product_uuid, 'p' || (id % 50) AS candidate_uuid, score FROM suggestions) GROUP BY ALL) m WHERE NOT EXISTS (SELECT 1 FROM suggestions s WHERE s.status = 'pending' AND s.product_uuid = m.product_uuid AND s.candidate_uuid = m.candidate_uuid)")
def suggestions_to_add(spark, d):
    pending = A.suggestions(spark, d)
    made = pending.select("product_uuid", F.concat(F.lit("p"), F.col("id") % 50).alias("candidate_uuid"), "score")
    return V.new_suggestions(pending, made)


@query("checks alerts watch_list products", "SELECT 'checks' AS name, count(*) AS kept FROM checks WHERE product_uuid NOT IN (SELECT uuid FROM products WHERE NOT enabled) UNION ALL SELECT 'alerts', count(*) FROM alerts WHERE product_uuid NOT IN (SELECT uuid FROM products WHERE NOT enabled)")
def product_deletion(spark, d):
    """What is left of each table after products are deleted."""
    deleted = A.products(spark, d).filter("not enabled").select("uuid")
    left = [V.without(t, deleted, "product_uuid").agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("kept")) for n, t in (("checks", A.checks(spark, d)), ("alerts", A.alerts(spark, d)))]
    return left[0].unionByName(left[1])


@query("watch_list", "SELECT uuid, CASE WHEN check_interval % 3 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN check_interval % 3 = 0 THEN 'critical' ELSE priority END AS priority, url FROM watch_list")
def product_patches(spark, d):
    products = A.watch_list(spark, d)
    patches = products.filter("check_interval % 3 = 0").select("uuid", F.upper("name").alias("name"), F.lit("critical").alias("priority"), F.lit("hacked").alias("url"))
    return V.patched(products, patches, ("name", "priority", "check_interval", "enabled")).select("uuid", "name", "priority", "url")


@query("discovered", "SELECT fingerprint, left(title, 300) AS name, " + S.name_key("title") + " AS name_key FROM discovered WHERE trim(title) <> ''")
def catalog_creations(spark, d):
    rows = A.discovered(spark, d).filter("trim(title) <> ''").withColumn("name", F.substring("title", 1, 300))
    return E.with_names(rows).select("fingerprint", "name", "name_key")


@query("discovered", "SELECT fingerprint, title AS name, site, url, nullif(" + S.slug("url") + ", '') AS group_key, CASE WHEN site = 'shop1' THEN '[\"decouverte\",\"shop1\"]' ELSE '[\"decouverte\",\"shop1\",\"' || site || '\"]' END AS tags FROM discovered WHERE status = 'imported'")
def discovery_imports(spark, d):
    return V.imported(A.discovered(spark, d).filter("status = 'imported'"), X.product_slug(F.col("url")), ["decouverte", "shop1"])


@query("discovered", "SELECT product_uuid, 'discovered' AS event_type, 'Produit découvert automatiquement' AS label, site AS new_value, price FROM discovered WHERE product_uuid IS NOT NULL")
def discovery_timeline(spark, d):
    rows = A.discovered(spark, d).filter("product_uuid is not null")
    return rows.select("product_uuid", F.lit("discovered").alias("event_type"), F.lit("Produit découvert automatiquement").alias("label"), F.col("site").alias("new_value"), "price")


@query("offer_events suggestions", "SELECT o.canonical_url, o.seq, coalesce(t, o.product_uuid) AS product_uuid FROM offer_events o LEFT JOIN (SELECT product_uuid, arg_min(candidate_uuid, id) AS t FROM suggestions WHERE status = 'pending' AND id % 7 = 0 GROUP BY 1) m ON m.product_uuid = o.product_uuid")
def accepted_suggestions(spark, d):
    made = A.suggestions(spark, d)
    return V.accepted(made, made.filter("id % 7 = 0"), A.offer_events(spark, d)).select("canonical_url", "seq", "product_uuid")


@query("fetches", "SELECT id, CASE WHEN source IN ('http', 'browser') THEN source ELSE 'unknown' END AS fetch_source, coalesce(blocked_status, status_code) AS http_status, coalesce(fallback, false) OR blocked_status IS NOT NULL AS browser_fallback FROM fetches")
def fetch_diagnostics(spark, d):
    return V.fetch_diagnostics(A.fetches(spark, d))


# --- counts ------------------------------------------------------------------------------------------------


@query("checks alerts discovered catalog watch_list products", f"SELECT (SELECT count(*) FROM checks) AS checks, (SELECT count(*) FROM alerts) AS alerts, (SELECT count(*) FROM catalog) AS catalog, (SELECT count(*) FROM products) AS products, (SELECT count(*) FROM products WHERE enabled) AS enabled, (SELECT count(*) FROM alerts WHERE {_DAY.format('created_at', 'created_at', 'alerts')}) AS alerts_today, (SELECT count(*) FROM discovered WHERE {_DAY.format('first_seen_at', 'first_seen_at', 'discovered')}) AS discoveries_today, (SELECT avg(response_time_ms) FROM checks, now WHERE status = 'ok' AND checked_at >= t - INTERVAL 24 HOUR) AS avg_response_ms")
def table_counts(spark, d):
    """One row of independent one-row aggregates."""
    return _one_row(_counts(spark, d))


def _counts(spark, d):
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    alerts, found, products = A.alerts(spark, d), A.discovered(spark, d), A.products(spark, d)
    recent = A.checks(spark, d).filter((F.col("status") == "ok") & T.since("checked_at", _now(spark, d), 24))
    return [
        n(A.checks(spark, d), "checks"), n(alerts, "alerts"), n(A.catalog_products(spark, d), "catalog"),
        products.agg(F.count(F.lit(1)).alias("products"), F.count_if("enabled").alias("enabled")),
        n(_last_day(alerts, "created_at"), "alerts_today"), n(_last_day(found, "first_seen_at"), "discoveries_today"), recent.agg(F.avg("response_time_ms").alias("avg_response_ms")),
    ]


def _last_day(df, column, hours=24):
    return df.filter(T.since(column, T.latest(df, column), hours))


def _one_row(parts):
    """Side by side: every part is an aggregate without groups, so each has one row."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


@query("discovered", "SELECT site, status, count(*) AS n FROM discovered GROUP BY ALL")
def discoveries_by_status(spark, d):
    return A.discovered(spark, d).groupBy("site", "status").agg(F.count(F.lit(1)).alias("n"))


@query("watch_list", "SELECT site, count(*) AS n FROM watch_list GROUP BY site")
def products_by_site(spark, d):
    return A.watch_list(spark, d).groupBy("site").agg(F.count(F.lit(1)).alias("n"))


@query(*with_ctes("readings", _CH, "SELECT change_type, count(*) AS n FROM ch GROUP BY 1"))
def changes_by_type(spark, d):
    return _changes(spark, d).groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


@query("suggestions", "SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, round_even(sum(score) / CAST(count(score) AS DOUBLE), 1) AS avg_score FROM suggestions")
def suggestion_totals(spark, d):
    return V.suggestion_totals(A.suggestions(spark, d))


@query("suggestions", "SELECT id, product_uuid, candidate_uuid, score FROM suggestions WHERE status = 'pending' ORDER BY score DESC, id LIMIT 100")
def top_suggestions(spark, d):
    return A.suggestions(spark, d).filter("status = 'pending'").orderBy(F.desc("score"), "id").limit(100).select("id", "product_uuid", "candidate_uuid", "score")


@query("search_attempts stored_attempts", "SELECT product_uuid, site, status, next_retry_at FROM stored_attempts, now WHERE status <> 'found' AND next_retry_at <= t ORDER BY next_retry_at, product_uuid, site LIMIT 50")
def due_retries(spark, d):
    return V.due_retries(A.stored_attempts(spark, d), _now(spark, d)).select("product_uuid", "site", "status", "next_retry_at")


@query("search_attempts stored_attempts", "SELECT product_uuid, site, bool_or(status = 'found') AS already_found, count(*) FILTER (status <> 'found' AND next_retry_at IS NOT NULL) AS pending_retries FROM stored_attempts GROUP BY ALL")
def attempt_probes(spark, d):
    found = F.col("status") == "found"
    return A.stored_attempts(spark, d).groupBy("product_uuid", "site").agg(F.bool_or(found).alias("already_found"), F.count_if(~found & F.col("next_retry_at").isNotNull()).alias("pending_retries"))


@query("engine_events", "SELECT product_uuid, kind, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY product_uuid ORDER BY created_at DESC, id DESC) AS r FROM engine_events) WHERE r <= 20 GROUP BY ALL")
def recent_event_counts(spark, d):
    return V.event_counts(A.engine_events(spark, d))


@query("discoveries", "SELECT url, arg_min(page_id, (page_id, seq)) AS page_id, arg_min(site, (page_id, seq)) AS site, arg_min(title, (page_id, seq)) AS title, arg_min(seq, (page_id, seq)) AS seq FROM discoveries GROUP BY url")
def first_by_url(spark, d):
    return V.first_by(A.discoveries(spark, d), F.col("url"), "page_id", "seq")


@query("tries", "SELECT product_uuid, string_agg(site, ',' ORDER BY f) AS tags FROM (SELECT product_uuid, site, min(seq) AS f FROM tries GROUP BY ALL) GROUP BY 1")
def merged_tags(spark, d):
    rows = A.tries(spark, d).select("product_uuid", "seq", F.array("site").alias("tags"))
    return R.tags_union(rows, "product_uuid", "tags", "seq")


_AFTER = """fresh AS (SELECT fingerprint, arg_max(title, (seen_at, seq)) FILTER (title <> '') AS new_title, arg_max(image_url, (seen_at, seq)) FILTER (image_url <> '') AS image_url, arg_max(price, (seen_at, seq)) FILTER (price <> '') AS new_price, arg_min(site, (seen_at, seq)) AS new_site,
  count(*) AS again, min(seen_at) AS first_at, max(seen_at) AS last_at FROM resightings GROUP BY 1),
after AS (SELECT coalesce(k.fingerprint, f.fingerprint) AS fingerprint, coalesce(k.site, f.new_site) AS site, coalesce(f.new_title, k.title) AS title, f.image_url, coalesce(f.new_price, k.price) AS price,
  CASE WHEN k.fingerprint IS NULL OR (k.status = 'gone' AND f.again IS NOT NULL) THEN 'pending' ELSE k.status END AS status, CASE WHEN k.status = 'gone' AND f.again IS NOT NULL THEN 'réapparue sur le site' END AS decision_reason,
  CASE WHEN k.fingerprint IS NULL THEN 0 ELSE 1 END + coalesce(f.again, 0) AS times_seen, coalesce(k.first_seen_at, f.first_at) AS first_seen_at, greatest(k.first_seen_at, f.last_at) AS last_seen_at
  FROM (SELECT fingerprint, site, title, price, status, first_seen_at FROM discovered) k FULL JOIN fresh f ON f.fingerprint = k.fingerprint)"""


def _after(spark, d):
    known = A.discovered(spark, d).select("fingerprint", "site", "title", "price", "status", "first_seen_at")
    return C.sighting_upsert(known, A.resightings(spark, d))


@query(*with_ctes("discovered resightings", _AFTER, "SELECT * FROM after"))
def discovery_upsert(spark, d):
    return _after(spark, d)


@query(*with_ctes("discovered resightings", _AFTER, "SELECT site, sum(times_seen) AS products_seen, count(decision_reason) AS back, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("imported", "pending", "ignored", "blocked", "gone")) + " FROM after GROUP BY site"))
def discovery_scan_reports(spark, d):
    return C.scan_reports(_after(spark, d))


@query("tries", "SELECT *, CASE WHEN status IN ('not_found', 'error') THEN last_attempt_at + to_seconds(CAST(floor(least(1800 * pow(1.5, greatest(attempts - 1, 0)), 21600)) AS BIGINT)) END AS next_retry_at FROM (SELECT product_uuid, site, key_kind, key_value, CAST(count(*) AS INTEGER) AS attempts, arg_max(status, (tried_at, seq)) AS status, arg_max(confidence, (tried_at, seq)) AS confidence, arg_max(found_url, (tried_at, seq)) FILTER (found_url <> '') AS found_url, max(tried_at) AS last_attempt_at FROM tries GROUP BY ALL)")
def attempts_to_retry(spark, d):
    return C.with_next_retry(C.attempts_upsert(A.tries(spark, d)))


# --- stories and bundles -----------------------------------------------------------------------------------


@query(*with_ctes("offer_events", S.RUNS, "SELECT product_uuid, count(*) AS merchants, arg_min(site, (first_seen_at, site, canonical_url)) AS first_merchant, min(first_seen_at) AS first_seen_at, arg_max(site, (first_seen_at, site, canonical_url)) AS last_merchant, max(first_seen_at) AS last_merchant_at FROM state GROUP BY 1"))
def product_merchants(spark, d):
    return V.merchants(_offers(spark, d))


def _monitored(rows):
    """Rows of watched products under the names that offers monitor them by."""
    return rows.withColumn("monitored_uuid", F.concat(F.lit("m"), F.substring("product_uuid", 2, 20))).drop("product_uuid")


_MON = S.RUNS + f""",
{_CH},
mon AS (SELECT monitored_uuid, product_uuid, min(site) AS site FROM state WHERE monitored_uuid IS NOT NULL GROUP BY ALL),
mch AS (SELECT 'm' || substr(product_uuid, 2) AS monitored_uuid, * EXCLUDE (product_uuid) FROM lab)"""
_TOLD = "concat_ws(' · ', coalesce(old_value, '—') || ' → ' || coalesce(new_value, '—'), CASE WHEN change_type LIKE 'price%' THEN new_value END)"


@query(*with_ctes("offer_events readings catalog_events", _MON, f"""SELECT product_uuid, first_seen_at AS "at", site, 'Nouvelle fiche' AS label, canonical_url AS detail, 'discovery' AS origin FROM state
  UNION ALL SELECT m.product_uuid, c.checked_at, m.site, c.label, {_TOLD}, 'monitoring' FROM mch c JOIN mon m USING (monitored_uuid)
  UNION ALL SELECT m.product_uuid, e.created_at, m.site, CASE kind {' '.join("WHEN '{}' THEN '{}'".format(k, V.EVENT_LABELS[k].replace("'", "''")) for k in Y.STORY_KINDS)} END, e.detail, 'intelligence' FROM catalog_events e JOIN mon m ON m.monitored_uuid = 'm' || substr(e.product_uuid, 2) WHERE kind IN {_listed(Y.STORY_KINDS)}"""))
def product_stories(spark, d):
    return Y.stories(_offers(spark, d), _monitored(_changes(spark, d)), _monitored(A.catalog_events(spark, d)))


@query(*with_ctes("offer_events readings alerts stored_attempts", _MON, """SELECT s.*, coalesce(c.changes, 0) AS changes, coalesce(c.price_changes, 0) AS price_changes, coalesce(c.back_in_stock, 0) AS back_in_stock, coalesce(c.out_of_stock, 0) AS out_of_stock,
    coalesce(c.preorders, 0) AS preorders, coalesce(c.invitations, 0) AS invitations, coalesce(a.notifications, 0) AS notifications, coalesce(a.screenshots, 0) AS screenshots, coalesce(t.searches, 0) AS searches, coalesce(t.searches_found, 0) AS searches_found, t.next_retry_at
  FROM (SELECT product_uuid, count(*) AS merchants, arg_min(site, (first_seen_at, site, canonical_url)) AS first_merchant, min(first_seen_at) AS first_seen_at, arg_max(site, (first_seen_at, site, canonical_url)) AS last_merchant, max(first_seen_at) AS last_merchant_at FROM state GROUP BY 1) s
  LEFT JOIN (SELECT m.product_uuid, count(*) AS changes, count(*) FILTER (change_type = 'price_changed') AS price_changes, count(*) FILTER (change_type = 'back_in_stock') AS back_in_stock, count(*) FILTER (change_type = 'went_out_of_stock') AS out_of_stock,
    count(*) FILTER (change_type = 'preorder_opened') AS preorders, count(*) FILTER (change_type = 'invitation_opened') AS invitations FROM mch JOIN mon m USING (monitored_uuid) GROUP BY 1) c USING (product_uuid)
  LEFT JOIN (SELECT m.product_uuid, count(*) AS notifications, count(screenshot_path) AS screenshots FROM alerts a JOIN mon m ON m.monitored_uuid = 'm' || substr(a.product_uuid, 2) GROUP BY 1) a USING (product_uuid)
  LEFT JOIN (SELECT product_uuid, count(*) AS searches, count(*) FILTER (status = 'found') AS searches_found, min(next_retry_at) AS next_retry_at FROM stored_attempts GROUP BY 1) t USING (product_uuid)"""))
def product_metrics(spark, d):
    return Y.metrics(_offers(spark, d), _monitored(_changes(spark, d)), _monitored(A.alerts(spark, d)), A.stored_attempts(spark, d))


@query(*with_ctes("readings", _CH, "SELECT product_uuid, count(*) AS changes, count(*) FILTER (change_type = 'price_changed') AS price_changes, count(*) FILTER (change_type = 'back_in_stock') AS back_in_stock, count(*) FILTER (change_type = 'went_out_of_stock') AS out_of_stock, count(*) FILTER (change_type = 'preorder_opened') AS preorders, count(*) FILTER (change_type = 'invitation_opened') AS invitations FROM ch GROUP BY 1"))
def product_counters(spark, d):
    return V.change_counters(_changes(spark, d))


@query(*with_ctes("engine_events offer_events", S.RUNS, "SELECT id, coalesce(s, source, '—') AS site, kind FROM (SELECT id, source, kind, 'm' || substr(product_uuid, 2) AS m FROM engine_events) LEFT JOIN (SELECT monitored_uuid, min(site) AS s FROM state WHERE monitored_uuid IS NOT NULL GROUP BY 1) ON m = monitored_uuid"))
def story_event_sites(spark, d):
    events = A.engine_events(spark, d).withColumn("product_uuid", F.concat(F.lit("m"), F.substring("product_uuid", 2, 20)))
    return V.story_sites(events, _offers(spark, d)).select("id", "site", "kind")


@query(*with_ctes("products checks", f"{S.STATS}, t1 AS (SELECT 1)", "SELECT CAST(sum(checks) AS BIGINT) AS checks, CAST(sum(errors) AS BIGINT) AS errors, round_even(sum(checks * avg_response_ms) FILTER (avg_response_ms IS NOT NULL) / sum(checks) FILTER (avg_response_ms IS NOT NULL), 1) AS avg_response_ms FROM stats"))
def health_overview(spark, d):
    sites = T.health_by_site(A.checks(spark, d), A.products(spark, d), _now(spark, d), 168)
    return sites.agg(F.sum("checks").alias("checks"), F.sum("errors").alias("errors"), V.weighted_mean(sites).alias("avg_response_ms"))


@query("discovered search_attempts stored_attempts", f"SELECT (SELECT count(*) FROM discovered WHERE {_DAY.format('first_seen_at', 'first_seen_at', 'discovered')}) AS found_today, imported, pending, ignored, blocked, last_discovery_at, searches_total, searches_found, searches_empty, searches_retrying FROM (SELECT count(*) FILTER (status = 'imported') AS imported, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'ignored') AS ignored, count(*) FILTER (status = 'blocked') AS blocked, max(first_seen_at) AS last_discovery_at FROM discovered), (SELECT count(*) AS searches_total, count(*) FILTER (status = 'found') AS searches_found, count(*) FILTER (status IN ('not_found', 'pending')) AS searches_empty, count(*) FILTER (status <> 'found' AND next_retry_at IS NOT NULL) AS searches_retrying FROM stored_attempts)")
def discovery_stats(spark, d):
    found, tries = A.discovered(spark, d), A.stored_attempts(spark, d)
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    return _one_row([
        _last_day(found, "first_seen_at").agg(F.count(F.lit(1)).alias("found_today")),
        found.agg(*[of(s).alias(s) for s in ("imported", "pending", "ignored", "blocked")], F.max("first_seen_at").alias("last_discovery_at")),
        tries.agg(F.count(F.lit(1)).alias("searches_total"), of("found").alias("searches_found"), of("not_found", "pending").alias("searches_empty"), F.count_if((F.col("status") != "found") & F.col("next_retry_at").isNotNull()).alias("searches_retrying")),
    ])


@query(*with_ctes("catalog suggestions offer_events", "n AS (SELECT count(DISTINCT canonical_url) AS offers FROM offer_events)", "SELECT total AS canonical_products, offers, merged_automatically, pending_validation, rejected, avg_confidence, ean, upc, isbn, mpn, asin, model_number FROM n, (SELECT count(*) FILTER (status = 'accepted') AS merged_automatically, count(*) FILTER (status = 'pending') AS pending_validation, count(*) FILTER (status = 'rejected') AS rejected, round_even(avg(score), 1) AS avg_confidence FROM suggestions), (SELECT count(*) AS total, count(ean) AS ean, count(upc) AS upc, count(isbn) AS isbn, count(mpn) AS mpn, count(asin) AS asin, count(model_number) AS model_number FROM catalog)"))
def intelligence_stats(spark, d):
    totals = V.suggestion_totals(A.suggestions(spark, d)).withColumnsRenamed({"accepted": "merged_automatically", "pending": "pending_validation", "avg_score": "avg_confidence"})
    offers = A.offer_events(spark, d).select("canonical_url").distinct().agg(F.count(F.lit(1)).alias("offers"))
    return _one_row([C.identifier_coverage(A.catalog_products(spark, d)).withColumnRenamed("total", "canonical_products"), totals, offers])


@query("engine_events checks", "SELECT * FROM (SELECT avg(response_time_ms) FILTER (fetch_source = 'http') AS http_ms, avg(response_time_ms) FILTER (fetch_source = 'browser') AS browser_ms FROM checks, now WHERE checked_at >= t - INTERVAL 24 HOUR AND status = 'ok'), (SELECT avg(duration_ms) FILTER (kind = 'browser_fallback') AS fallback_ms, avg(duration_ms) FILTER (kind = 'page_missing') AS missing_ms FROM engine_events, now WHERE created_at >= t - INTERVAL 24 HOUR)")
def phase_timings(spark, d):
    now = _now(spark, d)
    recent = A.engine_events(spark, d).filter(T.since("created_at", now, 24))
    of = lambda k: F.avg(F.when(F.col("kind") == k, F.col("duration_ms")))
    return _one_row([T.avg_by_fetch_source(A.checks(spark, d), now, 24), recent.agg(of("browser_fallback").alias("fallback_ms"), of("page_missing").alias("missing_ms"))])


@query("checks alerts discovered", "SELECT 'checks' AS series, strftime(checked_at, '%Y-%m-%dT%H:00') AS bucket, CAST(count(*) AS DOUBLE) AS value FROM checks, now WHERE checked_at >= t - INTERVAL 48 HOUR GROUP BY ALL UNION ALL SELECT 'confidence', strftime(checked_at, '%Y-%m-%dT%H:00'), round_even(avg(confidence), 1) FROM checks, now WHERE checked_at >= t - INTERVAL 48 HOUR AND confidence IS NOT NULL GROUP BY ALL UNION ALL SELECT 'alerts', strftime(created_at, '%Y-%m-%d'), CAST(count(*) AS DOUBLE) FROM alerts GROUP BY ALL UNION ALL SELECT 'discoveries', strftime(first_seen_at, '%Y-%m-%d'), CAST(count(*) AS DOUBLE) FROM discovered GROUP BY ALL")
def charts(spark, d):
    """The series of the dashboard, one under another."""
    now, checks = _now(spark, d), A.checks(spark, d)
    day = lambda df, c, name: df.groupBy(F.date_format(c, "yyyy-MM-dd").alias("bucket")).agg(F.count(F.lit(1)).alias("value")).withColumn("series", F.lit(name))
    parts = [
        T.per_hour(checks, now, 48).select("bucket", F.col("total").alias("value")).withColumn("series", F.lit("checks")),
        T.confidence_per_hour(checks, now).select("bucket", F.col("avg_confidence").alias("value")).withColumn("series", F.lit("confidence")),
        day(A.alerts(spark, d), "created_at", "alerts"), day(A.discovered(spark, d), "first_seen_at", "discoveries"),
    ]
    parts = [p.select("series", "bucket", F.col("value").cast("double").alias("value")) for p in parts]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(*with_ctes("identities offer_events", S.RUNS, "SELECT i.uuid, s.site, 'ean' AS kind, ean AS value, 1 AS rank FROM identities i, (SELECT DISTINCT site FROM state ORDER BY site LIMIT 8) s WHERE ean IS NOT NULL AND NOT EXISTS (SELECT 1 FROM state WHERE product_uuid = i.uuid AND state.site = s.site)"))
def search_plan(spark, d):
    """The surest key of each product with an EAN at every merchant that has no offer of it."""
    offers = _offers(spark, d)
    keys = E.search_keys(A.identities(spark, d)).filter("kind = 'ean' and rank = 1")
    return V.search_plan(keys, offers.select("site").distinct(), offers.select("product_uuid", "site"))


@query("drafts", "SELECT draft_id, field, value, confidence FROM (" + " UNION ALL ".join(f"SELECT draft_id, '{f}' AS field, trim({c}) AS value, {V.FIELD_CONFIDENCE[f]} AS confidence FROM drafts" for f, c in (("ean", "ean"), ("upc", "upc"), ("mpn", "mpn"), ("brand", "brand"), ("collection", "collection"), ("canonical_name", "name"))) + ") WHERE value <> ''")
def draft_identity(spark, d):
    return V.field_facts(A.drafts(spark, d), {"ean": "ean", "upc": "upc", "mpn": "mpn", "brand": "brand", "collection": "collection", "canonical_name": "name"})


@query("tries", "SELECT product_uuid, seq, priority, CASE WHEN priority >= 90 THEN priority ELSE CAST(floor(priority * near) AS INTEGER) END AS confidence FROM (SELECT product_uuid, seq, CASE WHEN key_kind = 'ean' THEN 100 ELSE 70 END AS priority, confidence / 100e0 AS near FROM tries) WHERE priority >= 90 OR CAST(floor(priority * near) AS INTEGER) >= 45")
def candidate_confidences(spark, d):
    rows = A.tries(spark, d).select("product_uuid", "seq", F.when(F.col("key_kind") == "ean", 100).otherwise(70).alias("priority"), (F.col("confidence") / 100).alias("near"))
    return V.candidate_confidence(rows, F.col("near")).select("product_uuid", "seq", "priority", "confidence")


@query("tries", "SELECT product_uuid, arg_max(site, (confidence, -seq)) AS site, max(confidence) AS confidence FROM tries GROUP BY 1")
def best_candidates(spark, d):
    """The most confident candidate of each product, the first on ties."""
    return A.tries(spark, d).groupBy("product_uuid").agg(F.max_by("site", F.struct("confidence", -F.col("seq"))).alias("site"), F.max("confidence").alias("confidence"))


@query("identities", "SELECT uuid, coalesce(nullif(CASE WHEN uuid LIKE '%7' THEN '' ELSE ean END, ''), nullif(upc, ''), nullif(mpn, ''), canonical_name) AS best_term FROM identities")
def best_terms(spark, d):
    known = A.identities(spark, d).withColumn("ean", F.when(F.col("uuid").endswith("7"), "").otherwise(F.col("ean")))  # known to have none
    return known.select("uuid", V.best_term().alias("best_term"))


_FLAT = ("ean", "upc", "isbn", "mpn", "sku", "asin", "model_number", "brand")


@query("identities", " UNION ALL ".join(f"SELECT uuid, '{f}' AS field, {f} AS value FROM identities WHERE {f} <> ''" for f in _FLAT))
def flat_identity(spark, d):
    """Known keys of each product through a map, as it is stored in JSON and read back; blanks are dropped."""
    pairs = F.map_filter(F.create_map(*[x for f in _FLAT for x in (F.lit(f), F.col(f))]), lambda _, v: v != "")
    stored = A.identities(spark, d).select("uuid", F.to_json(pairs).alias("identity"))
    return stored.select("uuid", F.explode(F.from_json("identity", "map<string,string>")).alias("field", "value"))


_KNOWN = "(SELECT fingerprint FROM first_pages WHERE page_id % 3 = 0)"


@query("first_pages", f"SELECT site, count(*) AS seen, count(*) FILTER (fingerprint NOT IN {_KNOWN}) AS new, least(2, count(*) FILTER (fingerprint NOT IN {_KNOWN})) AS taken, count(*) FILTER (fingerprint NOT IN {_KNOWN}) <= 2 AS complete FROM first_pages GROUP BY site")
def scan_cycle(spark, d):
    pages = A.first_pages(spark, d)
    return V.scan_cycle(pages, pages.filter("page_id % 3 = 0"), most_new=2)


@query("discovered", "SELECT fingerprint, array_to_string(list_filter(['🆕 <b>NOUVEAU PRODUIT DÉTECTÉ</b>', '', '<b>Site :</b> ' || site, '<b>Produit :</b> ' || title, CASE WHEN price IS NOT NULL THEN '<b>Prix :</b> ' || price END, '<b>URL :</b> ' || url, '', CASE WHEN product_uuid IS NOT NULL THEN '✅ Surveillance démarrée automatiquement' ELSE '⏳ En attente de validation dans le dashboard' END], lambda x: x IS NOT NULL), chr(10)) AS message FROM discovered")
def discovery_messages(spark, d):
    """Messages about discoveries, without the hour at which they are sent; markup in values is escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    line = lambda name, c: F.concat(F.lit(f"<b>{name} :</b> "), safe(c))
    end = F.when(F.col("product_uuid").isNotNull(), "✅ Surveillance démarrée automatiquement").otherwise("⏳ En attente de validation dans le dashboard")
    lines = [F.lit("🆕 <b>NOUVEAU PRODUIT DÉTECTÉ</b>"), F.lit(""), line("Site", "site"), line("Produit", "title"), line("Prix", "price"), line("URL", "url"), F.lit(""), end]
    return A.discovered(spark, d).select("fingerprint", F.concat_ws("\n", *lines).alias("message"))
