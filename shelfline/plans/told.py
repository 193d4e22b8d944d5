"""Queries of what clients and channels are told: anomalies in words, newest chains, messages of every kind, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.operators import changes as G
from shelfline.operators import ingest as I
from shelfline.operators import messages as W
from shelfline.operators import telemetry as T
from shelfline.plans import ingest as P
from shelfline.plans import sql as S
from shelfline.plans.register import query, with_ctes
from shelfline.sources import adapters as A


def _now(spark, d):
    return T.latest(A.table(spark, d, "events"), "ts")


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _said(template: str, *values: str) -> str:
    parts = template.split("{}")
    return " || ".join(x for part, value in zip(parts, [*values, ""]) for x in (_lit(part), value) if x and x != "''") or "''"


_NAME = "upper(site[1]) || lower(substr(site, 2))"


def _whole(value: str) -> str:
    return f"CAST(CAST(round_even({value}, 0) AS BIGINT) AS VARCHAR)"


def _reports() -> str:
    rows = []
    for at, (key, (title, why)) in enumerate(W.DRIFTS.items()):
        rate, base = f"(recent_{key} / CAST(recent_checks AS DOUBLE))", f"(baseline_{key} / CAST(baseline_checks AS DOUBLE))"
        beside = f"CASE WHEN baseline_checks >= 20 THEN {_said('contre {}% la semaine précédente', _whole(base + ' * 100'))} ELSE 'aucune référence disponible sur la semaine précédente' END"
        told = _said("{}% des vérifications sur 24 h, {}. " + why, _whole(rate + " * 100"), beside)
        rows.append(f"SELECT site, {at} AS at_kind, '{key}' AS kind, {_said(title, _NAME)} AS title, {told} AS detail FROM win WHERE recent_checks >= 20 AND {rate} >= 0.1 AND CASE WHEN baseline_checks >= 20 THEN {rate} >= {base} * 2 ELSE {rate} >= 0.1 * 3 END")
    seconds = "CAST(round_even({} / 1000, 1) AS VARCHAR)"
    rows.append(f"SELECT site, 3, 'slowdown', {_said(W.SLOWER, _NAME)}, {_said('{} s en moyenne contre {} s la semaine précédente.', seconds.format('recent_ms'), seconds.format('baseline_ms'))} FROM win WHERE recent_checks >= 20 AND baseline_checks >= 20 AND recent_ms > 0 AND baseline_ms > 0 AND recent_ms > baseline_ms * 1.5")
    rows.append(f"SELECT site, 4, 'confidence', {_said(W.LESS_SURE, _NAME)}, {_said(W.LESS_SURE_DETAIL, _whole('recent_confidence'), _whole('baseline_confidence'))} FROM win WHERE baseline_confidence - recent_confidence >= 8")
    return " UNION ALL ".join(rows)


@query(*with_ctes("products checks", f"{S.WINDOWS},\nrep AS ({_reports()})", "SELECT CAST(row_number() OVER (ORDER BY site, at_kind) AS INTEGER) AS position, 'warning' AS severity, site AS source, kind, title, detail FROM rep"))
def anomaly_reports(spark, d):
    return W.anomaly_reports(T.windows(A.checks(spark, d), A.products(spark, d), _now(spark, d)))


@query("engine_events", """SELECT coalesce(product_uuid, source) AS subject, CAST(floor(epoch(created_at) / 30) AS BIGINT) AS cycle, min(created_at) AS started_at, count(*) AS steps, arg_min(source, id) AS source,
  CASE WHEN bool_or(kind IN ('unknown_state', 'blocked', 'locale_mismatch')) THEN 'non résolu' WHEN bool_or(kind IN ('browser_fallback', 'browser_render')) THEN 'rattrapé par le navigateur' WHEN bool_or(kind = 'network_error') THEN 'échec réseau' ELSE 'isolé' END AS outcome
  FROM engine_events, now WHERE created_at >= t - INTERVAL 24 HOUR AND severity <> 'info' GROUP BY 1, 2 ORDER BY started_at DESC, subject LIMIT 50""")
def latest_incidents(spark, d):
    return W.latest_chains(T.incident_chains(A.engine_events(spark, d), _now(spark, d), 24))


def _json(**fields: str) -> str:
    return "CAST(json_object(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ") AS VARCHAR)"


_SAME = {"product": "product_uuid", "label": "label", "old_value": "old_value", "new_value": "new_value"}
_LAB = S.CHANGES + f",\nlab AS (SELECT *, {S.LABEL} AS label FROM ch)"
_LABELLED = f"labelled AS (SELECT * REPLACE (CASE change_type {' '.join(f'WHEN {_lit(k)} THEN {_lit(v)}' for k, v in G.LABELS.items())} ELSE change_type END AS label) FROM lab)"
_MESSAGES = " UNION ALL ".join([
    f"SELECT 'check' AS type, CAST(id AS VARCHAR) AS key, CASE WHEN status = 'ok' THEN {_json(product='product_uuid', status=_lit('ok'), availability='availability', response_time_ms='response_time_ms')} ELSE {_json(product='product_uuid', status=_lit('error'))} END AS payload FROM checks",
    f"SELECT 'timeline', CAST(id AS VARCHAR), {_json(product='product_uuid', event_type=_lit('baseline'), label=_lit(W.BASELINE), new_value='availability', price='price')} FROM conc WHERE o_id IS NULL",
    f"SELECT 'timeline', id || '/' || change_type, {_json(event_type='change_type', **_SAME)} FROM labelled",
    f"SELECT 'alert', id || '/' || change_type, {_json(change_type='change_type', **_SAME)} FROM labelled",
    f"SELECT 'discovery', fingerprint, {_json(**{c: c for c in ('fingerprint', 'site', 'title', 'url', 'price', 'status')}, imported='status = ' + _lit('imported'), product_uuid='product_uuid')} FROM discovered",
    f"SELECT 'alert_status', CAST(id AS VARCHAR), {_json(alert_id='id', delivered='notified')} FROM alerts",
    f"SELECT 'screenshot', CAST(id AS VARCHAR), {_json(product='product_uuid', alert_id='id', path='screenshot_path', success='screenshot_path IS NOT NULL')} FROM alerts",
])


@query(*with_ctes("readings checks discovered alerts", f"{_LAB},\n{_LABELLED}", _MESSAGES))
def client_message_feed(spark, d):
    """Every message that clients are sent of checks, changes, discoveries and alerts."""
    readings, alerts = A.readings(spark, d), A.alerts(spark, d)
    first = G.paired(readings).filter("old is null").select("product_uuid", "new.id", "new.availability", "new.price")
    feed = W.check_messages(A.checks(spark, d))
    for more in (W.baseline_messages(first), W.change_messages(G.change_events(readings)), W.discovery_messages(A.discovered(spark, d)), W.alert_messages(alerts)):
        feed = feed.unionByName(more)
    return feed


@query(*with_ctes("listed_products arrivals", f"{P._WALK},\n{P._NAMED}", f"SELECT 'catalog' AS type, draft_id || '/' || kind AS key, {_json(kind='kind', product_uuid='product', summary='coalesce(detail, ' + _lit('') + ')')} AS payload FROM (SELECT draft_id, 'catalog_product_created' AS kind, product, NULL AS detail FROM outcomes WHERE created UNION ALL SELECT draft_id, 'catalog_match_pending', product, candidate FROM outcomes WHERE decision = 'suggest' UNION ALL SELECT draft_id, 'catalog_offer_linked', product, summary FROM outcomes)"))
def catalog_message_feed(spark, d):
    return W.catalog_messages(I.events_of(I.ingested(A.arrivals(spark, d), A.listed_products(spark, d))))


def _safe(x: str) -> str:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{sign}', '{entity}')"
    return x


def _short(x: str) -> str:
    return f"CASE WHEN coalesce({x}, '') = '' THEN '—' WHEN length(trim(regexp_replace({x}, '\\s+', ' ', 'g'))) <= 140 THEN trim(regexp_replace({x}, '\\s+', ' ', 'g')) ELSE substr(trim(regexp_replace({x}, '\\s+', ' ', 'g')), 1, 139) || '…' END"


_ALERT = "CASE change_type WHEN 'seller_became_official' THEN '🏷️ ' || m || ' devient vendeur' WHEN 'seller_left_buybox' THEN '🏷️ ' || m || ' quitte la Buy Box' " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in W.ALERT_LABELS.items()) + " ELSE change_type END"
_ACTS = "CASE action " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in W.ACTION_LABELS.items()) + " END"


@query(*with_ctes("readings products", S.CHANGES, f"""SELECT product_uuid, id, change_type, concat_ws(chr(10), '🚨 <b>ALERTE DROP</b>', '', '<b>Produit :</b> ' || {_safe('product_uuid')}, '<b>Site :</b> ' || {_safe('m')}, '<b>Événement :</b> ' || {_safe(_ALERT)},
  CASE WHEN coalesce(old_value, '') <> '' OR coalesce(new_value, '') <> '' THEN '<b>Changement :</b> ' || {_safe(_short('old_value'))} || ' → ' || {_safe(_short('new_value'))} END, CASE WHEN action <> 'none' THEN '<b>Action possible :</b> ' || {_safe(_ACTS)} END,
  CASE WHEN action <> 'none' AND seller_name <> '' THEN '<b>Vendeur :</b> ' || {_safe('seller_name')} END, CASE WHEN now_price <> '' THEN '<b>Prix :</b> ' || {_safe('now_price')} END) AS text
  FROM (SELECT c.product_uuid, c.id, c.change_type, c.old_value, c.new_value, r.action, r.seller_name, r.price AS now_price, {_NAME} AS m FROM ch c JOIN readings r ON r.id = c.id LEFT JOIN products p ON p.uuid = c.product_uuid)"""))
def alert_texts(spark, d):
    readings = A.readings(spark, d)
    return W.alert_texts(G.change_events(readings), readings, A.products(spark, d))
