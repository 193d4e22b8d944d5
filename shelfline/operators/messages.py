"""What the monitor tells its clients and channels: messages of every kind, anomalies in words, stories, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.operators.telemetry import CONFIDENCE_DROP, DRIFT_FACTOR, DRIFT_FLOOR, MIN_SAMPLE, SLOWDOWN_FACTOR

#: Titles and details of anomalies; {} is the site's name.
DRIFTS = {
    "browser_checks": ("{} utilise le navigateur beaucoup plus souvent que d'habitude", "Le rendu Chromium n'est déclenché que si la requête HTTP échoue ou n'aboutit à rien : cette hausse annonce généralement un blocage."),
    "unknown_states": ("{} génère beaucoup d'états indéterminés", "Le plugin ne reconnaît plus l'action d'achat : le vocabulaire ou la structure de la page a probablement changé."),
    "http_403": ("{} renvoie de nombreux 403", "Le site refuse de servir la page à cette adresse IP. Un hébergeur est souvent en cause ; surveiller depuis une connexion domestique règle généralement le problème."),
}
SLOWER, LESS_SURE = "{} est plus lent depuis 24 heures", "La confiance moyenne du plugin {} diminue"
LESS_SURE_DETAIL = "{} % sur 24 h contre {} % la semaine précédente. Une confiance qui baisse précède les états indéterminés : la structure de la page a probablement changé."
#: How an alert names what happened, and what can be done.
ALERT_LABELS = {
    "product_appeared": "🆕 Fiche produit en ligne", "product_delisted": "⚪ Fiche retirée de la vente", "price_appeared": "💶 Prix affiché", "price_changed": "💶 Prix modifié",
    "preorder_opened": "🟢 PRÉCOMMANDE OUVERTE", "invitation_opened": "🎟️ INVITATION OUVERTE", "back_in_stock": "🟢 RETOUR EN STOCK", "went_out_of_stock": "🔴 Rupture de stock",
    "seller_became_official": "🏷️ Vendeur officiel de retour", "seller_left_buybox": "🏷️ Vendeur officiel absent de la Buy Box", "status_changed": "🔄 Disponibilité modifiée",
}
ACTION_LABELS = {
    "add_to_cart": "Ajouter au panier", "buy_now": "Acheter maintenant", "preorder": "Précommander", "request_invite": "Demander une invitation", "notify_me": "Prévenez-moi",
    "coming_soon": "Bientôt disponible", "temporarily_unavailable": "Temporairement indisponible", "currently_unavailable": "Actuellement indisponible",
    "discontinued": "Plus disponible", "third_party_only": "Revendeur tiers uniquement",
}
BASELINE = "Surveillance démarrée — état initial enregistré"
LONGEST_VALUE = 140
MOST_CHAINS = 50


def _named(of: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in of.items() for x in pair])[key]


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1000)))


def _rounded(value: Column, places: int = 0) -> Column:
    """A number as text, half to even; whole numbers without a point."""
    r = F.bround(value.cast("double"), places)
    return r.cast("long").cast("string") if not places else r.cast("string")


def _filled(template: str, *values: Column) -> Column:
    parts = template.split("{}")
    return F.concat(*[x for part, value in zip(parts, [*values, None]) for x in (F.lit(part), value) if x is not None])


def anomaly_reports(compared: DataFrame) -> DataFrame:
    """(position, severity, source, kind, title, detail) of drifts, by site and in the order they are looked for.

    `compared` is what `telemetry.windows` gives.  A rate drifts if it reaches the floor and twice its own baseline, or
    three floors where there is no baseline to go by.
    """
    name, n, base_n = _capital(F.col("site")), F.col("recent_checks"), F.col("baseline_checks")
    known = base_n >= MIN_SAMPLE
    kinds = []
    for at, (key, (title, why)) in enumerate(DRIFTS.items()):
        rate, base = F.col(f"recent_{key}") / n, F.col(f"baseline_{key}") / base_n
        drifted = (n >= MIN_SAMPLE) & (rate >= DRIFT_FLOOR) & F.when(known, rate >= base * DRIFT_FACTOR).otherwise(rate >= DRIFT_FLOOR * 3)
        beside = F.when(known, _filled("contre {}% la semaine précédente", _rounded(base * 100))).otherwise("aucune référence disponible sur la semaine précédente")
        told = _filled("{}% des vérifications sur 24 h, {}. " + why, _rounded(rate * 100), beside)
        kinds.append(F.when(drifted, _report(at, key, _filled(title, name), told)))
    slow = (n >= MIN_SAMPLE) & known & (F.col("recent_ms") > 0) & (F.col("baseline_ms") > 0) & (F.col("recent_ms") > F.col("baseline_ms") * SLOWDOWN_FACTOR)
    told = _filled("{} s en moyenne contre {} s la semaine précédente.", _rounded(F.col("recent_ms") / 1000, 1), _rounded(F.col("baseline_ms") / 1000, 1))
    kinds.append(F.when(slow, _report(3, "slowdown", _filled(SLOWER, name), told)))
    dropped = F.col("baseline_confidence") - F.col("recent_confidence") >= CONFIDENCE_DROP
    told = _filled(LESS_SURE_DETAIL, _rounded(F.col("recent_confidence")), _rounded(F.col("baseline_confidence")))
    kinds.append(F.when(dropped, _report(4, "confidence", _filled(LESS_SURE, name), told)))
    found = compared.select("site", F.explode(F.filter(F.array(*kinds), lambda k: k.isNotNull())).alias("k"))
    place = F.row_number().over(Window.orderBy("site", "k.at"))  # five rows a site at most
    return found.select(place.alias("position"), F.lit("warning").alias("severity"), F.col("site").alias("source"), "k.kind", "k.title", "k.detail")


def _report(at: int, kind: str, title: Column, detail: Column) -> Column:
    return F.struct(F.lit(at).alias("at"), F.lit(kind).alias("kind"), title.alias("title"), detail.alias("detail"))


def latest_chains(chains: DataFrame, most: int = MOST_CHAINS) -> DataFrame:
    """The newest of `chains` (telemetry.incident_chains), newest first: a list for a page, so `most` is its length."""
    return chains.orderBy(F.desc("started_at"), "subject").limit(most)


# --- messages to clients -------------------------------------------------------------------------------------------


def _payload(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": "false"})


def _product(uuid: Column) -> dict[str, Column]:
    return {"product": uuid}


def _body(kind: str, key: Column, payload: Column) -> list[Column]:
    return [F.lit(kind).alias("type"), key.cast("string").alias("key"), payload.alias("payload")]


def check_messages(checks: DataFrame) -> DataFrame:
    ok = _payload(product=F.col("product_uuid"), status=F.lit("ok"), availability=F.col("availability"), response_time_ms=F.col("response_time_ms"))
    failed = _payload(product=F.col("product_uuid"), status=F.lit("error"))
    return checks.select(*_body("check", F.col("id"), F.when(F.col("status") == "ok", ok).otherwise(failed)))


def baseline_messages(baselines: DataFrame) -> DataFrame:
    payload = _payload(product=F.col("product_uuid"), event_type=F.lit("baseline"), label=F.lit(BASELINE), new_value=F.col("availability"), price=F.col("price"))
    return baselines.select(*_body("timeline", F.col("id"), payload))


def change_messages(changes: DataFrame) -> DataFrame:
    """Two messages for each change: an entry of the timeline, and an alert."""
    same = {"product": F.col("product_uuid"), "label": F.col("label"), "old_value": F.col("old_value"), "new_value": F.col("new_value")}
    key = F.concat_ws("/", F.col("id").cast("string"), "change_type")
    entries = changes.select(*_body("timeline", key, _payload(event_type=F.col("change_type"), **same)))
    return entries.unionByName(changes.select(*_body("alert", key, _payload(change_type=F.col("change_type"), **same))))


def discovery_messages(found: DataFrame) -> DataFrame:
    payload = _payload(**{c: F.col(c) for c in ("fingerprint", "site", "title", "url", "price", "status")}, imported=F.col("status") == "imported", product_uuid=F.col("product_uuid"))
    return found.select(*_body("discovery", F.col("fingerprint"), payload))


def alert_messages(alerts: DataFrame) -> DataFrame:
    """Whether alerts were delivered, and the pictures that were taken for them."""
    told = alerts.select(*_body("alert_status", F.col("id"), _payload(alert_id=F.col("id"), delivered=F.col("notified"))))
    shot = _payload(product=F.col("product_uuid"), alert_id=F.col("id"), path=F.col("screenshot_path"), success=F.col("screenshot_path").isNotNull())
    return told.unionByName(alerts.select(*_body("screenshot", F.col("id"), shot)))


def catalog_messages(events: DataFrame) -> DataFrame:
    """What an ingest publishes (`ingest.events_of`), one message each."""
    payload = _payload(kind=F.col("kind"), product_uuid=F.col("product"), summary=F.coalesce("detail", F.lit("")))
    return events.select(*_body("catalog", F.concat_ws("/", "draft_id", "kind"), payload))


# --- alerts in words -------------------------------------------------------------------------------------------------


def _safe(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def _short(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.when(F.length(clean) <= LONGEST_VALUE, clean).otherwise(F.concat(F.substring(clean, 1, LONGEST_VALUE - 1), F.lit("…")))
    return F.when(F.coalesce(text, F.lit("")) == "", "—").otherwise(cut)


def alert_texts(changes: DataFrame, readings: DataFrame, products: DataFrame) -> DataFrame:
    """(product_uuid, id, change_type, text): the alert of each change, without the hour at which it is sent.

    Markup in values is escaped; an alert of a product that isn't known names no site.
    """
    state = readings.select("id", "action", "seller_name", F.col("price").alias("now"))
    rows = changes.join(state, "id", "left").join(products.select(F.col("uuid").alias("product_uuid"), "site"), "product_uuid", "left")
    merchant = _capital(F.col("site"))
    label = (
        F.when(F.col("change_type") == "seller_became_official", F.concat(F.lit("🏷️ "), merchant, F.lit(" devient vendeur")))
        .when(F.col("change_type") == "seller_left_buybox", F.concat(F.lit("🏷️ "), merchant, F.lit(" quitte la Buy Box")))
        .otherwise(F.coalesce(_named(ALERT_LABELS, F.col("change_type")), F.col("change_type")))
    )
    line = lambda name, value: F.concat(F.lit(f"<b>{name} :</b> "), value)
    some = (F.coalesce("old_value", F.lit("")) != "") | (F.coalesce("new_value", F.lit("")) != "")
    acts = F.col("action") != "none"
    lines = [
        F.lit("🚨 <b>ALERTE DROP</b>"), F.lit(""), line("Produit", _safe(F.col("product_uuid"))), line("Site", _safe(merchant)), line("Événement", _safe(label)),
        F.when(some, line("Changement", F.concat(_safe(_short(F.col("old_value"))), F.lit(" → "), _safe(_short(F.col("new_value")))))),
        F.when(acts, line("Action possible", _safe(_named(ACTION_LABELS, F.col("action"))))), F.when(acts & (F.col("seller_name") != ""), line("Vendeur", _safe(F.col("seller_name")))),
        F.when(F.col("now") != "", line("Prix", _safe(F.col("now")))),
    ]
    return rows.select("product_uuid", "id", "change_type", F.concat_ws("\n", *lines).alias("text"))
