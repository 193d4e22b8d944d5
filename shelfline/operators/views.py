"""List views, lookups, sinks as transforms, and the bundles that dashboards read.

Sinks never update in place: what the monitored application writes row by row is a DataFrame of facts here, and
a mutation is a join with the facts that change it.  All functions keep null keys as rows that match nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labels and default severities of engine events.
EVENT_LABELS = {
    "http_error": "Erreur HTTP", "timeout": "Délai dépassé", "network_error": "Échec réseau", "browser_render": "Rendu navigateur",
    "browser_fallback": "Bascule sur le navigateur", "blocked": "Page d'interception", "page_missing": "Fiche introuvable",
    "unknown_state": "État indéterminé", "low_confidence": "Confiance insuffisante", "locale_mismatch": "Contexte de livraison incorrect",
    "unstable": "Lectures contradictoires", "discovery_scan": "Balayage Discovery", "discovery_found": "Nouvelle fiche repérée",
    "discovery_imported": "Fiche importée", "catalog_created": "Produit canonique créé", "catalog_merged": "Offre rattachée",
    "catalog_pending": "Fusion à valider", "screenshot": "Capture d'écran",
}
ERRORS = ("http_error", "timeout", "network_error", "blocked")
WARNINGS = ("browser_fallback", "page_missing", "unknown_state", "low_confidence", "locale_mismatch", "unstable")
#: Changes that deserve a picture, and those no longer made.
IMPORTANT = (
    "product_appeared", "product_delisted", "price_appeared", "preorder_opened", "invitation_opened", "back_in_stock",
    "went_out_of_stock", "seller_became_official", "seller_left_buybox", "status_changed",
)
RETIRED = ("button_changed", "page_changed")
#: What names a button to buy.
BUY_HINTS = ("précommander", "precommander", "pré-commander", "preorder", "pre-order", "réserver", "reserver", "ajouter au panier", "add to cart", "acheter")
#: Columns that lists may be sorted by, the default first.
SORTS = {
    "checks": ("checked_at", "response_time_ms", "status"),
    "alerts": ("created_at", "change_type"),
    "products": ("created_at", "name", "site", "priority", "check_interval", "updated_at"),
    "catalog": ("updated_at", "name", "brand", "created_at", "release_date"),
    "discoveries": ("first_seen_at", "last_seen_at", "title", "site", "status"),
    "timeline": ("created_at", "event_type"),
}
#: Confidence of what a listing tells about a product.
FIELD_CONFIDENCE = {
    "ean": 100, "upc": 100, "isbn": 100, "mpn": 95, "sku": 92, "manufacturer_part_number": 90, "brand": 90, "collection": 80,
    "edition": 80, "release_date": 90, "primary_image": 85, "canonical_name": 70,
}
LEAST_TEXT_CONFIDENCE = 45


def sorts(resource: str) -> dict[str, str]:
    return {c: c for c in SORTS[resource]}


def lookup(table: DataFrame, key: str, values: list) -> DataFrame:
    """Rows whose key is one of a few values; the filter reaches the scan."""
    return table.filter(F.col(key).isin(values))


def tagged(table: DataFrame, column: str, tag: str) -> DataFrame:
    """Rows whose JSON array of tags holds `tag`, in any case; no JSON is no tags."""
    tags = F.transform(F.from_json(column, "array<string>"), F.lower)
    return table.filter(F.coalesce(F.array_contains(tags, tag.lower()), F.lit(False)))


def grouped(rows: DataFrame, wanted: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """`value` of all rows of each wanted key, as one text in order: a batch of fetches in one join."""
    found = rows.join(wanted.select(key).distinct(), key, "left_semi")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return found.groupBy(key).agg(F.array_join(listed, ",").alias("items"), F.count(F.lit(1)).alias("n"))


def labelled(events: DataFrame) -> DataFrame:
    """Engine events with label and severity; an unknown kind is its own label, severity defaults by kind, detail is cut at 500."""
    names = F.create_map(*[F.lit(x) for p in EVENT_LABELS.items() for x in p])
    kind = F.col("kind")
    usual = F.when(kind.isin(*ERRORS), "error").when(kind.isin(*WARNINGS), "warning").otherwise("info")
    return events.withColumns(
        {"label": F.coalesce(names[kind], kind), "severity": F.coalesce("severity", usual), "detail": F.substring("detail", 1, 500)}
    )


def predicates(readings: DataFrame) -> DataFrame:
    """conclusive, actionable and hash-free facts of every reading."""
    buys = F.col("action").isin("add_to_cart", "preorder", "request_invite", "buy_now")
    return readings.withColumns({"conclusive": F.col("availability") != "unknown", "actionable": buys})


def screenshot_worthy(changes: DataFrame) -> DataFrame:
    """`changes` (change_type, old_value, new_value) with important, alert_worthy and screenshot."""
    kind = F.col("change_type")

    def buys(value: str) -> F.Column:
        return F.exists(F.array(*map(F.lit, BUY_HINTS)), lambda h: F.contains(F.lower(F.coalesce(value, F.lit(""))), h))

    important = kind.isin(*IMPORTANT)
    newly = (kind == "button_changed") & buys("new_value") & ~buys("old_value")
    return changes.withColumns({"important": important, "alert_worthy": ~kind.isin(*RETIRED), "screenshot": important | newly})


def merchant_labels(changes: DataFrame, products: DataFrame) -> DataFrame:
    """Labels of the timeline; those of seller changes name the merchant."""
    site = F.coalesce(F.initcap("site"), F.lit("Le marchand"))
    kind = F.col("change_type")
    label = F.when(kind == "seller_became_official", F.concat(site, F.lit(" devient vendeur"))).when(kind == "seller_left_buybox", F.concat(site, F.lit(" quitte la Buy Box")))
    rows = changes.join(products.select(F.col("uuid").alias("product_uuid"), "site"), "product_uuid", "left")
    return rows.withColumn("label", F.coalesce(label, "label"))


def transition(old: F.Column, new: F.Column, price: F.Column) -> F.Column:
    """"old → new · price", a dash for a side that is missing, and nothing for none."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    shown = lambda c: F.when(has(c), c).otherwise("—")
    moved = F.when(has(old) | has(new), F.concat(shown(old), F.lit(" → "), shown(new)))
    return F.concat_ws(" · ", moved, F.when(has(price), price))


def notified(alerts: DataFrame, sent: DataFrame, pictures: DataFrame) -> DataFrame:
    """Alerts with the flags that later facts set: sent (id), pictures (id, path)."""
    flags = sent.select("id").distinct().withColumn("__sent", F.lit(True))
    shots = pictures.groupBy("id").agg(F.max("path").alias("__path"))
    rows = alerts.join(flags, "id", "left").join(shots, "id", "left")
    return rows.select(
        *[c for c in alerts.columns if c not in ("notified", "screenshot_path")],
        (F.col("notified") | F.coalesce("__sent", F.lit(False))).alias("notified"), F.coalesce("__path", "screenshot_path").alias("screenshot_path"),
    )


def decided_discoveries(found: DataFrame, decisions: DataFrame, deleted: DataFrame) -> DataFrame:
    """Discoveries after decisions (fingerprint, decision, reason) and the deletion of products (uuid), which detaches."""
    own = decisions.select("fingerprint", F.col("decision").alias("__d"), F.col("reason").alias("__r"))
    gone = deleted.select(F.col("uuid").alias("product_uuid")).distinct().withColumn("__gone", F.lit(True))
    rows = found.join(own, "fingerprint", "left").join(gone, "product_uuid", "left")
    return rows.select(
        "fingerprint", F.coalesce("__d", "status").alias("status"), F.when(F.coalesce("__r", F.lit("")) != "", F.col("__r")).alias("decision_reason"),
        F.when(F.col("__gone").isNull(), F.col("product_uuid")).alias("product_uuid"),
    )


def new_suggestions(pending: DataFrame, made: DataFrame) -> DataFrame:
    """Suggestions that are made and not already pending for the same two products, once each, the best score."""
    open_ones = pending.filter("status = 'pending'").select("product_uuid", "candidate_uuid")
    best = made.groupBy("product_uuid", "candidate_uuid").agg(F.max("score").alias("score"))
    return best.join(open_ones, ["product_uuid", "candidate_uuid"], "left_anti").withColumn("status", F.lit("pending"))


def without(table: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows that do not belong to deleted products (uuid)."""
    return table.join(deleted.select(F.col("uuid").alias(key)).distinct(), key, "left_anti").select(*table.columns)


def patched(products: DataFrame, patches: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Products with the whitelisted fields that patches (uuid, ...) set; a null sets nothing, other fields are ignored."""
    own = [c for c in fields if c in patches.columns]
    new = patches.select("uuid", *[F.col(c).alias(f"__{c}") for c in own])
    return products.join(new, "uuid", "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in own else c for c in products.columns])


def best_term() -> F.Column:
    """The term that tells a product best: its EAN, UPC, part number or name, the first that isn't empty."""
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("ean", "upc", "mpn")], F.col("canonical_name"))


def first_by(rows: DataFrame, key: F.Column, *order: str) -> DataFrame:
    """Of rows with one key the first in order; min_by keeps it to one aggregate."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(key.alias("__key")).agg(F.min_by(whole, F.struct(*order)).alias("__row")).select("__row.*")


def search_plan(keys: DataFrame, sites: DataFrame, known: DataFrame, most_keys: int = 6, most_sites: int = 8) -> DataFrame:
    """Searches to make: each product's surest keys at each merchant (few by contract) where it has no offer yet."""
    few = sites.orderBy("site").limit(most_sites)
    wanted = keys.filter(F.col("rank") <= most_keys).join(F.broadcast(few))  # eight sites at most
    had = known.select(F.col("product_uuid").alias("uuid"), F.lower("site").alias("site"))
    return wanted.join(had, ["uuid", "site"], "left_anti").select("uuid", "site", "kind", "value", "rank")


def candidate_confidence(candidates: DataFrame, near: F.Column) -> DataFrame:
    """(priority, near 0..1) -> confidence; a strong key's is its priority, a weak one's falls with the name, under 45 none."""
    weak = F.floor(F.col("priority") * F.greatest(F.lit(0.0), near)).cast("int")
    out = candidates.withColumn("confidence", F.when(F.col("priority") >= 90, F.col("priority")).otherwise(weak))
    return out.filter((F.col("priority") >= 90) | (F.col("confidence") >= LEAST_TEXT_CONFIDENCE))


def field_facts(drafts: DataFrame, names: dict[str, str]) -> DataFrame:
    """(draft_id, field, value, confidence) of every filled field; names: field -> column."""
    parts = [F.struct(F.lit(f).alias("field"), F.trim(c).alias("value"), F.lit(FIELD_CONFIDENCE[f]).alias("confidence")) for f, c in names.items()]
    return drafts.select("draft_id", F.explode(F.array(*parts)).alias("x")).filter("x.value <> ''").select("draft_id", "x.*")


def event_counts(events: DataFrame, last: int = 20) -> DataFrame:
    """(product_uuid, kind, n) within each product's newest events."""
    w = Window.partitionBy("product_uuid").orderBy(F.desc("created_at"), F.desc("id"))
    newest = events.filter("product_uuid is not null").withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= last)
    return newest.groupBy("product_uuid", "kind").agg(F.count(F.lit(1)).alias("n"))


def merchants(offers: DataFrame) -> DataFrame:
    """Each product's merchants: how many, and which was first and last to list it."""
    order = F.struct("first_seen_at", "site", "canonical_url")
    return offers.groupBy("product_uuid").agg(
        F.count(F.lit(1)).alias("merchants"), F.min_by("site", order).alias("first_merchant"), F.min("first_seen_at").alias("first_seen_at"),
        F.max_by("site", order).alias("last_merchant"), F.max("first_seen_at").alias("last_merchant_at"),
    )


def change_counters(changes: DataFrame) -> DataFrame:
    """Each product's changes by what they mean to a buyer."""
    of = lambda *kinds: F.count_if(F.col("change_type").isin(*kinds))
    return changes.groupBy("product_uuid").agg(
        F.count(F.lit(1)).alias("changes"), of("price_changed").alias("price_changes"), of("back_in_stock").alias("back_in_stock"),
        of("went_out_of_stock").alias("out_of_stock"), of("preorder_opened").alias("preorders"), of("invitation_opened").alias("invitations"),
    )


def weighted_mean(sites: DataFrame) -> F.Column:
    """Mean response over sites by their checks, rounded; sites without one carry no weight, none at all is null."""
    n = F.when(F.col("avg_response_ms").isNotNull(), F.col("checks"))
    return F.bround(F.sum(n * F.col("avg_response_ms")) / F.sum(n), 1)


def suggestion_totals(suggestions: DataFrame) -> DataFrame:
    """One row: pending, accepted and rejected, and the mean score of all."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return suggestions.agg(of("pending"), of("accepted"), of("rejected"), F.bround(F.sum("score") / F.count("score"), 1).alias("avg_score"))


def due_retries(attempts: DataFrame, as_of: dt.datetime, limit: int = 50) -> DataFrame:
    """Unfound searches whose time has come, the longest overdue first."""
    due = attempts.filter((F.col("status") != "found") & (F.col("next_retry_at") <= F.lit(as_of).cast("timestamp_ntz")))
    return due.orderBy("next_retry_at", "product_uuid", "site", "key_kind").limit(limit)


def story_sites(events: DataFrame, offers: DataFrame) -> DataFrame:
    """Events with the site of the offer that is monitored under their product, else their own source."""
    own = offers.filter("monitored_uuid is not null").groupBy(F.col("monitored_uuid").alias("product_uuid")).agg(F.min("site").alias("__site"))
    return events.join(own, "product_uuid", "left").withColumn("site", F.coalesce("__site", "source", F.lit("—"))).drop("__site")


def scan_cycle(found: DataFrame, known: DataFrame, most_new: int = 50) -> DataFrame:
    """One scan by site: pages seen and new, new ones up to a cap (the rest waits for the next scan, as the feature has it)."""
    old = known.select("fingerprint").distinct().withColumn("__old", F.lit(True))
    rows = found.join(old, "fingerprint", "left").withColumn("new", F.col("__old").isNull())
    w = Window.partitionBy("site", "new").orderBy("page_id")
    rows = rows.withColumn("taken", F.col("new") & (F.row_number().over(w) <= most_new))
    return rows.groupBy("site").agg(F.count(F.lit(1)).alias("seen"), F.count_if("new").alias("new"), F.count_if("taken").alias("taken"), (F.count_if("new") <= most_new).alias("complete"))


def imported(records: DataFrame, slug: F.Column, tags: list[str]) -> DataFrame:
    """Products that discoveries become: title cut at 200, group by slug, default tags and the site, each once."""
    own = F.array_distinct(F.concat(F.array(*map(F.lit, tags)), F.array("site")))
    return records.select(
        "fingerprint", F.substring("title", 1, 200).alias("name"), "site", "url", F.when(slug != "", slug).alias("group_key"), F.to_json(own).alias("tags")
    )


def accepted(suggestions: DataFrame, accepted_ids: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers after suggestions are accepted: those of the new product go to the candidate."""
    moves = suggestions.join(accepted_ids.select("id").distinct(), "id", "left_semi").filter("status = 'pending'")
    moves = moves.groupBy("product_uuid").agg(F.min_by("candidate_uuid", "id").alias("__to"))
    return offers.join(moves, "product_uuid", "left").withColumn("product_uuid", F.coalesce("__to", "product_uuid")).drop("__to")


def fetch_diagnostics(fetches: DataFrame) -> DataFrame:
    """A refusal's status goes before a later success; a refusal is a fallback to the browser."""
    refused = F.col("blocked_status").isNotNull()
    source = F.when(F.col("source").isin("http", "browser"), F.col("source")).otherwise("unknown")
    return fetches.select("id", source.alias("fetch_source"), F.coalesce("blocked_status", "status_code").alias("http_status"), (F.coalesce("fallback", F.lit(False)) | refused).alias("browser_fallback"))
