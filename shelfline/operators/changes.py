"""State changes between successive readings: silent baselines, conclusive readings only, absorbing rules.

`change_events` compares each conclusive reading with the conclusive one before it (a window by product).
Double-read confirmation needs state that plain `lag` can't give; `confirmed` folds it, the same way in batch
and in streams (`shelfline.streaming.monitor`).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIONABLE = ("add_to_cart", "preorder", "request_invite", "buy_now")
#: What a new availability is called.
AVAILABILITY_EVENTS = {"in_stock": "back_in_stock", "preorder": "preorder_opened", "unavailable": "went_out_of_stock", "not_listed": "product_delisted"}
#: Labels of the timeline.
LABELS = {
    "product_appeared": "Produit découvert",
    "product_delisted": "Fiche retirée",
    "price_appeared": "Prix détecté",
    "price_changed": "Prix modifié",
    "preorder_opened": "Précommande ouverte",
    "invitation_opened": "Invitation ouverte",
    "back_in_stock": "Retour en stock",
    "went_out_of_stock": "Rupture de stock",
    "status_changed": "Disponibilité modifiée",
}
FIELDS = ("availability", "price", "page_exists", "action", "seller_type", "seller_name", "checked_at", "id")


def described(state: F.Column) -> F.Column:
    seller = F.when(state["seller_name"].isNotNull(), F.concat(F.lit("vendu par "), state["seller_name"]))
    return F.concat_ws(" · ", state["availability"], state["price"], seller)


def paired(readings: DataFrame) -> DataFrame:
    """Every conclusive reading beside the conclusive one before it (null for the first)."""
    w = Window.partitionBy("product_uuid").orderBy("checked_at", "id")
    state = F.struct(*FIELDS)
    conclusive = readings.filter("availability <> 'unknown'").withColumn("new", state)
    return conclusive.select("product_uuid", "new", F.lag("new").over(w).alias("old"))


def baselines(readings: DataFrame) -> DataFrame:
    return paired(readings).filter("old is null").select("product_uuid", "new.checked_at", "new.availability", "new.price")


def _event(condition: F.Column, kind: F.Column, old: F.Column, new: F.Column) -> F.Column:
    return F.when(condition, F.struct(kind.alias("change_type"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value")))


def events_of(old: F.Column, new: F.Column) -> F.Column:
    """Array of (change_type, old_value, new_value) between two conclusive states."""
    appeared = ~old["page_exists"] & new["page_exists"]
    moved = old["availability"] != new["availability"]
    kind = F.lit("status_changed")
    for availability, name in AVAILABILITY_EVENTS.items():
        named = F.lit(name)
        if availability == "preorder":
            named = F.when(new["action"] == "request_invite", "invitation_opened").otherwise(named)
        kind = F.when(new["availability"] == availability, named).otherwise(kind)
    both = old["action"].isin(*ACTIONABLE) & new["action"].isin(*ACTIONABLE)
    seller = both & (old["seller_type"] != "unknown") & (new["seller_type"] != "unknown") & (old["seller_type"] != new["seller_type"])
    official = new["seller_type"] == "official"
    third, shop = F.lit("revendeur tiers"), F.lit("vendeur officiel")
    has_new, had = F.coalesce(new["price"], F.lit("")) != "", F.coalesce(old["price"], F.lit("")) != ""
    still = ~moved & ~appeared
    found = F.array(
        _event(appeared, F.lit("product_appeared"), described(old), described(new)),
        _event(~appeared & moved, kind, described(old), described(new)),
        _event(
            seller,
            F.when(official, "seller_became_official").otherwise("seller_left_buybox"),
            F.coalesce(old["seller_name"], F.when(official, third).otherwise(shop)),
            F.coalesce(new["seller_name"], F.when(official, shop).otherwise(third)),
        ),
        _event(still & has_new & ~had, F.lit("price_appeared"), F.lit(None), new["price"]),
        _event(still & has_new & had & (old["price"] != new["price"]), F.lit("price_changed"), old["price"], new["price"]),
    )
    return F.filter(found, lambda e: e.isNotNull())


def change_events(readings: DataFrame) -> DataFrame:
    """A row for each change, with its timeline label; baselines and inconclusive readings make none."""
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    found = paired(readings).filter("old is not null").select("product_uuid", F.col("new.id").alias("id"), F.col("new.checked_at").alias("checked_at"), F.explode(events_of(F.col("old"), F.col("new"))).alias("e"))
    return found.select("product_uuid", "id", "checked_at", "e.*", F.coalesce(label[F.col("e.change_type")], F.col("e.change_type")).alias("label"))


def signatures(events: DataFrame) -> DataFrame:
    """The comparable signature of each reading's changes."""
    part = F.concat_ws("=", F.col("change_type"), F.coalesce("new_value", F.lit("")))
    return events.groupBy("product_uuid", "id").agg(F.array_join(F.sort_array(F.collect_list(part)), "|").alias("signature"))


def business_hash(df: DataFrame, version: str = "1") -> DataFrame:
    """`df` with the fingerprint of its business state; a third-party seller's name plays no part."""
    seller = F.when(F.col("seller_type") == "official", F.lower(F.trim(F.coalesce("seller_name", F.lit(""))))).otherwise("")
    parts = [F.col("availability"), F.col("action"), F.when(F.col("page_exists"), "buybox").otherwise(""), F.col("seller_type"), seller, F.coalesce("price", F.lit("")), F.lit("EUR"), F.lit(""), F.lit(version)]
    return df.withColumn("business_hash", F.left(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), F.lit(16)))


def signature(old: Mapping, new: Mapping) -> tuple[tuple[str, str], ...]:
    """The comparable changes between two conclusive readings, as `events_of` finds them."""
    found = []
    said = " · ".join(x for x in (new["availability"], new["price"], new["seller_name"] and f"vendu par {new['seller_name']}") if x is not None)
    appeared, moved = new["page_exists"] and not old["page_exists"], old["availability"] != new["availability"]
    if appeared:
        found.append(("product_appeared", said))
    elif moved:
        invited = new["availability"] == "preorder" and new["action"] == "request_invite"
        found.append(("invitation_opened" if invited else AVAILABILITY_EVENTS.get(new["availability"], "status_changed"), said))
    kinds = {old["seller_type"], new["seller_type"]}
    if old["action"] in ACTIONABLE and new["action"] in ACTIONABLE and len(kinds) == 2 and "unknown" not in kinds:
        official = new["seller_type"] == "official"
        named = new["seller_name"] or ("vendeur officiel" if official else "revendeur tiers")
        found.append(("seller_became_official" if official else "seller_left_buybox", named))
    if not moved and not appeared and new["price"] and new["price"] != old["price"]:
        found.append(("price_changed" if old["price"] else "price_appeared", new["price"]))
    return tuple(sorted(found))


def confirm_step(state: dict | None, waiting: dict | None, reading: dict) -> tuple[dict | None, dict | None, tuple | None]:
    """(confirmed state, reading that waits, outcome) after one reading; the outcome is (kind, old, new) or None.

    The first conclusive reading is a baseline.  A reading with changes waits for the one after it, which
    confirms it if it is conclusive and shows the very same changes; then the second reading is the state.  If
    not, the state stays and the pair is unstable.  Inconclusive readings that none waits for change nothing.
    """
    conclusive = reading["availability"] != "unknown"
    if waiting is not None:
        if conclusive and signature(state, reading) == signature(state, waiting):
            return reading, None, ("confirmed", state, reading)
        return state, None, ("unstable", waiting, reading)
    if not conclusive:
        return state, None, None
    if state is None:
        return reading, None, ("baseline", None, reading)
    if signature(state, reading):
        return state, reading, None
    return reading, None, None


READ = ("availability", "price", "page_exists", "action", "seller_type", "seller_name")
CONFIRMED = "product_uuid string, id long, outcome string, old_value string, new_value string"


def reading_of(row) -> dict:
    """The fields of a row that confirmation compares, with None for missing ones."""
    return {c: None if pd.isna(x := getattr(row, c)) else x for c in READ}


def shown(x: dict | None) -> str | None:
    return None if x is None else " · ".join(v for v in (x["availability"], x["price"]) if v)


def confirmed(readings: DataFrame) -> DataFrame:
    """Double-read confirmation in batch: (product_uuid, id, outcome, old_value, new_value).

    Each task folds its products' readings in order as they stream by, so it holds one batch and one state,
    however long a product's history is.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        product = state = waiting = None
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.product_uuid != product:
                    product, state, waiting = r.product_uuid, None, None
                state, waiting, found = confirm_step(state, waiting, reading_of(r))
                if found:
                    out.append((product, r.id, found[0], shown(found[1]), shown(found[2])))
            yield pd.DataFrame(out, columns=["product_uuid", "id", "outcome", "old_value", "new_value"])

    own = readings.select("product_uuid", "id", "checked_at", *READ).filter("product_uuid is not null and availability is not null")
    return own.repartition("product_uuid").sortWithinPartitions("product_uuid", "checked_at", "id").mapInPandas(fold, CONFIRMED)


def check_incidents(checks: DataFrame) -> DataFrame:
    """The incidents that each check tells of, as engine events; a plain check tells of none."""
    blocked = F.col("http_status").isin(403, 429)
    unknown = ~blocked & (F.col("availability") == "unknown")
    low = F.col("confidence") < 60

    def event(kind: str, detail: F.Column) -> F.Column:
        return F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))

    http = F.concat(F.lit("HTTP "), F.col("http_status"))
    kinds = F.array(
        F.when(blocked, event("blocked", http)).when(unknown, event("unknown_state", F.lit("état indéterminé"))),
        F.when(low, event("low_confidence", F.concat(F.lit("confiance "), F.col("confidence")))),
        F.when((F.col("fetch_source") == "browser") & (F.col("status") == "ok"), event("browser_fallback", F.lit("analyse infructueuse ou accès refusé en HTTP"))),
        F.when(F.col("http_status") == 404, event("page_missing", http)).when(F.col("http_status") >= 400, event("http_error", http)),
    )
    severity = F.when(F.col("e.kind").isin("http_error", "blocked"), "error").otherwise("warning")
    exploded = checks.select("id", "product_uuid", F.explode(F.filter(kinds, lambda e: e.isNotNull())).alias("e"))
    return exploded.select("id", "product_uuid", "e.kind", severity.alias("severity"), F.substring("e.detail", 1, 500).alias("detail"))
