"""What a product lived through, from three streams, with its metrics, searches and health in one row each.

Listings, changes and engine events are three narrow streams of one shape; monitored products lead to catalogue
products by a join on distinct (monitored, product, site), so no stream is multiplied by what a merchant sells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.operators import views as V

#: Engine events that belong to a story.
STORY_KINDS = ("catalog_created", "catalog_merged", "catalog_pending", "discovery_found", "discovery_imported")


def monitored_sites(offers: DataFrame) -> DataFrame:
    """(monitored_uuid, product_uuid, site): what a monitored product stands for, each once; of several sites the first."""
    rows = offers.filter("monitored_uuid IS NOT NULL")
    return rows.groupBy("monitored_uuid", "product_uuid").agg(F.min("site").alias("site"))


def _entry(product: Column, at: Column, site: Column, label: Column, detail: Column, origin: str) -> list[Column]:
    return [product.alias("product_uuid"), at.alias("at"), site.alias("site"), label.alias("label"), detail.alias("detail"), F.lit(origin).alias("origin")]


def stories(offers: DataFrame, changes: DataFrame, events: DataFrame) -> DataFrame:
    """(product_uuid, at, site, label, detail, origin) of every entry: listings, then monitoring, then the engine.

    `changes` have monitored_uuid, checked_at, change_type, label, old_value, new_value; `events` have monitored_uuid,
    kind, detail, created_at.  Those of products that no offer monitors, or of other kinds, are in no story.
    """
    of = monitored_sites(offers)
    listed = offers.select(*_entry(F.col("product_uuid"), F.col("first_seen_at"), F.col("site"), F.lit("Nouvelle fiche"), F.col("canonical_url"), "discovery"))
    price = F.when(F.col("change_type").startswith("price"), F.col("new_value"))
    told = V.transition(F.col("old_value"), F.col("new_value"), price)
    watched = changes.join(of, "monitored_uuid").select(*_entry(F.col("product_uuid"), F.col("checked_at"), F.col("site"), F.col("label"), told, "monitoring"))
    named = F.create_map(*[F.lit(x) for pair in V.EVENT_LABELS.items() for x in pair])[F.col("kind")]
    own = events.filter(F.col("kind").isin(*STORY_KINDS)).join(of, "monitored_uuid")
    engine = own.select(*_entry(F.col("product_uuid"), F.col("created_at"), F.col("site"), F.coalesce(named, F.col("kind")), F.col("detail"), "intelligence"))
    return listed.unionByName(watched).unionByName(engine)


def metrics(offers: DataFrame, changes: DataFrame, alerts: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row for each catalogue product with an offer: merchants, changes, notifications, pictures and searches.

    Every stream is reduced to a row a product before it is joined; what doesn't occur counts 0.
    """
    of = monitored_sites(offers)
    counted = V.change_counters(changes.join(of, "monitored_uuid").drop("monitored_uuid").select("product_uuid", "change_type"))
    sent = alerts.join(of, "monitored_uuid").groupBy("product_uuid").agg(F.count(F.lit(1)).alias("notifications"), F.count("screenshot_path").alias("screenshots"))
    tried = attempts.groupBy("product_uuid").agg(F.count(F.lit(1)).alias("searches"), F.count_if(F.col("status") == "found").alias("searches_found"), F.min("next_retry_at").alias("next_retry_at"))
    rows = V.merchants(offers).join(counted, "product_uuid", "left").join(sent, "product_uuid", "left").join(tried, "product_uuid", "left")
    counts = ["changes", "price_changes", "back_in_stock", "out_of_stock", "preorders", "invitations", "notifications", "screenshots", "searches", "searches_found"]
    return rows.select("product_uuid", "merchants", "first_merchant", "first_seen_at", "last_merchant", "last_merchant_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "next_retry_at")
