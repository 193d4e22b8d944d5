"""Catalog maintenance: upserts and histories as transforms of event logs, never as updates in place."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Offer status by availability.
STATUS = {"in_stock": "active", "preorder": "active", "unavailable": "inactive", "not_listed": "not_found", "unknown": "active"}
RANK = {"in_stock": 0, "preorder": 1}


def offer_runs(events: DataFrame) -> DataFrame:
    """Every sighting of an offer with the state it leaves, and whether price or availability changed.

    Nulls keep the value before; the first monitored_uuid stays; a null never counts as a change.
    """
    w = Window.partitionBy("canonical_url").orderBy("seen_at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("canonical_url").orderBy("seen_at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.select(
        "*",
        F.last("price", True).over(w).alias("new_price"), F.last("price", True).over(before).alias("old_price"),
        F.last("availability", True).over(w).alias("new_availability"), F.last("availability", True).over(before).alias("old_availability"),
        F.first("monitored_uuid", True).over(w).alias("first_monitored"),
        F.row_number().over(Window.partitionBy("canonical_url").orderBy("seen_at", "seq")).alias("rn"),
    )
    moved = lambda c: F.coalesce(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"old_{c}")), F.lit(False))
    return carried.withColumn("changed", (F.col("rn") == 1) | moved("price") | moved("availability"))


def offer_state(events: DataFrame) -> DataFrame:
    """The latest state of each offer."""
    newest = F.struct("seen_at", "seq")
    return offer_runs(events).groupBy("canonical_url").agg(
        F.max_by("product_uuid", newest).alias("product_uuid"), F.max_by("site", newest).alias("site"),
        F.max_by("new_price", newest).alias("price"), F.max_by("new_availability", newest).alias("availability"),
        F.max_by("first_monitored", newest).alias("monitored_uuid"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_checked_at"),
    )


def offer_history(events: DataFrame) -> DataFrame:
    """A row for each sighting that changed price or availability, the first included."""
    return offer_runs(events).filter("changed").select("canonical_url", "seen_at", "seq", F.col("new_price").alias("price"), F.col("new_availability").alias("availability"))


def status_transitions(events: DataFrame) -> DataFrame:
    """Sightings at which an offer's status differs from the one before.

    A page that is gone is not_found whatever it said; an availability without a status is active, as is none.
    """
    status = F.coalesce(F.create_map(*[F.lit(x) for p in STATUS.items() for x in p])[F.col("new_availability")], F.lit("active"))
    if "page_exists" in events.columns:
        status = F.when(F.coalesce("page_exists", F.lit(True)), status).otherwise("not_found")
    w = Window.partitionBy("canonical_url").orderBy("seen_at", "seq")
    rows = offer_runs(events).withColumn("status", status).withColumn("previous", F.lag("status").over(w))
    return rows.filter("previous <> status").select("canonical_url", "seen_at", "seq", "previous", "status")


def sightings(found: DataFrame, fingerprint: F.Column) -> DataFrame:
    """Sightings as one row for each fingerprint: times seen, latest non-empty title and url."""
    filled = F.when(F.col("title") != "", F.col("title"))
    newest = F.struct("seq", "page_id")
    return found.withColumn("fingerprint", fingerprint).groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("times_seen"), F.max_by(filled, F.when(filled.isNotNull(), newest)).alias("title"),
        F.max_by("url", newest).alias("url"), F.max("site").alias("site"),
    )


def mark_missing(known: DataFrame, seen: DataFrame) -> DataFrame:
    """`known` (site, fingerprint, status) after complete scans that saw `seen` (site, fingerprint).

    Pending rows that their site's scan did not see are gone; decided rows never change, nor do rows of sites
    without a scan or whose scan saw nothing.
    """
    here = seen.select("site", "fingerprint").distinct().withColumn("__seen", F.lit(True))
    scanned = seen.select("site").distinct().withColumn("__scanned", F.lit(True))
    rows = known.join(here, ["site", "fingerprint"], "left").join(scanned, "site", "left")
    gone = (F.col("status") == "pending") & F.col("__scanned").isNotNull() & F.col("__seen").isNull()
    return rows.select(
        "fingerprint", "site", F.when(gone, "gone").otherwise(F.col("status")).alias("status"),
        F.when(gone, "absente du dernier balayage complet").alias("decision_reason"),
    )


def attempts_upsert(tries: DataFrame) -> DataFrame:
    """Tries (product_uuid, site, key_kind, key_value, status, confidence, found_url, tried_at, seq) as one row for each key.

    attempts counts them; status and confidence are the latest; the latest url found stays.
    """
    newest = F.struct("tried_at", "seq")
    url = F.when(F.col("found_url") != "", F.col("found_url"))
    return tries.groupBy("product_uuid", "site", "key_kind", "key_value").agg(
        F.count(F.lit(1)).cast("int").alias("attempts"), F.max_by("status", newest).alias("status"), F.max_by("confidence", newest).alias("confidence"),
        F.max_by(url, F.when(url.isNotNull(), newest)).alias("found_url"), F.max("tried_at").alias("last_attempt_at"),
    )


def with_next_retry(attempts: DataFrame) -> DataFrame:
    """`attempts` (status, attempts, last_attempt_at) with next_retry_at: null for what was found or is no failure."""
    due = retry_schedule(attempts)
    moment = F.timestamp_add("SECOND", F.col("retry_seconds").cast("int"), F.col("last_attempt_at"))
    return due.withColumn("next_retry_at", moment.cast("timestamp_ntz")).drop("retry_seconds")


def sighting_upsert(known: DataFrame, seen: DataFrame) -> DataFrame:
    """`known` discoveries after further sightings: (fingerprint, site, title, image_url, price, status, decision_reason, times_seen, first_seen_at, last_seen_at).

    A sighting fills in what it tells and leaves what it doesn't; what was gone is pending again, and every other
    decision stays.  What isn't known becomes pending.  `seen` may hold a fingerprint many times, in the order of seq.
    """
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    newest = lambda c: F.max_by(filled(c), F.when(filled(c).isNotNull(), F.struct("seen_at", "seq"))).alias(f"new_{c}")
    fresh = seen.groupBy("fingerprint").agg(
        newest("title"), newest("image_url"), newest("price"), F.min_by("site", F.struct("seen_at", "seq")).alias("new_site"),
        F.count(F.lit(1)).alias("again"), F.min("seen_at").alias("from"), F.max("seen_at").alias("to"),
    )
    rows = known.withColumn("__known", F.lit(True)).join(fresh, "fingerprint", "full")
    old, back = F.col("__known").isNotNull(), (F.col("status") == "gone") & F.col("again").isNotNull()
    return rows.select(
        "fingerprint", F.coalesce("site", "new_site").alias("site"), F.coalesce("new_title", "title").alias("title"), F.col("new_image_url").alias("image_url"), F.coalesce("new_price", "price").alias("price"),
        F.when(old & ~back, F.col("status")).otherwise("pending").alias("status"), F.when(old & back, "réapparue sur le site").alias("decision_reason"),
        (F.when(old, 1).otherwise(0) + F.coalesce("again", F.lit(0))).alias("times_seen"), F.coalesce("first_seen_at", "from").alias("first_seen_at"), F.greatest("first_seen_at", "to").alias("last_seen_at"),
    )


def scan_reports(after: DataFrame) -> DataFrame:
    """A report for each site of what `sighting_upsert` gives: rows seen, new ones, and where decisions stand."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return after.groupBy("site").agg(
        F.sum("times_seen").alias("products_seen"), F.count_if(F.col("decision_reason").isNotNull()).alias("back"), of("imported"), of("pending"), of("ignored"), of("blocked"), of("gone"),
    )


def retry_schedule(attempts: DataFrame, base: float = 1800, factor: float = 1.5, longest: float = 21600) -> DataFrame:
    """Seconds until the next try of each failed attempt, of which `attempts` were made; null for all others."""
    made = F.greatest(F.lit(0.0), F.col("attempts").cast("double") - 1)
    delay = F.least(F.lit(base) * F.pow(F.lit(factor), made), F.lit(float(longest)))
    return attempts.withColumn("retry_seconds", F.when(F.col("status").isin("not_found", "error"), F.floor(delay)))


def enrich(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """Fill blanks of `old` from `new` by uuid; what is known is never overwritten."""
    other = new.select("uuid", *[F.col(c).alias(f"__{c}") for c in fields])
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return old.join(other, "uuid", "left").select("uuid", *[F.coalesce(blank(c), F.col(f"__{c}")).alias(c) for c in fields])


def reassigned(offers: DataFrame, merges: DataFrame) -> DataFrame:
    """Offers of merged products under their target."""
    return offers.join(merges, offers["product_uuid"] == merges["source_uuid"], "left").select(
        *[F.coalesce("target_uuid", "product_uuid").alias("product_uuid") if c == "product_uuid" else offers[c] for c in offers.columns]
    )


def retained(df: DataFrame, column: str, as_of: dt.datetime, days: int) -> DataFrame:
    return df.filter(F.col(column) >= F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz"))


def propagation(states: DataFrame) -> DataFrame:
    """The order in which merchants listed each product, and hours after the first."""
    w = Window.partitionBy("product_uuid").orderBy("first_seen_at", "site", "canonical_url")
    first = F.first("first_seen_at").over(w)
    seconds = F.unix_seconds(F.col("first_seen_at").cast("timestamp")) - F.unix_seconds(first.cast("timestamp"))
    return states.select("product_uuid", "site", F.row_number().over(w).alias("rank"), F.bround(seconds / 3600, 1).alias("delay_hours"))


def best_offer(states: DataFrame) -> DataFrame:
    """The site of each product's best available offer; none is no row."""
    rank = F.when(F.col("availability") == "in_stock", 0).when(F.col("availability") == "preorder", 1)
    return states.withColumn("rank", rank).filter("rank is not null").groupBy("product_uuid").agg(
        F.min_by("site", F.struct("rank", "first_seen_at", "site", "canonical_url")).alias("best_site"), F.min("rank").alias("best_rank")
    )


def identifier_coverage(catalog: DataFrame, fields: tuple[str, ...] = ("ean", "upc", "isbn", "mpn", "asin", "model_number")) -> DataFrame:
    return catalog.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in fields])


def story(states: DataFrame, history: DataFrame) -> DataFrame:
    """A product's story: new listings and changes in one stream of entries."""
    listed = states.select("product_uuid", F.col("first_seen_at").alias("seen_at"), F.lit("Nouvelle fiche").alias("label"), F.col("site").alias("detail"), F.lit(0).alias("origin"))
    sites = states.select("canonical_url", "product_uuid")
    changed = history.join(sites, "canonical_url").select(
        "product_uuid", "seen_at", F.lit("Offre modifiée").alias("label"), F.concat_ws(" · ", "availability", "price").alias("detail"), F.lit(1).alias("origin")
    )
    return listed.unionByName(changed)
