"""Analytics over checks and engine events: conditional aggregates, series, scores, drift and incident chains.

Every operator is a pure function of DataFrames and an explicit `as_of`; the checks table is read once for all
the aggregates of a query, and only aggregates meet the small product dimension's site.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Penalty label, weight, reference rate.
SCORE_WEIGHTS = (
    ("erreurs", 30, 0.10),
    ("blocages", 25, 0.05),
    ("états indéterminés", 20, 0.20),
    ("bascules navigateur", 10, 0.30),
    ("lenteur", 8, 1.0),
    ("confiance", 7, 1.0),
)
SLOW_RESPONSE_MS, LOW_CONFIDENCE_FLOOR, MIN_CHECKS = 8000.0, 50.0, 10
HEALTHY, DEGRADED = 90, 70
MIN_SAMPLE, DRIFT_FACTOR, DRIFT_FLOOR, SLOWDOWN_FACTOR, CONFIDENCE_DROP = 20, 2.0, 0.10, 1.5, 8.0
CYCLE_SECONDS = 30


def latest(df: DataFrame, column: str) -> dt.datetime | None:
    """The reference instant of a fixture: its newest timestamp."""
    return df.agg(F.max(column)).first()[0]


def since(column: str, as_of: dt.datetime, hours: float, until: float | None = None) -> F.Column:
    """column in [as_of - hours, as_of - until), or without upper bound."""
    low = F.col(column) >= F.lit(as_of - dt.timedelta(hours=hours)).cast("timestamp_ntz")
    return low if until is None else low & (F.col(column) < F.lit(as_of - dt.timedelta(hours=until)).cast("timestamp_ntz"))


def _ok_response() -> F.Column:
    return F.when(F.col("status") == "ok", F.col("response_time_ms"))


def site_aggregates() -> list[F.Column]:
    status = F.col("http_status")
    return [
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.avg(_ok_response()).alias("avg_response_ms"),
        F.count_if(F.col("availability") == "unknown").alias("unknown_states"),
        F.count_if(F.col("fetch_source") == "browser").alias("browser_checks"),
        F.avg("confidence").alias("avg_confidence"),
        F.count_if(status == 403).alias("http_403"),
        F.count_if(status == 429).alias("http_429"),
        F.count_if(status == 404).alias("http_404"),
        F.count_if(status >= 500).alias("http_5xx"),
        F.count_if(status.between(400, 499)).alias("http_4xx"),
    ]


def with_site(checks: DataFrame, products: DataFrame) -> DataFrame:
    """Checks of known products with their site; Spark sends the product dimension around while it is small."""
    return checks.join(products.select("uuid", "site"), checks["product_uuid"] == products["uuid"]).drop("uuid")


def health_by_site(checks: DataFrame, products: DataFrame, as_of: dt.datetime, hours: float = 168) -> DataFrame:
    return with_site(checks.filter(since("checked_at", as_of, hours)), products).groupBy("site").agg(*site_aggregates())


def per_hour(checks: DataFrame, as_of: dt.datetime, hours: float = 168) -> DataFrame:
    bucket = F.date_format(F.date_trunc("hour", "checked_at"), "yyyy-MM-dd'T'HH:00").alias("bucket")
    return checks.filter(since("checked_at", as_of, hours)).groupBy(bucket).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "error").alias("errors"), F.avg(_ok_response()).alias("avg_ms")
    )


def confidence_per_hour(checks: DataFrame, as_of: dt.datetime, hours: float = 48) -> DataFrame:
    bucket = F.date_format("checked_at", "yyyy-MM-dd'T'HH:00").alias("bucket")
    rows = checks.filter(since("checked_at", as_of, hours) & F.col("confidence").isNotNull())
    return rows.groupBy(bucket).agg(F.bround(F.avg("confidence"), 1).alias("avg_confidence"))


def avg_by_fetch_source(checks: DataFrame, as_of: dt.datetime, hours: float = 168) -> DataFrame:
    ok = checks.filter(since("checked_at", as_of, hours) & (F.col("status") == "ok"))
    return ok.agg(*[F.avg(F.when(F.col("fetch_source") == s, F.col("response_time_ms"))).alias(f"{s}_ms") for s in ("http", "browser")])


def product_health(checks: DataFrame, as_of: dt.datetime, hours: float = 168) -> DataFrame:
    """Windowed aggregates, the all-time count and the last error of every product, in one pass."""
    recent = since("checked_at", as_of, hours)
    failed = F.col("status") == "error"
    return checks.groupBy("product_uuid").agg(
        F.count_if(recent).alias("checks"),
        F.count_if(recent & failed).alias("errors"),
        F.avg(F.when(recent, _ok_response())).alias("avg_response_ms"),
        F.avg(F.when(recent, F.col("confidence"))).alias("avg_confidence"),
        F.count(F.lit(1)).alias("total_checks"),
        F.max(F.when(failed, F.col("checked_at"))).alias("last_error_at"),
    )


def site_stats(checks: DataFrame, products: DataFrame, as_of: dt.datetime, hours: float = 24) -> DataFrame:
    """Last check, last error, mean response and count of each site: one pass instead of a query for each."""
    newest = F.struct("checked_at", "id")
    return with_site(checks, products).groupBy("site").agg(
        F.max("checked_at").alias("last_check_at"),
        F.max_by("status", newest).alias("last_status"),
        F.max(F.when(F.col("status") == "error", newest))["id"].alias("last_error_id"),
        F.avg(F.when(since("checked_at", as_of, hours), _ok_response())).alias("avg_response_ms"),
        F.count(F.lit(1)).alias("total"),
    )


def last_confidences(checks: DataFrame, n: int = 20) -> DataFrame:
    """The newest n confidences of every product, oldest first."""
    w = Window.partitionBy("product_uuid").orderBy(F.desc("checked_at"), F.desc("id"))
    ranked = checks.filter("confidence is not null").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return ranked.select("product_uuid", "confidence", (F.lit(n) - F.col("rn")).alias("position"))


def windows(checks: DataFrame, products: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Each site's last 24 hours beside its six days before, from one scan."""
    rows = with_site(checks.filter(since("checked_at", as_of, 168)), products)
    out = []
    for name, inside in (("recent", since("checked_at", as_of, 24)), ("baseline", since("checked_at", as_of, 168, 24))):
        out += [
            F.count_if(inside).alias(f"{name}_checks"),
            F.count_if(inside & (F.col("fetch_source") == "browser")).alias(f"{name}_browser_checks"),
            F.count_if(inside & (F.col("availability") == "unknown")).alias(f"{name}_unknown_states"),
            F.count_if(inside & (F.col("http_status") == 403)).alias(f"{name}_http_403"),
            F.avg(F.when(inside, _ok_response())).alias(f"{name}_ms"),
            F.avg(F.when(inside, F.col("confidence"))).alias(f"{name}_confidence"),
        ]
    return rows.groupBy("site").agg(*out)


def anomalies(compared: DataFrame) -> DataFrame:
    """(source, kind) of drifts: rates that doubled above a floor, slowdowns, and falling confidence."""
    enough = F.col("recent_checks") >= MIN_SAMPLE
    usable = F.col("baseline_checks") >= MIN_SAMPLE

    def drift(key: str) -> F.Column:
        rate = F.col(f"recent_{key}") / F.col("recent_checks")
        base = F.col(f"baseline_{key}") / F.col("baseline_checks")
        grown = F.when(usable, rate >= base * DRIFT_FACTOR).otherwise(rate >= DRIFT_FLOOR * 3)
        return F.when(enough & (rate >= DRIFT_FLOOR) & grown, F.lit(key))

    slow = enough & usable & (F.col("recent_ms") > 0) & (F.col("baseline_ms") > 0) & (F.col("recent_ms") > F.col("baseline_ms") * SLOWDOWN_FACTOR)
    dropped = F.col("baseline_confidence") - F.col("recent_confidence") >= CONFIDENCE_DROP
    kinds = F.array(drift("browser_checks"), drift("unknown_states"), drift("http_403"), F.when(slow, "slowdown"), F.when(dropped, "confidence"))
    return compared.select(F.col("site").alias("source"), F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("kind"))


def score(stats: DataFrame) -> DataFrame:
    """`stats` (site aggregates and `blocked`) with penalties, score, score_status and main_issue."""
    n = F.col("checks")
    rates = {
        "erreurs": F.col("errors") / n,
        "blocages": (F.col("http_403") + F.col("http_429") + F.col("blocked")) / n,
        "états indéterminés": F.col("unknown_states") / n,
        "bascules navigateur": F.col("browser_checks") / n,
        "lenteur": F.coalesce(F.least(F.lit(1.0), F.col("avg_response_ms") / SLOW_RESPONSE_MS), F.lit(0.0)),
        "confiance": F.coalesce(F.greatest(F.lit(0.0), (F.lit(LOW_CONFIDENCE_FLOOR) - F.col("avg_confidence")) / LOW_CONFIDENCE_FLOOR), F.lit(0.0)),
    }
    out, names = stats, []
    for i, (label, weight, reference) in enumerate(SCORE_WEIGHTS):
        penalty = F.bround(F.least(F.lit(float(weight)), rates[label] / reference * weight), 0).cast("int")
        out = out.withColumn(f"penalty_{i}", F.when(n >= MIN_CHECKS, penalty).otherwise(0))
        names.append(f"penalty_{i}")
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    out = out.withColumn("score", F.greatest(F.lit(0), F.lit(100) - total))
    level = F.when(F.col("score") >= HEALTHY, "healthy").when(F.col("score") >= DEGRADED, "degraded").otherwise("unhealthy")
    worst = F.greatest(*names)
    issue = F.when(worst == 0, F.lit(None).cast("string"))
    for c, (label, _, _) in zip(names, SCORE_WEIGHTS):
        issue = issue.when(F.col(c) == worst, label)
    return out.withColumn("score_status", F.when(n < MIN_CHECKS, "observation").otherwise(level)).withColumn("main_issue", issue)


def kinds_by_source(events: DataFrame, as_of: dt.datetime, hours: float = 168) -> DataFrame:
    return events.filter(since("created_at", as_of, hours)).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


def plugin_cards(sites: DataFrame, stats: DataFrame, events: DataFrame, last: DataFrame, watched: DataFrame) -> DataFrame:
    """Every site with its statistics, event counts, last check and products, zero where it has none, and its score."""
    kinds = ("blocked", "browser_fallback", "network_error", "http_error", "page_missing")
    per_site = events.groupBy(F.col("source").alias("site")).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds])
    card = sites.join(stats, "site", "left").join(per_site, "site", "left").join(last, "site", "left").join(watched, "site", "left")
    counts = [c for c in (*stats.columns, *kinds, "products") if c not in ("site", "avg_response_ms", "avg_confidence")]
    card = score(card.na.fill(0, counts))
    success = F.when(F.col("checks") > 0, F.bround(100 * (F.col("checks") - F.col("errors")) / F.col("checks"), 1))
    return card.withColumn("success_rate", success)


def system_score(cards: DataFrame, events: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One row: the weighted mean of plugins (3 each), discovery (1) and product intelligence (1).

    Pending suggestions are a debt from ten on.  The joins are of aggregates without groups, one row each.
    """
    plugins = cards.agg(F.coalesce(F.sum("score"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n"))
    failed = events.agg(F.coalesce(F.sum(F.when((F.col("source") == "discovery") & (F.col("kind") == "network_error"), F.col("n"))), F.lit(0)).alias("failed"))
    discovery = F.when(F.col("failed") == 0, 100).otherwise(80)
    waiting = suggestions.agg(F.count_if(F.col("status") == "pending").cast("int").alias("pending"))
    intelligence = F.when(F.col("pending") < 10, 100).otherwise(F.greatest(F.lit(60), 100 - F.col("pending")))
    overall = F.bround((F.col("total") * 3 + discovery + intelligence) / (F.col("n") * 3 + 2), 0).cast("int")
    level = F.when(F.col("score") >= HEALTHY, "healthy").when(F.col("score") >= DEGRADED, "degraded").otherwise("unhealthy")
    return plugins.join(failed).join(waiting).select(overall.alias("score")).withColumn("status", level)


def events_per_hour(events: DataFrame, kinds: list[str], as_of: dt.datetime, hours: float = 168) -> DataFrame:
    """One column for each kind, zero where an hour lacks it."""
    rows = events.filter(since("created_at", as_of, hours) & F.col("kind").isin(kinds))
    bucket = F.date_format("created_at", "yyyy-MM-dd'T'HH:00").alias("bucket")
    return rows.groupBy(bucket).pivot("kind", kinds).count().na.fill(0)


def average_durations(events: DataFrame) -> DataFrame:
    return events.filter("duration_ms is not null").groupBy("kind").agg(F.avg("duration_ms").alias("avg_duration_ms"))


def incident_chains(events: DataFrame, as_of: dt.datetime, hours: float = 168) -> DataFrame:
    """Events of one product (or source) within one 30-second bucket, and what they tell together."""
    rows = events.filter(since("created_at", as_of, hours) & (F.col("severity") != "info"))
    cycle = F.floor(F.unix_seconds(F.col("created_at").cast("timestamp")) / CYCLE_SECONDS).alias("cycle")
    kinds = F.collect_set("kind")
    outcome = (
        F.when(F.arrays_overlap(kinds, F.array(*map(F.lit, ("unknown_state", "blocked", "locale_mismatch")))), "non résolu")
        .when(F.arrays_overlap(kinds, F.array(*map(F.lit, ("browser_fallback", "browser_render")))), "rattrapé par le navigateur")
        .when(F.array_contains(kinds, "network_error"), "échec réseau")
        .otherwise("isolé")
    )
    return rows.groupBy(F.coalesce("product_uuid", "source").alias("subject"), cycle).agg(
        F.min("created_at").alias("started_at"), F.count(F.lit(1)).alias("steps"), F.min_by("source", "id").alias("source"), outcome.alias("outcome")
    )
