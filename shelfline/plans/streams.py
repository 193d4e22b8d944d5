"""Queries of streams: journalled sinks and readings that arrive late, held against the SQL of their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.operators import changes as G
from shelfline.plans import sql as S
from shelfline.plans.register import query, with_ctes
from shelfline.sources import adapters as A
from shelfline.sources.files import work_dir
from shelfline.streaming import journal as J
from shelfline.streaming import late as L
from shelfline.streaming import monitor as M


def _arriving(spark, d, name, per_trigger=1):
    return M.arriving(spark, f"{d}/{name}.parque[t]", A.table(spark, d, name), per_trigger)


@query(*with_ctes("offer_events", S.RUNS, "SELECT * FROM state"))
def stream_offer_state(spark, d):
    """Offers upserted by a stream of sightings through a journal that may see a batch twice."""
    journal = J.Journal(spark, work_dir(spark, "journal"))
    J.run(_arriving(spark, d, "lineitem"), journal, {"offers": lambda batch: J.offer_parts(A.offer_events_of(batch))})
    return J.offers(journal)


def _routes() -> dict:
    """What a batch of checks becomes: rows of checks, then incidents; both are appended."""
    checks = lambda batch: A.checks_of(batch).select("id", "product_uuid", "status", "checked_at")
    return {"checks": checks, "incidents": lambda batch: G.check_incidents(A.checks_of(batch))}


_INCIDENTS = """inc AS (SELECT id FROM checks WHERE http_status IN (403, 429) OR availability = 'unknown' UNION ALL SELECT id FROM checks WHERE confidence < 60
  UNION ALL SELECT id FROM checks WHERE fetch_source = 'browser' AND status = 'ok' UNION ALL SELECT id FROM checks WHERE http_status >= 400)"""


@query(*with_ctes("checks", _INCIDENTS, "SELECT c.id, c.product_uuid, c.status, coalesce(i.n, 0) AS incidents FROM checks c LEFT JOIN (SELECT id, count(*) AS n FROM inc GROUP BY id) i ON i.id = c.id"))
def stream_routed_checks(spark, d):
    """Every check as the stream's router recorded it, with the number of incidents that it recorded for it."""
    journal = J.Journal(spark, work_dir(spark, "journal"))
    J.run(_arriving(spark, d, "events"), journal, _routes())
    checks = journal.read("checks", "id long, product_uuid string, status string, checked_at timestamp_ntz")
    incidents = journal.read("incidents", "id long, product_uuid string, kind string, severity string, detail string")
    told = incidents.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return checks.join(told, "id", "left").select("id", "product_uuid", "status", F.coalesce("n", F.lit(0)).alias("incidents"))


_SETTLED = "settled AS (SELECT * FROM readings WHERE checked_at <= (SELECT max(checked_at) FROM readings) - INTERVAL 1 DAY)"
_STEPS, _, _TOLD = S.CONFIRM.replace("readings", "settled").rpartition("\nSELECT w.")


@query(*with_ctes("readings", f"{_SETTLED},\n{_STEPS}", "SELECT w." + _TOLD))
def stream_late_readings(spark, d):
    """Confirmation of readings that may be a day late: what the watermark has passed, in the order of event time."""
    return M.run_to_table(L.confirmed(A.readings_of(_arriving(spark, d, "events", None)), "1 day"))
