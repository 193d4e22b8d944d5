"""Journalled sinks that see batches twice or fail, and readings that arrive out of order."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfline.operators import catalog as C
from shelfline.operators import changes as G
from shelfline.plans import registry
from shelfline.streaming import journal as J
from shelfline.streaming import late as L
from shelfline.streaming import monitor as M
from tests.test_oracle import rows as compared
from tests.test_rules import READING, readings

EVENTS = "product_uuid string, site string, canonical_url string, price string, availability string, monitored_uuid string, seen_at timestamp_ntz, seq long"


def sightings(n, seed=1):
    rng = random.Random(seed)
    pick = lambda *of: rng.choice([None, *of])
    return [
        (f"p{rng.randrange(3)}", pick("a", "b"), f"u{rng.randrange(6)}", pick("1 €", "2 €"), pick("in_stock", "unavailable"), pick("m1", "m2"), dt.datetime(2024, 1, rng.randrange(1, 28)), i)
        for i in range(n)
    ]


def rows(df):
    return sorted(map(str, df.collect()))


def test_batches_in_any_order_and_twice_give_the_state_of_all_events(spark, tmp_path):
    events = spark.createDataFrame(sightings(300), EVENTS)
    journal = J.Journal(spark, f"{tmp_path}/j")
    assert J.offers(journal).count() == 0
    for batch in (2, 0, 1, 2, 2):
        journal.write("offers", J.offer_parts(events.filter(F.col("seq") % 3 == batch)), batch)
    want = rows(C.offer_state(events))
    assert journal.batches("offers") == [0, 1, 2] and rows(J.offers(journal)) == want
    journal.compacted("offers", J.OFFERS, J.merged_offers)
    journal.write("offers", J.offer_parts(events), 3)  # everything once more
    assert journal.batches("offers", "base") == [2] and rows(J.offers(journal)) == want


def test_a_batch_that_a_sink_had_finished_is_passed_over(spark, tmp_path):
    journal = J.Journal(spark, f"{tmp_path}/j")
    one, two = spark.range(5), spark.range(9)
    journal.write("s", one, 7)
    journal.write("s", two, 7)
    assert journal.read("s", "id long").count() == 5
    # a write that stopped before its end leaves files and no marker
    two.write.parquet(journal.folder("s", 8))
    (tmp_path / "j" / "s" / "batch-000000000008" / "_SUCCESS").unlink()
    assert journal.read("s", "id long").count() == 5
    journal.write("s", one, 8)
    assert journal.read("s", "id long").count() == 10


def test_a_sink_that_fails_stops_no_other_and_its_batch_comes_again(spark, tmp_path):
    journal, source = J.Journal(spark, f"{tmp_path}/j"), f"{tmp_path}/in"
    spark.range(0, 10, 1, 1).write.parquet(source)
    stream = M.arriving(spark, source, spark.range(1))
    broken, seen = [True], []

    def first(batch):
        seen.append("first")
        return batch

    def second(batch):
        if broken[0]:
            raise ValueError("sink is down")
        return batch.withColumn("twice", F.col("id") * 2)

    sinks = {"first": first, "second": second, "third": lambda batch: batch.filter("id > 4")}
    with pytest.raises(Exception, match="sink is down"):
        J.run(stream, journal, sinks, f"{tmp_path}/log")
    assert [len(journal.batches(s)) for s in sinks] == [1, 0, 1]
    broken[0] = False
    spark.range(10, 12, 1, 1).write.mode("append").parquet(source)
    J.run(M.arriving(spark, source, spark.range(1)), journal, sinks, f"{tmp_path}/log")
    assert [journal.read(s, "id long").count() for s in sinks] == [12, 12, 7]
    assert journal.read("first", "id long").distinct().count() == 12


def test_readings_out_of_order_are_confirmed_in_the_order_of_time(spark, tmp_path):
    given = readings(3, 240)
    want = rows(G.confirmed(spark.createDataFrame(given, READING)))
    shuffled = random.Random(1).sample(given, len(given))
    end = ("end", 10**6, max(r[2] for r in given) + dt.timedelta(days=4000), "in_stock", *[None] * 5)
    for part in (shuffled[:80], shuffled[80:160], shuffled[160:], [end]):
        spark.createDataFrame(part, READING).coalesce(1).write.mode("append").parquet(f"{tmp_path}/r")
    stream = M.arriving(spark, f"{tmp_path}/r", spark.createDataFrame([], READING))
    found = M.run_to_table(L.confirmed(stream, "3000 days"))
    assert rows(found) == want and len(want) > 20


def events(n, seed=4):
    """Rows of `events` over five days that end on a full millisecond."""
    rng, start = random.Random(seed), dt.datetime(2024, 1, 1)
    kinds = ["view", "click", "signup", "purchase", "purchase", "error"]
    found = [(i, start + dt.timedelta(microseconds=rng.randrange(5 * 86_400_000_000)), rng.randrange(9), rng.choice(kinds), rng.randrange(1, 4) * 1.5) for i in range(n)]
    return [*found, (n, start + dt.timedelta(days=5), 3, "click", 1.0)]


def agree_over_parts(spark, tmp_path, name, given):
    """The query's rows, which its SQL has to give, over events that lie in three files, each of which spans all times."""
    for i in range(3):
        part = spark.createDataFrame(given[i::3], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").withColumn("props", F.lit("{}"))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    expected = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    df = registry.queries()[name](spark, str(tmp_path))
    found = df.collect()
    assert compared(df.columns, [tuple(r) for r in found]) == compared(names, expected.fetchall())
    return found


@pytest.mark.parametrize("name", ["stream_late_readings", "stream_confirmed_changes"])
def test_files_that_overlap_in_time_lose_no_reading(spark, tmp_path, name):
    assert len(agree_over_parts(spark, tmp_path, name, events(600))) > 100


def test_readings_of_one_millisecond_and_at_the_watermark(spark, tmp_path):
    at = dt.datetime(2024, 1, 2, 12)
    later = dt.timedelta(microseconds=1)
    # a later id is read earlier within one millisecond; two products have but readings at the watermark or past it
    given = [(1, at + 2 * later, 50, "click", 1.0), (2, at + later, 50, "purchase", 2.0), (3, at, 50, "signup", 2.0)]
    given += [(4, dt.datetime(2024, 1, 5), 60, "click", 1.0), (6, dt.datetime(2024, 1, 5, 0, 0, 1), 70, "click", 1.0), (8, None, 60, "click", 1.0), (None, at, 80, "click", 1.0)]
    found = agree_over_parts(spark, tmp_path, "stream_late_readings", [*given, *events(30)])
    told = {r.product_uuid: r for r in found}
    assert told["u60"].id == 4 and told["u80"].id is None and "u70" not in told
    assert [r.id for r in found if r.product_uuid == "u50" and r.outcome == "baseline"] == [3]


def test_products_of_one_bucket_are_folded_apart(spark, tmp_path):
    given = readings(5, 300)
    end = ("end", 10**6, max(r[2] for r in given) + dt.timedelta(days=4000), "in_stock", *[None] * 5)
    for part in (given[1::2], given[::2], [end]):
        spark.createDataFrame(part, READING).coalesce(1).write.mode("append").parquet(f"{tmp_path}/r")
    stream = M.arriving(spark, f"{tmp_path}/r", spark.createDataFrame([], READING))
    found = rows(M.run_to_table(L.confirmed(stream, "3000 days", buckets=1)))
    assert found == rows(G.confirmed(spark.createDataFrame(given, READING))) and len({r.split("'")[1] for r in found}) == 3
