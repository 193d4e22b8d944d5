"""Core operators on nulls, ties, repeated rows and empty tables, against the rules stated plainly."""

import random

import pytest

from shelfline.functions import html as H
from shelfline.operators import catalog as C
from shelfline.operators import changes as G
from shelfline.operators import relational as R
from shelfline.operators import resolution as E
from shelfline.operators import views as V
from shelfline.sources import files as S
from shelfline.streaming import monitor as M

READING = "product_uuid string, id long, checked_at timestamp_ntz, availability string, price string, page_exists boolean, action string, seller_type string, seller_name string"


def readings(seed, n):
    import datetime as dt

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["unknown", "in_stock", "in_stock", "preorder", "unavailable", "not_listed", None])
        rows.append((
            rng.choice(["a", "b", "c", None]), i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 2), kind, rng.choice(["1,00 €", "2,00 €", None]), rng.random() < 0.8,
            rng.choice(["add_to_cart", "preorder", "request_invite", "none"]), rng.choice(["official", "third_party", "unknown"]), rng.choice(["shop", None]),
        ))
    return rows


def test_signature_is_that_of_the_column_rules(spark):
    rows = [r for r in readings(1, 300) if r[0] == "a" and r[3] not in (None, "unknown")]
    df = spark.createDataFrame(rows, READING)
    by_columns = {r.id: r.signature for r in G.signatures(G.change_events(df)).collect()}
    fields = dict(zip([c.split()[0] for c in READING.split(", ")], range(9)))
    state = [{c: r[fields[c]] for c in G.READ} for r in rows]
    for i in range(1, len(rows)):
        found = "|".join(sorted(f"{k}={v}" for k, v in G.signature(state[i - 1], state[i])))
        assert by_columns.get(rows[i][1], "") == found


def test_confirmation_in_batch_and_stream_agree_and_follow_the_rule(spark, tmp_path):
    rows = readings(2, 400)
    df = spark.createDataFrame(rows, READING)
    batch = sorted(map(tuple, G.confirmed(df.repartition(5)).collect()))
    df.coalesce(1).write.parquet(f"{tmp_path}/r")
    stream = M.run_to_table(M.confirmed(M.arriving(spark, f"{tmp_path}/r", df)))
    assert batch == sorted(map(tuple, stream.collect())) and {r[2] for r in batch} == {"baseline", "confirmed", "unstable"}
    assert {r[0] for r in batch} == {"a", "b", "c"}
    assert G.confirmed(df.limit(0)).count() == 0


def test_a_third_reading_is_no_second_one():
    read = lambda a, p=None: dict(availability=a, price=p, page_exists=True, action="none", seller_type="unknown", seller_name=None)
    base, gone, back = read("in_stock"), read("unavailable"), read("in_stock")
    state, waiting, out = G.confirm_step(None, None, base)
    assert out[0] == "baseline"
    state, waiting, out = G.confirm_step(state, waiting, gone)
    assert out is None and waiting == gone and state == base
    state, waiting, out = G.confirm_step(state, waiting, back)
    assert out[0] == "unstable" and waiting is None and state == base
    state, waiting, _ = G.confirm_step(state, waiting, gone)
    state, waiting, out = G.confirm_step(state, waiting, read("unknown"))
    assert out[0] == "unstable" and state == base
    state, waiting, _ = G.confirm_step(state, waiting, gone)
    state, waiting, out = G.confirm_step(state, waiting, gone)
    assert out[0] == "confirmed" and state == gone


def test_retries_and_missing_pages(spark):
    tries = spark.createDataFrame([("a", "not_found", i) for i in range(9)] + [("b", "found", 3), ("c", None, 1)], "product_uuid string, status string, attempts int")
    got = [r.retry_seconds for r in C.retry_schedule(tries).orderBy("product_uuid", "attempts").collect()]
    assert got == [1800, 1800, 2700, 4050, 6075, 9112, 13668, 20503, 21600, None, None]
    known = spark.createDataFrame([("s", "f1", "pending"), ("s", "f2", "pending"), ("s", "f3", "imported"), ("t", "f4", "pending"), (None, "f5", "pending")], "site string, fingerprint string, status string")
    seen = spark.createDataFrame([("s", "f1"), ("s", "f1"), ("t", None)], "site string, fingerprint string")
    got = {r.fingerprint: r.status for r in C.mark_missing(known, seen).collect()}
    assert got == {"f1": "pending", "f2": "gone", "f3": "imported", "f4": "gone", "f5": "pending"}
    assert {r.status for r in C.mark_missing(known, seen.limit(0)).collect()} == {"pending", "imported"}


def test_rules_fold_and_order(spark):
    rows = [("CÔFFRET Élite", "https://a/x"), ("coffret", "https://a/PROMO"), ("rien", "https://a/elite"), (None, None), ("occasion coffret", "u")]
    df = spark.createDataFrame(rows, "title string, url string")
    got = [(r.decision, r.reason) for r in E.rules_decision(df, {"include": ["Coffret", "coffret ", ""], "exclude": ["Occasion"], "url_include": ["élite"], "url_exclude": ["promo"]}).collect()]
    assert [g[0] for g in got] == ["accept", "exclude", "accept", "reject", "exclude"]
    assert got[1][1] == "URL exclue : promo" and got[4][1] == "titre exclu : occasion" and got[0][1] == "correspond à : coffret"
    assert {r.decision for r in E.rules_decision(df, None).collect()} == {"accept"}


def test_views_on_nulls_ties_and_empty_tables(spark):
    offers = spark.createDataFrame([("p", "b", "u2", 1), ("p", "a", "u1", 1), (None, "c", "u3", 2), ("p", "a", "u1", 1)], "product_uuid string, site string, canonical_url string, first_seen_at int")
    got = {r.product_uuid: (r.merchants, r.first_merchant, r.last_merchant) for r in V.merchants(offers).collect()}
    assert got == {"p": (3, "a", "b"), None: (1, "c", "c")}
    assert V.merchants(offers.limit(0)).count() == 0
    tags = spark.createDataFrame([('["A","b"]',), ("broken",), (None,), ("[]",)], "tags string")
    assert V.tagged(tags, "tags", "a").count() == 1
    events = spark.createDataFrame([(1, None, "blocked", 1), (2, "p", "blocked", 1), (3, "p", "blocked", 1)], "id long, product_uuid string, kind string, created_at int")
    assert [tuple(r) for r in V.event_counts(events, last=1).collect()] == [("p", "blocked", 1)]
    none = spark.createDataFrame([], "status string, score int")
    assert tuple(V.suggestion_totals(none).first()) == (0, 0, 0, None)
    assert [tuple(r) for r in R.tags_union(spark.createDataFrame([("p", 2, ["x", "y"]), ("p", 1, ["y"])], "k string, o int, t array<string>"), "k", "t", "o").collect()] == [("p", "y,x")]


def test_structured_data_is_parsed_and_merged(spark):
    html = """<script type="application/ld+json">not json</script><script type="application/ld+json">
      [{"@type": "Product", "sku": "", "brand": ["Un", "Deux"], "offers": {"sku": "inner", "gtin13": "4006381333931"}},
       {"@graph": [{"@type": "http://schema.org/Product", "gtin": 4006381333931, "sku": "a_b  c"}]}]</script>
      <div itemscope><span itemprop="sku">other</span><span itemprop="model"> m 1 </span></div><meta property="product:brand" content="Trois">"""
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p")], "id int, html string")
    rows = {r.id: r for r in H.identifiers(df).collect()}
    assert (rows[1].ean, rows[1].sku, rows[1].brand, rows[1].manufacturer_ref) == ("4006381333931", "A-B-C", "Un", "M-1")
    assert all(rows[i].ean is None and rows[i].brand is None for i in (2, 3, 4))
    states = {r.id: (r.availability, r.blocked_reason) for r in H.with_state(df).collect()}
    assert states[2] == ("unknown", "page quasi vide (contenu rendu côté client ?)")


def test_configuration_and_saved_states(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    text = yaml.safe_dump({"products": [{"name": "Coffret X", "site": "s", "url": "u", "check_interval": 1, "tags": [" A ", "a", ""]}]})
    (row,) = S.products_yaml(spark, text).collect()
    assert (row.uuid, row.check_interval, row.priority, row.tags) == ("s--coffret-x", 10, "normal", ["a"])
    with pytest.raises(ValueError):
        S.products_yaml(spark, yaml.safe_dump({"products": [{"name": "x"}]}))
    (tmp_path / "a.json").write_text('{"product_uuid":"p1","availability":"in_stock"}\nbroken\n{"availability":"x"}\n')
    states = S.saved_states(spark, f"{tmp_path}/a.json")
    assert [r.product_uuid for r in states.collect()] == ["p1"]
    assert S.absent_only(states, states).count() == 0


def test_discovery_settings_and_seeds(spark):
    yaml = pytest.importorskip("yaml")
    off = S.discovery_settings(None)
    assert (off["enabled"], off["mode"], off["scan_interval"], off["max_new_per_scan"], off["defaults"]["tags"]) == (False, "review", 900, 50, ["auto-découvert"])
    assert S.discovery_settings("a: [") == off and S.discovery_settings("scan_interval: often") == off
    text = yaml.safe_dump({"enabled": True, "mode": " AUTO ", "scan_interval": 5, "max_new_per_scan": 0, "rules": {"include": ["Éte ", "ete"]}, "sites": {"Shop": {"enabled": False, "depth": 2}, "b": None}, "defaults": {"check_interval": 1, "priority": "?", "tags": [" X ", ""]}})
    got = S.discovery_settings(text)
    assert (got["mode"], got["scan_interval"], got["max_new_per_scan"], got["rules"]["include"]) == ("auto", 60, 1, ["ete"])
    assert got["sites"] == {"shop": {"enabled": False, "options": {"depth": 2}}, "b": {"enabled": True, "options": {}}}
    assert got["defaults"] == {"check_interval": 10, "priority": "normal", "tags": ["x"], "enabled": True}
    some, none = spark.range(2), spark.range(0)
    assert S.seeded(none, some).count() == 2 and S.seeded(some, none).count() == 2 and S.seeded(none, none).count() == 0
