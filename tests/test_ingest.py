"""Ingest and merges against one listing, or one merge, after another in plain Python."""

import random

import pytest

from shelfline.functions.text import fold, name_similarity
from shelfline.functions.text import STOP_WORDS
from shelfline.operators import ingest as I
from shelfline.operators import merges as M

FIELDS = ["ean", "mpn", "asin", "manufacturer_sku", "model_number", "brand", "release_date", "collection"]
DRAFTS = "draft_id string, seq long, name string, " + ", ".join(f"{f} string" for f in FIELDS)
CATALOG = "uuid string, created_seq long, name string, " + ", ".join(f"{f} string" for f in FIELDS)
SCORES = [("ean", 100), ("mpn", 95), ("asin", 93), ("manufacturer_sku", 92), ("model_number", 88)]


def norm(name):
    return " ".join(w for w in "".join(c if c.isalnum() or c in "_ " else " " for c in fold(name)).split() if w not in STOP_WORDS)


def first_match(draft, products):
    low = lambda v: (v or "").strip().lower()
    key = lambda n: sorted(set(norm(n).split()))
    tests = [(s, f, lambda p, f=f: draft[f] and p[f] == draft[f]) for f, s in SCORES]
    tests += [
        (85, "name_brand", lambda p: low(draft["brand"]) and key(p["name"]) == key(draft["name"]) and low(p["brand"]) == low(draft["brand"])),
        (80, "name_release_date", lambda p: draft["release_date"] and p["release_date"] == draft["release_date"] and name_similarity(norm(draft["name"]), norm(p["name"])) >= 0.82),
        (75, "name_collection", lambda p: low(draft["collection"]) and low(p["collection"]) == low(draft["collection"]) and name_similarity(norm(draft["name"]), norm(p["name"])) >= 0.82),
        (70, "name_only", lambda p: key(p["name"]) == key(draft["name"])),
    ]
    for score, method, fits in tests:
        for p in products:
            if fits(p):
                return score, method, p
    return None


def one_by_one(drafts, catalog):
    products = [dict(zip(["uuid", "created_seq", "name", *FIELDS], row)) for row in sorted(catalog, key=lambda r: r[1])]
    out = []
    for row in sorted(drafts, key=lambda r: r[1]):
        d = dict(zip(["draft_id", "seq", "name", *FIELDS], row))
        hit = first_match(d, products)
        if hit and hit[0] >= 90:
            score, method, p = hit
            for f in FIELDS:
                p[f] = p[f] or d[f]
            out.append((d["draft_id"], p["uuid"], False, score, method, p["uuid"], "merge"))
        else:
            p = {"uuid": "n:" + d["draft_id"], **{k: d[k] for k in ["name", *FIELDS]}}
            products.append(p)
            out.append((d["draft_id"], p["uuid"], True, *((hit[0], hit[1], hit[2]["uuid"], "suggest") if hit else (None, None, None, "new"))))
    return sorted(out), products


@pytest.mark.parametrize("seed", range(2))
def test_ingest_is_that_of_one_listing_after_another(spark, seed):
    rng = random.Random(seed)
    some = lambda kind, n, p: f"{kind}{rng.randrange(n)}" if rng.random() < p else rng.choice([None, ""])
    names = ["Coffret Étoile rouge", "rouge coffret ETOILE", "Coffret étoile rouges", "Le jeu bleu", "jeu bleu neuf", "Grand jeu de cartes bleu"]
    facts = lambda p: [some("e", 25, p), some("m", 25, p), some("a", 25, p), some("s", 25, p), some("n", 9, 0.3), some(" B", 3, 0.4), some("2024-0", 3, 0.3), some("C", 3, 0.3)]
    catalog = [(f"p{i}", i, rng.choice(names), *facts(0.3)) for i in range(12)]
    drafts = [(f"d{i}", rng.randrange(10**6) * 1000 + i, rng.choice(names), *facts(0.35)) for i in range(60)]
    got = I.ingested(spark.createDataFrame(drafts, DRAFTS), spark.createDataFrame(catalog, CATALOG)).collect()
    want, products = one_by_one(drafts, catalog)
    assert sorted((r.draft_id, r["product"], r.created, r.score, r.method, r.candidate, r.decision) for r in got) == want
    assert {r[6] for r in want} >= {"merge", "suggest"}
    left, right = spark.createDataFrame(drafts, DRAFTS), spark.createDataFrame(catalog, CATALOG)
    after = I.products_after(left, right, I.placements(left, right), ["ean", "mpn", "brand"]).collect()
    assert {(r["product"], r.ean, r.mpn, r.brand) for r in after} == {(p["uuid"], p["ean"] or None, p["mpn"] or None, p["brand"] or None) for p in products}


def test_long_chain_of_listings(spark):
    """Each listing knows the one before it by an identifier that only that one has: as many rounds as listings."""
    drafts = [(f"d{i}", i, f"n {i}", f"e{(i + 1) // 2}", f"m{i // 2}", *[None] * 6) for i in range(10)]
    got = I.ingested(spark.createDataFrame(drafts, DRAFTS), spark.createDataFrame([], CATALOG)).collect()
    assert sorted((r.draft_id, r["product"], r.created, r.score, r.method, r.candidate, r.decision) for r in got) == one_by_one(drafts, [])[0]


def test_nothing_and_odd_names(spark):
    none = spark.createDataFrame([], DRAFTS)
    assert I.ingested(none, spark.createDataFrame([("p", 1, "a", *["x"] * 8)], CATALOG)).count() == 0
    drafts = [("d0", 1, None, *[None] * 8), ("d1", 2, "", *[" "] * 8), ("d2", 3, "le la", *[None] * 8)]
    got = {r.draft_id: r.decision for r in I.ingested(spark.createDataFrame(drafts, DRAFTS), spark.createDataFrame([], CATALOG)).collect()}
    assert got["d0"] == "new" and set(got) == {"d0", "d1", "d2"}


def test_a_product_held_by_many_is_thinned(spark):
    rows = [("v", i, (0, 100 - i), f"p{i}") for i in range(100)] + [("v", i, (0, i), f"q{i}") for i in range(50, 60)]
    facts = spark.createDataFrame(rows, "value string, since long, born struct<made:int,at:long>, product string")
    kept = I._firsts(facts, ["value"]).collect()
    assert sorted((r.since, r.born.at) for r in kept) == [(i, 100 - i) for i in range(100)]


def merged_one_by_one(merges, at):
    """Where everything that was at `at` in the beginning is after the merges."""
    for _, source, target in sorted(merges):
        if source is not None and target is not None and source != target and at == source:
            at = target
    return at


@pytest.mark.parametrize("span", [M.SPAN, 4])
def test_chains_of_merges(spark, monkeypatch, span):
    monkeypatch.setattr(M, "SPAN", span)
    rng = random.Random(2)
    merges = [(i, f"p{rng.randrange(9)}", f"p{rng.randrange(9)}") for i in range(40)] + [(50, None, "p1"), (51, "p1", None), (52, "p3", "p3")]
    merges += [(100 + i, f"c{i}", f"c{i + 1}") for i in range(9)] + [(200, "x", "y"), (201, "y", "x"), (302, "late", "c0")]
    df = spark.createDataFrame(merges, "id long, source string, target string")
    got = {r["product"]: (r.final, r.hops) for r in M.homes(df).collect()}
    for product, (final, _) in got.items():
        assert final == merged_one_by_one(merges, product)
    assert got["c0"] == ("c9", 9) and got["x"] == ("x", 2) and got["late"] == ("c0", 1)
    offers = spark.createDataFrame([("c0", "m1"), ("c9", None), ("other", "m2")], "product_uuid string, monitored_uuid string")
    assert {tuple(r) for r in M.rehomed(offers, df).collect()} == {("c9", "m1", "c9"), ("c9", None, None), ("other", "m2", "other")}


def test_fields_spread_in_the_order_of_merges(spark):
    rng = random.Random(4)
    products = [(f"p{i}", f"e{i}" if rng.random() < 0.4 else None, rng.choice([None, "", f"b{i}"])) for i in range(12)]
    merges = [(i, f"p{rng.randrange(12)}", f"p{rng.randrange(12)}") for i in range(30)]
    known = {p: {"ean": e or None, "brand": b or None} for p, e, b in products}
    for _, source, target in merges:
        if source != target:
            for f in ("ean", "brand"):
                known[target][f] = known[target][f] or known[source][f]
    got = M.learnt(spark.createDataFrame(products, "uuid string, ean string, brand string"), spark.createDataFrame(merges, "id long, source string, target string"), ["ean", "brand"])
    assert {(r["product"], r.field): r.value for r in got.collect()} == {(p, f): v for p, own in known.items() for f, v in own.items() if v}


def test_listings_of_one_number_come_one_after_another(spark):
    drafts = [(f"d{i}", 5, "x", "E1", ["M1", None, None][i], None, None, None, None, None, None) for i in (2, 0, 1)]
    catalog = [("p1", 1, "y", *[None] * len(FIELDS))]
    arrived = spark.createDataFrame(drafts, DRAFTS)
    got = {r.draft_id: (r.product, r.score) for r in I.placements(arrived, spark.createDataFrame(catalog, CATALOG)).collect()}
    assert got == {"d0": ("n:d0", None), "d1": ("n:d0", 100), "d2": ("n:d0", 100)}


def test_a_long_chain_takes_few_passes(spark, monkeypatch):
    """Listings that depend on each other in a row are written a few times, not once for each link of the chain.

    Only numbers of keys are written in rounds.
    """
    drafts = [(f"d{i:02}", i, f"n {i}", f"e{(i + 1) // 2}", f"m{i // 2}", *[None] * 6) for i in range(24)]
    written, plain = [], I.stored
    monkeypatch.setattr(I, "stored", lambda df, kind: written.append(kind) or plain(df, kind))
    got = I.placements(spark.createDataFrame(drafts, DRAFTS), spark.createDataFrame([], CATALOG)).collect()
    assert sorted((r.draft_id, r["product"], r.score, r.method) for r in got) == [(w[0], w[1], *((w[3], w[4]) if w[6] == "merge" else (None, None))) for w in one_by_one(drafts, [])[0]]
    assert len([kind for kind in written if not kind.startswith("key-")]) <= 5, written


@pytest.mark.parametrize("most", [0, 3])
def test_groups_too_large_for_a_task_are_placed_alike(spark, monkeypatch, most):
    rng = random.Random(7)
    some = lambda kind: rng.choice([None, "", *[f"{kind}{rng.randrange(12)}"] * 2])
    drafts = [(f"d{i}", rng.randrange(10**6) * 100 + i, "n", some("e"), some("m"), some("a"), some("s"), *[None] * 4) for i in range(25)]
    catalog = [(f"p{i}", i, "n", some("e"), some("m"), some("a"), some("s"), *[None] * 4) for i in range(5)]
    left, right = spark.createDataFrame(drafts, DRAFTS), spark.createDataFrame(catalog, CATALOG)
    whole = sorted(map(str, I.placements(left, right).collect()))
    monkeypatch.setattr(I, "MOST_FOLDED", most)
    assert sorted(map(str, I.placements(left, right).collect())) == whole
