"""What single texts and addresses of marketplaces have to be read as."""

from pyspark.sql import functions as F

from shelfline.functions import html as H
from shelfline.functions import market as M
from shelfline.functions import text as X

URLS = [
    ("https://WWW.amazon.fr/Coffret-Rare/dp/b0abcdefgh/ref=x?th=1#top", "B0ABCDEFGH", "https://www.amazon.fr/dp/B0ABCDEFGH", "amazon.fr", "https://WWW.amazon.fr/Coffret-Rare/dp/b0abcdefgh/ref=x?th=1&language=fr_FR#top"),
    ("http://amazon.co.uk/gp/product/B012345678", "B012345678", "http://amazon.co.uk/dp/B012345678", "amazon.co.uk", "http://amazon.co.uk/gp/product/B012345678?language=en_GB"),
    ("https://www.amazon.de/s?k=x&asin=B0DE345678", "B0DE345678", "https://www.amazon.de/dp/B0DE345678", "amazon.de", "https://www.amazon.de/s?k=x&asin=B0DE345678&language=de_DE"),
    ("https://www.amazon.com/dp/SHORT?language=es_US", None, "https://www.amazon.com/dp/SHORT", "amazon.com", "https://www.amazon.com/dp/SHORT?language=es_US"),
    ("https://notamazon.fr/dp/B0ABCDEFGH", "B0ABCDEFGH", "https://notamazon.fr/dp/B0ABCDEFGH", None, "https://notamazon.fr/dp/B0ABCDEFGH?language=fr_FR"),
]
AMOUNTS = [
    ("Prix : 1 299,99 € le 21/08/2026", "1299,99 €", "EUR", "2026-08-21"), ("$45.50, release 2026-08-21 or 1.2.2020", "45,50 €", "USD", "2026-08-21"),
    ("£9.99 on 3-4-2025", "9,99 €", "GBP", "2025-04-03"), ("12 345 678,00€", "12345678,00 €", "EUR", None), ("sans prix 12 €", None, "EUR", None), ("", None, None, None),
]
LABELS = [
    ("Livrer à France", "FR"), ("Deliver to : Belgium", "BE"), ("Livraison à 75001 Paris", "FR"), ("Livrer à 75001 Deutschland", "DE"), ("Mettre à jour la position", None),
    ("Livraison en États-Unis", "US"), ("vers le Japon demain", "JP"), ("Francfort", None), ("99999 Ailleurs", None), ("  Österreich ", "AT"),
]
SELLERS = [
    ("Vendu par : Amazon Amazon Expédié par Autre", "Amazon", False), ("vendu par Boutique du Coin | Paris", "Boutique du Coin", True), ("Ajouter au panier", None, True),
    ("QWxhZGRpbjpvcGVuIHNlc2FtZQ==", None, False), ("x", None, False), ("Vendu par   ", None, True), ("12 34", None, False), ("pfff", None, False),
]
STATES = [
    (("add_to_cart", "Amazon", True, 80, "FR"), ("available", "official", "available", None, "in_stock")),
    (("buy_now", "Revendeur", False, 100, "FR"), ("third_party_only", "third_party", "third_party_only", None, "in_stock")),
    (("request_invite", None, False, 60, None), ("invitation", "unknown", "invitation", None, "preorder")),
    (("add_to_cart", "Amazon", True, 40, "FR"), ("available", "official", "unknown", "confidence", "in_stock")),
    (("preorder", "", False, 80, "US"), ("preorder", "unknown", "unknown", "locale", "preorder")),
    (("none", None, False, 80, "FR"), ("unknown", "unknown", "unknown", "unknown", "unknown")),
    (("discontinued", None, False, 80, "FR"), ("unavailable", "unknown", "unavailable", None, "unavailable")),
]
WALLS = [("<p>Cloudflare</p>", "x" * 300, "cloudflare"), ("<form action='/ValidateCaptcha'>", "x" * 300, "captcha"), ("<p>ok</p>", "x" * 300, None), ("<p>ok</p>", "x", "error")]
SLUGS = [("Coffret Étoile n°3 !", "coffret_etoile_n3", "mon-coffret_rare", "Mon Coffret Rare"), ("!!!", "produit", "a", "A"), ("ÀÉ-ß", "ae", "", ""), ("x" * 70, "x" * 60, "--b--", "B")]
SITEMAP = "<urlset><url><loc> https://a/1 </loc></url><url><loc>https://a/2</loc></url><loc></loc></urlset>"


def read(spark, rows, kinds, *columns):
    """The columns over `rows`, in their order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at int, " + kinds)
    return [tuple(r)[1:] for r in sorted(df.select("at", *columns).collect())]


def test_addresses(spark):
    url = F.col("url")
    assert read(spark, [r[:1] for r in URLS], "url string", M.asin(url), M.article_url(url), M.market(url, 0), M.with_language(url)) == [r[1:] for r in URLS]


def test_amounts_and_dates(spark):
    text = F.col("text")
    assert read(spark, [r[:1] for r in AMOUNTS], "text string", M.amount(text), M.currency(text), M.iso_date(text)) == [r[1:] for r in AMOUNTS]


def test_destinations(spark):
    assert read(spark, [r[:1] for r in LABELS], "label string", M.destination(X.normalise(F.col("label")))) == [r[1:] for r in LABELS]


def test_sellers_and_labels(spark):
    text = F.col("text")
    readable = M.readable(F.when(text.startswith("Vendu par : "), "dcf5").otherwise(text))
    assert read(spark, [r[:1] for r in SELLERS], "text string", M.seller(text, "vendu par"), readable) == [r[1:] for r in SELLERS]


def test_states(spark):
    state = M.native_state(F.col("action"), F.col("seller"), F.col("official"))
    guarded = M.guarded(state, F.col("confidence"), F.col("country"), F.lit("FR"))
    elsewhere = F.coalesce(F.col("country") != "FR", F.lit(False))
    reason = M.blocked_reason(F.lit(None).cast("string"), elsewhere, F.col("confidence"), state)
    found = read(spark, [i for i, _ in STATES], "action string, seller string, official boolean, confidence int, country string", state, M.seller_type(F.col("seller"), F.col("official")), guarded, reason)
    assert found == [e[:4] for _, e in STATES] and all(H.AVAILABILITY.get(i[0], "unknown") == e[4] for i, e in STATES)


def test_walls_slugs_and_site_maps(spark):
    assert read(spark, [w[:2] for w in WALLS], "html string, text string", M.blocked(F.col("html"), F.col("text"))) == [w[2:] for w in WALLS]
    assert read(spark, [s[:1] + s[2:3] for s in SLUGS], "value string, path string", X.slugify(F.col("value")), X.title_from_url(F.col("path"))) == [(s[1], s[3]) for s in SLUGS]
    assert read(spark, [(SITEMAP,)], "body string", H.sitemap_urls(F.col("body"))) == [(["https://a/1", "https://a/2"],)]
