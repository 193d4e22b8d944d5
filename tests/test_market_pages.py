"""The element table and what is read of marketplace pages, on small pages."""

import pytest
from pyspark.sql import functions as F

from shelfline.functions import elements as E
from shelfline.operators import pages as G
from shelfline.sources import adapters as A

ROWS = "page_id long, url string, html string"


def pages(spark, *html):
    return spark.createDataFrame([(i, "https://www.amazon.fr/dp/B000000001", h) for i, h in enumerate(html)], ROWS)


def test_elements_are_intervals():
    found = E.listed("<div id=a><p>one<p>two</p><br><ul><li>x<li>y</ul></div><script>var t='</p>'</script>tail &amp; end")
    by = {(e["tag"], e["id"]): e for e in found["elements"]}
    div, ul = by["div", "a"], by["ul", ""]
    assert (div["n"], div["last"]) == (1, 7) and (ul["n"], ul["last"]) == (5, 7)
    lis = [e for e in found["elements"] if e["tag"] == "li"]
    assert [(e["n"], e["last"]) for e in lis] == [(6, 6), (7, 7)]
    assert [t["said"] for t in found["texts"]] == ["one", "two", "x", "y", "tail & end"]
    assert (div["first_text"], div["end_text"]) == (0, 4)
    assert E.listed(None) == {"elements": [], "texts": [], "data": []}


@pytest.mark.parametrize(
    "selector, found",
    [("#b", [2]), (".x", [1, 3]), ("#a .x", [3]), ("#a b.y", [3]), ("i[name='q.r']", [4]), ("[class*='or']", [4]), ("#s\\.t", [5]), (".x #b .y", [3]), ("#b #a", []), ("u", [5])],
)
def test_selectors(spark, selector, found):
    html = "<div id='a' class='x'><p id='b'><b class='x  y'></b></p><i name='q.r' class='word'></i></div><u id='s.t'></u>"
    read = E.with_elements(pages(spark, html)).select(F.transform(E.selected("elements", selector), lambda e: e["n"]).alias("n"))
    assert read.first().n == found


def test_narrowest_scope_goes_first(spark):
    wide = "<div id='ppd'><input id='add-to-cart-button'><div id='buybox'>{}</div></div>"
    rows = G.scope_trace(pages(spark, wide.format("<b id='availability'>x</b>"), wide.format(""), "<p>rien</p>", None), "page_id").collect()
    kept = {r.page_id: (r.label, r.identifier) for r in rows if r.retained}
    assert kept == {0: ("buy box", "div#buybox"), 1: ("fiche produit", "div#ppd"), 2: ("page entière", "html"), 3: ("page entière", "html")}
    assert {r.reason for r in rows if not r.retained} == {G.TAKEN, G.NOTHING}


def test_what_stands_in_noise_decides_nothing(spark):
    html = "<div id='buybox'><div class='a-carousel'><input id='add-to-cart-button' type='submit' value='Ajouter au panier'></div></div>" + "<p>texte calme </p>" * 20
    (row,) = G.analysed(pages(spark, html), "page_id").collect()
    assert (row.scope, row.action, row.state, row.blocked_reason) == ("page entière", "none", "unknown", "aucune action d'achat identifiée")


def test_fate_of_an_invitation(spark):
    pad, buy = "<p>texte calme </p>" * 20, "<div id='buybox'><b id='price_inside_buybox'>9,99 €</b>{}</div>"
    ask = "<button id='invite-x'>Demander une invitation</button>"
    cases = [buy.format(ask), buy.format("") + ask, buy.format("") + f"<footer>{ask}</footer>", buy.format(""), buy.format("<i>x</i>") + "<b aria-label='Request invite'></b>"]
    rows = {r.page_id: r for r in G.invitation_probes(pages(spark, *[c + pad for c in cases]), "page_id").collect()}
    assert [rows[i].used for i in range(5)] == [True, False, False, False, False]
    assert [rows[i].reason for i in range(4)] == [G.USED, G.OUTSIDE.format("buy box"), G.IN_NOISE, G.ABSENT]
    assert rows[4].markers == "request invite" and rows[4].reason == G.OUTSIDE.format("buy box")
    marks = {(r.page_id, r.place, r.fate) for r in G.invitation_marks(pages(spark, *cases), "page_id").collect()}
    assert marks == {(0, "button#invite-x", "scope"), (1, "button#invite-x", "outside"), (2, "button#invite-x", "noise"), (4, "b", "outside")}


def test_evidence_is_the_innermost_element(spark):
    html = "<div id='dp' class='c'><p class='one two three'>Sera <i>bientôt disponible</i> ici</p></div>"
    rows = G.mentions(pages(spark, html, "<div><p>Bientôt disponible, bientôt disponible</p></div>"), "page_id", ("bientot disponible",)).collect()
    assert {(r.page_id, r.carrier, r.excerpt) for r in rows} == {(0, "p.one.two > i", "bientôt disponible"), (1, "p", "Bientôt disponible, bientôt disponible")}


#: What each kind of block comes to: state, availability, evidence or reason.
KINDS = {
    0: ("available", "in_stock"), 1: ("out_of_stock", "unavailable"), 2: ("third_party_only", "in_stock"), 3: ("unknown", "unknown"), 5: ("invitation", "preorder"),
    6: ("unknown", "unknown"), 7: ("invitation", "preorder"), 8: ("captcha", "unknown"), 9: ("preorder", "preorder"), 11: ("unknown", "unknown"),
}


def test_analyses_of_all_pages(spark):
    rows = G.analysed(A.market_pages(spark, "/root/testdata/sf0.001"), "page_id").collect()
    assert len(rows) == A.table(spark, "/root/testdata/sf0.001", "pages").count()
    for r in rows:
        kind = r.page_id % len(A.MARKET_BLOCKS)
        if r.locale_blocked:
            assert (r.state, r.availability, r.blocked_reason) == ("unknown", "unknown", "contexte de livraison incorrect") and r.delivery_country != r.market_country
        elif r.downgraded:
            assert r.confidence < 60 and r.state == "unknown" and r.classified != "unknown"
        elif kind in KINDS and r.confidence is not None and (r.confidence >= 60 or KINDS[kind][0] == "unknown"):
            assert (r.state, r.availability) == KINDS[kind]
        if kind == 11 and r.state != "captcha":
            assert (r.origin, r.evidence, r.excerpt, r.variation) == ("texte du périmètre", "p.soon > i", "bientôt disponible", f"Taille {r.page_id}")
        if kind == 8:
            assert (r.state, r.scope, r.blocked_reason, r.invitation_reason) == ("captcha", None, "captcha", G.UNREADABLE)
        if kind == 2:
            assert (r.seller, r.shipped_by, r.seller_type, r.price) == (f"Boutique {r.page_id}", "Amazon", "third_party", f"1{r.page_id % 900 + 100},50 €")
    assert any(r.locale_blocked for r in rows) and any(r.downgraded for r in rows)
    probes = {r.page_id: r.reason for r in G.invitation_probes(A.market_pages(spark, "/root/testdata/sf0.001"), "page_id").collect()}
    assert all(r.invitation_reason in (probes[r.page_id], G.UNREADABLE) for r in rows)


def test_empty_table_and_walls(spark):
    assert G.analysed(spark.createDataFrame([], ROWS), "page_id").count() == 0
    pad = "<p>texte calme </p>" * 20
    cases = [None, "", "<p>court</p>", "<p>Cloudflare</p>" + pad, "<p>Saisissez les caractères</p>" + pad, pad]
    rows = {r.page_id: r for r in G.analysed(pages(spark, *cases), "page_id").collect()}
    assert [rows[i].state for i in range(6)] == ["error", "error", "error", "cloudflare", "intercepted", "unknown"]
    assert [rows[i].page_exists for i in range(6)] == [False, False, False, True, True, True]
