"""Queries over listings, detail tables and second readings: literal pages, dealt to the parts in turn.

The SQL states for each form of page the rows that have to come of it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.functions import listing as L
from shelfline.functions import purchase as P
from shelfline.plans.market import _forms, _literal
from shelfline.plans.register import query


def _rows(forms: int, expected: list[tuple], *names: str) -> str:
    """Expected rows (number of the form, values of `names`) for every part that has the form."""
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in expected)
    return f"SELECT p_partkey AS key, e.* EXCLUDE (form) FROM part JOIN (VALUES {values}) e(form, {', '.join(names)}) ON p_partkey % {forms} = form"


_EMPTY, _CART, _SOON = "<p>Chargement</p>", "<button>Ajouter au panier</button><i class='price'>9,99 €</i>", "<button>Bientôt disponible</button>"
# status, source, page, page as rendered / availability, action, price, read twice
READ = [
    ((200, "http", _CART, _SOON), ("in_stock", "add_to_cart", "9,99 €", False)),
    ((200, "http", _EMPTY, _CART), ("in_stock", "add_to_cart", "9,99 €", True)),
    ((200, "http", _EMPTY, _EMPTY), ("unknown", "none", None, True)),
    ((200, "browser", _EMPTY, _CART), ("unknown", "none", None, False)),
    ((200, "http", _EMPTY, None), ("unknown", "none", None, False)),
    ((404, "http", _CART, _CART), ("not_listed", None, None, False)),
    ((None, "http", None, _CART), ("not_listed", None, None, False)),
]


@query("", _rows(len(READ), [(i, *e) for i, (_, e) in enumerate(READ)], "availability", "action", "price", "browser_fallback"))
def second_readings(spark, d):
    return L.twice_read(_forms(spark, d, [i for i, _ in READ], "status", "source", "html", "rendered"))


_WISH = "<div id='wishlist-box'><button>Ajouter au panier</button></div>"
# page / action, label, origin, controls passed over, why, controls read
OFFERS = [
    ("<div id='availability'><span>Actuellement indisponible</span></div><input id='add-to-cart-button' type='submit' value='Ajouter au panier'>", ("currently_unavailable", "actuellement indisponible", "bloc disponibilité", 0, "", 1)),
    ("<span id='hdp-invite-button'><button id='x'></button></span><span id='hdp-invite-button-announce'>Demander une invitation</span>", ("request_invite", "Demander une invitation", "contrôle d'achat", 0, "", 1)),
    (_WISH + "<a href='#'>Livrer à Paris</a><button>Précommander cet article</button>", ("preorder", "Précommander cet article", "libellé de contrôle", 2, "liste d'envies, adresse de livraison", 3)),
    (_WISH + "<div id='availability'>Il ne reste plus que 2 exemplaires</div>", ("add_to_cart", "il ne reste plus que", "bloc disponibilité", 1, "liste d'envies", 1)),
    ("<p>Cet article sera bientôt disponible</p>", ("coming_soon", "bientot disponible", "texte du périmètre", 0, "", 0)),
    ("<div id='addToCart'><input type='submit'></div>", ("add_to_cart", "(libellé illisible)", "contrôle d'achat", 0, "", 1)),
    ("<div class='sponsored'><form><input name='submit.buy-now' type='submit' value='Buy now'></form></div>", ("none", None, None, 1, "produit sponsorisé", 1)),
    ("<div class='share'><b id='one-click-button'></b></div>", ("add_to_cart", "(bouton d'achat sans libellé lisible)", "buy box", 0, "", 0)),
    ("<div id='availability'>Temporairement en rupture de stock.</div>", ("temporarily_unavailable", "temporairement en rupture de stock", "bloc disponibilité", 0, "", 0)),
    ("<input id='add-to-cart-button' type='submit' value='Précommander'><a>Essayez Prime</a>", ("preorder", "Précommander", "contrôle d'achat", 1, "Prime", 2)),
    (None, ("none", None, None, 0, "", 0)),
]


@query("", _rows(len(OFFERS), [(i, *e) for i, (_, e) in enumerate(OFFERS)], "action", "label", "origin", "ignored", "ignored_reasons", "examined"))
def purchase_actions(spark, d):
    return P.with_action(_forms(spark, d, [(html,) for html, _ in OFFERS], "html"))
