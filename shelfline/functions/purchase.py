"""What a marketplace page lets a buyer do: one action, by six sources in order.

In Python: the controls of a page with their labels and surroundings, the texts of availability and of the page.
Which controls are passed over and which source decides are Column expressions.  The whole page is the scope
unless another is named.
A null page is an empty one: no action.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions import text as X
from shelfline.functions.listing import _Node, _Tree, classes

#: Folded words of each kind.
INVITATION = (
    "demande d'invitation", "demander une invitation", "disponible sur invitation", "request an invite", "request invite", "available by invitation",
    "vous avez ete invite", "invitation acceptee",
)
PREORDER = ("precommander", "precommande", "pre-commander", "pre-order", "preorder", "reserver maintenant")
COMING_SOON = ("bientot disponible", "prochainement disponible", "coming soon", "pas encore disponible a la vente")
ADD_TO_CART = ("ajouter au panier", "ajouter dans le panier", "add to cart", "add to basket")
BUY_NOW = ("acheter maintenant", "acheter cet article", "buy now")
IN_STOCK = ("en stock", "in stock", "il ne reste plus que", "only")
NOTIFY_ME = ("prevenez-moi", "previens-moi", "me prevenir", "m'alerter", "alertez-moi", "email me when available", "notify me")
TEMPORARY = ("temporairement en rupture de stock", "temporairement indisponible", "temporarily out of stock")
OUT_OF_STOCK = (
    "temporairement en rupture de stock", "temporairement indisponible", "actuellement indisponible", "rupture de stock", "en rupture", "currently unavailable",
    "temporarily out of stock", "out of stock", "nous ne savons pas quand cet article sera de nouveau approvisionne",
)
UNAVAILABLE = ("cet article n'est pas disponible", "produit non disponible", "n'est plus disponible", "no longer available", "this item is not available", "indisponible")
#: Labels that never decide, and why.
EXCLUDED_LABELS = (
    ("ajouter a votre liste", "liste d'envies"), ("ajouter a une liste", "liste d'envies"), ("liste d'envies", "liste d'envies"),
    ("liste de souhaits", "liste d'envies"), ("add to list", "liste d'envies"), ("add to wish list", "liste d'envies"),
    ("liste de naissance", "liste d'envies"), ("adresse de livraison", "adresse de livraison"), ("mettre a jour la position", "adresse de livraison"),
    ("mettre a jour l'emplacement", "adresse de livraison"), ("choisir le lieu de livraison", "adresse de livraison"), ("livrer a", "adresse de livraison"),
    ("select delivery location", "adresse de livraison"), ("essayez prime", "Prime"), ("essai gratuit de prime", "Prime"), ("adherer a prime", "Prime"),
    ("try prime", "Prime"), ("payer en plusieurs fois", "financement"), ("paiement en plusieurs fois", "financement"), ("en 4 fois", "financement"),
    ("financement", "financement"), ("garantie", "garantie / assurance"), ("plan de protection", "garantie / assurance"),
    ("assurance", "garantie / assurance"), ("installation", "service annexe"), ("partager", "partage"), ("comparer", "comparaison"),
    ("voir les avis", "avis clients"), ("poser une question", "questions/réponses"), ("signaler", "signalement"),
    ("voir les options d'achat", "renvoi vers les autres vendeurs"), ("autres vendeurs sur amazon", "renvoi vers les autres vendeurs"),
    ("see all buying options", "renvoi vers les autres vendeurs"), ("retours gratuits", "politique de retour"),
    ("retourner cet article", "politique de retour"), ("en savoir plus", "lien d'information"), ("politique de confidentialite", "mentions légales"),
)
#: Parts of the names of a control, or of what it stands in, that keep it from deciding.
EXCLUDED_NAMES = (
    ("wishlist", "liste d'envies"), ("wish-list", "liste d'envies"), ("add-to-registry", "liste d'envies"), ("registry", "liste d'envies"),
    ("glow", "adresse de livraison"), ("contextualingress", "adresse de livraison"), ("delivery-block", "adresse de livraison"),
    ("nav-global-location", "adresse de livraison"), ("prime", "Prime"), ("installment", "financement"), ("financ", "financement"),
    ("warranty", "garantie / assurance"), ("protection-plan", "garantie / assurance"), ("mbb-", "garantie / assurance"), ("share", "partage"),
    ("comparison", "comparaison"), ("askatf", "questions/réponses"), ("customer-reviews", "avis clients"),
    ("see-all-buying-choices", "renvoi vers les autres vendeurs"), ("sp-sponsored", "produit sponsorisé"), ("sponsored", "produit sponsorisé"),
)
#: Which words mean which action, in order, for each source.
IN_LABELS = ((INVITATION, "request_invite"), (PREORDER, "preorder"), (NOTIFY_ME, "notify_me"), (ADD_TO_CART, "add_to_cart"), (BUY_NOW, "buy_now"))
BLOCKING = (*IN_LABELS[:3], (TEMPORARY, "temporarily_unavailable"), (OUT_OF_STOCK, "currently_unavailable"), (UNAVAILABLE, "discontinued"))
POSITIVE = (*IN_LABELS[3:], (IN_STOCK, "add_to_cart"), (COMING_SOON, "coming_soon"))
IN_PAGE = (*IN_LABELS[:2], (OUT_OF_STOCK, "currently_unavailable"), (COMING_SOON, "coming_soon"), (UNAVAILABLE, "currently_unavailable"))
#: Elements that decide by their own names, in order; the words of their labels go before the action here.
CONTROL_IDS = ("hdp-invite-button", "hdp-invite-button-announce", "add-to-cart-button", "buy-now-button", "one-click-button", "outOfStockBuyBox", "outOfStock", "submit.add-to-cart")
CONTROL_NAMES = ("submit.add-to-cart", "submit.buy-now")
#: How many elements around a control can exclude it, how many links or buttons and how many inputs are read, and the longest label.
AROUND, MOST_CONTROLS, LONGEST = 6, 200, 80

CONTROL = T.StructType(
    [
        T.StructField("at", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("label", T.StringType()), T.StructField("folded", T.StringType()), T.StructField("plain", T.StringType()),
        T.StructField("names", T.ArrayType(T.StringType())), T.StructField("in_cart_form", T.BooleanType()), T.StructField("listed", T.BooleanType()),
    ]
)
PAGE = T.StructType([T.StructField("controls", T.ArrayType(CONTROL)), T.StructField("stock", T.ArrayType(T.StringType())), T.StructField("page", T.StringType())])


def words(text: str | None) -> str:
    return " ".join((text or "").split())


def names_of(node: _Node) -> str:
    a = node.attrs
    return X.fold(" ".join(filter(None, (a.get("id"), a.get("name"), words(a.get("class")), a.get("data-component-type")))))


def around(node: _Node) -> list[str]:
    """Folded names of a control, then of the elements it stands in, up to the page's body."""
    found, above = [names_of(node)], node.parent
    while above is not None and len(found) <= AROUND and above.tag not in ("", "body", "html"):
        found.append(names_of(above))
        above = above.parent
    return found


def offered(html: str | None, scope: int = 0, gone: Iterable[int] = ()) -> dict:
    """Controls of a page (links and buttons, then inputs, then other elements that names make controls) and its texts.

    Only what stands inside element number `scope` (0: the page) and in none of the elements `gone`.
    """
    tree = _Tree(html)
    left = [True] * len(tree.nodes)
    for n in (tree.nodes[i] for i in gone):
        left[n.inside : n.last[0]] = [False] * (n.last[0] - n.inside)
        tree.texts[n.first : n.last[1]] = [""] * (n.last[1] - n.first)
    top = tree.nodes[scope]
    nodes = [n for n in tree.nodes if left[n.inside] and (not scope or top.inside < n.inside < top.last[0])]
    by_id: dict[str, _Node] = {}
    for n in nodes:
        by_id.setdefault(n.attrs.get("id", ""), n)
    inputs = [n for n in nodes if n.tag == "input" and n.attrs.get("type", "").lower() in ("submit", "button")]
    listed = [n for n in nodes if n.tag in ("a", "button")][:MOST_CONTROLS] + inputs[:MOST_CONTROLS]
    known = {n.inside for n in listed}
    named = lambda n: "invit" in n.attrs.get("id", "") or n.attrs.get("id") in CONTROL_IDS or n.attrs.get("name") in CONTROL_NAMES
    controls = []
    for n in [*listed, *(n for n in nodes if n.inside not in known and named(n))]:
        own, a = ("" if n.tag == "input" else tree.text(n)), n.attrs
        twin = by_id.get(f"{a['id']}-announce") if a.get("id") else None
        said = (a.get("value") if n.tag == "input" else None, a.get("aria-label"), own, tree.text(twin) if twin else None)
        label = next((w for w in map(words, said) if w), "")[:LONGEST]
        plain = words((a.get("value") if n.tag == "input" else own) or a.get("aria-label"))
        above, in_form = n.parent, False
        while above is not None and not in_form:
            in_form, above = above.attrs.get("id") == "addToCart", above.parent
        controls.append(
            {
                "tag": n.tag, "id": a.get("id", ""), "name": a.get("name", ""), "label": label, "folded": X.fold(label), "plain": X.fold(plain),
                "names": around(n), "in_cart_form": in_form and n.tag == "input" and a.get("type") == "submit", "listed": n.inside in known, "at": n.inside,
            }
        )
    stock = [X.fold(tree.text(n)) for wanted in ("availability", "outOfStock") for n in nodes if n.attrs.get("id") == wanted]
    return {"controls": controls, "stock": stock, "page": X.fold(tree.text(top))}


@F.pandas_udf(PAGE)
def page_offer(pages: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    return X.in_steps(pages, lambda *columns: pd.DataFrame([offered(*row) for row in zip(*columns)], columns=PAGE.fieldNames()))


def holds(text: Column, words_: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words_)), lambda w: F.contains(text, w))


def _reason(text: Column, table: tuple) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(part)), why) for part, why in table])


def _decided(action: Column, label: Column, origin: str) -> Column:
    return F.when(action.isNotNull(), F.struct(action.alias("action"), label.alias("label"), F.lit(origin).alias("origin")))


def _from_texts(texts: Column, table: tuple, origin: str) -> Column:
    """The first words of the table that any of the texts holds."""
    found = []
    for words_, action in table:
        said = F.flatten(F.transform(texts, lambda t: F.filter(F.array(*map(F.lit, words_)), lambda w: F.contains(t, w))))
        found.append(_decided(F.when(F.size(said) > 0, action), F.get(said, 0), origin))
    return F.coalesce(*found)


def _by_label(folded: Column) -> Column:
    return F.coalesce(*[F.when(holds(folded, words_), action) for words_, action in IN_LABELS])


def _whitelist() -> list:
    """(which controls, action) of each deciding element, in order."""
    by_id = lambda x: lambda c: c["id"] == x
    by_name = lambda x: lambda c: (c["tag"] == "input") & (c["name"] == x)
    part = lambda x: lambda c: F.contains(c["id"], F.lit(x))
    return [
        (by_id("hdp-invite-button"), "request_invite"), (by_id("hdp-invite-button-announce"), "request_invite"),
        (lambda c: c["id"].startswith("hdp-invite"), "request_invite"), (part("invite-button"), "request_invite"),
        (part("invitationRequest"), "request_invite"), (part("invite"), "request_invite"), (by_id("add-to-cart-button"), "add_to_cart"),
        (by_name("submit.add-to-cart"), "add_to_cart"), (lambda c: c["in_cart_form"], "add_to_cart"), (by_id("buy-now-button"), "buy_now"),
        (by_name("submit.buy-now"), "buy_now"), (by_id("one-click-button"), "buy_now"), (by_id("outOfStockBuyBox"), "currently_unavailable"),
        (by_id("outOfStock"), "currently_unavailable"),
    ]


def with_action(pages: DataFrame, scope: Column | None = None, gone: Column | None = None, carried: tuple[str, ...] = ("key",)) -> DataFrame:
    """`pages` (html) to the columns `carried`, action, label, origin, ignored, ignored_reasons, examined.

    `scope` is the number of the element that is read (the page where it isn't given), `gone` those that are left out.

    Sources in order: words of availability that block, deciding elements, labels of other controls, words of
    availability that sell, words of the page, a buy button nobody can read.  Controls that their names, their
    surroundings or (beyond deciding elements) their labels exclude never decide; they are counted with reasons.
    """
    scope = F.lit(0) if scope is None else scope
    gone = F.array().cast("array<int>") if gone is None else gone
    read = pages.select(*carried, page_offer("html", scope, gone).alias("p"))
    by_names = lambda c: F.get(F.filter(F.transform(c["names"], lambda n: _reason(n, EXCLUDED_NAMES)), lambda r: r.isNotNull()), 0)
    judged = F.transform("p.controls", lambda c: F.struct(c.alias("c"), by_names(c).alias("why")))
    read = read.select(*carried, F.col("p.stock").alias("stock"), F.array("p.page").alias("page"), judged.alias("all"))
    free = F.lit(None).cast("string")
    deciding = []
    for fits, action in _whitelist():
        first = F.array_min(F.filter("all", lambda x: fits(x["c"])))
        label = F.when(first["c"]["label"] == "", "(libellé illisible)").otherwise(first["c"]["label"])
        allowed = first.isNotNull() & first["why"].isNull()
        deciding.append(_decided(F.when(allowed, F.coalesce(_by_label(first["c"]["folded"]), F.lit(action))), label, "contrôle d'achat"))
    listed = F.filter("all", lambda x: x["c"]["listed"])
    speaking = F.get(F.filter(listed, lambda x: x["why"].isNull() & _reason(x["c"]["folded"], EXCLUDED_LABELS).isNull() & _by_label(x["c"]["folded"]).isNotNull()), 0)
    buys = F.exists(
        "all", lambda x: x["c"]["id"].isin("add-to-cart-button", "buy-now-button", "submit.add-to-cart", "one-click-button") | ((x["c"]["tag"] == "input") & (x["c"]["name"] == "submit.add-to-cart")) | x["c"]["in_cart_form"]
    )
    found = F.coalesce(
        _from_texts(F.col("stock"), BLOCKING, "bloc disponibilité"), *deciding,
        _decided(_by_label(speaking["c"]["folded"]), speaking["c"]["label"], "libellé de contrôle"),
        _from_texts(F.col("stock"), POSITIVE, "bloc disponibilité"), _from_texts(F.col("page"), IN_PAGE, "texte du périmètre"),
        _decided(F.when(buys, "add_to_cart"), F.lit("(bouton d'achat sans libellé lisible)"), "buy box"),
        F.struct(F.lit("none").alias("action"), free.alias("label"), free.alias("origin")),
    )
    reasons = F.filter(F.transform(listed, lambda x: F.coalesce(x["why"], _reason(x["c"]["plain"], EXCLUDED_LABELS))), lambda r: r.isNotNull())
    return read.select(*carried, found.alias("f"), reasons.alias("r"), F.size(listed).alias("examined")).select(
        *carried, "f.action", "f.label", "f.origin", F.size("r").alias("ignored"), F.array_join(F.array_distinct("r"), ", ").alias("ignored_reasons"), "examined"
    )


def confidence(*signs: Column) -> Column:
    """20 points for each sign of a readable product page: price, button, buy box, title, structured data."""
    return sum((F.when(s, 20).otherwise(0) for s in signs), F.lit(0))
