"""What a marketplace page says, read in the narrowest block that can decide it, with the trace of how.

Works on element tables (`shelfline.functions.elements`): noise is cut out as intervals, the scope is the first
container that holds something to decide by, evidence is the innermost element around a text, and the fate of an
invitation is where its interval ends up.  All of it is Column expressions over a page's own arrays.

Null pages are empty ones: no elements, the whole page as the scope, nothing found.  Repeated rows are read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import elements as E
from shelfline.functions import html as H
from shelfline.functions import market as M
from shelfline.functions import purchase as P

#: Containers from the narrowest to the widest, and what each is called.
SCOPES = (
    ("buy box", "#desktop_buybox"), ("buy box", "#buybox"), ("buy box", "#qualifiedBuybox"), ("buy box", "#buyBoxAccordion"),
    ("bloc achat", "#rightCol"), ("bloc achat", "#addToCart_feature_div"), ("bloc achat", "#desktop_qualifiedBuyBox"),
    ("fiche produit", "#ppd"), ("fiche produit", "#dp-container"), ("fiche produit", "#centerCol"), ("fiche produit", "#dp"),
)
#: Blocks that change while the product doesn't.
NOISE = (
    "#navbar", "#nav-main", "#navFooter", "footer", "header", "#sp-cc", "#sp-cc-banner", "[data-cel-widget*='cookie']", "#similarities_feature_div",
    "#sims-consolidated-1_feature_div", "#sims-consolidated-2_feature_div", "#purchase-sims-feature", "[class*='sponsored']",
    "[data-component-type='sp-sponsored-result']", "[id*='sponsored']", "[class*='carousel']", "[class*='Carousel']", "#ask-btf_feature_div",
    "#askATFLink", "#customer-reviews_feature_div", "#reviewsMedley", "#cr-dp-summarization-attributes", "#promotions_feature_div",
    "#applicable_promotion_list_sec", "#prime-ad-container", "[id*='prime-benefit']", "#rhf", "#rhf-container",
    "#HLCXComparisonWidget_feature_div", "#dp-ads-center-promo_feature_div", "#va-related-videos-widget",
)
#: Where a page says what can be bought, whether there is any, what it costs, what it is, and who sells it.
BUY = ("#add-to-cart-button", "#buy-now-button", "#submit\\.add-to-cart", "#one-click-button", "input[name='submit.add-to-cart']", "#addToCart input[type='submit']")
STOCK = ("#availability", "#outOfStock", "#availability span")
PRICE = (
    "#corePrice_feature_div .a-offscreen", "#corePriceDisplay_desktop_feature_div .a-offscreen", ".priceToPay .a-offscreen", "#price_inside_buybox",
    "#newBuyBoxPrice", ".a-price .a-offscreen",
)
TITLE = ("#productTitle", "#title span", "h1#title")
MERCHANT = ("#merchant-info", "#sellerProfileTriggerId", "#tabular-buybox", "#fulfillerInfoFeature_feature_div", "#merchantInfoFeature_feature_div")
VARIATION = (
    "#variation_style_name .selection", "#variation_size_name .selection", "#variation_color_name .selection", ".swatchSelect .a-size-base",
    "#inline-twister-expanded-dimension-text-style_name",
)
DELIVERY = (
    "#glow-ingress-line2", "#contextualIngressPtLabel_deliveryShortLine", "#nav-global-location-slot #glow-ingress-line2", "#glow-ingress-block",
    "#nav-global-location-slot", "[data-csa-c-slot-id='nav-global-location-slot']", "#deliveryBlockMessage", "#mir-layout-DELIVERY_BLOCK",
)
#: Folded words before sellers and senders, at the start of rows that name an edition, and of robot walls.
SOLD_BY, SHIPPED_BY = ("vendu par", "sold by", "vendeur"), ("expedie par", "ships from", "livre par")
EDITION = ("edition", "format", "plateforme", "platform")
BOT_WALL = (
    "saisissez les caracteres", "enter the characters you see", "pour continuer, veuillez", "type the characters",
    "sorry, we just need to make sure you're not a robot", "desole, il faut que nous nous assurions", "api-services-support@amazon.com",
    "identifiez-vous pour continuer",
)
#: What is said of a candidate, of an invitation, and of a native state.
WHOLE = "page entière"
HELD, TAKEN, NOTHING = "premier bloc contenant de quoi décider : ", "un bloc plus étroit a déjà été retenu", "ni bouton d'achat, ni disponibilité, ni prix"
FALLBACK = "aucun bloc d'achat exploitable — repli sur la page entière"
ABSENT = "absent du DOM"
USED = "retenu : c'est lui qui fixe l'état"
IN_NOISE = "retiré avec le bruit avant analyse (carrousel, recommandations, produits sponsorisés, navigation ou pied de page)"
OUTSIDE = "présent dans la page mais hors du périmètre retenu ({}) — il appartient à un autre bloc"
UNREAD = "dans le périmètre retenu, mais aucun mot-clé d'invitation reconnu à la classification (libellé inconnu ?)"
UNREADABLE = "page non analysée (contenu non exploitable)"
STATE_LABELS = {
    "available": "disponible", "invitation": "demande d'invitation", "preorder": "précommande", "coming_soon": "bientôt disponible",
    "out_of_stock": "temporairement en rupture", "unavailable": "indisponible", "third_party_only": "revendeur tiers uniquement",
    "intercepted": "page d'interception", "captcha": "captcha", "cloudflare": "protection Cloudflare", "error": "page en erreur", "unknown": "état indéterminé",
}
BLOCKING = ("intercepted", "captcha", "cloudflare")
#: Locations that are told, and the lengths of notes.
MOST_PLACES, NOTE, NAME = 5, 120, 80
LEAST_CONFIDENCE = 60

_EVERYTHING = (1 << 31) - 1


def _first_text(where: str, texts: str, selectors: tuple[str, ...], scope: str | None = None) -> Column:
    """The text, else the value, of the first element of each selector; of these the first that isn't empty."""
    said = []
    for s in selectors:
        found = E.selected(where, s)
        first = F.get(F.filter(found, lambda x: E.inside(x, F.col(scope))) if scope else found, 0)
        value = lambda e: F.trim(F.regexp_replace(e["value"], r"\s+", " "))
        text = E.let(first, lambda e: E.let(E.text_of(e, texts), lambda t: F.when(t == "", value(e)).otherwise(t)))
        said.append(E.let(text, lambda t: F.when(t != "", t)))
    return F.coalesce(*said)


def _texts_in(where: str, texts: str, selectors: tuple[str, ...], scope: str | None) -> Column:
    """(selector, text) of all elements of each selector, without the empty ones."""
    each = []
    for s in selectors:
        found = E.selected(where, s)
        found = F.filter(found, lambda x: E.inside(x, F.col(scope))) if scope else found
        each.append(F.transform(found, lambda e: F.struct(F.lit(s).alias("selector"), E.text_of(e, texts).alias("text"))))
    return F.filter(F.concat(*each), lambda x: x["text"] != "")


def _cleaned(pages: DataFrame) -> DataFrame:
    """`pages` (html) with elements, texts, data, noise, and alive and said: the elements and texts outside the noise."""
    read = E.with_elements(pages).withColumn("noise", E.held(F.filter("elements", lambda e: _any([E.fits(E.steps(s)[0], e) for s in NOISE]))))
    alive, said = E.without("elements", "texts", "noise")
    return read.withColumns({"alive": E.held(alive), "said": E.held(said)})


def with_scope(pages: DataFrame) -> DataFrame:
    """`pages` (html) with elements, texts, noise, alive, said, candidates, scope and scope_label.

    alive and said are the elements and texts outside the noise.  candidates are the containers met, narrowest kind
    first, with the selectors of what decides in them; the scope is the first that has any, else the whole page.
    """
    decisive = [*BUY, *STOCK, *PRICE]
    read = _cleaned(pages)
    found = [F.transform(E.selected("alive", s), lambda e: F.struct(F.lit(k).alias("k"), e["n"].alias("n"))) for k, s in enumerate(decisive)]
    met = [F.transform(E.selected("alive", s), lambda e: F.struct(F.lit(label).alias("label"), F.lit(s).alias("selector"), e.alias("e"))) for label, s in SCOPES]
    read = read.withColumns({"__found": E.held(F.concat(*found)), "__met": E.held(F.concat(*met))})
    names = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(decisive)])

    def judged(c: Column, place: Column) -> Column:
        has = lambda s: F.exists("__found", lambda h: (h["k"] == s["k"]) & E.inside(h, c["e"]))
        material = F.transform(F.filter(names, has), lambda s: s["s"])
        return F.struct(place.alias("place"), c["label"].alias("label"), c["selector"].alias("selector"), c["e"].alias("e"), material.alias("material"))

    read = read.withColumn("candidates", E.held(F.transform("__met", judged)))
    read = read.withColumn("__kept", E.held(F.get(F.filter("candidates", lambda c: F.size(c["material"]) > 0), 0)))
    whole = F.struct(
        F.lit(0).alias("n"), F.lit(_EVERYTHING).alias("last"), F.lit(0).alias("first_text"), F.lit(_EVERYTHING).alias("end_text"),
        *[F.lit("[document]" if f == "tag" else "").alias(f) for f in E.ELEMENT.fieldNames()[4:]],
    )
    return read.withColumns(
        {"scope": E.held(F.coalesce(F.col("__kept.e"), whole)), "scope_label": F.coalesce(F.col("__kept.label"), F.lit(WHOLE)), "scope_place": E.held(F.col("__kept.place"))}
    ).drop("__found", "__met", "__kept")


def _any(tests: list[Column]) -> Column:
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def _trace() -> Column:
    """What is said of every candidate: label, selector, identifier, material, retained, reason."""

    def said(c: Column) -> Column:
        kept = F.coalesce(c["place"] == F.col("scope_place"), F.lit(False))
        reason = F.when(kept, F.concat(F.lit(HELD), F.array_join(c["material"], ", "))).when(F.size(c["material"]) > 0, TAKEN).otherwise(NOTHING)
        return F.struct(
            c["label"].alias("label"), c["selector"].alias("selector"), E.described(c["e"]).alias("identifier"),
            F.array_join(c["material"], ", ").alias("material"), kept.alias("retained"), reason.alias("reason"),
        )

    last = F.struct(
        F.lit(WHOLE).alias("label"), F.lit("html").alias("selector"), F.lit("html").alias("identifier"), F.lit("").alias("material"),
        F.lit(True).alias("retained"), F.lit(FALLBACK).alias("reason"),
    )
    trace = F.transform("candidates", said)
    return F.when(F.col("scope_place").isNull(), F.concat(trace, F.array(last))).otherwise(trace)


def scope_trace(pages: DataFrame, key: str) -> DataFrame:
    """A row for each container met in each page, and for the whole page where none of them decides."""
    rows = with_scope(pages).select(key, F.posexplode(_trace()).alias("place", "c"))
    return rows.select(key, "place", "c.*")


def _hits(words: tuple[str, ...], folded: Column) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(folded, w))


def mentions(pages: DataFrame, key: str, words: tuple[str, ...]) -> DataFrame:
    """(key, at, marker, carrier, excerpt) of each text outside the noise and each of `words` that it holds.

    The carrier is the innermost element around the text, told by where it is found; the excerpt is what it says.
    Words are folded; a text that holds a word twice is one mention.
    """
    read = _cleaned(pages)
    found = F.transform("said", lambda t: F.struct(t["at"].alias("at"), _hits(words, t["folded"]).alias("markers")))
    found = F.transform(F.filter(found, lambda m: F.size(m["markers"]) > 0), lambda m: F.struct(m["at"], m["markers"], E.innermost("alive", m["at"]).alias("e")))
    told = F.transform(
        found, lambda m: F.struct(m["at"], m["markers"], E.located(m["e"], "alive").alias("carrier"), F.substring(E.text_of(m["e"], "said"), 1, NOTE).alias("excerpt"))
    )
    rows = read.select(key, F.explode(told).alias("m"))
    return rows.select(key, "m.at", F.explode("m.markers").alias("marker"), "m.carrier", "m.excerpt")


# --- the invitation ----------------------------------------------------------------------------------------


def with_marks(scoped: DataFrame) -> DataFrame:
    """What `with_scope` gives, with `marks`: elements of the untouched page that bear words of invitation, and their fate."""
    saying = F.filter("texts", lambda t: F.size(_hits(P.INVITATION, t["folded"])) > 0)
    in_text = F.transform(saying, lambda t: F.struct(E.innermost("elements", t["at"]).alias("e"), _hits(P.INVITATION, t["folded"]).alias("markers")))

    def named(field: str, only: Column | None = None) -> Column:
        return F.transform(
            F.filter("elements", lambda e: (F.size(_hits(P.INVITATION, e[field])) > 0) & ((e["tag"] == "input") if only is not None else F.lit(True)) & ~e["tag"].isin(*H.SILENT)),
            lambda e: F.struct(e.alias("e"), _hits(P.INVITATION, e[field]).alias("markers")),
        )

    def judged(m: Column) -> Column:
        e = m["e"]
        around = F.get(F.filter("noise", lambda z: (e["n"] >= z["n"]) & (e["n"] <= z["last"])), 0)

        def told(lost: Column) -> Column:
            fate = F.when(lost.isNotNull(), "noise").when(E.inside(e, F.col("scope")), "scope").otherwise("outside")
            return F.struct(e["n"].alias("n"), E.located(e, "elements").alias("place"), m["markers"].alias("markers"), fate.alias("fate"), E.described(lost).alias("lost_with"))

        return E.let(around, told)

    marks = F.concat(F.filter(in_text, lambda m: m["e"].isNotNull()), named("folded label"), named("folded value", F.lit(True)))
    return scoped.withColumn("__marks", E.held(marks)).withColumn("marks", E.held(F.transform("__marks", judged))).drop("__marks")


def invitation_marks(pages: DataFrame, key: str) -> DataFrame:
    """(key, n, place, marker, fate, lost_with) of every element that bears words of invitation, a row for each of them."""
    each = lambda m: F.transform(
        m["markers"], lambda w: F.struct(m["n"].alias("n"), m["place"].alias("place"), w.alias("marker"), m["fate"].alias("fate"), m["lost_with"].alias("lost_with"))
    )
    rows = with_marks(with_scope(pages))
    return rows.select(key, F.explode(F.array_distinct(F.flatten(F.transform("marks", each)))).alias("m")).select(key, "m.*")


def _probe(state: Column) -> Column:
    """present, markers, locations, survived_noise, in_scope, used and reason, from marks and the state that was found."""
    full = F.array_join(F.transform("texts", lambda t: t["folded"]), " ")
    markers = F.array_distinct(F.concat(E.let(full, lambda t: _hits(P.INVITATION, t)), F.flatten(F.transform("marks", lambda m: m["markers"]))))
    present = F.size(markers) > 0
    survived = F.exists("marks", lambda m: m["fate"] != "noise")
    within = F.exists("marks", lambda m: m["fate"] == "scope")
    used = present & (state == "invitation")
    reason = (
        F.when(~present, ABSENT).when(used, USED).when(~survived, IN_NOISE)
        .when(~within, F.concat(F.lit(OUTSIDE.split("{}")[0]), "scope_label", F.lit(OUTSIDE.split("{}")[1]))).otherwise(UNREAD)
    )
    places = F.slice(F.array_distinct(F.transform("marks", lambda m: m["place"])), 1, MOST_PLACES)
    return F.struct(
        present.alias("present"), F.array_join(markers, ", ").alias("markers"), F.array_join(places, ", ").alias("locations"),
        (present & survived).alias("survived_noise"), (present & within).alias("in_scope"), used.alias("used"), reason.alias("reason"),
    )


# --- labels and the buy box --------------------------------------------------------------------------------


def _labels() -> Column:
    """(text, selector) of everything offered as a label in the scope, in order, white space made even."""
    pair = lambda text, selector: F.struct(F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"), selector.alias("selector"))
    ours = lambda e: E.inside(e, F.col("scope"))
    buys = []
    for s in BUY:
        first = F.slice(F.filter(E.selected("alive", s), ours), 1, 1)
        said = lambda e: F.coalesce(*[F.when(x != "", x) for x in (e["value"], e["aria-label"])], E.text_of(e, "said"))
        told = F.lit(s)
        buys.append(F.transform(first, lambda e: pair(said(e), told)))  # noqa: B023 - called at once
    links = F.filter("alive", lambda e: ours(e) & e["tag"].isin("a", "button"))
    inputs = F.filter("alive", lambda e: ours(e) & (e["tag"] == "input") & F.lower(e["type"]).isin("submit", "button"))
    of_links = F.flatten(F.transform(links, lambda e: F.array(pair(e["aria-label"], E.described(e)), pair(E.text_outside(e, "texts", "noise"), E.described(e)))))
    of_inputs = F.flatten(F.transform(inputs, lambda e: F.array(pair(e["value"], E.described(e)), pair(e["aria-label"], E.described(e)))))
    stock = F.transform(_texts_in("alive", "said", STOCK, "scope"), lambda x: F.struct(x["text"].alias("text"), x["selector"].alias("selector")))
    return F.filter(F.concat(*buys, of_links, of_inputs, stock), lambda x: x["text"] != "")


def action_labels(pages: DataFrame, key: str) -> DataFrame:
    """(key, kept, place, text, selector): the labels people can read, and those that they can't, of each scope in order, each text once."""
    listed = F.transform(_labels(), lambda x, i: F.struct(x["text"].alias("text"), i.alias("i"), x["selector"].alias("selector")))
    rows = with_scope(pages).withColumn("__all", E.held(F.array_sort(listed)))
    once = F.filter("__all", lambda x, i: (i == 0) | (F.get("__all", i - 1)["text"] != x["text"]))
    judged = F.transform(once, lambda x: F.struct(x["i"].alias("i"), x["text"].alias("text"), x["selector"].alias("selector"), M.readable(x["text"]).alias("kept")))
    rows = rows.withColumn("__once", E.held(F.array_sort(judged)))

    def told(kept: bool) -> Column:
        own = F.filter("__once", lambda x: x["kept"] == F.lit(kept))
        return F.transform(own, lambda x, i: F.struct(x["kept"].alias("kept"), i.alias("place"), x["text"].alias("text"), x["selector"].alias("selector")))

    return rows.select(key, F.explode(F.concat(told(True), told(False))).alias("l")).select(key, "l.*")


def _after(text: Column, words: tuple[str, ...]) -> Column:
    """What follows the first of the folded words that has anything after it."""
    accents = {"e": "[eé]"}
    return F.coalesce(*[M.seller(text, "".join(accents.get(c, c) for c in w)) for w in words])


def with_buy_box(scoped: DataFrame) -> DataFrame:
    """What `with_scope` gives, with price, currency, buy_selector, seller, shipped_by, stock_note, variation, edition, page_title."""
    buys = [F.when(F.exists(E.selected("alive", s), lambda e: E.inside(e, F.col("scope"))), s) for s in BUY]
    merchant = F.array_join(F.transform(_texts_in("alive", "said", MERCHANT, "scope"), lambda x: x["text"]), " ")
    anywhere = F.array_join(F.transform(_texts_in("alive", "said", MERCHANT, None), lambda x: x["text"]), " ")
    merchant = E.let(merchant, lambda m: F.when(m != "", m).otherwise(anywhere))
    stock = F.array_join(F.transform(_texts_in("alive", "said", STOCK, "scope"), lambda x: x["text"]), " ")
    rows = F.filter("alive", lambda e: e["tag"].isin("tr", "li"))
    said = F.transform(rows, lambda e: F.struct(E.text_of(e, "said").alias("raw"), E.text_of(e, "said", "folded").alias("folded")))
    labelled = F.filter(said, lambda x: _any([x["folded"].startswith(w) for w in EDITION]))
    values = F.transform(labelled, lambda x: F.trim(F.get(F.split(x["raw"], "[:‎]", 2), 1)))
    edition = F.substring(F.get(F.filter(values, lambda v: v != ""), 0), 1, NAME)
    read = scoped.withColumns({
        "__price": E.held(F.coalesce(_first_text("alive", "said", PRICE, "scope"), _first_text("alive", "said", PRICE))), "__merchant": E.held(merchant),
        "__stock": E.held(F.substring(stock, 1, NOTE)),
    })
    box = {
        "price": M.amount(F.col("__price")), "currency": M.currency(F.col("__price")), "buy_selector": F.coalesce(*buys),
        "seller": _after(F.col("__merchant"), SOLD_BY), "shipped_by": _after(F.col("__merchant"), SHIPPED_BY), "stock_note": F.when(F.col("__stock") != "", F.col("__stock")),
        "variation": F.substring(_first_text("alive", "said", VARIATION), 1, NAME), "edition": edition, "page_title": _first_text("alive", "said", TITLE),
    }
    return read.withColumns({name: E.held(value) for name, value in box.items()}).drop("__price", "__merchant", "__stock")


BOX = ["price", "currency", "buy_selector", "seller", "shipped_by", "stock_note", "variation", "edition", "page_title"]


def buy_boxes(pages: DataFrame, key: str) -> DataFrame:
    """What the buy box of each page says."""
    return with_buy_box(with_scope(pages)).select(key, "scope_label", *BOX)


# --- the whole analysis ------------------------------------------------------------------------------------


def analysed(pages: DataFrame, key: str) -> DataFrame:
    """Every page (key, url, html) to its state, with how it was found and what kept it from counting.

    In order: robot walls and empty pages, the place it was served for, the invitation, scope, buy box, one action,
    its native state, confidence (five signs of 20), and the guard against pages of another country.
    """
    read = with_buy_box(with_marks(with_scope(pages)))
    read = read.withColumn("full", E.held(F.array_join(F.transform("texts", lambda t: t["folded"]), " ")))
    full = F.col("full")
    low = F.lower(F.coalesce("html", F.lit("")))
    block = (
        F.when(F.contains(low, F.lit("cf-browser-verification")) | F.contains(low, F.lit("cloudflare")), "cloudflare")
        .when(F.contains(low, F.lit("captcha")), "captcha").when(F.size(_hits(BOT_WALL, full)) > 0, "intercepted").when(F.length(full) < 200, "error")
    )

    def destined(selector: str) -> Column:
        country = lambda e: E.let(E.text_of(e, "texts", "folded"), lambda t: F.when(t != "", M.destination(t)))
        row = lambda e, c: F.struct(c.alias("country"), F.substring(E.text_of(e, "texts"), 1, NOTE).alias("label"), F.lit(selector).alias("selector"))
        told = lambda e: F.when(e.isNotNull(), E.let(country(e), lambda c: F.when(c.isNotNull(), row(e, c))))
        return E.let(F.get(E.selected("elements", selector), 0), told)

    structured = F.exists("data", lambda d: F.contains(F.lower(d), F.lit("product"))) | F.exists("elements", lambda e: F.contains(F.lower(e["itemtype"]), F.lit("product")))
    readable = F.exists(_labels(), lambda x: M.readable(x["text"]))
    served = F.regexp_extract(F.get(F.filter("elements", lambda e: e["tag"] == "html"), 0)["lang"], r"^\s*([A-Za-z]{2})(?:[-_]([A-Za-z]{2}))?", 0)
    known = {"block": block, "delivery": F.coalesce(*map(destined, DELIVERY)), "structured": structured, "readable": readable, "served": F.lower(F.trim(served))}
    read = read.withColumns({name: E.held(value) for name, value in known.items()})

    found = P.with_action(read, F.col("scope.n"), F.transform("noise", lambda z: z["n"]), tuple(read.columns))
    official = F.contains(F.lower(F.coalesce("seller", F.lit(""))), F.lit("amazon"))
    found = found.withColumn("classified", M.native_state(F.col("action"), F.col("seller"), official))
    signs = {
        "prix": F.col("price").isNotNull(), "bouton": F.col("readable"), "buy box": F.col("buy_selector").isNotNull() | F.col("stock_note").isNotNull(),
        "identité": F.col("page_title").isNotNull(), "json-ld": F.col("structured"),
    }
    summed = F.concat_ws(", ", *[F.when(sign, f"{name}+20") for name, sign in signs.items()])
    found = found.withColumns({"confidence": P.confidence(*signs.values()), "confidence_detail": F.when(summed == "", "aucun indice").otherwise(summed), "market_country": M.market(F.col("url"), 1)})
    downgraded = (F.col("confidence") < LEAST_CONFIDENCE) & (F.col("classified") != "unknown")
    elsewhere = ~downgraded & (F.col("classified") != "unknown") & F.coalesce(F.col("delivery.country") != F.coalesce("market_country", F.lit("FR")), F.lit(False))
    found = found.withColumns({"downgraded": F.col("block").isNull() & downgraded, "locale_blocked": F.col("block").isNull() & elsewhere})
    state = F.coalesce("block", F.when(F.col("downgraded") | F.col("locale_blocked"), "unknown").otherwise(F.col("classified")))
    found = found.withColumn("state", E.held(state)).withColumn("probe", E.held(_probe(F.col("classified"))))
    labels = F.create_map(*[F.lit(x) for p in STATE_LABELS.items() for x in p])
    reason = (
        F.when(F.col("state").isin(*BLOCKING), labels[F.col("state")]).when(F.col("locale_blocked"), "contexte de livraison incorrect")
        .when(F.col("downgraded"), "confiance insuffisante").when(F.col("state") == "unknown", "aucune action d'achat identifiée")
    )
    third = F.when(F.col("classified") == "third_party_only", "third_party_only").otherwise(F.col("action"))
    told_action = F.when(F.col("state") != "unknown", F.when(F.col("block").isNull(), third)).otherwise("none")
    availability = F.create_map(*[F.lit(x) for p in H.AVAILABILITY.items() for x in p])
    found = found.withColumn("evidence", E.held(_evidence()))
    walled = F.col("block").isNotNull()
    unless = lambda c: F.when(~walled, c)
    return found.select(
        key, "state", labels[F.col("state")].alias("state_label"), unless(F.col("classified")).alias("classified"),
        F.coalesce(availability[F.coalesce(told_action, F.lit("none"))], F.lit("unknown")).alias("availability"), unless(F.col("action")).alias("action"),
        unless(F.col("label")).alias("action_label"), unless(F.col("origin")).alias("origin"), unless(F.col("evidence.place")).alias("evidence"),
        unless(F.col("evidence.excerpt")).alias("excerpt"), unless(F.col("scope_label")).alias("scope"), unless(E.described(F.col("scope"))).alias("block_retained"),
        unless(F.size("candidates") + F.when(F.col("scope_place").isNull(), 1).otherwise(0)).alias("blocks_examined"),
        *[unless(F.col(c)).alias(c) for c in BOX], unless(M.seller_type(F.col("seller"), official)).alias("seller_type"),
        unless(F.col("confidence")).alias("confidence"), unless(F.col("confidence_detail")).alias("confidence_detail"), "downgraded", "locale_blocked",
        F.col("served").alias("language"), F.col("delivery.country").alias("delivery_country"), F.col("delivery.label").alias("delivery_label"),
        F.col("delivery.selector").alias("delivery_selector"), "market_country", F.when(~walled, F.col("probe.present")).otherwise(False).alias("invitation_present"),
        F.when(walled, UNREADABLE).otherwise(F.col("probe.reason")).alias("invitation_reason"), unless(F.col("ignored")).alias("controls_ignored"),
        unless(F.col("ignored_reasons")).alias("ignored_reasons"), reason.alias("blocked_reason"), (F.col("state") != "error").alias("page_exists"),
    )


def _evidence() -> Column:
    """Where the decisive words stand, for an action that the text of the scope decided: the innermost element around them."""
    ours = F.filter("said", lambda t: (t["at"] >= F.col("scope.first_text")) & (t["at"] < F.col("scope.end_text")) & F.contains(t["folded"], F.col("label")))
    told = lambda e: F.when(e.isNotNull(), F.struct(E.located(e, "alive").alias("place"), F.substring(E.text_of(e, "said"), 1, NOTE).alias("excerpt")))
    carrier = E.let(F.get(ours, 0)["at"], lambda at: E.innermost("alive", at))
    return F.when(F.col("origin") == "texte du périmètre", E.let(carrier, told))


def invitation_probes(pages: DataFrame, key: str) -> DataFrame:
    """Whether each page offers an invitation, and what became of it on the way to the decision."""
    rows = with_marks(with_scope(pages))
    acts = P.with_action(rows, F.col("scope.n"), F.transform("noise", lambda z: z["n"]), (key, "texts", "marks", "scope_label"))
    state = F.when(F.col("action") == "request_invite", "invitation").otherwise("")
    return acts.select(key, _probe(state).alias("p")).select(key, "p.*")
