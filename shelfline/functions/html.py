"""Product pages to typed state: a small parser pulls out texts, columns decide what they mean.

The parser (standard library) only collects: title, visible text without noise, control labels, price texts,
JSON-LD, item properties and metas.  Keywords, precedence, prices and identifiers are Column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions import text as X

#: Keywords in order of precedence, folded (no accents, lower case).
PREORDER = ("precommander", "precommande", "pre-commander", "preorder", "pre-order")
CART = ("ajouter au panier", "add to cart", "acheter")
UNAVAILABLE = (
    "indisponible", "rupture de stock", "epuise", "non disponible", "victime de son succes", "out of stock", "sold out",
    "stock epuise", "bientot disponible", "m'alerter", "prevenez-moi",
)
#: Parts of class names and of ids that mark noise.
NOISE = (
    "carousel", "slider", "recommend", "cross-sell", "crosssell", "upsell", "similar", "related", "also-like", "suggestion",
    "you-may", "bought-together", "breadcrumb", "cookie", "onetrust", "didomi", "consent", "newsletter", "subscribe", "advert",
    "publicite", "sponsor", "promo-banner", "modal", "popin", "popup", "review", "rating", "avis",
)
NOISE_IDS = ("cookie", "onetrust", "didomi", "consent", "newsletter", "advert", "sponsor", "review")
#: What marks a waiting page, and whose it is.
INTERSTITIAL = (
    ("cf-browser-verification", "Cloudflare"), ("challenge-platform", "Cloudflare"), ("cf_chl", "Cloudflare"), ("just a moment", "Cloudflare"),
    ("attention required", "Cloudflare"), ("datadome", "DataDome"), ("px-captcha", "PerimeterX"), ("_incapsula_", "Imperva"),
    ("incapsula incident", "Imperva"), ("vous etes une personne", "vérification humaine"), ("verification que vous etes", "vérification humaine"),
    ("enable javascript and cookies", "page d'attente JavaScript"), ("veuillez activer javascript", "page d'attente JavaScript"),
)
#: Fields of a product in structured data, and the metas that stand for them.
PRODUCT_FIELDS = (
    "gtin13", "gtin12", "gtin", "ean", "upc", "isbn", "sku", "mpn", "productID", "model", "brand", "category", "releaseDate",
    "datePublished", "isPartOf", "collection", "edition", "bookEdition", "image",
)
MICRODATA = PRODUCT_FIELDS[:13]
METAS = {
    "product:retailer_item_id": "sku", "product:mfr_part_no": "mpn", "product:ean": "gtin13", "product:upc": "gtin12",
    "product:brand": "brand", "og:brand": "brand", "og:image": "image",
}
NESTED = ("@graph", "mainEntity", "itemListElement", "hasVariant")
MOST_BUTTONS, DEEPEST = 8, 6
NOISE_TAGS = ("footer", "nav", "header")
#: What an action says about availability.
AVAILABILITY = {
    "add_to_cart": "in_stock", "buy_now": "in_stock", "third_party_only": "in_stock", "preorder": "preorder", "request_invite": "preorder",
    "notify_me": "unavailable", "coming_soon": "unavailable", "temporarily_unavailable": "unavailable", "currently_unavailable": "unavailable",
    "discontinued": "unavailable", "none": "unknown",
}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style", "noscript", "template"))

PAGE = T.StructType(
    [
        T.StructField("title", T.StringType()), T.StructField("page_text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("prices", T.ArrayType(T.StringType())),
        T.StructField("links", T.ArrayType(T.StringType())), T.StructField("nodes", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        T.StructField("folded_text", T.StringType()), T.StructField("folded_title", T.StringType()), T.StructField("folded_labels", T.ArrayType(T.StringType())),
    ]
)


def flat(value: object) -> str:
    """A value of structured data as text: an object by its name, a list by its first item."""
    if isinstance(value, list):
        value = value[0] if value else None
    if isinstance(value, dict):
        value = value.get("name") or value.get("@id") or value.get("url") or value.get("contentUrl")
    return "" if value is None or isinstance(value, (dict, list)) else " ".join(str(value).split())


def product_nodes(payload: object, depth: int = 0):
    """Every object of type Product in JSON-LD, outermost first, through the keys that nest them."""
    if depth > DEEPEST:
        return
    if isinstance(payload, list):
        for item in payload:
            yield from product_nodes(item, depth + 1)
    elif isinstance(payload, dict):
        kind = payload.get("@type")
        if any(str(k).lower().endswith("product") for k in (kind if isinstance(kind, list) else [kind]) if k):
            yield payload
        for key in NESTED:
            if key in payload:
                yield from product_nodes(payload[key], depth + 1)


def structured(json_ld: list[str], props: dict, metas: dict) -> list[dict[str, str]]:
    """Filled product fields of each JSON-LD product, then of item properties, then of metas."""
    found: list[dict] = []
    for text in json_ld:
        try:
            found += product_nodes(json.loads(text))
        except ValueError:
            continue
    found.append({k: props[k] for k in MICRODATA if k in props})
    meta: dict[str, str] = {}
    for key, value in metas.items():
        if (field := METAS.get(key.lower())) is not None:
            meta.setdefault(field, value)
    filled = [{f: flat(node.get(f)) for f in PRODUCT_FIELDS} for node in [*found, meta]]
    return [{k: v for k, v in node.items() if v} for node in filled]


class _Collector(HTMLParser):
    """Texts of a page by what encloses them; unclosed and stray tags are tolerated."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict, list[str]]] = []
        self.title, self.lang, self.text, self.labels, self.prices = [], None, [], [], []
        self.links, self.json_ld, self.props, self.metas = [], [], {}, {}

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang")
        if tag == "meta" and a.get("content"):
            self.metas.setdefault(a.get("property") or a.get("name") or "", a["content"])
        if a.get("itemprop") and (a.get("content") or a.get("value")):
            self.props.setdefault(a["itemprop"], a.get("content") or a["value"])
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag == "input" and a.get("type") in ("submit", "button") and not self._noisy():
            self._label(a.get("value"))
        if tag not in VOID:
            self.open.append((tag, a, []))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.open):
            while self.open:
                name, a, parts = self.open.pop()
                self._closed(name, a, " ".join(" ".join(parts).split()))
                if name == tag:
                    break

    def handle_data(self, data):
        tags = [t for t, _, _ in self.open]
        if "title" in tags:
            self.title.append(data)
        elif tags and tags[-1] == "script":
            if self.open[-1][1].get("type") == "application/ld+json":
                self.json_ld.append(data)
        elif not SILENT & set(tags):
            for _, _, parts in self.open:
                parts.append(data)
            if not self._noisy():
                self.text.append(data)

    def _noisy(self) -> bool:
        return any(self._is_noise(t, a) for t, a, _ in self.open)

    @staticmethod
    def _is_noise(tag: str, a: dict) -> bool:
        by_class, by_id = a.get("class", ""), a.get("id", "")
        named = any(n in by_class for n in NOISE) or any(n in by_id for n in NOISE_IDS)
        return named or tag in NOISE_TAGS or a.get("role") in ("navigation", "dialog")

    def _label(self, text):
        text = " ".join((text or "").split())
        if 0 < len(text) <= 100 and text not in self.labels:
            self.labels.append(text)

    def _closed(self, tag, a, text):
        if a.get("itemprop") and text:
            self.props.setdefault(a["itemprop"], text)
        if self._noisy() or self._is_noise(tag, a):
            return
        if tag in ("button", "a") or a.get("role") == "button" or any(x in a.get("class", "") for x in ("btn", "button", "add-to-cart", "cta")):
            for x in (text, a.get("aria-label"), a.get("title")):
                self._label(x)
        if "price" in a.get("class", "") or a.get("itemprop") == "price" or "data-price" in a:
            self.prices.append(text)

    def finished(self) -> dict:
        while self.open:
            name, a, parts = self.open.pop()
            self._closed(name, a, " ".join(" ".join(parts).split()))
        words = lambda parts: " ".join(" ".join(parts).split())
        title, text = words(self.title)[:120], words(self.text)
        return {
            "title": title, "page_text": text, "lang": self.lang, "labels": self.labels, "prices": self.prices, "links": self.links,
            "nodes": structured(self.json_ld, self.props, self.metas), "folded_text": X.fold(text), "folded_title": X.fold(title),
            "folded_labels": [X.fold(x) for x in self.labels],
        }


def collected(html: str | None) -> dict:
    parser = _Collector()
    parser.feed(html or "")
    parser.close()
    return parser.finished()


@F.pandas_udf(PAGE)
def page_parts(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    return X.in_steps(pages, lambda html: pd.DataFrame([collected(x) for x in html], columns=PAGE.fieldNames()))


def with_state(pages: DataFrame) -> DataFrame:
    """`pages` (html) with title, action, availability, price, status_text, blocked_reason and page_lang.

    A null page is an empty one.  Of the labels of controls the first eight with a keyword decide.
    """
    parts = pages.withColumn("__p", page_parts("html"))
    known = F.array(*map(F.lit, (*PREORDER, *CART, *UNAVAILABLE)))
    acting = F.filter("__p.folded_labels", lambda x: F.exists(known, lambda k: F.contains(x, k)))
    parts = parts.withColumn("__l", F.array_join(F.slice(acting, 1, MOST_BUTTONS), " | "))
    labels, text = F.col("__l"), F.col("__p.folded_text")
    hit = lambda words, where: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(where, w))
    pre, cart, gone, page_gone = hit(PREORDER, labels), hit(CART, labels), hit(UNAVAILABLE, labels), hit(UNAVAILABLE, text)

    def unavailable(word: F.Column) -> F.Column:
        asks = word.rlike("alerter|prevenir|prevenez|alertez|notify")
        return F.when(asks, "notify_me").when(word.rlike("bientot|coming soon"), "coming_soon").otherwise("currently_unavailable")

    buys = (F.size(pre) > 0) | (F.size(cart) > 0)
    action = (
        F.when(buys & (F.size(gone) > 0), "none")
        .when(F.size(pre) > 0, "preorder")
        .when(F.size(cart) > 0, "add_to_cart")
        .when(F.size(gone) > 0, unavailable(F.get(gone, 0)))
        .when(F.size(page_gone) > 0, unavailable(F.get(page_gone, 0)))
        .otherwise("none")
    )
    price = F.coalesce(X.price_eur(F.array_join("__p.prices", " ; ")), X.price_eur(F.col("__p.page_text")))
    out = parts.withColumn("action", action)
    availability = F.create_map(*[F.lit(x) for p in AVAILABILITY.items() for x in p])[F.col("action")]
    start = F.lower(F.substring(F.coalesce("html", F.lit("")), 1, 4000))
    seen = F.concat_ws(" ", "__p.folded_title", text, start)
    walls = [F.when(F.contains(seen, F.lit(mark)), f"page d'attente {whose}") for mark, whose in INTERSTITIAL]
    wall = F.coalesce(*walls, F.when(F.length(text) < 200, "page quasi vide (contenu rendu côté client ?)"))
    unknown = availability == "unknown"
    return out.select(
        *pages.columns, F.col("__p.title").alias("title"), "action", availability.alias("availability"), price.alias("price"),
        F.when(unknown, F.coalesce(wall, F.get(page_gone, 0))).otherwise(F.get(page_gone, 0)).alias("status_text"),
        F.when(unknown, F.coalesce(wall, F.lit("aucune action d'achat identifiée"))).alias("blocked_reason"), F.col("__p.lang").alias("page_lang"),
    )


def identifiers(pages: DataFrame) -> DataFrame:
    """`pages` (html) with identifiers and attributes: of each the first that any source gives in normal form.

    Sources are JSON-LD products in order, then item properties, then metas.
    """
    parts = pages.withColumn("__n", page_parts("html")["nodes"])

    def first(names: tuple[str, ...], normal) -> F.Column:
        each = F.transform("__n", lambda node: normal(F.coalesce(*[node[n] for n in names])))
        return F.get(F.filter(each, lambda x: x.isNotNull()), 0)

    text = lambda v: F.substring(v, 1, 120)
    date = lambda v: F.when(v.rlike(r"\d{4}-\d{2}-\d{2}"), F.regexp_extract(v, r"\d{4}-\d{2}-\d{2}", 0))
    return parts.select(
        *pages.columns,
        first(("gtin13", "gtin", "ean"), X.normalise_ean).alias("ean"), first(("gtin12", "upc", "gtin13", "gtin"), X.normalise_upc).alias("upc"),
        first(("isbn",), X.normalise_isbn).alias("isbn"), first(("mpn",), X.normalise_code).alias("mpn"), first(("sku",), X.normalise_code).alias("sku"),
        first(("productID", "model"), X.normalise_code).alias("manufacturer_ref"), first(("brand",), text).alias("brand"),
        first(("isPartOf", "collection"), text).alias("collection"), first(("edition", "bookEdition"), text).alias("edition"),
        first(("category",), text).alias("category"), first(("releaseDate", "datePublished"), date).alias("release_date"),
        first(("image",), lambda v: F.when(v.startswith("http"), v)).alias("image_url"),
    )


def head_lang(html: F.Column | str) -> F.Column:
    """The language a page declares as it is written; empty where it declares none."""
    return F.regexp_extract(html, r'<html lang="([^"]*)"', 1)


def head_title(html: F.Column | str) -> F.Column:
    """The first title without nested tags, of 120 characters at most, read without a parser.

    Of entities those of markup itself are decoded (&lt; &gt; &amp;, with their semicolons); others stay as written.
    """
    title = F.trim(F.regexp_replace(F.regexp_extract(html, "<title>([^<]*)</title>", 1), r"[\t\n\f\r ]+", " "))
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        title = F.replace(title, F.lit(entity), F.lit(sign))
    return F.substring(title, 1, 120)


def sitemap_urls(body: F.Column) -> F.Column:
    """Every <loc> of a sitemap or sitemap index."""
    return F.regexp_extract_all(body, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
