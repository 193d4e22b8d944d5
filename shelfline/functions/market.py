"""What marketplace pages say: addresses, prices, sellers, destinations and dates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.functions import text as X

#: Domain, country, language and currency of each marketplace.
MARKETS = (
    ("amazon.fr", "FR", "fr_FR", "EUR"), ("amazon.be", "BE", "fr_BE", "EUR"), ("amazon.de", "DE", "de_DE", "EUR"), ("amazon.es", "ES", "es_ES", "EUR"),
    ("amazon.it", "IT", "it_IT", "EUR"), ("amazon.nl", "NL", "nl_NL", "EUR"), ("amazon.co.uk", "GB", "en_GB", "GBP"), ("amazon.com", "US", "en_US", "USD"),
)
#: How countries are named.
COUNTRIES = (
    ("france", "FR"), ("belgique", "BE"), ("belgium", "BE"), ("belgie", "BE"), ("allemagne", "DE"), ("germany", "DE"), ("deutschland", "DE"),
    ("espagne", "ES"), ("spain", "ES"), ("espana", "ES"), ("italie", "IT"), ("italy", "IT"), ("italia", "IT"), ("pays-bas", "NL"), ("pays bas", "NL"),
    ("netherlands", "NL"), ("nederland", "NL"), ("luxembourg", "LU"), ("suisse", "CH"), ("switzerland", "CH"), ("schweiz", "CH"), ("royaume-uni", "GB"),
    ("royaume uni", "GB"), ("united kingdom", "GB"), ("etats-unis", "US"), ("etats unis", "US"), ("united states", "US"), ("usa", "US"), ("canada", "CA"),
    ("portugal", "PT"), ("irlande", "IE"), ("ireland", "IE"), ("autriche", "AT"), ("austria", "AT"), ("osterreich", "AT"), ("pologne", "PL"),
    ("poland", "PL"), ("polska", "PL"), ("suede", "SE"), ("sweden", "SE"), ("japon", "JP"), ("japan", "JP"),
)
#: What stands before a destination.
DELIVERY_LEADS = (
    "livrer a", "livrer en", "livraison a", "livraison en", "livraison", "mettre a jour la position", "deliver to", "delivering to",
    "update location", "choisir le lieu de livraison",
)
#: What a native state is for each action.
STATES = {
    "add_to_cart": "available", "buy_now": "available", "third_party_only": "third_party_only", "preorder": "preorder", "request_invite": "invitation",
    "notify_me": "out_of_stock", "temporarily_unavailable": "out_of_stock", "currently_unavailable": "out_of_stock", "discontinued": "unavailable",
    "coming_soon": "coming_soon", "none": "unknown",
}


def asin(url: F.Column) -> F.Column:
    """The article number in a path, else in a parameter."""
    path = F.regexp_extract(url, r"(?i)/(?:dp|gp/product|gp/aw/d|product|-)/([A-Z0-9]{10})(?:[/?#]|$)", 1)
    param = F.regexp_extract(url, r"(?i)[?&]asin=([A-Z0-9]{10})", 1)
    return F.upper(F.when(path != "", path).when(param != "", param))


def host(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def article_url(url: F.Column) -> F.Column:
    """https://host/dp/article; an address without article keeps its path and nothing after it."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    root = F.concat(F.when(scheme == "", "https").otherwise(F.lower(scheme)), F.lit("://"), F.when(host(url) == "", "www.amazon.fr").otherwise(host(url)))
    path = F.regexp_extract(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"^([^?#]*)", 1)
    return F.when(asin(url).isNotNull(), F.concat(root, F.lit("/dp/"), asin(url))).otherwise(F.concat(root, path))


def market(url: F.Column, column: int) -> F.Column:
    """A column of MARKETS for an address: 0 domain, 1 country, 2 language, 3 currency; null for other hosts."""
    h = host(url)
    found = [F.when((h == m[0]) | h.endswith(f".{m[0]}"), m[column]) for m in MARKETS]
    return F.coalesce(*found)


def with_language(url: F.Column) -> F.Column:
    """The address with its market's language, the preferred one's for other hosts; one that is set stays."""
    base, fragment = F.regexp_replace(url, "#.*$", ""), F.regexp_extract(url, "(#.*)$", 1)
    language = F.coalesce(market(url, 2), F.lit(MARKETS[0][2]))
    joined = F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), F.lit("language="), language, fragment)
    return F.when(base.rlike(r"[?&]language="), url).otherwise(joined)


def amount(text: F.Column) -> F.Column:
    """The first amount, thousands apart or not, as "x,yy €" whatever its currency."""
    found = F.regexp_extract(text, r"(\d{1,4}(?:[ \u00a0\u202f]?\d{3})*[.,]\d{2})", 1)
    return F.when(found != "", F.concat(F.replace(F.regexp_replace(found, r"[ \u00a0\u202f]", ""), F.lit("."), F.lit(",")), F.lit(" €")))


def currency(text: F.Column) -> F.Column:
    return F.when(F.contains(text, F.lit("€")), "EUR").when(F.contains(text, F.lit("$")), "USD").when(F.contains(text, F.lit("£")), "GBP")


def destination(folded: F.Column) -> F.Column:
    """The country of a folded delivery label: by its name, by a French postcode unless another country is named, by a name in it."""
    lead = "|".join(DELIVERY_LEADS)
    bare = F.when(folded.rlike(f"^(?:{lead})"), F.regexp_replace(F.regexp_replace(folded, f"^(?:{lead})", ""), "^[ :,-]+|[ :,-]+$", "")).otherwise(folded)
    named = [(F.when(bare == name, code), F.when(bare.rlike(rf"\b{name}\b"), code)) for name, code in COUNTRIES]
    inside = F.coalesce(*[b for _, b in named])
    foreign = bare.rlike(r"\b(?:" + "|".join(n for n, c in COUNTRIES if c != "FR") + r")\b")
    postcode = bare.rlike(r"\b(?:0[1-9]|[1-8]\d|9[0-8])\d{3}\b") & ~foreign
    return F.coalesce(*[a for a, _ in named], F.when(postcode, "FR"), inside)


def iso_date(text: F.Column) -> F.Column:
    iso = F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0)
    part = lambda i: F.regexp_extract(text, r"(\d{1,2})[/\s.-](\d{1,2})[/\s.-](\d{4})", i)
    european = F.when(part(3) != "", F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))
    return F.when(iso != "", iso).otherwise(european)


def seller(text: F.Column, label: str) -> F.Column:
    """What follows `label` (a folded word) up to the next separator, words not repeated, 80 characters at most."""
    tail = F.regexp_replace(F.regexp_extract(text, f"(?isu){label}(.*)$", 1), r"^[ :•|\n\t-]+", "")
    stop = r"(?iu)\s{2,}|[|•/]|Expédié par|Expéditeur|Vendu par|Vendeur|Ships from|Sold by|Dispatched from|Livré par"
    words = F.filter(F.split(F.get(F.split(tail, stop), 0), r"\s+"), lambda w: w != "")
    once = F.filter(words, lambda w, i: (i == 0) | (F.lower(w) != F.lower(F.get(words, i - 1))))
    name = F.substring(F.array_join(once, " "), 1, 80)
    return F.when(name != "", name)


def readable(label: F.Column) -> F.Column:
    """Whether people can read a label: 2 to 60 characters, no token, with a letter and a vowel."""
    clean = F.trim(F.regexp_replace(label, r"\s+", " "))
    token = clean.rlike(r"^[A-Za-z0-9+/=_-]{16,}$") | clean.rlike(r"^[0-9a-fA-F]{12,}$")
    vowel = clean.rlike("(?iu)[aeiouyàâäéèêëîïôöùûü]")
    return F.coalesce(F.length(clean).between(2, 60) & ~token & clean.rlike("[A-Za-zÀ-ÿ]") & vowel, F.lit(False))


def blocked(html: F.Column, text: F.Column) -> F.Column:
    """Why a page is none of a product: cloudflare, captcha, or error for hardly any text."""
    low = F.lower(html)
    return (
        F.when(F.contains(low, F.lit("cf-browser-verification")) | F.contains(low, F.lit("cloudflare")), "cloudflare")
        .when(F.contains(low, F.lit("captcha")), "captcha")
        .when(F.length(text) < 200, "error")
    )


def native_state(action: F.Column, seller: F.Column, official: F.Column) -> F.Column:
    """The state of an action; what can be bought of somebody else is a third party's."""
    named = F.create_map(*[F.lit(x) for p in STATES.items() for x in p])[action]
    others = action.isin("add_to_cart", "buy_now") & (F.coalesce(seller, F.lit("")) != "") & ~official
    return F.when(others, "third_party_only").otherwise(named)


def seller_type(seller: F.Column, official: F.Column) -> F.Column:
    return F.when(F.coalesce(seller, F.lit("")) == "", "unknown").when(official, "official").otherwise("third_party")


def guarded(state: F.Column, confidence: F.Column, country: F.Column, expected: F.Column) -> F.Column:
    """The state, or unknown where confidence is under 60 or the page is known to deliver elsewhere."""
    elsewhere = F.coalesce(country != expected, F.lit(False))
    return F.when((confidence < 60) | elsewhere, "unknown").otherwise(state)


def blocked_reason(block: F.Column, elsewhere: F.Column, confidence: F.Column, state: F.Column) -> F.Column:
    """A wall goes before a wrong destination, that before low confidence, that before an unknown state."""
    return F.coalesce(block, F.when(elsewhere, "locale"), F.when(confidence < 60, "confidence"), F.when(state == "unknown", "unknown"))
