"""Text, URL, price and identifier functions as Column expressions; pandas only where Unicode folding needs it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words without weight in product names.
STOP_WORDS = (
    "le", "la", "les", "de", "du", "des", "un", "une", "et", "the", "of", "neuf", "nouveau", "new", "edition", "ed",
    "version", "pack", "lot", "officiel", "official", "fr", "france", "francais", "vf", "produit", "article",
    "reference", "ref",
)
#: Query parameters that do not identify a page (matched at the start of their names).
NOISE_PARAMS = ("utm_", "gclid", "fbclid", "msclkid", "mc_", "_ga", "ref", "source", "cmpid", "sessionid", "sid", "affiliate", "partner", "campaign")


#: Rows whose results a Python worker holds at once: texts and trees of pages are many times as large as what is read.
STEP = 64


def in_steps(batches: Iterator, read: Callable[..., pd.DataFrame | pd.Series]) -> Iterator[pd.DataFrame | pd.Series]:
    """`read` over the columns of each batch, few rows at a time, so that memory doesn't grow with the batch."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        for at in range(0, len(columns[0]), STEP):
            yield read(*[c.iloc[at : at + STEP] for c in columns])


def fold(text: str | None) -> str | None:
    if text is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(plain.lower().split())


@F.pandas_udf(T.StringType())
def _folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    return in_steps(texts, lambda text: text.map(fold))


def normalise(text: F.Column) -> F.Column:
    """Accents, case and runs of white space folded away.

    Only texts beyond ASCII go to Python: NFKD has no built-in function.
    """
    plain = text.rlike(r"\A\p{ASCII}*\z")
    ascii_fold = F.lower(F.trim(F.regexp_replace(text, r"[\t-\r\x1C-\x1F ]+", " ")))
    return F.when(plain, ascii_fold).otherwise(_folded(F.when(~plain, text)))


def normalise_name(name: F.Column) -> F.Column:
    """Comparable form of a name: folded, punctuation as spaces, stop words gone, word order kept."""
    words = F.split(F.regexp_replace(normalise(name), r"[^\p{L}\p{N}_\s]", " "), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS)), " ")


def name_key(normalised: F.Column) -> F.Column:
    """Distinct words in order, from a normalised name."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(normalised, " "), lambda w: w != ""))), " ")


def name_similarity(left: str, right: str) -> float:
    """Mean of the Jaccard overlap of words and of difflib's ratio, for normalised names."""
    if not left or not right:
        return 0.0
    if left == right:
        return 1.0
    a, b = set(left.split()), set(right.split())
    return (len(a & b) / len(a | b) + SequenceMatcher(None, left, right).ratio()) / 2


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([name_similarity(a or "", b or "") for a, b in zip(left, right)], dtype="float64")


def slugify(value: F.Column, longest: int = 60) -> F.Column:
    ascii_only = F.regexp_replace(normalise(value), r"[^\x00-\x7F]", "")
    slug = F.regexp_replace(F.regexp_replace(ascii_only, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    slug = F.regexp_replace(F.substring(slug, 1, longest), "_+$", "")
    return F.when(slug == "", "produit").otherwise(slug)


def canonical_url(url: F.Column) -> F.Column:
    """Scheme and host in lower case, without www., tracking parameters, fragment and closing slash; parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*:", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^//([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(F.regexp_replace(rest, "^//[^/?]*", ""), r"^([^?]*)", 1), "/{2,}", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    noise = "(?i)^(" + "|".join(re.escape(p) for p in NOISE_PARAMS) + ")"
    pairs = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].rlike(noise))
    query = F.array_join(F.array_sort(pairs), "&")
    full = F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host, path)
    return F.when(query == "", full).otherwise(F.concat(full, F.lit("?"), query))


def product_slug(canonical: F.Column) -> F.Column:
    path = F.regexp_replace(F.regexp_replace(canonical, r"\?.*$", ""), "^[a-z0-9+.-]+://[^/]*", "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    last = F.when(F.size(segments) > 0, F.element_at(segments, -1)).otherwise("")
    return F.lower(F.regexp_replace(last, r"(?i)\.(html?|php|aspx?)$", ""))


def fingerprint(site: F.Column, canonical: F.Column, sku: F.Column, ean: F.Column) -> tuple[F.Column, F.Column]:
    """(fingerprint, basis): by EAN, else by site and SKU, else by site and URL."""
    has_ean, has_sku = F.trim(F.coalesce(ean, F.lit(""))) != "", F.trim(F.coalesce(sku, F.lit(""))) != ""
    seed = (
        F.when(has_ean, F.concat(F.lit("ean:"), F.trim(ean)))
        .when(has_sku, F.concat(F.lower(site), F.lit(":sku:"), F.lower(F.trim(sku))))
        .otherwise(F.concat(F.lower(site), F.lit(":url:"), canonical))
    )
    basis = F.when(has_ean, "ean").when(has_sku, "sku").otherwise("url")
    return F.left(F.sha2(seed.cast("binary"), 256), F.lit(32)), basis


def digits(value: F.Column) -> F.Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9]", "")


def is_valid_gtin(code: F.Column) -> F.Column:
    """For a string of digits: a length of 8, 12, 13 or 14, no placeholder body, and the right check digit."""
    n = F.length(code)
    body = F.substring(code, F.lit(1), n - 1)
    weighted = F.transform(
        F.filter(F.split(F.reverse(body), ""), lambda d: d != ""), lambda d, i: d.cast("int") * F.when(i % 2 == 0, 3).otherwise(1)
    )
    check = (10 - F.aggregate(weighted, F.lit(0), lambda a, b: a + b) % 10) % 10
    several = F.length(F.replace(body, F.substring(code, 1, 1), F.lit(""))) > 0
    return n.isin(8, 12, 13, 14) & several & (check.cast("string") == F.substring(code, -1, 1))


def normalise_ean(value: F.Column) -> F.Column:
    code = digits(value)
    n = F.length(code)
    widened = F.when(n == 12, F.concat(F.lit("0"), code)).when((n == 14) & code.startswith("0"), F.substring(code, 2, 13)).otherwise(code)
    return F.when(is_valid_gtin(code), widened)


def normalise_upc(value: F.Column) -> F.Column:
    code = digits(value)
    valid = is_valid_gtin(code)
    return F.when((F.length(code) == 12) & valid, code).when((F.length(code) == 13) & code.startswith("0") & valid, F.substring(code, 2, 12))


def normalise_isbn(value: F.Column) -> F.Column:
    raw = F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9Xx]", ""))
    return F.when((F.length(raw) == 13) & ~raw.contains("X") & is_valid_gtin(digits(raw)), raw).when(F.length(raw) == 10, raw)


def normalise_code(value: F.Column) -> F.Column:
    cleaned = F.regexp_replace(F.upper(F.trim(value)), r"[\s_]+", "-")
    cleaned = F.regexp_replace(F.regexp_replace(cleaned, "-{2,}", "-"), "^-+|-+$", "")
    return F.when(cleaned != "", cleaned)


def price_eur(text: F.Column) -> F.Column:
    """The first price in euros as "x,yy €"; thousands separators are not read."""
    before = F.regexp_extract(text, r"(\d{1,4}[.,]\d{2})\s*€", 1)
    after = F.regexp_extract(text, r"€\s*(\d{1,4}[.,]\d{2})", 1)
    found = F.when(before != "", before).otherwise(after)
    return F.when(found != "", F.concat(F.replace(found, F.lit("."), F.lit(",")), F.lit(" €")))


def title_from_url(slug: F.Column) -> F.Column:
    words = F.filter(F.split(slug, "[-_]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))), " ")
