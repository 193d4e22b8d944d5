"""A page as a table of its elements, and CSS selectors as filters over it.

Elements are numbered as they open, and each knows the last number that opens inside it and the stretch of the
page's texts that it holds.  "Inside" so is containment of intervals, and so is what a text stands in; nothing
climbs a tree.  The table is an array column: pages are independent, so selecting, cleaning and narrowing stay
in their rows and shuffle nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions import text as X
from shelfline.functions.listing import _Tree

#: Attributes that selectors and readings ask for; an attribute that a page doesn't set is empty.
ATTRIBUTES = ("id", "name", "type", "value", "aria-label", "class", "data-cel-widget", "data-component-type", "itemtype", "content", "property", "lang", "data-csa-c-slot-id")
_FIELDS = [T.StructField(f, T.IntegerType()) for f in ("n", "last", "first_text", "end_text")]
#: Attributes that are searched for words, and the fields of their folded forms.
FOLDED = {"aria-label": "folded label", "value": "folded value"}
ELEMENT = T.StructType([*_FIELDS, *(T.StructField(a, T.StringType()) for a in ("tag", *ATTRIBUTES, *FOLDED.values()))])
TEXT = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("said", T.StringType()), T.StructField("folded", T.StringType())])
TABLE = T.StructType([T.StructField("elements", T.ArrayType(ELEMENT)), T.StructField("texts", T.ArrayType(TEXT)), T.StructField("data", T.ArrayType(T.StringType()))])


class _Page(_Tree):
    """The tree with the texts of scripts of structured data."""

    def __init__(self, html: str | None):
        self.data: list[str] = []
        super().__init__(html)

    def handle_data(self, data):
        top = self.open[-1]
        if top.tag == "script" and top.attrs.get("type") == "application/ld+json":
            self.data.append(data)
        super().handle_data(data)


def listed(html: str | None) -> dict:
    tree = _Page(html)
    texts = [" ".join(t.split()) for t in tree.texts]

    def element(n) -> dict:
        held = {a: n.attrs.get(a, "") for a in ATTRIBUTES}
        folded = {to: X.fold(held[a]) for a, to in FOLDED.items()}
        return {"n": n.inside, "last": n.last[0] - 1, "first_text": n.first, "end_text": n.last[1], "tag": n.tag, **held, **folded}

    return {
        "elements": [element(n) for n in tree.nodes[1:]],
        "texts": [{"at": i, "said": t, "folded": X.fold(t)} for i, t in enumerate(texts)],
        "data": tree.data,
    }


def with_elements(pages: DataFrame) -> DataFrame:
    """`pages` (html) with `elements`, `texts` and `data` (scripts of structured data); a null page has none of them."""

    def read(batches):
        def read_some(some):
            found = pd.DataFrame([listed(x) for x in some["html"]], columns=TABLE.fieldNames(), index=some.index)
            return pd.concat([some, found], axis=1)

        return X.in_steps(batches, read_some)

    return pages.mapInPandas(read, T.StructType([*pages.schema.fields, *TABLE.fields]))


def held(value: Column) -> Column:
    """`value`, computed once for a row before whatever reads the column.

    A column that the optimiser may fold into its reader would be computed anew for every item of an array that a
    lambda walks over.  It leaves alone what is not deterministic, as the partition's number is said to be.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with `value` computed once however often f asks for it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# --- selectors ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """What one element has to be: its tag, and (attribute, `=` or `*=` or `.`, value)."""

    tag: str
    tests: tuple[tuple[str, str, str], ...]


_STEP = re.compile(r"#((?:\\.|[\w-])+)|\.([\w-]+)|\[([\w-]+)(\*?=)'([^']*)'\]")


def steps(selector: str) -> list[Step]:
    """The steps of a selector: tags, `#id`, `.class`, `[attr='x']`, `[attr*='x']`, one inside another by spaces."""
    out = []
    for part in re.findall(r"(?:\[[^\]]*\]|\\.|[^\s])+", selector):
        tag = re.match(r"[a-z0-9]*", part).group()
        tests = []
        for id_, class_, name, how, value in _STEP.findall(part):
            tests.append(("id", "=", id_.replace("\\", "")) if id_ else ("class", ".", class_) if class_ else (name, how, value))
        out.append(Step(tag, tuple(tests)))
    return out


def fits(step: Step, e: Column) -> Column:
    tests = [e["tag"] == step.tag] if step.tag else []
    for name, how, value in step.tests:
        held = e[name]
        if how == "*=":
            tests.append(F.contains(held, F.lit(value)))
        elif how == ".":
            tests.append(F.contains(F.concat(F.lit(" "), F.regexp_replace(held, r"\s+", " "), F.lit(" ")), F.lit(f" {value} ")))
        else:
            tests.append(held == value)
    found = tests[0]
    for t in tests[1:]:
        found = found & t
    return found


def inside(e: Column, outer: Column) -> Column:
    return (e["n"] > outer["n"]) & (e["n"] <= outer["last"])


def selected(elements: Column | str, selector: str) -> Column:
    """The elements that a selector finds, in the order they open."""
    elements = F.col(elements) if isinstance(elements, str) else elements
    above, own = steps(selector)[:-1], steps(selector)[-1]
    if not above:
        return F.filter(elements, lambda e: fits(own, e))

    def below(k: int, holders: Column) -> Column:
        step = [*above, own][k]
        found = F.filter(elements, lambda e: fits(step, e) & F.exists(holders, lambda a: inside(e, a)))
        return found if k == len(above) else let(found, lambda h: below(k + 1, h))

    return let(F.filter(elements, lambda e: fits(above[0], e)), lambda h: below(1, h))


def without(elements: str, texts: str, noise: str) -> tuple[Column, Column]:
    """(elements, texts) that stand in none of the elements of `noise`, nor are one of them."""
    gone = lambda e: F.exists(noise, lambda z: (e["n"] >= z["n"]) & (e["n"] <= z["last"]))
    return F.filter(elements, lambda e: ~gone(e)), F.filter(texts, lambda t: ~_unsaid(t, noise))


def _unsaid(t: Column, noise: str) -> Column:
    return F.exists(noise, lambda z: (t["at"] >= z["first_text"]) & (t["at"] < z["end_text"]))


def text_of(e: Column, texts: str, part: str = "said") -> Column:
    """All texts of an element, one after another."""
    own = F.filter(texts, lambda t: (t["at"] >= e["first_text"]) & (t["at"] < e["end_text"]))
    return F.array_join(F.transform(own, lambda t: t[part]), " ")


def text_outside(e: Column, texts: str, noise: str) -> Column:
    """All of a page's `texts` that an element holds outside `noise`, read at their numbers and not sought among all."""
    own = F.slice(texts, e["first_text"] + 1, e["end_text"] - e["first_text"])
    return F.array_join(F.transform(F.filter(own, lambda t: ~_unsaid(t, noise)), lambda t: t["said"]), " ")


def innermost(elements: str, at: Column) -> Column:
    """The element that holds a text and opens last: of nested intervals, the one that starts last is the smallest."""
    return F.array_max(F.filter(elements, lambda e: (e["first_text"] <= at) & (at < e["end_text"])))


def described(e: Column) -> Column:
    """tag#id, else tag and its first two classes, else the tag."""
    classes = F.filter(F.split(e["class"], r"\s+"), lambda c: c != "")
    named = F.concat_ws(".", e["tag"], F.slice(classes, 1, 2))
    return F.when(e["id"] != "", F.concat_ws("#", e["tag"], e["id"])).otherwise(named)


def located(e: Column, elements: str) -> Column:
    """An element by its id, or by what describes it after the nearest element around it that has an id or a class."""
    named = F.filter(elements, lambda a: (a["n"] < e["n"]) & (e["n"] <= a["last"]) & ((a["id"] != "") | (a["class"] != "")))
    within = let(F.array_max(named), lambda a: F.when(a.isNull(), described(e)).otherwise(F.concat(described(a), F.lit(" > "), described(e))))
    return F.when(e["id"] != "", described(e)).otherwise(within)
