"""Personal data: base patterns, and sanitisation of terms that reveal protected entities.

Base spans are e-mail addresses, IP addresses, card and phone numbers.  What a pattern leaves in the text can
still identify: a name beside an address, say.  So every distinct base value is a protected entity, and the
corpus says how strongly a term t of the same document reveals an entity e:

    PMI(e; t) = log2(N * docs(e and t) / (docs(e) * docs(t)))      IC(e) = log2(N / docs(e))

A term that occurs with e in `LEAST_DOCS` documents or more discloses e if PMI >= ALPHA * IC.  Where PMI reaches
IC the term occurs with e only and is removed; else it is generalised; both wherever it stands, in every
document.  N and all counts are of whole documents over the whole corpus.  Everything is DataFrame and SQL functions.

The patterns below match what their plain forms match, but read a run of characters once: where a run can't
start a match, its later characters can't either, so a match starts after a character that is not of the run
or where the match before ended (\\G).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import others, renamed_apart, stored, table

LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no span of the kind: cheap, and never wrong.
HINTS = {
    "email": lambda text: F.contains(text, F.lit("@")),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda text: text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda text: F.contains(text, F.lit("+")),
}
TERM = r"[\p{L}\p{N}]+"
#: What stands for a base span in a masked text, and a term there that no span touches.
GAP = "\uffff"
FREE_TERM = rf"(?<![\p{{L}}\p{{N}}{GAP}])[\p{{L}}\p{{N}}]++(?!{GAP})"
#: Share of an entity's information that a term may reveal; documents that must show it, at least.
ALPHA = 0.8
LEAST_DOCS = 2
#: Terms or entities that are sent to every task, at most (each a short string); more are joined by shuffle.
MOST_SENT = 500_000
#: Matches that are counted off at once where terms are located.
RUN = 128

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
ALL_SPANS = "array<struct<kind:string,start:int,end:int,value:string,action:string>>"


def _digits(value: F.Column) -> F.Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: F.Column) -> F.Column:
    if kind == "ip":
        # Without leading zeros a part is at most 255 if it is short and its number is.
        return F.forall(
            F.transform(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+", "")),
            lambda part: (F.length(part) <= 3) & (F.coalesce(part.try_cast("int"), F.lit(0)) <= 255),
        )
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def located(text: F.Column, pattern: str, kind: str) -> F.Column:
    """Every match of `pattern` as (kind, start, end, value), in code points.

    What lies between matches and the matches themselves add up to the text, so lengths give positions.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))

    def add(acc: F.Column, piece: F.Column) -> F.Column:
        start = acc["at"] + F.length(piece["gap"])
        end = start + F.length(piece["value"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), piece["value"].alias("value"))
        return F.when(piece["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["found"], F.array(span)).alias("found")))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))
    return F.aggregate(pieces, none, add, lambda acc: acc["found"])


def base_spans(text: F.Column) -> F.Column:
    """All base spans by kind, then start; a match that fails its kind's test is dropped."""

    def of(kind: str) -> F.Column:
        found = F.filter(located(text, PATTERNS[kind], kind), lambda span: _valid(kind, span["value"]))
        return F.when(HINTS[kind](text), found).otherwise(F.array().cast(SPAN))

    return F.concat(*[of(kind) for kind in PATTERNS])


def _key(id_col: F.Column, text: F.Column) -> F.Column:
    return F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("-")), F.xxhash64(text).cast("string"))


def words(text: F.Column, pattern: str = TERM) -> F.Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def masked(text: F.Column, base: F.Column) -> F.Column:
    """The text with GAP for every base span (or overlapping spans), and nowhere else."""
    text = F.translate(text, GAP, " ")
    ordered = F.sort_array(F.transform(base, lambda s: F.struct(s["start"], s["end"])))

    def add(acc: F.Column, s: F.Column) -> F.Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.concat(acc["out"], gap, F.lit(GAP)).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(ordered, zero, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _sent(df: DataFrame) -> DataFrame:
    """`df`, sent to every task if it is short enough for that."""
    return F.broadcast(df) if df.limit(MOST_SENT + 1).count() <= MOST_SENT else df


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, term_docs): in how many rows of `docs` (text) each term with a letter occurs, over all whole texts."""
    return docs.select(F.explode(words(F.col("text"))).alias("term")).filter(F.col("term").rlike(r"\p{L}")).groupBy("term").agg(F.count(F.lit(1)).alias("term_docs"))


def disclosing(some: DataFrame, docs: DataFrame, alpha: float = ALPHA, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(entity, term, pmi, ic) of terms that disclose an entity; `some` holds the rows with base spans (row, text, base).

    A term counts with every entity of its document, wherever in the text the two stand.  No more documents hold
    both than hold either, so PMI <= log2(N / max(docs(e), docs(t))): pairs that cannot reach the threshold or
    `least_docs` by that are left out before they are counted, and no other.
    """
    n = float(docs.count())
    name = F.transform("base", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"])))
    held = some.select("row", F.explode(F.array_distinct(name)).alias("entity"))
    entities = stored(held.groupBy("entity").agg(F.count(F.lit(1)).alias("entity_docs")).filter(F.col("entity_docs") >= least_docs), "pii-entities")
    by_row = held.join(_sent(entities), "entity").groupBy("row").agg(F.collect_list(F.struct("entity", "entity_docs")).alias("entities"))
    most = entities.agg(F.max("entity_docs")).first()[0]
    log = lambda count: F.log2(F.lit(n) / count)
    reaches = lambda e, t: log(F.greatest(e, t)) >= alpha * log(e) - 1e-6
    counts = term_counts(docs).filter(F.col("term_docs") >= least_docs)
    if alpha <= 1:  # the bound grows with docs(e), so the commonest entity tells which terms are out for all
        counts = counts.filter(reaches(F.lit(most).cast("long"), F.col("term_docs")))
    counts = stored(counts, "pii-terms")
    terms = some.join(by_row, "row").select("entities", F.explode(words(masked(F.col("text"), F.col("base")), FREE_TERM)).alias("term")).filter(F.col("term").rlike(r"\p{L}"))
    met = terms.join(_sent(counts), "term").select("term", "term_docs", F.explode(F.filter("entities", lambda e: reaches(e["entity_docs"], F.col("term_docs")))).alias("e"))
    together = met.groupBy("e.entity", "e.entity_docs", "term", "term_docs").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= least_docs)
    pmi = F.log2(F.lit(n) * F.col("both") / (F.col("entity_docs") * F.col("term_docs")))
    return together.select("entity", "term", pmi.alias("pmi"), log(F.col("entity_docs")).alias("ic")).filter(F.col("pmi") >= alpha * F.col("ic"))


def term_spans(text: F.Column, base: F.Column, terms: F.Column, actions: F.Column) -> F.Column:
    """Every occurrence of `terms` outside the base spans, in order, each with its term's action.

    Matches are counted off in runs of RUN, and runs are then moved to where they start, so that no long list is
    copied for each match.
    """
    values = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    pieces = F.arrays_zip(F.split(text, TERM, -1).alias("gap"), values.alias("value"), F.transform(values, F.lower).alias("term"))
    none = F.array().cast(ALL_SPANS)

    def add(acc: F.Column, piece: F.Column) -> F.Column:
        start = acc["at"] + F.length(piece["gap"])
        end = start + F.coalesce(F.length(piece["value"]), F.lit(0))
        action = F.element_at(actions, F.array_position(terms, piece["term"]).cast("int"))
        span = F.struct(F.lit("term").alias("kind"), start.alias("start"), end.alias("end"), piece["term"].alias("value"), action.alias("action"))
        hit = F.array_contains(terms, piece["term"])
        return F.struct(end.alias("at"), F.when(hit, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    zero = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def moved(acc: F.Column, run: F.Column) -> F.Column:
        at = lambda s: F.struct(s["kind"], (s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["value"], s["action"])
        found = F.when(F.size(run["found"]) > 0, F.concat(acc["found"], F.array(F.transform(run["found"], at)))).otherwise(acc["found"])
        return F.struct((acc["at"] + run["at"]).alias("at"), found.alias("found"))

    # A transform of one element names the pieces, so that they are cut once and not for each run.
    runs = F.flatten(F.transform(F.array(pieces), lambda p: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int")), lambda i: F.aggregate(F.slice(p, i * RUN + 1, F.lit(RUN)), zero, add)
    )))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{ALL_SPANS}>").alias("found"))
    spans = F.flatten(F.aggregate(runs, start, moved, lambda acc: acc["found"]))
    return F.filter(spans, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))


def sanitised(text: F.Column, spans: F.Column) -> F.Column:
    """The text with base spans replaced by [KIND], terms by [TERM] or nothing; of overlapping spans the first counts."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"], s["action"])))

    def add(acc: F.Column, s: F.Column) -> F.Column:
        put = F.when(s["action"] == "remove", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["out"], gap, put).alias("out"), s["end"].alias("at")))

    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(ordered, zero, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, least_docs: int = LEAST_DOCS) -> DataFrame:
    """`docs` with pii_spans (kind, start, end, value, action; by kind, then start) and pii_text, the text without them.

    Kinds are email, ip, card, phone and term; offsets are code points, end exclusive.  A null text counts as
    empty and stays null; rows that repeat are each treated, and count as documents of their own; null ids are
    ordinary; an empty table gives no rows.  Input columns named like an added one are replaced.
    """
    docs = renamed_apart(docs, ["pii_spans", "pii_text", "__own", "__key", "__base", "__terms", "__actions", "__spans"])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    narrow = docs.select(_key(F.col(f"`{id_col}`"), text).alias("key"), text.alias("text"))
    found = narrow.withColumn("base", base_spans(F.col("text"))).filter(F.size("base") > 0)
    some = stored(found.withColumn("row", F.monotonically_increasing_id()), "pii-base")
    revealing = disclosing(some, narrow.select("text"), alpha, least_docs)
    action = F.when(F.max(F.col("pmi") - F.col("ic")) >= -1e-9, "remove").otherwise("generalise")
    marked = stored(revealing.groupBy("term").agg(action.alias("action")), "pii-disclosing")
    # A term that discloses an entity is sanitised in every document that holds it, with or without the entity.
    by_key = (
        narrow.select("key", F.explode(words(F.col("text"))).alias("term"))
        .join(_sent(marked), "term")
        .groupBy("key")
        .agg(F.sort_array(F.collect_set(F.struct("term", "action"))).alias("marks"))
        .select("key", F.col("marks.term").alias("__terms"), F.col("marks.action").alias("__actions"))
    )
    spans = some.dropDuplicates(["key"]).select("key", "base").join(by_key, "key", "full").withColumnsRenamed({"key": "__key", "base": "__base"})
    out = docs.withColumn("__own", _key(F.col(f"`{id_col}`"), text)).join(spans, F.col("__own") == F.col("__key"), "left")
    none = F.array().cast(ALL_SPANS)
    known = F.coalesce(F.col("__base"), F.array().cast(SPAN))
    base = F.transform(known, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit("replace").alias("action")))
    extra = F.when(F.col("__terms").isNotNull(), term_spans(text, known, F.col("__terms"), F.col("__actions"))).otherwise(none)
    out = out.withColumn("__spans", F.concat(base, extra))
    every, own = F.col("__spans"), F.col(f"`{text_col}`")
    cleaned = F.when(F.size(every) > 0, sanitised(own, every)).otherwise(own)
    return out.select(*[docs[f"`{c}`"] for c in others(docs, [])], every.alias("pii_spans"), cleaned.alias("pii_text"))


def _listed(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' base spans, counted and hashed, and all spans with those the corpus adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sanitise(docs)
    spans = F.col("pii_spans")

    def count(kind: str) -> F.Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"] != "term")
    return found.select(
        "doc_id", *[count(kind) for kind in PATTERNS], F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(spans).alias("spans")
    )
