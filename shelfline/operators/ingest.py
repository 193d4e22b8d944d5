"""Ingest of listings in order: each joins a product of the catalogue or one that an earlier listing made.

Which product a listing joins depends on what earlier ones made and filled in, so the order decides.  Listings
and products that no chain of shared values connects play no part for each other.  So these groups are found first,
over the values alone, and each is folded in order in one task; listings without a value make a product at once.

A group of more than MOST_FOLDED rows is in no single task.  There the answer is a fixpoint: all listings are
matched at once against the catalogue and against what the listings before them contributed by the last round's answer.
The first listing is right after one round, and each that depends on right ones in the next; rounds end when no answer
changes, so there are as many as the longest chain of listings that depend on each other, not as many as listings.

A product's field is the first that is known of it, which is a minimum over the listings it was given.  Of all the
products that hold a value only those that were made before every product that held it earlier can be found;
that is a short list for each value, however many products hold it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.operators.resolution import IDENTIFIERS, MERGE, SUGGEST, close_names, with_names
from shelfline.sources.files import stored

#: Places in the order that one window looks at when a value's list is thinned out.
SPAN = 1 << 20
#: Rows of a connected group that one task folds in order, at most; larger groups are matched in rounds.
MOST_FOLDED = 50_000
#: Fields that a product takes from the first listing that has them.
ATTRIBUTES = ("brand", "release_date", "collection")
#: What is said of a listing.
JOINED, PROPOSED, MADE = "rattaché à « {} » ({}, confiance {})", "nouveau produit — fusion possible proposée (confiance {})", "nouveau produit"


def _filled(fields: list[str]) -> F.Column:
    """(field, value) of the fields that aren't empty."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return F.explode(F.filter(each, lambda x: F.coalesce(x["value"], F.lit("")) != "")).alias("f")


def _firsts(facts: DataFrame, key: list[str]) -> DataFrame:
    """Of `facts` (key, since, born, product) those that were born before all of the same key with an earlier since."""
    place = "since.seq" if isinstance(facts.schema["since"].dataType, T.StructType) else "since"
    thin = facts.groupBy(*key, "since").agg(F.min(F.struct("born", "product")).alias("p")).withColumn("span", F.expr(f"{place} div {SPAN}"))
    for part in (["span"], []):  # within a span first, so that no value's whole list is sorted at once
        before = Window.partitionBy(*key, *part).orderBy("since").rowsBetween(Window.unboundedPreceding, -1)
        thin = thin.withColumn("least", F.min("p").over(before)).filter("least IS NULL OR p < least")
    return thin.select(*key, "since", "p.born", "p.product")


def _turn() -> F.Column:
    """A listing's place in the order: equal numbers are taken by draft_id."""
    return F.struct(F.col("seq").cast("long").alias("seq"), "draft_id")


def _before_all() -> F.Column:
    return F.struct(F.lit(-1).cast("long").alias("seq"), F.lit("").alias("draft_id"))


def _born(at: str, made: int) -> F.Column:
    return F.struct(F.lit(made).alias("made"), F.col(at).cast("long").alias("at"))


def _known(catalog: DataFrame, told: DataFrame | None, fields: list[str]) -> DataFrame:
    """(product, born, field, value, since): the first that is known of each field, and since which listing.

    `told` are listings with the product and born that they were given.
    """
    facts = catalog.select(F.col("uuid").alias("product"), _born("created_seq", 0).alias("born"), _before_all().alias("since"), _filled(fields))
    if told is not None:
        facts = facts.unionByName(told.select("product", "born", _turn().alias("since"), _filled(fields)))
    firsts = facts.groupBy("product", "f.field").agg(F.min(F.struct("since", "f.value", "born")).alias("x"))
    return firsts.select("product", "x.born", "field", "x.value", "x.since")


def _alone() -> list[F.Column]:
    """The product that a listing makes if it joins none."""
    return [F.concat(F.lit("n:"), "draft_id").alias("product"), _born("seq", 1).alias("born")]


def _keys(fields: list[str]) -> F.Column:
    """Numbers of the values that a row carries, ascending.  Two values of one number only make a group larger."""
    each = [F.when(F.col(f).cast("string") != "", F.xxhash64(F.lit(f), F.col(f).cast("string"))) for f in fields]
    return F.array_sort(F.array_compact(F.array(*each))) if each else F.array().cast("array<bigint>")


def _groups(keyed: DataFrame) -> DataFrame:
    """(key, group): of keys that a row of `keyed` (keys) has beside others, the smallest that chains of rows reach.

    Every round each key takes the smallest label among its neighbours' and then its label's label, which halves chains.
    """
    edges = keyed.filter("size(keys) > 1").select(F.col("keys")[0].alias("a"), F.explode(F.slice("keys", 2, 99)).alias("b")).filter("a <> b")
    both = stored(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct(), "key-edges")
    labels = both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("near")).select("key", F.least("key", "near").alias("group"))
    while True:
        seen = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("group").alias("near"))
        stepped = stored(labels.join(seen, "key").select("key", "group", F.least("group", "near").alias("next")), "key-steps")
        jump = stepped.select(F.col("key").alias("next"), F.col("next").alias("far"))
        moved = stored(stepped.join(jump, "next").select("key", "group", F.least("next", "far").alias("next")), "key-groups")
        labels = moved.select("key", F.col("next").alias("group"))
        if moved.filter("next <> group").isEmpty():
            return labels


def _folded(rows: DataFrame, kept: list[str], merging: list[tuple[str, int]]) -> DataFrame:
    """Listings among `rows` with product, born, score and method, group by group in order.

    Rows are those of whole groups: _group, _kind (0 products, 1 listings), _at (their place), _id, a column _f0, _f1, ...
    for each field of `merging`, surest first, and the columns `kept` of listings.  What is held is one group's values.
    """
    n = len(merging)
    given = T.StructType.fromDDL("product string, _made int, _born long, score int, method string")
    out = T.StructType([*[rows.schema[c] for c in kept], *given.fields])
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string())

    def fold(batches):
        # holders: of each field's value the product made first; known: fields of products that are filled.
        group, holders, known = None, {}, set()
        for batch in batches:
            told, is_listing = [], []
            for of, kind, at, name, *values in zip(*(batch.column(k).to_pylist() for k in range(4 + n))):
                if of != group:
                    group, holders, known = of, {}, set()
                found = next(((i, held) for i, v in enumerate(values) if v and (held := holders.get((i, v)))), None) if kind else None
                product = found[1] if found else (kind, at is not None, at or 0, f"n:{name}" if kind else name)
                for i, v in enumerate(values):
                    if v and (product[3], i) not in known:
                        known.add((product[3], i))
                        holders[i, v] = min(holders.get((i, v), product), product)
                is_listing.append(kind == 1)
                if kind:
                    told.append((product[3], product[0], product[2] if product[1] else None, *(merging[found[0]][::-1] if found else (None, None))))
            if told:
                listings = batch.filter(pa.array(is_listing))
                yield pa.RecordBatch.from_arrays([*listings.columns[4 + n :], *[pa.array(x, t) for x, t in zip(zip(*told), kinds)]], names=out.names)

    ordered = rows.repartition("_group").sortWithinPartitions("_group", "_kind", "_at", "_id").mapInArrow(fold, out)
    return ordered.select(*kept, "product", F.struct(F.col("_made").alias("made"), F.col("_born").alias("at")).alias("born"), "score", "method")


def _in_rounds(drafts: DataFrame, catalog: DataFrame, merging: list[tuple[str, int]]) -> DataFrame:
    """Listings with product, born, score and method as a fixpoint of rounds over all of them."""
    scores, fields = F.create_map(*[F.lit(x) for pair in merging for x in pair]), [f for f, _ in merging]
    wanted = stored(drafts.select("draft_id", "seq", _filled(fields)).select("draft_id", "seq", "f.*", scores[F.col("f.field")].alias("score")), "listing-keys")
    placed, seen = None, None
    while True:
        told = None if placed is None else drafts.join(placed.select("draft_id", "product", "born"), "draft_id")
        facts = _firsts(_known(catalog, told, fields), ["field", "value"])
        hits = wanted.join(facts, ["field", "value"]).filter(F.col("since") < _turn()).groupBy("draft_id")
        best = hits.agg(F.min(F.struct((-F.col("score")).alias("less"), "born", "product", "field")).alias("m"))
        own = drafts.select("draft_id", F.struct(*_alone()).alias("own")).join(best, "draft_id", "left")
        placed = stored(
            own.select("draft_id", F.coalesce("m.product", "own.product").alias("product"), F.coalesce("m.born", "own.born").alias("born"), (-F.col("m.less")).alias("score"), F.col("m.field").alias("method")),
            "placements",
        )
        now = placed.agg(F.count(F.lit(1)), F.sum(F.xxhash64("draft_id", "product", "score").cast("decimal(38,0)"))).first()
        if now == seen:
            return drafts.join(placed, "draft_id")
        seen = now


def _placed(drafts: DataFrame, catalog: DataFrame) -> DataFrame:
    """`drafts` with product, born, score and method: the product of every listing; score is null where it makes one."""
    carried = set(drafts.columns) & set(catalog.columns)
    merging = sorted([(f, s) for f, s in IDENTIFIERS if f in carried and s >= MERGE], key=lambda x: -x[1])
    fields = [f for f, _ in merging]
    drafts = stored(drafts.withColumn("seq", F.col("seq").cast("long")).withColumn("keys", _keys(fields)), "listings")
    kept = [c for c in drafts.columns if c != "keys"]
    alone = drafts.filter("size(keys) = 0").select(*kept, *_alone(), F.lit(None).cast("int").alias("score"), F.lit(None).cast("string").alias("method"))
    listed = catalog.withColumn("keys", _keys(fields)).filter("size(keys) > 0")
    values = [F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)]
    first = F.col("keys")[0].alias("key")
    asked = drafts.filter("size(keys) > 0").select(first, F.lit(1).alias("_kind"), F.col("seq").alias("_at"), F.col("draft_id").alias("_id"), *values, F.struct(*kept).alias("listing"))
    held = listed.select(first, F.lit(0).alias("_kind"), F.col("created_seq").cast("long").alias("_at"), F.col("uuid").alias("_id"), *values, F.lit(None).cast(asked.schema["listing"].dataType).alias("listing"))
    groups = _groups(drafts.select("keys").unionByName(listed.select("keys")))
    rows = asked.unionByName(held).join(groups, "key", "left").withColumn("_group", F.coalesce("group", "key"))
    cols = ["_group", "_kind", "_at", "_id", *[f"_f{i}" for i in range(len(fields))]]
    rows = stored(rows.select(*cols, "listing"), "grouped-listings")
    large = stored(rows.groupBy("_group").count().filter(F.col("count") > MOST_FOLDED).select("_group"), "large-groups")
    small = rows.join(F.broadcast(large), "_group", "left_anti")
    found = alone.unionByName(_folded(small.select(*cols, "listing.*"), kept, merging))
    if not large.isEmpty():
        rest = rows.join(F.broadcast(large), "_group", "left_semi")
        ours = rest.filter("_kind = 0").select(F.col("_id").alias("uuid"), F.col("_at").alias("created_seq"), *[F.col(f"_f{i}").alias(f) for i, f in enumerate(fields)])
        found = found.unionByName(_in_rounds(rest.filter("_kind = 1").select("listing.*"), ours, merging))
    return stored(found, "placed")


def placements(drafts: DataFrame, catalog: DataFrame) -> DataFrame:
    """(draft_id, seq, product, born, score, method): the product of every listing; score is null where it makes one.

    `drafts` have distinct draft_id, and seq from 0 on, which is their order; those of one seq go by draft_id.  Of the
    identifying fields those count that both sides carry.  Null and empty values are no key; an empty catalogue or no listings are as they are.
    """
    return _placed(drafts, catalog).select("draft_id", "seq", "product", "born", "score", "method")


def _learnt(catalog: DataFrame, placed: DataFrame) -> DataFrame:
    """(product, and a struct of value and since for each attribute): the first that is known of it."""
    fields = (*ATTRIBUTES, "model_number")
    facts = catalog.select(F.col("uuid").alias("product"), _before_all().alias("since"), *fields).unionByName(placed.select("product", _turn().alias("since"), *fields))
    return facts.groupBy("product").agg(*[F.min(F.when(F.col(f).cast("string") != "", F.struct("since", F.col(f).cast("string").alias("value")))).alias(f) for f in fields])


def _rungs(wide: DataFrame) -> DataFrame:
    """(score, method, block, name, since, born, product) of every rung below merging that a product can be found by."""
    low = lambda f: F.lower(F.trim(F.col(f"{f}.value")))
    rung = lambda score, method, block, name, since: F.struct(
        F.lit(score).alias("score"), F.lit(method).alias("method"), F.when(block != "", block).alias("block"), name.alias("name"), since.alias("since")
    )
    none = F.lit("")
    rungs = [
        rung(88, "model_number", F.col("model_number.value"), none, F.col("model_number.since")),
        rung(85, "name_brand", F.when(low("brand") != "", F.concat_ws("\n", low("brand"), "name_key")), none, F.col("brand.since")),
        rung(80, "name_release_date", F.col("release_date.value"), F.col("name_norm"), F.col("release_date.since")),
        rung(75, "name_collection", low("collection"), F.col("name_norm"), F.col("collection.since")),
        rung(70, "name_only", F.concat(F.lit("\n"), "name_key"), none, F.col("made_at")),
    ]
    return wide.select("product", "born", F.explode(F.array(*rungs)).alias("r")).filter("r.block IS NOT NULL AND r.name IS NOT NULL").select("product", "born", "r.*")


def ingested(drafts: DataFrame, catalog: DataFrame) -> DataFrame:
    """What became of every listing: draft_id, product, created, score, method, candidate, decision, summary.

    A match of 90 or more joins the product and fills in its empty fields; one of 70 or more makes a product and
    proposes the other; else the listing makes a product.  Each sees the catalogue and what came before it.
    """
    for f in (*ATTRIBUTES, "model_number"):
        drafts = drafts if f in drafts.columns else drafts.withColumn(f, F.lit(None).cast("string"))
        catalog = catalog if f in catalog.columns else catalog.withColumn(f, F.lit(None).cast("string"))
    placed = _placed(drafts, catalog)
    made = with_names(placed.filter("score IS NULL"))
    names = with_names(catalog).select(F.col("uuid").alias("product"), _born("created_seq", 0).alias("born"), "name", "name_norm", "name_key", _before_all().alias("made_at"))
    made = stored(made.withColumn("made_at", _turn()), "made")
    names = stored(names.unionByName(made.select(names.columns)), "product-names")
    key = ["score", "method", "block", "name"]
    found_by = stored(_firsts(_rungs(names.drop("name").join(_learnt(catalog, placed), "product", "left")), key), "product-rungs")

    told = [F.when(F.col(f).cast("string") != "", F.struct(F.col(f).cast("string").alias("value"), _before_all().alias("since"))).alias(f) for f in (*ATTRIBUTES, "model_number")]
    wanted = _rungs(made.select("product", F.struct("draft_id", "seq").alias("born"), "name_norm", "name_key", "made_at", *told))
    wanted = stored(wanted.select("born.*", *key), "wanted-rungs")
    block = F.struct("method", "block").alias("block")
    near = close_names(wanted.filter("name <> ''").select(block, "name").distinct(), found_by.filter("name <> ''").select(block, "name").distinct())
    near = near.select("block.method", "block.block", F.col("l").alias("name"), F.col("r").alias("other"))
    close = wanted.filter("name <> ''").join(near, ["method", "block", "name"])
    close = close.join(found_by.withColumnRenamed("name", "other").withColumnRenamed("product", "candidate").drop("score"), ["method", "block", "other"])
    exact = wanted.filter("name = ''").join(found_by.withColumnRenamed("product", "candidate"), key)
    cols = ["draft_id", "seq", "score", "method", "candidate", "born", "since"]
    hits = exact.select(*cols).unionByName(close.select(*cols)).filter("since.seq < seq").groupBy("draft_id")
    proposed = hits.agg(F.min(F.struct((-F.col("score")).alias("less"), "born", "candidate", "method")).alias("m"))

    titles = names.select("product", F.col("name").alias("title"))
    rows = placed.join(proposed, "draft_id", "left").join(titles, "product", "left")
    created = F.col("score").isNull()
    score, method = F.coalesce("score", -F.col("m.less")), F.coalesce(F.col("method"), F.col("m.method"))
    summary = (
        F.when(~created, F.format_string(JOINED.replace("{}", "%s"), "title", "method", "score"))
        .when(F.col("m").isNotNull(), F.format_string(PROPOSED.replace("{}", "%s"), -F.col("m.less"))).otherwise(MADE)
    )
    return rows.select(
        "draft_id", "seq", "product", created.alias("created"), score.alias("score"), method.alias("method"), F.coalesce(F.when(~created, F.col("product")), F.col("m.candidate")).alias("candidate"),
        F.when(~created, "merge").when(-F.col("m.less") >= SUGGEST, "suggest").otherwise("new").alias("decision"), summary.alias("summary"),
    )


def products_after(drafts: DataFrame, catalog: DataFrame, placed: DataFrame, fields: list[str]) -> DataFrame:
    """(product, listings, and `fields`): every product after the ingest, its empty fields filled in by its listings."""
    told = drafts.withColumn("seq", F.col("seq").cast("long")).join(placed.select("draft_id", "product", "born"), "draft_id")
    known = _known(catalog, told, fields)
    wide = known.groupBy("product").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    everyone = catalog.select(F.col("uuid").alias("product")).unionByName(placed.select("product")).distinct()
    listings = placed.groupBy("product").agg(F.count(F.lit(1)).alias("listings"))
    return everyone.join(listings, "product", "left").join(wide, "product", "left").select("product", F.coalesce("listings", F.lit(0)).alias("listings"), *fields)


def events_of(outcomes: DataFrame) -> DataFrame:
    """(draft_id, kind, product, detail) that an ingest publishes: products made, proposals, offers linked."""
    kinds = F.array(
        F.struct(F.lit("catalog_product_created").alias("kind"), F.lit(None).cast("string").alias("detail"), F.col("created").alias("told")),
        F.struct(F.lit("catalog_match_pending").alias("kind"), F.col("candidate").alias("detail"), (F.col("decision") == "suggest").alias("told")),
        F.struct(F.lit("catalog_offer_linked").alias("kind"), F.col("summary").alias("detail"), F.lit(True).alias("told")),
    )
    return outcomes.select("draft_id", "product", F.explode(F.filter(kinds, lambda k: k["told"])).alias("k")).select("draft_id", "k.kind", "product", "k.detail")
