"""Merges of products in the order they happened: where offers end up, and what each product has learnt.

A merge moves whatever offers its source has at that time, so an offer of A follows the first merge of A, then the
first later one of where it came to, and so on.  Every merge has one next merge, always later: a forest, walked by
pointer doubling in as many rounds as the logarithm of the longest chain.  Circles of merges need no rule, since
time doesn't run in circles: A into B and later B into A brings A's offers home.

What a target doesn't know it takes over from its source as that is known at the time; the source keeps it.  So a
field reaches a product with the earliest merge from one that knows it by then, found by relaxation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.sources.files import stored

#: Merges that one window of a product looks at; longer histories are told by their spans first.
SPAN = 1 << 16


def _next(merges: DataFrame) -> DataFrame:
    """`merges` (id, source, target) with `next`: the first later merge whose source is the target, or null.

    Arrivals and departures of a product are looked at in spans of ids; an arrival after a span's last departure goes
    to the first of the next span that has one.
    """
    arrivals = merges.select(F.col("target").alias("at"), "id", F.lit(None).cast("long").alias("leaves"))
    departures = merges.select(F.col("source").alias("at"), "id", F.col("id").alias("leaves"))
    moves = arrivals.unionByName(departures).withColumn("span", F.expr(f"id div {SPAN}"))
    later = Window.partitionBy("at", "span").orderBy("id").rangeBetween(1, Window.unboundedFollowing)
    within = moves.withColumn("soon", F.min("leaves").over(later)).filter("leaves IS NULL")
    spans = moves.groupBy("at", "span").agg(F.min("leaves").alias("first"))
    spans = spans.withColumn("then", F.min("first").over(Window.partitionBy("at").orderBy("span").rangeBetween(1, Window.unboundedFollowing)))
    found = within.join(spans.select("at", "span", "then"), ["at", "span"]).select("id", F.coalesce("soon", "then").alias("next"))
    return merges.join(found, "id")


def chains(merges: DataFrame) -> DataFrame:
    """(id, source, target, final, hops): every merge, where what it moved is at last, and after how many merges.

    `merges` have id (distinct; their order), source and target; merges with null ends, or of a product with itself,
    never happened.
    """
    real = merges.filter("source IS NOT NULL AND target IS NOT NULL AND source <> target").select(F.col("id").cast("long"), "source", "target")
    made = stored(_next(stored(real, "merges")).withColumn("final", F.col("target")).withColumn("hops", F.lit(1).cast("long")), "chains")
    while made.filter("next IS NOT NULL").limit(1).count():
        ahead = made.select(F.col("id").alias("next"), F.col("final").alias("to"), F.col("hops").alias("more"), F.col("next").alias("after"))
        doubled = made.join(ahead, "next", "left")
        made = stored(
            doubled.select("id", "source", "target", F.col("after").alias("next"), F.coalesce("to", "final").alias("final"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "chains"
        )
    return made.drop("next")


def homes(merges: DataFrame) -> DataFrame:
    """(product, final, hops) of every product that was ever merged: where the offers it had at first are at last."""
    first = chains(merges).groupBy("source").agg(F.min_by(F.struct("final", "hops"), "id").alias("f"))
    return first.select(F.col("source").alias("product"), "f.final", "f.hops")


def rehomed(offers: DataFrame, merges: DataFrame) -> DataFrame:
    """`offers` (product_uuid, ...) with product_uuid as it is after all merges, and `group_uuid` for monitored ones."""
    to = homes(merges).select(F.col("product").alias("product_uuid"), "final")
    moved = offers.join(to, "product_uuid", "left").withColumn("product_uuid", F.coalesce("final", "product_uuid")).drop("final")
    return moved.withColumn("group_uuid", F.when(F.col("monitored_uuid").isNotNull(), F.col("product_uuid")))


def learnt(products: DataFrame, merges: DataFrame, fields: list[str]) -> DataFrame:
    """(product, field, value, since, origin): what every product knows after all merges, and from whom.

    `since` is the merge that told it, or null for what it always knew.  Empty values are unknown.
    """
    real = stored(merges.filter("source IS NOT NULL AND target IS NOT NULL AND source <> target").select(F.col("id").cast("long"), "source", "target"), "merges")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("f")
    own = products.select(F.col("uuid").alias("product"), each).filter("coalesce(f.value, '') <> ''")
    own = stored(own.select("product", "f.field", "f.value", F.lit(-1).cast("long").alias("since"), F.col("product").alias("origin")), "known")
    known, seen = own, None
    while True:
        told = real.join(known, F.col("source") == F.col("product")).filter("since < id")
        told = told.select(F.col("target").alias("product"), "field", "value", F.col("id").alias("since"), "origin")
        # Only the first to tell counts; what a product knew by itself has the least `since` of all.
        firsts = own.unionByName(told).groupBy("product", "field").agg(F.min(F.struct("since", "value", "origin")).alias("x"))
        known = stored(firsts.select("product", "field", "x.value", "x.since", "x.origin"), "known")
        now = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("product", "field", "since", "value").cast("decimal(38,0)"))).first()
        if now == seen:
            return known.withColumn("since", F.when(F.col("since") >= 0, F.col("since")))
        seen = now
