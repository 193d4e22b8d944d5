"""Mixing sources to target weights by sampling fixed-length blocks.

Each source's tokens (words), document after document in a seeded order, are one stream cut into blocks of
`BLOCK` tokens; a stream's last block may be shorter.  The mixture is a row of slots, each one block, cut into output shards.  For every shard the
number of slots of each source is drawn: a multinomial draw whose probabilities are what each source still
has to give, so the draws of all shards together meet the targets.  Slot j of a source holds the block that a
seeded permutation of the source's block numbers puts at j, pass after pass over the source; joining slots to
blocks by (source, block) gives the mixture.  A source's last slot uses as much of its block as its target still
needs, so that short blocks, which a small source may have nothing but, cost it nothing: the mixture holds
exactly the target of every source, rounded to a token.

Positions in a stream are sums over buckets of documents, so no task ever holds a whole source.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.llm.common import stored, table, unused

#: Tokens in a block; slots in an output shard at least; documents in a bucket, about.
BLOCK = 64
SHARD_SLOTS = 1 << 16
#: Output shards at most: larger mixtures have larger shards, so the draws stay few.
MOST_SHARDS = 4096
BUCKET_ROWS = 8192
#: No source is taken more often than this.
MOST_PASSES = 3
TOKEN = r"[^\x20\x09-\x0D]+"


def token_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size): targets that fill `MOST_PASSES` times a source at most.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating.  Filling by weight with caps has one
    answer: in order of cap by weight, sources are at their cap until the rest, shared by weight among those
    that are left, fits under the next cap.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    everyone = Window.orderBy(F.col("source").isNull(), "source")
    weighed = by_source.withColumn("weight", F.pmod(F.row_number().over(everyone) - 1, F.lit(3)) + 1)
    cap = F.col("source_size") * MOST_PASSES
    filling = Window.orderBy("fill", F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    weighed = weighed.withColumn("fill", cap / F.col("weight"))
    weighed = weighed.select(
        "*",
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("capped"),
        F.sum("weight").over(after).alias("left"),
        F.sum("source_size").over(whole).alias("total"),
    )
    # The first source that stays under its cap sets the level of all later ones; later ones compute lower levels.
    level = (F.col("total") - F.col("capped")) / F.col("left")
    found = F.max(F.when(level < F.col("fill"), level)).over(whole)
    target = F.when(found.isNull() | (F.col("fill") <= found), cap.cast("double")).otherwise(F.col("weight") * found)
    return weighed.select("source", "source_size", "n_docs", target.alias("target"))


def placed_documents(docs: DataFrame, seed: int, n_rows: int) -> DataFrame:
    """`docs` (uid, id, source, size, content) plus `at`: the tokens before each document in its source's stream.

    The order hashes ids and contents, so it does not depend on how the table is laid out; uid only parts rows
    that are equal in all of them, which may change places.
    """
    buckets = max(1, n_rows // BUCKET_ROWS)
    h = F.xxhash64(F.lit(seed), "id", "content")
    bucketed = docs.withColumn("bucket", F.pmod(h, F.lit(buckets))).withColumn("h", h)
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "id", "content", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
    own = bucketed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    matched = own["source"].eqNullSafe(starts["source"]) & (own["bucket"] == starts["bucket"])
    return own.join(starts, matched).select(*[own[c] for c in docs.columns], (starts["start"] + own["inside"]).alias("at"))


def draw_slots(seed: int, slots: list[int]):
    """(shard, source number, slots of the source before, slots drawn), shard by shard; `slots`: of each source."""
    left = np.array(slots, dtype=np.int64)
    done = np.zeros_like(left)
    size = max(SHARD_SLOTS, -(-int(left.sum()) // MOST_SHARDS))
    rng, shard = np.random.default_rng(seed), 0
    while left.sum():
        want = int(min(size, left.sum()))
        drawn = np.zeros_like(left)
        while (short := want - int(drawn.sum())) > 0:
            rest = left - drawn
            drawn += np.minimum(rng.multinomial(short, rest / rest.sum()), rest)
        for k in np.flatnonzero(drawn):
            yield shard, int(k), int(done[k]), int(drawn[k])
        left -= drawn
        done += drawn
        shard += 1


def _rounds(n: int, key: int) -> tuple[int, np.ndarray]:
    """(half the bits, the keys of the Feistel rounds) of the permutation of 0..n-1."""
    return max(1, (max(1, n - 1).bit_length() + 1) // 2), np.random.default_rng(key).integers(1, 1 << 63, 4, dtype=np.uint64)


def _mixed(low: np.ndarray, key: np.uint64, half: int) -> np.ndarray:
    mixed = (low + key) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(32)) & np.uint64((1 << half) - 1)


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1 at `index`: Feistel rounds over an even number of bits, walked until under n."""
    half, keys = _rounds(n, key)
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        high, low = out[walking] >> np.uint64(half), out[walking] & np.uint64((1 << half) - 1)
        for k in keys:
            high, low = low, high ^ _mixed(low, k, half)
        out[walking] = (high << np.uint64(half)) | low
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def place_of(value: int, n: int, key: int) -> int:
    """Where `permuted` puts `value`: the same rounds backwards."""
    half, keys = _rounds(n, key)
    x = np.array([value], dtype=np.uint64)
    while True:
        high, low = x >> np.uint64(half), x & np.uint64((1 << half) - 1)
        for k in keys[::-1]:
            high, low = low ^ _mixed(high, k, half), high
        x = (high << np.uint64(half)) | low
        if x[0] < n:
            return int(x[0])


def _pass_key(seed: int, source_no: int, turn: int) -> int:
    return hash((seed, source_no, turn)) & 0x7FFFFFFF


def slots_for(target: int, size: int, block: int, seed: int, source_no: int) -> tuple[int, int]:
    """(slots, tokens that the last of them uses) that hold exactly `target` tokens of a source of `size`."""
    blocks = -(-size // block)
    turns, rest = divmod(target, size)
    last = size - (blocks - 1) * block  # the tokens of the stream's last block
    if not rest:
        at_end = int(permuted(np.array([blocks - 1]), blocks, _pass_key(seed, source_no, turns - 1))[0]) if turns else 0
        return turns * blocks, last if at_end == blocks - 1 else block
    missing = block - last
    short_at = place_of(blocks - 1, blocks, _pass_key(seed, source_no, turns))
    n = -(-rest // block)
    held = n * block - (missing if short_at < n else 0)
    if held < rest:
        n, held = n + 1, held + (last if short_at == n else block)
    used = (last if short_at == n - 1 else block) - (held - rest)
    return turns * blocks + n, used


COUNTS = pa.schema([("shard", pa.int32()), ("source_no", pa.int32()), ("source", pa.string()), ("blocks", pa.int64()), ("first", pa.int64()), ("slots", pa.int64()), ("all_slots", pa.int64()), ("last_uses", pa.int64())])
SLOTS = pa.schema([("shard", pa.int32()), ("source", pa.string()), ("slot", pa.int64()), ("pass", pa.int32()), ("block", pa.int64()), ("uses", pa.int64())])


def drawn_counts(targets: DataFrame, block: int, seed: int) -> DataFrame:
    """(shard, source_no, source, blocks, first, slots, all_slots, last_uses): slots of each source in each output shard.

    The draws run in one task over the sources alone, which it holds (a row each); what it draws leaves it in batches.
    """
    numbered = targets.filter("source_size > 0").select("source", "source_size", F.round("target").cast("long").alias("target"))

    def draw(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        wanted = [slots_for(r["target"], r["source_size"], block, seed, k) for k, r in enumerate(rows)]
        held = []
        for shard, k, first, n in draw_slots(seed, [slots for slots, _ in wanted]):
            held.append((shard, k, rows[k]["source"], -(-rows[k]["source_size"] // block), first, n, *wanted[k]))
            if len(held) == BUCKET_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), COUNTS)], schema=COUNTS)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), COUNTS)], schema=COUNTS)

    kinds = "shard int, source_no int, source string, blocks long, first long, slots long, all_slots long, last_uses long"
    return numbered.coalesce(1).mapInArrow(draw, kinds)


def placed_slots(counts: DataFrame, block: int, seed: int) -> DataFrame:
    """(shard, source, slot, pass, block, uses): every slot with the block its source's permutation puts there.

    uses: how many of the block's tokens the slot takes, from its first on.
    """
    whole = block

    def place(batches):
        for batch in batches:
            for r in batch.to_pylist():
                for at in range(r["first"], r["first"] + r["slots"], SHARD_SLOTS):
                    slot = np.arange(at, min(at + SHARD_SLOTS, r["first"] + r["slots"]))
                    turn = slot // r["blocks"]
                    block = np.empty_like(slot)
                    for t in np.unique(turn):
                        own = turn == t
                        block[own] = permuted(slot[own] % r["blocks"], r["blocks"], _pass_key(seed, r["source_no"], int(t)))
                    n = len(slot)
                    uses = np.where(slot == r["all_slots"] - 1, r["last_uses"], whole)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["shard"]] * n, pa.int32()), pa.array([r["source"]] * n, pa.string()), pa.array(slot), pa.array(turn.astype(np.int32)), pa.array(block), pa.array(uses)],
                        schema=SLOTS,
                    )

    spread = counts.repartition(counts.sparkSession.sparkContext.defaultParallelism * 4, "shard", "source_no")
    return spread.mapInArrow(place, "shard int, source string, slot long, pass int, block long, uses long")


@dataclass
class Mixture:
    """What `mix` returns; all tables are narrow.

    documents: uid, id, source, size, content, source_size, target, at.  targets: source, source_size, n_docs, target.
    rows: shard, source, slot, pass, block, uid, id, start, taken: the tokens start..start+taken-1 of a document.
    """

    documents: DataFrame
    targets: DataFrame
    rows: DataFrame


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = BLOCK, seed: int = 17) -> Mixture:
    """Mix `docs` by source; `Mixture` describes the result, `mixed_text` gives its texts.

    Null or empty texts have no tokens and are never taken; a null source is a source of its own and comes
    last; rows that repeat, ids included, are documents of their own; an empty table gives an empty mixture;
    other columns play no part.  Equal rows and seeds give equal mixtures, however
    the table is split into files or partitions.
    """
    sized = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), token_count(F.col(f"`{text_col}`")).alias("size"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("content"),
    )
    sized = stored(sized.withColumn("uid", F.monotonically_increasing_id()), "mixing")
    targets = stored(source_targets(sized), "mixing-targets")
    n_rows = targets.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    placed = placed_documents(sized.select("uid", "id", "source", "size", "content"), seed, n_rows)
    slots = placed_slots(drawn_counts(targets, block, seed), block, seed)
    pieces = placed.filter("size > 0").select(
        "uid", "id", "source", "at", "size", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block")
    )
    start = F.greatest(F.col("block") * block, F.col("at"))
    pieces = pieces.select(
        "uid", "id", F.col("source").alias("of"), F.col("block").alias("part"), (start - F.col("at")).alias("start"),
        (F.least((F.col("block") + 1) * block, F.col("at") + F.col("size")) - start).alias("taken"), (start - F.col("block") * block).alias("inside"),
    )
    # Spark takes the size of the slots for that of the few counts they come from, and would broadcast them.
    rows = slots.hint("merge").join(pieces, slots["source"].eqNullSafe(pieces["of"]) & (slots["block"] == pieces["part"])).drop("of", "part")
    rows = rows.withColumn("taken", F.least(F.col("taken"), F.col("uses") - F.col("inside"))).filter("taken > 0").drop("uses", "inside")
    own = targets.select(F.col("source").alias("of"), "source_size", "target")
    documents = placed.join(own, placed["source"].eqNullSafe(own["of"])).drop("of")
    return Mixture(documents, targets, rows)


def taken_by_document(mixture: Mixture) -> DataFrame:
    """mixture.documents with `taken`: tokens of each document in the mixture, repeats counted."""
    taken = mixture.rows.groupBy("uid").agg(F.sum("taken").alias("taken"))
    return mixture.documents.join(taken, "uid", "left").withColumn("taken", F.coalesce(F.col("taken"), F.lit(0)))


def mixed_text(mixture: Mixture, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """shard, source, slot, block and the text of every piece of the mixture, for documents with unique ids."""
    words = docs.select(F.col(f"`{id_col}`").alias("id"), F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(TOKEN), F.lit(0)).alias("words"))
    cut = F.slice("words", (F.col("start") + 1).cast("int"), F.col("taken").cast("int"))
    return mixture.rows.join(words, "id").select("shard", "source", "slot", "block", "id", "start", F.array_join(cut, " ").alias("text"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> DataFrame:
    """Whole documents instead of blocks: each as often as the mixture takes it, with its columns unchanged.

    A document of which the mixture takes x times its tokens is kept floor(x + u) times, u in [0, 1) by a
    hash of its id, so a source's expected share is its target.  Documents without tokens stay once.
    Ids should be unique; rows that share an id get the mean of what the mixture takes of them.
    """
    taken = taken_by_document(mix(docs, id_col, source_col, text_col, seed=seed))
    share = taken.groupBy("id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    u = F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(1 << 20)) / (1 << 20)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + u)).cast("int")
    own_id, n, copy = (unused(name, docs) for name in ("__id", "__copies", "__copy"))
    share = share.select(F.col("id").alias(own_id), copies.alias(n)).filter(F.col(n) > 0)
    kept = docs.join(share, F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)))
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[docs[f"`{c}`"] for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their source's size and target and the words the mixture takes of each."""
    taken = taken_by_document(mix(table(spark, sf_dir, "documents")))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
