"""Near-duplicate detection: bottom-k sketches, inverted lists, a union-sketch estimate, exact Jaccard.

A document's set is its distinct shingles of `words` words, kept as 64-bit hashes.  The same hashes order the
shingles, so the k smallest of a set (its bottom-k sketch) are a sample that two similar sets share.

1. Documents with equal sets are one class, represented by the smallest id; only representatives go on.
2. Short sketches find suspects: a pair above the threshold shares at least `must_share` of its k values (but
   for a chance under 1e-9; always, where a sketch holds the whole set), so a document of which fewer values
   occur elsewhere has no partner.
3. Suspects' long sketches give inverted lists.  Of the values that occur elsewhere only the rarest are listed:
   so many that a pair sharing `must_share` values meets in one of them.
4. Each list's most central document (most of its values occur elsewhere) is compared with the whole list.
   That links most of a group of copies in one step for each copy, whatever the group's size.
5. Pairs of a list not yet connected are compared as well.  Of its whole set a document can share only what
   occurs in documents of other components, and that count bounds the sizes its partners may have.  Copies of
   one text with edits of their own, too far from each other, so have no partners among themselves, whatever
   the group's size.  In the list where it first meets, a pair has in common what comes from that value on at
   most; a side that so can't reach the threshold with any size that occurs in the list is left out.  Pairs
   that meet within the HEAD rarest values of both are taken once.  A signature of BITS bits travels with every
   entry: one bit of the smallest value in each part of the hashes' range.  Bits that differ estimate similarity
   where two entries meet, so that texts put together from common blocks, which share every list and no more
   than a part, become no pair.  Where the bits leave it open, DEEP bits of the values of PARTS parts decide: most
   of what differs shows, so that copies of one text just below the threshold become no pair either, unless
   they are long.  Before the exact comparison the union of both sketches estimates it again.
6. Links, all confirmed on full sets, are joined to components.

Nodes are classes of equal sets under numbers of their own; ids come back when components are known, so rows that
share an id keep all the links of their different texts.

Nothing is capped: a list may have any length, and every pair that could be linked is linked or connected.

Shingles stand as 64-bit hashes throughout, and equal sets are recognised by their size and two 64-bit sums.
Two of s different shingles share a hash with a chance of about s**2 / 2**65; even then an intersection is off
by one.  Two different sets share both sums with a chance of 2**-128 for each pair.
"""

from __future__ import annotations

from functools import cache
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import Scratch, checkpointed, stored, table
from shelfline.llm.hashing import span_hashes, texts_of

#: Values in the sketch that finds suspects, and in the sketch that finds pairs.
SHORT, LONG = 32, 512
#: Listed values that travel with each entry of a list, so that most pairs are taken in one of their lists only.
HEAD = 16
#: Bits of the signature that travels with each entry, and the words of 64 bits that hold them.
BITS = 1024
WORDS = BITS // 64
#: Parts, and bits of each one's smallest value (4, packed two a byte), for pairs whose single bits leave it open.
PARTS, DEEP = 2048, 4
#: Ids that are sent to every task to thin a table out before it is joined, at most (8 bytes each).
MOST_SENT = 2_000_000
#: The chance of overlooking a pair exactly at the threshold, for each of both sketches.
MISS = 1e-9
GROUP_BYTES = 1 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def must_share(k: int, similarity: float) -> int:
    """The most values c such that two sets of that similarity share fewer than c of k with a chance under MISS."""
    chance, c = 0.0, 0
    while c < k:
        chance += comb(k, c) * similarity**c * (1 - similarity) ** (k - c)
        if chance >= MISS:
            break
        c += 1
    return max(1, c)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a text of fewer words is one shingle, of none an empty set."""
    space = IS_SPACE[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = ~space[starts]
    starts, ends = starts[keep], ends[keep]
    h = span_hashes(LOWER[data], starts, ends)
    of_text = np.searchsorted(starts, offsets)
    full = np.zeros(max(0, len(h) - words + 1), dtype=np.uint64)
    for i in range(words):
        full = full * np.uint64(0xC2B2AE3D27D4EB4F) + h[i : i + len(full)]
    full = _mixed(full)
    out = []
    for a, b in zip(of_text[:-1].tolist(), of_text[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for x in h[a:b]:
                short = np.uint64((int(short) * 0x9FB21C651E98DF25 + int(x)) & 0xFFFFFFFFFFFFFFFF)
            out.append(_mixed(np.array([short])))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sets(batch_ids: pa.Array, texts: pa.Array, words: int):
    data, offsets = texts_of(texts)
    ids, i = batch_ids.to_pylist(), 0
    while i < len(ids):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP_BYTES, side="right")) - 1)
        for doc, found in zip(ids[i:j], shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)):
            yield doc, found
        i = j


def _batches(rows, kinds: pa.Schema, size: int = 2000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)


def _set_key(found: np.ndarray) -> str:
    again = _mixed(found + np.uint64(0x632BE59BD9B4E019))
    return f"{len(found)}:{int(found.sum(dtype=np.uint64)):x}:{int(again.sum(dtype=np.uint64)):x}"


def sketches(docs: DataFrame, words: int, k: int) -> DataFrame:
    """(uid, n, set_key, sketch): size, a 128-bit fingerprint of the set, and its k smallest hashes, ascending."""
    kinds = pa.schema([("uid", pa.int64()), ("n", pa.int64()), ("set_key", pa.string()), ("sketch", pa.list_(pa.int64()))])

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                for uid, found in _sets(batch.column(0), batch.column(1), words):
                    yield uid, len(found), _set_key(found), found[:k].view(np.int64)

    return docs.select("uid", "text").mapInArrow(lambda b: _batches(rows(b), kinds), "uid long, n long, set_key string, sketch array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(uid, set_key, n, hashes): the whole set of each document, ascending, as little-endian 64-bit integers."""
    kinds = pa.schema([("uid", pa.int64()), ("set_key", pa.string()), ("n", pa.int64()), ("hashes", pa.binary())])

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                for uid, found in _sets(batch.column(0), batch.column(1), words):
                    yield uid, _set_key(found), len(found), found.astype("<u8").tobytes()

    return docs.select("uid", "text").mapInArrow(lambda b: _batches(rows(b), kinds, 200), "uid long, set_key string, n long, hashes binary")


def postings_of(sets: DataFrame, k: int | None = None) -> DataFrame:
    """A row for each of the k smallest hashes (all without k) of each set: the columns before hashes, and value."""
    kept = [f for f in sets.schema.fields if f.name != "hashes"]
    names = [*[f.name for f in kept], "value"]

    def cut(batches):
        for batch in batches:
            values = [np.frombuffer(raw, dtype="<i8")[:k] for raw in batch.column(len(kept)).to_pylist()]
            if values:
                each = [len(v) for v in values]
                columns = [np.repeat(batch.column(i).to_numpy(), each) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, np.concatenate(values))], names=names)

    out = ", ".join(f"{name} long" for name in names)
    return sets.filter("n > 0").select(*[f.name for f in kept], "hashes").mapInArrow(cut, out)


def shared_values(postings: DataFrame) -> DataFrame:
    """`postings` (value, ...) whose value occurs in two or more rows, with df: how many."""
    counts = postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    return postings.join(counts, "value")


def _needed(k: int, similarity: float) -> F.Column:
    """Values of its sketch that a document shares with any partner's sketch, at least.

    If the union has k values or fewer, both sketches are whole sets; else k values of the union are a sample.
    """
    return F.least(F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-9)), F.lit(must_share(k, similarity))).cast("int")


def suspects(reps: DataFrame, k: int, similarity: float) -> DataFrame:
    """(uid) of representatives that share enough values of their short sketches with others."""
    postings = reps.select("uid", "n", F.explode("sketch").alias("value"))
    shared = shared_values(postings).groupBy("uid", "n").agg(F.count(F.lit(1)).alias("shared"))
    return shared.filter(F.col("shared") >= _needed(k, similarity)).select("uid")


def lists(sets: DataFrame, k: int, similarity: float) -> DataFrame:
    """(uid, n, shared, central, rare): for each document that may have partners, its values to be listed.

    shared: how many values of its long sketch occur elsewhere; central: their share of the sketch; rare: the
    rarest of them, rarest first.
    """
    whole = F.least("n", F.lit(k))
    return (
        shared_values(postings_of(sets.select("uid", "n", "hashes"), k))
        .groupBy("uid", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))
        .withColumn("needed", _needed(k, similarity))
        .filter(F.size("values") >= F.col("needed"))
        .select(
            "uid",
            "n",
            F.size("values").alias("shared"),
            (F.size("values") / whole).alias("central"),
            F.transform(F.slice("values", F.lit(1), F.size("values") - F.col("needed") + 1), lambda x: x["value"]).alias("rare"),
        )
    )


def entries(listed: DataFrame) -> DataFrame:
    """(value, uid, n, central, remaining): inverted lists; remaining: a document's shared values from this one on."""
    each = listed.select("uid", "n", "shared", "central", F.posexplode("rare").alias("at", "value"))
    return each.select("value", "uid", "n", "central", (F.col("shared") - F.col("at")).cast("long").alias("remaining"))


def signatures(sets: DataFrame) -> DataFrame:
    """(uid, s0, s1, ..., deep): a bit of the smallest hash in each of BITS parts of the hashes' range, and DEEP bits in each of PARTS, 0 for an empty part."""
    names, width = [f"s{i}" for i in range(WORDS)], PARTS * DEEP // 64

    def signed(batches):
        for batch in batches:
            rows = np.zeros((batch.num_rows, WORDS), dtype=np.int64)
            deep = np.zeros((batch.num_rows, width), dtype=np.int64)
            for i, raw in enumerate(batch.column(1)):
                values = np.frombuffer(raw.as_buffer(), dtype="<u8")
                part, first = np.unique(values >> np.uint64(64 - (BITS - 1).bit_length()), return_index=True)
                bits = np.zeros(BITS, dtype=np.uint8)
                bits[part.astype(np.int64)] = (_mixed(values[first] + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(63)).astype(np.uint8)
                rows[i] = np.packbits(bits).view("<i8")
                part, first = np.unique(values >> np.uint64(64 - (PARTS - 1).bit_length()), return_index=True)
                fours = np.zeros(PARTS, dtype=np.uint8)
                fours[part.astype(np.int64)] = (_mixed(values[first] + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - DEEP)).astype(np.uint8)
                deep[i] = (fours[0::2] << 4 | fours[1::2]).view("<i8")
            more = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), pa.array(deep.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in rows.T], more], names=["uid", *names, "deep"])

    return sets.select("uid", "hashes").mapInArrow(signed, "uid long, " + ", ".join(f"{n} long" for n in names) + ", deep array<long>")


@cache
def most_differing(similarity: float, deep: int = 1, parts: int = BITS) -> list[int]:
    """By the size of the union, up to `parts`: in how many parts two sets that reach the similarity differ at most.

    A part that both fill alike has equal bits, and of the others one in 2**deep.  What the sets don't share is at most
    (1 - similarity) of the union, and no more parts can differ; more than that many do with a chance under MISS.
    """
    p, out = (1 - similarity) * (1 - 0.5**deep), []
    for union in range(parts + 1):
        most, chance, term = int((1 - similarity) * union + 1e-9), 1.0, (1 - p) ** union
        for k in range(most + 1):
            chance -= term
            if chance < MISS:
                most = k
                break
            term *= (union - k) / (k + 1) * p / (1 - p)
        out.append(most)
    return out


def _alike(x: str, y: str, similarity: float) -> F.Column:
    """Whether so few bits of two signatures differ that the sets may reach the similarity."""
    differ = F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0")))
    for i in range(1, WORDS):
        differ = differ + F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}")))
    return differ <= _limit(x, y, similarity, 1, BITS)


def _limit(x: str, y: str, similarity: float, deep: int, parts: int) -> F.Column:
    union = F.floor((F.col(f"{x}.n") + F.col(f"{y}.n")) / F.lit(1 + similarity) + F.lit(1e-9))
    # Unions of more values fill all parts at most, and the limit doesn't fall with the size.
    return F.get(F.lit(most_differing(similarity, deep, parts)), F.least(union, F.lit(parts)).cast("int"))


def _deeply_alike(x: str, y: str, similarity: float) -> F.Column:
    """`_alike` by DEEP bits of each part: a group of four bits counts once, whichever of them differ."""

    def parts(a: F.Column, b: F.Column) -> F.Column:
        z = a.bitwiseXOR(b)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    differ = F.aggregate(F.zip_with(f"{x}.deep", f"{y}.deep", parts), F.lit(0), lambda total, n: total + n)
    return differ <= _limit(x, y, similarity, DEEP, PARTS)


def only(df: DataFrame, uids: DataFrame) -> DataFrame:
    """Rows of `df` whose uid is in `uids` (distinct): few enough ids are sent to the tasks, so `df` stays where it is."""
    if uids.limit(MOST_SENT + 1).count() <= MOST_SENT:
        uids = F.broadcast(uids)
    return df.join(uids, "uid", "left_semi")


def linked(pairs: DataFrame, sets: DataFrame, k: int, similarity: float) -> DataFrame:
    """`pairs` (a, b) whose full sets reach the similarity; those far below it by their union sketch go first."""
    least = must_share(k, similarity)
    sets = only(sets, checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()))
    left = sets.select(F.col("uid").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("uid").alias("b"), F.col("hashes").alias("y"))
    hundredths = round(similarity * 100)

    def compare(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                ok = 100 * min(len(x), len(y)) >= hundredths * max(len(x), len(y))
                if ok and min(len(x), len(y)) > k:
                    union = np.unique(np.concatenate([x[:k], y[:k]]))[:k]
                    ok = len(np.intersect1d(np.intersect1d(union, x[:k], True), y[:k], True)) >= least
                if ok:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok = 100 * common >= hundredths * (len(x) + len(y) - common)
                keep.append(ok)
            n = [i for i, ok in enumerate(keep) if ok]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in n], pa.int64()), pa.array([b[i] for i in n], pa.int64())], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(uid, component): the smallest uid that each linked uid reaches.

    Every round each node takes the smallest label among its neighbours' and then its label's label, which
    halves chains; rounds end when nothing changes.  Labels are checkpointed in the shared folder each round.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("uid")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        seen = both.join(labels, F.col("b") == F.col("uid")).groupBy(F.col("a").alias("uid")).agg(F.min("component").alias("near"))
        # Written, so that the join below has sides of its own, whose hot keys (hubs) Spark may split.
        stepped = checkpointed(labels.join(seen, "uid").select("uid", "component", F.least("component", "near").alias("next")))
        jump = stepped.select(F.col("uid").alias("next"), F.col("next").alias("far"))
        moved = checkpointed(
            stepped.join(jump, "next", "left").select("uid", "component", F.least("next", "far").alias("next"))
        )
        changed = moved.filter("next <> component").limit(1).count()
        labels = moved.select("uid", F.col("next").alias("component"))
        if not changed:
            return labels


def partner_sizes(sets: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """(uid, most): the largest set that each of `members` (uid, component) can be linked to in another component.

    A link of sets of n and m has similarity / (1 + similarity) * (n + m) shingles in common at least, and a
    member has no more in common with other components than the values of its whole set that occur there.
    Members that reach no size at all are left out.
    """
    own = only(sets, members.select("uid")).join(members, "uid").select("uid", "n", "component", "hashes")
    postings = postings_of(own)
    there = postings.groupBy("value").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1")
    common = postings.join(there, "value", "left_semi").groupBy("uid", "n").agg(F.count(F.lit(1)).alias("common"))
    most = F.floor(F.lit((1 + similarity) / similarity + 1e-9) * F.col("common")) - F.col("n")
    return common.select("uid", "n", most.alias("most")).filter(F.col("most") >= F.lit(similarity - 1e-9) * F.col("n")).select("uid", "most")


def _reach(common: F.Column, n: F.Column, m: F.Column, similarity: float) -> F.Column:
    """Whether sets of n and m with so many in common reach the similarity."""
    return common >= F.lit(similarity - 1e-9) * (n + m - common)


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of `docs`.

    Rows whose sets reach the similarity are linked, equal sets included; component_id is the smallest id that
    links reach, and kept is true for its row.  Texts without words, null ones among them, have empty sets and
    link with nothing.  Ids are integers; rows that share one are documents of their own, with all the links of
    each.  Null ids are never linked (component_id null, kept).  An empty table gives no rows; other
    columns play no part.  `similarity` counts in whole hundredths.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("uid"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    scratch = Scratch(docs.sparkSession)
    drawn = stored(sketches(own, words, SHORT), "sketches", compression="zstd")
    real = drawn.filter("n > 0 and uid is not null")
    # Classes of equal sets: a number, the smallest id, and the size and sketch, which all rows of one share.
    classes = real.groupBy("set_key").agg(F.min("uid").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.stored(classes.withColumn("number", F.monotonically_increasing_id()), "classes", compression="zstd")
    suspected = checkpointed(suspects(classes.select(F.col("number").alias("uid"), "n", "sketch"), SHORT, similarity))
    wanted = only(classes.select(F.col("number").alias("uid"), "rep", "set_key"), suspected).withColumnRenamed("uid", "number")
    wanted = scratch.stored(wanted, "wanted", compression="zstd")
    texts = only(own, wanted.select(F.col("rep").alias("uid")).distinct())
    few = wanted.count() <= MOST_SENT
    numbers = wanted.select("number", F.col("rep").alias("uid"), "set_key")
    sets = full_sets(texts, words).join(F.broadcast(numbers) if few else numbers, ["uid", "set_key"]).select(F.col("number").alias("uid"), "n", "hashes")
    if not drawn.groupBy("uid", "set_key").count().filter("uid is not null and count > 1").isEmpty():
        sets = sets.dropDuplicates(["uid"])  # repeated rows
    sets = scratch.stored(sets, "sets", compression="zstd")
    listed = scratch.stored(lists(sets, LONG, similarity), "lists", compression="zstd")

    rank = F.struct(-F.col("central"), "uid")
    by_value = entries(listed).groupBy("value").agg(
        F.min(rank).alias("hub"), F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.count(F.lit(1)).alias("length")
    )
    by_value = by_value.filter("length > 1").select("value", F.col("hub.uid").alias("hub"), "least_n", "most_n")
    by_value = scratch.stored(by_value, "hubs", compression="zstd")
    spread = entries(listed).join(by_value, "value")
    to_hubs = spread.filter("uid <> hub").select(F.least("uid", "hub").alias("a"), F.greatest("uid", "hub").alias("b")).distinct()
    first = checkpointed(linked(checkpointed(to_hubs), sets, LONG, similarity))
    labels = components(first)

    # The most a document can have in common with another that it first meets here, and with which size best.
    size = F.greatest(F.least("remaining", "most_n"), F.col("least_n"))
    sampled = F.col("n") > int(LONG * similarity)
    reachable = sampled | _reach(F.least("remaining", size), F.col("n"), size, similarity)
    rest = spread.filter(reachable).join(labels, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    # A list whose members are all connected already has nothing left to find.
    several = rest.groupBy("value").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("value")
    rest = rest.join(several, "value", "left_semi").select("value", "uid", "n", "remaining", "component", "hub")
    rest = scratch.stored(rest, "rest", compression="zstd")
    sizes = checkpointed(partner_sizes(sets, rest.select("uid", "component").distinct(), similarity))
    rest = rest.join(sizes, "uid").join(listed.select("uid", F.slice("rare", 1, HEAD).alias("head")), "uid")
    signed = scratch.stored(signatures(only(sets, sizes.select("uid"))), "signatures", compression="zstd")
    rest = rest.join(signed, "uid")
    common = F.array_intersect("x.head", "y.head")
    x, y = rest.alias("x"), rest.alias("y")
    met = (
        (F.col("x.value") == F.col("y.value"))
        & (F.col("x.uid") < F.col("y.uid"))
        & (F.col("x.component") != F.col("y.component"))
        & (F.col("x.uid") != F.col("x.hub"))
        & (F.col("y.uid") != F.col("y.hub"))
        & (F.col("x.n") <= F.col("y.most"))
        & (F.col("y.n") <= F.col("x.most"))
        & (F.least("x.n", "y.n") >= F.lit(similarity - 1e-9) * F.greatest("x.n", "y.n"))
        & (
            (F.greatest("x.n", "y.n") > int(LONG * similarity))
            | _reach(F.least("x.remaining", "y.remaining"), F.col("x.n"), F.col("y.n"), similarity)
        )
        & _alike("x", "y", similarity)
        & F.coalesce(F.get(common, F.lit(0)) == F.col("x.value"), F.lit(True))
        & _deeply_alike("x", "y", similarity)
    )
    others = x.join(y, met).select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")).distinct()
    second = linked(checkpointed(others), sets, LONG, similarity)
    final = components(first.union(second)).join(classes.select(F.col("number").alias("uid"), "rep"), "uid")
    least = final.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = scratch.stored(final.join(least, "component").select("uid", "component_id"), "found")

    by_class = classes.join(found, F.col("number") == F.col("uid"), "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"))
    by_class = stored(by_class, "components", compression="zstd")
    scratch.clear()
    out = drawn.join(by_class, "set_key", "left")
    component = F.when(F.col("uid").isNull() | (F.col("n") == 0), F.col("uid")).otherwise(F.coalesce("component_id", "uid"))
    return out.select(
        F.col("uid").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("uid"), F.lit(True)).alias("kept")
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' components under 3-word shingles and a similarity of 0.85."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, words=3, similarity=0.85)
