"""A Merkle manifest of a data set: digests built bottom-up, proofs pushed top-down.

Every row is a leaf.  The leaves of a group, in the order of their ids, are the lowest level of its tree, two
nodes have one parent, and the groups' roots are the leaves of one more tree.  Where a leaf stands is found
without a global window: rows are range-partitioned and sorted, and each partition's counts by group give its
start in the group.

Building: a step takes a persisted level, brings the nodes below each node that is STEP levels higher together
(2**STEP digests at most), and hashes them up to it; what results is the next persisted level.  A group needs
a step for each STEP levels, so a tree of a billion leaves takes four.  Proofs: steps are taken again from the root
down.  The persisted nodes below a node join what it inherited - its proof, from its own sibling up to the root -
and each child puts its own siblings before it.  The last step reaches the leaves.

No task sees more than 2**STEP nodes of a group at a time, and a proof is sent once for each such block.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.llm.common import Scratch, table

#: Binary levels that one step builds or descends.
STEP = 8
#: Starts of partitions and groups that are sent to every task, at most (some 60 bytes each); more are joined by shuffle.
MOST_SENT = 500_000


def leaf_digest(values: list[F.Column]) -> F.Column:
    """Lowercase hex SHA-256 of the values one after another: `-` for null, else UTF-8 bytes, `:`, the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _group_key(group: F.Column) -> F.Column:
    """A string that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(leaves: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """`leaves` with `idx`, their place within `g` by `order` from 0, and `height`, the levels above the group's leaves."""
    # The last key parts rows that are equal in all others, so that no number of them has to fit into one task.
    dealt = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("g", *[F.asc_nulls_first(c) for c in order], "tie")
    rows = scratch.stored(dealt.sortWithinPartitions("g", *[F.asc_nulls_first(c) for c in order], "tie").drop("tie").withColumn("at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("at", 33).alias("part")  # the id's upper bits are its partition, the lower its place there
    counts = rows.groupBy("g", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("g").orderBy("part")
    starts = scratch.stored(
        counts.withColumn("start", F.sum("n").over(before) - F.col("n")).withColumn("size", F.sum("n").over(Window.partitionBy("g"))).drop("n"), "starts"
    )
    if starts.count() <= MOST_SENT:
        starts = F.broadcast(starts)
    height = F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0)
    return (
        rows.withColumn("part", part)
        .join(starts, ["g", "part"])
        .withColumn("idx", F.col("at") - F.col("first") + F.col("start"))
        .withColumn("height", height)
        .drop("part", "at", "first", "start", "size")
    )


_HASHED = """
aggregate(array_repeat(0, m), array(digests), (done, x) -> concat(done, array(
  transform(sequence(0, (size(element_at(done, -1)) - 1) div 2),
            i -> sha2(concat(get(element_at(done, -1), 2 * i), coalesce(get(element_at(done, -1), 2 * i + 1), '')), 256)))))
"""
#: A step of a proof: `<` and a sibling to the left, `>` and one to the right, or nothing where a node is alone.
_SIBLINGS = """
transform(array_repeat(0, m), (x, j) -> coalesce(
  concat(if(shiftright(i, j) % 2 = 1, '<', '>'), get(get(levels, j), shiftright(i, j) ^ 1)), ''))
"""


class Tree:
    """The persisted levels of one tree for each group; `roots` has (g, digest).

    `nodes` has g, idx, height, digest and whatever its rows carry; every group's idx run from 0.
    """

    def __init__(self, nodes: DataFrame, scratch: Scratch):
        self.scratch, self.steps, self.tops = scratch, [], []
        own = [c for c in nodes.columns if c not in ("g", "idx", "height")]
        nodes = nodes.select("g", "idx", F.col("height").alias("left"), F.struct(*own).alias("node"))
        tallest = nodes.agg(F.max("left")).first()[0]
        for _ in range(max(1, ceil((tallest or 0) / STEP))):
            m = F.least(F.col("left"), F.lit(STEP))
            blocks = (
                nodes.withColumn("m", m)
                .withColumn("block", F.expr("shiftright(idx, m)"))
                .groupBy("g", "block", "m", (F.col("left") - F.col("m")).alias("left"))
                .agg(F.sort_array(F.collect_list(F.struct("idx", "node"))).alias("nodes"))
                .withColumn("digests", F.col("nodes.node.digest"))
            )
            level = scratch.stored(blocks.withColumn("levels", F.expr(_HASHED)).drop("digests"), "level")
            self.steps.append(level)
            above = level.select("g", F.col("block").alias("idx"), "left", F.struct(F.expr("element_at(levels, -1)[0]").alias("digest")).alias("node"))
            self.tops.append(above.filter("left = 0").select("g", F.col("node.digest").alias("digest")))
            nodes = above.filter("left > 0")

    @property
    def roots(self) -> DataFrame:
        found = self.tops[0]
        for top in self.tops[1:]:
            found = found.unionByName(top)
        return found

    def pushed(self, inherited: DataFrame) -> DataFrame:
        """(g, node, siblings, ...) of every leaf, from `inherited`: g, siblings and what else a group's leaves inherit.

        A group's root inherits `siblings`; each leaf has its own siblings, from the lowest level up, before them.
        """
        extra = [c for c in inherited.columns if c not in ("g", "siblings")]
        from_above = None
        for level in reversed(self.steps):
            ends = level.filter("left = 0").join(inherited, "g")
            if from_above is not None:
                ends = ends.unionByName(level.filter("left > 0").join(from_above.withColumnRenamed("idx", "block"), ["g", "block"]))
            each = ends.select("g", "m", "levels", "siblings", *extra, F.posexplode("nodes").alias("i", "child"))
            own = F.concat(F.expr(_SIBLINGS), F.col("siblings")).alias("siblings")
            made = each.select("g", F.col("child.idx").alias("idx"), F.col("child.node").alias("node"), own, *extra)
            if level is not self.steps[0]:
                from_above = self.scratch.stored(made.drop("node"), "proofs")
        return made.drop("idx")


def proof_digest(siblings: str = "siblings") -> F.Column:
    """H of a proof's digests, lowest level first."""
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.substring(s, 2, 64)), ""), 256)


def folded(digest: str, siblings: str = "siblings") -> F.Column:
    """The root that a leaf's digest and its siblings give."""
    return F.expr(
        f"aggregate({siblings}, {digest}, (own, s) -> sha2(if(s like '<%', concat(substr(s, 2), own), concat(own, substr(s, 2))), 256))"
    )


def proved(rows: DataFrame, group: str, order: list[str], leaf: F.Column, carried: dict[str, F.Column]) -> DataFrame:
    """(the carried columns, leaf, subroot, root, siblings) of every row of `rows`.

    Groups are ordered bytewise, null first; rows within one by `order`, null first, then by leaf, so that rows
    that tie differ in nothing else that counts.  Repeated rows are leaves of their own; a lone leaf is its group's
    root, and a lone group's root is the root; an empty table gives no rows.  Texts of any length become digests
    before anything is shuffled.  Columns that are not named play no part.
    """
    scratch = Scratch(rows.sparkSession)
    payload = F.struct(*[c.alias(name) for name, c in carried.items()]).alias("payload")
    keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)]
    leaves = rows.select(_group_key(F.col(f"`{group}`")).alias("g"), *keys, leaf.alias("digest"), payload)
    names = [f"k{i}" for i in range(len(order))]
    below = Tree(numbered(leaves, [*names, "digest"], scratch).drop(*names), scratch)

    groups = below.roots.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest")
    above = Tree(numbered(groups, ["of"], scratch), scratch)
    top = above.roots.select("g", F.expr("cast(array() as array<string>)").alias("siblings"), F.col("digest").alias("root"))
    per_group = above.pushed(top).select(F.col("node.of").alias("g"), F.col("node.digest").alias("subroot"), "root", "siblings")
    found = below.pushed(scratch.stored(per_group, "subroots"))
    return found.select("node.payload.*", F.col("node.digest").alias("leaf"), "subroot", "root", "siblings")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest, proof and root, and whether a copy that was tampered with in part still gives it."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    altered = leaf_digest([F.when(changed, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in FIELDS])
    leaf = leaf_digest([F.col(c) for c in FIELDS])
    found = proved(docs, "lang", ["doc_id"], leaf, {"doc_id": F.col("doc_id"), "seen": altered})
    return found.withColumn("folded_root", folded("seen")).select(
        "doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


#: The table of CRC-32 for half bytes: entry k is k, shifted four times by the reversed polynomial EDB88320.
_NIBBLES = []
for _k in range(16):
    for _ in range(4):
        _k = (_k >> 1) ^ (0xEDB88320 if _k & 1 else 0)
    _NIBBLES.append(_k)


def crc32_sql(ascii_text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a column's bytes, which all have to be ASCII."""
    nibbles = "[" + ", ".join(f"{k}::BIGINT" for k in _NIBBLES) + "]"
    half = f"xor({{c}} >> 4, {nibbles}[({{c}} & 15) + 1])"
    step = half.format(c="xor(c, b)")
    step = f"xor(({step}) >> 4, {nibbles}[(({step}) & 15) + 1])"
    codes = f"list_transform(string_split({ascii_text}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _leaf_sql(n_chars: str) -> str:
    one = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(one.format(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


OP12_SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql("n_chars")} AS leaf,
         {_leaf_sql(f"n_chars + (CASE WHEN ({crc32_sql('CAST(doc_id AS VARCHAR)')}) % 7 = 0 THEN 1 ELSE 0 END)")} AS seen
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM base),
low AS (
  SELECT g, 0 AS lvl, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT g, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY g, lvl, idx // 2, n),
subroots AS (
  SELECT g, lvl AS height, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, idx, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY lvl, idx // 2, n),
top AS (SELECT lvl AS height, h AS root FROM high WHERE n = 1),
path AS (
  SELECT l.g, l.idx, s.lvl AS rise, (l.idx >> s.lvl) % 2 AS odd, s.h
  FROM leaves l JOIN (SELECT DISTINCT g, lvl FROM low WHERE n > 1) d ON d.g = l.g
  LEFT JOIN low s ON s.g = l.g AND s.lvl = d.lvl AND s.idx = xor(l.idx >> d.lvl, 1)
  WHERE s.h IS NOT NULL
  UNION ALL
  SELECT l.g, l.idx, r.height + s.lvl, (r.idx >> s.lvl) % 2, s.h
  FROM leaves l JOIN subroots r ON r.g = l.g JOIN high s ON s.n > 1 AND s.idx = xor(r.idx >> s.lvl, 1)),
proofs AS (SELECT g, idx, sha256(string_agg(h, '' ORDER BY rise)) AS proof FROM path GROUP BY g, idx),
folds AS (
  SELECT l.g, l.idx, 0 AS rise, r.height + t.height AS height, l.seen AS h FROM leaves l JOIN subroots r ON r.g = l.g, top t
  UNION ALL
  SELECT f.g, f.idx, f.rise + 1, f.height,
         sha256(CASE WHEN p.h IS NULL THEN f.h WHEN p.odd = 1 THEN p.h || f.h ELSE f.h || p.h END)
  FROM folds f LEFT JOIN path p ON p.g = f.g AND p.idx = f.idx AND p.rise = f.rise WHERE f.rise < f.height)
SELECT l.doc_id, l.leaf, r.subroot, t.root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = t.root AS verified
FROM leaves l JOIN subroots r ON r.g = l.g CROSS JOIN top t JOIN folds f ON f.g = l.g AND f.idx = l.idx AND f.rise = f.height
LEFT JOIN proofs p ON p.g = l.g AND p.idx = l.idx
"""
