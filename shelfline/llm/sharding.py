"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters records uniformly over memory-sized buckets by a seeded hash of their key.  Pass two
brings each bucket together, puts it into a Fisher-Yates order (Spark's `shuffle` of an array draws one)
and writes it.  The buckets laid end to end are one random order of the whole input; shard k of n holds
the k-th nth of it, so shard row counts are at most one apart (the `rows` law).

No hot key can overfill a bucket as long as the key columns are nearly unique: sources and copies play no
part in the scatter.  Bucket offsets come from counts per bucket, summed in two levels, so that no window
ever holds more than `GROUP` buckets or one row for each `GROUP` buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.llm.common import renamed_apart, table, work_path

#: Bytes of strings and binaries in a bucket, about; and buckets at least, so that small inputs use every core.
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 64
#: Buckets at most, since a row for each (16 bytes) goes to every task; beyond it buckets grow.
MOST_BUCKETS = 2_000_000
#: Buckets whose offsets one window row set holds.
GROUP = 4096


def _size_of(df: DataFrame) -> F.Column:
    size = F.lit(0)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
    return size + F.lit(8 * len(df.columns))


def _bucket_starts(counts: DataFrame) -> DataFrame:
    """(bucket, start): rows in all buckets before each, from (bucket, n)."""
    grouped = counts.withColumn("g", F.expr(f"bucket div {GROUP}"))
    totals = grouped.groupBy("g").agg(F.sum("n").alias("in_group"))
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("g", F.coalesce(F.sum("in_group").over(before), F.lit(0)).alias("group_start"))
    inside = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        grouped.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(totals, "g")
        .select("bucket", (F.col("group_start") + F.col("inside")).alias("start"))
    )


def shuffle_into_shards(
    df: DataFrame,
    key: list[str],
    n_shards: int = 8,
    seed: int = 17,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All rows of `df` in a seeded random order, cut into `n_shards` shards.

    Adds `shard` (int, 0 to n_shards-1) and `slot` (long, gapless from 0 in each shard).  Input columns
    of these names, in any case, are replaced.  Null keys and null values are ordinary values; rows that
    repeat are all kept; an empty table gives no rows; with fewer rows than shards some shards are empty.
    Key columns should be nearly unique, since rows of one key share a bucket.
    Equal inputs, seeds and sizes give equal shards.
    """
    df = renamed_apart(df, ["shard", "slot"])
    n, n_bytes = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_size_of(df)), F.lit(0))).first()
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, math.ceil(n_bytes / bucket_bytes)))
    scatter = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in key]), F.lit(buckets)).cast("int").alias("bucket")
    starts = _bucket_starts(df.groupBy(scatter).agg(F.count(F.lit(1)).alias("n")))

    atomic = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    order = [F.col(f"rec.`{c}`") for c in [*key, *[c for c in atomic if c not in key]]]
    ordered = (
        df.select(scatter, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("rec"))
        .repartitionById(buckets, "bucket")
        .sortWithinPartitions("bucket", *order)
    )
    # The sort above fixes what the seeded draw sees, so that a task run again draws the same order.
    drawn = ordered.groupBy("bucket").agg(F.collect_list("rec").alias("recs"))
    placed = (
        drawn.select("bucket", F.shuffle("recs", seed).alias("recs"))
        .join(F.broadcast(starts), "bucket")  # MOST_BUCKETS rows at most; buckets stay where they are
        .select("start", F.posexplode("recs").alias("pos", "rec"))
        .withColumn("at", F.col("start") + F.col("pos"))
        .withColumn("shard", F.expr(f"cast(at * {n_shards} div {max(n, 1)} as int)"))
        .withColumn("slot", F.expr(f"at - (cast(shard as bigint) * {n} + {n_shards - 1}) div {n_shards}"))
    )
    return placed.select("rec.*", "shard", "slot")


def write_shards(shards: DataFrame, path: str) -> None:
    """Write what `shuffle_into_shards` returns as one Parquet folder for each shard; `slot` gives the order."""
    shards.write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read what `write_shards` wrote; `schema` is that of the written rows (an empty set has no folders)."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the `rows` law, as written to and read from shard folders.

    Equal texts are not kept together: that would break the law for large groups of copies.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = shuffle_into_shards(docs, ["doc_id"], n_shards=8)
    path = work_path(spark, "shards")
    write_shards(shards, path)
    text = F.coalesce(F.col("text"), F.lit(""))
    return read_shards(spark, path, shards.schema).select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
