"""Sinks of a stream that may see a batch twice: every batch is a folder under its number, written once.

A stream that is restarted repeats its last batch.  A sink writes batch n to a folder called n, and Spark's marker
of a finished write is the record that it did: a repeated batch that a sink has finished is passed over by it, one that
it hadn't is written anew.  So sinks of one batch may fail apart from each other, and what is read holds every batch once.

State is kept as partial aggregates that can be merged in any order and any number of times.  An upsert so is an
append, and the table is the merge of all batches; `compacted` replaces old batches by their merge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.sources.files import work_dir


class Journal:
    """The batches that sinks have written below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        folder, fs = self._fs(path)
        return fs.exists(folder)

    def folder(self, sink: str, batch: int, kind: str = "batch") -> str:
        return f"{self.root}/{sink}/{kind}-{batch:012d}"

    def finished(self, sink: str, batch: int, kind: str = "batch") -> bool:
        return self._exists(f"{self.folder(sink, batch, kind)}/_SUCCESS")

    def write(self, sink: str, df: DataFrame, batch: int, kind: str = "batch") -> None:
        """Write `df` as the sink's batch, unless that is done already; what a failed write left is replaced."""
        if not self.finished(sink, batch, kind):
            df.write.mode("overwrite").parquet(self.folder(sink, batch, kind))

    def batches(self, sink: str, kind: str = "batch") -> list[int]:
        """The numbers of finished batches, ascending."""
        folder, fs = self._fs(f"{self.root}/{sink}")
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(n for n in (int(x.rpartition("-")[2]) for x in names if x.startswith(f"{kind}-")) if self.finished(sink, n, kind))

    def read(self, sink: str, schema) -> DataFrame:
        """All finished batches: the newest merge of old ones, if there is any, and those after it."""
        bases = self.batches(sink, "base")
        paths = [self.folder(sink, bases[-1], "base")] if bases else []
        paths += [self.folder(sink, n) for n in self.batches(sink) if not bases or n > bases[-1]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def compacted(self, sink: str, schema, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Merge all finished batches into a base; the batches stay until the base is finished, and readers skip them after."""
        done = self.batches(sink)
        if done:
            self.write(sink, merge(self.read(sink, schema)), done[-1], "base")


def routed(journal: Journal, sinks: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each sink's rows of a batch, in the order of `sinks`; one that fails does not stop the others.

    Failures are raised together when all sinks had their turn, so that the stream repeats the batch; sinks that have
    finished it are then passed over.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch.persist()
        failed = []
        for name, rows in sinks.items():
            try:
                journal.write(name, rows(batch), number)
            except Exception as error:  # noqa: BLE001 - isolation is the point; all failures are raised below
                failed.append(f"{name}: {error}")
        batch.unpersist()
        if failed:
            raise RuntimeError("; ".join(failed))

    return handle


def run(stream: DataFrame, journal: Journal, sinks: dict[str, Callable[[DataFrame], DataFrame]], checkpoint: str | None = None) -> None:
    """Route everything that has arrived; with the same `checkpoint` a later run goes on after it."""
    checkpoint = checkpoint or work_dir(stream.sparkSession, "stream-log")
    writer = stream.writeStream.foreachBatch(routed(journal, sinks)).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


# --- offers as mergeable state -------------------------------------------------------------------------------

_AT = "struct<seen_at:timestamp_ntz,seq:bigint>"
OFFERS = f"canonical_url string, newest {_AT}, product_uuid string, site string, price string, price_at {_AT}, availability string, availability_at {_AT}, monitored_uuid string, monitored_at {_AT}, first_seen_at timestamp_ntz, last_checked_at timestamp_ntz"


def offer_parts(events: DataFrame) -> DataFrame:
    """Sightings of offers as partial states, one for each offer."""
    at = F.struct("seen_at", F.col("seq").cast("long").alias("seq"))
    when = lambda c: F.when(F.col(c).isNotNull(), at)
    rows = events.select(
        "canonical_url", at.alias("newest"), "product_uuid", "site", "price", when("price").alias("price_at"), "availability", when("availability").alias("availability_at"),
        "monitored_uuid", when("monitored_uuid").alias("monitored_at"), F.col("seen_at").alias("first_seen_at"), F.col("seen_at").alias("last_checked_at"),
    )
    return merged_offers(rows)


def merged_offers(parts: DataFrame) -> DataFrame:
    """Partial states merged by offer: the newest known of each field, the first monitored one, first and last sighting.

    The order of parts and how often one occurs make no difference.
    """
    return parts.groupBy("canonical_url").agg(
        F.max("newest").alias("newest"), F.max_by("product_uuid", "newest").alias("product_uuid"), F.max_by("site", "newest").alias("site"),
        F.max_by("price", "price_at").alias("price"), F.max("price_at").alias("price_at"), F.max_by("availability", "availability_at").alias("availability"),
        F.max("availability_at").alias("availability_at"), F.min_by("monitored_uuid", "monitored_at").alias("monitored_uuid"), F.min("monitored_at").alias("monitored_at"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_checked_at").alias("last_checked_at"),
    )


def offers(journal: Journal, sink: str = "offers") -> DataFrame:
    """The offers as all finished batches leave them."""
    state = merged_offers(journal.read(sink, OFFERS))
    return state.select("canonical_url", "product_uuid", "site", "price", "availability", "monitored_uuid", "first_seen_at", "last_checked_at")
