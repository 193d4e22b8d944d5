"""The monitoring cycle as streams: readings and checks arrive as files, facts and states leave as tables.

Series use event time with a watermark; confirmation keeps each product's state between batches and runs the
same step as the batch fold, so both give the same rows for readings that arrive in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.operators.changes import CONFIRMED, READ, confirm_step, reading_of, shown
from shelfline.sources.files import work_dir

STATE = "state string, waiting string"


def arriving(spark: SparkSession, table: str, like: DataFrame, per_trigger: int | None = 1) -> DataFrame:
    """The Parquet table at the glob `table` (one file, or a folder of part files) as a stream with the schema of `like`.

    A glob, since Spark takes a plain path for that of a folder.  Files come `per_trigger` at a time in the order of
    their modification, or all that are there at once (None): a table's parts are in no order of event time, so that what
    depends on it would lose or misplace the readings of later files.
    """
    stream = spark.readStream.schema(like.schema)
    return (stream.option("maxFilesPerTrigger", per_trigger) if per_trigger else stream).parquet(table)


def checks_per_hour(checks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Totals, errors and mean response of each hour of event time."""
    timed = checks.withColumn("at_time", F.col("checked_at").cast("timestamp")).withWatermark("at_time", late)
    ok = F.when(F.col("status") == "ok", F.col("response_time_ms"))
    hourly = timed.groupBy(F.window("at_time", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "error").alias("errors"), F.avg(ok).alias("avg_ms")
    )
    return hourly.select(F.date_format("w.start", "yyyy-MM-dd'T'HH:00").alias("bucket"), "total", "errors", "avg_ms")


def confirmed(readings: DataFrame) -> DataFrame:
    """Double-read confirmation over a stream of readings: state and waiting reading are kept as JSON."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state, waiting = map(json.loads, held.get) if held.exists else (None, None)
        out = []
        for r in pd.concat(list(frames)).sort_values(["checked_at", "id"]).itertuples(index=False):
            state, waiting, found = confirm_step(state, waiting, reading_of(r))
            if found:
                out.append((key[0], r.id, found[0], shown(found[1]), shown(found[2])))
        held.update((json.dumps(state), json.dumps(waiting)))
        yield pd.DataFrame(out, columns=["product_uuid", "id", "outcome", "old_value", "new_value"])

    rows = readings.select("product_uuid", "id", "checked_at", *READ).filter("product_uuid is not null and availability is not null")
    return rows.groupBy("product_uuid").applyInPandasWithState(fold, CONFIRMED, STATE, "append", "NoTimeout")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything that has arrived, and return what the stream wrote.

    Appended rows go to a file sink, which commits each batch once; complete results replace the table.
    """
    spark = stream.sparkSession
    out = work_dir(spark, "stream-out")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", work_dir(spark, "stream-log")).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
