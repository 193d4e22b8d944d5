"""Double-read confirmation of readings that arrive out of order, as a stateful processor with event-time timers.

Products are dealt over buckets, and a bucket is a key of the state: calls of the state store, timers and frames cost
the same for one product as for many.  Readings wait in the bucket's list state, some hundred to an entry, until the
watermark has passed them; then those that can't be overtaken any more are folded in order, product by product, and one
timer is set for the earliest that still waits.  What is held is each product's confirmed reading and the one that waits
for its second, and the readings of the watermark's delay; input is taken frame by frame, so a hot product is never one frame.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from shelfline.operators.changes import CONFIRMED, READ, confirm_step, shown

COLUMNS = ["product_uuid", "id", "outcome", "old_value", "new_value"]
#: Where Spark keeps state that has lists and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys of the state at most; a bucket's waiting readings are in memory while they are folded.
BUCKETS = 8192
#: Readings in one entry of the list state.
ENTRY = 200


def _order(row: list) -> tuple:
    product, at, id_, _ = row
    return product, at, id_ is None, id_


def _entries(rows: list) -> list[tuple[str]]:
    return [(json.dumps(rows[i : i + ENTRY]),) for i in range(0, len(rows), ENTRY)]


def _folded(held: dict, rows: Iterable[list]) -> list[tuple]:
    """Outcomes of the readings `rows`, which are in order; `held` is brought up to them."""
    out = []
    for product, own in groupby(rows, key=lambda r: r[0]):
        state, waiting = held.get(product, (None, None))
        for _, _, id_, reading in own:
            state, waiting, found = confirm_step(state, waiting, json.loads(reading))
            if found:
                out.append((product, id_, found[0], shown(found[1]), shown(found[2])))
        held[product] = (state, waiting)
    return out


class Confirmation(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "states string")
        self.early = handle.getListState("early", "readings string")

    def _set_timer(self, at_ms: int) -> None:
        for old in list(self.handle.listTimers()):
            if old <= at_ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            ids = [None if pd.isna(x) else int(x) for x in frame["id"].tolist()]
            new = list(zip(frame["product_uuid"].tolist(), frame["at_us"].tolist(), ids, frame["reading"].tolist()))
            self.early.appendList(_entries(new))
            first = min([*([first] if first is not None else []), *(r[1] for r in new)])
        if first is not None:
            self._set_timer(first // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waits, due = [], []
        for (entry,) in self.early.get():
            for row in json.loads(entry):
                (due if row[1] // 1000 <= passed else waits).append(row)
        due.sort(key=_order)
        held = json.loads(self.held.get()[0]) if self.held.exists() else {}
        out = _folded(held, due)
        self.held.update((json.dumps(held),))
        if waits:
            self.early.put(_entries(waits))
            self.handle.registerTimer(min(r[1] for r in waits) // 1000)
        else:
            self.early.clear()
        yield pd.DataFrame(out, columns=COLUMNS).astype({"id": "Int64"})

    def close(self) -> None:
        pass


def confirmed(readings: DataFrame, late: str, buckets: int = BUCKETS) -> DataFrame:
    """Confirmation over a stream whose readings may be `late`: (product_uuid, id, outcome, old_value, new_value).

    A reading counts once the watermark has passed it, in the order of event time and id; later ones are dropped, and
    so are those without a time.  `buckets` stays as it is for the life of a checkpoint.
    Sets the session's state store to the one that keeps lists and timers.
    """
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = readings.withColumn("at", F.col("checked_at").cast("timestamp")).withWatermark("at", late)
    own = timed.filter("product_uuid is not null and availability is not null and at is not null")
    bucket, reading = F.pmod(F.xxhash64("product_uuid"), F.lit(buckets)), F.to_json(F.struct(*READ), {"ignoreNullFields": "false"})
    rows = own.select(bucket.alias("bucket"), "product_uuid", "id", "at", F.unix_micros("at").alias("at_us"), reading.alias("reading"))
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Confirmation(), outputStructType=CONFIRMED, outputMode="Append", timeMode="EventTime")
