"""Structured Streaming jobs: assessment, rates, caches, cooldowns, feedback, export.

Every job takes the checkpoint folder as a parameter; on a cluster it lies on
shared storage (``session.checkpoint_root``), so a restarted query goes on from
its last committed batch whichever executors are lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from msgrisk.operators import analytics, panels
from msgrisk.operators.ledger import NEVER, next_accepted, payload_code
from msgrisk.plans.assess import Model, assess, checked
from msgrisk.registry import Registry
from msgrisk.schemas import split_valid, validate_feedback
from msgrisk.session import store, stored_tables
from msgrisk.sources.batches import BatchTable
from msgrisk.sources.tables import event_rows, store_feedback, unstored_feedback, write_event_batch, write_siem


def _start(writer, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def assess_stream(
    messages: DataFrame, events_path: str, checkpoint: str, registry: Registry | None = None,
    model: Model | None = None, key: str = "", trigger: dict | None = None, quarantine: str | None = None,
    valid_only: bool = True,
) -> StreamingQuery:
    """Assess arriving messages and append event rows, by day; messages that break a rule go to ``quarantine``,
    without ``valid_only`` they are assessed as well.

    Each micro-batch runs the batch plan (its distinct-host step aggregates and
    joins back, which one streaming plan cannot).  Events are a table of batches
    (``sources.batches``): a retry adds no rows twice, and files follow the size of a day.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with stored_tables(batch.sparkSession):
            rows = store(batch) if quarantine else batch        # read twice then: the source is asked once
            write_event_batch(event_rows(assess(rows, registry, model, key, valid_only)), events_path, batch_id)
            if quarantine:
                checked(rows)[1].write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")

    return _start(messages.writeStream.foreachBatch(write), checkpoint, trigger)


def rate_stream(
    requests: DataFrame, path: str, checkpoint: str, limit: int = 120, lateness: str = "2 minutes",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Per-client minute counts, written whenever they change; ``read_rates`` gives the newest of each.

    Requests later than the watermark are dropped with the state of their minute; ``late_stream`` keeps them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _rates(batch.sparkSession, path).append(batch, batch_id)

    counted = analytics.rate_counts(requests.withWatermark("ts", lateness), limit)
    return _start(counted.writeStream.outputMode("update").foreachBatch(write), checkpoint, trigger)


def _newest_rates(rows: DataFrame) -> DataFrame:
    """The state of every minute: counts only grow, so the largest is the newest."""
    return rows.groupBy("window_start", "client").agg(F.max("n_requests").alias("n_requests"), F.max("over_limit").alias("over_limit"))


def _rates(spark: SparkSession, path: str) -> BatchTable:
    return BatchTable(spark, path, reduce=_newest_rates)


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Columns window_start, client, n_requests, over_limit: the newest count of every minute."""
    return _rates(spark, path).read()


def late_stream(
    requests: DataFrame, path: str, checkpoint: str, lateness: str = "2 minutes", seconds: int = 60, trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the requests that ``rate_stream`` drops: those whose minute had ended ``lateness`` before the newest
    time of the earlier batches.  The watermark is noted with the batches it comes from, so a restarted query and a
    repeated batch decide alike.  ``read_late`` gives the rows, with the watermark they missed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = BatchTable(spark, path)
        mark = table.listed()["notes"].get("watermark_us")
        late = batch.withColumn("watermark", F.timestamp_micros(F.lit(mark).cast("long")))
        end = F.window("ts", f"{seconds} seconds")["end"]
        newest = batch.agg(F.unix_micros(F.max("ts") - F.expr(f"INTERVAL {lateness}"))).first()[0]
        marks = [m for m in (mark, newest) if m is not None]
        table.append(late.where(end <= F.col("watermark")), batch_id, {"watermark_us": max(marks)} if marks else {})

    return _start(requests.writeStream.foreachBatch(write), checkpoint, trigger)


def read_late(spark: SparkSession, path: str) -> DataFrame:
    return BatchTable(spark, path).read()


class WindowProcessor(StatefulProcessor):
    """Per key: the last accepted instant and its payload hash; marks each row accepted or skipped.

    ``wait_ms`` is the least distance to the last accepted row; a row with its payload hash is skipped as well.
    State is dropped ``keep_ms`` after it was last changed, when it can no longer matter; a payload hash is
    remembered as long.  Rows of a micro-batch are taken in time order, then by row id.
    """

    OUTPUT = "key string, row_id long, ts timestamp, accepted boolean"

    def __init__(self, wait_ms: int, keep_ms: int):
        self.wait_ms, self.keep_ms = wait_ms, max(keep_ms, wait_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_accepted", "ms long, code long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before, code = map(int, self.last.get()) if self.last.exists() else (NEVER, NEVER)
        # the source's rows per micro-batch bound what arrives per key; one step for each accepted row
        batch = pd.concat(list(rows)).sort_values(["ts", "row_id"])
        millis = batch["ts"].astype("datetime64[ms]").astype("int64").to_numpy()
        codes = batch["code"].to_numpy()
        accepted = np.zeros(len(millis), bool)
        following, other = next_accepted(millis, codes, self.wait_ms)
        at = int(np.searchsorted(millis, before + self.wait_ms))
        if at < len(millis) and codes[at] == code:
            at = int(other[at])
        last = -1
        while at < len(millis):
            accepted[at], last, at = True, at, int(following[at])
        if last >= 0:
            self.last.update((int(millis[last]), int(codes[last])))
            if before != NEVER:
                self.handle.deleteTimer(before + self.keep_ms)
            self.handle.registerTimer(int(millis[last]) + self.keep_ms)
        yield pd.DataFrame(
            {"key": key[0], "row_id": batch["row_id"], "ts": batch["ts"], "accepted": accepted}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _windowed(
    rows: DataFrame, key: str, time: str, row_id: str, wait_ms: int, keep_ms: int, lateness: str, payload: str | None = None
) -> DataFrame:
    stamp = F.col(time).cast("timestamp")
    shaped = rows.select(
        F.col(key).cast("string").alias("key"),
        F.col(row_id).cast("long").alias("row_id"),
        stamp.alias("ts"),
        payload_code(F.unix_millis(stamp), row_id, payload).alias("code"),
    ).withWatermark("ts", lateness)
    return shaped.groupBy("key").transformWithStateInPandas(
        WindowProcessor(wait_ms, keep_ms),
        outputStructType=WindowProcessor.OUTPUT,
        outputMode="Append",
        timeMode="EventTime",
    )


def cooldown_stream(
    checks: DataFrame, key: str, time: str, row_id: str, seconds: int = 30, keep_seconds: int = 300,
    lateness: str = "1 minute", payload: str | None = None,
) -> DataFrame:
    """Mark checks accepted or skipped; state of quiet views is purged after five minutes.

    With a column of payload hashes a check with the hash of the last accepted one is skipped too, for
    ``keep_seconds`` (a batch, ``ledger.cooldown``, never forgets)."""
    return _windowed(checks, key, time, row_id, seconds * 1000, keep_seconds * 1000, lateness, payload)


def ttl_stream(
    payloads: DataFrame, key: str, time: str, row_id: str, seconds: int = 3600, lateness: str = "1 minute"
) -> DataFrame:
    """The exact result cache: a row not accepted is a hit on the stored result."""
    wait = seconds * 1000 + 1
    return _windowed(payloads, key, time, row_id, wait, wait, lateness)


def deduplicate_stream(
    payloads: DataFrame, key: str, time: str, row_id: str, seconds: int = 3600, lateness: str = "1 minute"
) -> DataFrame:
    """Rows (key, row_id, ts) of payloads that were not stored in the last ``seconds``; a repeat does not
    extend the life of the stored one."""
    return ttl_stream(payloads, key, time, row_id, seconds, lateness).where("accepted").drop("accepted")


def feedback_stream(
    feedback: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, quarantine: str | None = None,
    panels_path: str | None = None,
) -> StreamingQuery:
    """Store the first valid feedback per message and kind; later ones add no row.

    Rows that break a rule go to ``quarantine``, the newest ones to the dashboard's panels, if given."""

    def write(batch: DataFrame, batch_id: int) -> None:
        with stored_tables(batch.sparkSession):
            rows = unstored_feedback(batch, path)
            if panels_path:
                # first the panels: a batch that is repeated after its rows were stored finds them there
                rows = store(rows)
                _panels(batch.sparkSession, f"{panels_path}/feedback").append(panels.feedback_fold(rows), batch_id)
            store_feedback(rows, path)
        if quarantine:
            split_valid(validate_feedback(batch))[1].write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")

    return _start(feedback.writeStream.foreachBatch(write), checkpoint, trigger)


def _panels(spark: SparkSession, path: str) -> BatchTable:
    return BatchTable(spark, path, reduce=panels.merged)


def dashboard_stream(
    events: DataFrame, events_path: str, panels_path: str, checkpoint: str, trigger: dict | None = None,
) -> StreamingQuery:
    """Store arriving events, and fold them into the panels' partial aggregates; no old event is read.

    ``feedback_stream`` does the same for the feedback panel."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with stored_tables(spark):
            rows = store(batch.withColumn("event_date", F.to_date("created_at")))
            write_event_batch(rows, events_path, batch_id)
            _panels(spark, f"{panels_path}/events").append(panels.event_fold(rows), batch_id)

    return _start(events.writeStream.foreachBatch(write), checkpoint, trigger or {"processingTime": "30 seconds"})


def latest_panels(spark: SparkSession, panels_path: str, as_of: str | None = None) -> DataFrame:
    """The five panels (panel, item, n_events, average_risk) of the batches that are complete."""
    folds = [t.read() for t in (_panels(spark, f"{panels_path}/{name}") for name in ("events", "feedback")) if t.exists()]
    if not folds:
        return spark.createDataFrame([], panels.PANEL)
    fold = folds[0] if len(folds) == 1 else folds[0].unionByName(folds[1])
    return panels.panels(fold, as_of or str(spark.sql("SELECT current_timestamp()").first()[0]))


def export_stream(
    events: DataFrame, path: str, checkpoint: str, prefix: str = "msgrisk", trigger: dict | None = None
) -> StreamingQuery:
    """Hand every event that is not safe to the connectors, as flat JSON rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        alerts = batch.filter(F.col("classification") != "safe")
        write_siem(analytics.siem_rows(alerts, prefix, limit=None), f"{path}/batch={batch_id}", "overwrite")

    return _start(events.writeStream.foreachBatch(write), checkpoint, trigger)
