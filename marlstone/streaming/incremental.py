"""Streaming forms of maintenance: idempotent upserts per micro-batch, run folding, sessions and traces with an end of life."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.operators.maintenance import BucketedTable, VersionedTables, upsert_chunks


def upsert_stream(changes: DataFrame, store: VersionedTables, name: str, checkpoint: str, order: list[str], key: str = "doc_id", id: str = "chunk_id", wrap: Callable | None = None):
    """A query that applies each micro-batch of changed chunks to a versioned table: a document's chunks are replaced as a
    whole, so a batch that is run again changes nothing but ids."""

    def apply(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        now = store.current()
        if now is None:
            old = batch.limit(0).withColumn(id, F.lit(None).cast("long"))
            last = 0
        else:
            old = store.read(name, now)
            last = old.agg(F.max(id)).first()[0] or 0
        store.write({name: upsert_chunks(old, batch, last, order, key, id)})

    w = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (wrap(w) if wrap else w.trigger(availableNow=True)).start()


def upsert_buckets(changes: DataFrame, table: BucketedTable, checkpoint: str, order: list[str], wrap: Callable | None = None):
    """As `upsert_stream`, into a bucketed table: a micro-batch rewrites only the buckets of its documents, and one that is run
    again after it was applied is skipped."""

    def apply(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            table.apply(batch, order, f"{checkpoint}#{epoch}")

    w = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (wrap(w) if wrap else w.trigger(availableNow=True)).start()


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user of a stream or table of events (ts, user_id, value): started, ended, events, total."""
    w = F.session_window("ts", gap)
    src = events.withWatermark("ts", late) if events.isStreaming else events
    return src.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events", "total")


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events by type and time window; late events count until the watermark has passed."""
    src = events.withWatermark("ts", late) if events.isStreaming else events
    return src.groupBy(F.window("ts", size, slide or size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def fold_open_runs(records: DataFrame, timeout_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """Runs of a stream of records (run, stage, status, at): a row when a run ends, and an `incomplete` one when its end doesn't come
    in time: run, status, records."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame({"run": [key[0]], "status": ["incomplete"], "records": [n]})
            return
        n = state.get[0] if state.exists else 0
        ended = None
        for b in batches:
            n += len(b)
            e = b[b["stage"] == "end"]
            if len(e):
                ended = e["status"].iloc[-1]
        if ended is not None:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"run": [key[0]], "status": [ended], "records": [n]})
        else:
            state.update((n,))
            state.setTimeoutDuration(timeout_ms)

    return records.groupBy("run").applyInPandasWithState(update, "run string, status string, records long", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows appended to a log of JSON lines."""
    rows.write.mode("append").json(path)


#: Lines after which a log is compacted, and those that stay.
LOG_LINES, LOG_KEPT = 1_500, 500


def compact_log(log: DataFrame, path: str, keep: int = LOG_KEPT, at: str = "started") -> None:
    """The last `keep` rows of a log, written anew in one version."""
    log.orderBy(F.desc_nulls_last(at)).limit(keep).coalesce(1).write.mode("overwrite").json(path)


def compact_when_long(log: DataFrame, path: str, lines: int = LOG_LINES, keep: int = LOG_KEPT, at: str = "started") -> bool:
    """Compacts a log once it has more than `lines` rows; says whether it did."""
    if log.limit(lines + 1).count() <= lines:
        return False
    compact_log(log, path, keep, at)
    return True
