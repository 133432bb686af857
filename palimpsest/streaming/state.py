"""Structured Streaming forms of the keyed state operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATEST = "user_id long, event_id long, ts timestamp, event_type string, value double"


def _newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best = state.get if state.exists else None
    changed = False
    for frame in frames:
        row = frame.sort_values(["ts", "event_id"]).iloc[-1]
        new = (int(row.ts.value), int(row.event_id), str(row.event_type), float(row.value))
        if best is None or new[:2] >= best[:2]:
            best, changed = new, True
    if changed:
        state.update(best)
        yield pd.DataFrame({"user_id": [key[0]], "event_id": [best[1]], "ts": [pd.Timestamp(best[0])], "event_type": [best[2]], "value": [best[3]]})


def latest_wins_stream(events: DataFrame) -> DataFrame:
    """Per user the newest event so far; older arrivals change nothing. Emits each change (update mode)."""
    return events.groupBy("user_id").applyInPandasWithState(_newest, LATEST, "ts_ns long, event_id long, event_type string, value double", "update", GroupStateTimeout.NoTimeout)


def quota_stream(events: DataFrame, limit: int) -> DataFrame:
    """Requests in arrival order with whether the user's counter still allowed them."""

    def consume(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        for frame in frames:
            frame = frame.sort_values(["ts", "event_id"])
            granted = [used + k < limit for k in range(len(frame))]
            used += sum(granted)
            yield pd.DataFrame({"user_id": key[0], "event_id": frame.event_id.to_numpy(), "granted": granted})
        state.update((used,))

    return events.groupBy("user_id").applyInPandasWithState(consume, "user_id long, event_id long, granted boolean", "used long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by type and time window; events later than `late` are dropped."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


def upsert_batch(batch: DataFrame, batch_id: int, path: str, key: list[str], version: list[str]) -> None:
    """Merges a batch into the keyed table under path: of each key the row of the greatest version stays.

    Every batch writes a table of its own, made of the one before it and of the batch alone, so that a batch that comes
    again, after a failure say, writes the same rows in the same place. For use in foreachBatch.
    """
    from pyspark.sql import functions as F

    spark = batch.sparkSession
    rows = batch
    done = [b for b in _batches(spark, path) if b < batch_id]
    if done:
        rows = spark.read.schema(batch.schema).parquet(f"{path}/batch={max(done)}").unionByName(batch)
    order = F.struct(*version, *[c for c in rows.columns if c not in version])
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _batches(spark, path: str) -> list[int]:
    """Numbers of the batches whose tables are complete."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    tables = [s.getPath() for s in files.listStatus(folder)]
    return [int(p.getName().split("=")[1]) for p in tables if p.getName().startswith("batch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def current_table(spark, path: str, schema) -> DataFrame:
    """The keyed table as the last complete batch left it; empty before the first."""
    done = _batches(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/batch={max(done)}") if done else spark.createDataFrame([], schema)


def upsert_stream(rows: DataFrame, path: str, key: list[str], version: list[str], checkpoint: str):
    """A stream writer that keeps the keyed table under path up to date; start() it."""
    return rows.writeStream.foreachBatch(lambda batch, k: upsert_batch(batch, k, path, key, version)).option("checkpointLocation", checkpoint)
