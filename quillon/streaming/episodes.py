"""Streaming twins: sessions of events with a watermark, a running state of users, an append-only journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 hours", key: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """Sessions of each key: first and last event, number, sum. Works on a stream (rows come out when the watermark passes a session) and on a table."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    g = timed.groupBy(F.col(key).alias("series"), F.session_window("at", gap).alias("w"))
    return g.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total")).drop("w")


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours", key: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    timed = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    g = timed.groupBy(F.col(key).alias("series"), F.window("at", width).alias("w")).agg(F.round(F.sum(value), 2).alias("y"), F.count(F.lit(1)).alias("n"))
    return g.select("series", F.floor(F.unix_timestamp("w.start") / 3600).alias("hour"), "y", "n")


def review_state(events: DataFrame, key: str = "user_id") -> DataFrame:
    """For each key, after each batch: events so far, the last action and whether it stands approved. State lives in the engine's state store."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(keys, frames, state: GroupState):
        n, last, at = state.get if state.exists else (0, "", -1)
        for pdf in frames:
            n += len(pdf)
            top = pdf.loc[pdf["event_id"].idxmax()]
            if int(top["event_id"]) > at:
                at, last = int(top["event_id"]), str(top["event_type"])
        state.update((n, last, at))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "last_action": [last], "approved": [last == "purchase"]})

    return events.select(key, "event_id", "event_type").groupBy(key).applyInPandasWithState(step, f"{key} long, n long, last_action string, approved boolean", "n long, last string, at long", "update", GroupStateTimeout.NoTimeout)


def journal(stream: DataFrame, path: str, checkpoint: str):
    """Appends each batch to a journal once, however often a batch is run again."""

    def add(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").json(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
