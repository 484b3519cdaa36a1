"""Idle sessions over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.catalog import SESSION_IDLE_SECONDS


def idle_sessions(events: DataFrame, user: str, ts: str, idle: int = SESSION_IDLE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Closed sessions of a stream of events; state goes once the watermark has passed a session's end."""
    events = events.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", late)
    out = events.groupBy(user, F.session_window("event_time", f"{idle} seconds").alias("w")).agg(F.min("event_time").alias("start"), F.max("event_time").alias("end"), F.count("*").alias("n_events"))
    return out.drop("w")
