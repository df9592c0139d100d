"""Watch: running alert groups and rolling rate.

``watch_sink`` is a ``foreachBatch`` function.  One aggregate with grouping
sets reduces the micro-batch -- read once -- to alert groups, per-second
counts, sources and the latest time; it is written as the batch's ``delta``.
That small table is merged with the previous state tables (at most 200
groups, 61 seconds, one row per watched source) and written as the next
version.  Batch ``i`` reads the version of batch ``i-1`` only, so a replayed
batch is idempotent.

The 200 groups kept are the 200 most recently seen (the least recently
seen is evicted first); a group evicted and seen again restarts its count.
The rate is exact: the sum of the seconds of the last minute.  ``watch``
unions a heartbeat into the stream (Spark's rate source), so time goes on and
the rate falls when nothing is appended.  Sources leave with their ``gone``
marker.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.config import ALERT_RATE_WINDOW_S, MAX_ALERT_EVENTS, MAX_ALERT_GROUPS, LogQuery
from loglens.functions import regex as rx
from loglens.operators import lines as L
from loglens.operators import report as R
from loglens.streaming.follow import read_version

ALERTS_SCHEMA = "source string, line string, count long, first timestamp, last timestamp"
SECONDS_SCHEMA = "sec long, n long"
SOURCES_SCHEMA = "path string"
HEADER_SCHEMA = "alert_groups long, rate long, rate_capped boolean, sources long, now timestamp"


def eligible_events(batch: DataFrame, q: LogQuery, year=None) -> DataFrame:
    """Lines that count as alerts: match, not noise, recent enough."""
    pattern = rx.severity_pattern(q.pattern) if q.pattern else None
    line = F.col("line")
    ok = ~rx.ignored(line, q.ignore) & rx.match(line, pattern, q.ignore_case) & L.since_ok(
        line, F.col("observed_at"), q.since, year)
    return batch.filter((F.col("kind") == "line") & ok).select(
        F.col("path").alias("source"), "line", F.col("observed_at").alias("at"))


def batch_delta(batch: DataFrame, q: LogQuery, year=None) -> DataFrame:
    """All that the state needs to know of a micro-batch, from one pass.

    ``what``: group (source, line), second (sec), source (path) or all.
    """
    pattern = rx.severity_pattern(q.pattern) if q.pattern else None
    line, at = F.col("line"), F.col("observed_at")
    event = (F.col("kind") == "line") & ~rx.ignored(line, q.ignore) & rx.match(line, pattern, q.ignore_case) & L.since_ok(line, at, q.since, year)
    event = F.coalesce(event, F.lit(False))
    sec = F.floor(F.unix_micros(at) / F.lit(1_000_000)).cast("long")
    x = batch.withColumn("_e", event).select(
        F.when(F.col("_e"), F.col("path")).alias("source"), F.when(F.col("_e"), line).alias("line"), F.when(F.col("_e"), sec).alias("sec"), "path",
        F.col("_e").cast("long").alias("n"), F.when(F.col("_e"), at).alias("at"), at.alias("seen"), (F.col("kind") == "gone").alias("gone"),
    )
    keys = [F.col(c) for c in ("source", "line", "sec", "path")]
    sets = x.groupingSets([keys[:2], keys[2:3], keys[3:], []], *keys).agg(
        F.grouping_id().alias("g"), F.sum("n").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.max("seen").alias("seen"), F.bool_or("gone").alias("gone"))
    what = F.when(F.col("g") == 0b0011, "group").when(F.col("g") == 0b1101, "second").when(F.col("g") == 0b1110, "source").otherwise("all")
    # lines that are no events, and ticks without a path, make one empty group each
    some = (F.col("n") > 0) & (F.col("what").isin("group", "second")) | (F.col("what") == "source") & F.col("path").isNotNull() | (F.col("what") == "all")
    return sets.withColumn("what", what).filter(some).select(*DELTA)


DELTA = ("what", "source", "line", "sec", "path", "n", "first", "last", "seen", "gone")
DELTA_SCHEMA = "what string, source string, line string, sec long, path string, n long, first timestamp, last timestamp, seen timestamp, gone boolean"


def watch_sink(spark: SparkSession, state_dir: str, q: LogQuery, keep: int = MAX_ALERT_GROUPS, year=None):
    """``foreachBatch`` function maintaining ``alerts``, ``seconds``,
    ``sources`` and ``header`` tables under ``state_dir`` (versioned)."""
    schemas = {"delta": DELTA_SCHEMA, "alerts": ALERTS_SCHEMA, "seconds": SECONDS_SCHEMA, "sources": SOURCES_SCHEMA, "header": HEADER_SCHEMA}

    def put(df: DataFrame, table: str, batch_id: int) -> DataFrame:
        root = os.path.join(state_dir, table)
        df.write.mode("overwrite").parquet(os.path.join(root, f"v={batch_id}"))
        return read_version(spark, root, batch_id, schemas[table])

    def before(table: str, batch_id: int) -> DataFrame:
        return read_version(spark, os.path.join(state_dir, table), batch_id - 1, schemas[table])

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        delta = put(batch_delta(batch, q, year), "delta", batch_id)
        of = lambda what: delta.filter(F.col("what") == what)

        groups = of("group").select("source", "line", F.col("n").alias("count"), "first", "last")
        merged = before("alerts", batch_id).unionByName(groups).groupBy("source", "line").agg(
            F.sum("count").alias("count"), F.min("first").alias("first"), F.max("last").alias("last"))
        alerts = put(R.top_alerts(merged, keep), "alerts", batch_id)

        now = of("all").select(F.col("seen").alias("now")).unionByName(before("header", batch_id).select("now")).agg(F.max("now").alias("now")).first()["now"]
        # the seconds still inside the window of the latest time seen
        secs = before("seconds", batch_id).unionByName(of("second").select("sec", "n")).groupBy("sec").agg(F.sum("n").alias("n"))
        t = F.unix_seconds(F.lit(now).cast("timestamp"))
        secs = put(secs.filter(F.col("sec") >= t - ALERT_RATE_WINDOW_S), "seconds", batch_id)

        seen = of("source").filter(~F.col("gone")).select("path")
        left = of("source").filter("gone").select("path")
        sources = put(before("sources", batch_id).unionByName(seen).distinct().join(left, "path", "left_anti"), "sources", batch_id)

        rate = secs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rate"))
        rate = rate.select("rate", (F.col("rate") > MAX_ALERT_EVENTS).alias("rate_capped"))
        put(R.watch_header(alerts, rate, sources).withColumn("now", F.lit(now).cast("timestamp")), "header", batch_id)

    return on_batch


def latest(spark: SparkSession, state_dir: str, table: str, batch_id: int) -> DataFrame:
    schema = {"alerts": ALERTS_SCHEMA, "seconds": SECONDS_SCHEMA, "sources": SOURCES_SCHEMA,
              "header": HEADER_SCHEMA}[table]
    return read_version(spark, os.path.join(state_dir, table), batch_id, schema)


def windowed_rate(stream: DataFrame, q: LogQuery) -> DataFrame:
    """T9 for SQL users: events per sliding minute, every second, with a
    one-minute watermark on the observation time."""
    ev = eligible_events(stream, q)
    return ev.withWatermark("at", "1 minute").groupBy(F.window("at", "60 seconds", "1 second")).agg(
        F.count(F.lit(1)).alias("events"))


def ticks(spark: SparkSession) -> DataFrame:
    """A stream of one row a second: ``kind`` tick, no path, no line."""
    beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return beat.select(F.lit("tick").alias("kind"), F.col("timestamp").alias("observed_at"))


def watch(
    spark: SparkSession,
    path: str,
    q: LogQuery,
    state_dir: str | None = None,
    trigger: str = "1 second",
    heartbeat: bool = True,
    **source_options,
):
    """Section 3.3: ``logtail`` -> alert groups, rate and header tables
    (T8, T9) under ``state_dir`` (default: a fresh folder in the shared
    ``spark.checkpoint.dir``).  ``heartbeat`` lets time go on without new
    lines; such a query always has something to do.  Returns ``(StreamingQuery, state_dir)``;
    read the tables with ``latest``."""
    from loglens.session import new_state_dir
    from loglens.sources.tail import tail_stream

    state_dir = state_dir or new_state_dir(spark, "watch")
    src = tail_stream(spark, path, **source_options)
    if heartbeat:
        src = src.unionByName(ticks(spark), allowMissingColumns=True)
    sq = (src.writeStream.foreachBatch(watch_sink(spark, state_dir, q))
          .option("checkpointLocation", os.path.join(state_dir, "checkpoint"))
          .trigger(processingTime=trigger).start())
    return sq, state_dir
