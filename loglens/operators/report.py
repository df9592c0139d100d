"""Counts, alert groups, rates and output blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.config import ALERT_RATE_WINDOW_S, MAX_ALERT_EVENTS, MAX_ALERT_GROUPS, MAX_RENDERED_ALERTS
from loglens.functions.timeparse import ts_literal

# Bytes of output lines in a block: a row of the result and a JSON object.
BLOCK_BYTES = 16 << 20


def _ts(now) -> Column:
    return now if isinstance(now, Column) else ts_literal(now)


# ---- A1 ---------------------------------------------------------------------------------

def match_counts(rows: DataFrame) -> DataFrame:
    """A1: matches per source plus a total row (``path`` NULL).

    Input: output rows with ``is_match`` and ``is_gap``; markers and
    context lines do not count.  ``rollup`` is a partial aggregation.
    """
    hit = (F.col("is_match") & ~F.col("is_gap")).cast("long")
    return rows.rollup("path").agg(F.sum(hit).alias("matches"))


# ---- A2 / L4 / A3 / A3b / A7: watch ----------------------------------------------------------

def alert_groups(events: DataFrame, time_col: str = "observed_at") -> DataFrame:
    """A2: per (source, line) count, first and last observation."""
    return events.groupBy("source", "line").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(time_col).alias("first"),
        F.max(time_col).alias("last"),
    )


def top_alerts(alerts: DataFrame, k: int = MAX_ALERT_GROUPS) -> DataFrame:
    """L4: most recent groups first, then larger count; full tie-break.

    The 200 groups the live view keeps are exactly the top 200 by ``last``
    (least recently seen is evicted first).  ``orderBy().limit()`` plans as
    ``TakeOrderedAndProject``: a per-task top-k, never a full sort.
    """
    return alerts.orderBy(F.col("last").desc(), F.col("count").desc(), "source", "line").limit(k)


def shown_alerts(alerts: DataFrame) -> DataFrame:
    """L4: the rows the dashboard shows."""
    return top_alerts(alerts, MAX_RENDERED_ALERTS)


def trailing_rate(events: DataFrame, now, time_col: str = "at") -> DataFrame:
    """A3: events in the minute before ``now`` (both ends inclusive).

    ``rate`` is exact; the label shows at most 100,000 (``N+`` beyond), as the
    live view does, and ``rate_capped`` says so.
    """
    t = _ts(now)
    lo = t - F.expr(f"INTERVAL {ALERT_RATE_WINDOW_S} SECONDS")
    n = events.filter((F.col(time_col) >= lo) & (F.col(time_col) <= t)).agg(F.count(F.lit(1)).alias("n"))
    shown = F.least(F.col("n"), F.lit(MAX_ALERT_EVENTS)).cast("string")
    capped = F.col("n") > MAX_ALERT_EVENTS
    return n.select(
        F.col("n").cast("long").alias("rate"),
        capped.alias("rate_capped"),
        F.concat(shown, F.when(capped, F.lit("+")).otherwise(F.lit(""))).alias("rate_label"),
    )


def rate_series(events: DataFrame, time_col: str = "at", bucket_s: int = 3600) -> DataFrame:
    """For every second with events, the events of that second and the
    60 before it.

    Reduced to per-second counts first (partial aggregation).  The seconds
    are then cut into ``bucket_s`` ranges; the last 60 seconds of a range
    are also copied into the next one (halo), so a 60-second range window
    inside each range sees everything it needs -- parallel over ranges, no
    window over one unpartitioned time line.
    """
    w_s = ALERT_RATE_WINDOW_S
    sec = F.floor(F.unix_micros(F.col(time_col).cast("timestamp")) / F.lit(1_000_000)).cast("long")
    per_sec = events.groupBy(sec.alias("sec")).agg(F.count(F.lit(1)).alias("n"))
    bk = F.floor(F.col("sec") / F.lit(bucket_s)).cast("long")
    copies = F.array(
        F.struct(bk.alias("bk"), F.lit(True).alias("primary")),
        F.when(F.col("sec") - bk * F.lit(bucket_s) >= bucket_s - w_s,
               F.struct((bk + 1).alias("bk"), F.lit(False).alias("primary"))),
    )
    x = per_sec.select("sec", "n", F.explode(F.array_compact(copies)).alias("_c")).select(
        "sec", "n", F.col("_c.bk").alias("bk"), F.col("_c.primary").alias("primary"))
    w = Window.partitionBy("bk").orderBy("sec").rangeBetween(-w_s, 0)
    r = x.withColumn("rate", F.sum("n").over(w)).filter(F.col("primary"))
    return r.select(F.timestamp_seconds("sec").alias("second"), F.col("rate").cast("long").alias("rate"))


def watch_header(alerts: DataFrame, rate: DataFrame, files: DataFrame) -> DataFrame:
    """One row -- alert groups, rate, watched sources.

    Each input is reduced to one row; the rows are stacked and folded by a
    global aggregate (no join).
    """
    g = alerts.agg(F.count(F.lit(1)).alias("alert_groups"))
    s = files.agg(F.countDistinct("path").alias("sources"))
    cols = {"alert_groups": "long", "rate": "long", "rate_capped": "boolean", "sources": "long"}

    def widen(df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in cols.items()])

    stacked = widen(g).unionByName(widen(rate)).unionByName(widen(s))
    return stacked.agg(*[F.max(c).alias(c) for c in cols])


# ---- A5 / S7: blocks -----------------------------------------------------------------------------

def blocks(
    rows: DataFrame,
    now,
    span: int | None = None,
    with_counts: bool = True,
    max_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A5: the ordered output lines of a block as one array.

    The rows of a ``(path, bk)`` (``bk`` = ``line_no div width`` of the search
    output; pass ``span`` to re-cut rows without ``bk``) are cut into blocks
    where a running sum of their bytes passes a multiple of ``max_bytes``, so
    a block holds about ``max_bytes`` at most whatever the file and its lines
    are, plus one line.  A source with less is one block, as in the original
    tool.  ``part`` numbers a source's blocks from 0 without gaps; ``suffix``
    is ``"<n> matches"`` with the source's total.  Both come from a table of
    one row per ``(path, bk)``, so the lines never meet by path.
    """
    if span is not None or "bk" not in rows.columns:
        rows = rows.withColumn("bk", F.floor(F.col("line_no") / F.lit(span or 1_000_000)).cast("long"))
    w = Window.partitionBy("path", "bk").orderBy("line_no", "sub")
    running = w.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("line") + 1).over(running), F.lit(0))
    x = rows.select("path", "bk", "line_no", "sub", "line", "is_match", "is_gap", F.floor(before / F.lit(max_bytes)).alias("_cut"))
    new = (F.col("_cut") != F.lag("_cut").over(w)).cast("int")
    x = x.withColumn("_b", F.coalesce(F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("long"))
    agg = x.groupBy("path", "bk", "_b").agg(
        F.array_sort(F.collect_list(F.struct(F.col("line_no"), F.col("sub"), F.col("line")))).alias("_l"),
    )
    hit = (F.col("is_match") & ~F.col("is_gap")).cast("long")
    parts = x.groupBy("path", "bk").agg((F.max("_b") + 1).alias("_n"), F.sum(hit).alias("_m"))
    of_path = Window.partitionBy("path")
    first = F.sum("_n").over(of_path.orderBy("bk").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("path", "bk", F.coalesce(first, F.lit(0)).alias("_first"), F.sum("_m").over(of_path).alias("_total"))
    out = agg.join(parts, ["path", "bk"], "left")
    suffix = F.concat(F.col("_total").cast("string"), F.lit(" matches")) if with_counts else F.lit(None).cast("string")
    t = F.date_format(_ts(now), "yyyy-MM-dd'T'HH:mm:ssXXX")
    lines = F.transform("_l", lambda r: r["line"])
    return out.select("path", (F.col("_first") + F.col("_b")).cast("long").alias("part"), t.alias("time"), suffix.alias("suffix"), lines.alias("lines"))


def to_json_blocks(blk: DataFrame) -> DataFrame:
    """One JSON object per block, keys ``path, time, suffix?, lines``.

    ``<``, ``>``, ``&``, U+2028 and U+2029 are written as ``\\u`` escapes
    like the original encoder; an empty suffix is left out.
    """
    j = F.to_json(F.struct("path", "time", "suffix", "lines"))
    # these characters only occur inside JSON strings, so a plain replace is safe
    for ch, esc in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        j = F.replace(j, F.lit(ch), F.lit(esc))
    return blk.select("path", "part", j.alias("json"))


def write_json_blocks(blk: DataFrame, out_dir: str) -> None:
    """S7 sink: JSON lines text files (one object per line), each file in order."""
    to_json_blocks(blk).sortWithinPartitions("path", "part").select("json").write.mode("overwrite").text(out_dir)
