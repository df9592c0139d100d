"""Line-level search operators: filters (P1-P5, P12), context (W1, J3),
gap markers (W2), runs (W3, W6), last lines (W4), fair batches (W5),
buffer caps (W7).

Every operator takes and returns a ``lines``-shaped DataFrame
(``path, line_no, line`` plus flags).  Ordered steps use the bucketed
primitives of ``ordered`` so that one huge file is never one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.config import LogQuery
from loglens.functions import regex as rx
from loglens.functions.timeparse import line_time, ts_literal
from loglens.operators.ordered import DEFAULT_BUCKET_LINES, line_bucket, previous_row, running_count

GAP = "--"


# ---- filters -------------------------------------------------------------------------

def since_ok(line: Column, fallback: Column, since, year=None) -> Column:
    """Line time >= since; lines without a time use ``fallback``."""
    if since is None:
        return F.lit(True)
    s = since if isinstance(since, Column) else ts_literal(since)
    return F.coalesce(line_time(line, year), fallback.cast("timestamp")) >= s


def flag_lines(
    df: DataFrame,
    q: LogQuery,
    time_col: str = "file_mtime",
    year=None,
) -> DataFrame:
    """Add ``is_eligible`` (not noise, recent enough) and ``is_match``.

    Without a pattern every eligible line is a match.
    """
    line = F.col("line")
    elig = ~rx.ignored(line, q.ignore) & since_ok(line, F.col(time_col), q.since, year)
    pattern = rx.severity_pattern(q.pattern) if q.pattern else None
    hit = rx.match(line, pattern, q.ignore_case)
    return df.withColumn("is_eligible", elig).withColumn("is_match", F.col("is_eligible") & hit)


# ---- W1 / J3: context -------------------------------------------------------------------

def context(
    df: DataFrame,
    before: int,
    after: int,
    plan: str = "join",
) -> DataFrame:
    """Eligible lines within ``before``/``after`` lines of a match.

    Input needs ``path, line_no, is_eligible, is_match``.  Ineligible lines
    keep their positions (they use up context and make gaps) but are not
    returned.

    * ``plan="join"`` (default): each match names the positions it selects;
      these go through a ``distinct`` and a semi join on ``(path, line_no)``.
      Hash-partitioned on both columns, so a huge file spreads over all
      tasks; when matches are rare AQE turns the join into a broadcast and
      the lines are not shuffled at all.
    * ``plan="window"``: ``max(is_match)`` over a row frame per file: one sort
      per file, good for many similar small files.
    """
    if before == 0 and after == 0:
        return df.filter(F.col("is_match"))
    if plan == "window":
        w = Window.partitionBy("path").orderBy("line_no").rowsBetween(-after, before)
        near = F.max(F.col("is_match").cast("int")).over(w) == 1
        return df.withColumn("_near", near).filter(F.col("_near") & F.col("is_eligible")).drop("_near")
    hits = df.filter(F.col("is_match")).select(
        "path",
        F.explode(F.sequence(F.col("line_no") - before, F.col("line_no") + after)).alias("line_no"),
    ).distinct()
    return df.filter(F.col("is_eligible")).join(hits, ["path", "line_no"], "left_semi")


# ---- W2 / W3: gap markers and runs -------------------------------------------------------

def _bucket(width: int) -> Column:
    return F.floor(F.col("line_no") / F.lit(int(width))).cast("long")


def _in_order(*more: str) -> Window:
    return Window.partitionBy("path", "bk").orderBy("line_no", *more)


def _edges(x: DataFrame, collapse: bool) -> DataFrame:
    """One small row per bucket: where it starts and ends, and what its first
    and last run look like."""
    agg = [
        F.min("line_no").alias("first_no"), F.max("line_no").alias("last_no"),
        F.bool_or(F.when(F.col("_k") == 1, F.col("_gap"))).alias("gap"),
        # keeps all columns in this branch, so that both branches read one and the same exchange
        F.sum(F.octet_length("line") + F.col("is_match").cast("int")).alias("size"),
    ]
    if collapse:
        hits_before = F.col("_hits") - F.col("is_match").cast("int")
        later = F.col("_start") & (F.col("_k") > 1)
        agg += [
            F.max("_k").alias("n"), F.max("_hits").alias("m"),
            F.min_by("line", "_k").alias("first_line"), F.max_by("line", "_k").alias("last_line"),
            F.min(F.when(later, F.col("_k"))).alias("second"), F.max(F.when(later, F.col("_k"))).alias("last"),
            F.min(F.when(later, hits_before)).alias("second_hits"), F.max(F.when(later, hits_before)).alias("last_hits"),
        ]
    return x.groupBy("path", "bk").agg(*agg)


def _joined_edges(edges: DataFrame, collapse: bool) -> DataFrame:
    """What a bucket's rows need to know of the buckets before and after it:
    ``_gap0`` (a marker before its first row) and, for runs, ``_joins`` (its
    first run goes on from an earlier bucket) and the length and hits of its
    first and last run as a whole (``_fn _fm _ln _lm``).

    A scan by path over one row per bucket; no line is in it but the edges'.
    """
    w = Window.partitionBy("path").orderBy("bk")
    before = F.lag("last_no").over(w)
    gap = F.coalesce("gap", F.col("first_no") - before > 1, F.lit(False)) & (F.col("size") >= 0)
    e = edges.withColumn("_gap0", gap)
    if not collapse:
        return e.select("path", "bk", "_gap0")
    joins = F.coalesce(F.lag("last_line").over(w).eqNullSafe(F.col("first_line")) & before.isNotNull() & ~F.col("_gap0"), F.lit(False))
    first = F.struct(F.lit(0).alias("at"), (F.coalesce(F.col("second") - 1, F.col("n"))).alias("n"), F.coalesce("second_hits", "m").alias("m"))
    last = F.when(F.col("last").isNotNull(), F.struct(F.lit(1).alias("at"), (F.col("n") - F.col("last") + 1).alias("n"), (F.col("m") - F.col("last_hits")).alias("m")))
    runs = e.withColumn("_joins", joins).select("path", "bk", "_gap0", "_joins", F.explode(F.array_compact(F.array(first, last))).alias("r"))
    runs = runs.select("path", "bk", "_gap0", "_joins", "r.*")
    alone = (F.col("at") == 1) | ~F.col("_joins")
    order = Window.partitionBy("path").orderBy("bk", "at").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("chain", F.sum(alone.cast("int")).over(order))
    whole = Window.partitionBy("path", "chain")
    runs = runs.withColumns({"n": F.sum("n").over(whole), "m": F.sum("m").over(whole)})
    return runs.groupBy("path", "bk", "_gap0", "_joins").agg(
        F.min_by("n", "at").alias("_fn"), F.min_by("m", "at").alias("_fm"),
        F.max_by("n", "at").alias("_ln"), F.max_by("m", "at").alias("_lm"),
    )


def _assembled(x: DataFrame, collapse: bool) -> DataFrame:
    """Output rows of lines placed in buckets.

    Input: ``path, bk, line_no, sub, line, is_match``, the row's place ``_k``
    in its bucket and ``_gap`` (a marker belongs before it; null if only the
    buckets before can tell).  The text stays in its ``(path, bk)``
    partition: what crosses bucket edges is a table of one row per bucket.
    """
    if collapse:
        w = _in_order("sub")
        same = F.lag("line").over(w).eqNullSafe(F.col("line"))
        start = (F.col("_k") == 1) | F.coalesce("_gap", F.lit(False)) | ~same
        x = x.withColumns({"_start": start, "_hits": F.sum(F.col("is_match").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    told = _joined_edges(_edges(x, collapse), collapse)
    line, match = F.col("line"), F.col("is_match")
    if collapse:
        x = x.filter("_start").withColumn("_hits", F.col("_hits") - F.col("is_match").cast("int"))
        x = x.withColumns({"_next": F.lead("_k").over(w), "_next_hits": F.lead("_hits").over(w)})
    x = x.join(told, ["path", "bk"], "left")
    if collapse:
        x = x.filter((F.col("_k") > 1) | ~F.col("_joins"))
        inner = F.col("_next").isNotNull() & (F.col("_k") > 1)
        n = F.when(inner, F.col("_next") - F.col("_k")).when(F.col("_k") == 1, F.col("_fn")).otherwise(F.col("_ln"))
        m = F.when(inner, F.col("_next_hits") - F.col("_hits")).when(F.col("_k") == 1, F.col("_fm")).otherwise(F.col("_lm"))
        line = F.when(n > 1, F.concat(line, F.lit("  × "), n.cast("string"))).otherwise(line)
        match = m > 0
    gap = F.when(F.col("_k") == 1, F.col("_gap0")).otherwise(F.coalesce("_gap", F.lit(False)))
    row = lambda sub, text, hit, is_gap: F.struct(sub.alias("sub"), text.alias("line"), hit.alias("is_match"), F.lit(is_gap).alias("is_gap"))
    emit = F.array(F.when(gap, row(F.lit(0), F.lit(GAP), F.lit(False), True)), row(F.col("sub"), line, match, False))
    return x.select("path", "bk", "line_no", F.explode(F.array_compact(emit)).alias("_e")).select("path", "bk", "line_no", "_e.*")


def _marked(sel: DataFrame, width: int, markers: bool, collapse: bool = False) -> DataFrame:
    """Output rows of already selected lines, from one exchange of them to
    ``(path, line_no div width)``: a ``--`` before a line that does not follow
    the previous selected line of its file, and runs as one row.
    """
    # both branches of the plan below must filter alike to share one exchange: here, and by a left join
    x = sel.filter(F.col("path").isNotNull()).select("path", _bucket(width).alias("bk"), "line_no", F.lit(1).alias("sub"), "line", "is_match")
    if not markers and not collapse:
        return x.withColumn("is_gap", F.lit(False))
    w = _in_order("sub")
    before = F.lag("line_no").over(w)
    gap = F.when(before.isNotNull(), F.col("line_no") - before > 1) if markers else F.lit(False)
    return _assembled(x.withColumns({"_gap": gap, "_k": F.row_number().over(w)}), collapse)


def gap_markers(sel: DataFrame, bucket_width: int = DEFAULT_BUCKET_LINES) -> DataFrame:
    """A ``--`` row before each selected line that does not follow the
    previous selected line of its file.

    Output: ``path, line_no, sub, line, is_match, is_gap``; ``(line_no, sub)``
    orders a file's output (the marker has ``sub=0`` and the line number of
    the line after it).
    """
    return _marked(sel, bucket_width, True).drop("bk")


def dedup(rows: DataFrame, bucket_width: int = DEFAULT_BUCKET_LINES) -> DataFrame:
    """Collapse consecutive equal output lines to ``line  × n``.

    Input: output rows ``path, line_no, sub, line, is_match, is_gap`` (see
    ``gap_markers``; plain selected lines with ``sub=1, is_gap=false`` work
    too).  Runs are formed inside buckets of ``bucket_width`` line numbers and
    joined over bucket edges by a table of one row per bucket.  The width
    steers parallelism only.

    The match count of a run is its flag before the rewrite (one per run);
    markers never join a run.
    """
    w = _in_order("sub")
    x = rows.filter(F.col("path").isNotNull()).select("path", _bucket(bucket_width).alias("bk"), "line_no", "sub", "line", "is_match", "is_gap")
    # a marker has the line number of the line after it, so both lie in one bucket
    x = x.withColumn("_gap", F.coalesce(F.lag("is_gap").over(w), F.lit(False))).filter(~F.col("is_gap")).drop("is_gap")
    return _assembled(x.withColumn("_k", F.row_number().over(w)), True).select(*OUT_COLS)


def drop_repeats(df: DataFrame, bucket_width: int = DEFAULT_BUCKET_LINES) -> DataFrame:
    """Drop a line equal to the line before it (no counter)."""
    p = previous_row(df, ["path"], "line_no", ["line"], line_bucket("line_no", bucket_width))
    return p.filter(~F.col("line").eqNullSafe(F.col("prev_line"))).drop("prev_line", "prev_line_no")


# ---- W4 / W5 / W7: per-source limits ------------------------------------------------------------

def tail_lines(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` lines of each source.

    ``row_number() <= n`` becomes a ``WindowGroupLimit``: each map task
    forwards at most ``n`` rows per source, so a huge file costs no big sort.
    """
    w = Window.partitionBy("path").orderBy(F.col("line_no").desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def fair_batches(df: DataFrame, per_source: int, bucket_width: int = DEFAULT_BUCKET_LINES) -> DataFrame:
    """Round number of each line when every source may emit
    ``per_source`` lines per round; emit order is ``round, path, line_no``."""
    r = running_count(df, ["path"], [F.col("line_no")], line_bucket("line_no", bucket_width), "_rc")
    return r.withColumn("round", F.floor((F.col("_rc") - 1) / F.lit(per_source)).cast("long")).drop("_rc")


def cap_pending(df: DataFrame, n: int) -> DataFrame:
    """Keep the newest ``n`` lines of each source; ``dropped`` counts the rest."""
    kept = tail_lines(df, n)
    counts = df.groupBy("path").agg(F.count(F.lit(1)).alias("_total"))
    return kept.join(counts, "path").withColumn(
        "dropped", F.greatest(F.col("_total") - F.lit(n), F.lit(0)).cast("long")
    ).drop("_total")


# ---- composed search --------------------------------------------------------------------------

OUT_COLS = ("path", "bk", "line_no", "sub", "line", "is_match", "is_gap")


def _near_in_buckets(flagged: DataFrame, q: LogQuery, width: int) -> DataFrame:
    """Eligible lines near a match, from one shuffle of all lines to
    ``(path, line_no div width)``.

    Every line is also copied to the other buckets that hold a line within
    ``max(before, after)`` of it (the halo, which may span many buckets), so
    the range frame of every line is complete inside its bucket.
    """
    h = max(q.before, q.after)
    home = F.floor(F.col("line_no") / F.lit(width)).cast("long")
    low = F.greatest(F.floor((F.col("line_no") - h) / F.lit(width)), F.lit(0)).cast("long")
    high = F.floor((F.col("line_no") + h) / F.lit(width)).cast("long")
    x = flagged.select("path", "line_no", "line", "is_eligible", "is_match", home.alias("home"), F.explode(F.sequence(low, high)).alias("bk"))
    w = Window.partitionBy("path", "bk").orderBy("line_no").rangeBetween(-q.after, q.before)
    x = x.withColumn("_near", F.max(F.col("is_match").cast("int")).over(w) == 1)
    return x.filter(F.col("_near") & F.col("is_eligible") & (F.col("home") == F.col("bk"))).select("path", "line_no", "line", "is_match")


def select_lines(
    df: DataFrame,
    q: LogQuery,
    time_col: str = "file_mtime",
    year=None,
    plan: str = "auto",
    markers: bool = True,
    bucket_width: int = DEFAULT_BUCKET_LINES,
) -> DataFrame:
    """Search one lines table: filters -> context -> gap markers -> dedup.

    Output rows ``path, bk, line_no, sub, line, is_match, is_gap``; ``bk``
    (``line_no div bucket_width``) names the output chunk.  Markers and runs
    are those of the whole file: all plans and widths give the same rows.

    Plans:

    * ``"auto"`` (default): without context, ``"select"``; with context,
      ``"join"``.
    * ``"select"``: filter first, then shuffle only the selected lines for
      markers and runs -- the plan for plain searches, where matches are a
      small part of the data.
    * ``"join"``: the positions near matches go through a semi join (J3), so
      the text of lines that aren't selected is not shuffled when AQE
      broadcasts the positions; then as ``"select"``.
    * ``"bucket"``: context from one shuffle of all lines -- best when matches
      are dense.
    * ``"window"``: per-file window (one sort per file, not skew-safe).
    """
    flagged = flag_lines(df, q, time_col, year)
    has_context = bool(q.before or q.after)
    if plan == "auto":
        plan = "join"
    if not q.has_pattern:
        sel = flagged.filter(F.col("is_eligible"))
    elif not has_context:
        sel = flagged.filter(F.col("is_match"))
    elif plan == "bucket":
        sel = _near_in_buckets(flagged, q, bucket_width)
    else:
        sel = context(flagged, q.before, q.after, "window" if plan == "window" else "join")
    return _marked(sel, bucket_width, markers and q.has_pattern, q.dedup).select(*OUT_COLS)


def order_output(rows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return rows.orderBy("path", *extra, "line_no", "sub")
