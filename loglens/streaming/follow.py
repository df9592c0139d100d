"""Follow: the search predicate over appended lines.

Input is the ``logtail`` stream (``sources.tail``): ``path, gen, offset, line,
kind, observed_at``; markers (``kind`` rotated/truncated) pass through.

* T1 ``follow_filter``: stateless filter, append mode.
* T2/T3/T4 ``context_batch``: one micro-batch as DataFrame operations.  Lines
  get their positions from ordinals within byte chunks plus one row a chunk,
  so a batch of one huge file uses all tasks; what is carried from batch to
  batch is one row a file: its last ``before`` lines and how far its context
  is open.  ``context_sink`` runs it in ``foreachBatch`` with versioned state.
  Ignored lines do not take a position (unlike batch search), each line is
  printed once, a match re-arms ``after``, there are no ``--`` markers, dedup
  only inside one batch, a rotation resets the state.
* ``follow_context``: the same as one streaming DataFrame with
  ``applyInPandasWithState``, a group being a file's rows of a micro-batch;
  for streams of small files.
* T7 ``fair_flush``: ``foreachBatch`` sink; pending lines of each source are
  a table in the shared checkpoint folder, versioned by batch id, so a
  replayed batch reads the same input and writes the same output.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from loglens.config import MAX_BATCH_LINES, MAX_BUFFER_LINES, LogQuery
from loglens.functions import regex as rx
from loglens.operators import lines as L
from loglens.operators.ordered import line_bucket, ordinal

# --- fixed values: notices that users see -----------------------------------------
ROTATED_NOTICE = "↻ file rotated/replaced"
TRUNCATED_NOTICE = "↻ file truncated"
BUFFERED_SUFFIX = " buffered"
DROPPED_NOTICE = ("⚠ skipped ", " older buffered lines (hot log)")
# ---------------------------------------------------------------------------------------

OUT_SCHEMA = "path string, gen long, offset long, seq long, line string, observed_at timestamp"
STATE_SCHEMA = (
    "seen long, wanted_until long, emitted long, "
    "kept array<struct<at:long,gen:long,offset:long,line:string>>"
)


def follow_filter(stream: DataFrame, q: LogQuery, year=None) -> DataFrame:
    """Appended lines that pass the search predicate (markers kept)."""
    pattern = rx.severity_pattern(q.pattern) if q.pattern else None
    line = F.col("line")
    ok = ~rx.ignored(line, q.ignore) & rx.match(line, pattern, q.ignore_case) & L.since_ok(
        line, F.col("observed_at"), q.since, year)
    marker = F.col("kind").isin("rotated", "truncated")
    out = stream.filter(marker | (F.col("kind") == "line") & ok)
    return out.withColumn("line", F.when(marker, F.when(F.col("kind") == "rotated", ROTATED_NOTICE)
                                         .otherwise(TRUNCATED_NOTICE)).otherwise(F.col("line")))


def _collapsed(rows: pd.DataFrame) -> pd.DataFrame:
    """Consecutive equal lines of one batch -> ``line  × n`` at the first one's place."""
    run = (rows["line"] != rows["line"].shift()).cumsum()
    first = rows.groupby(run, sort=False).first()
    n = rows.groupby(run, sort=False).size()
    first["line"] = [t if k == 1 else f"{t}  × {k}" for t, k in zip(first["line"], n)]
    return first


class _FileSoFar:
    """What a file's next lines need to know of those before: positions count
    the lines that noise filters let through, since the file (re)started."""

    def __init__(self, seen=0, wanted_until=0, emitted=0, kept=()):
        self.seen, self.wanted_until, self.emitted = seen, wanted_until, emitted
        self.kept = [(int(k["at"]), int(k["gen"]), int(k["offset"]), k["line"]) for k in kept]

    def add(self, part: pd.DataFrame, q: LogQuery) -> pd.DataFrame:
        """The selected rows among the kept lines and the part's, each once."""
        n = len(part)
        at = np.arange(self.seen + 1, self.seen + n + 1)
        old = pd.DataFrame(self.kept, columns=["at", "gen", "offset", "line"])
        rows = pd.concat([old, part.assign(at=at)[["at", "gen", "offset", "line", "observed_at"]]], ignore_index=True)
        place = rows["at"].to_numpy(np.int64)
        if q.has_pattern:
            hits = at[part["is_match"].to_numpy(bool)]
            # the next match at or after a line, and the last one at or before it
            following = np.append(hits, np.iinfo(np.int64).max)[np.searchsorted(hits, place)]
            leading = np.append(-q.after - 1, hits)[np.searchsorted(hits, place, side="right")]
            wanted = (following - q.before <= place) | (leading + q.after >= place) & (leading > 0) | (place <= self.wanted_until)
            if len(hits):
                self.wanted_until = int(hits[-1]) + q.after
        else:
            wanted = np.ones(len(rows), bool)
        chosen = rows[wanted & (place > self.emitted)]
        self.seen += n
        if len(chosen):
            self.emitted = int(chosen["at"].iloc[-1])
        last = rows[place > self.seen - q.before] if q.before else rows.iloc[:0]
        self.kept = list(last[["at", "gen", "offset", "line"]].itertuples(index=False, name=None))
        if chosen["observed_at"].isna().any():  # a kept line is shown with what made it wanted
            chosen = chosen.assign(observed_at=chosen["observed_at"].fillna(part["observed_at"].iloc[0]))
        return chosen.drop(columns="at")

    def state(self) -> tuple:
        return self.seen, self.wanted_until, self.emitted, [tuple(k) for k in self.kept]


def _make_stateful(q: LogQuery):
    def step(key, pdfs: Iterator[pd.DataFrame], state):
        (path,) = key
        file = _FileSoFar()
        if state.exists:
            seen, until, emitted, kept = state.get
            file = _FileSoFar(seen, until, emitted, [k if isinstance(k, dict) else k.asDict() for k in (kept if kept is not None else [])])
        frames = [p for p in pdfs if len(p)]
        if not frames:
            return
        rows = pd.concat(frames)
        rows = rows.assign(_line=rows["kind"] == "line").sort_values(["gen", "offset", "_line"], ignore_index=True)
        out = []
        # parts between markers
        for _, part in rows.groupby((~rows["_line"]).cumsum(), sort=True):
            if not part["_line"].iloc[0]:
                head = part.iloc[0]
                if head["kind"] == "rotated":
                    file = _FileSoFar()
                notice = ROTATED_NOTICE if head["kind"] == "rotated" else TRUNCATED_NOTICE
                out.append(part.iloc[:1][["gen", "offset", "observed_at"]].assign(line=notice))
                part = part.iloc[1:]
            if len(part):
                out.append(file.add(part, q))
        state.update(file.state())
        out = [x for x in out if len(x)]
        if not out:
            return
        shown = pd.concat(out, ignore_index=True)
        shown = _collapsed(shown) if q.dedup else shown
        yield pd.DataFrame({
            "path": [path] * len(shown), "gen": shown["gen"].astype("int64").to_numpy(), "offset": shown["offset"].astype("int64").to_numpy(),
            "seq": np.arange(len(shown)), "line": shown["line"].to_numpy(), "observed_at": pd.to_datetime(shown["observed_at"]).to_numpy(),
        })

    return step


def follow_context(stream: DataFrame, q: LogQuery) -> DataFrame:
    """The stream-side search with context, per file state.

    Patterns run before the group, by the same engine and dialect as in T1:
    noise leaves there, and the group gets flags and positions.  A group is
    one file's rows of one micro-batch -- bounded by the source's per-file
    admission (``maxBytesPerFile``) -- so no group grows with the data.
    ``since`` is the caller's filter on the stream (``follow`` applies it).
    """
    pattern = rx.severity_pattern(q.pattern) if q.pattern else None
    line = F.col("line")
    hit = F.coalesce(rx.match(line, pattern, q.ignore_case), F.lit(False))
    flagged = stream.filter(F.col("kind").isin("rotated", "truncated") | (F.col("kind") == "line") & ~rx.ignored(line, q.ignore)).withColumn("is_match", hit)
    return flagged.groupBy("path").applyInPandasWithState(
        _make_stateful(q), OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


# ---- T2 as DataFrame operations -------------------------------------------------------------

# Bytes of a file whose lines one task numbers.
CHUNK_BYTES = 4 << 20
# Rows of one per file that are broadcast; beyond that they are joined by shuffle.
TOLD_FILES = 1 << 18
CONTEXT_SCHEMA = (
    "path string, seen long, wanted_until long, emitted long, "
    "kept array<struct<at:long,gen:long,offset:long,line:string,observed_at:timestamp>>"
)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(TOLD_FILES + 1).count() <= TOLD_FILES else df


def context_batch(rows: DataFrame, state: DataFrame, q: LogQuery, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """T2/T3/T4 on one micro-batch: its output rows and the next state.

    ``state`` has one row a file (``CONTEXT_SCHEMA``).  Positions count the
    lines that noise filters let through since the file (re)started; ``seg``
    tells the parts of a batch that rotations separate, 0 going on from the
    state.  Matches name the positions they select; a semi join on (path,
    seg, position) picks the lines, those kept from earlier batches included.
    A line is shown if it is selected, or within the context still open, and
    lies after the last line shown.
    """
    pattern = rx.severity_pattern(q.pattern) if q.pattern else None
    line = F.col("line")
    hit = F.coalesce(rx.match(line, pattern, q.ignore_case), F.lit(False))
    marked = rows.filter(F.col("kind").isin("rotated", "truncated"))
    turns = rows.filter(F.col("kind") == "rotated").groupBy("path").agg(F.collect_set("gen").alias("turns"))
    known = state.select("path", "seen", "wanted_until", "emitted")
    of_file = _small(known.join(turns, "path", "full_outer"))
    kept = rows.filter((F.col("kind") == "line") & ~rx.ignored(line, q.ignore)).select("path", "gen", "offset", "line", "observed_at", hit.alias("is_match"))
    seg = F.coalesce(F.size(F.filter("turns", lambda g: g <= F.col("gen"))), F.lit(0))
    kept = kept.join(of_file, "path", "left").withColumn("seg", F.when(F.col("turns").isNull(), 0).otherwise(seg))
    carried = lambda c: F.when(F.col("seg") == 0, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long")
    kept = kept.withColumns({c: carried(c) for c in ("seen", "wanted_until", "emitted")}).drop("turns")
    place = F.struct("gen", line_bucket("offset", chunk_bytes).cast("long").alias("chunk"))
    new = ordinal(kept, ["path", "seg"], ["gen", "offset"], place, "at").withColumn("at", F.col("at") + F.col("seen") + 1)

    old = state.select("path", "seen", "wanted_until", "emitted", F.explode("kept").alias("k")).select(
        "path", "k.gen", "k.offset", "k.line", "k.observed_at", F.lit(False).alias("is_match"), F.lit(0).alias("seg"), "seen", "wanted_until", "emitted", "k.at")
    lines = new.unionByName(old)
    if q.has_pattern:
        wanted = new.filter("is_match").select("path", "seg", F.explode(F.sequence(F.col("at") - q.before, F.col("at") + q.after)).alias("at")).distinct()
        lines = lines.join(wanted.withColumn("_w", F.lit(True)), ["path", "seg", "at"], "left").filter(
            F.col("_w").isNotNull() | (F.col("at") <= F.col("wanted_until"))).drop("_w")
    chosen = lines.filter(F.col("at") > F.col("emitted"))

    notice = F.when(F.col("kind") == "rotated", ROTATED_NOTICE).otherwise(TRUNCATED_NOTICE)
    notices = marked.select("path", "gen", "offset", notice.alias("line"), "observed_at")
    shown = chosen.select("path", "gen", "offset", "line", "observed_at").unionByName(notices)
    if q.dedup:
        shown = _runs(shown, chunk_bytes)
    shown = shown.select("path", "gen", "offset", F.lit(0).cast("long").alias("seq"), "line", "observed_at")

    # the next state: of the last segment of every file of the batch; others keep theirs
    last = rows.filter(F.col("kind") != "gone").select("path").distinct().join(of_file, "path", "left").select(
        "path", F.coalesce(F.size("turns"), F.lit(0)).alias("seg"), "turns", "seen", "wanted_until", "emitted")
    last = last.withColumn("seg", F.when(F.col("turns").isNull(), 0).otherwise(F.col("seg"))).drop("turns")
    last = last.withColumns({c: carried(c) for c in ("seen", "wanted_until", "emitted")})
    ends = new.groupBy("path", "seg").agg(F.max("at").alias("_seen"), (F.max(F.when(F.col("is_match") & F.lit(q.has_pattern), F.col("at"))) + q.after).alias("_until"))
    shown_to = chosen.groupBy("path", "seg").agg(F.max("at").alias("_emitted"))
    newest = Window.partitionBy("path", "seg").orderBy(F.col("at").desc())
    all_lines = new.select("path", "seg", "at", "gen", "offset", "line", "observed_at").unionByName(old.select("path", "seg", "at", "gen", "offset", "line", "observed_at"))
    tails = all_lines.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= q.before).groupBy("path", "seg").agg(
        F.array_sort(F.collect_list(F.struct("at", "gen", "offset", "line", "observed_at"))).alias("kept"))
    after = last.join(ends, ["path", "seg"], "left").join(shown_to, ["path", "seg"], "left").join(tails, ["path", "seg"], "left").select(
        "path", F.coalesce("_seen", "seen").alias("seen"), F.coalesce("_until", "wanted_until").alias("wanted_until"),
        F.coalesce("_emitted", "emitted").alias("emitted"), F.coalesce("kept", F.array().cast(tails.schema["kept"].dataType)).alias("kept"))
    untouched = state.join(rows.select("path").distinct(), "path", "left_anti")
    return shown, after.unionByName(untouched)


def _runs(shown: DataFrame, chunk_bytes: int) -> DataFrame:
    """Consecutive equal lines of one batch -> ``line  × n`` at the first one's place."""
    place = F.struct("gen", line_bucket("offset", chunk_bytes).cast("long").alias("chunk"))
    rows = ordinal(shown, ["path"], ["gen", "offset"], place, "line_no")
    runs = L.dedup(rows.select("path", "line_no", F.lit(1).alias("sub"), "line", F.lit(False).alias("is_match"), F.lit(False).alias("is_gap")))
    return rows.drop("line").join(runs.select("path", "line_no", "line"), ["path", "line_no"]).drop("line_no")


def context_sink(spark: SparkSession, state_dir: str, q: LogQuery, then, chunk_bytes: int = CHUNK_BYTES):
    """T2 as a ``foreachBatch`` function: ``context_batch`` with the state of
    the batch before, then ``then(output rows, batch id)``.  The micro-batch
    is read once, into a table of the shared state folder."""
    root = os.path.join(state_dir, "context")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        at = os.path.join(state_dir, "rows", f"v={batch_id % 2}")  # two in turn: the earlier one is done with
        batch.write.mode("overwrite").parquet(at)
        rows = spark.read.schema(batch.schema).parquet(at)
        shown, after = context_batch(rows, read_version(spark, root, batch_id - 1, CONTEXT_SCHEMA), q, chunk_bytes)
        after.write.mode("overwrite").parquet(os.path.join(root, f"v={batch_id}"))
        then(shown, batch_id)

    return on_batch


# ---- T7: fair flush ----------------------------------------------------------------------------

PENDING_SCHEMA = "path string, b long, gen long, offset long, seq long, line string"


def read_version(spark: SparkSession, root: str, version: int, schema: str) -> DataFrame:
    """State table written by batch ``version``; empty only before the first batch.

    A version that can't be read fails the batch: taking it for empty would
    lose state silently.
    """
    if version < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(os.path.join(root, f"v={version}"))


def fair_flush(
    spark: SparkSession,
    state_dir: str,
    out_dir: str,
    per_source: int = MAX_BATCH_LINES,
    max_pending: int = MAX_BUFFER_LINES,
):
    """A ``foreachBatch`` function emitting at most ``per_source`` lines
    per source per batch, keeping at most ``max_pending`` newest lines of
    each source pending and announcing how many older ones were dropped.

    Input rows: ``path, gen, offset, seq, line, observed_at`` (output of
    ``follow_filter``/``follow_context``/``context_batch``).  Output:
    ``out_dir/batch_id=<i>`` with ``path, k, line, suffix`` (``"<n> buffered"``
    where lines stay pending).  Batch ``i`` reads the pending table of batch
    ``i-1`` and writes its own, so a replayed batch gives the same result.

    The newest ``max_pending`` lines of a source are found by a rank limit
    before the shuffle (each task sends that many at most), its number of
    lines by a partial count: a hot source is no large task.
    """
    pend_root = os.path.join(state_dir, "pending")

    def flush(batch: DataFrame, batch_id: int) -> None:
        new = batch.select("path", F.lit(batch_id).cast("long").alias("b"), "gen", "offset", "seq", "line")
        # read once: the batch's own rows go into the next version first
        at = os.path.join(state_dir, "arrived", f"v={batch_id % 2}")
        new.write.mode("overwrite").parquet(at)
        rows = read_version(spark, pend_root, batch_id - 1, PENDING_SCHEMA).unionByName(spark.read.schema(PENDING_SCHEMA).parquet(at))
        out, rest = fair_batch(rows, per_source, max_pending)
        out.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch_id={batch_id}"))
        rest.write.mode("overwrite").parquet(os.path.join(pend_root, f"v={batch_id}"))

    return flush


def fair_batch(rows: DataFrame, per_source: int, max_pending: int) -> tuple[DataFrame, DataFrame]:
    """Of the pending lines: what is shown now (``path, k, line, suffix``), and what stays."""
    order = ("b", "gen", "offset", "seq")
    newest = Window.partitionBy("path").orderBy(*(F.col(c).desc() for c in order))
    kept = rows.withColumn("_new_rank", F.row_number().over(newest)).filter(F.col("_new_rank") <= max_pending)
    totals = rows.groupBy("path").agg(F.count(F.lit(1)).alias("_total"))
    kept = kept.withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy(*order))).join(totals, "path")
    out = kept.filter(F.col("_k") <= per_source)
    dropped = F.col("_total") - F.lit(max_pending)
    buffered = F.least("_total", F.lit(max_pending)) - F.lit(per_source)
    out = out.withColumn("suffix", F.when(buffered > 0, F.concat(buffered.cast("string"), F.lit(BUFFERED_SUFFIX))))
    notices = out.filter((F.col("_k") == 1) & (dropped > 0)).select(
        "path", F.lit(0).cast("long").alias("k"), F.concat(F.lit(DROPPED_NOTICE[0]), dropped.cast("string"), F.lit(DROPPED_NOTICE[1])).alias("line"), "suffix")
    shown = out.select("path", F.col("_k").cast("long").alias("k"), "line", "suffix").unionByName(notices)
    return shown, kept.filter(F.col("_k") > per_source).select("path", *order, "line")


def _recent(stream: DataFrame, q: LogQuery, year=None) -> DataFrame:
    """Markers and the lines that ``since`` lets through: one rule with and without context."""
    if q.since is None:
        return stream
    return stream.filter((F.col("kind") != "line") | L.since_ok(F.col("line"), F.col("observed_at"), q.since, year))


def search_then_follow(spark: SparkSession, path: str, q: LogQuery, year=None, **options) -> DataFrame:
    """Search the files and keep following them as ONE stream.

    The stream starts at byte 0 of every file (``startingLines=-1``), so the
    search part and the follow part are the same query and no line written
    in between is lost; new files are still picked up (T10) and ``since``
    stays applied to every line.
    """
    from loglens.sources.tail import tail_stream

    opts = {"startingLines": -1, **options}
    src = tail_stream(spark, path, **opts)
    if q.before or q.after or q.dedup:
        return follow_context(_recent(src, q, year), q)
    return follow_filter(src, q, year)


def follow(
    spark: SparkSession,
    path: str,
    q: LogQuery,
    out_dir: str,
    state_dir: str | None = None,
    trigger: str = "500 milliseconds",
    **source_options,
):
    """Section 3.2: ``logtail`` -> filter (T1) or context (T2, ``context_sink``) ->
    fair flush (T7) into ``out_dir``.  Checkpoint and pending state live
    under ``state_dir`` (default: a fresh folder in the session's shared
    ``spark.checkpoint.dir``).  Returns the running ``StreamingQuery``.
    """
    from loglens.session import new_state_dir
    from loglens.sources.tail import tail_stream

    state_dir = state_dir or new_state_dir(spark, "follow")
    src = tail_stream(spark, path, **source_options)
    sink = fair_flush(spark, state_dir, out_dir)
    if q.before or q.after or q.dedup:
        rows, sink = _recent(src, q), context_sink(spark, state_dir, q, sink)
    else:
        rows = follow_filter(src, q).withColumn("seq", F.lit(0).cast("long"))
    return (rows.writeStream.foreachBatch(sink)
            .option("checkpointLocation", os.path.join(state_dir, "checkpoint"))
            .trigger(processingTime=trigger).start())
