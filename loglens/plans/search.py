"""Composed plans: search (section 3.1), snapshot (W8) and JSON output.

One lazy plan per call; the driver only builds it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglens.config import DEFAULT_MAX_FILES, LogQuery
from loglens.operators import lines as L
from loglens.operators import report as R
from loglens.operators.ordered import DEFAULT_BUCKET_LINES
from loglens.operators.targets import resolve_targets


def search(
    lines: DataFrame,
    q: LogQuery,
    time_col: str = "file_mtime",
    year=None,
    plan: str = "auto",
    bucket_width: int = DEFAULT_BUCKET_LINES,
) -> DataFrame:
    """Search a lines table; rows ``path, bk, line_no, sub, line, is_match, is_gap``."""
    return L.select_lines(lines, q, time_col, year, plan, True, bucket_width)


def search_blocks(lines: DataFrame, q: LogQuery, now, time_col: str = "file_mtime", year=None,
                  plan: str = "auto", bucket_width: int = DEFAULT_BUCKET_LINES) -> DataFrame:
    """Search and assemble one block per source (A5) with ``N matches``."""
    rows = search(lines, q, time_col, year, plan, bucket_width)
    return R.blocks(rows, now, with_counts=q.has_pattern or q.since is not None)


def snapshot(lines: DataFrame, n: int, q: LogQuery, time_col: str = "file_mtime", year=None,
             bucket_width: int = DEFAULT_BUCKET_LINES) -> DataFrame:
    """Last 4N lines -> search -> last N output lines when there is no
    pattern -> dedup.

    After the first step every source holds at most 4N rows, so the last-N
    cut is a window over those few rows.
    """
    recent = L.tail_lines(lines, max(4 * n, n))
    rows = L.select_lines(recent, LogQuery(q.pattern, q.ignore_case, q.ignore, q.since, q.before, q.after, False),
                          time_col, year, plan="auto", bucket_width=bucket_width)
    if not q.has_pattern:
        w = Window.partitionBy("path").orderBy(F.col("line_no").desc(), F.col("sub").desc())
        rows = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    return L.dedup(rows, bucket_width) if q.dedup else rows


def search_files(
    spark,
    paths,
    q: LogQuery,
    now,
    year=None,
    ordinal: str = "scalable",
    bucket_width: int = DEFAULT_BUCKET_LINES,
    window_bytes: int | None = None,
) -> DataFrame:
    """Section 3.1 end to end on real files: scan (plain and gzip) -> line
    ordinals -> optional read window -> search -> one JSON-ready block per
    source.

    A pattern without a time bound means the last 24 hours before ``now``.
    ``paths`` are files, directories or globs.  ``window_bytes`` applies the
    original tool's read window (last N bytes of plain files, first N bytes
    of decompressed gzip files); off by default.
    """
    from loglens.sources.text import read_lines

    return _search_read(read_lines(spark, paths), q, now, year, ordinal, bucket_width, window_bytes)


def _search_read(lines: DataFrame, q: LogQuery, now, year, ordinal: str, bucket_width: int, window_bytes: int | None) -> DataFrame:
    from loglens.sources.text import first_bytes, last_bytes, with_line_no

    q = q.with_defaults(dt.datetime.fromisoformat(now) if isinstance(now, str) else now)

    lines = with_line_no(lines, ordinal).select("path", "file_mtime", "line_no", "line")
    if window_bytes:
        gz = F.lower(F.col("path")).endswith(".gz")
        lines = last_bytes(lines.filter(~gz), window_bytes).unionByName(first_bytes(lines.filter(gz), window_bytes))
    rows = search(lines, q, "file_mtime", year, "auto", bucket_width)
    return R.blocks(rows, now, with_counts=q.has_pattern or q.since is not None)


# Files that are named to the scan one by one; more are found below the roots by a join.
LISTED_FILES = 10_000


def search_targets(
    spark,
    targets,
    roots,
    q: LogQuery,
    now,
    groups=None,
    excludes=(),
    current: bool = False,
    proc_fds: DataFrame | None = None,
    listeners: DataFrame | None = None,
    max_files: int = DEFAULT_MAX_FILES,
    year=None,
    bucket_width: int = DEFAULT_BUCKET_LINES,
    window_bytes: int | None = None,
) -> DataFrame:
    """Section 3.1 from the words a user types: targets -> files -> search.

    Group names, ``@process``, ``:port``, paths and names resolve to files
    below ``roots`` (rotated siblings included unless ``current``), their
    lines are searched, and the blocks come oldest file first (by path with
    ``current``), each file's in order.
    """
    from loglens.sources.catalog import list_files
    from loglens.sources.text import read_lines

    files = list_files(spark, roots)
    chosen = resolve_targets(files, targets, roots, groups, proc_fds, listeners, excludes, not current, max_files)
    known = [r["path"] for r in chosen.limit(LISTED_FILES + 1).collect()]
    if len(known) > LISTED_FILES:
        lines = read_lines(spark, roots, recursive=True).join(chosen, "path", "left_semi")
    elif known:
        lines = read_lines(spark, known)
    else:
        lines = read_lines(spark, roots, recursive=True).limit(0)
    found = _search_read(lines, q, now, year, "scalable", bucket_width, window_bytes)
    order = ["path", "part"] if current else ["mtime", "path", "part"]
    return found.join(files.select("path", "mtime"), "path").orderBy(*order).drop("mtime")
