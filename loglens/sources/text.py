"""Log text sources.

``read_lines`` turns plain and gzip log files into a ``lines`` table with
Spark's text source (split per 128 MB for plain files, one task per gzip
file, codec chosen by suffix).  ``with_line_no`` adds the per-file line
ordinal without sorting a file in one task (``method="scalable"``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglens.operators.ordered import DEFAULT_BUCKET_LINES


def _plain_path(c: Column) -> Column:
    """The path without scheme and without the URI's escapes, as file listings have it."""
    plain = F.regexp_replace(c, r"^file:(//)?", "")
    return F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))


def read_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    path_regex: str | None = None,
    modified_after: str | None = None,
    recursive: bool = False,
    skip_bad_files: bool = False,
) -> DataFrame:
    """``path, file_mtime, line, _block`` for every line of the files.

    Lines end at ``\\n`` only; up to two trailing ``\\r`` are dropped (F8).
    Path and age predicates apply to ``_metadata`` right at the scan, so
    they prune files before any row is read.  A file that cannot be read
    (corrupt gzip, deleted meanwhile) fails the job, unless
    ``skip_bad_files`` is set; ``skipped_files`` then tells which files are
    missing from the result.  A gzip broken half-way still yields the lines
    before the damage.
    """
    r = spark.read.option("lineSep", "\n")
    if skip_bad_files:
        r = r.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if modified_after:
        r = r.option("modifiedAfter", modified_after)
    df = r.text(list(paths) if not isinstance(paths, str) else paths)
    if path_regex:
        df = df.filter(F.col("_metadata.file_path").rlike(path_regex))
    return df.select(
        _plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_modification_time").alias("file_mtime"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.regexp_replace(F.col("value"), r"\r{1,2}\z", "").alias("line"),
    )


def skipped_files(spark: SparkSession, roots: str | Sequence[str]) -> DataFrame:
    """Files below the roots with bytes of which ``skip_bad_files`` gives no line: ``path, size``."""
    from loglens.sources.catalog import list_files

    roots = [roots] if isinstance(roots, str) else list(roots)
    read = read_lines(spark, roots, recursive=True, skip_bad_files=True).select("path").distinct()
    return list_files(spark, roots).where(F.col("size") > 0).join(read, "path", "left_anti").select("path", "size")


def with_line_no(df: DataFrame, method: str = "scalable") -> DataFrame:
    """S3: 0-based line ordinal within each file.

    * ``scalable``: rows of one split are contiguous in
      ``monotonically_increasing_id``; a per-split table (``min`` id, row
      count) gets prefix sums over the splits of a file and is joined back.
      No per-file sort; AQE picks the join by the split table's real size.
    * ``simple``: ``row_number`` over the file ordered by split and id (one
      sort per file).

    Both branches read the same scan, so ids agree.
    """
    t = df.withColumn("_mid", F.monotonically_increasing_id())
    if method == "simple":
        w = Window.partitionBy("path").orderBy("_block", "_mid")
        return t.withColumn("line_no", (F.row_number().over(w) - 1).cast("long")).drop("_mid", "_block")
    splits = t.groupBy("path", "_block").agg(F.min("_mid").alias("_min"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_base", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    res = t.join(splits, ["path", "_block"])
    return res.withColumn("line_no", (F.col("_base") + F.col("_mid") - F.col("_min")).cast("long")).drop(
        "_mid", "_min", "_base", "_block"
    )


def _windowed(lines: DataFrame, n: int, width: int, from_end: bool) -> tuple[DataFrame, DataFrame]:
    """Lines of the buckets that lie wholly inside the ``n`` bytes, and those
    of the bucket that the edge runs through, with ``_cum``: bytes up to and
    including the line, counted from the window's outer end.

    Sums of one number per ``(path, bucket)``, scanned by path, drop the
    buckets outside before any line is put in order; a window runs over the
    edge bucket of each file alone.
    """
    size = F.octet_length("line") + 1
    t = lines.withColumn("_bk", F.floor(F.col("line_no") / F.lit(int(width))))
    sizes = t.groupBy("path", "_bk").agg(F.sum(size).alias("_size"))
    order = F.col("_bk").desc() if from_end else F.col("_bk")
    outer = F.sum("_size").over(Window.partitionBy("path").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("_outer", F.coalesce(outer, F.lit(0))).filter(F.col("_outer") < n)
    t = t.join(sizes, ["path", "_bk"])
    whole = F.col("_outer") + F.col("_size") <= n
    inside = t.filter(whole).drop("_bk", "_size", "_outer")
    w = Window.partitionBy("path", "_bk").orderBy(F.col("line_no").desc() if from_end else F.col("line_no"))
    cum = F.col("_outer") + F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    edge = t.filter(~whole).withColumn("_cum", cum).filter(F.col("_cum") - size < n)
    return inside, edge.drop("_bk", "_size", "_outer")


def last_bytes(lines: DataFrame, n: int, bucket_width: int = DEFAULT_BUCKET_LINES) -> DataFrame:
    """The lines inside the last ``n`` bytes of each file (each line
    counted with its newline); the first line of the window is cut to the
    part inside it (cut by characters)."""
    inside, edge = _windowed(lines, n, bucket_width, True)
    cut = F.expr(f"right(line, CAST({n} - (_cum - octet_length(line) - 1) - 1 AS INT))")
    return inside.unionByName(edge.withColumn("line", F.when(F.col("_cum") <= n, F.col("line")).otherwise(cut)).drop("_cum"))


def first_bytes(lines: DataFrame, n: int, bucket_width: int = DEFAULT_BUCKET_LINES) -> DataFrame:
    """The lines inside the first ``n`` bytes (gzip read window); the last
    line is cut to the part inside it."""
    inside, edge = _windowed(lines, n, bucket_width, False)
    cut = F.expr(f"left(line, CAST({n} - (_cum - octet_length(line) - 1) AS INT))")
    return inside.unionByName(edge.withColumn("line", F.when(F.col("_cum") <= n, F.col("line")).otherwise(cut)).drop("_cum"))


def scan(spark: SparkSession, paths, method: str = "scalable", **kw) -> DataFrame:
    """S1-S3 together: ``path, file_mtime, line_no, line``."""
    return with_line_no(read_lines(spark, paths, **kw), method).select("path", "file_mtime", "line_no", "line")
