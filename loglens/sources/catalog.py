"""S5 source: the ``files`` table of real directories.

``binaryFile`` lists the files (recursively, in parallel on the cluster for
large trees); selecting only ``path, modificationTime, length`` prunes the
``content`` column, so no file body is read.  ``modifiedAfter`` applies the
recency cutoff during listing.  The result feeds ``operators.files.catalog``
and the other file-set operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.functions.glob import check_root


def list_files(
    spark: SparkSession,
    roots: Sequence[str],
    modified_after: str | None = None,
    glob_filter: str | None = None,
) -> DataFrame:
    """``path, mtime, size`` of every regular file below ``roots``.

    Paths come back without the ``file:`` scheme; a root of ``/`` is refused.
    """
    for r in roots:
        check_root(r.rstrip("/") + "/*")
    out = None
    for r in roots:
        rd = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if modified_after:
            rd = rd.option("modifiedAfter", modified_after)
        if glob_filter:
            rd = rd.option("pathGlobFilter", glob_filter)
        df = rd.load(r).select(
            F.regexp_replace(F.col("path"), r"^file:(//)?", "").alias("path"),
            F.col("modificationTime").alias("mtime"),
            F.col("length").alias("size"),
        )
        out = df if out is None else out.unionByName(df)
    return out.dropDuplicates(["path"])
