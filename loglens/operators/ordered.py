"""Order-within-a-key primitives that do not put one key into one task.

A plain ``Window.partitionBy(path)`` sorts a whole file in one task: a file
holding a third of the data would then be one task.  The primitives here
split every key into *buckets* -- ranges of the order that are monotone and
bounded in size -- and combine a window inside ``(key, bucket)`` with a small
per-bucket table (one row per bucket) whose prefix sums give each bucket
its offset.  The per-bucket table has ``#rows / bucket_size`` rows, so it is
small even for very large keys.

* For data ordered by a dense ordinal (``line_no``), ``line_bucket`` is a
  fixed-width range: every bucket holds at most ``width`` rows.
* For any other order, ``quantile_bucket`` takes global quantiles of a
  numeric order expression (one approximate-percentile job, a bounded list
  of numbers on the driver): any bucket then holds about ``1/n`` of all rows,
  whatever the key distribution is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET_LINES = 1 << 20  # rows per line-number bucket


def line_bucket(pos: Column | str = "line_no", width: int = DEFAULT_BUCKET_LINES) -> Column:
    """Fixed-width bucket of a dense ordinal."""
    c = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(c / F.lit(int(width)))


_BOUNDS: dict[str, list] = {}
_BOUNDS_MAX = 64


def quantile_bucket(df: DataFrame, x: Column, n: int = 256, accuracy: int = 10_000,
                    cache_key: str | None = None) -> Column:
    """Bucket index from global quantiles of the numeric expression ``x``.

    Any non-decreasing bucketing gives the same ordinals -- the bounds only
    decide how evenly the work spreads -- so bounds computed once for an
    input (``cache_key``) can be reused by later plans over it.
    """
    bounds = _BOUNDS.get(cache_key) if cache_key else None
    if bounds is None:
        qs = [i / n for i in range(1, n)]
        row = df.select(F.percentile_approx(x, qs, accuracy).alias("b")).first()
        bounds = sorted(set(b for b in (row["b"] or []) if b is not None))
        if cache_key:
            if len(_BOUNDS) >= _BOUNDS_MAX:
                _BOUNDS.pop(next(iter(_BOUNDS)))
            _BOUNDS[cache_key] = bounds
    return bucket_of(x, bounds)


def bucket_of(x: Column, bounds: list) -> Column:
    """Number of ``bounds`` (sorted) that are <= ``x``: a balanced tree of
    comparisons, ``log2(len(bounds))`` per row, no lambda."""

    def tree(lo: int, hi: int) -> Column:
        # answer lies in [lo, hi]; bounds[lo:hi] decide it
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(x >= F.lit(bounds[mid - 1]), tree(mid, hi)).otherwise(tree(lo, mid - 1))

    return tree(0, len(bounds)) if bounds else F.lit(0)


def _keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def running_count(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    out: str,
    flag: Column | None = None,
    value: Column | None = None,
) -> DataFrame:
    """Inclusive running count of rows (or of ``flag`` rows, or running sum
    of ``value``) within ``keys``.

    ``bucket`` must be non-decreasing along ``order`` within a key.  The
    result has one extra column ``out``; no row is dropped.
    """
    if value is not None:
        f = value.cast("long")
    else:
        f = F.lit(1) if flag is None else F.when(flag, F.lit(1)).otherwise(F.lit(0))
    t = df.withColumn("_bk", bucket).withColumn("_f", f)
    w = Window.partitionBy(*_keys(keys), F.col("_bk")).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_local", F.sum("_f").over(w))
    sizes = t.groupBy(*keys, "_bk").agg(F.sum("_f").alias("_n"))
    wb = Window.partitionBy(*_keys(keys)).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(wb), F.lit(0))).drop("_n")
    res = t.join(base, [*keys, "_bk"], "inner")
    return res.withColumn(out, (F.col("_base") + F.col("_local")).cast("long")).drop("_bk", "_f", "_local", "_base")


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    out: str = "ordinal",
) -> DataFrame:
    """0-based row number within ``keys`` along ``order`` (skew-safe ``row_number``)."""
    t = running_count(df, keys, order, bucket, "_rc")
    return t.withColumn(out, F.col("_rc") - 1).drop("_rc")


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    cols: Sequence[str],
    bucket: Column,
    prefix: str = "prev_",
) -> DataFrame:
    """Values of ``pos`` and ``cols`` of the previous row within ``keys``.

    ``pos`` is a unique, increasing position (for example ``line_no`` or an
    output ordinal).  Inside a bucket this is ``lag``; the first row of a
    bucket takes the last row of the nearest earlier non-empty bucket from a
    per-bucket table.  Columns come out as ``prefix + name``.
    """
    t = df.withColumn("_bk", bucket)
    w = Window.partitionBy(*_keys(keys), F.col("_bk")).orderBy(F.col(pos))
    names = [pos, *cols]
    for c in names:
        t = t.withColumn(prefix + c, F.lag(F.col(c)).over(w))
    t = t.withColumn("_first", F.row_number().over(w) == 1)
    last = t.groupBy(*keys, "_bk").agg(F.max_by(F.struct(*[F.col(c) for c in names]), F.col(pos)).alias("_last"))
    wb = Window.partitionBy(*_keys(keys)).orderBy("_bk")
    carry = last.withColumn("_carry", F.lag("_last").over(wb)).drop("_last")
    res = t.join(carry, [*keys, "_bk"], "inner")
    for c in names:
        res = res.withColumn(
            prefix + c,
            F.when(F.col("_first"), F.col("_carry")[c]).otherwise(F.col(prefix + c)),
        )
    return res.drop("_bk", "_first", "_carry")
