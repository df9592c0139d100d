"""Sharding by sampled splitters.

Records are ordered by (hash of the text, key), which spreads any hot source
over the whole order, and lets equal texts lie side by side without being one
indivisible group.  A size-weighted sample of that order gives quantile
boundaries of many small ranges; every record goes to its range; a range that
came out overfull is subdivided at a second, denser sample of its own.  Exact
sums by range then place each record's bytes in the global order, and the
global order is cut into shards of near equal bytes.

No task sorts more than one range, no row's text is moved, and what the
driver holds (splitters, one sum per range) has a bound that doesn't depend
on the input.

Law ``bytes``: a record goes to the shard in which its first byte falls when
all bytes, in order, are cut into equal shares, so shards differ by less than
two records.

Edge cases: a null text counts as empty (size 16, crc 0); equal rows keep
the order of their slots among themselves open but take the same places; null
keys come first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import stored, text_or_empty

SHARDS = 40
# Ranges for each shard, and sampled rows for each range.  At this many a range
# is overfull by a third only once in some thousand times; it is split anyway.
RANGES_A_SHARD = 8
SAMPLES_A_RANGE = 32
# Bytes beyond which a range is cut by a sample of its own.
RANGE_BYTES = 1 << 34
OVERHEAD = 16


def _sample(records: DataFrame, total: int, wanted: int) -> list[tuple]:
    """About ``wanted`` (at most some times that) places of the order, drawn with chance by size."""
    # the draw hangs on the key alone: a task that runs again draws the same rows
    chance = F.pmod(F.xxhash64("_h", "_k", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    drawn = records.where(chance * total < F.col("size") * wanted).select("_h", "_k").limit(20 * wanted)
    return sorted((tuple(r) for r in drawn.collect()), key=_order)


def _order(place: tuple) -> tuple:
    return place[0], place[1] is not None, place[1] if place[1] is not None else 0


def _quantiles(places: list[tuple], parts: int) -> list[tuple]:
    cuts = [places[len(places) * i // parts] for i in range(1, parts)] if places else []
    return sorted(set(cuts), key=_order)


def _ranged(records: DataFrame, cuts: list[tuple]) -> DataFrame:
    """The number of cuts at or before each row, by binary search among constants."""
    if not cuts:
        return records.withColumn("_range", F.lit(0))
    hashes, keys = F.lit([h for h, _ in cuts]).cast("array<bigint>"), F.array(*(F.lit(k).cast("long") for _, k in cuts))
    steps = F.lit([1 << i for i in reversed(range(len(cuts).bit_length()))])

    def step(found: Column, width: Column) -> Column:
        h, k = F.get(hashes, found + width - 1), F.get(keys, found + width - 1)  # null beyond the last cut
        passed = (h < F.col("_h")) | ((h == F.col("_h")) & (k.isNull() | F.coalesce(k <= F.col("_k"), F.lit(False))))
        return F.when(passed, found + width).otherwise(found)

    return records.withColumn("_range", F.aggregate(steps, F.lit(0), step))


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """key, size, text_crc32, shard and slot of every row."""
    records = docs.select(
        F.col(key).cast("long").alias("_k"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text)).alias("_h"),
    )
    records = stored(records, "shard-records")  # four numbers a row, so the texts are read once
    total = records.agg(F.sum("size")).first()[0] or 0
    ranges = shards * RANGES_A_SHARD
    cuts = _quantiles(_sample(records, total, ranges * SAMPLES_A_RANGE), ranges)
    sums = _sums(_ranged(records, cuts))
    while overfull := [r for r, (size, n) in sums.items() if size > range_bytes and n > 1]:
        more = []
        for r in overfull:
            inside = _ranged(records, cuts).where(F.col("_range") == r).drop("_range")
            parts = 2 + sums[r][0] // range_bytes
            more += _quantiles(_sample(inside, sums[r][0], parts * SAMPLES_A_RANGE), parts)
        finer = sorted({*cuts, *more}, key=_order)
        if finer == cuts:  # equal rows alone, or none drawn: nothing to cut at
            break
        cuts = finer
        sums = _sums(_ranged(records, cuts))
    bytes_before, rows_before, b, n = {}, {}, 0, 0
    for r in sorted(sums):
        bytes_before[r], rows_before[r] = b, n
        b, n = b + sums[r][0], n + sums[r][1]

    def start(of: dict[int, int]) -> Column:
        return F.element_at(F.lit([of.get(r, 0) for r in range(len(cuts) + 1)]).cast("array<bigint>"), F.col("_range") + 1)

    in_range = Window.partitionBy("_range").orderBy(F.col("_h"), F.col("_k").asc_nulls_first())
    placed = _ranged(records, cuts).withColumns(
        {
            "_before": start(bytes_before) + F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
            "_rank": start(rows_before) + F.row_number().over(in_range) - 1,
        }
    )
    placed = placed.withColumn("shard", F.expr(f"CAST((_before * {shards}) DIV {max(total, 1)} AS int)"))
    first = placed.groupBy(F.col("shard").alias("_s")).agg(F.min("_rank").alias("_first"))  # one row a shard
    return placed.join(F.broadcast(first), F.col("shard") == F.col("_s")).select(
        F.col("_k").alias(key), "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).cast("long").alias("slot")
    )


def _sums(ranged: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each range: as many rows as there are ranges."""
    found = ranged.groupBy("_range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {r["_range"]: (r["b"], r["n"]) for r in found}
