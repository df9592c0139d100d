"""Benchmark decontamination by SimHash, as DataFrame expressions only.

1. A window can only be similar to an item if they share a shingle of
   ``SIZE`` words; the shared shingles of all texts give the windows, as long
   in words as the item and placed so that the shingle lies as in the item.
   Windows without any shared shingle have similarity 0 and need no fingerprint.
2. Windows and items get 64-bit SimHashes of their words.
3. Multi-index: a fingerprint is cut into ``BLOCKS`` blocks.  Two fingerprints
   within ``RADIUS`` differ by at most ``NEAR`` bits in some block, so items
   are listed under all values of each block within ``NEAR`` bits, windows are
   looked up by their own, and no pair within the radius is missed.
4. Pairs within the radius are verified by the exact weighted similarity of
   their shingles: the sum of the lesser counts over that of the greater.

Words are runs of letters and digits, in lower case.  Items with fewer than
``SIZE`` words have one shingle of them all.

Edge cases: null or empty texts and items without words match nothing; rows
with null ids are searched like others; repeated rows each get their matches;
repeated items count as one by id and text; an empty table on either side
gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import stored, text_or_empty

SIZE = 5
PERCENT = 80
BLOCKS = 6
# At a similarity of 0.8 of the shingles the words have a cosine of about 8/9 if the cut lies at an end: some 9.6 of 64
# bits differ, with a deviation of 2.9, so a radius of 11 would lose windows; 17 is 2.5 deviations off.
NEAR = 2
RADIUS = BLOCKS * (NEAR + 1) - 1
# Shingles and index rows of items that are broadcast (some 30 bytes each); beyond that they are joined by shuffle.
BROADCAST_ROWS = 1 << 20
EDGES = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
# Masks of each block that flip up to NEAR of its bits.
MASKS = [[sum(1 << i for i in flips) for near in range(NEAR + 1) for flips in combinations(range(b - a), near)] for a, b in zip(EDGES, EDGES[1:])]


def bare_words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ", -1), "")


def _shingles(words: str, size: int) -> str:
    """SQL: the hash of each run of size words (an array by place)."""
    return (
        f"CASE WHEN size({words}) >= {size} THEN transform(sequence(0, size({words}) - {size}), i -> xxhash64("
        + ", ".join(f"{words}[i + {j}]" if j else f"{words}[i]" for j in range(size))
        + ")) ELSE CAST(array() AS array<bigint>) END"
    )


def _fingerprint(words: str) -> str:
    """SQL: the SimHash of the words; 16 sums hold four 16-bit counters each."""
    ones = 0x0001000100010001
    start = ", ".join(f"0L AS s{r}" for r in range(16))
    step = ", ".join(f"a.s{r} + (shiftrightunsigned(h, {r}) & {ones}L) AS s{r}" for r in range(16))
    bits = " | ".join(
        f"IF(2 * (shiftrightunsigned(a.s{r}, {16 * j}) & 65535L) > size({words}), shiftleft(1L, {r + 16 * j}), 0L)" for r in range(16) for j in range(4)
    )
    return f"aggregate(transform({words}, w -> xxhash64(w)), struct({start}), (a, h) -> struct({step}), a -> {bits})"


def _numbered(shingles: str) -> str:
    """SQL: each shingle with the number of equal ones before it, so that sets tell counts."""
    return (
        f"CASE WHEN size(array_distinct({shingles})) = size({shingles}) THEN transform({shingles}, s -> xxhash64(s, 0))"
        f" ELSE transform({shingles}, (s, i) -> xxhash64(s, size(filter(slice({shingles}, 1, i), t -> t = s)))) END"
    )


def _blocks(fingerprint: str) -> list[str]:
    return [f"shiftrightunsigned({fingerprint}, {a}) & {(1 << (b - a)) - 1}L" for a, b in zip(EDGES, EDGES[1:])]


def _listed(items: DataFrame) -> DataFrame:
    """item, size, item_print, block and every value within NEAR bits of the block's own.

    The masks are one constant: an expression for each of some 400 values makes a method that the JVM never compiles.
    """
    own = F.array(*(F.struct(F.lit(b).alias("block"), F.expr(block).alias("own")) for b, block in enumerate(_blocks("print"))))
    masks = F.expr("array(" + ", ".join(f"array({', '.join(f'{m}L' for m in of)})" for of in MASKS) + ")")
    blocks = items.select("item", "size", F.col("print").alias("item_print"), F.inline(own))
    values = blocks.select("item", "size", "item_print", "block", "own", F.explode(masks[F.col("block")]).alias("mask"))
    return values.select("item", "size", "item_print", "block", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    rows = benchmark.select(F.col(item).alias("item"), bare_words(text_or_empty(text)).alias("words")).distinct().where(F.size("words") > 0)
    rows = rows.withColumn("n", F.size("words")).withColumn("size", F.least("n", F.lit(SIZE)))
    by_size = F.expr("CASE size " + " ".join(f"WHEN {s} THEN {_shingles('words', s)}" for s in range(1, SIZE + 1)) + " END")
    rows = rows.withColumn("shingles", by_size).withColumn("print", F.expr(_fingerprint("words")))
    return rows.withColumn("counted", F.expr(_numbered("shingles"))).drop("words")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """_k, _h (hash of the text), item, first (word), distance, shared and total of every window similar to an item."""
    items = stored(_items(benchmark, item, item_text), "items")
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # at most SIZE numbers
    rows = docs.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_h"), bare_words(text_or_empty(text)).alias("words"))
    grams = F.explode(F.array(*(F.struct(F.lit(s).alias("size"), F.expr(_shingles("words", s)).alias("h")) for s in sizes))) if sizes else None
    if grams is None:
        return rows.join(items, F.lit(False)).select("_k", "_h", "item", *(F.lit(0).alias(c) for c in ("first", "distance", "shared", "total")))
    found = rows.select("_k", "_h", grams.alias("g")) if len(sizes) > 1 else rows.select("_k", "_h", F.struct(F.lit(sizes[0]).alias("size"), F.expr(_shingles("words", sizes[0])).alias("h")).alias("g"))
    placed = found.select("_k", "_h", F.col("g.size").alias("size"), F.posexplode("g.h").alias("p", "h"))
    known = items.select("size", "n", F.posexplode("shingles").alias("q", "h")).select("size", "n", "q", "h").distinct()
    hits = placed.join(_small(known), ["size", "h"]).select("_k", "_h", "size", "n", F.greatest(F.col("p") - F.col("q"), F.lit(0)).alias("first"))
    windows = stored(hits.groupBy("_k", "_h").agg(F.collect_set(F.struct("first", "n", "size")).alias("windows")), "windows")
    of = windows.withColumnsRenamed({"_k": "k", "_h": "h"})
    cut = rows.join(of, rows["_k"].eqNullSafe(F.col("k")) & rows["_h"].eqNullSafe(F.col("h"))).select("_k", "_h", "words", F.explode("windows").alias("w"))
    cut = cut.select("_k", "_h", "w.*", F.expr("slice(words, w.first + 1, w.n)").alias("words")).distinct()
    by_size = F.expr("CASE size " + " ".join(f"WHEN {s} THEN {_shingles('words', s)}" for s in sizes) + " END")
    cut = cut.withColumn("shingles", by_size).withColumn("print", F.expr(_fingerprint("words")))
    cut = stored(cut.withColumn("counted", F.expr(_numbered("shingles"))).drop("words", "shingles"), "prints")
    return _verified(cut, items)


def _verified(windows: DataFrame, items: DataFrame) -> DataFrame:
    listed = _listed(items)
    own = F.array(*(F.struct(F.lit(b).alias("block"), F.expr(block).alias("value")) for b, block in enumerate(_blocks("print"))))
    probes = windows.select("_k", "_h", "first", "n", "size", "print", F.explode(own).alias("o")).select("_k", "_h", "first", "n", "size", "print", "o.*")
    near = probes.join(_small(listed), ["block", "value", "size"]).withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))))
    near = near.where(F.col("distance") <= RADIUS).select("_k", "_h", "first", "n", "size", "item", "distance").distinct()
    theirs = items.select("item", "size", F.col("counted").alias("theirs")).distinct()
    pairs = near.join(theirs, ["item", "size"]).withColumnsRenamed({"_k": "k", "_h": "h"})
    same = F.col("_k").eqNullSafe(F.col("k")) & F.col("_h").eqNullSafe(F.col("h"))
    pairs = pairs.join(windows.withColumnsRenamed({"first": "f2", "n": "n2", "size": "s2"}), same & (F.col("first") == F.col("f2")) & (F.col("n") == F.col("n2")) & (F.col("size") == F.col("s2")))
    shared = F.size(F.array_intersect("counted", "theirs"))
    pairs = pairs.select("_k", "_h", "item", "first", "distance", shared.alias("shared"), (F.size("counted") + F.size("theirs") - shared).alias("total"))
    return pairs.where(100 * F.col("shared") >= PERCENT * F.col("total")).where("total > 0")


def best(found: DataFrame) -> DataFrame:
    """_k, _h, item and the best (then first) window of theirs."""
    order = F.struct((F.col("shared") * 1000000 / F.col("total")).cast("long").alias("likeness"), (-F.col("first")).alias("back"), "shared", "total", "distance")
    top = found.groupBy("_k", "_h", "item").agg(F.max(order).alias("b"))
    return top.select("_k", "_h", "item", (-F.col("b.back")).cast("long").alias("first"), F.col("b.shared").cast("long").alias("shared"), F.col("b.total").cast("long").alias("total"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without any window similar to an item."""
    leaks = find(docs, benchmark, key, text).select(F.col("_k").alias("_leak_k"), F.col("_h").alias("_leak_h")).distinct()
    return docs.join(leaks, docs[key].eqNullSafe(F.col("_leak_k")) & F.xxhash64(docs[text]).eqNullSafe(F.col("_leak_h")), "left_anti")
