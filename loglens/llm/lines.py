"""Line dedup with two Bloom filters.

A first pass over the texts sets, in every task, the bits of a filter of line
keys seen once and of one of keys seen twice (keys whose bits were all set
before); merged block by block, a bit set in two tasks' first filters counts
as seen twice.  The second filter misses no key that two documents share.  A
second pass sends only lines that it suspects, by the key itself and combined
on the map side, to be counted exactly; what two filters wrongly suspect
costs a little shuffle and no result.  The doomed line numbers of each
document then go back to its text.

A key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased.
Keys of at least ``least_chars`` code points in at least ``least_docs``
documents lose their lines everywhere but in the largest key column's rows.

Edge cases: a null or empty text is one empty line and stays as it is; a
document counts once however often it has a line; rows that share a doc_id
count as documents of their own, and all of them keep a line if theirs is the
largest id; null ids count as smallest (they keep their line only if no other
id has it); an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import SPACES, map_arrow, slices, stored, text_or_empty

LEAST_CHARS = 20
LEAST_DOCS = 3
BITS_A_LINE = 16
HASHES = 4
# Bits of a filter: at most 64 MB go to each Python worker whatever the input; a fuller filter only suspects more.
MOST_BITS = 1 << 29
BLOCK_BITS = 1 << 16


def keys_of(text: str, least_chars: int) -> dict[str, list[int]]:
    """The line numbers of each key of a text that is long enough."""
    found: dict[str, list[int]] = {}
    for number, line in enumerate(text.split("\n")):
        if len(line) >= least_chars:
            key = line.strip(SPACES)
            if len(key) >= least_chars:
                low = key.lower() if key.isascii() else key.encode("utf-8").lower().decode("utf-8")  # bytes.lower() knows A-Z only
                found.setdefault(low, []).append(number)
    return found


def bit_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A row of HASHES bit numbers for each hash (Kirsch and Mitzenmacher's double hashing)."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return ((hashes[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


def places(keys: list[str], bits: int) -> np.ndarray:
    return bit_places(np.array([xxhash.xxh3_64_intdigest(k.encode("utf-8")) for k in keys], np.uint64), bits)


class Seen:
    """The two filters, packed, the first bit of a byte being its highest."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    def add(self, keys: list[str]) -> None:
        """Distinct keys of one document."""
        at = places(keys, self.bits)
        old = holds(self.once, at)
        for bits, some in ((self.twice, at[old].ravel()), (self.once, at.ravel())):
            np.bitwise_or.at(bits, some >> 3, (128 >> (some & 7)).astype(np.uint8))


def holds(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all bits of each row of places are set."""
    return ((packed[at >> 3] & (128 >> (at & 7))) != 0).all(1)


def filter_bits(n_lines: int) -> int:
    wanted = max(BLOCK_BITS, n_lines * BITS_A_LINE)
    return min(MOST_BITS, -(-wanted // BLOCK_BITS) * BLOCK_BITS)


def filter_of(hashes: DataFrame) -> np.ndarray:
    """A packed Bloom filter of a column of 64-bit hashes."""
    bits = filter_bits(hashes.count())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = bit_places(np.asarray(batch.column(0)).view(np.uint64), bits).ravel()
            np.bitwise_or.at(packed, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        blocks = packed.reshape(-1, BLOCK_BITS // 8)
        for i in np.flatnonzero(blocks.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([blocks[i].tobytes()])], ["block", "bits"])

    packed = np.zeros((bits // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for row in map_arrow(hashes.coalesce(4), build, "block long, bits binary").toLocalIterator():  # four filters at most
        packed[row["block"]] |= np.frombuffer(row["bits"], np.uint8)
    return packed.reshape(-1)


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] | b[0], a[1] | b[1] | (a[0] & b[0])


def twice_seen(texts: DataFrame, bits: int, least_chars: int) -> DataFrame:
    """block, bits: the packed second filter, without empty blocks."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(bits)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if keys := list(keys_of(text, least_chars)):
                    seen.add(keys)
        once, twice = (x.reshape(-1, BLOCK_BITS // 8) for x in (seen.once, seen.twice))
        blocks = np.flatnonzero(once.any(1))
        for some in np.array_split(blocks, max(1, len(blocks) // 256)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64()), pa.array([once[i].tobytes() for i in some], pa.binary()), pa.array([twice[i].tobytes() for i in some], pa.binary())],
                ["block", "once", "twice"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                new = np.frombuffer(once, np.uint8), np.frombuffer(twice, np.uint8)
                blocks[block] = _merge(blocks[block], new) if block in blocks else new
        found = [(k, v[1].tobytes()) for k, v in blocks.items() if v[1].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([v for _, v in found], pa.binary())], ["block", "bits"])

    built = map_arrow(texts, build, "block long, once binary, twice binary")
    # a task holds its share of the blocks, which MOST_BITS bounds
    return map_arrow(built.repartition("block"), merge, "block long, bits binary")


def doomed_lines(docs: DataFrame, key: str, text: str, least_chars: int, least_docs: int) -> DataFrame:
    """_id, _of, _lines array<int>: id, text hash and lines to drop of every document that loses any."""
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64(text).alias("_hash"), F.col(key).alias("_key"), text_or_empty(text).alias("text"))
    n_lines = rows.select(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1).alias("n")).first()["n"] or 0
    bits = filter_bits(n_lines)
    packed = np.zeros((bits // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for row in twice_seen(rows.select("text"), bits, least_chars).collect():  # MOST_BITS at most
        packed[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(packed.reshape(-1))

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for batch in slices(batches):
            found: list[tuple] = []
            for of, own, text in zip(*(c.to_pylist() for c in batch.columns)):
                if keys := keys_of(text, least_chars):
                    hit = holds(twice, places(list(keys), bits))
                    found += [(k, own, of, n) for (k, n), h in zip(keys.items(), hit) if h]
            columns = list(zip(*found)) if found else [[], [], [], []]
            kinds = pa.string(), batch.schema.field(1).type, pa.int64(), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["line", "_key", "_hash", "numbers"])

    kind = rows.schema["_key"].dataType.simpleString()
    suspects = stored(map_arrow(rows, suspect, f"line string, _key {kind}, _hash long, numbers array<int>"), "suspect-lines")
    counted = suspects.groupBy("line").agg(F.count(F.lit(1)).alias("_n"), F.max("_key").alias("_last")).where(F.col("_n") >= least_docs)
    lost = suspects.join(counted, "line").where(~F.col("_key").eqNullSafe(F.col("_last")))
    return lost.groupBy(F.col("_key").alias("_id"), F.col("_hash").alias("_of")).agg(F.flatten(F.collect_list("numbers")).alias("_lines"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Every row with ``_row`` (its columns), ``_kept`` (its text without the dropped lines), ``n_lines`` and ``n_dropped``."""
    base = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    doomed = doomed_lines(base, "_key", "_text", least_chars, least_docs)
    return _rebuild(base.join(doomed, base["_key"].eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of")), "left").drop("_id", "_of"))


def _rebuild(joined: DataFrame) -> DataFrame:
    lines = F.split(text_or_empty("_text"), "\n", -1)
    drop = F.array_sort(F.array_distinct(F.col("_lines")))
    rows = joined.withColumns({"_all": lines, "_drop": F.coalesce(drop, F.array().cast("array<int>"))})
    # the kept lines are the runs between dropped ones
    bounds = "concat(array(-1), _drop, array(size(_all)))"
    runs = f"flatten(zip_with(slice({bounds}, 1, size(_drop) + 1), slice({bounds}, 2, size(_drop) + 1), (a, b) -> slice(_all, a + 2, b - a - 1)))"
    kept = F.when(F.size("_drop") == 0, F.col("_text")).otherwise(F.array_join(F.expr(runs), "\n"))
    return rows.select("_row", kept.alias("_kept"), F.size("_all").cast("long").alias("n_lines"), F.size("_drop").cast("long").alias("n_dropped"))
