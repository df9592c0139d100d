"""Suffix-array dedup: removes bytes covered by long strings that start earlier too.

Column-wise construction, one symbol of every string a round, runs over
collections of strings that are bounded in length, so that the rounds are
bounded too:

1. Every window of ``WIDTH`` bytes has an anchor: the leftmost of its
   ``GRAM``-byte grams with the least hash.  Equal windows have equal anchors
   at equal offsets, so windows meet by their anchors' hash.  Anchors whose
   hash occurs once are dropped; a Bloom filter of the others (of bounded
   size) tells tasks which surroundings to send.
2. The surroundings of an anchor are the bytes of all windows it stands for.
   Equal surroundings are combined before the shuffle; only the first of them
   can hold a first occurrence.
3. Surroundings with the same anchor are lined up at it and inserted column by
   column from the right: every round puts one more symbol before each string,
   so the order of all suffixes from that column on (and with it the column of
   the Burrows-Wheeler transform) follows from the round before by one stable
   distribution, and the common prefixes of neighbours from the least of those
   between their old places.  Neighbours that share ``WIDTH`` bytes are equal
   windows, of which all but the first are doomed.  The columns lie one after
   another in a file that is read once, from its end.
4. Anchors with more surroundings than one task should hold are split by
   longer anchors (the bytes that the left half and the right half of their
   windows have in common), down to single windows, where equal ones combine.

Edge cases: a null text is empty; texts shorter than ``WIDTH`` stay whole;
rows with equal id and text are one document and get the same result; a null
id is the smallest; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import map_arrow, slices, stored
from loglens.llm.lines import bit_places, filter_of, holds
from loglens.llm.shingles import mix

WIDTH = 100
GRAM = 32
SLICE = 1 << 20
# Surroundings of one anchor that a task takes, and of several anchors that go through the rounds together.
MOST_IN_GROUP = 1 << 16
BATCH = 1 << 14
# Copies that tasks are told to pass over (8 MB); others are found like any other repeat.
TOLD_COPIES = 1 << 20
NO_ID = -(1 << 63)


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over every run of ``width`` numbers."""
    have = 1
    while have * 2 <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def grams(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of every run of ``size`` (a power of two) bytes."""
    x, have = data.astype(np.uint64) + np.uint64(1), 1
    factor = 0x9E3779B97F4A7C15
    while have < size:
        x = x[:-have] * np.uint64(factor) + x[have:]
        x ^= x >> np.uint64(29)
        factor = (factor * factor + 0x632BE59BD9B4E019) % (1 << 64) | 1
        have *= 2
    return mix(x)


def anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of the texts in data: the text, hash, place, first and last window of every anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none.view(np.uint64), none, none, none
    h = grams(data, gram)
    span = width - gram + 1
    least = _sliding(h, span, np.minimum)  # by window
    n = len(least)
    # a gram that is the least of some window around it equals the largest of those windows' least
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(len(h) - n, np.uint64)])
    candidate = np.flatnonzero(_sliding(padded, span, np.maximum) == h)
    of_text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    start = np.flatnonzero(np.arange(n) + width <= offsets[1:][of_text])
    if not len(start):
        return none, none.view(np.uint64), none, none, none
    at = np.searchsorted(candidate, start)
    open_ = np.arange(len(start))
    while len(open_):
        open_ = open_[h[candidate[at[open_]]] != least[start[open_]]]
        at[open_] += 1
    place = candidate[at]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (of_text[start[1:]] != of_text[start[:-1]])]))
    last = np.concatenate([new[1:], [len(start)]]) - 1
    return of_text[start[new]], h[place[new]], place[new], start[new], start[last]


class _Texts:
    """The bytes of a slice of texts."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def _fresh(batch: pa.RecordBatch, told: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """The rows (_k, _text, text) that aren't told to be copies of others."""
    ids, hashes = told
    if not len(ids) or not batch.num_rows:
        return batch
    k, h = np.asarray(batch.column(0)), np.asarray(batch.column(1))
    at = np.minimum(np.searchsorted(ids, k), len(ids) - 1)
    return batch.filter(pa.array((ids[at] != k) | (hashes[at] != h)))


def repeated_filter(rows: DataFrame, told, width: int) -> np.ndarray:
    """A packed Bloom filter of the anchors' hashes that occur twice or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=8 * SLICE):
            held = []
            for part in slices(iter([_fresh(batch, told.value)]), size=SLICE):
                texts = _Texts(part.column(2))
                held.append(anchors(texts.data, texts.offsets, width)[1])
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n > 1)], ["h", "again"])

    counts = map_arrow(rows, count, "h long, again boolean")
    twice = counts.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).where((F.col("n") > 1) | F.col("again")).select("h")
    twice = stored(twice, "anchors")
    return filter_of(twice)


def surroundings(rows: DataFrame, told, packed, width: int) -> DataFrame:
    """h, _k, _text, first (window), off (of the anchor from there), seg: what lies around repeated anchors."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices((_fresh(b, told.value) for b in batches), size=SLICE):
            texts = _Texts(batch.column(2))
            of, h, place, first, last = anchors(texts.data, texts.offsets, width)
            if not len(of):
                continue
            again = holds(packed.value, bit_places(h, len(packed.value) * 8))
            of, h, place, first, last = (x[again] for x in (of, h, place, first, last))
            size = last - first + width
            cuts = np.concatenate([[0], np.cumsum(size)])
            flat = texts.data[np.repeat(first - cuts[:-1], size) + np.arange(cuts[-1])]
            seg = pa.BinaryArray.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            ids, hashes = np.asarray(batch.column(0))[of], np.asarray(batch.column(1))[of]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(ids), pa.array(hashes), pa.array((first - texts.offsets[of]).astype(np.int64)), pa.array((place - first).astype(np.int32)), seg],
                ["h", "_k", "_text", "first", "off", "seg"],
            )

    return map_arrow(rows, emit, "h long, _k long, _text long, first long, off int, seg binary")


class _Columns:
    """Strings lined up at their anchors; the file holds one column after another.

    A cell is a byte plus one; 0, before and after a string, is no byte.
    """

    def __init__(self, segs: list[bytes], offs: np.ndarray):
        sizes = np.array([len(s) for s in segs])
        self.left = int(offs.max())
        self.width = self.left + int((sizes - offs).max())
        self.begin, self.end = self.left - offs, self.left - offs + sizes
        self.rows = len(segs)
        flat = np.frombuffer(b"".join(segs), np.uint8)
        starts = np.cumsum(sizes) - sizes
        self.file = tempfile.TemporaryFile()
        for column in range(self.width):
            inside = np.flatnonzero((self.begin <= column) & (column < self.end))
            cells = np.zeros(self.rows, np.uint16)
            cells[inside] = flat[starts[inside] + column - self.begin[inside]].astype(np.uint16) + 1
            cells.tofile(self.file)

    def read(self, column: int) -> np.ndarray:
        self.file.seek(column * self.rows * 2)
        return np.frombuffer(self.file.read(self.rows * 2), np.uint16)


def doomed_windows(group: np.ndarray, rank: np.ndarray, segs: list[bytes], offs: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """By string and column (of its own): whether the window from there equals one of a lower rank.

    Only strings of one group are compared.  Returns a matrix of rows by the
    most windows a string has.
    """
    sizes = np.array([len(s) for s in segs])
    windows = sizes - width + 1
    out = np.zeros((len(segs), int(windows.max())), bool)
    columns = _Columns(segs, offs)
    n = len(segs)
    small = np.unique(group, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(small, kind="stable")
    by_group = small.astype(np.uint16)  # at most BATCH + MOST_IN_GROUP strings, fewer groups
    common = np.zeros(n, np.int32)  # of each place with the place before, within its group
    for column in range(columns.width - 1, -1, -1):
        symbols = columns.read(column)
        inside = (columns.begin <= column) & (column < columns.end)
        # the round's insertion: a stable distribution by the new symbol (the transform's column), inside the groups
        bwt = symbols[order]
        moved = np.argsort(bwt, kind="stable")
        moved = moved[np.argsort(by_group[order[moved]], kind="stable")]
        now = order[moved]
        same = np.zeros(n, bool)
        same[1:] = (small[now[1:]] == small[now[:-1]]) & (symbols[now[1:]] == symbols[now[:-1]]) & inside[now[1:]] & inside[now[:-1]]
        fresh = np.zeros(n, np.int32)
        pairs = np.flatnonzero(same)
        if len(pairs):
            # old places are increasing where symbols are equal; the least common prefix between them stays
            bounds = np.empty(2 * len(pairs), np.int64)
            bounds[0::2], bounds[1::2] = moved[pairs - 1] + 1, moved[pairs] + 1
            fresh[pairs] = np.minimum.reduceat(np.append(common, 0), bounds)[0::2] + 1
        order, common = now, fresh
        equal = common >= width
        if equal.any():
            heads = np.flatnonzero(~equal)
            least = np.minimum.reduceat(rank[order], heads)
            run = np.cumsum(~equal) - 1
            late = rank[order] > least[run]
            hit = order[late]
            out[hit, column - columns.begin[hit]] = True
    columns.file.close()
    return out


def _ranges(flags: np.ndarray) -> list[list[int]]:
    """First and last of every run of set flags, one after another, by row."""
    padded = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    change = np.diff(padded, axis=1)
    out = []
    for starts, ends in ((np.flatnonzero(c == 1), np.flatnonzero(c == -1)) for c in change):
        out.append(np.stack([starts, ends - 1], 1).ravel().tolist())
    return out


def _rounds(classes: DataFrame, width: int) -> DataFrame:
    """_k, _text, first, ranges of every first surroundings whose windows start elsewhere earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            k, first = rows.column("_k").to_numpy(), rows.column("first").to_numpy()
            offs = rows.column("off").to_numpy().astype(np.int64)
            # equal windows have their anchors at equal offsets, so the anchors' order is the windows'
            rank = np.empty(len(k), np.int64)
            places = np.stack([k, first + offs], 1)
            rank[:] = np.unique(places, axis=0, return_inverse=True)[1].reshape(-1)
            flags = doomed_windows(rows.column("h").to_numpy(), rank, rows.column("seg").to_pylist(), offs, width)
            some = np.flatnonzero(flags.any(1))
            return pa.RecordBatch.from_arrays(
                [pa.array(k[some]), pa.array(rows.column("_text").to_numpy()[some]), pa.array(first[some]), pa.array(_ranges(flags[some]), pa.list_(pa.int32()))],
                ["_k", "_text", "first", "ranges"],
            )

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < BATCH:
                continue
            rows = pa.Table.from_batches(held)
            h = rows.column("h").to_numpy()
            cuts = np.flatnonzero(h[1:] != h[:-1]) + 1  # whole groups only; the last may go on
            done = 0
            while done < len(h):
                after = cuts[cuts > done]
                if not len(after):
                    break
                fit = after[after <= done + BATCH]
                until = int(fit[-1] if len(fit) else after[0])
                yield flush(rows.slice(done, until - done))
                done = until
            held = rows.slice(done).to_batches()
        if held and sum(b.num_rows for b in held):
            rows = pa.Table.from_batches(held)
            h = rows.column("h").to_numpy()
            cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
            done = 0
            while done < len(h):
                fit = [c for c in cuts if done < c <= done + BATCH]
                until = fit[-1] if fit else next(c for c in cuts if c > done)
                yield flush(rows.slice(done, until - done))
                done = until

    # the window's partitions hold whole groups, in order
    whole = classes.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("c > 1").select("h", "_k", "_text", "first", "off", "seg")
    return map_arrow(whole, run, "_k long, _text long, first long, ranges array<int>")


def _combined(segments: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Equal surroundings as one, with the first place of theirs; the windows of the others."""
    segments = segments.withColumn("cls", F.xxhash64("off", "seg"))
    place = F.struct("_k", "first", "_text")
    firsts = segments.groupBy("h", "core", "off", "seg", "cls").agg(F.min(place).alias("m"))
    firsts = stored(firsts.select("h", "core", "off", "seg", "cls", "m._k", "m.first", "m._text"), "surroundings")
    places = firsts.select("h", "cls", F.struct("_k", "first", "_text").alias("m"))
    later = segments.select("h", "cls", "_k", "_text", "first", F.expr(f"first + length(seg) - {width}").alias("b")).join(places, ["h", "cls"]).where(place != F.col("m"))
    return firsts.drop("cls"), later.select("_k", "_text", F.col("first").alias("a"), "b")


def _halves(classes: DataFrame, width: int) -> DataFrame:
    """The left and the right windows of each of the surroundings, by longer anchors.

    Windows around a core of ``core`` bytes start 0 to width - core bytes before
    it.  Those t bytes or more before it share t more bytes on the left, the
    others the bytes up to width - t + 1 from its start.
    """
    rows = classes.withColumn("t", F.expr(f"CAST(({width} - core + 1) DIV 2 AS int)")).withColumn("many", F.expr(f"CAST(length(seg) - {width - 1} AS int)"))
    rows = rows.withColumn("left", F.expr("greatest(0, least(many, off - t + 1))"))
    parts = "array(struct(0 AS skip, left AS many, off - t AS off, core + t AS core), struct(left AS skip, many - left AS many, off - left AS off, {w} - t + 1 AS core))"
    rows = rows.withColumn("p", F.explode(F.expr(f"filter({parts.format(w=width)}, x -> x.many > 0)")))
    cut = rows.select(
        "h", "_k", "_text", (F.col("first") + F.col("p.skip")).alias("first"), "p.off", "p.core", F.expr(f"substring(seg, p.skip + 1, p.many + {width - 1})").alias("seg")
    )
    return cut.withColumn("h", F.expr("xxhash64(core, substring(seg, off + 1, core))"))


def find_repeats(rows: DataFrame, width: int = WIDTH, most_in_group: int = MOST_IN_GROUP) -> DataFrame:
    """_k, _text, a, b: the windows from a to b of a document start earlier too; rows has _k, _text and text."""
    spark = rows.sparkSession
    size = F.octet_length("text")
    facts = rows.select("_k", "_text", size.alias("size"), F.md5(F.col("text").cast("binary")).alias("whole")).where(F.col("size") >= width)
    facts = stored(facts, "texts")
    first = facts.groupBy("whole").agg(F.min("_k").alias("least"), F.max("_k").alias("most")).where("least < most")
    copies = stored(facts.join(first, "whole").where(F.col("_k") > F.col("least")).select("_k", "_text", "size").distinct(), "copies")
    found = [copies.select("_k", "_text", F.lit(0).cast("long").alias("a"), (F.col("size") - width).cast("long").alias("b"))]
    some = copies.groupBy("_k").agg(F.min("_text").alias("t"), F.count(F.lit(1)).alias("n")).where("n = 1").select("_k", "t").limit(TOLD_COPIES).toPandas()
    some = some.sort_values("_k")
    told = spark.sparkContext.broadcast((some["_k"].to_numpy(np.int64), some["t"].to_numpy(np.int64)))
    packed = spark.sparkContext.broadcast(repeated_filter(rows, told, width))
    segments = stored(surroundings(rows, told, packed, width), "segments").withColumn("core", F.lit(GRAM))
    classes, later = _combined(segments, width)
    found.append(later)
    while True:
        large = stored(classes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_in_group).select("h"), "large")
        if large.isEmpty():
            break
        parts, later = _combined(_halves(classes.join(large, "h").where(F.col("core") < width), width), width)
        found.append(later)
        classes = classes.join(large, "h", "left_anti").unionByName(parts)
    rounds = _rounds(classes, width)
    pairs = F.expr("transform(sequence(0, size(ranges) DIV 2 - 1), i -> struct(first + ranges[2 * i] AS a, first + ranges[2 * i + 1] AS b))")
    found.append(rounds.select("_k", "_text", F.explode(pairs).alias("r")).select("_k", "_text", "r.a", "r.b"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, most_in_group: int = MOST_IN_GROUP) -> DataFrame:
    """key, n_bytes, spans (removed runs as start and end, in order) and kept (the other bytes) of every row."""
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("_k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    repeats = find_repeats(rows, width, most_in_group).groupBy(F.col("_k").alias("k"), F.col("_text").alias("t")).agg(F.collect_list(F.struct("a", "b")).alias("_ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = _Texts(batch.column(0))
            spans, kept = [], []
            for i, ranges in enumerate(batch.column(2)):
                own = data.data[data.offsets[i] : data.offsets[i + 1]]
                values = ranges.values
                if values is None or not len(values):
                    spans.append([])
                    kept.append(own.tobytes())
                    continue
                a, b = np.asarray(values.field(0)), np.asarray(values.field(1)) + width
                step = np.zeros(len(own) + 1, np.int64)
                np.add.at(step, a, 1)
                np.add.at(step, b, -1)
                gone = np.cumsum(step)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append(edge.tolist())
                kept.append(own[~gone].tobytes())
            lists = pa.array([[{"start": s, "end": e} for s, e in zip(x[::2], x[1::2])] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(np.diff(data.offsets)), lists, pa.array(kept, pa.binary())], ["_k", "n_bytes", "spans", "kept"]
            )

    joined = rows.join(repeats, (F.col("_k") == F.col("k")) & (F.col("_text") == F.col("t")), "left").select("text", "_k", "_ranges")
    out = map_arrow(joined, cut, "_k long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    return out.select(F.when(F.col("_k") != NO_ID, F.col("_k")).alias(key), "n_bytes", "spans", "kept")
