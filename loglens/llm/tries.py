"""Prefix trie of conversations, screened by a count-min sketch.

A node is a distinct sequence of first turns; a conversation is a path.  Every
turn gets the 128-bit digest of the prefix that it ends: the exclusive or of a
hash of (place, turn digest) for each of its turns, so the digests of a long
conversation can be summed up in pieces.

Tasks count their prefix digests in a count-min sketch (counters stop at
two), and the sketches are merged.  A sketch never counts too low, so an
estimate of one proves that no other conversation has the prefix.  Nodes of
such prefixes -- the tails -- are emitted where they are, from one row alone.
Only prefixes that may be shared are shuffled for exact grouping, as digests
without texts and combined on the map side.  A full sketch proves less and
changes no result.

A conversation owns the nodes whose smallest member it is: the lower part of
its path.  So sums over a subtree are sums over the members of the node: of
all that a member owns, and, for the owner, of what it owns from there on.

Joins from rows to nodes or conversations send those that would meet many
rows to all tasks; they are few by the threshold (``HOT``), and all others
meet few rows (``spread_join``).  Identifiers of a node's ends are sorted by
range, cut into pieces and hashed piece by piece.

Edge cases: rows without a conversation id are left out; null roles and texts
are empty; turns are ordered with null first, equal ones by role and text
(their digest); repeated rows are turns of their own; an empty table gives no
rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import map_arrow, stored
from loglens.llm.shingles import mix
from loglens.operators.ordered import line_bucket, ordinal, quantile_bucket, running_count

# Turns of a conversation that one task puts in order; longer ones are put in order in pieces.
LONG = 1 << 16
# Rows that a join may broadcast: facts that meet more than 1/HOT of all rows each are no more than HOT.
HOT = 1 << 16
SKETCH_ROWS = 4
CELLS_A_PREFIX = 4
# Cells of a row of the sketch: tasks hold 64 MB of it at most, and 32 MB are broadcast.
MOST_CELLS = 1 << 26
BLOCK = 1 << 16
ENDS_A_PIECE = 512
NODE = ["depth", "p1", "p2"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---- turns in order ---------------------------------------------------------------------

def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, pos (from 0), dig (of role and text) and chars (code points of the text) of every turn."""
    who, what = (F.coalesce(F.col(x), F.lit("")) for x in (role, text))
    whole = F.concat(F.length(who).cast("string"), F.lit(":"), who, what)
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("c"), F.col(turn).alias("t"), F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("dig"), F.length(what).cast("long").alias("chars")
    )
    order = [F.col("t").asc_nulls_first(), F.col("dig")]
    rows = stored(rows, "turns")
    long = stored(rows.groupBy("c").count().where(F.col("count") > LONG).select("c"), "long")
    by_conv = F.row_number().over(Window.partitionBy("c").orderBy(*order)).cast("long") - 1
    if long.isEmpty():
        found = rows.withColumn("pos", by_conv)
    else:
        few = F.broadcast(long) if long.count() <= HOT else long
        pieces = rows.join(few, "c", "left_semi").withColumn("x", F.coalesce(F.col("t").cast("double"), F.lit(float("-inf"))))
        in_pieces = ordinal(pieces, ["c"], order, quantile_bucket(pieces, F.col("x")), "pos").drop("x")
        found = rows.join(few, "c", "left_anti").withColumn("pos", by_conv).unionByName(in_pieces)
    return stored(found.select("c", "pos", "dig", "chars"), "sequences")


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join rows to facts (one row for each key), of which ``weight`` says how many rows they meet at most."""
    total = facts.agg(F.sum(weight)).first()[0] or 0
    least = max(1000, total // HOT)
    hot, cold = facts.where(F.col(weight) > least).drop(weight), facts.where(F.col(weight) <= least).drop(weight)
    met = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti")
    return met.unionByName(rest.join(cold, keys, how))


# ---- rebuilt conversations (input of the registered query) -------------------------------

def rebuilt(seq: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Sequences in which conversation c starts with the first crc32(c) % most turns of conversation c - c % block.

    Also c of the conversations that have no turn then.
    """
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % most).cast("int")
    base = F.col("c") - F.col("c") % block
    first = seq.where((F.col("pos") < most - 1) & (F.col("c") == base))
    heads = first.groupBy(F.col("c").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "dig", "chars"))).alias("head"))
    convs = seq.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": h, "base": base})
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")))
    convs = stored(convs.select("c", "n", "h", "head"), "heads")
    ours = convs.select("c", F.explode("head").alias("x")).select("c", "x.pos", "x.dig", "x.chars")
    place = convs.select("c", (F.size("head") - F.col("h")).cast("long").alias("shift"), "n")
    own = spread_join(seq.where(F.col("pos") >= h), place, ["c"], "n").select("c", (F.col("pos") + F.col("shift")).alias("pos"), "dig", "chars")
    none = convs.where((F.size("head") == 0) & (F.col("n") <= F.col("h"))).select("c")
    return stored(ours.unionByName(own), "rebuilt"), none


# ---- prefixes and their screening ---------------------------------------------------------

def prefixes(seq: DataFrame) -> DataFrame:
    """c, depth (from 1), p1, p2 (digest of the prefix), q1, q2 (of its parent), chars and more (goes on) of every turn."""
    lanes = [F.xxhash64(F.lit(i), F.col("pos"), F.col("dig")) for i in (1, 2)]
    rows = seq.select("c", "pos", "chars", lanes[0].alias("h1"), lanes[1].alias("h2"))
    piece = line_bucket("pos", LONG)
    w = Window.partitionBy("c", "bk").orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("bk", piece)
    local = rows.withColumns({"x1": F.bit_xor("h1").over(run), "x2": F.bit_xor("h2").over(run), "more": F.lead("pos").over(w).isNotNull()})
    long = stored(rows.where("bk > 0").select("c").distinct(), "long")
    if long.isEmpty():
        joined = local.withColumns({"y1": F.lit(0).cast("long"), "y2": F.lit(0).cast("long"), "end": F.lit(-1).cast("long")})
    else:
        few = F.broadcast(long) if long.count() <= HOT else long
        totals = rows.join(few, "c", "left_semi").groupBy("c", "bk").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"), F.max("pos").alias("top"))
        wb = Window.partitionBy("c").orderBy("bk")
        before = wb.rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy("c")
        carry = totals.select("c", "bk", F.coalesce(F.bit_xor("t1").over(before), F.lit(0)).alias("y1"), F.coalesce(F.bit_xor("t2").over(before), F.lit(0)).alias("y2"), F.max("top").over(whole).alias("end"))
        joined = local.join(carry, ["c", "bk"], "left")
    p1, p2 = (F.col(f"x{i}").bitwiseXOR(F.coalesce(f"y{i}", F.lit(0).cast("long"))) for i in (1, 2))
    rows = joined.select("c", (F.col("pos") + 1).alias("depth"), p1.alias("p1"), p2.alias("p2"), "h1", "h2", "chars", (F.col("more") | (F.col("pos") < F.coalesce("end", F.lit(-1)))).alias("more"))
    parent = [F.col(f"p{i}").bitwiseXOR(F.col(f"h{i}")).alias(f"q{i}") for i in (1, 2)]
    return stored(rows.select("c", *NODE, *parent, "chars", "more"), "prefixes")


def cells(digests: np.ndarray, width: int) -> np.ndarray:
    """The cell of each digest in every row of the sketch, rows one after another."""
    out = np.empty((len(digests), SKETCH_ROWS), np.int64)
    for r in range(SKETCH_ROWS):
        out[:, r] = (mix(digests ^ np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(width)).astype(np.int64) + r * width
    return out


def _plane(at: np.ndarray, size: int) -> np.ndarray:
    packed = np.zeros(size // 8, np.uint8)
    np.bitwise_or.at(packed, at >> 3, (128 >> (at & 7)).astype(np.uint8))
    return packed


def sketch_width(n: int) -> int:
    return min(MOST_CELLS, 1 << max(BLOCK.bit_length() - 1, (max(1, n) * CELLS_A_PREFIX - 1).bit_length()))


def crowded_cells(found: DataFrame, width: int) -> np.ndarray:
    """Packed bits: cells of the count-min sketch with a count of two or more."""
    size = SKETCH_ROWS * width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)
        for batch in batches:
            at, times = np.unique(cells(np.asarray(batch.column(0)).view(np.uint64), width).ravel(), return_counts=True)
            bit = (128 >> (at & 7)).astype(np.uint8)
            often = (times > 1) | ((once[at >> 3] & bit) != 0)
            np.bitwise_or.at(twice, at[often] >> 3, bit[often])
            np.bitwise_or.at(once, at >> 3, bit)
        once, twice = (x.reshape(-1, BLOCK // 8) for x in (once, twice))
        for i in np.flatnonzero(once.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([once[i].tobytes()], pa.binary()), pa.array([twice[i].tobytes()], pa.binary())], ["block", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, one, two in zip(*(x.to_pylist() for x in batch.columns)):
                one, two = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
                have = blocks.get(block)
                blocks[block] = (one, two) if have is None else (have[0] | one, have[1] | two | (have[0] & one))
        for k, (_, two) in blocks.items():
            if two.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([two.tobytes()], pa.binary())], ["block", "bits"])

    parts = map_arrow(found, count, "block long, once binary, twice binary")
    packed = np.zeros((size // BLOCK, BLOCK // 8), np.uint8)
    for row in map_arrow(parts.repartition("block"), merge, "block long, bits binary").toLocalIterator():  # 32 MB in all
        packed[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return packed.reshape(-1)


def screened(rows: DataFrame) -> DataFrame:
    """The prefixes with ``kind``: 2 may be shared; 1 is proven to be of one conversation, its parent not; 0 so is its parent."""
    width = sketch_width(rows.count())
    shared = rows.sparkSession.sparkContext.broadcast(crowded_cells(rows.select("p1"), width))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def several(column: pa.Array) -> np.ndarray:
            at = cells(np.asarray(column).view(np.uint64), width)
            return ((bits[at >> 3] & (128 >> (at & 7))) != 0).all(1)  # the least of the counts is two or more

        for batch in batches:
            if batch.num_rows:
                by = dict(zip(batch.schema.names, batch.columns))
                edge = several(by["q1"]) | (np.asarray(by["depth"]) == 1)
                kind = np.where(several(by["p1"]), 2, edge.astype(np.int64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind)], [*batch.schema.names, "kind"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return map_arrow(rows, look, f"{kinds}, kind int")


# ---- exact grouping -----------------------------------------------------------------------

def ends_digests(ends: DataFrame) -> DataFrame:
    """NODE and ends: SHA-256 of the ascending ids of the conversations that end at a node."""
    ranged = ends.select(*NODE, "c").repartitionByRange(*NODE, "c").sortWithinPartitions(*NODE, "c")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([np.asarray(x) for x in batch.columns[:3]], 1)
            ids = batch.column(3)
            edge = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1 if len(keys) else []
            bounds = [0, *edge, len(keys)] if len(keys) else []
            out = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                for i in range(a, b, ENDS_A_PIECE):
                    some = ids.slice(i, min(ENDS_A_PIECE, b - i)).to_pylist()
                    out.append((*keys[a].tolist(), some[0], ",".join(map(str, some))))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, [pa.int64()] * 3 + [ids.type, pa.string()])], [*NODE, "first", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        out: list[tuple] = []
        for batch in batches:
            for d, p1, p2, _, piece in zip(*(x.to_pylist() for x in batch.columns)):
                if (d, p1, p2) != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (d, p1, p2), hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), [pa.int64()] * 3 + [pa.string()])], [*NODE, "ends"])
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*now, state.hexdigest()), [pa.int64()] * 3 + [pa.string()])], [*NODE, "ends"])

    key = "depth long, p1 long, p2 long"
    pieces = map_arrow(ranged, cut, f"{key}, first {ends.schema['c'].dataType.simpleString()}, piece string")
    return map_arrow(pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first"), digest, f"{key}, ends string")


def _facts(df: DataFrame, **columns: Column) -> DataFrame:
    """NODE and the columns of one kind of facts, null where they aren't given."""
    kinds = {"owner": "long", "n": "long", "children": "long", "leaves": "long", "saved": "long", "ends": "string", "parent": "long"}
    return df.select(*NODE, *(columns.get(k, F.lit(None)).cast(v).alias(k) for k, v in kinds.items()))


def trie(seq: DataFrame, turnless: DataFrame | None = None) -> DataFrame:
    """One row for each node of the sequences' trie; ``turnless``: c of conversations without a turn.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (of the subtree) and ends_sha256.
    """
    rows = prefixes(seq)
    probed = screened(rows)
    open_rows = stored(probed.where("kind > 0"), "shared")
    root = rows.where("depth = 1").select("c", F.lit(True).alias("more"))
    if turnless is not None:
        root = root.unionByName(turnless.select("c", F.lit(False).alias("more")))
    zero = F.lit(0).cast("long")
    root = root.select("c", *(zero.alias(k) for k in NODE), *(F.lit(None).cast("long").alias(k) for k in ("q1", "q2")), zero.alias("chars"), "more")
    members = stored(open_rows.where("kind = 2").drop("kind").unionByName(root), "members")
    edges = open_rows.where("kind = 1")

    grouped = members.groupBy(*NODE).agg(F.min("c").alias("owner"), F.count(F.lit(1)).alias("n"), F.max("more").alias("more"), F.max("chars").alias("chars"), F.max("q1").alias("q1"), F.max("q2").alias("q2"))
    nodes = stored(grouped.withColumn("w", (F.col("n") - 1) * F.col("chars")), "nodes")

    # what every conversation owns; leaves: members, less those that end at a shared node, and one for each such node without children
    owned = nodes.groupBy(F.col("owner").alias("c")).agg(F.sum("w").alias("own"), F.sum((~F.col("more")).cast("long")).alias("leaf"), F.lit(0).cast("long").alias("paths"))
    ending = members.where("NOT more").select("c", zero.alias("own"), F.lit(-1).cast("long").alias("leaf"), zero.alias("paths"))
    lengths = members.groupBy("c").agg(zero.alias("own"), zero.alias("leaf"), F.count(F.lit(1)).alias("paths"))
    of_conv = owned.unionByName(ending).unionByName(lengths).groupBy("c").agg(*(F.sum(x).alias(x) for x in ("own", "leaf", "paths"))).where("own <> 0 OR leaf <> 0")
    below = spread_join(members.select("c", *NODE), stored(of_conv, "owned"), ["c"], "paths")
    above = running_count(nodes.select("owner", "w", *NODE), ["owner"], ["depth"], line_bucket("depth", LONG), "upto", value=F.col("w"))

    up = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    children = nodes.where("depth > 0").select(F.col("owner").alias("c"), F.col("depth").alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(2).alias("kind"), "more", *up)
    children = children.unionByName(edges.select("c", F.col("depth").alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(1).alias("kind"), "more", *up))
    children = stored(children, "children")
    n_children = children.groupBy(*NODE).agg(F.count(F.lit(1)).alias("met"))
    parents = stored(nodes.join(n_children, NODE).select(*NODE, F.col("owner").alias("parent"), "met"), "parents")
    # a parent that isn't there is proven to be of one conversation: its child's
    with_parent = spread_join(children, parents, NODE, "met", "left")
    with_parent = with_parent.select("kind", "c", "more", F.col("d").alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.coalesce("parent", "c").alias("parent"))
    with_parent = stored(with_parent, "with-parent")

    facts = [
        _facts(nodes, owner=F.col("owner"), n=F.col("n")),
        _facts(parents, children=F.col("met")),
        _facts(below.groupBy(*NODE).agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf")), leaves=F.col("leaf"), saved=F.col("own")),
        _facts(above, saved=F.col("w") - F.col("upto")),
        _facts(ends_digests(members.where("NOT more")), ends=F.col("ends")),
        _facts(with_parent.where("kind = 2"), parent=F.col("parent")),
    ]
    together = facts[0]
    for f in facts[1:]:
        together = together.unionByName(f)
    of = together.groupBy(*NODE).agg(*(F.max(x).alias(x) for x in ("owner", "n", "children", "ends", "parent")), *(F.sum(x).alias(x) for x in ("leaves", "saved")))
    shared = of.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.coalesce("children", zero).alias("n_children"), (F.col("n") + F.coalesce("leaves", zero)).alias("n_leaves"),
        F.coalesce("saved", zero).alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )

    def alone(df: DataFrame, parent: str) -> DataFrame:
        one = F.lit(1).cast("long")
        return df.select(
            F.col("c").alias("conv_id"), "depth", F.col(parent).alias("parent_conv_id"), one.alias("n_convs"), F.col("more").cast("long").alias("n_children"), one.alias("n_leaves"),
            zero.alias("saved_tokens"), F.when(F.col("more"), F.lit(EMPTY_SHA)).otherwise(F.sha2(F.col("c").cast("string"), 256)).alias("ends_sha256"),
        )

    return shared.unionByName(alone(with_parent.where("kind = 1"), "parent")).unionByName(alone(probed.where("kind = 0"), "c"))


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations of a table of turns."""
    return trie(sequences(turns, conv, turn, role, text))
