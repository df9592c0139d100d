"""N-gram Jaccard join by a token-group matrix.

1. Documents with equal shingle sets are one class; only classes go on.
2. Similar classes are partitioned into groups: classes with an equal minimum
   hash are compared with pivots of theirs, and verified links make groups.
   That takes a few comparisons a class, also inside very large groups.
3. The token-group matrix holds, for each group, the union of its members'
   first shingles in an order of all shingles, rare ones first.  What a set
   and a group share among these bounds what they share at all: up to where
   the shorter of two lists of first shingles ends, both are known, and after
   it at most the rest can be common.  Only groups whose count reaches the
   least that this bound allows (``_least_shared``) are opened.
4. Members of opened groups that pass the same bound are verified exactly,
   and the links join the groups to components.

The order of the shingles only steers how many groups are opened, never the
result.  It counts shingles that some task has met twice; the most frequent of
those (at most ``FREQUENT``, 16 MB) are sent to all tasks.

Edge cases: a document without text or words has an empty set and links with
nothing; one with fewer words than a shingle has one shingle of them all;
rows with a null id get a null component and link with nothing; repeated ids
stand each for themselves, rows with equal sets always share a class; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import map_arrow, slices, stored, text_or_empty
from loglens.llm.graph import components
from loglens.llm.lines import bit_places, filter_of, holds
from loglens.llm.shingles import mix, shingle_sets

SHARED = 3
# First shingles of all members of a group whose union is held as one list (128 kB).
SHORT_UNION = 1 << 14
# Members of a group that are all looked at when it is opened.
FEW_MEMBERS = 8
MINIMA = 3
PIVOTS = 16
FREQUENT = 1 << 20
FREQUENT_FROM = 8
# Text whose shingles are worked out at a time; the arrays for it take some 50 times as much.
SHINGLED_BYTES = 1 << 20
# Shingles that a task counts at a time (48 MB).
COUNTED = 6_000_000
# Rows of 16 bytes that are broadcast (32 MB); beyond that they are joined by shuffle.
TOLD = 1 << 21


def _ids(rows: DataFrame) -> str:
    return rows.schema["_k"].dataType.simpleString()


def met_twice(held: list[np.ndarray]) -> pa.RecordBatch:
    """token, n of the shingles that the arrays hold twice or more; empties the list, and holds one copy beside it at most."""
    tokens = np.concatenate(held)
    held.clear()
    tokens.sort()
    same = np.zeros(len(tokens) + 1, bool)  # as the one before
    same[1:-1] = tokens[1:] == tokens[:-1]
    first = np.flatnonzero(same[1:] & ~same[:-1])
    last = np.flatnonzero(same[:-1] & ~same[1:])
    return pa.RecordBatch.from_arrays([pa.array(tokens[first].view(np.int64)), pa.array(last - first + 1)], ["token", "n"])


def frequent_shingles(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles and their counts, as far as tasks have met them twice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches, size=SHINGLED_BYTES):
            for s in shingle_sets(batch.column(1), size):
                held.append(s)
                n += len(s)
            if n > COUNTED:
                yield met_twice(held)
                n = 0
        if held:
            yield met_twice(held)

    counts = map_arrow(rows, count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    found = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    tokens, times = found["token"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], times[order]


def signatures(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """_k, h (hash of the set), n, minima and rarest shingles of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent_shingles(rows, size))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, times = shared.value
        for batch in slices(batches, size=SHINGLED_BYTES):
            sets = shingle_sets(batch.column(1), size)
            h = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
            minima, rare, common = [], [], []
            for s in sets:
                if not len(s):
                    common.append(0)
                    minima.append([])
                    rare.append(np.zeros(0, np.int64))
                    continue
                count = np.zeros(len(s), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    count = np.where(frequent[at] == s, times[at], 0)
                common.append(int((count > 0).sum()) * 1000 // len(s))
                minima.append([int(mix(s ^ np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))).min().view(np.int64)) for j in range(1, MINIMA + 1)])
                length = min(len(s), len(s) - -(-percent * len(s) // 100) + SHARED)
                order = np.argsort(count, kind="stable")[:length] if count.any() else slice(length)
                rare.append(s[order].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.array(h, np.uint64).view(np.int64)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(common, pa.int64()),
                    pa.array(minima, pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(np.cumsum([0, *map(len, rare)]).astype(np.int32), pa.array(np.concatenate(rare))),
                ],
                ["_k", "h", "n", "common", "minima", "rare"],
            )

    return map_arrow(rows, sign, f"_k {_ids(rows)}, h long, n long, common long, minima array<long>, rare array<long>")


def _may_reach(a: Column, b: Column, percent: int) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _group_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """a, b: each class with pivots of the classes that share a minimum.

    The pivot has most shingles in common with the corpus: of copies with
    changes of their own, the one that is most like the others.
    """
    keyed = classes.select("h", "n", "common", F.posexplode("minima").alias("j", "key")).withColumn("s", F.pmod("h", F.lit(PIVOTS)))
    salted = keyed.groupBy("j", "key", "s").agg(F.max(F.struct("common", "h", "n")).alias("sub"), F.count(F.lit(1)).alias("m"))
    pivots = salted.groupBy("j", "key").agg(F.max("sub").alias("top"), F.sum("m").alias("m")).where(F.col("m") > 1)
    member = keyed.join(pivots, ["j", "key"])
    to_top = member.select("h", "n", F.col("top.h").alias("p"), F.col("top.n").alias("pn"))
    large = pivots.where(F.col("m") > PIVOTS).select("j", "key")
    to_sub = keyed.join(salted.join(large, ["j", "key"]), ["j", "key", "s"]).select("h", "n", F.col("sub.h").alias("p"), F.col("sub.n").alias("pn"))
    pairs = to_top.unionByName(to_sub).where((F.col("h") != F.col("p")) & _may_reach(F.col("n"), F.col("pn"), percent))
    return pairs.select(F.greatest("h", "p").alias("a"), F.least("h", "p").alias("b")).distinct()


def _told(df: DataFrame) -> DataFrame:
    """Broadcast if it is small."""
    return F.broadcast(df) if df.count() <= TOLD else df


def _postings(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """h, n, g, members, tokens: the first shingles of each class that groups share, and a few others."""
    of = groups.join(groups.groupBy("root").agg(F.count(F.lit(1)).alias("members")), "root")
    grouped = classes.select("h", "n", "rare").join(_told(of), "h", "left").select("h", "n", F.coalesce("root", "h").alias("g"), F.coalesce("members", F.lit(1)).alias("members"), "rare")
    tokens = grouped.select("g", F.explode("rare").alias("token"))
    between = tokens.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where(F.col("lo") != F.col("hi")).select("token")
    shared = classes.sparkSession.sparkContext.broadcast(filter_of(stored(between, "between")))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = len(shared.value) * 8
        for batch in batches:
            lists = batch.column(4)
            sizes = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten())
            keep = holds(shared.value, bit_places(flat.view(np.uint64), bits)) if len(flat) else np.zeros(0, bool)
            m = np.bincount(np.repeat(np.arange(batch.num_rows), sizes)[keep], minlength=batch.num_rows)
            some = np.flatnonzero(m)
            tokens = pa.ListArray.from_arrays(np.cumsum(np.append(0, m[some])).astype(np.int32), pa.array(flat[keep]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(some)) for i in range(4)), tokens], ["h", "n", "g", "members", "tokens"])

    return stored(map_arrow(grouped, thin, "h long, n long, g long, members long, tokens array<long>"), "postings")


def _opened_pairs(classes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """a, b: classes of different groups that the token-group matrix can't tell apart."""
    known = _postings(classes, groups).withColumn("m", F.size("tokens"))
    postings = known.select("h", "n", "g", "members", "m", F.posexplode("tokens").alias("i", "token"))
    # sets that are similar meet in a shingle that is an early one of both: of m, one of the first m - needed + 1
    n, least = F.col("n"), F.ceil(F.lit(percent) * F.col("n") / 100)
    lowest = F.greatest(F.lit(1), F.least(_least_shared(n, least, percent), _least_shared(n, F.floor(F.lit(100) * n / percent), percent) - 1))
    matrix = postings.where(F.col("i") <= F.col("m") - lowest).groupBy("token", F.col("g").alias("other")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("m").alias("gm"), F.first("members").alias("size")
    )
    # sizes of members that may link with the class
    low = F.greatest("least", F.ceil(F.lit(percent) * F.col("n") / 100))
    high = F.least("most", F.floor(F.lit(100) * F.col("n") / percent))
    # the bound has its least value at either end; among larger members, up to rounding
    slack = F.when((high > F.col("n")) & (low < high), F.lit(1)).otherwise(F.lit(0))
    needed = F.least(_least_shared(F.col("n"), low, percent), _least_shared(F.col("n"), high, percent) - slack)
    # a class asks the larger group
    asks = (F.col("members") < F.col("size")) | ((F.col("members") == F.col("size")) & (F.col("g") < F.col("other")))
    met = postings.join(matrix, "token").where(asks & (low <= high) & (F.least(F.col("gm"), F.col("m") - F.col("i")) >= needed))
    # met and opened are each read twice or more below; planned anew each time, their joins and broadcasts fill the driver
    met = stored(met.groupBy("h", "n", "m", "other").agg(F.min(needed).alias("needed")), "met")
    mine = postings.select(F.col("h").alias("h2"), "i", "token")
    bound = _shared_with_groups(met, known, mine, postings.select(F.col("token").alias("t2"), F.col("g").alias("g2")).distinct())
    opened = stored(bound.where(F.col("shared") >= F.col("needed")).select("h", "n", "m", "other"), "opened")
    # the members that may qualify: all of a small group; of a larger one, those that share an early shingle
    needed = _least_shared(F.col("n"), F.col("pn"), percent)
    fits = _may_reach(F.col("n"), F.col("pn"), percent) & (F.least("m", "pm") >= needed)
    theirs = known.select(F.col("g").alias("other"), "members", F.col("h").alias("p"), F.col("n").alias("pn"), F.col("m").alias("pm"), F.col("tokens").alias("y"))
    all_of = opened.join(theirs.where(F.col("members") <= FEW_MEMBERS).drop("members"), "other").where(fits).select("h", "p", needed.alias("needed"), "y")
    large = known.where(F.col("members") > FEW_MEMBERS).select(F.col("g").alias("other")).distinct()
    others = postings.select(F.col("token").alias("t2"), F.col("h").alias("p"), F.col("n").alias("pn"), F.col("g").alias("pg"), F.col("m").alias("pm"), F.col("i").alias("j"))
    asking = opened.join(large, "other").join(mine, (F.col("h") == F.col("h2")) & (F.col("i") <= F.col("m") - lowest))
    pairs = asking.join(others, (F.col("token") == F.col("t2")) & (F.col("other") == F.col("pg")))
    pairs = pairs.where(fits & (F.col("i") <= F.col("m") - needed) & (F.col("j") <= F.col("pm") - needed))
    pairs = pairs.groupBy("h", "p").agg(F.min(needed).alias("needed")).join(theirs.select("p", "y"), "p").select("h", "p", "needed", "y")
    # then by all their first shingles
    pairs = all_of.unionByName(pairs).join(known.select("h", F.col("tokens").alias("x")), "h").where(F.size(F.array_intersect("x", "y")) >= F.col("needed"))
    return pairs.select(F.greatest("h", "p").alias("a"), F.least("h", "p").alias("b")).distinct()


def _shared_with_groups(met: DataFrame, known: DataFrame, mine: DataFrame, cells: DataFrame) -> DataFrame:
    """met with ``shared``: how many of a class's first shingles the union of the other group has.

    The union of most groups is short: one list beside the class's own.  Those
    of large groups stay rows of the matrix, and the class's shingles meet them one by one.
    """
    wide = known.groupBy("g").agg(F.sum("m").alias("all"))
    unions = known.join(wide.where(F.col("all") <= SHORT_UNION), "g").groupBy(F.col("g").alias("other")).agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union"))
    lists = met.join(unions, "other").join(known.select("h", "tokens"), "h")
    short = lists.select("h", "n", "m", "other", F.size(F.array_intersect("tokens", "union")).cast("long").alias("shared"), "needed")
    large = wide.where(F.col("all") > SHORT_UNION).select(F.col("g").alias("other"))
    rows = met.join(large, "other").join(mine, F.col("h") == F.col("h2")).join(cells, (F.col("token") == F.col("t2")) & (F.col("other") == F.col("g2")))
    return short.unionByName(rows.groupBy("h", "n", "m", "other").agg(F.count(F.lit(1)).alias("shared"), F.min("needed").alias("needed")))


def _least_shared(a: Column, b: Column, percent: int) -> Column:
    """How many first shingles sets of a and b shingles must share to reach the similarity.

    They need ``percent / (100 + percent)`` of a + b in common, and all but
    the first ones of the set whose list ends earlier may be.
    """
    rest = [F.greatest(F.lit(0), F.ceil(F.lit(percent) * n / 100) - SHARED) for n in (a, b)]
    return F.greatest(F.lit(1), F.ceil(F.lit(percent) * (a + b) / (100 + percent)) - F.greatest(*rest))


def verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs a, b of classes whose sets have the similarity."""
    pairs = stored(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct().join(classes.select("h", "_k"), "h")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SHINGLED_BYTES):
            found = shingle_sets(batch.column(1), size)
            # repeated ids may bring another text
            right = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in found]
            right = np.array(right, np.uint64).view(np.int64) == np.asarray(batch.column(0))
            found = [s for s, r in zip(found, right) if r]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(right)), lists], ["h", "tokens"])

    texts = rows.join(_told(stored(wanted, "wanted")), "_k").select("h", "text")  # no text moves while there are few
    tokens = stored(map_arrow(texts, sets, "h long, tokens array<long>"), "sets")
    both = pairs.join(tokens.select(F.col("h").alias("a"), F.col("tokens").alias("x")), "a").join(tokens.select(F.col("h").alias("b"), F.col("tokens").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    sure = both.select("a", "b", common.alias("i"), (F.size("x") + F.size("y")).alias("both"))
    return sure.where(100 * F.col("i") >= percent * (F.col("both") - F.col("i"))).select("a", "b").distinct()


def join(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component (the smallest key reachable by links) of every row."""
    rows = docs.select(F.col(key).alias("_k"), text_or_empty(text).alias("text"))
    signed = stored(signatures(rows, size, percent), "signatures")
    known = signed.where(F.col("_k").isNotNull() & (F.col("n") > 0))
    # of each class the row with the smallest key stands for all
    rest = known.select("h", "_k").join(known.groupBy("h").agg(F.min("_k").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "h")
    classes = known.join(_told(stored(rest.where(F.col("_k") > F.col("least")).select("h", "_k").distinct(), "copies")), ["h", "_k"], "left_anti")
    if not rest.where(F.col("_k") == F.col("least")).groupBy("h").count().where("count > 1").isEmpty():
        classes = stored(classes.dropDuplicates(["h"]), "classes")  # repeated rows
    links = verified(_group_pairs(classes, percent), classes, rows, size, percent)
    links = stored(links, "links")
    groups = stored(components(links).select(F.col("id").alias("h"), "root"), "groups")
    more = verified(_opened_pairs(classes, groups, percent), classes, rows, size, percent)
    joined = components(links.unionByName(more)).select(F.col("id").alias("h"), "root")
    root = classes.select("h", "_k").join(joined, "h", "left").select("h", "_k", F.coalesce("root", "h").alias("root"))
    first = root.groupBy("root").agg(F.min("_k").alias("first"))
    of = root.join(first, "root").select("h", "first")
    found = signed.select("_k", "n", "h").join(of.withColumnRenamed("h", "_h"), (F.col("h") == F.col("_h")) & (F.col("n") > 0), "left")
    own = F.when(F.col("_k").isNotNull(), F.coalesce("first", "_k"))
    return found.select(F.col("_k").alias(key), F.col("n").alias("n_shingles"), own.alias("component"))

