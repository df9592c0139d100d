"""Exact dedup by a tree-merge of sorted digest runs (DataFrame operations only).

Every input partition makes one run: the digests of its texts, each once, with
the smallest identifier and the number of rows.  The runs are numbered in base
``FAN``; in round r those whose numbers differ in digit r alone meet, and deal
their digests among themselves by digit r of the digest.  A meeting merges
``FAN`` sorted runs into ``FAN`` cells, so a cell stays about as long as a run,
and after as many rounds as the numbers have digits each digest lies in one
cell.  A digest that a third of all rows share is one entry a run from the
start: no task ever gets its rows together.

A digest is the SHA-256 of the text after each ``[\\x20\\x09-\\x0D]+`` became one
space.  At every level entries are one only if their byte lengths and an
independent 64-bit hash agree too.  What was found goes back down the same
tree: an entry takes the result from the one it went into, ``FAN`` to one at
most, and the rows take theirs from the entry of their own run.

Edge cases: a null text counts as empty, and empty texts are equal; the
smallest identifier is the smallest key, among rows with the same key the
first of the input; null keys come last, so they stay only if no other row
has the text; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import stored, text_or_empty

FAN = 16  # a hexadecimal digit a round
SAME = ["sha", "n_bytes", "check"]


def normalised(text: str = "text") -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_k, _at (place in the input), and what tells texts apart, of every row."""
    rows = docs.select(F.col(key).alias("_k"), normalised(text).alias("t"))
    return rows.select(
        "_k",
        F.monotonically_increasing_id().alias("_at"),
        F.unhex(F.sha2("t", 256)).alias("sha"),
        F.octet_length("t").alias("n_bytes"),
        F.xxhash64("t").alias("check"),
    )


def _cell(rounds: int, run: Column) -> Column:
    """The run's number as hexadecimal digits."""
    return F.lpad(F.hex(run), max(1, rounds), "0")


def _met(cell: Column, r: int) -> Column:
    """The cell after round r (from 1): digit r of the run gives way to that of the digest."""
    return F.concat(F.substring(cell, 1, r - 1), F.substring(F.hex("sha"), r, 1), F.expr(f"substring(cell, {r + 1})"))


def _merged(entries: DataFrame) -> DataFrame:
    """Equal entries of a cell as one: the smallest identifier and all rows."""
    return entries.groupBy("cell", *SAME).agg(F.min("least").alias("least"), F.sum("n").alias("n"))


def merge_runs(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """rows with their ``cell``, and the entries of all levels, from the runs to the whole."""
    last = rows.agg(F.max(F.shiftright("_at", 33))).first()[0] or 0
    rounds = len(f"{last:x}") if last else 0
    rows = rows.withColumn("cell", _cell(rounds, F.shiftright("_at", 33)))
    first = rows.select("cell", *SAME, F.struct(F.col("_k").isNull().alias("none"), "_k", "_at").alias("least"), F.lit(1).cast("long").alias("n"))
    levels = [stored(_merged(first), "run")]
    for r in range(1, rounds + 1):
        meeting = levels[-1].withColumn("cell", _met(F.col("cell"), r))
        # whole cells to a task, each merged in the order of its digests
        levels.append(stored(_merged(meeting.repartition("cell")), "run"))
    return rows, levels


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_k, keep (key of the row that stays), group_size, kept and sha of every row."""
    rows, levels = merge_runs(stored(digests(docs, key, text), "digests"))
    found = levels[-1].where("n > 1")
    for r in range(len(levels) - 1, 0, -1):
        above = found.select(F.col("cell").alias("_up"), *(F.col(c).alias(f"_{c}") for c in SAME), "least", "n")
        below = levels[r - 1].select("cell", *SAME, _met(F.col("cell"), r).alias("up"))
        same = [F.col("up") == F.col("_up"), *(F.col(c) == F.col(f"_{c}") for c in SAME)]
        found = below.join(above, same).select("cell", *SAME, "least", "n")
    told = rows.join(found, ["cell", *SAME], "left")
    return told.select(
        "_k",
        F.when(F.col("n").isNull(), F.col("_k")).otherwise(F.col("least._k")).alias("keep"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("least._at") == F.col("_at"), F.lit(True)).alias("kept"),
        "sha",
    )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each different text."""
    told = stored(groups(docs, key, text).where("group_size > 1"), "groups")
    by_row = told.groupBy("_k", "sha").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("times"))
    facts = by_row.where("NOT stays OR times > 1").select(F.col("_k").alias("_key"), F.col("sha").alias("_of"), "stays")
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_own"), F.unhex(F.sha2(normalised(text), 256)).alias("_sha"))
    left = whole.join(facts, F.col("_own").eqNullSafe(F.col("_key")) & (F.col("_sha") == F.col("_of")), "left")
    if by_row.where("stays AND times > 1").isEmpty():
        return left.where(F.col("stays").isNull()).select("_row.*")
    # repeated rows: one of those with the key that stays
    repeated = left.where("stays").groupBy("_own", "_sha").agg(F.first("_row").alias("_row"))
    return left.where(F.col("stays").isNull()).select("_row.*").unionByName(repeated.select("_row.*"))
