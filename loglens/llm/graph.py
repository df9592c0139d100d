"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, root of every node of the edges (a, b): the smallest id of its component.

    Alternates large and small stars until nothing changes.  A star's minimum
    is a partial aggregate joined back, so a node with very many edges is never
    held by one task; every round is written to the shared folder.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, sign = _kept(now)
    for _ in range(most_rounds):
        if sign[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        after = small.select("e.*").where(F.col("u") != F.col("v")).distinct()
        now, again = _kept(after)
        if again == sign:
            break
        sign = again
    else:
        raise RuntimeError(f"components aren't settled after {most_rounds} rounds")
    roots = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    tops = now.select(F.col("v").alias("id")).distinct().join(roots.select("id"), "id", "left_anti")
    return roots.unionByName(tops.select("id", F.col("id").alias("root")))


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges from the shared folder, with what tells two lists of edges apart."""
    edges = stored(edges, "edges")
    sign = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return edges, tuple(sign)
