"""Connected components of an edge table by alternating large and small stars.

Each round is two grouped minima and two joins, all on the JVM; the state is
the edge table, written to the shared folder after every round; the round before
is deleted.  The hub
of a star is a skewed join key, which adaptive execution splits; minima are
combined before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import removed, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(u, v)``; root is the least node.

    Nodes without an edge have no row.  An empty table gives an empty result.
    ``rows`` tells about how many edges there are, if that is known.
    """
    now = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", rows=rows)
    rows = now.count()  # a footer a file
    state = None
    for _ in range(max_rounds):
        before, now = now, written(_small_star(_large_star(now)), "edges", rows=rows)
        removed(before)
        seen = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if seen == state or seen[0] == 0:
            break
        state, rows = seen, seen[0]
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
