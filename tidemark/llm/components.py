"""Connected components by alternating large-star and small-star steps.

Edges stay distributed. A round deals them out by node twice and drops repeats
once; it is written to the shared folder, so the lineage stays short and a lost
executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, session_of

#: Edges of one task, on average, and tasks at least: few edges don't need many tasks.
TASK_EDGES, LEAST_TASKS = 250_000, 6


def _large_star(edges: DataFrame, tasks: int, scratch: Scratch) -> DataFrame:
    """A node's larger neighbours all hang on the smallest around it."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written and joined back: both sides are plain exchanges then, and the rows of a node with very many neighbours can be split.
    least = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int, scratch: Scratch) -> DataFrame:
    """A node and its smaller neighbours all hang on the smallest of these: an edge moves one node."""
    least = scratch.keep(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    return edges.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).coalesce(tasks)


def components(links: DataFrame, scratch: Scratch | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with a link; root is its component's smallest node.

    Links may be null, loops, repeated and in either direction; pairs with a
    null and loops are skipped. An empty table gives an empty result. With
    ``scratch`` the result lasts as long as its tables.
    """
    spark = session_of(links)
    scratch = scratch or Scratch(spark)
    now = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    edges = scratch.keep(now, "links")
    state, before = _state(edges), None
    while state["n"] and before != state:
        tasks = max(LEAST_TASKS, -(-2 * state["n"] // TASK_EDGES))
        own = Scratch(spark)
        hung = own.keep(_large_star(edges, tasks, own).distinct(), "links")
        after = scratch.keep(_small_star(hung, tasks, own).distinct().coalesce(tasks), "links")
        own.drop()
        scratch.drop(edges)
        # Both steps leave the edges of a forest of stars as they are.
        edges, before, state = after, state, _state(after)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
