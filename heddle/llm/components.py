"""Connected components of a graph given as a table of edges, by alternating large-star and small-star steps.

Both steps are a minimum for each node (map-side aggregation) and an ordinary join of edges with minima, so a hub with
very many neighbours is never gathered in one task. Each round is written to a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


ROWS_A_TASK = 200_000


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """edges: long columns a, b. Returns node, component (its smallest reachable node) for every node that has an edge to another."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    for _ in range(most_rounds):
        tasks = 2 + state[0] // ROWS_A_TASK  # rounds are short: as many tasks as the edges are worth
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = materialize(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks))
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
