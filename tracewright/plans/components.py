"""Connected components by alternating large-star and small-star rounds.

Every round is two key-minimum aggregations (partial sums before the shuffle, so a hub costs one row per
task) and two equi-joins that adaptive execution may split; labels never leave the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.plans.storage import discard, materialize, observed

#: Edges from which the minima are written before they are joined: a join with an aggregate in its own stage can't
#: be split, and a hub's edges would meet in one task; with fewer edges that task is small whatever the hub.
WRITTEN_EDGES = 1_000_000


def _least(rows: DataFrame, written: bool) -> DataFrame:
    low = rows.groupBy("u").agg(F.min("v").alias("m"))
    return materialize(low, "star-least") if written else low


def _large_star(edges: DataFrame, written: bool = False) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _least(both, written).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, written: bool = False) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if written:
        down = materialize(down, "star-large")
    low = _least(down, written)
    hung = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, root)`` for every node of ``edges`` that is not the least of its component.

    Self-loops, repeated edges and rows with a null end change nothing; an empty table gives an empty
    result. Raises if ``max_rounds`` rounds do not settle (rounds grow as the square of log n at most).
    """
    state = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    key = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    current, mark = observed(state, "star", *key)
    for _ in range(max_rounds):
        written = mark["n"] >= WRITTEN_EDGES
        nxt, now = observed(_small_star(_large_star(current, written), written), "star", *key)
        discard(current)
        current = nxt
        if now == mark:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError("components did not settle")
