"""Candidate generation: shared entities, nearest vectors, and the funnel that merges them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.plans.shipping import ship_package


def structural_candidates(hypotheses: DataFrame, evidence: DataFrame, involves: DataFrame) -> DataFrame:
    """``(evidence, hypothesis, shared)`` for pairs that involve an entity in common, none with itself.

    ``involves(node, entity)`` is joined with itself on the entity, after both sides were cut to the nodes
    asked for; a hub entity's pairs are the result itself, and adaptive execution may split it.
    """
    left = involves.join(evidence.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("evidence"), "entity").distinct()
    right = involves.join(hypotheses.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("hypothesis"), "entity").distinct()
    pairs = left.join(right, "entity").where("evidence <> hypothesis")
    return pairs.groupBy("evidence", "hypothesis").agg(F.sort_array(F.collect_set("entity")).alias("shared"))


#: Vectors in a block of queries and of rows: what one task multiplies at once.
QUERY_BLOCK, ROW_BLOCK = 1024, 16_384


def _blocks(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Vectors of each model in blocks of about ``size``, a node's in one block, and the number of blocks of each model.

    Models are few, which bounds the second table; a model's blocks are as many as its vectors ask for.
    """
    counts = rows.groupBy("model").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(counts), "model").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cell = F.struct("node", F.xxhash64("model", "vector").alias("key"), F.col("vector").cast("array<double>").alias("vector"))
    return dealt.groupBy("model", "block").agg(F.collect_list(cell).alias("rows")), counts


def _vectors(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in order, the keys of their vectors, and these at unit length (zero where a vector is)."""
    nodes = cell.values.field("node").to_numpy(zero_copy_only=False)
    keys = cell.values.field("key").to_numpy()
    matrix = cell.values.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(nodes), -1)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    order = np.lexsort((keys, nodes)) if nodes.dtype != object else np.argsort(nodes, kind="stable")
    return nodes[order], keys[order], np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)[order]


def nearest(queries: DataFrame, rows: DataFrame, k: int, merge: bool, with_self: bool = False) -> DataFrame:
    """Rows ``(hypothesis, query, evidence, similarity)``: of each block pair the ``k`` nearest, ties by evidence.

    A block of queries is multiplied with a block of rows and only the nearest leave the task: k rows a query
    and block, never the pairs. With ``merge`` the best of a node's vectors is taken before the cut to ``k``;
    without it every query vector, told apart by ``query``, cuts single rows.
    """
    sides = [df.select("node", "model", "vector") for df in (queries, rows)]
    left, _ = _blocks(sides[0], QUERY_BLOCK)
    right, counts = _blocks(sides[1], ROW_BLOCK)
    every = left.join(F.broadcast(counts), "model").select("model", F.col("rows").alias("q"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = every.join(right, ["model", "block"]).select("q", "rows")
    ship_package(queries.sparkSession)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [c.type.value_type.field("node").type for c in batch.columns]
            for asked, held in zip(*batch.columns):
                (q_nodes, q_keys, q), (r_nodes, _, r) = _vectors(asked), _vectors(held)
                scores = np.round(q @ r.T, 12)
                if merge:
                    q_nodes, q_at = np.unique(q_nodes, return_index=True)
                    r_nodes, r_at = np.unique(r_nodes, return_index=True)
                    scores = np.maximum.reduceat(np.maximum.reduceat(scores, q_at, axis=0), r_at, axis=1)
                found: list[tuple] = []
                for name, key, row in zip(q_nodes, q_keys, scores):
                    row = row if with_self else np.where(r_nodes == name, -np.inf, row)
                    least = np.partition(row, -k)[-k] if k < len(row) else -np.inf
                    near = np.nonzero((row >= least) & (row > -np.inf))[0]
                    found += [(name, key, r_nodes[j], row[j]) for j in near[np.argsort(-row[near], kind="stable")][:k]]
                columns = list(zip(*found)) or [[]] * 4
                arrays = [pa.array(c, t) for c, t in zip(columns, (kinds[0], pa.int64(), kinds[1], pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["hypothesis", "query", "evidence", "similarity"])

    own, other = (df.schema["node"].dataType.simpleString() for df in sides)
    return pairs.mapInArrow(compare, f"hypothesis {own}, query long, evidence {other}, similarity double")


def _ranked(best: DataFrame) -> DataFrame:
    order = Window.partitionBy("hypothesis").orderBy(F.desc("similarity"), "evidence")
    return best.withColumn("rank", F.row_number().over(order)).select("evidence", "hypothesis", "similarity", "rank")


def knn_candidates(hypotheses: DataFrame, evidence: DataFrame, k: int = 10, min_similarity: float | None = None) -> DataFrame:
    """``(evidence, hypothesis, similarity, rank)``: exact nearest evidence nodes of each hypothesis.

    Sides are ``(node, model, vector)`` with any number of vectors a node; only vectors of one model are
    compared and a pair of nodes counts by its best two. Hypotheses are the stated queries against all rows.
    """
    best = nearest(hypotheses, evidence, k, True).groupBy("evidence", "hypothesis").agg(F.max("similarity").alias("similarity"))
    return _ranked(best if min_similarity is None else best.where(F.col("similarity") >= min_similarity)).where(F.col("rank") <= k)


def knn_pushdown(hypotheses: DataFrame, evidence: DataFrame, k: int = 10) -> DataFrame:
    """As :func:`knn_candidates`, but every query vector cuts single vectors to ``k`` first and nodes are merged after.

    Where nodes have several vectors fewer than ``k`` nodes may be left of a vector, and more of a node.
    """
    turn = Window.partitionBy("hypothesis", "query").orderBy(F.desc("similarity"), "evidence")
    near = nearest(hypotheses, evidence, k, False).withColumn("r", F.row_number().over(turn)).where(F.col("r") <= k)
    return _ranked(near.groupBy("evidence", "hypothesis").agg(F.max("similarity").alias("similarity")))


def funnel(generators: dict[str, DataFrame], strategy: str = "union") -> DataFrame:
    """``(evidence, hypothesis, sources, shared)`` merged over generators.

    ``intersect`` keeps pairs that every generator with any output proposed; an empty one has no say.
    """
    parts = []
    for name, df in generators.items():
        shared = F.col("shared").cast("array<string>") if "shared" in df.columns else F.array().cast("array<string>")
        parts.append(df.select("evidence", "hypothesis", F.lit(name).alias("source"), shared.alias("shared")))
    pool = parts[0]
    for part in parts[1:]:
        pool = pool.unionByName(part)
    merged = pool.groupBy("evidence", "hypothesis").agg(
        F.sort_array(F.collect_set("source")).alias("sources"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("shared")))).alias("shared")
    )
    if strategy == "intersect":
        speaking = sum(not part.isEmpty() for part in parts)
        merged = merged.where(F.size("sources") == speaking)
    elif strategy != "union":
        raise ValueError(f"unknown strategy {strategy}")
    return merged


def evidence_by_hypothesis(pool: DataFrame) -> DataFrame:
    return pool.groupBy("hypothesis").agg(F.sort_array(F.collect_list("evidence")).alias("evidence"))


def retrieve_topk(chunks: DataFrame, queries: DataFrame, k: int = 8, model: str | None = None) -> DataFrame:
    """``(query, chunk, distance)`` of the ``k`` chunks ``(chunk, vector, …)`` nearest to each of ``queries(query, vector)``."""
    rows = chunks if model is None else chunks.where(F.col("model") == model)
    side = lambda df, name: df.select(F.col(name).alias("node"), F.lit("").alias("model"), "vector")
    near = nearest(side(queries, "query"), side(rows, "chunk"), k, True, with_self=True)
    order = Window.partitionBy("hypothesis").orderBy(F.desc("similarity"), "evidence")
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return near.select(F.col("hypothesis").alias("query"), F.col("evidence").alias("chunk"), (1 - F.col("similarity")).alias("distance"))


def guard_one_model(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` unchanged; evaluating a row of another vector space is an error."""
    other = F.concat(F.lit(f"vector space {model} can't be mixed with "), F.col("model"))
    return rows.withColumn("model", F.when(F.col("model") == model, F.col("model")).otherwise(F.raise_error(other).cast("string")))
