"""Scans of the active graph: reasoning nodes, base facts, rules and evidential edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reasoning_nodes(labels: dict[str, DataFrame]) -> DataFrame:
    """Current nodes of all labels, confidence 1 where none is stored."""
    parts = [df.where("valid_to is null").select(F.lit(name).alias("label"), "id", "box", F.coalesce("confidence", F.lit(1.0)).alias("confidence")) for name, df in labels.items()]
    return reduce(DataFrame.unionByName, parts)


def active_boxes(boxes: DataFrame) -> DataFrame:
    out = boxes.where("status = 'active'")
    return (out.where("valid_to is null") if "valid_to" in boxes.columns else out).select("box")


def active_nodes(nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    return nodes.join(active_boxes(boxes), "box", "left_semi")


def base_facts(nodes: DataFrame, evidenced_by: DataFrame) -> DataFrame:
    """Nodes with any evidence, each once."""
    return nodes.join(evidenced_by.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select("id", "confidence")


def group_derivations(derived: DataFrame, active: DataFrame) -> DataFrame:
    """``(rule, head, body, strength)`` of rows ``(conclusion, antecedent, derivation, strength)``.

    Rows without a derivation id are one rule a conclusion; a rule's strength is its least; rules of
    inactive conclusions are dropped.
    """
    rule = F.coalesce("derivation", F.concat(F.lit("by-conclusion:"), F.col("conclusion").cast("string")))
    rows = derived.join(active.select(F.col("id").alias("conclusion")), "conclusion", "left_semi").withColumn("rule", rule)
    return rows.groupBy("rule", F.col("conclusion").alias("head")).agg(F.sort_array(F.collect_set("antecedent")).alias("body"), F.min("strength").alias("strength"))


def rule_rows(rules: DataFrame) -> DataFrame:
    """Rules as body rows, the form that fixpoints read."""
    return rules.select("rule", "head", "strength", F.explode_outer("body").alias("atom"))


def evidential_edges(supports: DataFrame, refutes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Current edges of both signs between current nodes, strength 1 where none is stored."""
    side = lambda df, sign: df.where("valid_to is null").select("src", "dst", F.lit(sign).alias("sign"), F.coalesce("strength", F.lit(1.0)).alias("strength"))
    edges = side(supports, "supports").unionByName(side(refutes, "refutes"))
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "sign", "strength")


def hop(nodes: DataFrame, edges: DataFrame, targets: DataFrame, etype: str | None = None, optional: bool = False) -> DataFrame:
    """One typed hop from ``nodes(id, …)`` over ``edges(src, dst, etype, …)`` to ``targets(id, …)``; ``optional`` keeps starts without one."""
    rows = edges if etype is None else edges.where(F.col("etype") == etype)
    left = nodes.select(*[F.col(c).alias(f"a_{c}") for c in nodes.columns])
    right = targets.select(*[F.col(c).alias(f"b_{c}") for c in targets.columns])
    reach = rows.join(right, F.col("dst") == F.col("b_id"))
    return left.join(reach, F.col("a_id") == F.col("src"), "left" if optional else "inner")


def degrees_above(edges: DataFrame, key: str, least: int) -> DataFrame:
    """``(key, degree)`` with more than ``least`` edges."""
    return edges.groupBy(key).agg(F.count("*").alias("degree")).where(F.col("degree") > least)
