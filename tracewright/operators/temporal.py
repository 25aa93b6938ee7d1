"""Bitemporal versions: as-of views, supersession without deletion, upserts and newest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import scalars as S


def as_of(rows: DataFrame, at: Column) -> DataFrame:
    return rows.where(S.as_of(F.col("valid_from"), F.col("valid_to"), at))


def current(rows: DataFrame) -> DataFrame:
    return rows.where(S.current(F.col("valid_to")))


def supersede(rows: DataFrame, changed: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Close the current version of every changed key at ``at`` and open the changed row."""
    touched = changed.select(*keys).distinct().withColumn("__hit", F.lit(True))
    closed = rows.join(touched, keys, "left").withColumn("valid_to", F.when(F.col("__hit") & F.col("valid_to").isNull(), at).otherwise(F.col("valid_to"))).drop("__hit")
    opened = changed.withColumns({"valid_from": at, "valid_to": F.lit(None).cast("timestamp")})
    return closed.unionByName(opened, allowMissingColumns=True)


def newest(rows: DataFrame, keys: list[str], when: str, tie: str) -> DataFrame:
    """The newest row of each key, by aggregation rather than a sorted window."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(when, tie)).alias("__row"))
    return top.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Full replacement of rows by key; new keys are added, others stay."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def upsert_edges(edges: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Upsert by (src, dst, etype); a row without both endpoints does nothing."""
    ids = nodes.select("id")
    known = rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return upsert(edges, known.select(*edges.columns), ["src", "dst", "etype"])


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without ``gone(id)`` and edges without either end among them."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.select(*edges.columns)


def pending(work: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys no logged action has."""
    return work.join(log.select(*keys).distinct(), keys, "left_anti")


def replayable(work: DataFrame, log: DataFrame, outputs: DataFrame) -> DataFrame:
    """``(content_hash, action, outputs)``: the newest logged extraction of the same content whose outputs all still exist.

    ``log(action, content_hash, ts, n_outputs)``, ``outputs(action, output)`` of what exists.
    """
    last = newest(log, ["content_hash"], "ts", "action")
    have = outputs.groupBy("action").agg(F.count_distinct("output").alias("have"))
    whole = last.join(have, "action", "left").where("coalesce(have, 0) = n_outputs and n_outputs > 0")
    return work.select("content_hash").distinct().join(whole, "content_hash").select("content_hash", "action", F.col("have").alias("outputs"))
