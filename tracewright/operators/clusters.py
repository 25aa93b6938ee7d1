"""Order-dependent clustering of samples, agreement, medoids and content-seeded orders."""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import scalars as S
from tracewright.operators.candidates import nearest
from tracewright.plans.shipping import ship_package
from tracewright.plans.storage import materialize

THRESHOLD = 0.86


#: Rows that are compared with all openers before them at once.
BLOCK = 512


def leaders(vectors: np.ndarray, threshold: float) -> list[int]:
    """Cluster number of each row in order: the first cluster whose opener is near enough, else a new one.

    A block of rows meets the openers before it in one product; only rows that none of these takes are then
    looked at one by one, against the openers of their own block.
    """
    unit = vectors / np.where((n := np.linalg.norm(vectors, axis=1, keepdims=True)) > 0, n, 1)
    openers, held = np.empty_like(unit), 0
    out = np.empty(len(unit), np.int64)
    for at in range(0, len(unit), BLOCK):
        block = unit[at : at + BLOCK]
        found = np.full(len(block), -1)
        for start in range(0, held, 16 * BLOCK):
            rest = np.nonzero(found < 0)[0]
            near = block[rest] @ openers[start : min(held, start + 16 * BLOCK)].T >= threshold
            hit = near.any(axis=1)
            found[rest[hit]] = start + near[hit].argmax(axis=1)
        rest, before = np.nonzero(found < 0)[0], held
        own = block[rest] @ block[rest].T >= threshold
        opened: list[int] = []
        for i, row in enumerate(rest):
            near = np.nonzero(own[i, opened])[0] if opened else ()
            if len(near):
                found[row] = before + near[0]
            else:
                found[row], openers[held] = held, block[row]
                held += 1
                opened.append(i)
        out[at : at + BLOCK] = found
    return out.tolist()


def leader_clusters(rows: DataFrame, group: list[str], order: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``cluster`` to rows with a ``vector``; sequential within a group, parallel over groups."""
    ship_package(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField("cluster", T.IntegerType())])

    def run(pdf):
        pdf = pdf.sort_values(order)
        return pdf.assign(cluster=np.array(leaders(np.stack(pdf["vector"].to_list()).astype(float), threshold), np.int32))

    return rows.groupBy(*group).applyInPandas(run, schema)


def agreement(clustered: DataFrame, group: list[str], n_samples: int) -> DataFrame:
    """Distinct samples of a cluster over samples drawn, 1 at most."""
    share = F.count_distinct("sample") / F.lit(n_samples)
    return clustered.groupBy(*group, "cluster").agg(F.least(F.lit(1.0), share).alias("agreement"))


def medoids(clustered: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The member of each cluster with the greatest mean cosine to the others; first in order among equals.

    The sum of cosines to all members is the product with the sum of their unit vectors, so no pairs are made.
    """
    length = S.norm(F.col("vector"))
    unit = clustered.withColumn("unit", F.transform("vector", lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0)))
    flat = unit.select(*group, "cluster", F.posexplode("unit").alias("d", "x")).groupBy(*group, "cluster", "d").agg(F.sum("x").alias("x"))
    total = flat.groupBy(*group, "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("total"))
    size = unit.groupBy(*group, "cluster").agg(F.count("*").alias("size"))
    keys = [*group, "cluster"]
    scored = unit.join(total, keys).join(size, keys).withColumn("own", S.dot(F.col("unit"), F.col("unit")))
    mean = F.when(F.col("size") > 1, (S.dot(F.col("unit"), F.col("total")) - F.col("own")) / (F.col("size") - 1)).otherwise(0.0)
    ranked = scored.withColumn("mean_cosine", F.round(mean, 9))
    first = Window.partitionBy(*keys).orderBy(F.desc("mean_cosine"), *order)
    return ranked.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "unit", "total", "own")


def consolidate(samples: DataFrame, group: list[str], n_samples: int, threshold: float = THRESHOLD) -> DataFrame:
    """Canonical member, agreement and polarity-twin mark of each cluster of ``(…, polarity, epistemic_class, sample, position, vector)``."""
    parts = [*group, "polarity", "epistemic_class"]
    clustered = leader_clusters(samples, parts, ["sample", "position"], threshold)
    canon = medoids(clustered, parts, ["sample", "position"]).join(agreement(clustered, parts, n_samples), [*parts, "cluster"])
    canon = materialize(canon, "canon")
    marks = _twins(canon, group, parts, threshold).withColumn("twin", F.lit(True))
    keyed = canon.withColumn("__node", _node(parts))
    return keyed.join(marks, "__node", "left").drop("__node").fillna(False, ["twin"])


def _node(parts: list[str]) -> Column:
    return F.to_json(F.struct(*parts, "cluster"))


def _twins(canon: DataFrame, group: list[str], parts: list[str], threshold: float) -> DataFrame:
    """``(__node)`` of clusters that come near to one of another polarity in their group, by products of blocks: pairs are never made."""
    known = canon.where(" and ".join(f"`{c}` is not null" for c in (*group, "polarity")))
    place = lambda polarity: F.to_json(F.struct(*group, F.col(polarity).alias("polarity")))
    others = known.select(*group, F.col("polarity").alias("__other")).distinct()
    asked = known.join(others, group).where("polarity <> __other")
    side = lambda df, polarity: df.select(_node(parts).alias("node"), place(polarity).alias("model"), "vector")
    near = nearest(side(asked, "__other"), side(known, "polarity"), 1, False)
    return near.where(F.col("similarity") >= threshold).select(F.col("hypothesis").alias("__node")).distinct()


def claim_keys(propositions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(proposition, claim)`` with ``claim`` = model#cluster, clustered per model in id order."""
    out = leader_clusters(propositions, ["model"], ["proposition"], threshold)
    return out.select("proposition", F.concat_ws("#", "model", F.col("cluster").cast("string")).alias("claim"))


def require_sampling_diversity(n_samples: int, temperature: float) -> None:
    if n_samples > 1 and temperature <= 0:
        raise ValueError("several samples at temperature 0 are one sample")


def _words(key: str) -> Iterator[int]:
    """Big-endian 32-bit words of SHA-256 of the key, then of ``key|1``, ``key|2`` and so on: a fixed scheme of replayed orders."""
    for block in itertools.count():
        yield from struct.unpack(">8I", hashlib.sha256((f"{key}|{block}" if block else key).encode()).digest())


def content_permutation(key: str, n: int) -> list[int]:
    """The order of ``n`` items for ``key``: from the last place down, each swaps with the place that the next word picks."""
    order = list(range(n))
    for place, word in zip(range(n - 1, 0, -1), _words(key)):
        pick = word % (place + 1)
        order[place], order[pick] = order[pick], order[place]
    return order


def inverse_permutation(order: list[int]) -> list[int]:
    return np.argsort(order).tolist()


def permuted(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ``place``: the position of each row in its group's content-seeded order."""
    ship_package(rows.sparkSession)

    def run(pdf):
        pdf = pdf.sort_values(order)
        return pdf.assign(place=np.array(inverse_permutation(content_permutation(str(pdf[key].iloc[0]), len(pdf))), np.int32))

    return rows.groupBy(key).applyInPandas(run, T.StructType([*rows.schema.fields, T.StructField("place", T.IntegerType())]))
