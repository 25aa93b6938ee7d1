"""Persistence and maintenance steps around the kernels: revisions, merges, replays, purges and re-verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import policy as P
from tracewright.operators import temporal as T
from tracewright.plans import fixpoint as X


def value_conclusion(base: DataFrame, body: DataFrame, rule: DataFrame, semiring: P.Semiring = P.GODEL) -> tuple[int, float]:
    """Support count and confidence of one proposed rule's head in a snapshot, ``(0, 0.0)`` if it isn't supported.

    ``rule(rule, head, atom, strength)`` holds one rule; the snapshot itself is not changed.
    """
    both = body.select("rule", "head", "atom", "strength").unionByName(rule.select("rule", "head", "atom", "strength"))
    held = X.well_founded_support(base, both)
    head = rule.select(F.col("head").alias("node")).distinct()
    value = X.valuate(base, both, held, semiring).join(head, "node", "left_semi")
    count = X.support_counts(base, both, held).join(head, "node", "left_semi").join(value, "node").first()
    return (int(count["support_count"]), float(count["value"])) if count else (0, 0.0)


def merge_components(edges: DataFrame, pair: tuple, at: Column) -> DataFrame:
    """Confirm one pair: its open edge becomes confirmed, or a confirmed edge is opened; least id first."""
    a, b = sorted(pair)
    hit = (F.col("a") == a) & (F.col("b") == b) & F.col("valid_to").isNull()
    out = edges.withColumn("state", F.when(hit, "confirmed").otherwise(F.col("state")))
    fresh = edges.sparkSession.range(1).select(
        F.lit(a).cast(edges.schema["a"].dataType).alias("a"), F.lit(b).cast(edges.schema["b"].dataType).alias("b"), F.lit("confirmed").alias("state"),
        at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
    )
    missing = fresh.join(edges.where("valid_to is null").select("a", "b"), ["a", "b"], "left_anti")
    return out.unionByName(missing, allowMissingColumns=True)


def persist_revision(nodes: DataFrame, hypotheses: DataFrame, revision, at: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes and hypotheses after a revision that converged; one that did not is an error and changes nothing.

    Retracted nodes are closed and keep no confidence; the others get their value. Hypotheses get their verdict.
    """
    if revision.outcome.status != "converged":
        raise ValueError(f"revision is {revision.outcome.status}")
    gone = revision.retracted.select(F.col("node").alias("id"), F.lit(True).alias("__gone"))
    value = revision.values.select(F.col("node").alias("id"), F.col("value").alias("__value"))
    out = nodes.join(gone, "id", "left").join(value, "id", "left")
    closed = F.col("__gone") & F.col("valid_to").isNull()
    out = out.withColumns({
        "valid_to": F.when(closed, at).otherwise(F.col("valid_to")),
        "confidence": F.when(F.col("__gone"), 0.0).otherwise(F.coalesce("__value", "confidence")),
    }).drop("__gone", "__value")
    found = revision.verdicts.select("hypothesis", F.col("acceptability").alias("__a"), F.col("state").alias("__s"))
    marked = hypotheses.join(found, "hypothesis", "left")
    return out, marked.withColumns({"acceptability": F.coalesce("__a", "acceptability"), "state": F.coalesce("__s", "state")}).drop("__a", "__s")


def level_readings(nodes: DataFrame, anchors: DataFrame, taxonomy_depth: DataFrame, induced_depth: DataFrame) -> DataFrame:
    """``(id, level, reading)``: the depth of a confirmed anchor first, else the induced one, else none.

    ``anchors(id, target, state)``, ``taxonomy_depth(target, depth)``, ``induced_depth(id, depth)``.
    """
    top = anchors.where("state = 'confirmed'").join(taxonomy_depth, "target").groupBy("id").agg(F.min("depth").alias("anchored"))
    out = nodes.select("id").distinct().join(top, "id", "left").join(induced_depth.select("id", F.col("depth").alias("induced")), "id", "left")
    reading = F.when(F.col("anchored").isNotNull(), "anchored").when(F.col("induced").isNotNull(), "induced").otherwise("none")
    return out.select("id", F.coalesce("anchored", "induced").alias("level"), reading.alias("reading"))


def fact_levels(facts: DataFrame, readings: DataFrame) -> DataFrame:
    """``(fact, levels)``: distinct levels of the entities ``(fact, id)`` involves, ascending."""
    known = facts.join(readings.where("level is not null"), "id")
    return known.groupBy("fact").agg(F.sort_array(F.collect_set("level")).alias("levels"))


def purge_stale(propositions: DataFrame, current_hash: str | Column, dependents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Propositions of another extraction identity: those to purge, and those that something depends on and so block it."""
    stale = propositions.where(F.col("extraction_hash") != current_hash)
    used = dependents.select("proposition").distinct()
    return stale.join(used, "proposition", "left_anti"), stale.join(used, "proposition", "left_semi")


def stale_verifications(log: DataFrame, signature: str) -> DataFrame:
    """Propositions whose newest verification ``(proposition, signature, ts, action)`` has another signature."""
    return T.newest(log, ["proposition"], "ts", "action").where(F.col("signature") != signature).select("proposition")


def expire(table: DataFrame, keys: DataFrame, on: list[str], at: Column) -> DataFrame:
    """Close open rows whose keys are listed."""
    marked = table.join(keys.select(*on).distinct().withColumn("__hit", F.lit(True)), on, "left")
    return marked.withColumn("valid_to", F.when(F.col("__hit") & F.col("valid_to").isNull(), at).otherwise(F.col("valid_to"))).drop("__hit")


def make_session(name: str = "tracewright", **settings: str) -> SparkSession:
    """A session with adaptive execution and UTC; settings override."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
