"""Action log, provenance chains and audits, credibility, sensitivity and provisional marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import scalars as S

GAPS = ("no_evidence_span", "no_resolvable_source_text", "no_producing_action")
METRICS = ("prompt_tokens", "completion_tokens", "duration_ms")


def provenance_chain(facts: DataFrame, propositions: DataFrame, spans: DataFrame, actions: DataFrame) -> DataFrame:
    """Each fact with its propositions, spans, resolved texts and newest producing action.

    ``facts(fact, box)``, ``propositions(fact, proposition)``, ``spans(fact, span, text)``,
    ``actions(fact, action, ts)``. One aggregation a side and one join each, for a whole box at once.
    """
    p = propositions.groupBy("fact").agg(F.sort_array(F.collect_set("proposition")).alias("propositions"))
    s = spans.groupBy("fact").agg(F.count("span").alias("spans"), F.count("text").alias("texts"))
    a = actions.groupBy("fact").agg(F.max_by("action", F.struct("ts", "action")).alias("action"))
    out = facts.join(p, "fact", "left").join(s, "fact", "left").join(a, "fact", "left")
    return out.fillna(0, ["spans", "texts"])


def audit(chain: DataFrame) -> DataFrame:
    """Adds ``gaps``; missing text is only reported where spans exist."""
    gaps = F.array_compact(F.array(
        F.when(F.col("spans") == 0, GAPS[0]), F.when((F.col("spans") > 0) & (F.col("texts") == 0), GAPS[1]), F.when(F.col("action").isNull(), GAPS[2]),
    ))
    return chain.withColumn("gaps", gaps)


def violations(chain: DataFrame) -> DataFrame:
    return audit(chain).where(F.size("gaps") > 0)


def credibility(facts: DataFrame, boxes: DataFrame, propositions: DataFrame) -> DataFrame:
    """Effective credibility of ``facts(fact, box, alignment)``; of several propositions the first by id speaks."""
    first = propositions.groupBy("fact").agg(F.min_by("epistemic_class", "proposition").alias("epistemic_class"))
    out = facts.join(boxes.select("box", "reliability_prior"), "box", "left").join(first, "fact", "left")
    return out.withColumn("credibility", S.effective_credibility(F.col("reliability_prior"), F.col("epistemic_class"), F.col("alignment")))


def sensitivity_lub(rows: DataFrame, key: str) -> DataFrame:
    """Least upper bound of ``(level, compartments)`` over the antecedents of each key."""
    return rows.groupBy(key).agg(F.max("level").alias("level"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("compartments")))).alias("compartments"))


def provisional_fold(nodes: DataFrame, propositions: DataFrame) -> DataFrame:
    """Sorted distinct reasons of each node's propositions; a node without any lacks provenance."""
    folded = propositions.groupBy("node").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
    missing = F.array(F.lit("missing_provenance"))
    return nodes.select("node").distinct().join(folded, "node", "left").withColumn("reasons", F.coalesce("reasons", missing))


def append_actions(log: DataFrame, actions: DataFrame) -> DataFrame:
    """The log with actions it doesn't hold yet, by id; nothing is changed or removed."""
    return log.unionByName(actions.join(log.select("action"), "action", "left_anti"))


def action_metrics(log: DataFrame, json_col: str = "metrics", by: tuple[str, ...] = ()) -> DataFrame:
    """Sums of reported usage, of all actions or ``by`` some keys; actions that report none of a metric leave it out."""
    return log.groupBy(*by).agg(F.count("*").alias("actions"), *[F.coalesce(F.sum(F.get_json_object(json_col, f"$.{m}").cast("long")), F.lit(0)).alias(m) for m in METRICS])


def json_equals(json_col: str, field: str, value: str) -> Column:
    return F.get_json_object(json_col, f"$.{field}") == value


def counts_by_level(spans: DataFrame) -> DataFrame:
    return spans.groupBy("level").agg(F.count("*").alias("spans"), F.count("text").alias("texts"), F.count_if(F.col("text").isNull()).alias("missing")).orderBy("level")
