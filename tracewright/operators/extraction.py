"""From spans to propositions, facts and entities by guided calls to a model.

Every step has the same shape: work that the action log doesn't cover yet is an anti-join, the model is called
in partitions, a failing row fails alone, and what is written comes with the action that made it. Ids derive
from what they name, so a step that is run again writes the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import clusters as K
from tracewright.operators import provenance as O
from tracewright.operators import resolve as R
from tracewright.operators import temporal as T
from tracewright.operators.lifecycle import stale_verifications
from tracewright.plans.storage import materialize
from tracewright.sources import models as M
from tracewright.sources.documents import hash_embedder, reembed

CONTEXT = 8


def _json_list(strings: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(strings, S.ascii_json), ","), F.lit("]"))


def extraction_hash(text: Column, context: Column, context_ids: Column, task: M.Task) -> Column:
    """Identity of an extraction: its inputs, the task's words and schema, and the decoding regime; never its outputs."""
    quoted = lambda x: F.lit(json.dumps(x, sort_keys=True, separators=(",", ":")))
    return S.canonical_hash(
        target_text=S.ascii_json(text), context_text=S.ascii_json(context), context_span_ids=_json_list(context_ids), model=quoted(task.model), schema_version=quoted(task.version),
        prompt_sha=quoted(task.prompt_sha), schema_sha=quoted(task.schema_sha), sampling=quoted(task.sampling),
    )


def keyed_spans(spans: DataFrame, task: M.Task = M.PROPOSE, before: int = CONTEXT) -> DataFrame:
    """``(span_id, document_id, position, text)`` with the texts before each in its document and the hash of its extraction."""
    w = Window.partitionBy("document_id").orderBy("position").rowsBetween(-before, -1)
    near = spans.withColumns({"context": F.array_join(F.collect_list("text").over(w), "\n"), "context_ids": F.collect_list(F.col("span_id").cast("string")).over(w)})
    return near.withColumn("content_hash", extraction_hash(F.col("text"), F.col("context"), F.col("context_ids"), task)).drop("context_ids")


@dataclass(frozen=True)
class Extraction:
    """What a run writes: propositions, their edges to spans, lexemes, actions; and what it purged, could not touch or failed on."""

    propositions: DataFrame
    edges: DataFrame
    lexemes: DataFrame
    actions: DataFrame
    purged: DataFrame
    blocked: DataFrame
    failures: DataFrame


PROPOSITION = "span_id, document_id, ordinal, text, polarity, modality, attribution, scope, epistemic_class, agreement, faithfulness, reasons, vector, model, content_hash".split(", ")


def _consolidated(flat: DataFrame, task: M.Task, threshold: float) -> DataFrame:
    """One row a claim of several samples: the medoid of each cluster, its agreement, and marks of claims whose sign wavers."""
    if task.samples == 1:
        none = F.array().cast("array<string>")
        return flat.withColumns({"agreement": F.lit(None).cast("double"), "reasons": none, "ordinal": F.col("position")})
    K.require_sampling_diversity(task.samples, task.temperature)
    canon = K.consolidate(flat, ["span_id", "document_id", "content_hash"], task.samples, threshold)
    turn = Window.partitionBy("span_id").orderBy("sample", "position", "polarity", "epistemic_class")
    wavers = F.when(F.col("twin"), F.array(F.lit("polarity_unstable"))).otherwise(F.array().cast("array<string>"))
    return canon.withColumns({"reasons": wavers, "ordinal": F.row_number().over(turn) - 1})


def embedded(rows: DataFrame, model: str, embed: Callable) -> DataFrame:
    """Adds ``vector`` and ``model`` to rows with a ``text``."""
    return reembed(rows.withColumns({"vector": F.lit(None).cast("array<double>"), "model": F.lit("")}), model, embed)


def verified(rows: DataFrame, task: M.Task, model: M.Model, source: str = "source") -> DataFrame:
    """Rows with ``faithfulness`` by the verifier's verdict on ``text`` against ``source``; a failed call leaves it null."""
    done, failed = M.ask(rows.drop("faithfulness"), task, task.prompt(source=F.col(source), claim=F.col("text")), model)
    v = F.get("items", 0)
    score = S.faithfulness(v["entailment"], v["polarity_preserved"], v["modality_preserved"])
    done = done.withColumn("faithfulness", score).drop("items")
    return done.unionByName(failed.drop("failure").withColumn("faithfulness", F.lit(None).cast("double")))


def propositionize(
    spans: DataFrame, log: DataFrame, stored: DataFrame, dependents: DataFrame, task: M.Task = M.PROPOSE, verifier: M.Task | None = M.VERIFY, model: M.Model = M.stand_in,
    embed: Callable | None = None, vector_model: str = "hash", threshold: float = K.THRESHOLD,
) -> Extraction:
    """Extract the propositions of spans ``(span_id, document_id, position, text)`` that need it.

    ``log(span_id, content_hash, ts, action, n_outputs, verify_signature)`` and ``stored(proposition, action,
    span_id, …)`` are earlier runs, ``dependents(proposition)`` what later layers rest on. A span whose last
    extraction has the same hash is left alone. One with another hash is purged and extracted again, unless
    something depends on its propositions: then it is blocked. A hash that another span's extraction has, with
    all its outputs still there, is replayed: its texts and marks are copied, vectors are made anew, and its
    faithfulness is kept only if the verifier is the same. The rest is asked of the model, several times if
    the task says so, and verified.
    """
    embed = embed or hash_embedder(16)
    keyed = materialize(keyed_spans(spans, task), "keyed")
    last = T.newest(log.select("span_id", "content_hash", "ts", "action"), ["span_id"], "ts", "action").select("span_id", F.col("content_hash").alias("last_hash"))
    state = materialize(keyed.join(last, "span_id", "left").where("last_hash is null or last_hash <> content_hash"), "pending")
    old = stored.join(state.where("last_hash is not null").select("span_id"), "span_id", "left_semi").select("span_id", "proposition")
    held = old.join(dependents.select("proposition").distinct(), "proposition", "left_semi").select("span_id").distinct()
    blocked = materialize(held, "blocked")
    pending = state.join(blocked, "span_id", "left_anti").drop("last_hash")
    purged = old.join(blocked, "span_id", "left_anti").select("proposition")

    sources = log.join(old.select("span_id").distinct(), "span_id", "left_anti")
    copies = T.replayable(pending.select("content_hash"), sources.select("action", "content_hash", "ts", "n_outputs"), stored.select("action", F.col("proposition").alias("output")))
    signature = verifier.signature if verifier else None
    copies = materialize(copies.select("content_hash", "action").join(sources.select("action", "verify_signature"), "action"), "replayable")
    again = pending.join(copies, "content_hash").drop("text").join(stored.drop("span_id", "document_id", "content_hash", "vector", "model", "position", "proposition"), "action")
    same = F.col("verify_signature").eqNullSafe(F.lit(signature).cast("string"))
    score = F.when(same, F.col("faithfulness"))
    again = again.withColumns({"faithfulness": score, "reasons": S.reassess_reasons(F.col("reasons"), score)})
    again = embedded(again.select(*[c for c in PROPOSITION if c not in ("vector", "model")]), vector_model, embed).withColumn("replayed", F.lit(True))

    asked = pending.join(copies.select("content_hash"), "content_hash", "left_anti").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(task.samples - 1))))
    answers, failures = M.ask(asked, task, task.prompt(context=F.col("context"), target=F.col("text")), model)
    failed = materialize(failures.groupBy("span_id").agg(F.min("failure").alias("failure")), "failures")
    answers = answers.join(failed, "span_id", "left_anti")
    flat = answers.select("span_id", "document_id", "content_hash", "sample", F.posexplode("items").alias("position", "i")).select("span_id", "document_id", "content_hash", "sample", "position", "i.*")
    defaults = {"polarity": "asserted", "modality": "categorical", "attribution": "document", "scope": "", "epistemic_class": "observation"}
    flat = flat.where("trim(text) <> ''").fillna(defaults)
    claims = _consolidated(materialize(embedded(flat, vector_model, embed), "claims"), task, threshold)
    fresh = claims.join(keyed.select("span_id", F.col("text").alias("source")), "span_id")
    if verifier is None:
        fresh = fresh.withColumn("faithfulness", F.lit(None).cast("double"))
    else:
        fresh = verified(fresh, verifier, model)
        share = S.combine_faithfulness(F.col("faithfulness"), F.coalesce("agreement", F.lit(1.0)), F.lit(1.0))
        fresh = fresh.withColumn("faithfulness", share)
    fresh = fresh.withColumn("reasons", S.reassess_reasons(F.col("reasons"), F.col("faithfulness"))).withColumn("replayed", F.lit(False))

    out = fresh.select(*PROPOSITION, "replayed").unionByName(again.select(*PROPOSITION, "replayed"))
    ident = S.uuid5(F.concat_ws(":", F.col("span_id").cast("string"), "content_hash", "ordinal"))
    out = materialize(out.withColumns({"proposition": ident, "routing": S.route_for(F.col("epistemic_class"))}), "propositions")
    made = pending.join(failed, "span_id", "left_anti").join(out.groupBy("span_id").agg(F.count("*").alias("n_outputs"), F.max("replayed").alias("replayed")), "span_id", "left")
    actions = made.join(copies.select("content_hash", F.col("action").alias("reused_from")), "content_hash", "left").select(
        S.uuid5(F.concat_ws(":", F.lit("extract"), F.col("span_id").cast("string"), "content_hash")).alias("action"), F.lit("propositionizer").alias("actor"), F.lit("extract").alias("action_type"),
        "span_id", "content_hash", F.coalesce("n_outputs", F.lit(0)).alias("n_outputs"), F.lit(signature).cast("string").alias("verify_signature"), "reused_from",
    )
    edges = out.select(F.col("proposition").alias("src"), F.col("span_id").cast("string").alias("dst"), F.lit("EVIDENCED_BY").alias("etype"))
    return Extraction(out, edges, out.select("proposition", "document_id", S.lexemes(F.col("text")).alias("lexemes")), actions, purged, blocked, failed)


def backfill_verification(propositions: DataFrame, sources: DataFrame, log: DataFrame, task: M.Task = M.VERIFY, model: M.Model = M.stand_in) -> DataFrame:
    """Propositions whose newest verification has another signature, or that have none, verified anew.

    ``propositions(proposition, span_id, text, reasons, faithfulness)``, ``sources(span_id, source)``,
    ``log(proposition, signature, ts, action)``. Only reasons of faithfulness change.
    """
    never = propositions.select("proposition").join(log.select("proposition"), "proposition", "left_anti")
    due = stale_verifications(log, task.signature).union(never)
    rows = propositions.join(due.distinct(), "proposition", "left_semi").join(sources, "span_id")
    done = verified(rows, task, model)
    return done.withColumn("reasons", S.reassess_reasons(F.col("reasons"), F.col("faithfulness"))).drop("source")


@dataclass(frozen=True)
class FactSet:
    """Facts with their entities, edges and actions, and the propositions whose call failed."""

    facts: DataFrame
    entities: DataFrame
    edges: DataFrame
    actions: DataFrame
    failures: DataFrame


def extract_facts(propositions: DataFrame, spans: DataFrame, log: DataFrame, task: M.Task = M.ENTITIES, model: M.Model = M.stand_in) -> FactSet:
    """One fact for each proposition ``(proposition, box, tier, text, faithfulness)`` that the log has no extraction of.

    ``spans(proposition, span_id, level, compartments)`` seed sensitivity, the least upper bound of the
    sources. A fact starts with one support and its proposition's faithfulness, 1 where that is unknown.
    Entities are not merged here: each fact brings its own.
    """
    work = T.pending(propositions, log, ["proposition"])
    answers, failures = M.ask(work, task, task.prompt(statement=F.col("text")), model)
    bound = O.sensitivity_lub(spans, "proposition")
    fact = S.uuid5(F.concat(F.lit("fact:"), F.col("proposition").cast("string")))
    facts = answers.join(bound, "proposition", "left").select(
        fact.alias("fact"), "proposition", "box", "tier", F.col("text").alias("statement"), F.lit(1).cast("long").alias("support_count"), S.seed_confidence(F.col("faithfulness")).alias("confidence"),
        F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("compartments", F.array().cast("array<string>")).alias("compartments"), "items",
    )
    facts = materialize(facts, "facts")
    named = facts.select("fact", "box", F.posexplode("items").alias("n", "i")).where("trim(i.label) <> ''")
    entity = S.uuid5(F.concat_ws(":", F.lit("entity"), "fact", "n"))
    named = named.select("fact", "box", entity.alias("id"), "i.label", F.coalesce("i.type", F.lit("")).alias("type"), F.coalesce("i.kind", F.lit("object")).alias("kind"), F.coalesce("i.role", F.lit("other")).alias("role"))
    edge = lambda df, src, dst, etype, role: df.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), F.lit(etype).alias("etype"), role.cast("string").alias("role"))
    none = F.lit(None)
    edges = edge(named, "fact", "id", "INVOLVES", F.col("role")).unionByName(edge(facts, "fact", "proposition", "EVIDENCED_BY", none))
    edges = edges.unionByName(edge(facts.select("fact", "proposition").join(spans, "proposition"), "fact", "span_id", "EVIDENCED_BY", none))
    actions = facts.select(S.uuid5(F.concat(F.lit("facts:"), "fact")).alias("action"), F.lit("extractor").alias("actor"), F.lit("extract").alias("action_type"), "proposition", "fact", F.size("items").alias("n_entities"))
    return FactSet(facts.drop("items"), named.select("id", "box", "label", "type", "kind"), edges, actions, failures.select("proposition", "failure"))


def detect_mentions(propositions: DataFrame, task: M.Task = M.MENTIONS, model: M.Model = M.stand_in) -> DataFrame:
    """``(mention, proposition, box, surface, mention_type, kind, norm, tokens)``: what must be resolved to know what a claim is about."""
    answers, _ = M.ask(propositions.select("proposition", "box", "text"), task, task.prompt(statement=F.col("text")), model)
    found = answers.select("proposition", "box", F.posexplode("items").alias("n", "i")).select(
        F.concat_ws("#", F.col("proposition").cast("string"), "n").alias("mention"), "proposition", "box", "i.surface", F.coalesce("i.mention_type", F.lit("definite")).alias("mention_type"), "i.kind",
    )
    norm = S.normalize_label(F.col("surface"))
    return found.withColumn("norm", norm).withColumn("tokens", S.tokens(F.col("norm")))


def bind_box(mentions: DataFrame, entities: DataFrame, owners: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Bind each mention to referents of its box, then the taxonomy: ``(mention, target, score, state, ties, stage)``.

    ``owners(proposition, id)`` are the entities that a proposition's own fact brought along: they are left
    out of its referents before these are grouped, so that no mention binds to itself.
    """
    side = entities.select("box", "kind", "norm", "tokens", "type", F.col("id").alias("target"))
    near = mentions.select("mention", "proposition", "box", F.explode("tokens").alias("token")).join(side.withColumn("token", F.explode("tokens")), ["box", "token"])
    near = near.select("mention", "proposition", "target", "kind", "norm", "tokens", "type").distinct()
    free = near.join(owners.select("proposition", F.col("id").alias("target")), ["proposition", "target"], "left_anti")
    free = free.join(mentions.select("mention", F.col("norm").alias("m_norm"), F.col("tokens").alias("m_tokens"), F.col("kind").alias("m_kind")), "mention")
    free = free.where("m_kind is null or m_kind = kind")
    groups = free.groupBy("mention", "m_norm", "m_tokens", "m_kind", "kind", "norm").agg(F.min(F.col("target").cast("string")).alias("target"), F.first("tokens").alias("tokens"))
    score = S.binding_score(F.col("m_tokens"), F.col("tokens"), F.col("m_norm") == F.col("norm"), F.col("m_kind").eqNullSafe(F.col("kind")))
    graph = R.decide(groups.select("mention", "target", score.alias("score"))).withColumn("stage", F.lit("graph"))
    graph = materialize(graph, "bound")
    rest = mentions.select("mention", "norm", "tokens", F.lit(None).cast("string").alias("type")).join(graph.select("mention"), "mention", "left_anti")
    fallback = R.bind_taxonomy(rest, taxonomy).withColumn("stage", F.lit("taxonomy"))
    found = graph.unionByName(fallback)
    return found.unionByName(mentions.select("mention").join(found.select("mention"), "mention", "left_anti").withColumn("stage", F.lit("unresolved")), allowMissingColumns=True)


def detect_parts(propositions: DataFrame, referents: DataFrame, task: M.Task = M.PARTS, model: M.Model = M.stand_in) -> DataFrame:
    """``(part, whole, meronymy)`` between canonical referents ``(norm, canonical)`` that propositions name; unknown ends and self pairs go."""
    answers, _ = M.ask(propositions.select("proposition", "text"), task, task.prompt(statement=F.col("text")), model)
    said = answers.select(F.explode("items").alias("i")).select("i.child", "i.parent", F.coalesce("i.meronymy", F.lit("component-integral")).alias("meronymy")).distinct()
    return R.endpoints(said, referents)
