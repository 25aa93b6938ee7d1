"""The evidence graph put to work: loads, candidates over the active graph, the judge panel, edges, and contradictions.

The graph is tables: ``nodes(id, label, box, statement, confidence, valid_to)``, ``boxes(box, tier, status)``,
``involves(node, entity, role)``, ``evidenced(node, proposition)`` and ``vectors(proposition, model, vector)``.
A hypothesis is a node with that label; every other reasoning node is evidence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import policy as P
from tracewright.functions import scalars as S
from tracewright.operators import adjudicate as A
from tracewright.operators import candidates as C
from tracewright.operators import clusters as K
from tracewright.operators import resolve as R
from tracewright.plans import fixpoint as X
from tracewright.plans.storage import materialize
from tracewright.sources import models as M
from tracewright.sources import scans

SAMPLES = 5


def co_occurrence(involves: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``contexts(id, context)`` and ``roles(id, role)`` of ``entities(id, box, norm)`` from ``involves(node, entity, role)``.

    A context is the label of another entity of the same box in the same fact. Facts are self-joined on
    their node; equal pairs are one before labels are fetched.
    """
    mine = involves.join(entities.select(F.col("id").alias("entity"), "box"), "entity").select("node", "entity", "box", "role").distinct()
    other = mine.select("node", F.col("entity").alias("other"), "box")
    pairs = mine.select("node", "entity", "box").join(other, ["node", "box"]).where("entity <> other").select("entity", "other").distinct()
    contexts = pairs.join(entities.select(F.col("id").alias("other"), "norm"), "other").select(F.col("entity").alias("id"), F.col("norm").alias("context")).distinct()
    return contexts, mine.where("role is not null").select(F.col("entity").alias("id"), "role").distinct()


def resolve_boxes(entities: DataFrame, involves: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Entity resolution of all boxes at once: SAME_AS edges and one action a box.

    ``entities(id, box, kind, label, type)``. An edge runs from the lesser id to the greater, so a second run
    writes the same one. A box whose entities have no pair has an action too.
    """
    known = entities.withColumn("norm", S.normalize_label(F.col("label"))).withColumn("tokens", S.tokens(F.col("norm")))
    known = known.withColumn("type", F.when(F.col("type") != "", F.col("type")))
    contexts, roles = co_occurrence(involves, known)
    pairs = materialize(R.resolve(known, contexts, roles), "same-as")
    edges = pairs.join(known.select(F.col("id").alias("a"), "box"), "a").select(
        F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("SAME_AS").alias("etype"), "box", "state", F.col("score").alias("strength"), at.alias("valid_from"),
    )
    tally = edges.groupBy("box").agg(F.count_if(F.col("state") == "confirmed").alias("confirmed"), F.count_if(F.col("state") == "candidate").alias("candidate"))
    actions = known.groupBy("box").agg(F.count("*").alias("entities")).join(tally, "box", "left").fillna(0)
    return edges, actions.select(F.lit("entity-resolver").alias("actor"), F.lit("resolve").alias("action_type"), "box", "entities", "confirmed", "candidate")


def node_meta(nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """``(id, label, box, statement, tier)`` of current reasoning nodes."""
    return nodes.where("valid_to is null").join(boxes.select("box", "tier"), "box", "left").select("id", "label", "box", "statement", "tier")


def node_vectors(evidenced: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(node, proposition, model, vector)``: of a proposition in several vector spaces the first model by name counts, so none is mixed."""
    first = vectors.groupBy("proposition").agg(F.min_by(F.struct("model", "vector"), "model").alias("v"))
    return evidenced.select("node", "proposition").distinct().join(first, "proposition").select("node", "proposition", "v.model", "v.vector")


def load_propositions(propositions: DataFrame, edges: DataFrame, box: Column | None = None) -> DataFrame:
    """Propositions with the spans that they are evidenced by, of all boxes or one."""
    spans = edges.where("etype = 'EVIDENCED_BY'").groupBy(F.col("src").alias("proposition")).agg(F.sort_array(F.collect_set("dst")).alias("spans"))
    rows = propositions if box is None else propositions.where(F.col("box") == box)
    return rows.join(spans, "proposition", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<string>")))


def load_entities(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities with the facts that involve them and, through these, their source propositions."""
    involves = edges.where("etype = 'INVOLVES'").select(F.col("src").alias("fact"), F.col("dst").alias("id"))
    sources = edges.where("etype = 'EVIDENCED_BY'").select(F.col("src").alias("fact"), F.col("dst").alias("proposition"))
    return entities.join(involves, "id").join(sources, "fact", "left")


def load_referents(entities: DataFrame) -> DataFrame:
    """Entities of cases ``(id, box, kind, label, type)`` as referents by box, kind and label."""
    known = entities.withColumn("norm", S.normalize_label(F.col("label"))).withColumn("tokens", S.tokens(F.col("norm")))
    return R.group_referents(known)


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    boxes: DataFrame
    involves: DataFrame
    evidenced: DataFrame
    vectors: DataFrame


def split_active(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Current nodes of active boxes ``(node)``: hypotheses and evidence."""
    live = scans.active_nodes(graph.nodes.where("valid_to is null"), graph.boxes).select(F.col("id").alias("node"), "label")
    return live.where("label = 'hypothesis'").select("node"), live.where("label <> 'hypothesis'").select("node")


def generate_candidates(graph: Graph, k: int = 10, strategy: str = "union", pushdown: bool = False, only: DataFrame | None = None) -> DataFrame:
    """The pool ``(evidence, hypothesis, sources, shared)`` over the active graph: shared entities and nearest vectors.

    ``only(hypothesis)`` limits the targets before anything is searched.
    """
    hypotheses, evidence = split_active(graph)
    if only is not None:
        hypotheses = hypotheses.join(only.select(F.col("hypothesis").alias("node")), "node", "left_semi")
    placed = materialize(node_vectors(graph.evidenced, graph.vectors), "node-vectors")
    side = lambda nodes: placed.join(nodes, "node", "left_semi").select("node", "model", "vector")
    near = (C.knn_pushdown if pushdown else C.knn_candidates)(side(hypotheses), side(evidence), k)
    shared = C.structural_candidates(hypotheses, evidence, graph.involves)
    return C.funnel({"embedding": near, "structural": shared}, strategy)


def judge_panel(pool: DataFrame, meta: DataFrame, reliability: DataFrame | None = None, task: M.Task = M.JUDGE, model: M.Model = M.stand_in, samples: int = SAMPLES) -> DataFrame:
    """Judged pairs: :func:`adjudicate.tally` of a blind panel over each hypothesis's evidence.

    Each of ``samples`` members sees all evidence of a hypothesis in an order of its own, seeded by hypothesis
    and sample, numbered from 1. Its first verdict on a number counts, numbers out of range don't, and what it
    leaves out is irrelevant. ``reliability(evidence, reliability)`` discounts. One prompt holds the evidence
    of one hypothesis, which the funnel's ``k`` bounds for nearest vectors but not for shared entities.
    """
    text = meta.select("id", "statement")
    pairs = pool.select("evidence", "hypothesis").join(text.select(F.col("id").alias("evidence"), F.col("statement").alias("said")), "evidence")
    pairs = pairs.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("panel", F.concat_ws("|", F.col("hypothesis").cast("string"), "sample"))
    placed = materialize(K.permuted(pairs, "panel", "evidence"), "panel")
    number = F.col("place") + 1
    line = F.struct("place", F.concat(number.cast("string"), F.lit(". "), F.regexp_replace("said", "\\s+", " ")).alias("line"))
    lines = placed.groupBy("hypothesis", "sample", "panel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("lines"))
    asked = lines.join(text.select(F.col("id").alias("hypothesis"), F.col("statement").alias("claim")), "hypothesis")
    answers, _ = M.ask(asked, task, task.prompt(hypothesis=F.col("claim"), evidence=F.col("lines")), model)
    said = answers.select("panel", F.posexplode("items").alias("position", "i")).select("panel", "position", F.col("i.ref").alias("number"), "i.sign")
    first = said.groupBy("panel", "number").agg(F.min_by("sign", "position").alias("sign"))
    heard = placed.withColumn("number", number).join(answers.select("panel"), "panel", "left_semi").join(first, ["panel", "number"], "left")
    votes = heard.select("evidence", "hypothesis", F.coalesce("sign", F.lit("irrelevant")).alias("vote"))
    if reliability is not None:
        votes = votes.join(reliability, "evidence", "left").fillna(1.0, ["reliability"])
    return A.tally(votes)


@dataclass(frozen=True)
class Produced:
    """Edges to write, pairs dropped as irrelevant, edges held back, and actions by hypothesis."""

    edges: DataFrame
    dropped: DataFrame
    quarantined: DataFrame
    actions: DataFrame


def produce_edges(
    graph: Graph, reliability: DataFrame, reasons: DataFrame, k: int = 10, significance: P.Significance = P.Significance(), task: M.Task = M.JUDGE, model: M.Model = M.stand_in,
    samples: int = SAMPLES, only: DataFrame | None = None,
) -> Produced:
    """Candidates, judged, planned: evidential edges ``(evidence, hypothesis, sign, strength, significance, sign_stable, stakes)``.

    ``reliability(evidence, reliability)`` is the credibility of evidence, ``reasons(evidence, reasons)`` why
    it is provisional. ``only(hypothesis)`` corroborates those hypotheses alone.
    """
    meta = materialize(node_meta(graph.nodes, graph.boxes), "meta")
    pool = materialize(generate_candidates(graph, k, only=only), "pool")
    judged = judge_panel(pool, meta, reliability, task, model, samples).join(meta.select(F.col("id").alias("evidence"), "tier"), "evidence")
    judged = judged.drop("reliability").join(reliability.withColumnRenamed("reliability", "credibility"), "evidence", "left").join(reasons, "evidence", "left")
    judged = materialize(judged.withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>"))), "judged")
    plan = A.plan_edges(judged, significance)
    columns = ["evidence", "hypothesis", "sign", "strength", "significance", "sign_stable", "stakes"]
    edges, held = (materialize(df.select(*columns), "edges") for df in (plan.edges, plan.quarantined))
    dropped = judged.where("sign = 'irrelevant'").select("evidence", "hypothesis")
    told = lambda df, name: df.groupBy("hypothesis").agg(F.count("*").alias(name))
    actions = told(edges.where("sign = 'supports'"), "supporters").join(told(edges.where("sign = 'refutes'"), "refuters"), "hypothesis", "full")
    actions = actions.join(told(held, "quarantined"), "hypothesis", "full").fillna(0).withColumns({"actor": F.lit("edge-judge"), "signature": F.lit(task.signature)})
    return Produced(edges, dropped, held, actions)


def symbolic_queries(edges: DataFrame, evidenced: DataFrame, propositions: DataFrame, vectors: DataFrame, threshold: float = K.THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Sub-regions of hypotheses as signed atoms: facts ``(query, key, polarity)`` of hypothesis and supporters, and refuters.

    A hypothesis's region are the claims ``(proposition, polarity)`` of it, its refuters and its supporters.
    Claims of one region that mean the same, by leader clustering per model, share a key. Nodes without a
    placed claim bring no atom; a region without an atom of the hypothesis or of a refuter asks nothing.
    """
    roles = edges.select(F.col("hypothesis").alias("query"), F.col("evidence").alias("node"), F.when(F.col("sign") == "refutes", "refuter").otherwise("context").alias("role"))
    roles = roles.union(edges.select(F.col("hypothesis").alias("query"), F.col("hypothesis").alias("node"), F.lit("hypothesis").alias("role")).distinct())
    placed = roles.join(node_vectors(evidenced, vectors), "node").join(propositions.select("proposition", F.coalesce("polarity", F.lit("asserted")).alias("polarity")), "proposition")
    region = placed.select("query", "proposition", "model", "vector").distinct()
    keyed = K.leader_clusters(region, ["query", "model"], ["proposition"], threshold)
    keyed = keyed.select("query", "proposition", F.concat_ws("#", "model", F.col("cluster").cast("string")).alias("key"))
    atoms = placed.join(keyed, ["query", "proposition"]).select("query", "role", "key", F.when(F.col("polarity") == "asserted", "+").otherwise("-").alias("polarity")).distinct()
    atoms = materialize(atoms, "atoms")
    whole = atoms.groupBy("query").agg(F.max((F.col("role") == "hypothesis").cast("int")).alias("h"), F.max((F.col("role") == "refuter").cast("int")).alias("r")).where("h = 1 and r = 1")
    asked = atoms.join(whole.select("query"), "query", "left_semi")
    return asked.where("role <> 'refuter'").select("query", "key", "polarity"), asked.where("role = 'refuter'").select("query", "key", "polarity")


def symbolic_votes(facts: DataFrame, refuters: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``(hypothesis, symbolic)``: affirms where any refuting atom contradicts the region, dissents where all that touch it are consistent, else abstains."""
    out = A.check_consistency(facts, refuters, rules).groupBy(F.col("query").alias("hypothesis"))
    said = lambda v: F.count_if(F.col("symbolic") == v) > 0
    return out.agg(F.when(said("affirm"), "affirm").when(said("dissent"), "dissent").otherwise("abstain").alias("symbolic"))


@dataclass(frozen=True)
class Contradiction:
    """What a search for contradictions gathered, decided and changed."""

    produced: Produced
    gate: DataFrame
    revision: A.Revision
    actions: DataFrame


def find_contradictions(
    graph: Graph, targets: DataFrame, propositions: DataFrame, reliability: DataFrame, reasons: DataFrame, base: DataFrame, body: DataFrame, hypotheses: DataFrame, edges: DataFrame,
    gate: P.Gate = P.DEFAULT_GATE, k: int = 10, model: M.Model = M.stand_in, samples: int = SAMPLES, threshold: float = K.THRESHOLD,
) -> Contradiction:
    """Corroborate ``targets(hypothesis)``, gate what refutes them, and revise.

    The new edges replace stored ``edges(src, dst, sign, strength)`` of the same ends. The gate hears the
    language channel from the edges that were written (not those held back), and the symbolic one from the
    sub-region; a target without a refuter is never authorised. The revision is over the whole graph.
    """
    produced = produce_edges(graph, reliability, reasons, k, model=model, samples=samples, only=targets)
    firm = materialize(targets.select("hypothesis").distinct().join(produced.edges, "hypothesis").select("evidence", "hypothesis", "sign", "strength", "sign_stable"), "gathered")
    facts, refuters = symbolic_queries(firm, graph.evidenced, propositions, graph.vectors, threshold)
    llm = A.llm_channel(firm).join(firm.where("sign = 'refutes'").select("hypothesis").distinct(), "hypothesis", "left_semi")
    panel = llm.join(symbolic_votes(facts, refuters), "hypothesis", "left").select("hypothesis", "llm", "quoted", F.coalesce("symbolic", F.lit("abstain")).alias("symbolic"))
    decided = materialize(A.authorise_panel(panel, gate), "gate")
    new = firm.select(F.col("evidence").cast("string").alias("src"), F.col("hypothesis").cast("string").alias("dst"), "sign", "strength")
    both = edges.select("src", "dst", "sign", "strength").join(new, ["src", "dst"], "left_anti").unionByName(new)
    named = decided.select(F.col("hypothesis").cast("string").alias("hypothesis"), "llm", "symbolic")
    revision = A.revise(base, body, hypotheses, materialize(both, "edges"), named, gate)
    count = firm.groupBy("hypothesis").agg(F.count_if(F.col("sign") == "supports").alias("supporters"), F.count_if(F.col("sign") == "refutes").alias("refuters"))
    actions = targets.select("hypothesis").distinct().join(count, "hypothesis", "left").fillna(0).join(decided.select("hypothesis", "authorised", "reasons"), "hypothesis", "left")
    actions = actions.withColumns({"authorised": F.coalesce("authorised", F.lit(False)), "actor": F.lit("find-contradiction")})
    return Contradiction(produced, decided, revision, actions)


def load_and_evaluate(nodes: DataFrame, boxes: DataFrame, supports: DataFrame, refutes: DataFrame, semantics: P.Semantics = P.DF_QUAD, **limits) -> X.Solved:
    """Load everything active and solve it: ``nodes(id, label, box, confidence, valid_to)``, edges ``(src, dst, strength, valid_to)`` of each sign."""
    live = scans.reasoning_nodes({"node": nodes}).select(F.col("id").alias("arg"), F.col("id"), "box", F.col("confidence").alias("base"))
    edges = scans.evidential_edges(supports, refutes, live).join(live.select(F.col("id").alias("src"), "box"), "src")
    args, kept = A.assemble_framework(live, edges, scans.active_boxes(boxes))
    return X.solve(args, kept, semantics, **limits)


def load_derivations(nodes: DataFrame, boxes: DataFrame, evidenced: DataFrame, derived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base facts ``(node, confidence)`` and rules ``(rule, head, atom, strength)`` of the active graph."""
    live = scans.active_nodes(scans.reasoning_nodes({"node": nodes}), boxes)
    base = scans.base_facts(live, evidenced.select(F.col("node").alias("src"))).select(F.col("id").alias("node"), "confidence")
    rules = scans.rule_rows(scans.group_derivations(derived, live))
    return base, rules.join(live.select(F.col("id").alias("atom")), "atom", "left_semi").select("rule", "head", "atom", "strength")


def append_conclusions(base: DataFrame, body: DataFrame, proposals: DataFrame, semiring: P.Semiring = P.GODEL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conclusions, their DERIVED_FROM edges and actions of ``proposals(statement, kind, premise, strength, box)``, a row a premise.

    All are valued in the snapshot with their own rule added. A deduction's strength is 1 where none is
    given, an induction must have one and is provisional. A conclusion that is not supported is written with
    no support and no confidence.
    """
    strength = F.coalesce("strength", F.when(F.col("kind") == "deduced", 1.0).otherwise(F.raise_error(F.lit("an induction needs a strength")).cast("double")))
    ident = S.uuid5(F.concat_ws(":", F.lit("conclusion"), "kind", "box", "statement"))
    rules = proposals.select(ident.alias("head"), "statement", "kind", "box", F.col("premise").cast("string").alias("atom"), strength.alias("strength"))
    rules = materialize(rules.withColumn("rule", F.concat(F.lit("derived:"), "head")), "proposals")
    text = lambda df, *cols: df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    facts = base.select(F.col("node").cast("string").alias("node"), "confidence")
    both = materialize(text(body, "rule", "head", "atom").join(body.select(F.col("rule").cast("string").alias("rule"), "strength").distinct(), "rule").unionByName(rules.select("rule", "head", "atom", "strength")), "body")
    held = materialize(X.well_founded_support(facts, both).select("node"), "support")
    heads = rules.select("head", "statement", "kind", "box").distinct()
    value = X.valuate(facts, both, held, semiring).join(heads.select(F.col("head").alias("node")), "node", "left_semi")
    counts = X.support_counts(facts, both, held).join(value, "node")
    nodes = heads.join(counts.withColumnRenamed("node", "head"), "head", "left").select(
        F.col("head").alias("id"), "box", "statement", F.col("kind").alias("label"), (F.col("kind") == "induced").alias("provisional"),
        F.coalesce("support_count", F.lit(0)).alias("support_count"), F.coalesce("value", F.lit(0.0)).alias("confidence"),
    )
    edges = rules.select(F.col("head").alias("src"), F.col("atom").alias("dst"), F.lit("DERIVED_FROM").alias("etype"), F.col("rule").alias("derivation"), "strength")
    actions = nodes.select(S.uuid5(F.concat(F.lit("derive:"), "id")).alias("action"), F.lit("deriver").alias("actor"), F.col("label").alias("action_type"), F.col("id").alias("conclusion"), "support_count", "confidence")
    return nodes, edges, actions

