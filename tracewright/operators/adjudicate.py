"""Adjudication of hypotheses: verdicts, votes, edge plans, the refutation gate and held refutations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import policy as P
from tracewright.functions import scalars as S
from tracewright.plans import fixpoint as X


def assemble_framework(nodes: DataFrame, edges: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arguments and edges whose boxes are active; edges with an end outside are dropped."""
    boxes = active.select("box")
    args = nodes.join(boxes, "box", "left_semi").select("arg", "base")
    kept = edges.join(boxes, "box", "left_semi").join(args.select(F.col("arg").alias("src")), "src", "left_semi")
    return args, kept.join(args.select(F.col("arg").alias("dst")), "dst", "left_semi").select("src", "dst", "sign", "strength")


def verdicts(hypotheses: DataFrame, evidence: DataFrame, semantics: P.Semantics = P.DF_QUAD) -> DataFrame:
    """Verdict per hypothesis where evidence bears on hypotheses only, so that one sweep is the fixpoint.

    ``hypotheses(hypothesis, base)``; ``evidence(hypothesis, base, sign, strength)``.
    """
    inward = evidence.withColumn("x", F.col("strength") * F.col("base")).groupBy("hypothesis").agg(*X.aggregates(semantics))
    both = hypotheses.join(inward, "hypothesis", "left").fillna(0.0, ["support", "attack"])
    sigma = semantics.combine(F.col("base"), F.col("support"), F.col("attack"))
    return judge(both.withColumn("acceptability", S.clamp(sigma)))


def judge(solved: DataFrame) -> DataFrame:
    """Adds band and state to ``(hypothesis, acceptability, support, attack)``."""
    a = F.col("acceptability")
    return solved.select("hypothesis", "acceptability", "support", "attack", S.band(a).alias("band"), S.state(a, F.col("support"), F.col("attack")).alias("state"))


def adjudicate(args: DataFrame, edges: DataFrame, hypotheses: DataFrame, semantics: P.Semantics = P.DF_QUAD, **limits) -> DataFrame:
    """Solve any framework, cyclic ones too, and judge ``hypotheses(hypothesis)``."""
    solved = X.solve(args, edges, semantics, **limits)
    push = edges.join(solved.strengths.select(F.col("arg").alias("src"), "sigma"), "src").withColumn("x", F.col("strength") * F.col("sigma"))
    inward = push.groupBy(F.col("dst").alias("hypothesis")).agg(*X.aggregates(semantics))
    mine = hypotheses.select("hypothesis").join(solved.strengths.select(F.col("arg").alias("hypothesis"), F.col("sigma").alias("acceptability")), "hypothesis")
    return judge(mine.join(inward, "hypothesis", "left").fillna(0.0, ["support", "attack"]))


def tally(votes: DataFrame) -> DataFrame:
    """Panel votes ``(evidence, hypothesis, vote)`` to sign, strength and stability.

    Irrelevant wins only if it has more votes than either side; a tie of the sides supports. Strength is the
    projected probability of the winning side's opinion, discounted by the mean of a column ``reliability``
    where there is one. A sign is stable where the other side has no vote at all.
    """
    side = lambda v: F.count_if(F.col("vote") == v)
    counts = votes.groupBy("evidence", "hypothesis").agg(
        side("supports").alias("positive"), side("refutes").alias("negative"), side("irrelevant").alias("abstained"), F.count("*").alias("n_samples")
    )
    irrelevant = (F.col("abstained") > F.col("positive")) & (F.col("abstained") > F.col("negative"))
    sign = F.when(irrelevant, "irrelevant").when(F.col("negative") > F.col("positive"), "refutes").otherwise("supports")
    most, least = F.greatest("positive", "negative"), F.least("positive", "negative")
    opinion = S.opinion(most, least)
    if "reliability" in votes.columns:
        counts = counts.join(votes.groupBy("evidence", "hypothesis").agg(F.avg("reliability").alias("reliability")), ["evidence", "hypothesis"])
        opinion = S.discount(opinion, F.coalesce("reliability", F.lit(1.0)))
    strength = F.when(irrelevant, 0.0).otherwise(S.projected(opinion))
    stable = F.least("positive", "negative") == 0
    return counts.withColumns({"sign": sign, "strength": strength, "sign_stable": stable})


def first_vote(replies: DataFrame) -> DataFrame:
    """Of several replies of a sample about one pair the first counts: ``(evidence, hypothesis, sample, position, vote)``."""
    return replies.groupBy("evidence", "hypothesis", "sample").agg(F.min_by("vote", "position").alias("vote"))


@dataclass(frozen=True)
class EdgePlan:
    edges: DataFrame
    quarantined: DataFrame


def plan_edges(judged: DataFrame, significance: P.Significance = P.Significance()) -> EdgePlan:
    """Split judged edges into those to write and those held back.

    ``judged(evidence, hypothesis, sign, strength, tier, credibility, reasons)``. A refutation is of high
    stakes, and a support where its hypothesis has no other; high stakes with any provisional reason are
    quarantined. Held edges still count among a hypothesis's supports.
    """
    supports = judged.where("sign = 'supports'").groupBy("hypothesis").agg(F.count("*").alias("supports"))
    rated = judged.where("sign <> 'irrelevant'").join(supports, "hypothesis", "left")
    stakes = F.when((F.col("sign") == "refutes") | (F.coalesce("supports", F.lit(0)) <= 1), "high").otherwise("low")
    rated = rated.withColumns({"stakes": stakes, "significance": significance.of(F.col("tier"), F.col("credibility"))}).drop("supports")
    held = (F.col("stakes") == "high") & (F.size("reasons") > 0)
    return EdgePlan(rated.where(~held), rated.where(held))


def llm_channel(edges: DataFrame) -> DataFrame:
    """``(hypothesis, llm, quoted)``: affirms where a refuter's sign is stable, quoting the strongest; else abstains."""
    firm = (F.col("sign") == "refutes") & F.col("sign_stable")
    vote = F.when(F.count_if(firm) > 0, "affirm").otherwise("abstain")
    order = F.when(firm, F.struct(F.col("strength"), F.col("evidence")))
    return edges.groupBy("hypothesis").agg(vote.alias("llm"), F.max(order)["evidence"].alias("quoted"))


def least_model(facts: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Horn closure of signed atoms: ``facts(query, key, polarity)``, ``rules(query, rule, head_key, head_polarity, key, polarity)``."""
    if rules is None:
        return facts.select("query", "key", "polarity").distinct()
    atom = lambda k, p: F.to_json(F.struct(F.col("query"), F.col(k).alias("key"), F.col(p).alias("polarity")))
    base = facts.select(atom("key", "polarity").alias("node"))
    body = rules.select(F.concat_ws("/", "query", "rule").alias("rule"), atom("head_key", "head_polarity").alias("head"), atom("key", "polarity").alias("atom"))
    held = X.well_founded_support(base, body).select(F.from_json("node", "query string, key string, polarity string").alias("a"))
    return held.select("a.*").distinct()


def _clashes(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("query", "key").agg(F.count_distinct("polarity").alias("n")).where("n > 1").select("query").distinct()


def check_consistency(facts: DataFrame, refuters: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``(query, outcome, symbolic)``: what a refuter ``(query, key, polarity)`` does to the region's model.

    A clash without it is indeterminate; a key the region lacks is unrelated; no clash with it is
    consistent, a clash contradictory. Only a contradiction affirms and only consistency dissents.
    """
    before = _clashes(least_model(facts, rules)).withColumn("bad", F.lit(True))
    after = _clashes(least_model(facts.select("query", "key", "polarity").union(refuters.select("query", "key", "polarity")), rules)).withColumn("worse", F.lit(True))
    known = facts.select("query", "key").distinct().withColumn("known", F.lit(True))
    out = refuters.select("query", "key").distinct().join(known, ["query", "key"], "left").join(before, "query", "left").join(after, "query", "left")
    outcome = F.when(F.col("bad"), "indeterminate").when(F.col("known").isNull(), "unrelated").when(F.col("worse"), "contradictory").otherwise("consistent")
    vote = F.when(F.col("outcome") == "contradictory", "affirm").when(F.col("outcome") == "consistent", "dissent").otherwise("abstain")
    return out.select("query", "key", outcome.alias("outcome")).withColumn("symbolic", vote)


def authorise_panel(panel: DataFrame, gate: P.Gate = P.DEFAULT_GATE) -> DataFrame:
    """Adds ``authorised`` and ``reasons`` to a table with a vote column for each channel that spoke."""
    votes: dict[str, Column] = {c: F.col(c) for c in P.CHANNELS if c in panel.columns}
    ok, reasons = P.authorise(gate, **votes)
    return panel.withColumns({"authorised": ok, "reasons": reasons})


def hold_refutations(judged: DataFrame, authorised: DataFrame, prior: DataFrame) -> DataFrame:
    """A refutation not authorised keeps the prior state (or unsupported) and is marked pending."""
    out = judged.join(authorised.select("hypothesis", "authorised"), "hypothesis", "left").join(prior.select("hypothesis", F.col("state").alias("prior")), "hypothesis", "left")
    held = (F.col("state") == "refuted") & ~F.coalesce(F.col("authorised"), F.lit(False))
    return out.select(
        "hypothesis", "acceptability", F.when(held, F.coalesce("prior", F.lit("unsupported"))).otherwise(F.col("state")).alias("state"), held.alias("pending_refutation")
    )


@dataclass(frozen=True)
class Revision:
    """Outcome of the revision loop, its verdicts, retracted facts ``(node)`` and the values of what still holds."""

    outcome: X.Stabilised
    verdicts: DataFrame
    retracted: DataFrame
    values: DataFrame


def revise(
    base: DataFrame, body: DataFrame, hypotheses: DataFrame, edges: DataFrame, gate_votes: DataFrame,
    gate: P.Gate = P.DEFAULT_GATE, semiring: P.Semiring = P.GODEL, semantics: P.Semantics = P.DF_QUAD, max_rounds: int = 50,
) -> Revision:
    """Retract, recompute support and values, argue, gate, and again until nothing changes.

    ``base(node, confidence)``, ``body(rule, head, atom, strength)``, ``hypotheses(hypothesis, base)``,
    ``edges(src, dst, sign, strength)`` from nodes or hypotheses to hypotheses, ``gate_votes(hypothesis,
    llm, symbolic, ...)``. An argument's base score is its value; without one it is 0 where derivations
    govern it and its stored base elsewhere. A hypothesis whose refutation is authorised is retracted.

    Edges may bring ``sigma``: where not null, the base confidence of a source that nothing derives, bears on
    or retracts, and that ``base`` then need not hold. Ids are text. Where base, body and hypotheses bring a
    column ``region``, no node lies in two regions and neither rules nor edges without a sigma lead from one
    to another: the caller sees to that. Regions are then revised inside tasks, a block of them at a time;
    a region must fit a Python worker. Without it, or with policies that have no array form, a round is a
    number of jobs. Verdicts agree within the tolerance of sweeps, as blocks settle on their own.
    """
    local = all("region" in df.columns for df in (base, body, hypotheses)) and semiring.fold and semantics.sums and semantics.influence
    loop = _revise_regions if local else _revise_rounds
    if "sigma" not in edges.columns:
        edges = edges.withColumn("sigma", F.lit(None).cast("double"))
    return loop(base, body, hypotheses, edges, authorise_panel(gate_votes, gate), semiring, semantics, max_rounds)


def _fixed_sources(edges: DataFrame) -> DataFrame:
    return edges.where("sigma is not null").groupBy(F.col("src").alias("node")).agg(F.max("sigma").alias("confidence"))


def _revise_regions(base: DataFrame, body: DataFrame, hypotheses: DataFrame, edges: DataFrame, panel: DataFrame, semiring: P.Semiring, semantics: P.Semantics, max_rounds: int) -> Revision:
    from tracewright.plans import regions as G
    from tracewright.plans.shipping import ship_package
    from tracewright.plans.storage import observed

    home = F.xxhash64(F.col("region").cast("string"))
    kinds = dict(x.split() for x in G.ROWS.split(", "))

    def rows(df: DataFrame, **cols) -> DataFrame:
        cols = {"home": home} | cols
        return df.select(*[cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    authorised = panel.where("authorised").select("hypothesis", "authorised").distinct()
    args = hypotheses.select(F.col("hypothesis").alias("dst"), home.alias("home")).union(base.select("node", home)).distinct()
    # Edges go where their target lies; one to no argument is dropped.
    met = edges.join(args, "dst")
    given = F.col("sigma").isNotNull()
    flag = F.when(F.col("sign") == "supports", True).when(F.col("sign") == "refutes", False)
    all_rows = [
        rows(base, kind=F.lit(G.BASE), a=F.col("node"), x=F.col("confidence")),
        rows(body, kind=F.lit(G.RULE), a=F.col("rule"), b=F.col("head"), c=F.col("atom"), x=F.col("strength")),
        rows(hypotheses.join(authorised, "hypothesis", "left"), kind=F.lit(G.HYPOTHESIS), a=F.col("hypothesis"), x=F.col("base"), flag=F.col("authorised")),
        rows(met, home=F.col("home"), kind=F.when(given, G.FIXED).otherwise(G.EDGE), a=F.when(~given, F.col("src")), b=F.col("dst"), x=F.col("strength"), y=F.col("sigma"), flag=flag),
    ]
    rules = G.Rules(semiring.fold, semantics.sums, semantics.influence, dict(S.BANDS)["plausible"], X.SAME, X.TOLERANCE, X.SWEEPS, max_rounds)
    ship_package(base.sparkSession)
    found = reduce(DataFrame.union, all_rows).repartition("home").sortWithinPartitions("home").mapInArrow(G.revise_sorted(rules), G.FOUND)
    found, seen = observed(found, "revised", F.max("rounds").alias("rounds"), F.bool_and("settled").alias("settled"))
    of = lambda kind: found.where(F.col("kind") == kind)
    values = of(G.VALUE).select("node", F.col("x").alias("value")).union(_fixed_sources(edges))
    outcome = X.Stabilised("diverged" if seen["settled"] is False else "converged", of(G.RETRACTED).select("node"), seen["rounds"] or 1)
    verdicts = judge(of(G.VERDICT).select(F.col("node").alias("hypothesis"), F.col("x").alias("acceptability"), "support", "attack"))
    return Revision(outcome, verdicts, outcome.state, values)


def _revise_rounds(base: DataFrame, body: DataFrame, hypotheses: DataFrame, edges: DataFrame, panel: DataFrame, semiring: P.Semiring, semantics: P.Semantics, max_rounds: int) -> Revision:
    from tracewright.plans.storage import materialize

    base = materialize(base.select("node", "confidence").union(_fixed_sources(edges)), "revision")
    body = materialize(body.select("rule", "head", "atom", "strength"), "revision")
    edges = materialize(edges.select("src", "dst", "sign", "strength"), "revision")
    allowed = materialize(panel.select("hypothesis", "authorised"), "gate")
    governed = body.select(F.col("head").alias("arg")).distinct().withColumn("governed", F.lit(True))
    latest: dict = {}

    def step(retracted: DataFrame) -> DataFrame:
        facts = base.join(retracted, "node", "left_anti")
        rules = body.join(retracted.select(F.col("node").alias("head")), "head", "left_anti")
        held = X.well_founded_support(facts, rules)
        values = X.valuate(facts, rules, held, semiring)
        stored = hypotheses.select(F.col("hypothesis").alias("arg"), "base").union(base.select("node", "confidence")).groupBy("arg").agg(F.max("base").alias("stored"))
        args = stored.join(values.select(F.col("node").alias("arg"), "value"), "arg", "left").join(governed, "arg", "left")
        args = args.select("arg", F.coalesce("value", F.when(F.col("governed"), 0.0), F.col("stored")).alias("base"))
        args = materialize(args.join(retracted.select(F.col("node").alias("arg")), "arg", "left_anti"), "args")
        found = materialize(adjudicate(args, edges, hypotheses, semantics), "verdicts")
        out = found.where("state = 'refuted'").join(allowed.where("authorised"), "hypothesis", "left_semi").select(F.col("hypothesis").alias("node"))
        latest.update(verdicts=found, values=values)
        return materialize(retracted.union(out).distinct(), "retracted")

    none = materialize(base.where("false").select("node"), "retracted")
    outcome = X.stabilise(none, step, max_rounds, lambda df: X.state_key(df, "node"))
    return Revision(outcome, latest["verdicts"], outcome.state, latest["values"])
