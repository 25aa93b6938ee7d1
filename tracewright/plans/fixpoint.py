"""Iterative plans: each round is one DataFrame plan whose result is written to the shared folder.

Convergence is one aggregate a round; no node, edge or label comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.policy import DF_QUAD, GODEL, Semantics, Semiring
from tracewright.functions.scalars import is_transitive
from tracewright.plans.storage import discard, materialize, observed


@dataclass(frozen=True)
class Stabilised:
    """Outcome of a bounded loop: converged, oscillating (with its cycle's length) or diverged."""

    status: str
    state: Any
    rounds: int
    cycle: int = 0


def stabilise(initial: Any, step: Callable[[Any], Any], max_rounds: int, key: Callable[[Any], Hashable]) -> Stabilised:
    """Repeat ``step`` until the state's key repeats: at once is convergence, later an oscillation."""
    state, seen = initial, {key(initial): 0}
    for n in range(1, max_rounds + 1):
        state = step(state)
        k = key(state)
        if k in seen:
            cycle = n - seen[k]
            return Stabilised("converged" if cycle == 1 else "oscillating", state, n, 0 if cycle == 1 else cycle)
        seen[k] = n
    return Stabilised("diverged", state, max_rounds)


def _key(*cols: str) -> tuple:
    return F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h")


def state_key(df: DataFrame, *cols: str) -> tuple:
    """Row count and order-free hash of a table, as a state's key."""
    row = df.agg(*_key(*cols)).first()
    return row["n"], row["h"]


#: Rounds whose results are written together, so that what a loop has found is a few tables however long it runs.
TOGETHER = 8


def well_founded_support(base: DataFrame, body: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Least fixpoint ``(node, round)`` of Horn rules over base facts.

    ``base(node)``; ``body(rule, head, atom)`` has one row an antecedent, a null atom for a rule without
    any. A rule fires once all its distinct antecedents hold, so circular support never starts itself.
    Semi-naive: a round joins the body with the nodes that were new in the round before.
    """
    links = materialize(body.select("rule", "head", "atom").distinct(), "links")
    facts = base.select("node").where("node is not null").distinct()
    left = links.groupBy("rule", "head").agg(F.count("atom").alias("left"))
    left = left.join(facts.select(F.col("node").alias("head")), "head", "left_anti")
    fired = F.count_if(F.col("left") == 0).alias("fired")
    state = materialize(left.select("rule", "head", "left"), "rules")
    axioms = state.where("left = 0").select(F.col("head").alias("node")).distinct()
    delta = materialize(facts.union(axioms).withColumn("round", F.lit(0)), "support")
    written, rounds, spent = delta, [], []
    for n in range(1, max_rounds + 1):
        # Rules of a supported head have nothing left to say, so what fires next is new by itself.
        open_rules = state.where("left > 0").join(delta.select(F.col("node").alias("head")), "head", "left_anti")
        met = links.join(delta.select(F.col("node").alias("atom")), "atom").groupBy("rule").agg(F.count("*").alias("met"))
        nxt = open_rules.join(met, "rule", "left").select("rule", "head", (F.col("left") - F.coalesce("met", F.lit(0))).alias("left"))
        spent.append(state)
        state, seen = observed(nxt, "rules", fired)
        if not seen["fired"]:
            return reduce(DataFrame.union, [written, *rounds])
        delta = state.where("left = 0").select(F.col("head").alias("node"), F.lit(n).alias("round")).distinct()
        rounds.append(delta)
        if len(rounds) == TOGETHER:
            written, rounds = materialize(reduce(DataFrame.union, [written, *rounds]), "support"), []
            for table in spent:
                discard(table)
            spent = []
    raise RuntimeError("support did not settle")


def support_counts(base: DataFrame, body: DataFrame, supported: DataFrame) -> DataFrame:
    """``(node, support_count)``: 1 for a base fact, plus fired rules that differ in their body."""
    sets = body.groupBy("rule", "head").agg(F.sort_array(F.collect_set("atom")).alias("atoms"), F.count_distinct("atom").alias("need"))
    held = body.select("rule", "atom").distinct().join(supported.select(F.col("node").alias("atom")), "atom").groupBy("rule").agg(F.count("*").alias("met"))
    fired = sets.join(held, "rule", "left").where("coalesce(met, 0) = need").select(F.col("head").alias("node"), "atoms").distinct()
    one = base.select("node").distinct().withColumn("n", F.lit(1).cast("long"))
    return fired.groupBy("node").agg(F.count("*").alias("n")).unionByName(one).groupBy("node").agg(F.sum("n").alias("support_count"))


def over_delete(gone: DataFrame, body: DataFrame) -> DataFrame:
    """Nodes whose support may rest on ``gone(node)``: heads reached through any rule, transitively."""
    links = materialize(body.select("head", "atom").distinct(), "links")
    count = F.count(F.lit(1)).alias("n")
    delta, seen = observed(gone.select("node").distinct(), "deleted", count)
    written, recent = delta, []
    while seen["n"]:
        heads = links.join(delta.select(F.col("node").alias("atom")), "atom").select(F.col("head").alias("node")).distinct()
        delta, seen = observed(heads.join(reduce(DataFrame.union, [written, *recent]), "node", "left_anti"), "deleted", count)
        recent.append(delta)
        if len(recent) == TOGETHER:
            written, recent = materialize(reduce(DataFrame.union, [written, *recent]), "deleted"), []
    return reduce(DataFrame.union, [written, *recent])


def maintain_support(held: DataFrame, base: DataFrame, body: DataFrame, new_base: DataFrame, new_body: DataFrame) -> DataFrame:
    """``(node, support_count)`` of the new snapshot from that of the old one: over-delete, re-derive, cascade inserts.

    ``held(node, …)`` is what the old snapshot supports. Only rules that a changed node or a changed rule
    touches are looked at again: nodes shaken by what went lose their support until a rule over firm nodes
    gives it back, new facts and rules add theirs, and counts are taken anew for heads of touched rules only
    where ``held`` brings its counts along.
    """
    cols = ["rule", "head", "atom"]
    lost_facts = base.select("node").join(new_base.select("node"), "node", "left_anti")
    lost_rules = body.select(*cols).exceptAll(new_body.select(*cols))
    shaken = materialize(over_delete(lost_facts.union(lost_rules.select(F.col("head").alias("node"))).distinct(), body), "shaken")
    firm = materialize(held.select("node").join(shaken, "node", "left_anti"), "firm")
    # Heads that are firm need no rule: what is left to derive are shaken nodes and what new facts and rules reach.
    open_body = new_body.select(*cols).join(firm.select(F.col("node").alias("head")), "head", "left_anti")
    now = materialize(well_founded_support(firm.union(new_base.select("node")).distinct(), open_body).select("node"), "support")
    if "support_count" not in held.columns:
        return support_counts(new_base, new_body, now)
    moved = held.select("node").join(now, "node", "left_anti").union(now.join(held.select("node"), "node", "left_anti"))
    new_rules = new_body.select(*cols).exceptAll(body.select(*cols))
    facts = lost_facts.union(new_base.select("node").join(base.select("node"), "node", "left_anti"))
    heads = body.select(*cols).union(new_body.select(*cols)).join(moved.select(F.col("node").alias("atom")), "atom").select(F.col("head").alias("node"))
    touched = heads.union(lost_rules.union(new_rules).select(F.col("head").alias("node"))).union(facts).union(moved).distinct()
    touched = materialize(touched, "touched")
    again = support_counts(new_base.join(touched, "node", "left_semi"), new_body.join(touched.select(F.col("node").alias("head")), "head", "left_semi"), now)
    kept = held.select("node", "support_count").join(touched, "node", "left_anti")
    return kept.unionByName(again.join(now, "node", "left_semi"))


#: Share of a value by which rounding may move it.
SAME = 1e-12


def valuate(base: DataFrame, body: DataFrame, supported: DataFrame, semiring: Semiring = GODEL, max_rounds: int = 10_000) -> DataFrame:
    """``(node, value)``: the greatest of a base confidence and the values of its rules, by Kleene ascent.

    ``base(node, confidence)``; ``body(rule, head, atom, strength)``. Rules with an antecedent outside
    ``supported`` never count. Rules of one head and equal bodies are one, with the strength of the last by
    id. Values rise until a round changes none. Of a product's last bits the order of rows decides, so a value
    that comes out again within ``SAME`` of what it was stays as it was; else loops would never settle.
    """
    kept = supported.select("node").distinct()
    sets = body.groupBy("rule", "head").agg(F.sort_array(F.collect_set("atom")).alias("atoms"))
    lead = sets.groupBy("head", "atoms").agg(F.max("rule").alias("rule")).select("rule")
    links = body.select("rule", "head", "atom", "strength").join(lead, "rule", "left_semi").join(kept.select(F.col("node").alias("head")), "head", "left_semi")
    size = links.groupBy("rule").agg(F.count("atom").alias("need"))
    links = materialize(links.join(size, "rule"), "links")
    ground = base.join(kept, "node", "left_semi").groupBy("node").agg(F.max("confidence").alias("value"))
    axioms = links.where("need = 0").groupBy(F.col("head").alias("node")).agg(F.max("strength").alias("value"))
    ground, mark = observed(ground.unionByName(axioms).groupBy("node").agg(F.max("value").alias("value")), "ground", *_key("node", "value"))
    values = ground
    for _ in range(max_rounds):
        rules = links.join(values.select(F.col("node").alias("atom"), "value"), "atom").groupBy("rule", "head", "need", "strength")
        rules = rules.agg(F.count("*").alias("met"), semiring.times(F.col("value")).alias("product")).where("met = need")
        heads = rules.select(F.col("head").alias("node"), semiring.extend(F.col("product"), F.col("strength")).alias("value"))
        before = values.select("node", F.lit(None).cast("double").alias("value"), F.col("value").alias("before"))
        risen = ground.unionByName(heads).unionByName(before, allowMissingColumns=True).groupBy("node").agg(semiring.plus(F.col("value")).alias("now"), F.max("before").alias("before"))
        kept = F.when(F.abs(F.col("now") - F.col("before")) <= SAME * F.abs("before"), F.col("before")).otherwise(F.col("now"))
        nxt, now = observed(risen.where("now is not null").select("node", kept.alias("value")), "values", *_key("node", "value"))
        if values is not ground:
            discard(values)
        values = nxt
        if now == mark:
            return values
        mark = now
    raise RuntimeError("values did not settle")


#: Movement of a strength that counts as none, and sweeps at most.
TOLERANCE, SWEEPS = 1e-9, 100


@dataclass
class Solved:
    """Strengths ``(arg, base, sigma)``, sweeps run, whether they settled, arguments still moving, and the last sweeps."""

    strengths: DataFrame
    sweeps: int
    settled: bool
    unstable: DataFrame
    tail: DataFrame


def sweep(state: DataFrame, edges: DataFrame, semantics: Semantics) -> DataFrame:
    """One synchronous update of ``(arg, base, sigma)`` along ``(src, dst, sign, strength)``."""
    push = edges.join(state.select(F.col("arg").alias("src"), "sigma"), "src").withColumn("x", F.col("strength") * F.col("sigma"))
    inward = push.groupBy(F.col("dst").alias("arg")).agg(*aggregates(semantics))
    both = state.join(inward, "arg", "left").fillna(0.0, ["support", "attack"])
    moved = semantics.combine(F.col("base"), F.col("support"), F.col("attack"))
    return both.select("arg", "base", moved.alias("sigma"), F.col("sigma").alias("before"))


def aggregates(semantics: Semantics) -> list:
    side = lambda sign: semantics.aggregate(F.when(F.col("sign") == sign, F.col("x")))
    return [side("supports").alias("support"), side("refutes").alias("attack")]


def solve(args: DataFrame, edges: DataFrame, semantics: Semantics = DF_QUAD, max_sweeps: int = SWEEPS, tolerance: float = TOLERANCE, keep_last: int = 0) -> Solved:
    """Strengths of ``args(arg, base)`` under ``edges(src, dst, sign, strength)`` by synchronous sweeps.

    Edges with an end that is no argument are ignored; a strength outside 0..1 is an error. Stops once no
    strength moves by more than ``tolerance``; after ``max_sweeps`` the arguments that one more sweep still
    moves are reported. ``keep_last`` sweeps are kept as ``(sweep, arg, sigma)``.
    """
    valid = F.when(F.col("strength").between(0, 1), F.col("strength")).otherwise(F.raise_error(F.lit("strength outside 0..1")).cast("double"))
    ids = args.select("arg")
    known = edges.join(ids.withColumnRenamed("arg", "src"), "src", "left_semi").join(ids.withColumnRenamed("arg", "dst"), "dst", "left_semi")
    links = materialize(known.select("src", "dst", "sign", valid.alias("strength")), "edges")
    state = materialize(args.select("arg", "base", F.col("base").alias("sigma")), "sigma")
    tail: list[DataFrame] = [state.select(F.lit(0).alias("sweep"), "arg", "sigma")] if keep_last else []
    held: list[DataFrame] = []
    moving = F.abs(F.col("sigma") - F.col("before")) > tolerance
    for n in range(1, max_sweeps + 1):
        nxt, seen = observed(sweep(state, links, semantics), "sigma", F.count_if(moving).alias("moving"))
        if keep_last:
            tail.append(nxt.select(F.lit(n).alias("sweep"), "arg", "sigma"))
            held.append(state)
            if len(tail) > keep_last:
                tail.pop(0)
                discard(held.pop(0))
        else:
            discard(state)
        state = nxt
        if not seen["moving"]:
            return Solved(state.select("arg", "base", "sigma"), n, True, state.where("false").select("arg"), reduce(DataFrame.union, tail) if tail else None)
    after = sweep(state.select("arg", "base", "sigma"), links, semantics).where(moving).select("arg")
    return Solved(state.select("arg", "base", "sigma"), max_sweeps, False, after, reduce(DataFrame.union, tail) if tail else None)


def run_sweeps(args: DataFrame, edges: DataFrame, sweeps: int, semantics: Semantics = DF_QUAD) -> DataFrame:
    """Exactly ``sweeps`` updates; a plan cut by a written table every other sweep."""
    state = args.select("arg", "base", F.col("base").alias("sigma"))
    for n in range(1, sweeps + 1):
        state = sweep(state, edges, semantics).drop("before")
        if n % 2 == 0 and n < sweeps:
            state = materialize(state, "sigma")
    return state


def tail_variances(tail: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """``(arg, variance, oscillating)`` over the sweeps in ``tail``."""
    spread = tail.groupBy("arg").agg(F.var_pop("sigma").alias("variance"))
    return spread.withColumn("oscillating", F.col("variance") > epsilon)


def oscillation_summary(tail: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """One row: the greatest tail variance, how many arguments oscillate, and whether any does."""
    out = tail_variances(tail, epsilon)
    count = F.count_if("oscillating")
    return out.agg(F.coalesce(F.max("variance"), F.lit(0.0)).alias("max_variance"), count.alias("oscillating"), (count > 0).alias("is_oscillating"))


def oscillating_arguments(tail: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    return tail_variances(tail, epsilon).where("oscillating").select("arg")


def settle_cap(trajectory: DataFrame, window: int = 16, epsilon: float = 1e-6) -> DataFrame:
    """``(settled_cap)``: the first sweep from which no argument's variance over the last ``window`` sweeps exceeds ``epsilon``."""
    over = Window.partitionBy("arg").orderBy("sweep").rowsBetween(-(window - 1), 0)
    spread = trajectory.withColumn("variance", F.var_pop("sigma").over(over))
    return spread.agg((F.coalesce(F.max(F.when(F.col("variance") > epsilon, F.col("sweep"))), F.lit(-1)) + 1).alias("settled_cap"))


def settle_sweep(trajectory: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """``(arg, settled_at)``: the first sweep from which an argument no longer moves."""
    w = Window.partitionBy("arg").orderBy("sweep")
    moved = trajectory.withColumn("moved", F.abs(F.col("sigma") - F.lag("sigma").over(w)) > tolerance)
    return moved.groupBy("arg").agg(F.coalesce(F.max(F.when(F.col("moved"), F.col("sweep"))), F.lit(0)).alias("settled_at"))


def recommend_bound(slowest_settle: int, nice: tuple[int, ...] = (8, 16, 32, 64, 128, 256, 512, 1024)) -> int:
    """The least round figure of at least twice the slowest settling."""
    return next((n for n in nice if n >= 2 * slowest_settle), nice[-1])


def acyclic_edges(edges: DataFrame) -> DataFrame:
    """Edges ``(part, whole)`` whose ends both peel off from the roots down.

    Self-loops go first. A node peels once all its wholes have, so every node on or below a cycle keeps its
    edges out of the closure.
    """
    plain = materialize(edges.select("part", "whole").where("part <> whole").distinct(), "edges")
    nodes = plain.select(F.col("part").alias("node")).union(plain.select(F.col("whole").alias("node"))).distinct()
    roots = nodes.join(plain.select(F.col("part").alias("node")), "node", "left_anti")
    peel = plain.select(F.col("part").alias("rule"), F.col("part").alias("head"), F.col("whole").alias("atom"))
    peeled = materialize(well_founded_support(roots, peel).select("node"), "peeled")
    out = plain.join(peeled.withColumnRenamed("node", "part"), "part", "left_semi")
    return out.join(peeled.withColumnRenamed("node", "whole"), "whole", "left_semi").select("part", "whole")


#: Depth up to which a bounded closure is one plan, whose levels share their exchanges.
ONE_PLAN = 8


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(part, whole, depth)`` of all paths of acyclic edges, with their least length.

    A closure of few levels is a single plan. A deeper one is semi-naive: a round joins the paths of the
    last with the edges and drops those known; what is known is written together every eighth round, so a
    round reads a handful of tables however deep the paths are.
    """
    bounded = max_depth is not None and max_depth <= ONE_PLAN
    plain = edges.select("part", "whole").distinct() if bounded else materialize(edges.select("part", "whole").distinct(), "edges")
    step = plain.select(F.col("part").alias("whole"), F.col("whole").alias("next"))
    # Dealt by their new end, paths are made distinct and joined on without being dealt out again.
    reach = lambda last: last.join(step, "whole").select("part", F.col("next").alias("whole")).repartition("whole").distinct()
    if bounded:
        levels = [plain]
        for _ in range(max_depth - 1):
            levels.append(reach(levels[-1]))
        found = reduce(DataFrame.union, [level.withColumn("depth", F.lit(n)) for n, level in enumerate(levels, 1)])
        return found.groupBy("part", "whole").agg(F.min("depth").alias("depth"))
    delta, depth = plain, 1
    written, recent = plain.withColumn("depth", F.lit(1)), []
    while max_depth is None or depth < max_depth:
        depth += 1
        known = reduce(DataFrame.union, [written, *recent]).select("part", "whole")
        fresh = reach(delta).join(known, ["part", "whole"], "left_anti").withColumn("depth", F.lit(depth))
        fresh, seen = observed(fresh, "paths", F.count(F.lit(1)).alias("n"))
        if not seen["n"]:
            break
        recent.append(fresh)
        delta = fresh.select("part", "whole")
        if len(recent) == TOGETHER:
            written, recent = materialize(reduce(DataFrame.union, [written, *recent]), "paths"), []
    return reduce(DataFrame.union, [written, *recent])


def part_whole_closure(edges: DataFrame) -> DataFrame:
    """Cycle-safe ``(part, whole, depth)`` over component-integral edges."""
    return closure(acyclic_edges(edges.where(is_transitive(F.col("meronymy")))))


def pack_closure(edges: DataFrame) -> DataFrame:
    """All direct edges of any kind, and rollups of two steps and more over component-integral ones that aren't direct."""
    direct = edges.select("part", "whole", "meronymy").distinct().withColumn("anchored", F.lit("direct"))
    rolled = closure(edges.where(is_transitive(F.col("meronymy")))).where("depth > 1").join(direct.select("part", "whole"), ["part", "whole"], "left_anti")
    return direct.unionByName(rolled.select("part", "whole", F.lit("component-integral").alias("meronymy"), F.lit("rollup").alias("anchored")))


def has_cycle(edges: DataFrame) -> bool:
    """Whether some component-integral edge touches a cycle."""
    mine = edges.where(is_transitive(F.col("meronymy"))).select("part", "whole").distinct()
    return not mine.join(acyclic_edges(mine), ["part", "whole"], "left_anti").isEmpty()
