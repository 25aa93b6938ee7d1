"""The revision loop inside tasks, region by region, against plain Python and against the loop of plans."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.catalogue import QUERIES
from tracewright.functions import policy as P
from tracewright.operators import adjudicate as A
from tracewright.plans import fixpoint as X
from tracewright.plans import regions as G
from tracewright.queries import argument


def revised(base, body, hyps, edges, allowed, times=min, energy=False):
    """``(verdicts, retracted, values)`` by whole recomputation on dicts; edges with a sigma come from given sources."""
    gone, governed, rules = set(), {h for _, h, _, _ in body}, {}
    for rule, head, atom, strength in body:
        rules.setdefault((rule, head), [set(), strength])[0].update([atom] if atom is not None else [])
    leads = {}
    for (rule, head), (atoms, strength) in rules.items():
        leads[head, frozenset(atoms)] = max(leads.get((head, frozenset(atoms)), (rule, strength)), (rule, strength))
    stored = {}
    for node, x in base + hyps:
        stored[node] = max(stored.get(node, 0), x)
    while True:
        ground = {}
        for node, x in base:
            if node not in gone:
                ground[node] = max(ground.get(node, 0), x)
        value = dict(ground)
        while True:
            now = dict(value)
            for (head, atoms), (_, strength) in leads.items():
                if head not in gone and all(a in value for a in atoms):
                    now[head] = max(now.get(head, 0), times([*(value[a] for a in atoms), strength]))
            if now.keys() == value.keys() and all(abs(now[k] - value[k]) <= 1e-12 for k in now):
                break
            value = now
        score = {a: value.get(a, 0 if a in governed else stored[a]) for a in stored if a not in gone}

        def inward(sigma, a, sign):
            xs = [w * (given if given is not None else sigma[s]) for s, d, k, w, given in edges if d == a and k == sign and (given is not None or s in sigma)]
            return math.fsum(xs) if energy else 1 - math.prod(1 - x for x in xs)

        sigma = score
        for _ in range(100):
            now = {}
            for a, b in score.items():
                s, t = inward(sigma, a, "supports"), inward(sigma, a, "refutes")
                e = (s - t) ** 2 / (1 + (s - t) ** 2) if energy else abs(s - t)
                now[a] = b + (1 - b) * e if s > t else b - b * e
            still = all(abs(now[a] - sigma[a]) <= 1e-9 for a in now)
            sigma = now
            if still:
                break
        sides = {h: (inward(sigma, h, "supports"), inward(sigma, h, "refutes")) for h, _ in hyps if h in sigma}
        out = {h for h, (s, t) in sides.items() if sigma[h] < 0.5 and t > s and h in allowed}
        if not out:
            return {h: (sigma[h], *sides[h]) for h in sides}, gone, value
        gone |= out


def graphs(seed, n):
    """Regions of chains, cycles, alternatives, equal bodies and arguments about hypotheses."""
    rnd = random.Random(seed)
    for region in range(n):
        names = [f"{region}:{k}" for k in range(rnd.randint(2, 9))]
        weight = lambda: rnd.randint(1, 20) / 20
        base = [(x, weight()) for x in names if rnd.random() < 0.4]
        body = []
        for k in range(rnd.randint(0, 10)):
            atoms, strength = rnd.sample(names, rnd.randint(0, min(3, len(names)))), weight()
            body += [(f"{region}r{k}", head, a, strength) for head in [rnd.choice(names)] for a in atoms or [None]]
        hyps = [(x, weight()) for x in names if rnd.random() < 0.7]
        edges = [(rnd.choice(names), rnd.choice(names), rnd.choice(["supports", "refutes", "other"]), weight(), None) for _ in range(rnd.randint(0, 4))]
        edges += [(f"{region}f{k}", rnd.choice(names), rnd.choice(["supports", "refutes", "refutes"]), weight(), weight()) for k in range(rnd.randint(0, 8))]
        yield region, base, body, hyps, edges, {h for h, _ in hyps if rnd.random() < 0.7}


def tables(spark, made, regions=True):
    flat = lambda k: [(*row, g[0]) for g in made for row in g[k]]
    region = ", region long"
    base = spark.createDataFrame(flat(1), "node string, confidence double" + region)
    body = spark.createDataFrame(flat(2), "rule string, head string, atom string, strength double" + region)
    hyps = spark.createDataFrame(flat(3), "hypothesis string, base double" + region)
    edges = spark.createDataFrame(flat(4), "src string, dst string, sign string, strength double, sigma double" + region).drop("region")
    votes = spark.createDataFrame([(h, "affirm", "affirm") for g in made for h in g[5]], "hypothesis string, llm string, symbolic string")
    return [df if regions else df.drop("region") for df in (base, body, hyps, edges, votes)]


def outcome(out):
    found = {r.hypothesis: (r.acceptability, r.support, r.attack) for r in out.verdicts.collect()}
    return found, {r.node for r in out.retracted.collect()}, {r.node: r.value for r in out.values.collect()}


def alike(got, want, within=1e-6):
    for a, b in zip(got, want):
        assert set(a) == set(b)
        if isinstance(a, dict):
            assert all(a[k] == pytest.approx(b[k], abs=within) for k in a)


@pytest.mark.parametrize("semiring, times, semantics", [(P.GODEL, min, P.DF_QUAD), (P.VITERBI, math.prod, P.QUADRATIC_ENERGY)])
def test_regions_against_plain_python(spark, semiring, times, semantics):
    made = list(graphs(7, 300))
    out = A.revise(*tables(spark, made), semiring=semiring, semantics=semantics)
    want = [{}, set(), {}]
    for _, *parts in made:
        for all_of, some in zip(want, revised(*parts, times, semantics is P.QUADRATIC_ENERGY)):
            all_of.update(some)
    given = {s: w for g in made for s, _, _, _, w in g[4] if w is not None}
    assert len(want[1]) > 50 and out.outcome.status == "converged"
    alike(outcome(out), (want[0], want[1], want[2] | given))


def test_regions_equal_the_loop_of_plans(spark):
    made = list(graphs(11, 12))
    alike(outcome(A.revise(*tables(spark, made))), outcome(A.revise(*tables(spark, made, regions=False))))


def test_blocks_cut_between_regions(monkeypatch):
    """However rows are batched and blocks are cut, a chain of a region stays whole."""
    kinds = {"home": pa.int64(), "kind": pa.int8(), "a": pa.string(), "b": pa.string(), "c": pa.string(), "x": pa.float64(), "y": pa.float64(), "flag": pa.bool_()}
    rows = []
    for home in range(9):
        rows.append((home, G.BASE, f"{home}:0", None, None, 0.9, None, None))
        rows += [(home, G.RULE, f"{home}r{k}", f"{home}:{k + 1}", f"{home}:{k}", 0.9 - k / 100, None, None) for k in range(1 + home % 4)]
    rules = G.Rules(P.GODEL.fold, P.DF_QUAD.sums, P.DF_QUAD.influence, 0.5, X.SAME, 1e-9, 100, 50)
    for block in (1, 4, 1000):
        monkeypatch.setattr(G, "BLOCK", block)
        for size in (1, 2, 3, 7, 100):
            cut = [rows[k : k + size] for k in range(0, len(rows), size)]
            batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds.values())], list(kinds)) for part in cut]
            got = [r for b in G.revise_sorted(rules)(iter(batches)) for r in b.to_pylist()]
            assert sorted((r["node"], r["x"]) for r in got if r["kind"] == G.VALUE) == sorted((f"{h}:{k}", min(0.9, 0.9 - (k - 1) / 100)) for h in range(9) for k in range(2 + h % 4))
            blocks = sum(r["kind"] == G.ROUNDS for r in got)
            assert blocks == 9 if (block, size) == (1, 1) else blocks == 1 if block == 1000 else 1 <= blocks <= 9


def test_strengths_and_lengths_of_chains_have_no_limit(spark):
    n = 3000
    base = spark.createDataFrame([("0", 0.9, 1)], "node string, confidence double, region long")
    body = spark.range(n).selectExpr("concat('r', id) rule", "cast(id + 1 as string) head", "cast(id as string) atom", "0.8D strength", "1L region")
    hyps = spark.createDataFrame([(str(n), 0.4, 1)], "hypothesis string, base double, region long")
    edges = spark.createDataFrame([("f", str(n), "refutes", 0.5, 1.0)], "src string, dst string, sign string, strength double, sigma double")
    votes = spark.createDataFrame([], "hypothesis string, llm string, symbolic string")
    out = A.revise(base, body, hyps, edges, votes)
    assert [(r.acceptability, r.state) for r in out.verdicts.collect()] == [(pytest.approx(0.4), "refuted")]
    with pytest.raises(Exception, match="strength outside"):
        A.revise(base, body, hyps, edges.withColumn("strength", F.lit(1.5)), votes)


def no_rounds(monkeypatch):
    def fail(*args, **kwargs):
        raise AssertionError("a round of the loop costs jobs")

    for name in ("well_founded_support", "valuate", "solve"):
        monkeypatch.setattr(X, name, fail)


def test_revision_of_the_tables_against_plain_python(spark, sf, monkeypatch):
    no_rounds(monkeypatch)
    got = {r.state: (r.hypotheses, r.mean_acceptability) for r in QUERIES["revision_fixpoint"](spark, sf).collect()}
    orders = [(r.o_custkey, r.o_orderdate, r.o_orderkey, r.o_orderstatus, r.o_orderpriority) for r in spark.read.parquet(f"{sf}/orders.parquet").collect()]
    lines, votes, chains, judged = {}, {}, {}, {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        lines.setdefault((r.l_orderkey, r.l_partkey, r.l_suppkey), []).append((r.l_discount, r.l_quantity, r.l_returnflag))
        votes.setdefault(r.l_orderkey, {}).setdefault(r.l_partkey, []).append("R" if r.l_returnflag == "R" else r.l_linestatus)
    for o in sorted(orders):
        chains.setdefault(o[0], []).append(o)
    bears = {}
    for (order, part, box), rows in lines.items():
        sign = "refutes" if max(f for *_, f in rows) == "R" else "supports"
        bears.setdefault(order, []).append((f"{order}-{part}-{box}", order, sign, sum(q for _, q, _ in rows) / len(rows) / 50, 1 - sum(d for d, _, _ in rows) / len(rows)))

    def affirmed(order):
        """Some part's lines say only that it refutes, and not mostly nothing."""
        return order % 3 == 0 and any((n := said.count("R")) and not said.count("O") and said.count("F") <= n for said in votes.get(order, {}).values())

    for chain in chains.values():
        keys = [o[2] for o in chain]
        base = [(keys[0], 0.5 + keys[0] % 50 / 100)] if chain[0][4] != "5-LOW" else []
        body = [(k, k, keys[n - step], 1 - k % 7 / 100) for n, k in enumerate(keys) for step in (1, 2, 3) if 0 <= n - step]
        hyps = [(o[2], 0.4) for o in chain if o[3] == "P"]
        found, _, _ = revised(base, body, hyps, [e for k in keys for e in bears.get(k, [])], {h for h, _ in hyps if affirmed(h)})
        for a, s, t in found.values():
            judged.setdefault("supported" if a >= 0.5 else "refuted" if t > s else "unsupported", []).append(a)
    assert got == {state: (len(xs), pytest.approx(sum(xs) / len(xs), abs=2e-6)) for state, xs in judged.items()}


def test_orders_of_two_customers_are_no_regions(spark, tmp_path):
    line = spark.createDataFrame([(1, 1, 1)], "l_orderkey long, l_partkey long, l_suppkey long")
    for name, orders, lines, apart in (
        ("whole", [(1, 7), (2, 7), (3, None), (4, None)], line, True), ("shared", [(1, 7), (1, 8)], line, False), ("shared with none", [(1, 7), (1, None)], line, False),
        ("vague", [(1, 7)], line.withColumn("l_partkey", F.lit(None).cast("long")), False),
    ):
        spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/{name}/orders.parquet")
        lines.write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        assert argument._customers_apart(spark, f"{tmp_path}/{name}") == apart
