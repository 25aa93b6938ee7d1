"""Kernels against small independent restatements, hand-made cases and axioms."""

import hashlib
import json
import math
import random
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import policy as P
from tracewright.functions import scalars as S
from tracewright.operators import adjudicate as A
from tracewright.operators import clusters as K
from tracewright.operators import lifecycle as L
from tracewright.operators import metrics as M
from tracewright.operators import resolve as R
from tracewright.operators import temporal as T
from tracewright.operators import text as X
from tracewright.plans import fixpoint as fix
from tracewright.plans.components import connected_components


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scalars(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    row = one(
        spark, S.normalize_label(F.lit("The  Pump-Station, No. 3")), S.normalize_label(F.lit("the")), S.band(F.lit(0.75)), S.band(F.lit(0.2499)),
        S.cosine(v(0.0, 0.0), v(1.0, 0.0)), S.cosine(v(1.0, 1.0), v(1.0, 0.0)), S.uuid5(F.lit("dés")), S.ascii_json(F.lit('a"\\\né\U0001f600\x01')),
        S.state(F.lit(0.3), F.lit(0.1), F.lit(0.2)), S.faithfulness(F.lit("entailed"), F.lit(False), F.lit(True)), S.information_density(F.lit("In 2020 Bob paid 5% of $30 to NASA")),
        S.projected(S.opinion(F.lit(5), F.lit(0))), S.interest_modifier(F.lit("observation"), F.lit("self")), S.route_for(F.lit("testimony")),
    )
    assert list(row[:4]) == ["pump station no 3", "", "true", "false"]
    assert row[4] == 0 and row[5] == pytest.approx(math.sqrt(0.5))
    assert row[6] == str(uuid.uuid5(uuid.NAMESPACE_URL, "dés")) and row[7] == json.dumps('a"\\\né\U0001f600\x01')
    assert row[8] == "refuted" and row[9] == 0.4 and row[10] == 3 + 2 + 2
    assert row[11] == pytest.approx(6 / 7) and row[12] == 1 and row[13] == "judgement"
    with pytest.raises(Exception, match="outside"):
        one(spark, S.band(F.lit(1.5)))


def test_canonical_hash_is_that_of_sorted_compact_json(spark):
    want = hashlib.sha256(json.dumps({"b": "é", "a": None, "c": 3}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, S.canonical_hash(b=S.ascii_json(F.lit("é")), a=S.ascii_json(F.lit(None).cast("string")), c=F.lit("3")))[0] == want


def df_quad(b, s, a):
    return b + (1 - b) * (s - a) if s > a else b - b * (a - s)


def solve(args, edges, sweeps):
    sigma = dict(args)
    for _ in range(sweeps):
        nxt = {}
        for arg, base in args.items():
            ps = {sign: 1 - math.prod(1 - w * sigma[x] for x, y, g, w in edges if y == arg and g == sign) for sign in ("supports", "refutes")}
            nxt[arg] = df_quad(base, ps["supports"], ps["refutes"])
        sigma = nxt
    return sigma


def frames(spark, args, edges):
    return spark.createDataFrame(list(args.items()), "arg string, base double"), spark.createDataFrame(edges, "src string, dst string, sign string, strength double")


def test_solver_on_cyclic_frameworks(spark):
    cases = {
        "chain": ({"a": 0.8, "b": 0.5, "c": 0.5}, [("a", "b", "supports", 1.0), ("b", "c", "refutes", 0.5), ("z", "c", "supports", 1.0)]),
        "mutual": ({"a": 0.3, "b": 0.3}, [("a", "b", "supports", 0.5), ("b", "a", "supports", 0.5)]),
        "damped": ({"a": 0.5, "b": 0.5}, [("a", "b", "refutes", 0.5), ("b", "a", "refutes", 0.5)]),
    }
    for args, edges in cases.values():
        inside = [e for e in edges if e[0] in args and e[1] in args]
        got = fix.solve(*frames(spark, args, edges))
        assert got.settled and {r.arg: r.sigma for r in got.strengths.collect()} == pytest.approx(solve(args, inside, got.sweeps), abs=1e-9)


def test_undamped_refutation_never_settles_and_its_tail_swings(spark):
    got = fix.solve(*frames(spark, {"a": 1.0, "b": 1.0}, [("a", "b", "refutes", 1.0), ("b", "a", "refutes", 1.0)]), max_sweeps=20, keep_last=16)
    assert not got.settled and got.unstable.count() == 2
    assert {(r.arg, round(r.variance, 9), r.oscillating) for r in fix.tail_variances(got.tail).collect()} == {("a", 0.25, True), ("b", 0.25, True)}
    with pytest.raises(Exception, match="strength"):
        fix.solve(*frames(spark, {"a": 1.0, "b": 1.0}, [("a", "b", "refutes", 1.5)]))


@pytest.mark.parametrize("semantics", [P.DF_QUAD, P.QUADRATIC_ENERGY], ids=lambda s: s.name)
def test_axioms_of_gradual_semantics(spark, semantics):
    values = [0.0, 0.2, 0.5, 0.9, 1.0]
    grid = spark.createDataFrame([(b, s, a) for b in values for s in values for a in values], "b double, s double, a double")
    c = lambda s, a: semantics.combine(F.col("b"), s, a)
    out = grid.select("b", "s", "a", c(F.col("s"), F.col("a")).alias("x"), c(F.col("s") + 0.1, F.col("a")).alias("more"), c(F.col("s"), F.col("a") + 0.1).alias("less"))
    for r in out.collect():
        assert -1e-12 <= r.x <= 1 + 1e-12
        assert r.more >= r.x - 1e-12 and r.less <= r.x + 1e-12
        if r.s == r.a:
            assert r.x == r.b


def test_energy_of_equal_sides_is_level_in_any_order_of_rows(spark):
    rows = [("supports", 0.1), ("supports", 0.2), ("supports", 0.3), ("refutes", 0.3), ("refutes", 0.2), ("refutes", 0.1)]
    ev = spark.createDataFrame([(1, 1.0, *r) for r in rows], "hypothesis long, base double, sign string, strength double").coalesce(1)
    (got,) = A.verdicts(spark.createDataFrame([(1, 0.4)], "hypothesis long, base double"), ev, P.QUADRATIC_ENERGY).collect()
    assert got.support == got.attack == math.fsum([0.1, 0.2, 0.3]) and (got.acceptability, got.state) == (0.4, "unsupported")


def test_exact_sum_is_rounded_once(spark):
    rng = random.Random(9)
    groups = {g: [rng.choice((1, -1, 1e-9, 1e6)) * rng.random() for _ in range(rng.randrange(1, 9))] for g in range(60)} | {60: [1e300, 1.0], 61: [-0.25], 62: [float("nan"), 1.0]}
    frame = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g long, x double").repartition(4)
    for r in frame.groupBy("g").agg(S.exact_sum(F.col("x")).alias("s")).collect():
        assert r.s == pytest.approx(math.fsum(groups[r.g]), abs=1e-15, rel=1e-15, nan_ok=True)
        assert not all(0 <= x <= 1 for x in groups[r.g]) or r.s == math.fsum(groups[r.g])
    assert frame.where("false").agg(S.exact_sum(F.col("x"))).first()[0] == 0.0


def naive_support(base, rules):
    held = set(base)
    while True:
        more = {h for h, body in rules if body <= held} - held
        if not more:
            return held
        held |= more


def rule_frames(spark, base, rules):
    b = spark.createDataFrame([(x, 0.5 + x % 5 / 10) for x in base], "node long, confidence double")
    rows = [(k, h, a, 1 - k % 3 / 10) for k, (h, body) in enumerate(rules) for a in (body or [None])]
    return b, spark.createDataFrame(rows, "rule long, head long, atom long, strength double")


def random_rules(rng, n):
    return [(rng.randrange(n), frozenset(rng.sample(range(n), rng.randrange(0, 4)))) for _ in range(n)]


def test_support_values_and_maintenance_on_random_graphs(spark):
    rng = random.Random(4)
    for n in (6, 14):
        rules = random_rules(rng, n)
        base = set(rng.sample(range(n), 2))
        b, body = rule_frames(spark, base, rules)
        held = fix.well_founded_support(b, body)
        want = naive_support(base, rules)
        assert {r.node for r in held.collect()} == want
        counts = {r.node: r.support_count for r in fix.support_counts(b, body, held).collect()}
        fired = {(h, x) for h, x in rules if x <= want}
        assert counts == {x: (x in base) + sum(h == x for h, _ in fired) for x in want}
        values = {x: (0.5 + x % 5 / 10 if x in base else 0.0) for x in want}
        for _ in range(2 * n):
            for k, (h, x) in enumerate(rules):
                if x <= want:
                    values[h] = max(values[h], min([values[y] for y in x] + [1 - k % 3 / 10]))
        assert {r.node: r.value for r in fix.valuate(b, body, held).collect()} == pytest.approx(values)
        less_rules, less_base = rules[: n // 2] + random_rules(rng, n)[:2], set(list(base)[:1])
        nb, nbody = rule_frames(spark, less_base, less_rules)
        got = fix.maintain_support(held, b, body, nb, nbody)
        assert {r.node for r in got.collect()} == naive_support(less_base, less_rules)


def test_unfounded_cycles_do_not_hold(spark):
    b, body = rule_frames(spark, [0], [(1, frozenset([2])), (2, frozenset([1])), (3, frozenset([0]))])
    assert {r.node for r in fix.well_founded_support(b, body).collect()} == {0, 3}


def test_closure_drops_what_hangs_below_a_cycle(spark):
    rows = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), ("s", "c")]
    edges = spark.createDataFrame([(*r, "component-integral") for r in rows], "part string, whole string, meronymy string")
    got = {(r.part, r.whole, r.depth) for r in fix.part_whole_closure(edges).collect()}
    assert got == {("a", "b", 1), ("b", "c", 1), ("a", "c", 2), ("s", "c", 1)}
    assert fix.has_cycle(edges) and not fix.has_cycle(edges.where("part in ('a', 'b')"))


def test_components_of_random_graphs(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    want = {(x, find(x)) for x in list(root) if find(x) != x}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {(r.node, r.root) for r in got} == want and len(got) == len(want)


def test_stabilise_tells_convergence_oscillation_and_divergence():
    assert fix.stabilise(0, lambda x: min(x + 1, 3), 10, lambda x: x).status == "converged"
    out = fix.stabilise(0, lambda x: (x + 1) % 4, 10, lambda x: x)
    assert (out.status, out.cycle) == ("oscillating", 4)
    assert fix.stabilise(0, lambda x: x + 1, 5, lambda x: x).status == "diverged"
    assert fix.recommend_bound(29) == 64


def test_revision_retracts_what_an_authorised_refutation_reaches(spark):
    base = spark.createDataFrame([("f", 0.9), ("g", 0.9)], "node string, confidence double")
    body = spark.createDataFrame([("r", "h2", "h1", 1.0)], "rule string, head string, atom string, strength double")
    hyp = spark.createDataFrame([("h1", 0.4), ("h2", 0.4)], "hypothesis string, base double")
    edges = spark.createDataFrame([("f", "h1", "refutes", 1.0), ("g", "h2", "supports", 0.2)], "src string, dst string, sign string, strength double")
    votes = spark.createDataFrame([("h1", "affirm", "affirm"), ("h2", "abstain", "abstain")], "hypothesis string, llm string, symbolic string")
    out = A.revise(base, body, hyp, edges, votes)
    assert out.outcome.status == "converged" and {r.node for r in out.retracted.collect()} == {"h1"}
    nodes = spark.createDataFrame([("f", 0.9, None), ("h1", 0.4, None)], "id string, confidence double, valid_to timestamp")
    marks = hyp.select("hypothesis", F.lit(0.0).alias("acceptability"), F.lit("open").alias("state"))
    kept, judged = L.persist_revision(nodes, marks, out, F.current_timestamp())
    assert {(r.id, r.confidence, r.valid_to is None) for r in kept.collect()} == {("f", 0.9, True), ("h1", 0.0, False)}
    assert {r.hypothesis: r.state for r in judged.collect()}["h2"] == "unsupported"
    held = A.revise(base, body, hyp, edges, votes.withColumn("symbolic", F.lit("abstain")))
    assert held.retracted.count() == 0 and held.outcome.status == "converged"


def test_gate_algebra(spark):
    votes = [None, "affirm", "abstain", "dissent"]
    panel = spark.createDataFrame([(a, b, c) for a in votes for b in votes for c in votes], "llm string, symbolic string, temporal string")
    for r in A.authorise_panel(panel).collect():
        assert r.authorised == (r.llm == r.symbolic == "affirm" and r.temporal != "dissent") == (not r.reasons)
    for r in A.authorise_panel(panel, P.STRICT_GATE).collect():
        assert r.authorised == (r.llm == r.symbolic == r.temporal == "affirm")


def test_tally_ties_and_irrelevance(spark):
    rows = [(1, "supports")] * 5 + [(2, "supports"), (2, "refutes")] + [(3, "irrelevant")] * 3 + [(3, "supports")] + [(4, "irrelevant")] * 2 + [(4, "refutes")] * 2
    df = spark.createDataFrame([(e, 0, v) for e, v in rows], "evidence long, hypothesis long, vote string")
    got = {r.evidence: (r.sign, round(r.strength, 3), r.sign_stable) for r in A.tally(df).collect()}
    assert got == {1: ("supports", 0.857, True), 2: ("supports", 0.5, False), 3: ("irrelevant", 0.0, True), 4: ("refutes", 0.75, True)}  # only a split of the sides is unstable


def test_horn_consistency_with_rules(spark):
    facts = spark.createDataFrame([("q", "a", "+"), ("q", "b", "+")], "query string, key string, polarity string")
    rules = spark.createDataFrame([("q", "r1", "c", "+", "a", "+"), ("q", "r1", "c", "+", "b", "+")], "query string, rule string, head_key string, head_polarity string, key string, polarity string")
    check = lambda *atoms: {r.key: r.outcome for r in A.check_consistency(facts, spark.createDataFrame(list(atoms), facts.schema), rules).collect()}
    assert check(("q", "a", "+")) == {"a": "consistent"} and check(("q", "a", "-")) == {"a": "contradictory"} and check(("q", "z", "-")) == {"z": "unrelated"}


def test_opinion_fusion(spark):
    o = lambda p, n: S.opinion(F.lit(float(p)), F.lit(float(n)))
    fused, both = one(spark, P.fuse(F.array(o(3, 1), o(2, 2)), P.cumulative_fuse).alias("a"), o(5, 3).alias("b"))
    assert [fused[k] for k in fused.asDict()] == pytest.approx([both[k] for k in both.asDict()])
    a = one(spark, P.fuse(F.array(o(1, 0), o(1, 0), o(9, 0)), P.averaging_fuse))[0]
    b = one(spark, P.fuse(F.array(o(9, 0), o(1, 0), o(1, 0)), P.averaging_fuse))[0]
    assert a.belief != pytest.approx(b.belief) and a.belief + a.disbelief + a.uncertainty == pytest.approx(1)


def test_segmentation_prefers_valleys_and_splits_long_gaps():
    vectors = np.array([[1, 0], [1, 0], [0, 1], [0, 1], [0, 1]], float)
    assert X.segment(vectors, np.zeros(5), [2], X.Level(0, 50, 0.1, 0.1, 1.0)) in ([(0, 2), (2, 5)], [(0, 5)])
    assert X.segment(vectors, np.zeros(5), [2], X.Level(0, 3, 0.1, 0.1)) == [(0, 2), (2, 5)]
    assert X.segment(np.ones((10, 2)), np.zeros(10), [], X.Level(0, 4, 0.0, 0.0)) == [(0, 4), (4, 8), (8, 10)]
    assert X.segment(np.zeros((0, 2)), np.zeros(0), [], X.Level(0, 4, 0.0, 0.0)) == []


def test_sentences_drop_what_has_no_end(spark):
    df = spark.createDataFrame([(1, "The value is 3.14 units. Next! \nno end here\nLast"), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.doc_id, r.text, r.start) for r in X.sentence_spans(df).collect()]
    assert got == [(1, "14 units.", 15), (1, "Next!", 24), (1, "Last", 44)]


def test_windows(spark):
    df = spark.createDataFrame([(1, 10), (2, 4), (3, 0)], "doc_id long, n_tokens int")
    cut = sorted((r.doc_id, r.start, r.end) for r in X.token_windows(df, 4, 1, False).collect())
    assert cut == [(1, 0, 4), (1, 3, 7), (1, 6, 10), (2, 0, 4)]
    df = spark.createDataFrame([(1, 9)], "doc_id long, n_tokens int")
    assert sorted((r.start, r.end) for r in X.token_windows(df, 4, 1, True).collect()) == [(0, 4), (3, 7), (5, 9)]


def test_layout_checks(spark):
    e = spark.createDataFrame([(1, 0, 0, 5, ""), (1, 1, 4, 8, ""), (1, 2, 9, 12, "x"), (1, 3, 12, 13, " ")], "doc long, position int, start int, end int, text_between string")
    assert {(r.position, r.fault) for r in X.check_offsets(e).collect()} == {(1, "overlaps"), (2, "drops_text")}
    c = spark.createDataFrame([(1, 0, 0, 1, 2, 2, 2), (1, 0, 1, 1, 1, 2, 2), (1, 1, 1, 1, 2, 2, 2)], "table long, row int, col int, row_span int, col_span int, n_rows int, n_cols int")
    assert {(r.row, r.col, r.fault) for r in X.check_cells(c).collect()} == {(0, 1, "overlaps"), (1, 1, "outside")}


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=20), st.integers(0, 40))
def test_permutations_invert(seed, n):
    order = K.content_permutation(seed, n)
    assert sorted(order) == list(range(n)) and [order[i] for i in K.inverse_permutation(order)] == list(range(n))
    assert order == K.content_permutation(seed, n)


def test_leaders_of_many_blocks_are_those_of_one_by_one():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((1300, 8))
    v[::9] = v[0]
    unit, openers, want = v / np.linalg.norm(v, axis=1, keepdims=True), [], []
    for x in unit:
        near = [k for k, o in enumerate(openers) if o @ x >= 0.7]
        want.append(near[0] if near else len(openers))
        openers += [] if near else [x]
    assert K.leaders(v, 0.7) == want and len(openers) > 100


def test_twins_are_found_without_pairs(spark, monkeypatch):
    """Every pair of clusters by hand; no join with the other side's vectors is left."""
    rng = np.random.default_rng(4)
    rows = [(k % 2, "ab"[k % 3 % 2], "observation", k % 5, k, rng.standard_normal(3).tolist()) for k in range(60)] + [(9, "a", "observation", 0, 99, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "label int, polarity string, epistemic_class string, sample int, position long, vector array<double>")
    monkeypatch.setattr(S, "cosine", None)
    got = K.consolidate(frame, ["label"], 5, 0.9).collect()
    cos = lambda a, b: np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b) or 1)
    for r in got:
        assert r.twin == any(o.label == r.label and o.polarity != r.polarity and cos(o.vector, r.vector) >= 0.9 for o in got)
    assert {r.twin for r in got} == {True, False}


def test_documents_are_segmented_over_batches_without_a_call_for_each(spark):
    rng = np.random.default_rng(5)
    sizes = {"a": 1, "b": 70, "c": 3, "d": 40, "e": 2}
    rows = [(d, k, rng.standard_normal(4).tolist() if d != "e" and (d, k) != ("c", 1) else None, float(k % 3), k % 11 == 4) for d, n in sizes.items() for k in range(n)]
    levels = X.level_policy()
    got = {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        out = X.segment_documents(spark.createDataFrame(rows, "doc string, position int, vector array<double>, density double, valley boolean"), levels)
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
        for r in out.collect():
            got.setdefault((r.doc, r.level), []).append((r.start, r.end))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {("e", levels[0].level): [(0, 2)]}
    for d in "abcd":
        mine = [r for r in rows if r[0] == d]
        vectors = np.array([r[2] or [0.0] * 4 for r in mine])
        for x in levels:
            want[d, x.level] = X.segment(vectors, np.array([r[3] for r in mine]), [r[1] for r in mine if r[4]], x)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_leaders_open_clusters_in_order():
    v = np.array([[1, 0], [0.9, 0.1], [0, 1], [1, 0.05], [0.5, 0.5]])
    assert K.leaders(v, 0.95) == [0, 0, 1, 0, 2]


def test_decision_bands(spark):
    rows = [(1, "a", 0.9), (1, "b", 0.84), (2, "a", 0.9), (2, "b", 0.86), (3, "a", 0.7), (4, "a", 0.3)]
    got = {r.mention: (r.target, r.state, r.ties) for r in R.decide(spark.createDataFrame(rows, "mention long, target string, score double")).collect()}
    assert got == {1: ("a", "confirmed", 1), 2: ("a", "candidate", 2), 3: ("a", "candidate", 1)}


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 0), (0.7, 1), (0.3, 0)], "p double, outcome int")
    assert M.brier(df).first()[0] == pytest.approx((0.01 + 0.04 + 0.09 + 0.09) / 4)
    assert {r.bin: r.n for r in M.reliability(df).collect() if r.n} == {9: 1, 2: 2, 6: 1}  # 0.3 / 0.1 and 0.7 / 0.1 fall just short
    sure = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert M.kappa(sure).first()[0] == 1.0
    assert math.isnan(M.spearman(spark.createDataFrame([(1, 1), (1, 2)], "x int, y int")).first()[0])
    assert "| metric |" in M.report(spark.createDataFrame([("s", "m", 0.5)], "system string, metric string, value double"))


def test_supersession_and_upserts(spark):
    rows = spark.sql("select 1 id, 'x' v, timestamp'2024-01-01' valid_from, cast(null as timestamp) valid_to union all select 2, 'y', timestamp'2024-01-01', null")
    out = T.supersede(rows, spark.sql("select 1 id, 'z' v"), ["id"], F.lit("2024-02-01").cast("timestamp"))
    assert {(r.id, r.v) for r in T.current(out).collect()} == {(1, "z"), (2, "y")} and out.count() == 3
    assert {(r.id, r.v) for r in T.as_of(out, F.lit("2024-01-15").cast("timestamp")).collect()} == {(1, "x"), (2, "y")}
    nodes = spark.sql("select explode(array(1, 2)) id")
    edges = spark.createDataFrame([(1, 2, "T", 0.1)], "src int, dst int, etype string, w double")
    new = spark.createDataFrame([(1, 2, "T", 0.9), (1, 3, "T", 0.5), (2, 1, "T", 0.4)], edges.schema)
    assert {tuple(r) for r in T.upsert_edges(edges, new, nodes).collect()} == {(1, 2, "T", 0.9), (2, 1, "T", 0.4)}
    left, kept = T.detach_delete(nodes, edges, spark.sql("select 2 id"))
    assert left.count() == 1 and kept.count() == 0


def test_value_of_a_proposed_conclusion(spark):
    b, body = rule_frames(spark, [0, 1], [(2, frozenset([0, 1]))])
    rule = spark.createDataFrame([(9, 5, 2, 0.7)], "rule long, head long, atom long, strength double")
    assert L.value_conclusion(b, body, rule) == (1, 0.5)
    missing = spark.createDataFrame([(9, 5, 77, 0.7)], rule.schema)
    assert L.value_conclusion(b, body, missing) == (0, 0.0)
