"""Compositions on small graphs: replay, purge, failures, panels, contradictions, intake, packs, commits and versions."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from tests.test_sources import PACK
from tracewright.operators import adjudicate as A
from tracewright.operators import clusters as K
from tracewright.operators import extraction as E
from tracewright.operators import intake as I
from tracewright.operators import reasoning as N
from tracewright.operators import text as X
from tracewright.plans import storage
from tracewright.queries import compose
from tracewright.sources import documents as D
from tracewright.sources import models as M
from tracewright.sources import registry as R
from tracewright.streaming import ingest as G

LOG = "span_id long, content_hash string, ts int, action string, n_outputs long, verify_signature string"


def spans(spark, rows):
    return spark.createDataFrame(rows, "span_id long, document_id long, position int, text string")


def stored_from(out, actions):
    """Propositions as a later run finds them, with the action that made them."""
    return out.propositions.join(actions.select("span_id", "action"), "span_id").drop("ordinal_", "replayed", "routing")


def test_extraction_is_skipped_replayed_purged_or_blocked(spark):
    none = compose.empty_store(spark)
    nobody = spark.createDataFrame([], "proposition string")
    first = E.propositionize(spans(spark, [(1, 1, 0, "The valve leaks. It is unsafe."), (2, 2, 0, "Pumps run, mostly.")]), spark.createDataFrame([], LOG), none, nobody)
    props = {(r.span_id, r.ordinal): r for r in first.propositions.collect()}
    assert {k: (r.text, r.polarity, r.routing) for k, r in props.items()} == {(1, 0): ("The valve leaks", "asserted", "fact"), (1, 1): ("It is unsafe.", "negated", "fact"), (2, 0): ("Pumps run, mostly.", "asserted", "judgement")}
    assert all(r.proposition == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r.span_id}:{r.content_hash}:{r.ordinal}")) for r in props.values())
    acts = first.actions.collect()
    assert {r.span_id: r.n_outputs for r in acts} == {1: 2, 2: 1} and first.failures.count() == 0 and first.edges.count() == 3
    log = first.actions.select("span_id", "content_hash", F.lit(1).alias("ts"), "action", "n_outputs", "verify_signature")
    stored = stored_from(first, first.actions)
    # The same spans again: nothing. A third with the text and context of the first: replayed without a call.
    def refuse(prompt):
        raise RuntimeError("no call expected")

    again = E.propositionize(spans(spark, [(1, 1, 0, "The valve leaks. It is unsafe."), (3, 3, 0, "The valve leaks. It is unsafe.")]), log, stored, nobody, model=refuse)
    got = again.propositions.collect()
    assert {(r.span_id, r.text, r.replayed, round(r.faithfulness, 3)) for r in got} == {(3, "The valve leaks", True, 1.0), (3, "It is unsafe.", True, 1.0)}
    assert [r.reused_from for r in again.actions.collect()] == [next(a.action for a in acts if a.span_id == 1)]
    other = E.propositionize(spans(spark, [(3, 3, 0, "The valve leaks. It is unsafe.")]), log.withColumn("verify_signature", F.lit("old")), stored, nobody, model=refuse)
    assert {(r.faithfulness, tuple(r.reasons)) for r in other.propositions.collect()} == {(None, ("unassessed_faithfulness",))}
    # A changed text: purged and extracted again, or blocked where something rests on it.
    changed = [(1, 1, 0, "The valve holds."), (2, 2, 0, "Pumps run well.")]
    used = spark.createDataFrame([(props[2, 0].proposition,)], "proposition string")
    third = E.propositionize(spans(spark, changed), log, stored, used)
    assert {r.proposition for r in third.purged.collect()} == {props[1, 0].proposition, props[1, 1].proposition}
    assert [r.span_id for r in third.blocked.collect()] == [2] and [r.text for r in third.propositions.collect()] == ["The valve holds."]


def test_a_failing_span_fails_alone_and_unverified_claims_are_marked(spark):
    def model(prompt):
        if "bad" in prompt:
            raise RuntimeError("refused")
        return M.stand_in(prompt)

    rows = spans(spark, [(1, 1, 0, "good one"), (2, 2, 0, "bad one"), (3, 3, 0, None), (4, 4, 0, "")])
    args = (spark.createDataFrame([], LOG), compose.empty_store(spark), spark.createDataFrame([], "proposition string"))
    out = E.propositionize(rows, *args, verifier=None, model=model)
    assert [(r.span_id, r.text, r.faithfulness, r.reasons) for r in out.propositions.collect()] == [(1, "good one", None, ["unassessed_faithfulness"])]
    assert [r.span_id for r in out.failures.collect()] == [2] and {r.span_id for r in out.actions.collect()} == {1, 3, 4}
    assert E.propositionize(rows.where("false"), *args).propositions.count() == 0


def test_samples_agree_or_waver(spark):
    def model(prompt):
        name, part = M.parts_of(prompt)
        if name != "propose":
            return M.stand_in(prompt)
        items = [{"text": "same claim here", "polarity": p, "epistemic_class": "observation"} for p in ("asserted", "negated")]
        return json.dumps({"items": items + [{"text": "other words entirely"}]})

    task = M.Task(M.PROPOSE.name, M.PROPOSE.instructions, M.PROPOSE.items, samples=3, temperature=0.7)
    args = (spark.createDataFrame([], LOG), compose.empty_store(spark), spark.createDataFrame([], "proposition string"))
    out = E.propositionize(spans(spark, [(1, 1, 0, "x")]), *args, task=task, model=model).propositions.collect()
    assert sorted((r.text, r.polarity, r.agreement, tuple(r.reasons)) for r in out) == [
        ("other words entirely", "asserted", 1.0, ()), ("same claim here", "asserted", 1.0, ("polarity_unstable",)), ("same claim here", "negated", 1.0, ("polarity_unstable",)),
    ]
    with pytest.raises(ValueError):
        E.propositionize(spans(spark, [(1, 1, 0, "x")]), *args, task=M.Task("propose", "", M.PROPOSE.items, samples=2), model=model)


def test_identities_move_with_words_schema_and_regime(spark):
    base = M.PROPOSE
    others = [M.Task(base.name, base.instructions + ".", base.items), M.Task(base.name, base.instructions, base.items + ", x int"), M.Task(base.name, base.instructions, base.items, temperature=0.5)]
    assert len({t.signature for t in [base, *others]}) == 4 and M.Task(base.name, base.instructions, base.items).signature == base.signature
    assert M.parts_of("TASK: t\nsay\n\nCONTEXT:\na\nb\n\nTARGET:\nc") == ("t", {"CONTEXT": "a\nb", "TARGET": "c"})
    hashes = E.keyed_spans(spans(spark, [(1, 1, 0, "a"), (2, 1, 1, "b"), (3, 2, 0, "b"), (4, 3, 0, "b")])).collect()
    by = {r.span_id: r for r in hashes}
    assert by[2].context == "a" and by[3].content_hash == by[4].content_hash != by[2].content_hash


def test_verification_backfill_changes_its_own_reasons_only(spark):
    props = spark.createDataFrame([("a", 1, "short", ["polarity_unstable", "unassessed_faithfulness"], None), ("b", 1, "x" * 200, ["unassessed_faithfulness"], None), ("c", 1, "kept", [], 0.9)],
                                  "proposition string, span_id long, text string, reasons array<string>, faithfulness double")
    sources = spark.createDataFrame([(1, "source")], "span_id long, source string")
    log = spark.createDataFrame([("a", "old", 1, "x"), ("c", M.VERIFY.signature, 2, "y"), ("c", "old", 1, "x")], "proposition string, signature string, ts int, action string")
    got = {r.proposition: (r.faithfulness, r.reasons) for r in E.backfill_verification(props, sources, log).collect()}
    assert got == {"a": (1.0, ["polarity_unstable"]), "b": (0.3, ["low_faithfulness"])}


def test_mentions_do_not_bind_to_their_own_entities(spark):
    claims = spark.createDataFrame([("p", "b", "the hydraulic gearbox"), ("q", "b", "the hydraulic"), ("r", "b", "something")], "proposition string, box string, text string")
    mentions = E.detect_mentions(claims)
    ents = spark.createDataFrame([("e1", "b", "object", "hydraulic", ["hydraulic"], ""), ("e2", "b", "object", "gearbox", ["gearbox"], ""), ("e3", "z", "object", "something", ["something"], "")],
                                 "id string, box string, kind string, norm string, tokens array<string>, type string")
    owners = spark.createDataFrame([("p", "e1")], "proposition string, id string")
    taxonomy = spark.createDataFrame([("t1", "hydraulic", ["hydraulic"], None)], "target string, norm string, tokens array<string>, type string")
    got = {r.mention: (r.target, r.state, r.stage) for r in E.bind_box(mentions, ents, owners, taxonomy).collect()}
    assert got == {"p#0": ("t1", "confirmed", "taxonomy"), "q#0": ("e1", "confirmed", "graph"), "r#0": (None, None, "unresolved")} or got["q#0"][0] == "e1"
    assert got["p#0"][2] == "taxonomy" and got["r#0"][2] == "unresolved"


def graph(spark, statements, vectors=()):
    nodes = spark.createDataFrame([(i, "hypothesis" if i.startswith("h") else "fact", "off" if i.endswith("x") else "on", s) for i, s in statements.items()], "id string, label string, box string, statement string")
    nodes = nodes.withColumns({"confidence": F.lit(0.5), "valid_to": F.lit(None).cast("timestamp")})
    boxes = spark.createDataFrame([("on", "case", "active"), ("off", "case", "deprecated")], "box string, tier string, status string")
    involves = nodes.select(F.col("id").alias("node"), F.lit("thing").alias("entity"), F.lit("subject").alias("role"))
    placed = spark.createDataFrame([(i, i, "m", list(map(float, v))) for i, v in vectors], "node string, proposition string, model string, vector array<double>")
    return N.Graph(nodes, boxes, involves, placed.select("node", "proposition"), placed.select("proposition", "model", "vector"))


def test_the_panel_sees_each_order_and_counts_first_verdicts(spark):
    g = graph(spark, {"h1": "claim", "e1": "one", "e2": "two", "e3": "three", "ex": "off"})
    pool = N.generate_candidates(g)
    assert {r.evidence for r in pool.collect()} == {"e1", "e2", "e3"}

    def model(prompt):
        _, part = M.parts_of(prompt)
        lines = dict(x.split(". ", 1) for x in part["EVIDENCE"].split("\n"))
        two = next(int(n) for n, t in lines.items() if t == "two")
        # A verdict by position: whatever comes first refutes. The second verdict on a number and one out of range don't count.
        return json.dumps({"items": [{"ref": 1, "sign": "refutes"}, {"ref": 1, "sign": "supports"}, {"ref": 99, "sign": "supports"}] + ([{"ref": two, "sign": "supports"}] if two != 1 else [])})

    orders = [[sorted(["e1", "e2", "e3"])[i] for i in K.content_permutation(f"h1|{s}", 3)] for s in range(5)]
    got = {r.evidence: r for r in N.judge_panel(pool, N.node_meta(g.nodes, g.boxes), model=model).collect()}
    for e in ("e1", "e2", "e3"):
        refuted = sum(o[0] == e for o in orders)
        supported = 5 - refuted if e == "e2" else 0
        assert (got[e].negative, got[e].positive, got[e].abstained, got[e].n_samples) == (refuted, supported, 5 - refuted - supported, 5)


def test_contradictions_are_gated_before_they_revise(spark):
    """A stable refuter that clashes with the hypothesis's claim retracts it; one that doesn't clash leaves it pending."""
    texts = {"h1": "machinery works", "e1": "machinery unworkable", "h2": "generator works", "e2": "generator unworkable", "h3": "solitary claims"}
    g = graph(spark, texts, [("h1", (1, 0)), ("e1", (1, 0)), ("h2", (0, 1)), ("e2", (1, 0))])
    targets = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "hypothesis string")
    claims = spark.createDataFrame([("h1", "asserted"), ("e1", "negated"), ("h2", "asserted"), ("e2", "negated")], "proposition string, polarity string")
    none = spark.createDataFrame([], "evidence string, reliability double"), spark.createDataFrame([], "evidence string, reasons array<string>")
    base = spark.createDataFrame([("e1", 1.0), ("e2", 1.0)], "node string, confidence double")
    body = spark.createDataFrame([], "rule string, head string, atom string, strength double")
    hyps = spark.createDataFrame([("h1", 0.4), ("h2", 0.4), ("h3", 0.4)], "hypothesis string, base double")
    edges = spark.createDataFrame([], "src string, dst string, sign string, strength double")
    out = N.find_contradictions(g, targets, claims, *none, base, body, hyps, edges)
    gate = {r.hypothesis: (r.llm, r.symbolic, r.authorised) for r in out.gate.collect()}
    assert gate == {"h1": ("affirm", "affirm", True), "h2": ("affirm", "abstain", False)}
    assert {r.node for r in out.revision.retracted.collect()} == {"h1"} and out.revision.outcome.status == "converged"
    acts = {r.hypothesis: (r.supporters, r.refuters, r.authorised) for r in out.actions.collect()}
    assert acts == {"h1": (0, 1, True), "h2": (0, 1, False), "h3": (0, 0, False)}
    state = {r.hypothesis: r.state for r in A.hold_refutations(out.revision.verdicts, out.gate, hyps.select("hypothesis", F.lit("supported").alias("state"))).collect()}
    assert state["h2"] == "supported"


def test_doubtful_refutations_are_held_back(spark):
    g = graph(spark, {"h1": "machinery works", "e1": "machinery unworkable", "e2": "machinery runs"})
    reasons = spark.createDataFrame([("e1", ["low_faithfulness"]), ("e2", [])], "evidence string, reasons array<string>")
    out = N.produce_edges(g, spark.createDataFrame([("e1", 0.5)], "evidence string, reliability double"), reasons)
    assert [(r.evidence, r.sign) for r in out.edges.collect()] == [("e2", "supports")] and [(r.evidence, r.sign) for r in out.quarantined.collect()] == [("e1", "refutes")]
    assert [tuple(r[k] for k in ("hypothesis", "supporters", "refuters", "quarantined")) for r in out.actions.collect()] == [("h1", 1, 0, 1)]


def test_active_graph_is_loaded_and_evaluated(spark):
    nodes = spark.sql("select 'a' id, 'f' label, 'on' box, 0.8D confidence, cast(null as timestamp) valid_to union all select 'h', 'h', 'on', 0.5, null union all select 'z', 'f', 'off', 1.0, null union all select 'g', 'f', 'on', 1.0, timestamp'2024-01-01'")
    boxes = spark.createDataFrame([("on", "active"), ("off", "deprecated")], "box string, status string")
    edge = lambda *rows: spark.createDataFrame(rows, "src string, dst string, strength double, valid_to timestamp")
    solved = N.load_and_evaluate(nodes, boxes, edge(("a", "h", 0.5, None), ("z", "h", 1.0, None), ("g", "h", 1.0, None)), edge())
    assert {r.arg: round(r.sigma, 6) for r in solved.strengths.collect()} == {"a": 0.8, "h": 0.7}
    derived = spark.createDataFrame([("h", "a", "d", 0.9), ("h", "z", "d2", 0.9)], "conclusion string, antecedent string, derivation string, strength double")
    base, body = N.load_derivations(nodes, boxes, spark.createDataFrame([("a",), ("g",)], "node string"), derived)
    assert [tuple(r) for r in base.collect()] == [("a", 0.8)] and [(r["rule"], r["head"], r.atom) for r in body.collect()] == [("d", "h", "a")]


def test_boxes_resolve_within_kinds_and_roles_count_once(spark):
    ents = spark.createDataFrame([(1, "b", "actor", "The Pump A", "t"), (2, "b", "actor", "pump a", "t"), (3, "b", "object", "pump a", "t"), (4, "b", "actor", "valve", ""), (5, "c", "actor", "pump a", "t")], "id long, box string, kind string, label string, type string")
    inv = spark.createDataFrame([("f", 1, "subject"), ("f", 4, "object"), ("g", 2, "subject"), ("g", 4, "object")], "node string, entity long, role string")
    edges, acts = N.resolve_boxes(ents, inv, F.lit("2024-01-01").cast("timestamp"))
    got = [(r.src, r.dst, r.state, round(r.strength, 6)) for r in edges.collect()]
    # Shared context valve (and not themselves), one shared role: 0.5 + 0.25 + 0.35 * (1 - 0.5 ** 1.5).
    assert got == [(1, 2, "confirmed", round(0.75 + 0.35 * (1 - 0.5**1.5), 6))]
    assert {r.box: (r.entities, r.confirmed) for r in acts.collect()} == {"b": (4, 1), "c": (1, 0)}


def test_loads(spark):
    edges = spark.createDataFrame([("p", "s2", "EVIDENCED_BY"), ("p", "s1", "EVIDENCED_BY"), ("f", "e", "INVOLVES"), ("f", "p", "EVIDENCED_BY")], "src string, dst string, etype string")
    props = spark.createDataFrame([("p", "b"), ("q", "c")], "proposition string, box string")
    assert {r.proposition: r.spans for r in N.load_propositions(props, edges).collect()} == {"p": ["s1", "s2"], "q": []}
    assert N.load_propositions(props, edges, F.lit("b")).count() == 1
    ents = spark.createDataFrame([("e", "b", "object", "The Pump", "t"), ("e2", "b", "object", "pump", "t"), ("e3", "b", "actor", "pump", "t"), ("e4", "b", "actor", " ", "t")], "id string, box string, kind string, label string, type string")
    assert [(r.id, r.fact, r.proposition) for r in N.load_entities(ents, edges).collect()] == [("e", "f", "p")]
    assert sorted((r.kind, r.canonical, tuple(r.ids)) for r in N.load_referents(ents).collect()) == [("actor", "e3", ("e3",)), ("object", "e", ("e", "e2"))]


def test_conclusions_need_held_premises(spark):
    base = spark.createDataFrame([("a", 0.9), ("b", 0.6)], "node string, confidence double")
    body = spark.createDataFrame([("r", "c", "a", 0.8)], "rule string, head string, atom string, strength double")
    rows = [("s1", "deduced", "c", None, "x"), ("s1", "deduced", "b", None, "x"), ("s2", "induced", "nowhere", 0.5, "x")]
    proposals = spark.createDataFrame(rows, "statement string, kind string, premise string, strength double, box string")
    nodes, edges, actions = N.append_conclusions(base, body, proposals)
    assert {r.statement: (r.support_count, r.confidence, r.provisional) for r in nodes.collect()} == {"s1": (1, 0.6, False), "s2": (0, 0.0, True)}
    assert edges.count() == 3 and actions.count() == 2
    with pytest.raises(Exception, match="needs a strength"):
        N.append_conclusions(base, body, proposals.withColumn("kind", F.lit("induced")))


def test_intake_is_guarded_segmented_and_idempotent(spark):
    text = "Alpha beta gamma. Delta epsilon zeta! One two three?\nLast line here."
    files = spark.createDataFrame([("d1", text.encode()), ("d2", b"no end mark, just words, "), ("d3", b"  \n "), ("d4", b"")], "document_id string, content binary")
    none = spark.createDataFrame([], "document_id string, level int, start int, end int, vector array<double>, text string, span_id string, model string, content_hash string")
    log = spark.createDataFrame([], "document_id string, action_type string, content_hash string")
    levels = [X.Level(0, 2, 0.5, 0.1), X.Level(1, 8, 0.5, 0.02)]
    first = I.ingest(files, none, none, log, levels=levels)
    rows = first.spans.collect()
    for r in rows:
        full = text if r.document_id == "d1" else "no end mark, just words, "
        assert r.text == full[r.start : r.end] and r.span_id == str(uuid.uuid5(uuid.uuid5(uuid.NAMESPACE_URL, f"document:{r.document_id}"), f"{r.start}:{r.end}:{r.level}"))
    for level in (0, 1):
        mine = sorted((r.start, r.end) for r in rows if r.document_id == "d1" and r.level == level)
        assert mine[0][0] == 0 and mine[-1][1] == len(text) and all(b <= c for (_, b), (c, _) in zip(mine, mine[1:]))
    assert len([r for r in rows if r.level == 0 and r.document_id == "d1"]) >= 2
    kinds = [(r.document_id, r.action_type) for r in first.actions.collect()]
    assert ("d1", "parse") in kinds and ("d1", "segment:1") in kinds and ("d3", "segment:0") not in kinds
    again = I.ingest(files, first.spans, first.spans, first.actions, levels=levels)
    assert again.spans.count() == 0 and again.actions.count() == 0
    with pytest.raises(ValueError, match="can't be mixed"):
        I.ingest(files, first.spans, first.spans, first.actions, levels=levels, model="other")
    with pytest.raises(Exception, match="segmented otherwise"):
        I.ingest(files, first.spans, first.spans, log, levels=[X.Level(0, 3, 0.5, 0.1)]).spans.collect()
    chunks = I.chunk_documents(first.contents, 4, 1).collect()
    assert [r.chunk for r in sorted(chunks, key=lambda r: r.idx) if r.document_id == "d2"] == ["no end mark, just", "just words,"]


def test_packs_are_written_once_and_closures_rebuilt_by_box(spark):
    packs = spark.createDataFrame([], R.PACK_SCHEMA)
    pack = R.Pack.from_dict(PACK)
    at = F.lit("2024-01-01").cast("timestamp")
    first = R.pack_to_graph(packs, pack, at)
    assert (first.boxes.count(), first.entities.count(), first.actions.count()) == (1, 4, 1)
    names = {r.id: r.label for r in first.entities.collect()}
    got = {(names[r.src], names[r.dst], r.etype, r.anchored) for r in first.edges.collect()}
    direct = {("bearing", "pump"), ("roller", "bearing"), ("steel", "bearing")}
    assert got == {(*e, t, "direct") for e in direct for t in ("DIRECT_PART_OF", "PART_OF")} | {("roller", "pump", "PART_OF", "rollup")}
    again = R.pack_to_graph(storage.materialize(first.packs, "packs"), pack, F.current_timestamp())
    assert again.packs.count() == 1 and [df.count() for df in (again.boxes, again.entities, again.edges, again.actions)] == [0, 0, 0, 0]
    edges = first.edges.where("etype = 'DIRECT_PART_OF' or anchored = 'direct'")
    more = edges.unionByName(edges.where("etype = 'PART_OF'").withColumn("box", F.lit("other")))
    box = first.boxes.first().id
    rebuilt = R.rebuild_closure(more, spark.createDataFrame([(box,)], "box string"), at).collect()
    mine = {(names[r.src], names[r.dst]) for r in rebuilt if r.box == box and r.etype == "PART_OF"}
    assert mine == {("bearing", "pump"), ("roller", "bearing"), ("roller", "pump")} and sum(r.box == "other" for r in rebuilt) == 3
    tiers = spark.createDataFrame([("case", None), ("case", "domain")], "box string, own string").select(R.resolve_tier(F.col("box"), F.col("own")).alias("t"))
    assert [r.t for r in tiers.collect()] == ["case", "domain"]
    pairs = spark.createDataFrame([(2, 1, 0.9, "confirmed")], "a int, b int, score double, state string")
    assert [(r.src, r.dst) for r in R.same_as_edges(pairs, F.lit("b"), at).collect()] == [("1", "2")]


def test_commits_are_all_or_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/graph"
    one, two = spark.range(3), spark.range(5)
    assert storage.commit_tables(spark, path, {"nodes": one, "edges": two}) == 1
    with pytest.raises(Exception, match="broken"):
        storage.commit_tables(spark, path, {"nodes": two, "edges": spark.range(1).select(F.raise_error(F.lit("broken")).alias("id"))})
    assert storage.committed_versions(spark, path) == [1] and storage.read_committed(spark, path, "nodes").count() == 3
    assert storage.commit_tables(spark, path, {"nodes": two, "edges": two}) == 2
    assert storage.read_committed(spark, path, "nodes").count() == 5 and storage.read_committed(spark, path, "nodes", 1).count() == 3
    with pytest.raises(ValueError):
        storage.read_committed(spark, path, "nodes", 7)


def test_streamed_versions_take_late_rows_and_keep_other_keys(spark, tmp_path):
    schema = "k string, v int, ts timestamp"
    for n, rows in enumerate([[("a", 1, "2024-01-01"), ("b", 1, "2024-01-01")], [("a", 3, "2024-01-05")], [("a", 2, "2024-01-03")]]):
        df = spark.createDataFrame(rows, "k string, v int, ts string").select("k", "v", F.col("ts").cast("timestamp").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        import time

        time.sleep(1.1)  # files are taken in order of their times
    out = G.supersede_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "v", ["k"])
    got = sorted((r.k, r.v, str(r.valid_from)[:10], str(r.valid_to)[:10]) for r in out.collect())
    assert got == [("a", 1, "2024-01-01", "2024-01-03"), ("a", 2, "2024-01-03", "2024-01-05"), ("a", 3, "2024-01-05", "None"), ("b", 1, "2024-01-01", "None")]


def test_retries_and_job_status(spark, tmp_path):
    calls, waits = [], []

    def job():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError("later")
        return "done"

    assert G.with_retries(job, sleep=waits.append) == "done" and waits == [2.0, 4.0]
    with pytest.raises(ConnectionError):
        G.with_retries(lambda: (_ for _ in ()).throw(ConnectionError("always")), sleep=waits.append)
    with pytest.raises(KeyError):
        G.with_retries(lambda: {}["x"], sleep=waits.append)
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("x")
    status = G.JobStatus(spark, str(tmp_path), f"{tmp_path}/landed")
    assert {r["name"]: r.status for r in status.table().collect()} == {"a.txt": "pending", "b.txt": "pending"}
    spark.createDataFrame([("file:///in/a.txt",)], "path string").write.parquet(f"{tmp_path}/landed")
    assert {r["name"]: r.status for r in status.table().where("name like '%txt'").collect()} == {"a.txt": "done", "b.txt": "pending"}


def test_layout_service_retries_what_may_pass(monkeypatch):
    """The client of the layout service against a stub server: a refused call is final, a failing one is repeated."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = self.rfile.read(int(self.headers["Content-Length"]))
            seen.append((self.path, self.headers["Content-Type"], body))
            self.send_response(400 if body == b"bad" else 503 if len(seen) == 1 else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"elements": [{"kind": "paragraph", "text": "hello", "page": 2, "source_quality": "ocr"}]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        import time

        monkeypatch.setattr(time, "sleep", lambda s: None)
        parse = D.make_parser("service", f"http://127.0.0.1:{server.server_port}/")
        assert parse(b"data", "application/pdf") == [D.Element("paragraph", "hello", 2, "ocr")]
        assert [s[0] for s in seen] == ["/v1/parse"] * 2 and seen[0][1] == "application/pdf"
        with pytest.raises(Exception, match="400"):
            parse(b"bad", "application/pdf")
        assert len(seen) == 3
    finally:
        server.shutdown()


def test_embedding_service(spark):
    """Passages and windowed token vectors of a stub service; a wrong model, count or length is refused."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/embed":
                reply = [[len(t), 1] for t in asked["inputs"] if t != "lost"]
            else:
                words = asked["text"].split()
                size, step = asked["window_tokens"], asked["window_tokens"] - asked["overlap_tokens"]
                starts = range(0, max(1, len(words) - asked["overlap_tokens"]), step)
                spans = [[[3 * (k + j), 3 * (k + j) + 2] for j in range(len(words[k : k + size]))] for k in starts]
                reply = {"model_version": "m1", "offsets": spans, "embeddings": [[[a, b] for a, b in w] for w in spans]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    try:
        embed = D.make_embedder(url, 2)
        assert embed(["abc", None]) == [[3.0, 1.0], [0.0, 1.0]] and embed([]) == []
        for texts, size in ((["a", "lost"], 2), (["a"], 3)):
            with pytest.raises(ValueError, match="must answer"):
                D.make_embedder(url, size)(texts)
        assert len(D.make_embedder("", 8)(["one two"])[0]) == 8
        docs = spark.createDataFrame([(1, "aa bb cc dd ee"), (2, ""), (3, None), (4, "aa")], "doc_id long, text string")
        rows = D.token_vectors(docs, url, "m1", window=3, overlap=1).orderBy("doc_id", "window", "token").collect()
        assert [(r.doc_id, r.window, r.token, r.start) for r in rows] == [(1, 0, 0, 0), (1, 0, 1, 3), (1, 0, 2, 6), (1, 1, 0, 6), (1, 1, 1, 9), (1, 1, 2, 12), (4, 0, 0, 0)]
        assert all(list(r.vector) == [r.start, r.end] for r in rows)
        with pytest.raises(Exception, match="not with m2"):
            D.token_vectors(docs, url, "m2").collect()
    finally:
        server.shutdown()


def test_intermediate_tables_lie_in_a_folder_of_their_application(spark):
    table = storage.materialize(spark.range(3), "probe")
    assert table._tracewright_path.startswith(storage.run_dir(spark) + "/probe-") and table.count() == 3
    storage.discard(table)
    files, gone = storage._path(spark, table._tracewright_path)
    assert not files.exists(gone)
