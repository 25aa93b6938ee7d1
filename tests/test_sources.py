"""Sources, sinks, registries, model seams and streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.operators import lifecycle as L
from tracewright.sources import documents as D
from tracewright.sources import models as N
from tracewright.sources import registry as G
from tracewright.sources import scans as C
from tracewright.streaming import ingest as I

PACK = {
    "name": "pump", "version": "1", "entity_types": [{"name": "part"}, {"name": "material", "parent": "part"}],
    "entities": [{"key": k, "label": k, "type": "part"} for k in ("pump", "bearing", "roller")] + [{"key": "steel", "label": "steel", "type": "material"}],
    "part_of": [{"part": "bearing", "whole": "pump"}, {"part": "roller", "whole": "bearing"}, {"part": "steel", "whole": "bearing", "meronymy": "stuff-object"}],
}


def test_text_and_binary_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One.\n\nTwo é.")
    (tmp_path / "b.txt").write_text("")
    text = D.read_text(spark, str(tmp_path)).collect()
    assert [r.text for r in text] == ["One.\n\nTwo é."]  # an empty file has no row
    parsed = D.parse_documents(D.read_binary(spark, str(tmp_path)))
    assert [(r.kind, r.text) for r in parsed.collect()] == [("paragraph", "One.\n\nTwo é.")]
    assert D.assemble_text(parsed).first()["text"] == "One.\n\nTwo é."
    with pytest.raises(ValueError):
        D.make_parser("service")


def test_spans_name_their_text_and_persist_once(spark):
    docs = spark.createDataFrame([(1, "A one. B two."), (2, "C.")], "doc_id long, text string")
    spans = D.sentence_span_rows(docs)
    back = D.span_text(spans, docs.withColumnRenamed("doc_id", "document_id"))
    assert sorted(r.text.strip() for r in back.collect()) == ["A one.", "B two.", "C."]
    rows = spans.withColumn("vector", F.when(F.col("text") == "C.", F.array(F.lit(0.0))).otherwise(F.array(F.lit(1.0))))
    first = D.persist_spans(rows.where("false"), rows)
    assert first.added.count() == 2 and [r.reason for r in first.skipped.collect()] == ["zero_vector"]
    again = D.persist_spans(first.table, rows)
    assert again.added.count() == 0 and again.conflicts.count() == 0
    changed = D.persist_spans(first.table, rows.withColumn("text", F.concat("text", F.lit("!"))))
    assert changed.conflicts.count() == 2
    assert [r.start for r in D.document_spans(spans, 1, 0).collect()] == sorted(r.start for r in spans.where("document_id = 1").collect())


def test_seals_are_write_once(spark):
    docs = spark.createDataFrame([("a", "x")], "document_id string, text string")
    none = spark.createDataFrame([], "document_id string, tier string, input_sha256 string")
    sealed = D.seal(none, docs)
    assert D.seal(sealed, docs).count() == 1
    with pytest.raises(Exception, match="sealed document changed"):
        D.seal(sealed, docs.withColumn("text", F.lit("y"))).collect()
    with pytest.raises(ValueError):
        D.seal(none, docs, "case")


def test_chunk_sink_drops_surplus_tails(spark):
    old = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "document_id string, idx int")
    out = D.replace_chunks(old, old.where("document_id = 'a' and idx = 0"), spark.createDataFrame([("a",), ("b",)], "document_id string"))
    assert [tuple(r) for r in out.collect()] == [("a", 0)]


def test_boxes(spark):
    box = G.reference_box("handbook", reliability_prior=0.9, compartments=("x", "y"))
    assert G.Box.from_props(box.to_props(kind="pack")) == box and box.id == G.reference_box("handbook").id
    with pytest.raises(ValueError):
        G.Box("b", "nope")
    registry = G.create_boxes(spark.createDataFrame([], G.BOX_SCHEMA), [box, G.case_box("c")])
    assert G.create_boxes(registry, [box]).count() == 2
    assert [r.name for r in G.list_boxes(registry).collect()] == ["c", "handbook"]
    assert G.list_boxes(G.deprecate(registry, "name", "c"), active_only=True).count() == 1


def test_packs(spark, tmp_path):
    path = tmp_path / "pack.json"
    path.write_text(json.dumps(PACK))
    pack = G.Pack.from_file(spark, str(path))
    got = {(r.part, r.whole, r.anchored) for r in pack.closure(spark).collect()}
    assert got == {("bearing", "pump", "direct"), ("roller", "bearing", "direct"), ("steel", "bearing", "direct"), ("roller", "pump", "rollup")}
    packs = G.load_pack(spark.createDataFrame([], G.PACK_SCHEMA), pack, F.current_timestamp())
    assert G.load_pack(packs, G.Pack.from_dict(PACK | {"entities": PACK["entities"][::-1]}), F.current_timestamp()).count() == 1
    with pytest.raises(ValueError, match="other content"):
        G.load_pack(packs, G.Pack.from_dict(PACK | {"part_of": []}), F.current_timestamp())
    assert G.active_packs(G.deprecate_pack(packs, "pump", "1", F.current_timestamp())).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        G.Pack.from_dict(PACK | {"part_of": [{"part": "pump", "whole": "moon"}]})
    with pytest.raises(ValueError, match="cycle"):
        G.Pack.from_dict(PACK | {"part_of": PACK["part_of"] + [{"part": "pump", "whole": "roller"}]}).closure(spark)


def test_scans(spark):
    nodes = spark.sql("select 1 id, 'b' box, 0.5D confidence, cast(null as timestamp) valid_to union all select 2, 'b', null, null union all select 3, 'z', 0.1D, timestamp'2024-01-01'")
    got = C.reasoning_nodes({"fact": nodes, "hypothesis": nodes.where("id = 2")})
    assert {(r.label, r.id, r.confidence) for r in got.collect()} == {("fact", 1, 0.5), ("fact", 2, 1.0), ("hypothesis", 2, 1.0)}
    derived = spark.createDataFrame([(1, 5, None, 0.5), (1, 6, None, 0.4), (2, 5, "g", 0.9), (9, 5, "g2", 0.9)], "conclusion int, antecedent int, derivation string, strength double")
    rules = {r.rule: (r.head, r.body, r.strength) for r in C.group_derivations(derived, nodes.where("valid_to is null")).collect()}
    assert rules == {"by-conclusion:1": (1, [5, 6], 0.4), "g": (2, [5], 0.9)}
    e = spark.sql("select 1 src, 2 dst, cast(null as double) strength, cast(null as timestamp) valid_to union all select 1, 3, 0.5D, null")
    assert [tuple(r) for r in C.evidential_edges(e, e.where("false"), nodes.where("id < 3")).collect()] == [(1, 2, "supports", 1.0)]
    g, h = G.sample_graph(spark, 100, 4)
    assert g.count() == 100 and h.count() == 99


def test_models(spark):
    calls = N.guided_calls(spark.createDataFrame([("a\nb",), ("",)], "prompt string"), "prompt", T._parse_datatype_string("items array<struct<text string>>"))
    assert [[i.text for i in r.reply["items"]] for r in calls.collect()] == [["b"], []]

    def broken(prompt):
        raise OSError("down")

    assert N.guided_calls(calls.select("prompt"), "prompt", T._parse_datatype_string("items array<string>"), broken, 2).where("failure like 'OSError%'").count() == 2
    steps = iter([{"query": "q"}, {"query": "q2"}, {"answer": "yes"}])
    out = N.agentic_search("?", lambda q, seen: next(steps), lambda q: [1, len(q)])
    assert out.answer == "yes" and out.seen == [1, 2] and out.queries == ["q", "q2"]
    assert N.agentic_search("?", lambda q, seen: {"odd": 1}, lambda q: []).answer is None
    answers = spark.createDataFrame([("q1", 'say "hi"', ["c1"], 0.5)], N.ANSWER_SCHEMA)
    assert N.read_answers(spark, N.write_answers(answers)).collect() == answers.collect()


def test_reembedding_moves_stale_rows_only(spark):
    v = spark.createDataFrame([(1, "a b", "old", [0.0] * 4), (2, "a", "new", [9.0] * 4)], "id int, text string, model string, vector array<double>")
    got = {r.id: r for r in D.reembed(v, "new", D.hash_embedder(4)).collect()}
    assert got[2].vector == [9.0] * 4 and got[1].model == "new" and sum(x * x for x in got[1].vector) == pytest.approx(1)


def test_streams(spark, sf):
    s = I.event_stream(spark, f"{sf}/events.parquet")
    landed = spark.read.parquet(I.run_once(I.first_arrivals(s, ["user_id"], "ts", "60 days").select("user_id"), "t"))
    assert landed.count() == landed.distinct().count() > 0
    out = I.two_stages(s.select("event_id", "value"), "chain", lambda df: df.where("value > 50"), lambda df: df.where("event_id % 2 = 0"))
    assert out.count() == spark.read.parquet(f"{sf}/events.parquet").where("value > 50 and event_id % 2 = 0").count()


def test_lifecycle(spark):
    p = spark.createDataFrame([("p1", "h1"), ("p2", "h0"), ("p3", "h0")], "proposition string, extraction_hash string")
    purge, blocked = L.purge_stale(p, "h1", spark.createDataFrame([("p3",)], "proposition string"))
    assert [r.proposition for r in purge.collect()] == ["p2"] and [r.proposition for r in blocked.collect()] == ["p3"]
    log = spark.createDataFrame([("p1", "s0", 1, "a"), ("p1", "s1", 2, "b"), ("p2", "s0", 3, "c")], "proposition string, signature string, ts int, action string")
    assert [r.proposition for r in L.stale_verifications(log, "s1").collect()] == ["p2"]
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    read = L.level_readings(
        nodes, spark.createDataFrame([(1, "t", "confirmed"), (2, "t", "candidate")], "id int, target string, state string"),
        spark.createDataFrame([("t", 4)], "target string, depth int"), spark.createDataFrame([(1, 1), (2, 2)], "id int, depth int"),
    )
    assert {tuple(r) for r in read.collect()} == {(1, 4, "anchored"), (2, 2, "induced"), (3, None, "none")}
    assert L.fact_levels(spark.createDataFrame([("f", 1), ("f", 2), ("g", 3)], "fact string, id int"), read).collect()[0].levels == [2, 4]
    edges = spark.sql("select 1 a, 2 b, 'candidate' state, timestamp'2024-01-01' valid_from, cast(null as timestamp) valid_to")
    assert L.merge_components(edges, (2, 1), F.current_timestamp()).where("state = 'confirmed'").count() == 1
    assert L.merge_components(edges, (1, 3), F.current_timestamp()).count() == 2
