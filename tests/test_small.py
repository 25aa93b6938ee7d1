"""Small operators by cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import adjudicate as A
from tracewright.operators import candidates as C
from tracewright.operators import lifecycle as L
from tracewright.operators import metrics as M
from tracewright.operators import provenance as O
from tracewright.operators import resolve as R
from tracewright.plans import fixpoint as X
from tracewright.plans import storage
from tracewright.sources import models as N
from tracewright.sources import registry as G


def at():
    return F.lit("2024-02-01").cast("timestamp")


def test_settling_of_single_arguments(spark):
    rows = [(0, "a", 0.5), (1, "a", 0.5), (2, "a", 0.5), (0, "b", 0.1), (1, "b", 0.2), (2, "b", 0.3), (3, "b", 0.3)]
    got = X.settle_sweep(spark.createDataFrame(rows, "sweep int, arg string, sigma double")).collect()
    assert {r.arg: r.settled_at for r in got} == {"a": 0, "b": 2}


def test_gold_edges_of_planted_items(spark):
    planted = spark.createDataFrame([("i", "refuter", None, "h1"), ("j", "dissimilar_refuter", None, "h1"), ("k", "supporter", "h2", None)], "item string, kind string, supports string, refutes string")
    got = sorted(map(tuple, M.gold_edges(planted).collect()))
    assert got == [("i", "h1", "refutes", False), ("j", "h1", "refutes", True), ("k", "h2", "supports", False)]


def test_latency_leaves_out_the_warm_up(spark):
    calls = []
    got = M.latency(spark, lambda: calls.append(1), 5)
    assert len(calls) == 6 and 0 <= got["median"] <= got["p95"]


def test_rows_are_closed_once_and_never_removed(spark):
    rows = spark.createDataFrame([("a", "b", None), ("a", "c", None), ("x", "y", "2020-01-01")], "a string, b string, v string").select("a", "b", F.col("v").cast("timestamp").alias("valid_to"))
    split = spark.createDataFrame([("a", "b"), ("x", "y")], "a string, b string")
    for got in (R.close_edges(rows, split, at()), L.expire(rows, split, ["a", "b"], at())):
        assert {(r.a, r.b): str(r.valid_to)[:10] for r in got.collect()} == {("a", "b"): "2024-02-01", ("a", "c"): "None", ("x", "y"): "2020-01-01"}


def test_log_grows_by_what_it_lacks(spark):
    log = spark.createDataFrame([("1", '{"k": "v"}')], "action string, inputs string")
    more = spark.createDataFrame([("1", "changed"), ("2", '{"k": "w"}')], "action string, inputs string")
    out = O.append_actions(log, more)
    assert {(r.action, r.inputs) for r in out.collect()} == {("1", '{"k": "v"}'), ("2", '{"k": "w"}')}
    assert [r.action for r in out.where(O.json_equals("inputs", "k", "w")).collect()] == ["2"]


def test_pool_by_hypothesis_and_first_replies(spark):
    pool = spark.createDataFrame([("e2", "h"), ("e1", "h"), ("e9", "g")], "evidence string, hypothesis string")
    assert {r.hypothesis: r.evidence for r in C.evidence_by_hypothesis(pool).collect()} == {"h": ["e1", "e2"], "g": ["e9"]}
    replies = spark.createDataFrame([("e", "h", 0, 1, "refutes"), ("e", "h", 0, 0, "supports"), ("e", "h", 1, 0, "refutes")], "evidence string, hypothesis string, sample int, position int, vote string")
    assert {r["sample"]: r.vote for r in A.first_vote(replies).collect()} == {0: "supports", 1: "refutes"}


def test_one_vector_space_is_guarded(spark):
    rows = spark.createDataFrame([("m",), ("m",)], "model string")
    assert C.guard_one_model(rows, "m").count() == 2
    with pytest.raises(Exception, match="can't be mixed"):
        C.guard_one_model(rows, "n").collect()


def test_boxes_and_anchors(spark):
    box = G.working_box("notes", version="2")
    assert box.tier == "working" and box.id != G.working_box("notes").id
    anchors = spark.createDataFrame([("e", "t", 0.9, "confirmed")], "mention string, target string, score double, state string")
    assert [(r.src, r.dst, r.etype, r.state) for r in G.anchor_edges(anchors, F.lit("b"), at()).collect()] == [("e", "t", "ANCHORS_TO", "confirmed")]


def test_questions_are_read(spark, tmp_path):
    (tmp_path / "q.toml").write_text('[[question]]\nid = "q1"\ntext = "Why?"\naxis = "root_cause"\n[[question]]\nid = "q2"\ntext = "Who?"\n')
    got = N.read_questions(spark, f"file://{tmp_path}/q.toml").collect()
    assert [tuple(r) for r in got] == [("q1", "Why?", "root_cause"), ("q2", "Who?", None)]


def test_worst_quality_of_sources(spark):
    rows = spark.createDataFrame([(["digital", "ocr"],), (["handwritten", "ocr", None],), (["unheard"],), ([],)], "q array<string>")
    assert [r[0] for r in rows.select(S.worst_quality(F.col("q"))).collect()] == ["ocr", "handwritten", None, None]


def test_transitive_kinds(spark):
    rows = spark.createDataFrame([("component-integral",), ("stuff-object",)], "m string")
    assert [r[0] for r in rows.select(S.is_transitive(F.col("m"))).collect()] == [True, False]


def test_session_settings_and_run_folder(spark, tmp_path, monkeypatch):
    assert L.make_session("tests", **{"spark.sql.shuffle.partitions": "4"}).conf.get("spark.sql.adaptive.enabled") == "true"
    monkeypatch.setattr(spark.sparkContext, "_tracewright_run", f"file://{tmp_path}/run", raising=False)
    storage.materialize(spark.range(1), "x")
    assert list((tmp_path / "run").iterdir())
    storage.clear_run(spark)
    assert not (tmp_path / "run").exists()
