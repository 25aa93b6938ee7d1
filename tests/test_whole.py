"""Queries do the whole job: no rows, rules or premises are left out."""

import pytest

from tracewright import views as V
from tracewright.catalogue import QUERIES
from tracewright.operators import adjudicate as A
from tracewright.queries import argument


def test_revision_takes_every_premise(spark, sf, monkeypatch):
    seen = {}

    def stop(grounded, rules, *rest):
        seen["rules"] = rules
        raise StopIteration

    monkeypatch.setattr(A, "revise", stop)
    with pytest.raises(StopIteration):
        argument.revision_fixpoint(spark, sf)
    want = V.derivations(spark, sf)[1].selectExpr("cast(rule as string)", "cast(atom as string)").collect()
    assert sorted(map(tuple, seen["rules"].select("rule", "atom").collect())) == sorted(map(tuple, want))


@pytest.mark.parametrize("kind", ["cumulative", "averaging"])
def test_fusion_takes_every_opinion(spark, sf, kind):
    votes = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag").collect():
        votes.setdefault(r.l_orderkey, {}).setdefault(r.l_linenumber, []).append(r.l_returnflag)
    want = {}
    for order, lines in votes.items():
        done = None
        for _, flags in sorted(lines.items()):
            p, n = flags.count("A"), flags.count("R")
            b, d, u = p / (p + n + 2), n / (p + n + 2), 2 / (p + n + 2)
            if done:
                fb, fd, fu = done
                k = fu + u - fu * u if kind == "cumulative" else fu + u
                b, d, u = (fb * u + b * fu) / k, (fd * u + d * fu) / k, (1 if kind == "cumulative" else 2) * fu * u / k
            done = b, d, u
        want[order] = done
    assert max(map(len, votes.values())) > 3
    got = QUERIES[f"opinion_fusion_{kind}"](spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.belief, r.disbelief, r.uncertainty) == pytest.approx(want[r.l_orderkey], abs=2e-6)


def test_pending_work_of_every_customer(spark, sf, tmp_path):
    customers = [1, 200, 201, 5000]
    spark.createDataFrame([(c,) for c in customers], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    events = [(1, "click"), (201, "click"), (7, "view")]
    spark.createDataFrame(events, "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["pending_work_antijoin"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((c, t) for c in customers for t in ("click", "view") if (c, t) not in events)


def made_no_pairs(monkeypatch):
    from tracewright.operators import resolve as R

    def fail(*args):
        raise AssertionError("components need no pairs")

    monkeypatch.setattr(R, "resolve", fail)


def test_anchored_components_make_no_pairs(spark, sf, monkeypatch):
    made_no_pairs(monkeypatch)
    assert not QUERIES["anchored_components"](spark, sf).isEmpty()


def test_component_evidence_makes_no_pairs(spark, sf, monkeypatch):
    made_no_pairs(monkeypatch)
    assert not QUERIES["component_evidence"](spark, sf).isEmpty()
