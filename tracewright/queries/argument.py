"""Verdicts, votes, gates, edge plans, opinions and revision."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright import views as V
from tracewright.catalogue import query
from tracewright.functions import policy as P
from tracewright.functions import scalars as S
from tracewright.operators import adjudicate as A
from tracewright.operators import provenance as O
from tracewright.plans import fixpoint as X

EVIDENCE = """ev AS (
  SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey AS fact, l_orderkey AS hypothesis, l_partkey AS part, l_suppkey AS box,
    1 - avg(l_discount) AS base, CASE WHEN max(l_returnflag) = 'R' THEN 'refutes' ELSE 'supports' END AS sign,
    avg(l_quantity) / 50 AS strength, count(*) AS support_count, min(l_shipdate) AS valid_from
  FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey)"""
BOXES = """bx AS (
  SELECT s_suppkey AS box, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'case' WHEN 1 THEN 'working' WHEN 2 THEN 'reference' ELSE 'domain' END AS tier,
    CASE WHEN s_suppkey % 10 = 0 THEN 'deprecated' ELSE 'active' END AS status, least(1.0, greatest(0.0, s_acctbal / 10000)) AS reliability_prior FROM supplier)"""
BAND = "CASE WHEN a < 0.25 THEN 'false' WHEN a < 0.5 THEN 'implausible' WHEN a < 0.75 THEN 'plausible' ELSE 'true' END"
STATE = "CASE WHEN a >= 0.5 THEN 'supported' WHEN attack > support THEN 'refuted' ELSE 'unsupported' END"


def _verdict_sql(agg: str, combine: str) -> str:
    return f"""WITH {EVIDENCE},
inward AS (SELECT hypothesis, {agg.format('supports')} AS support, {agg.format('refutes')} AS attack FROM (SELECT *, strength * base AS x FROM ev) GROUP BY hypothesis),
hyp AS (SELECT o_orderkey AS hypothesis, 0.4::DOUBLE AS base, coalesce(support, 0.0) AS support, coalesce(attack, 0.0) AS attack
  FROM orders LEFT JOIN inward ON o_orderkey = hypothesis WHERE o_orderstatus = 'P'),
solved AS (SELECT *, least(1.0, greatest(0.0, {combine})) AS a FROM hyp)
SELECT hypothesis, round(a, 6) AS acceptability, round(support, 6) AS support, round(attack, 6) AS attack, {BAND} AS band, {STATE} AS state FROM solved"""


QUAD = "CASE WHEN support > attack THEN base + (1 - base) * (support - attack) WHEN attack > support THEN base - base * (attack - support) ELSE base END"
PROB = "coalesce(1 - product(1 - x) FILTER (WHERE sign = '{}'), 0.0)"
PULL = "((support - attack) * (support - attack) / (1 + (support - attack) * (support - attack)))"
ENERGY = f"CASE WHEN support > attack THEN base + (1 - base) * {PULL} WHEN attack > support THEN base - base * {PULL} ELSE base END"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("acceptability", "support", "attack")})


def verdicts(spark, sf_dir, semantics=P.DF_QUAD):
    return A.verdicts(V.hypotheses(spark, sf_dir), V.evidence(spark, sf_dir), semantics)


@query(_verdict_sql(PROB, QUAD))
def hypothesis_verdicts(spark, sf_dir):
    return _rounded(verdicts(spark, sf_dir))


@query(_verdict_sql("coalesce(sum(x) FILTER (WHERE sign = '{}'), 0.0)", ENERGY))
def hypothesis_verdicts_energy(spark, sf_dir):
    return _rounded(verdicts(spark, sf_dir, P.QUADRATIC_ENERGY))


CYCLE = """o AS (SELECT o_orderkey AS src, coalesce(lead(o_orderkey) OVER w, first_value(o_orderkey) OVER w) AS dst FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
edges AS (SELECT src, dst, CASE WHEN src % 2 = 0 THEN 'supports' ELSE 'refutes' END AS sign FROM o WHERE src <> dst)"""
SWEEPS = 6


def _sweep_sql(n: int) -> str:
    return f"""s{n} AS (SELECT arg, base, {QUAD} AS sigma FROM (
  SELECT a.arg, a.base, coalesce(support, 0.0) AS support, coalesce(attack, 0.0) AS attack FROM s{n - 1} a LEFT JOIN (
    SELECT dst, {PROB.format('supports')} AS support, {PROB.format('refutes')} AS attack
    FROM (SELECT dst, sign, 0.5 * sigma AS x FROM edges JOIN s{n - 1} ON src = arg) GROUP BY dst) i ON a.arg = i.dst))"""


@query(
    f"WITH {CYCLE},\ns0 AS (SELECT o_orderkey AS arg, 0.25 + (o_orderkey % 3) * 0.25 AS base, 0.25 + (o_orderkey % 3) * 0.25 AS sigma FROM orders),\n"
    + ",\n".join(map(_sweep_sql, range(1, SWEEPS + 1)))
    + f"\nSELECT arg, round(sigma, 6) AS sigma FROM s{SWEEPS}"
)
def qbaf_cyclic_sweeps(spark, sf_dir):
    """A fixed number of synchronous sweeps over the customers' order cycles."""
    args = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("arg"), (0.25 + (F.col("o_orderkey") % 3) * 0.25).alias("base"))
    return X.run_sweeps(args, V.order_cycles(spark, sf_dir), SWEEPS).select("arg", F.round("sigma", 6).alias("sigma"))


@query()
def qbaf_settled(spark, sf_dir):
    """Full solution of the cyclic framework, with tail variance of the last sweeps."""
    args = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("arg"), F.lit(0.5).alias("base"))
    solved = X.solve(args, V.order_cycles(spark, sf_dir), max_sweeps=64, keep_last=16)
    tails = X.tail_variances(solved.tail)
    return solved.strengths.join(tails, "arg").select("arg", F.round("sigma", 6).alias("sigma"), F.round("variance", 9).alias("variance"), "oscillating")


VOTES = """votes AS (SELECT l_partkey AS evidence, l_orderkey AS hypothesis,
  CASE WHEN l_returnflag = 'R' THEN 'refutes' WHEN l_linestatus = 'O' THEN 'supports' ELSE 'irrelevant' END AS vote FROM lineitem)"""
TALLY = """counts AS (SELECT evidence, hypothesis, count(*) FILTER (WHERE vote = 'supports') AS positive, count(*) FILTER (WHERE vote = 'refutes') AS negative,
  count(*) FILTER (WHERE vote = 'irrelevant') AS abstained, count(*) AS n_samples FROM votes GROUP BY ALL),
tally AS (SELECT *, CASE WHEN abstained > positive AND abstained > negative THEN 'irrelevant' WHEN negative > positive THEN 'refutes' ELSE 'supports' END AS sign,
  least(positive, negative) = 0 AS sign_stable FROM counts),
judged AS (SELECT *, CASE WHEN sign = 'irrelevant' THEN 0.0::DOUBLE
  ELSE greatest(positive, negative) / (positive + negative + 2.0::DOUBLE) + 0.5::DOUBLE * (2.0::DOUBLE / (positive + negative + 2.0::DOUBLE)) END AS strength FROM tally)"""


def votes(spark, sf_dir):
    vote = F.when(F.col("l_returnflag") == "R", "refutes").when(F.col("l_linestatus") == "O", "supports").otherwise("irrelevant")
    return V.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("evidence"), F.col("l_orderkey").alias("hypothesis"), vote.alias("vote"))


@query(f"WITH {VOTES}, {TALLY} SELECT evidence, hypothesis, sign, round(strength, 6) AS strength, sign_stable, n_samples FROM judged")
def judge_vote_tally(spark, sf_dir):
    out = A.tally(votes(spark, sf_dir))
    return out.select("evidence", "hypothesis", "sign", F.round("strength", 6).alias("strength"), "sign_stable", "n_samples")


PANEL = """panel AS (SELECT h.hypothesis, h.state, coalesce(llm, 'abstain') AS llm, CASE h.hypothesis % 3 WHEN 0 THEN 'affirm' WHEN 1 THEN 'abstain' ELSE 'dissent' END AS symbolic
  FROM v h LEFT JOIN (SELECT hypothesis, CASE WHEN count(*) FILTER (WHERE sign = 'refutes' AND sign_stable) > 0 THEN 'affirm' ELSE 'abstain' END AS llm FROM judged GROUP BY hypothesis) j
  ON h.hypothesis = j.hypothesis)"""
GATE = (
    f"WITH {VOTES}, {TALLY}, v AS ({_verdict_sql(PROB, QUAD)}), {PANEL}, "
    "gate AS (SELECT *, concat_ws(',', CASE WHEN llm <> 'affirm' THEN 'llm:' || llm END, CASE WHEN symbolic <> 'affirm' THEN 'symbolic:' || symbolic END) AS reasons FROM panel) "
)


def _heard(rows, spark, sf_dir):
    """Adds what the language and symbolic channels say of each hypothesis."""
    llm = A.llm_channel(A.tally(votes(spark, sf_dir)))
    k = F.col("hypothesis") % 3
    symbolic = F.when(k == 0, "affirm").when(k == 1, "abstain").otherwise("dissent")
    return rows.join(llm, "hypothesis", "left").withColumns({"llm": F.coalesce("llm", F.lit("abstain")), "symbolic": symbolic})


def _panel(spark, sf_dir):
    return A.authorise_panel(_heard(verdicts(spark, sf_dir).select("hypothesis", "acceptability", "state"), spark, sf_dir))


@query(GATE + "SELECT hypothesis, llm, symbolic, reasons = '' AS authorised, reasons FROM gate")
def gate_decisions(spark, sf_dir):
    return _panel(spark, sf_dir).select("hypothesis", "llm", "symbolic", "authorised", F.array_join("reasons", ",").alias("reasons"))


@query(
    GATE
    + "SELECT hypothesis, CASE WHEN state = 'refuted' AND reasons <> '' THEN CASE WHEN hypothesis % 2 = 0 THEN 'supported' ELSE 'unsupported' END ELSE state END AS state, "
    "state = 'refuted' AND reasons <> '' AS pending_refutation FROM gate"
)
def held_refutations(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    prior = panel.select("hypothesis", F.when(F.col("hypothesis") % 2 == 0, "supported").otherwise("unsupported").alias("state"))
    held = A.hold_refutations(panel.select("hypothesis", "acceptability", "state"), panel, prior)
    return held.select("hypothesis", "state", "pending_refutation")


JUDGED = f"""{EVIDENCE}, {BOXES}, rated AS (SELECT fact AS evidence, hypothesis, sign, strength, tier,
  least(1.0, greatest(0.0, reliability_prior * CASE WHEN part % 3 = 0 THEN 1.0 ELSE 0.5 END)) AS credibility, part % 5 = 0 AS doubtful FROM ev LEFT JOIN bx USING (box)),
stakes AS (SELECT *, sign = 'refutes' OR count(*) FILTER (WHERE sign = 'supports') OVER (PARTITION BY hypothesis) <= 1 AS high,
  least(1.0, greatest(0.0, CASE tier WHEN 'case' THEN 0.9 ELSE 1.0 END * coalesce(credibility, 1.0))) AS significance FROM rated)"""
SIGNIFICANCE = P.Significance((("case", 0.9),))


def plan(spark, sf_dir):
    ev = V.evidence(spark, sf_dir).join(V.boxes(spark, sf_dir).select("box", "tier", "reliability_prior"), "box", "left")
    doubt = F.when(F.col("part") % 5 == 0, F.array(F.lit("low_faithfulness"))).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.col("part") % 3 == 0, "observation").otherwise("testimony")
    judged = ev.select(
        F.col("fact").alias("evidence"), "hypothesis", "sign", "strength", "tier", doubt.alias("reasons"),
        S.effective_credibility(F.col("reliability_prior"), kind, F.lit("self")).alias("credibility"),
    )
    return A.plan_edges(judged, SIGNIFICANCE)


EDGE = "evidence, hypothesis, sign, round(strength, 6) AS strength, CASE WHEN high THEN 'high' ELSE 'low' END AS stakes, round(significance, 6) AS significance"


def _edges(df):
    return df.select("evidence", "hypothesis", "sign", F.round("strength", 6).alias("strength"), "stakes", F.round("significance", 6).alias("significance"))


@query(f"WITH {JUDGED} SELECT {EDGE} FROM stakes WHERE NOT (high AND doubtful)")
def edge_plan(spark, sf_dir):
    return _edges(plan(spark, sf_dir).edges)


@query(f"WITH {JUDGED} SELECT {EDGE} FROM stakes WHERE high AND doubtful")
def edge_quarantine(spark, sf_dir):
    return _edges(plan(spark, sf_dir).quarantined)


CRED = f"""WITH {EVIDENCE}, {BOXES} SELECT fact, round(least(1.0, greatest(0.0, reliability_prior * (1 + CASE WHEN part % 3 = 0 THEN 0.0 ELSE 1.0 END *
  (CASE part % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 1.3 ELSE 1.0 END - 1)))), 6) AS credibility FROM ev LEFT JOIN bx USING (box)"""


@query(CRED)
def effective_credibility(spark, sf_dir):
    ev = V.evidence(spark, sf_dir)
    align = F.element_at(F.array(*map(F.lit, ("self", "neutral", "against", "unknown"))), (F.col("part") % 4 + 1).cast("int"))
    facts = ev.select("fact", "box", align.alias("alignment"))
    props = ev.select("fact", F.col("part").alias("proposition"), F.when(F.col("part") % 3 == 0, "observation").otherwise("judgement").alias("epistemic_class"))
    return O.credibility(facts, V.boxes(spark, sf_dir), props).select("fact", F.round("credibility", 6).alias("credibility"))


def _opinions(spark, sf_dir):
    """For each order one opinion a line number from its votes, ordered, as an array."""
    side = lambda v: F.count_if(F.col("l_returnflag") == v).cast("double")
    each = V.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(S.opinion(side("A"), side("R")).alias("o"))
    return each.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "o"))), lambda s: s["o"]).alias("opinions"))


def _fused(spark, sf_dir, fusion):
    out = _opinions(spark, sf_dir).select("l_orderkey", P.fuse(F.col("opinions"), fusion).alias("o"))
    parts = {c: F.round(F.col(f"o.{c}"), 6) for c in ("belief", "disbelief", "uncertainty")}
    return out.select("l_orderkey", *[v.alias(k) for k, v in parts.items()], F.round(S.projected(F.col("o")), 6).alias("projected"))


def _fusion_sql(u: str, k: str) -> str:
    """A left fold over all opinions of an order, one step a recursion."""
    return f"""WITH RECURSIVE ops AS (SELECT l_orderkey, l_linenumber, p / (p + n + 2) AS b, n / (p + n + 2) AS d, 2 / (p + n + 2) AS u FROM (
  SELECT l_orderkey, l_linenumber, (count(*) FILTER (WHERE l_returnflag = 'A'))::DOUBLE AS p, (count(*) FILTER (WHERE l_returnflag = 'R'))::DOUBLE AS n FROM lineitem GROUP BY ALL)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM ops),
f AS (SELECT l_orderkey, r, b, d, u FROM ranked WHERE r = 1 UNION ALL
  SELECT f.l_orderkey, x.r, (f.b * x.u + x.b * f.u) / ({k}), (f.d * x.u + x.d * f.u) / ({k}), {u} / ({k}) FROM f JOIN ranked x ON f.l_orderkey = x.l_orderkey AND x.r = f.r + 1)
SELECT l_orderkey, round(b, 6) AS belief, round(d, 6) AS disbelief, round(u, 6) AS uncertainty, round(b + 0.5 * u, 6) AS projected
FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY r DESC) = 1"""


@query(_fusion_sql("f.u * x.u", "f.u + x.u - f.u * x.u"))
def opinion_fusion_cumulative(spark, sf_dir):
    return _fused(spark, sf_dir, P.cumulative_fuse)


@query(_fusion_sql("2 * f.u * x.u", "f.u + x.u"))
def opinion_fusion_averaging(spark, sf_dir):
    return _fused(spark, sf_dir, P.averaging_fuse)


def _customers_apart(spark, sf_dir):
    """Whether each order is one customer's and each line names its order, part and supplier, so that no node is two customers'."""
    orders = V.table(spark, sf_dir, "orders").where("o_orderkey is not null").groupBy("o_orderkey")
    region = V.region_of(F.col("o_custkey"))
    shared = orders.agg(F.min(region).alias("a"), F.max(region).alias("b")).where("a <> b")
    vague = V.table(spark, sf_dir, "lineitem").where("l_orderkey is null or l_partkey is null or l_suppkey is null")
    return vague.isEmpty() and shared.isEmpty()


@query()
def revision_fixpoint(spark, sf_dir):
    """The revision loop over all derivations: what is left standing once refutations are carried through.

    Rules and evidence stay within a customer's orders, so customers are the regions. Facts are given sources.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    apart = _customers_apart(spark, sf_dir)
    region = ["region"] if apart else []
    base, body = V.derivations(spark, sf_dir, regions=apart)
    ev = V.evidence(spark, sf_dir)
    grounded = base.select(text("node"), "confidence", *region)
    rules = body.select(text("rule"), text("head"), text("atom"), "strength", *region)
    hyp = V.hypotheses(spark, sf_dir, regions=apart).withColumn("hypothesis", text("hypothesis"))
    edges = ev.select(F.col("fact").alias("src"), F.col("hypothesis").cast("string").alias("dst"), "sign", "strength", F.col("base").alias("sigma"))
    gate = _heard(V.hypotheses(spark, sf_dir).select("hypothesis"), spark, sf_dir).select(text("hypothesis"), "llm", "symbolic")
    out = A.revise(grounded, rules, hyp, edges, gate)
    return out.verdicts.groupBy("state").agg(F.count("*").alias("hypotheses"), F.round(F.avg("acceptability"), 6).alias("mean_acceptability"))


SYMBOLIC = """facts AS (SELECT label AS query, 'k' || (vec_id % 40) AS key, CASE WHEN CASE label WHEN 0 THEN vec_id % 3 WHEN 1 THEN 0 ELSE vec_id % 40 % 7 END = 0 THEN '-' ELSE '+' END AS polarity FROM embeddings),
refuters AS (SELECT DISTINCT label AS query, 'k' || (vec_id % 55) AS key, '-' AS polarity FROM embeddings),
bad AS (SELECT DISTINCT query FROM (SELECT query, key FROM facts GROUP BY ALL HAVING count(DISTINCT polarity) > 1)),
worse AS (SELECT DISTINCT query FROM (SELECT query, key FROM (SELECT * FROM facts UNION SELECT * FROM refuters) GROUP BY ALL HAVING count(DISTINCT polarity) > 1))"""


@query(
    f"WITH {SYMBOLIC}, o AS (SELECT DISTINCT r.query, r.key, CASE WHEN b.query IS NOT NULL THEN 'indeterminate' WHEN f.key IS NULL THEN 'unrelated' "
    "WHEN w.query IS NOT NULL THEN 'contradictory' ELSE 'consistent' END AS outcome FROM refuters r LEFT JOIN (SELECT DISTINCT query, key FROM facts) f "
    "ON r.query = f.query AND r.key = f.key LEFT JOIN bad b ON r.query = b.query LEFT JOIN worse w ON r.query = w.query) SELECT query::INTEGER AS query, key, outcome, "
    "CASE outcome WHEN 'contradictory' THEN 'affirm' WHEN 'consistent' THEN 'dissent' ELSE 'abstain' END AS symbolic FROM o"
)
def symbolic_consistency(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").withColumn("query", F.col("label"))
    key = lambda n: F.concat(F.lit("k"), (F.col("vec_id") % n).cast("string")).alias("key")
    mark = F.when(F.col("label") == 0, F.col("vec_id") % 3).when(F.col("label") == 1, 0).otherwise(F.col("vec_id") % 40 % 7)
    facts = e.select("query", key(40), F.when(mark == 0, "-").otherwise("+").alias("polarity"))
    refuters = e.select("query", key(55), F.lit("-").alias("polarity"))
    return A.check_consistency(facts, refuters)


@query(
    f"WITH {EVIDENCE} SELECT hypothesis, max(CASE box % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END)::INTEGER AS level, "
    "array_to_string(list_sort(list_distinct(list('c' || (part % 6)))), ',') AS compartments FROM ev GROUP BY hypothesis"
)
def sensitivity_lub(spark, sf_dir):
    rows = V.evidence(spark, sf_dir).select("hypothesis", (F.col("box") % 4).cast("int").alias("level"), F.array(F.concat(F.lit("c"), (F.col("part") % 6).cast("string"))).alias("compartments"))
    return O.sensitivity_lub(rows, "hypothesis").withColumn("compartments", F.array_join("compartments", ","))


@query(
    f"""WITH {EVIDENCE}, r AS (SELECT hypothesis AS node, CASE WHEN part % 5 = 0 THEN 'low_faithfulness' WHEN part % 7 = 0 THEN 'unassessed_faithfulness' END AS reason
  FROM ev)
SELECT o_orderkey AS node, CASE WHEN count(node) = 0 THEN 'missing_provenance' ELSE coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') END AS reasons
FROM orders LEFT JOIN r ON o_orderkey = node GROUP BY o_orderkey"""
)
def provisional_fold(spark, sf_dir):
    ev = V.evidence(spark, sf_dir)
    reason = F.when(F.col("part") % 5 == 0, "low_faithfulness").when(F.col("part") % 7 == 0, "unassessed_faithfulness")
    props = ev.select(F.col("hypothesis").alias("node"), F.array_compact(F.array(reason)).alias("reasons"))
    nodes = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"))
    return O.provisional_fold(nodes, props).select("node", F.array_join("reasons", ",").alias("reasons"))


@query(
    f"""WITH {EVIDENCE}, f AS (SELECT fact, base AS verify, CASE part % 3 WHEN 0 THEN 'entailed' WHEN 1 THEN 'neutral' ELSE 'contradicted' END AS verdict,
  part % 4 <> 0 AS polarity_kept, part % 5 <> 0 AS modality_kept, CASE part % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.6 ELSE 1.0 END AS quality FROM ev),
g AS (SELECT *, CASE verdict WHEN 'entailed' THEN 1.0 WHEN 'neutral' THEN 0.3 ELSE 0.0 END * CASE WHEN polarity_kept THEN 1.0 ELSE 0.4 END * CASE WHEN modality_kept THEN 1.0 ELSE 0.7 END AS score FROM f)
SELECT fact, round(score * verify * quality, 6) AS faithfulness, CASE WHEN score * verify * quality < 0.5 THEN 'low_faithfulness' ELSE '' END AS reasons FROM g"""
)
def faithfulness_scores(spark, sf_dir):
    ev = V.evidence(spark, sf_dir)
    pick = lambda n, names: F.get(F.array(*map(F.lit, names)), (F.col("part") % n).cast("int"))
    verify = S.faithfulness(pick(3, ("entailed", "neutral", "contradicted")), F.col("part") % 4 != 0, F.col("part") % 5 != 0)
    score = S.combine_faithfulness(verify, F.col("base"), S.parse_quality(pick(4, ("digital", "ocr", "handwritten", "unknown"))))
    return ev.select("fact", F.round(score, 6).alias("faithfulness"), F.array_join(S.provisional_reasons(score), ",").alias("reasons"))


@query(f"WITH {BOXES} SELECT box, name, tier, status, round(reliability_prior, 6) AS reliability_prior FROM bx WHERE tier IN ('reference', 'domain') AND status = 'active'")
def box_registry(spark, sf_dir):
    from tracewright.sources.registry import list_boxes

    out = list_boxes(V.boxes(spark, sf_dir), ["reference", "domain"], active_only=True)
    return out.withColumn("reliability_prior", F.round("reliability_prior", 6))


@query(f"WITH {EVIDENCE}, {BOXES} SELECT box, count(*) AS facts, round(avg(base), 6) AS mean_base FROM ev SEMI JOIN (SELECT box FROM bx WHERE status = 'active') USING (box) GROUP BY box")
def active_node_semijoin(spark, sf_dir):
    from tracewright.sources.scans import active_nodes

    rows = active_nodes(V.evidence(spark, sf_dir), V.boxes(spark, sf_dir))
    return rows.groupBy("box").agg(F.count("*").alias("facts"), F.round(F.avg("base"), 6).alias("mean_base"))


@query(
    """WITH k AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
SELECT 'by-conclusion:' || o_custkey AS rule, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS body, min(1 - (o_orderkey % 7) / 100.0) AS strength FROM k WHERE n > 1 GROUP BY o_custkey"""
)
def derivation_rules(spark, sf_dir):
    from tracewright.sources.scans import group_derivations

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = V.table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).where("n > 1")
    rows = o.select(F.col("o_custkey").alias("conclusion"), F.col("o_orderkey").alias("antecedent"), F.lit(None).cast("string").alias("derivation"), (1 - (F.col("o_orderkey") % 7) / 100).alias("strength"))
    out = group_derivations(rows, V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))
    return out.select("rule", F.array_join("body", ",").alias("body"), "strength")
