"""Support, values, closures, components, temporal views and provenance."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright import views as V
from tracewright.catalogue import query
from tracewright.functions import policy as P
from tracewright.functions import scalars as S
from tracewright.operators import provenance as O
from tracewright.operators import resolve as R
from tracewright.operators import temporal as T
from tracewright.plans import fixpoint as X
from tracewright.plans.storage import materialize
from tracewright.queries.argument import EVIDENCE

CHAIN = """k AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER w AS n, first_value(o_orderpriority) OVER w AS first FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
BASE = "(0.5 + (o_orderkey % 50) / 100.0)"
STRENGTH = "(1 - (o_orderkey % 7) / 100.0)"


def _derivations(spark, sf_dir):
    return [materialize(df, "derivations") for df in V.derivations(spark, sf_dir)]


@query(f"WITH {CHAIN} SELECT o_orderkey AS node FROM k WHERE first <> '5-LOW'")
def truth_support(spark, sf_dir):
    base, body = _derivations(spark, sf_dir)
    return X.well_founded_support(base, body).select("node")


def _alternatives(spark, sf_dir):
    """The derivations, with a second rule for every order that rests on the one before it alone."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = V.table(spark, sf_dir, "orders").select((-1 - F.col("o_orderkey")).alias("rule"), F.col("o_orderkey").alias("head"), F.lag("o_orderkey").over(w).alias("atom"))
    base, body = V.derivations(spark, sf_dir)
    return materialize(base, "derivations"), materialize(body.select("rule", "head", "atom").union(o.where("atom is not null")), "derivations")


COUNT = "CAST(CASE WHEN n <= 2 THEN 1 ELSE 2 END AS BIGINT) AS support_count"


@query(f"WITH {CHAIN} SELECT o_orderkey AS node, {COUNT} FROM k WHERE first <> '5-LOW'")
def support_counts(spark, sf_dir):
    """Bases and fired rules; a second order's two rules have one body and count once."""
    base, body = _alternatives(spark, sf_dir)
    return X.support_counts(base, body, materialize(X.well_founded_support(base, body), "support"))


def _without(spark, sf_dir, facts, priority):
    gone = V.table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == priority).select(F.col("o_orderkey").alias("node"))
    return materialize(facts.join(gone, "node", "left_anti"), "derivations")


@query(f"WITH {CHAIN} SELECT o_orderkey AS node, {COUNT} FROM k WHERE first NOT IN ('5-LOW', '1-URGENT')")
def support_maintenance(spark, sf_dir):
    """Support and its counts after the urgent base facts were withdrawn, maintained from the old result."""
    base, body = _alternatives(spark, sf_dir)
    held = X.support_counts(base, body, materialize(X.well_founded_support(base, body), "support"))
    return X.maintain_support(materialize(held, "held"), base, body, _without(spark, sf_dir, base, "1-URGENT"), body)


@query(f"WITH {CHAIN} SELECT o_orderkey AS node, CAST(CASE WHEN n <= 2 OR o_orderkey % 5 = 0 THEN 1 ELSE 2 END AS BIGINT) AS support_count FROM k WHERE first <> '5-LOW'")
def support_insertion(spark, sf_dir):
    """Counts when facts come back and rules go at once: medium bases arrive, long rules of every fifth order leave."""
    base, body = _alternatives(spark, sf_dir)
    old = _without(spark, sf_dir, base, "3-MEDIUM")
    held = X.support_counts(old, body, materialize(X.well_founded_support(old, body), "support"))
    fewer = materialize(body.where("not (head % 5 = 0 and rule >= 0)"), "derivations")
    return X.maintain_support(materialize(held, "held"), old, body, base, fewer)


def _values(spark, sf_dir, semiring):
    base, body = _derivations(spark, sf_dir)
    held = materialize(X.well_founded_support(base, body), "support")
    return X.valuate(base, body, held, semiring).select("node", F.round("value", 6).alias("value"))


@query(
    f"WITH {CHAIN} SELECT o_orderkey AS node, round(min(CASE WHEN n = 1 THEN {BASE} ELSE {STRENGTH} END) OVER (PARTITION BY o_custkey ORDER BY n), 6) AS value "
    "FROM k WHERE first <> '5-LOW'"
)
def confidence_godel(spark, sf_dir):
    return _values(spark, sf_dir, P.GODEL)


@query(
    f"""WITH RECURSIVE {CHAIN}, r AS (
  SELECT o_custkey, n, o_orderkey, {BASE}::DOUBLE AS v1, 1.0::DOUBLE AS v2, 1.0::DOUBLE AS v3 FROM k WHERE n = 1 AND first <> '5-LOW'
  UNION ALL SELECT k.o_custkey, k.n, k.o_orderkey, r.v1 * r.v2 * r.v3 * (1 - (k.o_orderkey % 7) / 100.0), r.v1, r.v2 FROM r JOIN k ON k.o_custkey = r.o_custkey AND k.n = r.n + 1)
SELECT o_orderkey AS node, round(v1, 6) AS value FROM r"""
)
def confidence_viterbi(spark, sf_dir):
    return _values(spark, sf_dir, P.VITERBI)


EDGES = """edges AS (SELECT 'customer:' || c_custkey AS part, 'nation:' || c_nationkey AS whole FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)"""
CLOSURE = f"""{EDGES}, paths AS (SELECT part, whole, 1 AS depth FROM edges UNION SELECT p.part, e.whole, p.depth + 1 FROM paths p JOIN edges e ON p.whole = e.part)"""


@query(f"WITH RECURSIVE {CLOSURE} SELECT part, whole, min(depth)::INTEGER AS depth FROM paths GROUP BY ALL")
def partwhole_closure(spark, sf_dir):
    return X.part_whole_closure(V.part_whole(spark, sf_dir))


@query(f"WITH RECURSIVE {CLOSURE} SELECT part, count(DISTINCT whole) AS level FROM paths GROUP BY part")
def partwhole_levels(spark, sf_dir):
    return X.part_whole_closure(V.part_whole(spark, sf_dir)).groupBy("part").agg(F.count("whole").alias("level"))


@query(
    f"""WITH RECURSIVE {CLOSURE}, direct AS (SELECT part, whole, 'component-integral' AS meronymy FROM edges UNION SELECT 'part:' || p_partkey, 'brand:' || p_brand, 'stuff-object' FROM part)
SELECT part, whole, meronymy, 'direct' AS anchored FROM direct UNION ALL
SELECT part, whole, 'component-integral', 'rollup' FROM (SELECT part, whole, min(depth) AS d FROM paths GROUP BY ALL) WHERE d > 1"""
)
def pack_rollup(spark, sf_dir):
    return X.pack_closure(V.part_whole(spark, sf_dir))


@query(
    """WITH RECURSIVE k AS (SELECT o_orderkey AS node, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS up FROM orders),
r AS (SELECT node, up, 1 AS depth FROM k WHERE up IS NOT NULL UNION ALL SELECT r.node, k.up, depth + 1 FROM r JOIN k ON r.up = k.node WHERE k.up IS NOT NULL AND depth < 5)
SELECT node AS part, up AS whole, depth::INTEGER AS depth FROM r"""
)
def bounded_paths(spark, sf_dir):
    """Variable-length paths of one to five steps back through a customer's orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("part"), F.lag("o_orderkey").over(w).alias("whole"))
    return X.closure(o.where("whole is not null"), max_depth=5)


SCD = """e AS (SELECT *, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to FROM events)"""
AT = "2024-01-15 12:00:00"


@query(f"WITH {SCD} SELECT event_id, user_id, event_type FROM e WHERE ts <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}')")
def asof_snapshot(spark, sf_dir):
    return T.as_of(V.actions(spark, sf_dir), F.lit(AT).cast("timestamp")).select("event_id", "user_id", "event_type")


@query(f"WITH {SCD} SELECT event_id, user_id, event_type, value FROM e WHERE valid_to IS NULL")
def current_nodes(spark, sf_dir):
    return T.current(V.actions(spark, sf_dir)).select("event_id", "user_id", "event_type", "value")


@query(
    f"""WITH {SCD}, hit AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 90)
SELECT event_id, e.user_id, e.event_type, valid_to IS NOT NULL OR h.user_id IS NOT NULL AS closed FROM e LEFT JOIN hit h ON e.user_id = h.user_id AND e.event_type = h.event_type
UNION ALL SELECT NULL, user_id, event_type, false FROM hit"""
)
def supersession(spark, sf_dir):
    rows = V.actions(spark, sf_dir)
    changed = V.table(spark, sf_dir, "events").where("value > 90").select("user_id", "event_type").distinct()
    out = T.supersede(rows, changed, ["user_id", "event_type"], F.lit("2024-03-01 00:00:00").cast(rows.schema["valid_from"].dataType))
    return out.select("event_id", "user_id", "event_type", F.col("valid_to").isNotNull().alias("closed"))


@query("SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def latest_action_per_key(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return T.newest(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT c_custkey, event_type FROM customer, (SELECT DISTINCT event_type FROM events) t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c_custkey AND e.event_type = t.event_type)")
def pending_work_antijoin(spark, sf_dir):
    """Customer and event type that no logged event covers yet."""
    log = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), "event_type")
    kinds = log.agg(F.collect_set("event_type").alias("types")).scalar()  # event types are a vocabulary, not data
    work = V.table(spark, sf_dir, "customer").select("c_custkey", F.explode(kinds).alias("event_type"))
    return T.pending(work, log, ["c_custkey", "event_type"]).select("c_custkey", "event_type")


@query(
    "SELECT sha256(text) AS content_hash, max(doc_id) AS action, count(*) AS copies FROM documents GROUP BY sha256(text) HAVING count(*) > 1 AND max(doc_id) % 3 <> 0"
)
def replay_reuse(spark, sf_dir):
    """Extractions to replay: for content met before, the newest action, if both its outputs still exist; every third lost one."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    log = d.select(F.col("doc_id").alias("action"), "content_hash", F.col("doc_id").alias("ts"), F.lit(2).cast("long").alias("n_outputs"))
    outputs = log.select("action", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("output")).where("output = 'a' or action % 3 <> 0")
    counts = d.groupBy("content_hash").agg(F.count("*").alias("copies")).where("copies > 1")
    return T.replayable(counts, log, outputs).select("content_hash", "action").join(counts, "content_hash")


PROV = f"""WITH {EVIDENCE}, chain AS (SELECT fact, hypothesis, strength < 0.2 AS no_span, sign = 'refutes' AS no_text, a.action FROM ev
  LEFT JOIN (SELECT user_id, max_by(event_id, (ts, event_id)) AS action FROM events WHERE event_type = 'purchase' GROUP BY user_id) a ON part % 200 = a.user_id)"""


def _chain(spark, sf_dir):
    ev = V.evidence(spark, sf_dir)
    spans = ev.where("strength >= 0.2").select("fact", F.col("part").alias("span"), F.when(F.col("sign") != "refutes", "text").alias("text"))
    log = V.table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("action"), "ts")
    last = T.newest(log, ["user_id"], "ts", "action")
    actions = ev.select("fact", (F.col("part") % 200).alias("user_id")).join(last, "user_id").select("fact", "action", "ts")
    return O.provenance_chain(ev.select("fact", "box"), ev.select("fact", F.col("hypothesis").alias("proposition")), spans, actions)


@query(PROV + " SELECT fact, hypothesis::VARCHAR AS propositions, CASE WHEN no_span THEN 0 ELSE 1 END::BIGINT AS spans, CASE WHEN no_span OR no_text THEN 0 ELSE 1 END::BIGINT AS texts, action FROM chain")
def fact_provenance(spark, sf_dir):
    out = _chain(spark, sf_dir)
    return out.select("fact", F.array_join("propositions", ",").alias("propositions"), "spans", "texts", "action")


@query(
    PROV + ", g AS (SELECT fact, concat_ws(',', CASE WHEN no_span THEN 'no_evidence_span' END, CASE WHEN NOT no_span AND no_text THEN 'no_resolvable_source_text' END, "
    "CASE WHEN action IS NULL THEN 'no_producing_action' END) AS gaps FROM chain) SELECT fact, gaps FROM g WHERE gaps <> ''"
)
def audit_violations(spark, sf_dir):
    return O.violations(_chain(spark, sf_dir)).select("fact", F.array_join("gaps", ",").alias("gaps"))


@query(
    "SELECT event_type, count(*) AS actions, CAST(0 AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(CASE WHEN event_id % 2 = 0 THEN length(props) END), 0) AS BIGINT) AS completion_tokens, "
    "coalesce(sum(floor(value * 10)::BIGINT), 0)::BIGINT AS duration_ms FROM events GROUP BY event_type"
)
def action_metrics(spark, sf_dir):
    """Usage sums out of a JSON column; half the actions report no completion and none a prompt."""
    usage = F.struct(F.expr("cast(floor(value * 10) as bigint)").alias("duration_ms"), F.when(F.col("event_id") % 2 == 0, F.length("props")).alias("completion_tokens"))
    e = V.table(spark, sf_dir, "events").withColumn("metrics", F.to_json(usage))
    return O.action_metrics(e, by=("event_type",))


@query(
    f"""WITH {EVIDENCE} SELECT h.o_orderkey AS hypothesis, count(fact) AS degree, coalesce(max(strength), 0.0) AS strongest FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') h
LEFT JOIN ev ON h.o_orderkey = ev.hypothesis GROUP BY ALL"""
)
def optional_hops(spark, sf_dir):
    """Outer hops from hypotheses to their evidence."""
    from tracewright.sources.scans import hop

    ev = V.evidence(spark, sf_dir)
    nodes = V.hypotheses(spark, sf_dir).select(F.col("hypothesis").alias("id"))
    edges = ev.select(F.col("hypothesis").alias("src"), F.col("fact").alias("dst"), F.lit("EVIDENCED_BY").alias("etype"), "strength")
    reach = hop(nodes, edges, ev.select(F.col("fact").alias("id")), "EVIDENCED_BY", optional=True)
    return reach.groupBy(F.col("a_id").alias("hypothesis")).agg(F.count("b_id").alias("degree"), F.coalesce(F.max("strength"), F.lit(0.0)).alias("strongest"))


@query(f"WITH {EVIDENCE} SELECT hypothesis, count(*) AS degree FROM ev WHERE strength > 0.5 GROUP BY hypothesis HAVING count(*) > 2")
def degree_filter(spark, sf_dir):
    from tracewright.sources.scans import degrees_above

    return degrees_above(V.evidence(spark, sf_dir).where("strength > 0.5"), "hypothesis", 2)


@query(
    """WITH n AS (SELECT c_custkey AS id, c_acctbal AS confidence FROM customer), up AS (SELECT c_custkey AS id, -1.0::DOUBLE AS confidence FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT -c_custkey, 1.0 FROM customer WHERE c_acctbal < 0) SELECT * FROM up UNION ALL SELECT * FROM n ANTI JOIN up USING (id)"""
)
def vertex_upsert(spark, sf_dir):
    """Full replacement of vertices by id, with new ones added."""
    c = V.table(spark, sf_dir, "customer")
    rows = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.lit(-1.0).alias("confidence"))
    rows = rows.union(c.where("c_acctbal < 0").select((-F.col("c_custkey")).alias("id"), F.lit(1.0).alias("confidence")))
    return T.upsert(c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("confidence")), rows, ["id"])


@query(
    "SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) FILTER (WHERE k = 1) AS first_arrivals FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) GROUP BY user_id"
)
def stream_dedupe_ingest(spark, sf_dir):
    """Events as a stream, one row a key, landed once and summed up."""
    from tracewright.streaming import ingest as I

    stream = I.event_stream(spark, f"{sf_dir}/events.parquet")
    landed = I.run_once(stream.select("user_id", "event_type", "event_id").dropDuplicates(["user_id", "event_type"]), "dedupe")
    rows = spark.read.parquet(landed)
    return rows.groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), F.count("*").alias("first_arrivals"))


@query("SELECT user_id, sum(CASE WHEN event_type IN (SELECT min(event_type) FROM events) THEN -1 ELSE 1 END)::BIGINT AS support_count FROM events GROUP BY user_id")
def stream_delta_support(spark, sf_dir):
    """Support counts from a changelog of +1 and -1 per key."""
    from tracewright.streaming import ingest as I

    first = V.table(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]
    stream = I.event_stream(spark, f"{sf_dir}/events.parquet")
    signed = stream.select("user_id", F.when(F.col("event_type") == first, -1).otherwise(1).cast("long").alias("delta"))
    return I.deltas(signed, "support", ["user_id"])


NORM = "trim(regexp_replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), '^(the|a|an)( |$)', ''))"
PAIRS = f"""ent AS (SELECT p_partkey AS id, p_brand AS box, p_name AS label, p_type AS type, {NORM} AS norm, CASE WHEN p_size > 40 THEN 'actor' ELSE 'object' END AS kind FROM part),
tok AS (SELECT DISTINCT id, box, kind, unnest(string_split(norm, ' ')) AS token FROM ent), tok2 AS (SELECT * FROM tok WHERE token <> ''),
pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM tok2 x JOIN tok2 y ON x.box = y.box AND x.kind = y.kind AND x.token = y.token AND x.id < y.id),
played AS (SELECT DISTINCT l_partkey AS id, l_returnflag || l_linestatus AS role FROM lineitem), alike AS (SELECT DISTINCT a, b FROM pairs JOIN played x ON a = x.id JOIN played y ON b = y.id AND x.role = y.role),
ctx AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS c FROM lineitem), shared AS (SELECT a, b, count(*) AS n FROM pairs JOIN ctx x ON a = x.id JOIN ctx y ON b = y.id AND x.c = y.c GROUP BY ALL),
pscored AS (SELECT p.a, p.b, least(1.0, greatest(0.0, 0.5::DOUBLE * (x.norm = y.norm)::INT + 0.25::DOUBLE * CASE WHEN x.type = y.type THEN 1 ELSE -1 END
  + 0.35::DOUBLE * (1 - pow(0.5::DOUBLE, coalesce(n, 0) + CASE WHEN r.a IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END)))) AS score
  FROM pairs p JOIN ent x ON p.a = x.id JOIN ent y ON p.b = y.id LEFT JOIN shared s ON p.a = s.a AND p.b = s.b LEFT JOIN alike r ON p.a = r.a AND p.b = r.b),
resolved AS (SELECT *, CASE WHEN score >= 0.85 THEN 'confirmed' WHEN score >= 0.5 THEN 'candidate' END AS state FROM pscored WHERE score >= 0.5)"""
COMPONENTS = f"""{PAIRS}, sym AS (SELECT a, b FROM resolved WHERE state = 'confirmed' UNION SELECT b, a FROM resolved WHERE state = 'confirmed'),
reach AS (SELECT a AS id, a AS other FROM sym UNION SELECT r.id, s.b FROM reach r JOIN sym s ON r.other = s.a), comp AS (SELECT id, min(other) AS canonical FROM reach GROUP BY id)"""


@query(f"WITH {PAIRS} SELECT a, count(*) AS partners, min(b) AS first FROM pairs GROUP BY a")
def entity_blocking(spark, sf_dir):
    return R.block_pairs(V.entities(spark, sf_dir)).groupBy("a").agg(F.count("*").alias("partners"), F.min("b").alias("first"))


def resolved(spark, sf_dir):
    return R.resolve(V.entities(spark, sf_dir), V.contexts(spark, sf_dir), V.roles(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT a, b, round(score, 6) AS score, state FROM resolved")
def entity_resolution(spark, sf_dir):
    return resolved(spark, sf_dir).select("a", "b", F.round("score", 6).alias("score"), "state")


def linked(spark, sf_dir):
    return R.confirmed_links(V.entities(spark, sf_dir), V.contexts(spark, sf_dir), V.roles(spark, sf_dir))


@query(f"WITH RECURSIVE {COMPONENTS} SELECT id, canonical FROM comp")
def entity_components(spark, sf_dir):
    return R.canonical_components(linked(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {COMPONENTS}, {EVIDENCE} SELECT canonical, sum(support_count)::BIGINT AS support_count, round(max(base), 6) AS confidence, count(*) AS nodes
FROM (SELECT DISTINCT canonical, fact, support_count, base FROM comp JOIN ev ON id = part) GROUP BY canonical"""
)
def component_evidence(spark, sf_dir):
    ev = V.evidence(spark, sf_dir).select(F.col("part").alias("id"), F.col("fact").alias("node"), "support_count", F.col("base").alias("confidence"))
    return R.component_evidence(R.canonical_components(linked(spark, sf_dir)), ev).withColumn("confidence", F.round("confidence", 6))


@query(
    f"""WITH RECURSIVE {PAIRS}, edges AS (SELECT 'e:' || a AS a, 'e:' || b AS b FROM resolved WHERE state = 'confirmed' UNION ALL SELECT 'e:' || p_partkey, 't:' || (p_partkey % 7) FROM part WHERE p_size = 1),
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT a AS id, a AS other FROM sym UNION SELECT r.id, s.b FROM reach r JOIN sym s ON r.other = s.a),
comp AS (SELECT id, min(other) AS root FROM reach GROUP BY id),
agg AS (SELECT root, count(*) FILTER (WHERE id LIKE 'e:%') AS members, count(*) FILTER (WHERE id LIKE 't:%') AS targets, min(substr(id, 3)) FILTER (WHERE id LIKE 'e:%') AS e, min(substr(id, 3)) FILTER (WHERE id LIKE 't:%') AS t FROM comp GROUP BY root)
SELECT CASE WHEN targets = 1 THEN t ELSE e END AS canonical, members, targets, targets > 1 AS conflict FROM agg"""
)
def anchored_components(spark, sf_dir):
    anchors = V.table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 7).alias("target"))
    out = R.anchored_components(linked(spark, sf_dir), anchors)
    return out.select("canonical", F.size("members").cast("long").alias("members"), F.size("targets").cast("long").alias("targets"), "conflict")


TAXONOMY = f"""mention AS (SELECT p_partkey AS mention, {NORM} AS norm, p_type AS type, list_distinct(list_filter(string_split({NORM}, ' '), lambda x: x <> '')) AS toks FROM part),
tax AS (SELECT 'tax:' || word AS target, word AS norm, string_split(word, ' ') AS words FROM (SELECT unnest(toks) AS word FROM mention UNION SELECT norm FROM mention WHERE norm < 'm' AND norm <> '')),
near AS (SELECT mention, target, bool_or(exact) AS exact, count(*) / any_value(len(toks)) AS inner_share, count(*) / any_value(len(words)) AS outer_share FROM (
  SELECT m.mention, m.toks, t.target, t.words, m.norm = t.norm AS exact FROM (SELECT *, unnest(toks) AS word FROM mention) m JOIN (SELECT *, unnest(words) AS word FROM tax) t ON m.word = t.word) GROUP BY ALL)"""
DECIDE = """viable AS (SELECT *, max(score) OVER (PARTITION BY mention) AS best FROM scored WHERE score >= 0.5),
band AS (SELECT *, count(*) OVER (PARTITION BY mention) AS ties, row_number() OVER (PARTITION BY mention ORDER BY score DESC, target) AS r FROM viable WHERE round(best - score, 12) <= 0.05)
SELECT mention, target, round(score, 6) AS score, CASE WHEN ties = 1 AND best >= 0.85 THEN 'confirmed' ELSE 'candidate' END AS state, ties FROM band WHERE r = 1"""


def _mentions(spark, sf_dir):
    return V.entities(spark, sf_dir).withColumnRenamed("id", "mention")


def _taxonomy(spark, sf_dir):
    ents = V.entities(spark, sf_dir)
    names = ents.select(F.explode("tokens").alias("norm")).union(ents.where("norm < 'm' and norm <> ''").select("norm")).distinct()
    return names.select(F.concat(F.lit("tax:"), "norm").alias("target"), "norm", S.tokens(F.col("norm")).alias("tokens"), F.lit(None).cast("string").alias("type"))


@query(f"WITH {TAXONOMY}, scored AS (SELECT mention, target, 0.7::DOUBLE * inner_share + 0.3::DOUBLE * exact::INT AS score FROM near), {DECIDE}")
def taxonomy_binding(spark, sf_dir):
    return R.bind_taxonomy(_mentions(spark, sf_dir), _taxonomy(spark, sf_dir)).withColumn("score", F.round("score", 6))


ANCHOR = f"WITH {TAXONOMY}, scored AS (SELECT mention, target, 0.55::DOUBLE * greatest(inner_share, outer_share) + 0.4::DOUBLE * exact::INT AS score FROM near), {DECIDE}"


@query(ANCHOR)
def taxonomy_anchoring(spark, sf_dir):
    return R.anchor(_mentions(spark, sf_dir), _taxonomy(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"SELECT (SELECT count(*) FROM part) AS entities, count(*) FILTER (WHERE state = 'confirmed') AS anchored, count(*) FILTER (WHERE state = 'confirmed') / (SELECT count(*) FROM part) AS coverage FROM ({ANCHOR})")
def anchor_coverage(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    return R.anchor_coverage(m, R.anchor(m, _taxonomy(spark, sf_dir)))


REFERENTS = "ref AS (SELECT box, kind, norm, min(id::VARCHAR) AS canonical, count(*) AS members, min_by(type, id::VARCHAR) AS type FROM ent WHERE norm <> '' GROUP BY ALL)"


@query(f"WITH {PAIRS}, {REFERENTS} SELECT box, kind, norm, canonical, members, type FROM ref")
def referent_groups(spark, sf_dir):
    out = R.group_referents(V.entities(spark, sf_dir))
    return out.select("box", "kind", "norm", "canonical", F.size("ids").cast("long").alias("members"), "type")


@query(
    f"""WITH {PAIRS}, {REFERENTS}, rtok AS (SELECT DISTINCT box, norm, canonical, type, unnest(string_split(norm, ' ')) AS token FROM ref),
near AS (SELECT t.id AS mention, r.canonical AS target, count(*) AS hit FROM tok2 t JOIN rtok r ON t.box = r.box AND t.token = r.token GROUP BY ALL),
size AS (SELECT id, count(*) AS n FROM tok2 GROUP BY id),
scored AS (SELECT mention, target, least(1.0, 0.6::DOUBLE * (hit / n) + 0.25::DOUBLE * (e.norm = r.norm)::INT + 0.15::DOUBLE * 1) AS score
  FROM near JOIN size ON mention = size.id JOIN ent e ON mention = e.id JOIN ref r ON target = r.canonical WHERE e.type = r.type), {DECIDE}"""
)
def reference_binding(spark, sf_dir):
    ents = V.entities(spark, sf_dir)
    refs = R.group_referents(ents).withColumnRenamed("canonical", "target")
    return R.bind_references(ents.withColumnRenamed("id", "mention"), refs, ("box",)).withColumn("score", F.round("score", 6))
