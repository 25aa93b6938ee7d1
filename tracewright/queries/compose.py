"""Compositions: extraction, facts, candidates of the active graph, judged edges, contradictions, intake and conclusions."""

from pyspark.sql import functions as F

from tracewright import views as V
from tracewright.catalogue import query
from tracewright.functions import scalars as S
from tracewright.operators import extraction as E
from tracewright.operators import intake as I
from tracewright.operators import metrics as M
from tracewright.operators import reasoning as N
from tracewright.operators import resolve as R
from tracewright.operators import text as X
from tracewright.plans.storage import materialize
from tracewright.sources import documents as D
from tracewright.sources import models as L
from tracewright.streaming import ingest as G

NEGATED = "regexp_matches(lower({0}), '(^|[^a-z])(un|in)')"


def turns(spark, sf_dir):
    """Conversation turns as spans of their conversation."""
    c = V.table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("span_id"), F.col("conv_id").alias("document_id"), F.col("turn").alias("position"), "text")


def empty_store(spark):
    kinds = "proposition string, action string, span_id long, document_id long, ordinal int, text string, polarity string, modality string, attribution string, scope string, epistemic_class string"
    return spark.createDataFrame([], kinds + ", agreement double, faithfulness double, reasons array<string>, vector array<double>, model string, content_hash string")


@query(
    f"""WITH s AS (SELECT conv_id, turn, text, unnest(string_split_regex(text, '[.!?][ \\n]+')) AS raw, unnest(range(len(string_split_regex(text, '[.!?][ \\n]+')))) AS i FROM conversations WHERE conv_id % 2 = 0),
p AS (SELECT *, trim(raw, ' ' || chr(10)) AS claim, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1)::INTEGER AS ordinal FROM s WHERE trim(raw, ' ' || chr(10)) <> ''),
f AS (SELECT *, CASE WHEN length(claim) <= 100 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END * CASE WHEN contains(claim, 'ly') THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS score FROM p)
SELECT conv_id * 1000 + turn AS span_id, ordinal, sha256(claim) AS claim, CASE WHEN {NEGATED.format('claim')} THEN 'negated' ELSE 'asserted' END AS polarity,
  CASE WHEN contains(claim, ',') THEN 'judgement' ELSE 'observation' END AS epistemic_class, CASE WHEN contains(claim, ',') THEN 'judgement' ELSE 'fact' END AS routing,
  round(score, 6) AS faithfulness, CASE WHEN score < 0.5 THEN 'low_faithfulness' ELSE '' END AS reasons FROM f"""
)
def propositions(spark, sf_dir):
    """Propositions of the turns that no earlier run covers: odd conversations were extracted under the same identity before."""
    spans = turns(spark, sf_dir)
    done = E.keyed_spans(spans).where("document_id % 2 = 1")
    log = done.select("span_id", "content_hash", F.lit(1).alias("ts"), F.concat(F.lit("a"), "span_id").alias("action"), F.lit(1).cast("long").alias("n_outputs"), F.lit(L.VERIFY.signature).alias("verify_signature"))
    out = E.propositionize(spans, materialize(log, "log"), empty_store(spark), spark.createDataFrame([], "proposition string"))
    return out.propositions.select("span_id", "ordinal", F.sha2("text", 256).alias("claim"), "polarity", "epistemic_class", "routing", F.round("faithfulness", 6).alias("faithfulness"), F.array_join("reasons", ",").alias("reasons"))


def _claims(spark, sf_dir):
    """Turns as propositions of boxes, with the sensitivity of their spans."""
    c = turns(spark, sf_dir).select(F.col("span_id").alias("proposition"), (F.col("document_id") % 7).alias("box"), F.lit("case").alias("tier"), "text", F.when(F.col("position") % 2 == 0, 0.5).alias("faithfulness"), "position")
    spans = c.select("proposition", F.explode(F.array((F.col("position") % 3).cast("int"), F.lit(1))).alias("level")).withColumn("compartments", F.array(F.concat(F.lit("c"), F.col("level").cast("string"))))
    return c, spans.withColumn("span_id", F.col("proposition"))


WORDY = """w AS (SELECT conv_id * 1000 + turn AS proposition, turn, unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS label, unnest(range(len(regexp_extract_all(lower(text), '[a-z]{8,}')))) AS i FROM conversations),
d AS (SELECT proposition, turn, label, row_number() OVER (PARTITION BY proposition ORDER BY min(i)) AS r FROM w GROUP BY proposition, turn, label)"""


@query(
    f"WITH {WORDY} SELECT proposition, label, CASE WHEN label[1] <= 'm' THEN 'actor' ELSE 'object' END AS kind, CASE WHEN r = 1 THEN 'subject' ELSE 'object' END AS role, "
    "CASE WHEN turn % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence, greatest(turn % 3, 1)::INTEGER AS level FROM d WHERE turn % 3 <> 0"
)
def facts(spark, sf_dir):
    """Facts, their entities and roles of the propositions that the log doesn't have, every third."""
    claims, spans = _claims(spark, sf_dir)
    out = E.extract_facts(claims.drop("position"), spans, claims.where("position % 3 = 0").select("proposition"))
    role = out.edges.where("etype = 'INVOLVES'").select(F.col("src").alias("fact"), F.col("dst").alias("id"), "role")
    return out.facts.select("fact", "proposition", "confidence", "level").join(role, "fact").join(out.entities, "id").select("proposition", "label", "kind", "role", "confidence", "level")


@query(
    f"WITH {WORDY}, two AS (SELECT a.label AS c, b.label AS p FROM d a JOIN d b ON a.proposition = b.proposition AND a.r = 1 AND b.r = 2), known AS (SELECT DISTINCT label FROM d WHERE label[2] <= 'n') "
    "SELECT DISTINCT 'r:' || c AS part, 'r:' || p AS whole, 'component-integral' AS meronymy FROM two WHERE c IN (FROM known) AND p IN (FROM known) AND c <> p"
)
def induced_parts(spark, sf_dir):
    """Part-of relations that propositions name, between referents that are known."""
    claims, _ = _claims(spark, sf_dir)
    words = claims.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).alias("norm")).where("substr(norm, 2, 1) <= 'n'").distinct()
    return E.detect_parts(claims, words.select("norm", F.concat(F.lit("r:"), "norm").alias("canonical")))


ACTIVE = """WITH vec AS (SELECT vec_id, embedding::DOUBLE[] AS v, vec_id % 10 AS box FROM embeddings WHERE vec_id % 10 <> 3), hyp AS (SELECT * FROM vec WHERE vec_id % 100 = 0), ev AS (SELECT * FROM vec WHERE vec_id % 100 <> 0),
sims AS (SELECT h.vec_id AS hypothesis, e.vec_id AS evidence, round(list_cosine_similarity(h.v, e.v), 12) AS s FROM hyp h, ev e),
knn AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY hypothesis ORDER BY s DESC, evidence) <= 10),
st AS (SELECT h.vec_id AS hypothesis, e.vec_id AS evidence FROM hyp h JOIN ev e ON h.vec_id // 50 = e.vec_id // 50)"""


def embedding_graph(spark, sf_dir):
    """Vectors as nodes of ten boxes, of which one is deprecated; every proposition has a vector of a second, later model too."""
    e = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    nodes = e.select("id", F.when(F.col("id") % 100 == 0, "hypothesis").otherwise("fact").alias("label"), (F.col("id") % 10).alias("box"), F.lit("").alias("statement"), F.lit(1.0).alias("confidence"), F.lit(None).cast("timestamp").alias("valid_to"))
    boxes = spark.range(10).select(F.col("id").alias("box"), F.lit("case").alias("tier"), F.when(F.col("id") == 3, "deprecated").otherwise("active").alias("status"))
    involves = e.select(F.col("id").alias("node"), F.floor(F.col("id") / 50).cast("string").alias("entity"), F.lit("subject").alias("role"))
    evidenced = e.select(F.col("id").alias("node"), F.col("id").alias("proposition"))
    vectors = e.select(F.col("id").alias("proposition"), F.lit("a").alias("model"), "vector").unionByName(e.select(F.col("id").alias("proposition"), F.lit("b").alias("model"), F.reverse("vector").alias("vector")))
    return N.Graph(nodes, boxes, involves, evidenced, vectors)


@query(ACTIVE + " SELECT evidence, hypothesis, concat_ws(',', CASE WHEN k.s IS NOT NULL THEN 'embedding' END, CASE WHEN t.hit THEN 'structural' END) AS sources FROM knn k FULL JOIN (SELECT *, true AS hit FROM st) t USING (evidence, hypothesis)")
def active_candidates(spark, sf_dir):
    """Candidates over active boxes only: evidence for hypotheses by shared entities and nearest vectors of one model."""
    return N.generate_candidates(embedding_graph(spark, sf_dir)).select("evidence", "hypothesis", F.array_join("sources", ",").alias("sources"))


@query(ACTIVE + ", pool AS (SELECT evidence, hypothesis FROM knn UNION SELECT evidence, hypothesis FROM st) SELECT evidence, hypothesis, (row_number() OVER (PARTITION BY hypothesis ORDER BY evidence))::INTEGER AS rank FROM pool")
def ordered_pool(spark, sf_dir):
    """The pool in its total order, as pairs that a ranking can be held against."""
    return M.node_pairs(N.generate_candidates(embedding_graph(spark, sf_dir))).select("evidence", "hypothesis", "rank")


def turn_graph(spark, sf_dir):
    """Conversations as graphs: the first turn a hypothesis, the others evidence that shares the conversation as an entity."""
    c = turns(spark, sf_dir)
    nodes = c.select(
        F.col("span_id").alias("id"), F.when(F.col("position") == 0, "hypothesis").otherwise("fact").alias("label"), (F.col("document_id") % 5).alias("box"), F.col("text").alias("statement"),
        F.lit(0.5).alias("confidence"), F.lit(None).cast("timestamp").alias("valid_to"),
    )
    boxes = spark.range(5).select(F.col("id").alias("box"), F.lit("case").alias("tier"), F.when(F.col("id") == 4, "deprecated").otherwise("active").alias("status"))
    involves = c.select(F.col("span_id").alias("node"), F.col("document_id").cast("string").alias("entity"), F.lit("subject").alias("role"))
    evidenced = c.select(F.col("span_id").alias("node"), F.col("span_id").alias("proposition"))
    embed = D.hash_embedder(16)
    vectors = E.embedded(c.select(F.col("span_id").alias("proposition"), "text"), "hash", embed).select("proposition", "model", "vector")
    return N.Graph(nodes, boxes, involves, evidenced, vectors), c


def turn_marks(c):
    reliability = c.select(F.col("span_id").alias("evidence"), (1.0 - F.col("position") % 3 * 0.2).alias("reliability"))
    reasons = c.where("position % 4 = 0").select(F.col("span_id").alias("evidence"), F.array(F.lit("low_faithfulness")).alias("reasons"))
    return reliability, reasons


@query(
    f"""WITH t AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, text, regexp_extract_all(lower(text), '[a-z]{{8,}}') AS ws, {NEGATED.format("regexp_replace(text, '\\s+', ' ', 'g')")} AS neg, {NEGATED.format('text')} AS hneg FROM conversations WHERE conv_id % 5 <> 4),
j AS (SELECT e.id AS evidence, h.id AS hypothesis, e.turn, e.neg <> h.hneg AS apart, 1.0::DOUBLE - e.turn % 3 * 0.2::DOUBLE AS r FROM t h JOIN t e ON h.conv_id = e.conv_id AND h.turn = 0 AND e.turn <> 0 WHERE list_has_any(h.ws, e.ws)),
k AS (SELECT *, CASE WHEN apart THEN 'refutes' ELSE 'supports' END AS sign, r * 5 / 7.0 + 0.5 * (1 - r * 5 / 7.0) AS strength, count(*) FILTER (WHERE NOT apart) OVER (PARTITION BY hypothesis) AS n FROM j)
SELECT evidence, hypothesis, sign, round(strength, 6) AS strength, round(r, 6) AS significance, CASE WHEN apart OR n <= 1 THEN 'high' ELSE 'low' END AS stakes, (apart OR n <= 1) AND turn % 4 = 0 AS quarantined FROM k"""
)
def produced_edges(spark, sf_dir):
    """Edges between conversations' turns: candidates, five blind votes each, discounted, planned and held back where doubtful and of high stakes."""
    graph, c = turn_graph(spark, sf_dir)
    nothing = N.Graph(graph.nodes, graph.boxes, graph.involves, graph.evidenced, graph.vectors.where("false"))
    out = N.produce_edges(nothing, *turn_marks(c))
    rows = out.edges.withColumn("quarantined", F.lit(False)).unionByName(out.quarantined.withColumn("quarantined", F.lit(True)))
    return rows.select("evidence", "hypothesis", "sign", F.round("strength", 6).alias("strength"), F.round("significance", 6).alias("significance"), "stakes", "quarantined")


@query()
def contradiction_search(spark, sf_dir):
    """Every third active conversation's hypothesis: corroborated, gated and revised; its state and what the gate said."""
    graph, c = turn_graph(spark, sf_dir)
    targets = c.where("position = 0 and document_id % 3 = 0").select(F.col("span_id").alias("hypothesis"))
    claims = c.select(F.col("span_id").alias("proposition"), F.when(F.lower("text").rlike("(^|[^a-z])(un|in)"), "negated").otherwise("asserted").alias("polarity"))
    base = c.where("position > 0").select(F.col("span_id").cast("string").alias("node"), F.lit(0.9).alias("confidence"))
    body = spark.createDataFrame([], "rule string, head string, atom string, strength double")
    hypotheses = c.where("position = 0").select(F.col("span_id").cast("string").alias("hypothesis"), F.lit(0.3).alias("base"))
    edges = spark.createDataFrame([], "src string, dst string, sign string, strength double")
    out = N.find_contradictions(graph, targets, claims, *turn_marks(c), base, body, hypotheses, edges)
    found = out.actions.select(F.col("hypothesis").cast("string").alias("hypothesis"), "supporters", "refuters", "authorised", F.array_join("reasons", ",").alias("reasons"))
    return found.join(out.revision.verdicts.select("hypothesis", "state", F.round("acceptability", 6).alias("acceptability")), "hypothesis", "left")


@query()
def ingested_spans(spark, sf_dir):
    """All documents taken in: spans of two levels with ids, ranges and pooled vectors."""
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.encode("text", "UTF-8").alias("content"))
    stored = spark.createDataFrame([], "document_id string, level int, start int, end int, vector array<double>, text string, span_id string, model string, content_hash string")
    out = I.ingest(d, stored, stored, spark.createDataFrame([], "document_id string, action_type string, content_hash string"))
    return out.spans.select("document_id", "level", "start", "end", "span_id", F.length("text").alias("n_chars"))


@query(
    "WITH ent AS (SELECT p_partkey AS id, p_brand AS box, trim(regexp_replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), '^(the|a|an)( |$)', '')) AS norm FROM part), "
    "x AS (SELECT DISTINCT l_orderkey, id, box, norm FROM lineitem JOIN ent ON l_partkey = id) SELECT a.id, count(DISTINCT b.norm) AS contexts, min(b.norm) AS first FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.box = b.box AND a.id <> b.id GROUP BY a.id"
)
def co_occurrence(spark, sf_dir):
    """Labels of other entities of the same box in the same order."""
    lines = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("role"))
    contexts, _ = N.co_occurrence(lines, V.entities(spark, sf_dir))
    return contexts.groupBy("id").agg(F.count("*").alias("contexts"), F.min("context").alias("first"))


@query(
    """WITH k AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders), pr AS (SELECT o_custkey, o_orderkey FROM k WHERE r <= 2),
c AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 5 <> 0) AS held, min(0.5::DOUBLE + (o_orderkey % 50) / 100.0::DOUBLE) AS v FROM pr GROUP BY o_custkey)
SELECT o_custkey::VARCHAR AS statement, CASE WHEN o_custkey % 2 = 0 THEN 'deduced' ELSE 'induced' END AS label, o_custkey % 2 = 1 AS provisional, (n = held)::BIGINT AS support_count,
  round(CASE WHEN n = held THEN least(v, CASE WHEN o_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END) ELSE 0.0::DOUBLE END, 6) AS confidence FROM c"""
)
def conclusions(spark, sf_dir):
    """Conclusions from two orders each, valued in the snapshot; one whose premise is not held has no support."""
    from pyspark.sql import Window

    first = V.table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("r <= 2")
    base = V.table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("node"), (0.5 + F.col("o_orderkey") % 50 / 100).alias("confidence"))
    even = F.col("o_custkey") % 2 == 0
    proposals = first.select(F.col("o_custkey").cast("string").alias("statement"), F.when(even, "deduced").otherwise("induced").alias("kind"), F.col("o_orderkey").alias("premise"), F.when(~even, 0.6).alias("strength"), F.lit("b").alias("box"))
    body = spark.createDataFrame([], "rule string, head string, atom string, strength double")
    nodes, _, _ = N.append_conclusions(base, body, proposals)
    return nodes.select("statement", "label", "provisional", "support_count", F.round("confidence", 6).alias("confidence"))


@query(
    "WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY event_id) AS k FROM events) SELECT event_id, user_id, event_type, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS next_event FROM e"
)
def stream_supersession(spark, sf_dir):
    """Bitemporal versions of a stream of events: each names the one that closed it."""
    stream = G.event_stream(spark, f"{sf_dir}/events.parquet").select("user_id", "event_type", "event_id", "ts")
    out = G.supersede_stream(stream, "events", ["user_id", "event_type"])
    later = out.select("user_id", "event_type", F.col("event_id").alias("next_event"), F.col("valid_from").alias("valid_to"))
    joined = out.join(later, ["user_id", "event_type", "valid_to"], "left").groupBy("event_id", "user_id", "event_type").agg(F.min("next_event").alias("next_event"))
    return joined


@query("SELECT event_type, epoch(time_bucket(INTERVAL 6 HOUR, ts))::BIGINT AS opened, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    """Events in tumbling windows of event time, from a stream with a watermark that all rows keep within."""
    stream = G.event_stream(spark, f"{sf_dir}/events.parquet")
    rows = G.latest_totals(G.windowed_counts(stream, "ts", ["event_type"], "6 hours"), "windows")
    return rows.select("event_type", F.col("window.start").cast("timestamp").cast("long").alias("opened"), "n")


@query(
    "WITH e AS (SELECT conv_id, turn, (sum(length(text) + 2) OVER w - 2 - length(text)) AS s, (sum(length(text) + 2) OVER w - 2) AS e FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), "
    "win AS (SELECT conv_id, unnest(range((max(e) // 256)::BIGINT + 1)) AS k FROM e GROUP BY conv_id) "
    'SELECT e.conv_id, turn, max_by(k, (least(s - k * 256, k * 256 + 512 - e), -k)) AS "window" FROM e JOIN win ON e.conv_id = win.conv_id AND k * 256 < e AND k * 256 + 512 > s GROUP BY ALL'
)
def best_windows(spark, sf_dir):
    """For each turn the overlapping window with the widest margin around it."""
    e = X.char_ranges(V.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select(F.col("conv_id").alias("doc"), F.col("turn").alias("span"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    total = e.groupBy("doc").agg(F.max("s_end").alias("n"))
    windows = total.select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 256))).alias("window")).withColumns({"w_start": F.col("window") * 256, "w_end": F.col("window") * 256 + 512})
    return X.best_window(e, windows).select(F.col("doc").alias("conv_id"), F.col("span").alias("turn"), "window")


@query("SELECT stage, count(*) AS mentions FROM (SELECT CASE WHEN p_size > 40 THEN 'graph' WHEN p_size > 20 THEN 'taxonomy' ELSE 'unresolved' END AS stage FROM part) GROUP BY stage")
def binding_cascade(spark, sf_dir):
    """Labels made to be known to the graph, to the taxonomy only, or to neither, and the stage that resolves each."""
    p = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mention"), "p_size", F.concat(F.lit("word"), F.col("p_partkey").cast("string")).alias("norm"))
    side = lambda df, name: df.select(F.col("mention").cast("string").alias(name), "norm", S.tokens(F.col("norm")).alias("tokens"), F.lit("x").alias("type"))
    out = R.resolve_bindings(side(p, "mention"), side(p.where("p_size > 40"), "target"), side(p.where("p_size > 20"), "target"))
    return out.groupBy("stage").agg(F.count("*").alias("mentions"))


@query(
    "WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS rank FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) "
    "SELECT 'e' || l_partkey % 50 AS evidence, 'h' || l_orderkey % 20 AS hypothesis, min(rank)::INTEGER AS rank FROM r WHERE l_partkey % 3 = 0 AND l_orderkey % 2 = 0 GROUP BY ALL"
)
def projected_pool(spark, sf_dir):
    """Node pairs in gold ids through two maps, with the best rank of each; pairs that a map lacks go."""
    pool = V.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("evidence"), F.col("l_orderkey").alias("hypothesis"))
    evidence = V.table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node"), F.concat(F.lit("e"), (F.col("p_partkey") % 50).cast("string")).alias("gold"))
    hypotheses = V.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("node"), F.concat(F.lit("h"), (F.col("o_orderkey") % 20).cast("string")).alias("gold"))
    out = M.project_ids(M.node_pairs(pool), evidence, hypotheses)
    return out.groupBy("evidence", "hypothesis").agg(F.min("rank").alias("rank"))
