"""Candidates, nearest vectors, funnels, recall, samples and clusters over embeddings and orders."""

from pyspark.sql import functions as F

from tracewright import views as V
from tracewright.catalogue import query
from tracewright.operators import candidates as C
from tracewright.operators import clusters as K
from tracewright.operators import metrics as M
from tracewright.operators import text as X

COS = "list_cosine_similarity(h.v, e.v)"
SIDES = "vec AS (SELECT vec_id, label, 'm' || (label % 2) AS model, embedding::DOUBLE[] AS v FROM embeddings)"
KNN = f"""{SIDES}, sims AS (SELECT e.vec_id AS evidence, h.vec_id AS hypothesis, {COS} AS similarity FROM vec h JOIN vec e ON h.model = e.model WHERE h.vec_id % 100 = 0 AND e.vec_id <> h.vec_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY hypothesis ORDER BY similarity DESC, evidence) AS rank FROM sims QUALIFY rank <= 10)"""


def _sides(spark, sf_dir):
    """The stated query set (ids divisible by 100) as hypotheses, and all rows as evidence."""
    e = V.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("node"), "label", F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return e.where("node % 100 = 0"), e


@query(f"WITH {KNN} SELECT evidence, hypothesis, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM knn")
def knn_candidates(spark, sf_dir):
    return C.knn_candidates(*_sides(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


PUSHED = f"""{SIDES}, two AS (SELECT vec_id // 2 AS node, vec_id, model, v FROM vec),
sims AS (SELECT h.vec_id AS q, h.node AS hypothesis, e.node AS evidence, round(list_cosine_similarity(h.v, e.v), 12) AS similarity FROM two h JOIN two e ON h.model = e.model WHERE h.node % 100 = 0 AND e.node <> h.node),
cut AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY q ORDER BY similarity DESC, evidence) <= 10),
best AS (SELECT evidence, hypothesis, max(similarity) AS similarity FROM cut GROUP BY ALL)"""


@query(f"WITH {PUSHED} SELECT evidence, hypothesis, round(similarity, 6) AS similarity, (row_number() OVER (PARTITION BY hypothesis ORDER BY similarity DESC, evidence))::INTEGER AS rank FROM best")
def knn_pushdown(spark, sf_dir):
    """Two vectors a node: each query vector cuts to ten single vectors before nodes are merged, so ranks are not those of the exact search."""
    _, rows = _sides(spark, sf_dir)
    two = rows.select(F.floor(F.col("node") / 2).alias("node"), "model", "vector")
    return C.knn_pushdown(two.where("node % 100 = 0"), two).withColumn("similarity", F.round("similarity", 6))


POOL = f"{KNN}, st AS (SELECT e.vec_id AS evidence, h.vec_id AS hypothesis FROM vec h JOIN vec e ON h.vec_id // 50 = e.vec_id // 50 WHERE h.vec_id % 100 = 0 AND e.vec_id <> h.vec_id)"


def _pool(spark, sf_dir, strategy):
    hyp, ev = _sides(spark, sf_dir)
    nodes = hyp.select("node").union(ev.select("node"))
    involves = nodes.select("node", F.floor(F.col("node") / 50).cast("string").alias("entity"))
    return C.funnel({"knn": C.knn_candidates(hyp, ev), "structural": C.structural_candidates(hyp, ev, involves)}, strategy)


@query(
    f"WITH {POOL} SELECT evidence, hypothesis, concat_ws(',', CASE WHEN k.rank IS NOT NULL THEN 'knn' END, CASE WHEN s.hit THEN 'structural' END) AS sources "
    "FROM knn k FULL JOIN (SELECT *, true AS hit FROM st) s USING (evidence, hypothesis)"
)
def candidate_funnel_union(spark, sf_dir):
    return _pool(spark, sf_dir, "union").select("evidence", "hypothesis", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {POOL} SELECT evidence, hypothesis, 'knn,structural' AS sources FROM knn JOIN st USING (evidence, hypothesis)")
def candidate_funnel_intersect(spark, sf_dir):
    return _pool(spark, sf_dir, "intersect").select("evidence", "hypothesis", F.array_join("sources", ",").alias("sources"))


@query(
    """WITH inv AS (SELECT DISTINCT l_orderkey AS node, l_partkey AS entity FROM lineitem), hyp AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 = 0),
pairs AS (SELECT DISTINCT h.node AS hypothesis, e.node AS evidence FROM inv h JOIN hyp ON h.node = o_orderkey JOIN inv e USING (entity) WHERE e.node <> h.node)
SELECT hypothesis, count(*) AS candidates, min(evidence) AS first FROM pairs GROUP BY hypothesis"""
)
def structural_candidates(spark, sf_dir):
    involves = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("entity"))
    hyp = V.table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("node"))
    pairs = C.structural_candidates(hyp, V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node")), involves)
    return pairs.groupBy("hypothesis").agg(F.count("*").alias("candidates"), F.min("evidence").alias("first"))


@query(
    "WITH d AS (SELECT q.vec_id AS query, e.vec_id AS chunk, 1 - round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) "
    "SELECT query, chunk, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, chunk) <= 8"
)
def chunk_retrieval_topk(spark, sf_dir):
    """The eight chunks nearest to each stated query."""
    e = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk"), F.col("embedding").cast("array<double>").alias("vector"))
    queries = e.where("chunk % 100 = 0").withColumnRenamed("chunk", "query")
    return C.retrieve_topk(e, queries, 8).withColumn("distance", F.round("distance", 6))


GOLD = "gold AS (SELECT e.vec_id AS evidence, h.vec_id AS hypothesis, CASE WHEN e.vec_id % 2 = 0 THEN 'supports' ELSE 'refutes' END AS sign, e.vec_id % 3 = 0 AS dissimilar FROM vec h JOIN vec e ON h.model = e.model AND h.vec_id % 25 = e.vec_id % 25 WHERE h.vec_id % 100 = 0 AND e.vec_id <> h.vec_id)"


def _gold(spark, sf_dir):
    hyp, ev = _sides(spark, sf_dir)
    h = hyp.select(F.col("node").alias("hypothesis"), "model", (F.col("node") % 25).alias("k"))
    e = ev.select(F.col("node").alias("evidence"), "model", (F.col("node") % 25).alias("k"))
    pairs = h.join(e, ["model", "k"]).where("evidence <> hypothesis")
    return pairs.select("evidence", "hypothesis", F.when(F.col("evidence") % 2 == 0, "supports").otherwise("refutes").alias("sign"), (F.col("evidence") % 3 == 0).alias("dissimilar"))


@query(f"WITH {KNN}, {GOLD} SELECT 5::INTEGER AS budget, (count(*) FILTER (WHERE rank <= 5)) / count(*) AS recall FROM gold LEFT JOIN knn USING (evidence, hypothesis)")
def recall_at_budget(spark, sf_dir):
    return M.recall_at_budget(C.knn_candidates(*_sides(spark, sf_dir)), _gold(spark, sf_dir).select("evidence", "hypothesis"), 5)


@query(
    f"""WITH {KNN}, {GOLD}, sub AS (SELECT *, unnest(list_filter([CASE WHEN sign = 'supports' THEN 'supporter' END, CASE WHEN sign = 'refutes' THEN 'refuter' END,
  CASE WHEN sign = 'refutes' AND dissimilar THEN 'dissimilar_refuter' END], lambda x: x IS NOT NULL)) AS subset FROM gold)
SELECT budget::INTEGER AS budget, subset, (count(*) FILTER (WHERE rank <= budget)) / count(*) AS recall, count(*) AS n_gold
FROM sub LEFT JOIN knn USING (evidence, hypothesis), (SELECT unnest([1, 5, 10]) AS budget) GROUP BY budget, subset"""
)
def split_recall_curve(spark, sf_dir):
    return M.split_recall(C.knn_candidates(*_sides(spark, sf_dir)), _gold(spark, sf_dir), [1, 5, 10])


def _samples(spark, sf_dir):
    return V.table(spark, sf_dir, "embeddings").select(
        "label", (F.col("vec_id") % 5).cast("int").alias("sample"), F.col("vec_id").cast("long").alias("position"), F.col("embedding").cast("array<double>").alias("vector")
    )


@query()
def leader_clusters(spark, sf_dir):
    out = K.leader_clusters(_samples(spark, sf_dir), ["label"], ["sample", "position"], 0.6)
    return out.groupBy("label", "cluster").agg(F.count("*").alias("members"), F.min("position").alias("first"))


@query("SELECT label, (vec_id % 7)::INTEGER AS cluster, least(1.0, count(DISTINCT vec_id % 5) / 5::DOUBLE) AS agreement FROM embeddings WHERE vec_id % 5 <= vec_id % 7 GROUP BY ALL")
def sample_agreement(spark, sf_dir):
    """Clusters that some samples have no member in."""
    rows = _samples(spark, sf_dir).withColumn("cluster", (F.col("position") % 7).cast("int")).where("sample <= cluster")
    return K.agreement(rows, ["label"], 5)


@query(
    f"""WITH {SIDES}, m AS (SELECT a.label, a.vec_id, round(coalesce(avg(list_cosine_similarity(a.v, b.v)), 0.0), 9) AS mean_cosine FROM vec a LEFT JOIN vec b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL)
SELECT label, vec_id AS position, round(mean_cosine, 6) AS mean_cosine FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY mean_cosine DESC, vec_id % 5, vec_id) = 1"""
)
def medoid(spark, sf_dir):
    out = K.medoids(_samples(spark, sf_dir).withColumn("cluster", F.lit(0)), ["label"], ["sample", "position"])
    return out.select("label", "position", F.round("mean_cosine", 6).alias("mean_cosine"))


@query()
def consolidated_samples(spark, sf_dir):
    rows = _samples(spark, sf_dir).withColumns({"polarity": F.when(F.col("position") % 2 == 0, "affirmed").otherwise("negated"), "epistemic_class": F.lit("observation")})
    out = K.consolidate(rows, ["label"], 5, 0.5)
    return out.select("label", "polarity", "cluster", "position", F.round("agreement", 6).alias("agreement"), "twin")


@query()
def claim_keys(spark, sf_dir):
    hyp, ev = _sides(spark, sf_dir)
    return K.claim_keys(hyp.union(ev).select(F.col("node").alias("proposition"), "model", "vector"), 0.6)


@query()
def permuted_panel(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("label", "vec_id")
    return K.permuted(e, "label", "vec_id")


SIGNAL = f"""{SIDES}, g AS (SELECT label AS doc, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS position, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM vec),
s AS (SELECT doc, position, list_cosine_similarity(v, nxt) AS similarity FROM g WHERE nxt IS NOT NULL),
m AS (SELECT *, avg(similarity) OVER (PARTITION BY doc ORDER BY position ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM s),
t AS (SELECT *, avg(smooth) OVER (PARTITION BY doc) - 0.5 * stddev_pop(smooth) OVER (PARTITION BY doc) AS floor, lag(smooth) OVER w AS l, lead(smooth) OVER w AS r FROM m WINDOW w AS (PARTITION BY doc ORDER BY position))"""


def _signal(spark, sf_dir):
    from pyspark.sql import Window

    e = V.table(spark, sf_dir, "embeddings").withColumn("position", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    return e.select(F.col("label").alias("doc"), "position", F.col("embedding").cast("array<double>").alias("vector"))


@query(
    f"WITH {SIGNAL} SELECT doc, position::INTEGER AS position, round(similarity, 6) AS similarity, round(smooth, 6) AS smooth, coalesce(smooth < l AND smooth < r AND smooth < floor, false) AS valley FROM t"
)
def segment_signal(spark, sf_dir):
    out = X.segment_signal(_signal(spark, sf_dir))
    return out.withColumns({"similarity": F.round("similarity", 6), "smooth": F.round("smooth", 6)})


@query()
def segment_dp(spark, sf_dir):
    """Two levels of segments from one signal."""
    rows = _signal(spark, sf_dir)
    valleys = X.segment_signal(rows).select("doc", (F.col("position") - 1).alias("p"), "valley")
    rows = rows.withColumn("p", F.col("position") - 1).join(valleys, ["doc", "p"], "left").withColumn("density", (F.col("position") % 3).cast("double"))
    return X.segment_documents(rows.select("doc", "position", "vector", "density", F.coalesce("valley", F.lit(False)).alias("valley")), X.level_policy())


@query(
    f"WITH {SIDES}, flat AS (SELECT label, unnest(range(len(v))) AS d, unnest(v) AS x FROM vec), p AS (SELECT label, d, avg(x) AS x FROM flat GROUP BY ALL) "
    "SELECT label, d::INTEGER AS d, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM p"
)
def mean_pooled(spark, sf_dir):
    out = X.mean_pool(_samples(spark, sf_dir), ["label"])
    return out.select("label", F.posexplode("vector").alias("d", "x")).withColumn("x", F.round("x", 6))
