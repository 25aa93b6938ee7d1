"""Calibration, agreement and correlation of labels and predictions."""

from pyspark.sql import functions as F

from tracewright import views as V
from tracewright.catalogue import query
from tracewright.operators import metrics as M

ROWS = "rows_ AS (SELECT doc_id, quality, toxic, n_chars, least(1.0::DOUBLE, n_chars / 5000.0::DOUBLE) AS p FROM labels JOIN documents USING (doc_id))"
BINS = f"{ROWS}, binned AS (SELECT least(floor(p / (1.0::DOUBLE / 10.0::DOUBLE))::INTEGER, 9) AS bin, count(*) AS n, avg(p) AS mean_p, avg(quality) AS rate FROM rows_ GROUP BY 1)"


def _rows(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return V.table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("p", F.least(F.lit(1.0), F.col("n_chars") / 5000.0))


def _predictions(spark, sf_dir):
    return _rows(spark, sf_dir).select("p", F.col("quality").alias("outcome"))


@query(f"WITH {ROWS} SELECT round(avg((p - quality) * (p - quality)), 6) AS brier FROM rows_")
def brier(spark, sf_dir):
    return M.brier(_predictions(spark, sf_dir)).select(F.round("brier", 6).alias("brier"))


@query(f"WITH {BINS} SELECT b.i::INTEGER AS bin, coalesce(n, 0) AS n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM (SELECT unnest(range(10)) AS i) b LEFT JOIN binned ON b.i = bin")
def reliability(spark, sf_dir):
    return M.reliability(_predictions(spark, sf_dir)).withColumns({"mean_p": F.round("mean_p", 6), "rate": F.round("rate", 6)})


@query(f"WITH {BINS} SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 6) AS ece FROM binned")
def ece(spark, sf_dir):
    return M.ece(_predictions(spark, sf_dir)).select(F.round("ece", 6).alias("ece"))


@query(
    "WITH s AS (SELECT avg((quality = toxic)::INT) AS po, avg(quality) AS pa, avg(toxic) AS pb FROM labels), e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM s) "
    "SELECT round(CASE WHEN abs(1 - pe) < 1e-12 THEN CASE WHEN po = 1 THEN 1.0 ELSE 0.0 END ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM e"
)
def kappa(spark, sf_dir):
    rows = V.table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b"))
    return M.kappa(rows).select(F.round("kappa", 6).alias("kappa"))


@query(
    f"WITH {ROWS}, r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS a, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2 AS b FROM rows_) "
    "SELECT round(corr(a, b), 6) AS rho FROM r"
)
def spearman(spark, sf_dir):
    rows = _rows(spark, sf_dir).select(F.col("n_chars").alias("x"), F.col("quality").alias("y"))
    return M.spearman(rows).select(F.round("rho", 6).alias("rho"))


@query(
    "WITH f AS (SELECT o_orderkey % 2 AS gb, o_orderkey % 3 % 2 AS ga, o_orderkey % 5 % 2 AS pb, o_orderkey % 7 % 2 AS pa FROM orders), s AS (SELECT sign(ga - gb) AS g, sign(pa - pb) AS p FROM f) "
    "SELECT count(*) AS total, count(*) FILTER (WHERE g = p) AS correct, count(*) FILTER (WHERE g <> 0 AND p = 0) AS held_when_should_flip, count(*) FILTER (WHERE g = 0 AND p <> 0) AS flipped_when_should_hold, "
    "count(*) FILTER (WHERE g * p < 0) AS wrong_direction, count(*) FILTER (WHERE g <> p) / count(*) AS error_rate FROM s"
)
def state_flips(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = V.table(spark, sf_dir, "orders").select((k % 2).alias("gold_before"), (k % 3 % 2).alias("gold_after"), (k % 5 % 2).alias("pred_before"), (k % 7 % 2).alias("pred_after"))
    return M.state_flips(rows)
