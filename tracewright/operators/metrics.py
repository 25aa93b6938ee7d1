"""Evaluation metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.plans.storage import materialize


def brier(rows: DataFrame) -> DataFrame:
    """Mean squared error of ``(p, outcome)``."""
    return rows.agg(F.avg(F.pow(F.col("p") - F.col("outcome"), 2)).alias("brier"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """``(bin, n, mean_p, rate)`` with empty bins; a bin is the whole part of p / width in doubles."""
    width = F.lit(1.0) / F.lit(float(bins))
    index = F.least(F.floor(F.col("p") / width).cast("int"), F.lit(bins - 1))
    found = rows.groupBy(index.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("outcome").cast("double")).alias("rate"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").fillna(0, ["n"])


def ece(rows: DataFrame, bins: int = 10) -> DataFrame:
    total, gap = F.sum("n"), F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate")))
    return reliability(rows, bins).agg((gap / total).alias("ece"))


def kappa(rows: DataFrame) -> DataFrame:
    """Cohen's kappa of two 0/1 columns ``(a, b)``; where chance agreement is sure, 1 or 0 by observed agreement."""
    out = rows.agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"), F.avg("a").alias("pa"), F.avg("b").alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    sure = F.abs(1 - pe) < 1e-12
    return out.select(F.when(sure, F.when(F.col("po") == 1, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.col("po") - pe, 1 - pe)).alias("kappa"))


def _average_rank(rows: DataFrame, col: str) -> DataFrame:
    """Average ranks: distinct values are dealt by range, and each part adds what the parts before it hold."""
    counts = rows.groupBy(col).agg(F.count("*").alias("n"))
    dealt = materialize(counts.repartitionByRange(col).withColumn("part", F.spark_partition_id()), "ranks")
    parts = dealt.groupBy("part").agg(F.sum("n").alias("held"))
    # A row a part, which are as many as the session has shuffle partitions.
    offsets = parts.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("within", within).join(F.broadcast(offsets), "part").select(col, (F.col("offset") + F.col("within") + (F.col("n") + 1) / 2).alias(f"rank_{col}"))


def spearman(rows: DataFrame) -> DataFrame:
    """Rank correlation of ``(x, y)``; NaN without variance."""
    ranked = rows.join(_average_rank(rows, "x"), "x").join(_average_rank(rows, "y"), "y")
    spread = F.stddev_pop("rank_x") * F.stddev_pop("rank_y")
    rho = F.try_divide(F.covar_pop("rank_x", "rank_y"), spread)
    return ranked.agg(F.coalesce(rho, F.lit(float("nan"))).alias("rho"))


def state_flips(rows: DataFrame) -> DataFrame:
    """One row of ``(gold_before, gold_after, pred_before, pred_after)``: each state in one bucket, their total and the error rate.

    ``held_when_should_flip``: the gold moves and the prediction doesn't; ``flipped_when_should_hold``: the
    other way round; ``wrong_direction``: both move, apart; else ``correct``. No rows are an error.
    """
    gold, pred = F.signum(F.col("gold_after") - F.col("gold_before")), F.signum(F.col("pred_after") - F.col("pred_before"))
    held, flipped, wrong = (gold != 0) & (pred == 0), (gold == 0) & (pred != 0), (gold != 0) & (pred != 0) & (gold != pred)
    out = rows.agg(
        F.when(F.count("*") == 0, F.raise_error(F.lit("no states")).cast("long")).otherwise(F.count("*")).alias("total"), F.count_if(gold == pred).alias("correct"),
        F.count_if(held).alias("held_when_should_flip"), F.count_if(flipped).alias("flipped_when_should_hold"), F.count_if(wrong).alias("wrong_direction"),
    )
    return out.withColumn("error_rate", (F.col("total") - F.col("correct")) / F.col("total"))


def node_pairs(pool: DataFrame) -> DataFrame:
    """``(rank, evidence, hypothesis)`` of a candidate pool in its total order: by hypothesis, then evidence."""
    order = Window.partitionBy("hypothesis").orderBy("evidence")
    return pool.select("evidence", "hypothesis").distinct().withColumn("rank", F.row_number().over(order))


def recall_at_budget(ranked: DataFrame, gold: DataFrame, budget: int) -> DataFrame:
    """``(budget, recall)`` of gold pairs among the first ``budget`` rows; repeated rows use budget up.

    ``ranked(rank, evidence, hypothesis)``, ``gold(evidence, hypothesis)``. Empty gold is an error.
    """
    return recall_curve(ranked, gold.withColumn("subset", F.lit("all")), [budget]).select("budget", "recall")


def recall_curve(ranked: DataFrame, gold: DataFrame, budgets: list[int]) -> DataFrame:
    """``(budget, subset, recall, n_gold)``: each gold pair counts from its first rank on."""
    first = ranked.groupBy("evidence", "hypothesis").agg(F.min("rank").alias("rank"))
    at = gold.distinct().join(first, ["evidence", "hypothesis"], "left").withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    total = F.when(F.count("*") == 0, F.raise_error(F.lit("no gold pairs")).cast("long")).otherwise(F.count("*"))
    return at.groupBy("budget", "subset").agg((F.count_if(F.col("rank") <= F.col("budget")) / total).alias("recall"), F.count("*").alias("n_gold"))


def split_recall(ranked: DataFrame, gold: DataFrame, budgets: list[int]) -> DataFrame:
    """Recall of supporters, refuters and dissimilar refuters of ``gold(evidence, hypothesis, sign, dissimilar)``."""
    subsets = F.array_compact(F.array(
        F.when(F.col("sign") == "supports", "supporter"), F.when(F.col("sign") == "refutes", "refuter"),
        F.when((F.col("sign") == "refutes") & F.col("dissimilar"), "dissimilar_refuter"),
    ))
    return recall_curve(ranked, gold.select("evidence", "hypothesis", F.explode(subsets).alias("subset")), budgets)


def project_ids(pairs: DataFrame, evidence_map: DataFrame, hypothesis_map: DataFrame) -> DataFrame:
    """Node pairs to gold ids through ``(node, gold)`` maps, keeping ranks; unmapped pairs go."""
    e = evidence_map.select(F.col("node").alias("evidence"), F.col("gold").alias("gold_evidence"))
    h = hypothesis_map.select(F.col("node").alias("hypothesis"), F.col("gold").alias("gold_hypothesis"))
    out = pairs.join(e, "evidence").join(h, "hypothesis")
    return out.select("rank", F.col("gold_evidence").alias("evidence"), F.col("gold_hypothesis").alias("hypothesis"))


def gold_edges(planted: DataFrame, dissimilar_kinds: tuple[str, ...] = ("dissimilar_refuter",)) -> DataFrame:
    """Edges of ``planted(item, kind, supports, refutes)``."""
    flag = F.col("kind").isin(*dissimilar_kinds)
    side = lambda col: planted.where(F.col(col).isNotNull()).select(F.col("item").alias("evidence"), F.col(col).alias("hypothesis"), F.lit(col).alias("sign"), flag.alias("dissimilar"))
    return side("supports").unionByName(side("refutes"))


def report(metrics: DataFrame, system: str = "system", metric: str = "metric", value: str = "value", digits: int = 4) -> str:
    """A Markdown table of metric rows, one column a system; a report's few rows come to the driver."""
    wide = metrics.groupBy(metric).pivot(system).agg(F.first(value)).orderBy(metric)
    names = wide.columns
    show = lambda x: "—" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(map(show, row)) + " |" for row in wide.toLocalIterator()]) + "\n"


def latency(spark: SparkSession, run, repetitions: int = 7) -> dict[str, float]:
    """Median and 95th percentile of wall seconds over repetitions after one warm-up."""
    import time

    run()
    taken = []
    for _ in range(repetitions):
        began = time.perf_counter()
        run()
        taken.append(time.perf_counter() - began)
    taken.sort()
    return {"median": taken[len(taken) // 2], "p95": taken[min(len(taken) - 1, int(0.95 * len(taken)))]}
