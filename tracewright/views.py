"""Deterministic evidence-graph views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TIERS = ("case", "working", "reference", "domain")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tier_of(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), (key % 4 + 1).cast("int"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as boxes with tier, status and reliability prior."""
    s = table(spark, sf_dir, "supplier")
    prior = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s_acctbal") / 10000))
    status = F.when(F.col("s_suppkey") % 10 == 0, "deprecated").otherwise("active")
    return s.select(F.col("s_suppkey").alias("box"), F.col("s_name").alias("name"), tier_of(F.col("s_suppkey")).alias("tier"), status.alias("status"), prior.alias("reliability_prior"))


def hypotheses(spark: SparkSession, sf_dir: str, base: float = 0.4, regions: bool = False) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return o.select(F.col("o_orderkey").alias("hypothesis"), F.lit(base).alias("base"), *([region_of(F.col("o_custkey"))] if regions else []))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts: lines grouped by (order, part, supplier), with the sign and strength of their edge to the order."""
    by = ["l_orderkey", "l_partkey", "l_suppkey"]
    lines = table(spark, sf_dir, "lineitem").groupBy(*by).agg(
        (1 - F.avg("l_discount")).alias("base"), F.max("l_returnflag").alias("flag"), (F.avg("l_quantity") / 50).alias("strength"),
        F.count("*").alias("support_count"), F.min("l_shipdate").alias("valid_from"),
    )
    fact = F.concat_ws("-", *[F.col(c).cast("string") for c in by])
    return lines.select(
        fact.alias("fact"), F.col("l_orderkey").alias("hypothesis"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("box"), "base",
        F.when(F.col("flag") == "R", "refutes").otherwise("supports").alias("sign"), "strength", "support_count", "valid_from",
    )


def order_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each order to its customer's next one, the last to the first; a lone order has none."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    o = o.withColumn("dst", F.coalesce(F.lead("o_orderkey").over(w), F.first("o_orderkey").over(whole)))
    sign = F.when(F.col("o_orderkey") % 2 == 0, "supports").otherwise("refutes")
    return o.where("dst <> o_orderkey").select(F.col("o_orderkey").alias("src"), "dst", sign.alias("sign"), F.lit(0.5).alias("strength"))


def region_of(customer: Column) -> Column:
    """Orders without a customer count as one customer's, as they do in windows."""
    return F.coalesce(customer, F.lit(-1)).alias("region")


def derivations(spark: SparkSession, sf_dir: str, regions: bool = False) -> tuple[DataFrame, DataFrame]:
    """``base(node, confidence)`` and ``body(rule, head, atom, strength)``: an order follows from its customer's three before it.

    With ``regions`` both bring the customer as ``region``.
    """
    region = [region_of(F.col("o_custkey"))] if regions else []
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w))
    base = o.where("k = 1 and o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("node"), (0.5 + F.col("o_orderkey") % 50 / 100).alias("confidence"), *region)
    for step in (1, 2, 3):
        o = o.withColumn(f"p{step}", F.lag("o_orderkey", step).over(w))
    body = o.where("k > 1").select(
        F.col("o_orderkey").alias("rule"), F.col("o_orderkey").alias("head"), (1 - F.col("o_orderkey") % 7 / 100).alias("strength"),
        F.explode(F.array_compact(F.array("p1", "p2", "p3"))).alias("atom"), *region,
    )
    return base, body


def part_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (part, whole, meronymy) of customers, suppliers, nations, regions, parts and brands."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    n, p = table(spark, sf_dir, "nation"), table(spark, sf_dir, "part")

    def edges(df: DataFrame, child: str, ckey: str, parent: str, pkey: str, kind: str) -> DataFrame:
        name = lambda prefix, key: F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))
        return df.select(name(child, ckey).alias("part"), name(parent, pkey).alias("whole"), F.lit(kind).alias("meronymy"))

    whole = "component-integral"
    return (
        edges(c, "customer", "c_custkey", "nation", "c_nationkey", whole)
        .unionByName(edges(s, "supplier", "s_suppkey", "nation", "s_nationkey", whole))
        .unionByName(edges(n, "nation", "n_nationkey", "region", "n_regionkey", whole))
        .unionByName(edges(p, "part", "p_partkey", "brand", "p_brand", "stuff-object"))
    )


def kind_of(size: Column) -> Column:
    """Large parts act, the others are acted upon."""
    return F.when(size > 40, "actor").otherwise("object")


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity and the roles that it plays in lines, as distinct pairs."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("role")).distinct()


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities of boxes by brand, with normalised label and tokens."""
    from tracewright.functions import scalars as S

    p = table(spark, sf_dir, "part")
    out = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("box"), F.col("p_name").alias("label"), F.col("p_type").alias("type"), S.normalize_label(F.col("p_name")).alias("norm"), kind_of(F.col("p_size")).alias("kind"))
    return out.withColumn("tokens", S.tokens(F.col("norm")))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity and the suppliers that share an order line with it, as distinct pairs."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("context")).distinct()


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an append-only action log and as bitemporal versions of (user, event type)."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", "props", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"))
