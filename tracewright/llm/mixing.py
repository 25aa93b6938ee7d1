"""Mixing sources to target weights by hierarchical budgeting over a domain-language-source tree.

The token budget is dealt from the root down. At each node the children get shares in proportion to their
weights, none more than its subtree can give (its tokens times ``max_epochs``); what a child cannot use goes
to its siblings first, and only what all of them cannot use has already been left with the node's own
siblings, because a node's capacity is the sum of its leaves'. A leaf's budget is whole passes over its
documents and then a prefix of one more pass, in an order seeded by the epoch. The document that the budget
ends in is cut to the words that are left.

Only DataFrame functions are used. Texts are never shuffled: token counts are written once, and from them each
leaf's last order key is found digits by digits, 256 sums a leaf at a time; the selection is a comparison
with that key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import WORD, table
from tracewright.plans.storage import materialize

SEED, MAX_EPOCHS, BUDGET_RATIO = 17, 2, 0.8
LANG_WEIGHTS = {"en": 4.0, "fr": 2.0, "de": 2.0, "es": 2.0}
#: Leaves up to which the table of cuts is broadcast; a larger one is joined by a shuffle.
BROADCAST_LEAVES = 50_000
#: Times that two more hexadecimal digits of the order keys are looked at before the keys themselves.
LEVELS = 3
_LEAF = ["__domain", "__lang", "__source"]


def domain_of(source: Column) -> Column:
    """Four domains from the first hex digit of the source's MD5, where a corpus has no domain column."""
    return F.concat(F.lit("d"), F.translate(F.substring(F.md5(source), 1, 1), "0123456789abcdef", "0123012301230123"))


def weight_of(name: Column, weights: Mapping[str, float], default: float = 1.0) -> Column:
    if any(w <= 0 for w in (*weights.values(), default)):
        raise ValueError("weights must be positive")
    out = F.lit(float(default))
    for key, value in weights.items():
        out = F.when(name == key, F.lit(float(value))).otherwise(out)
    return out


def water_fill(children: DataFrame, parent: list[str], node: str, budget: Column) -> DataFrame:
    """Adds ``alloc``: the parent's budget dealt by ``weight`` with ceilings ``cap``, shortages to siblings."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("__ratio"), F.col(node))
    out = children.withColumn("__budget", budget.cast("double")).withColumn("__ratio", F.col("cap") / F.col("weight"))
    out = out.withColumn("__before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("__share", (F.col("__budget") - F.col("__before")) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    open_share = F.max(F.when(F.col("__share") < F.col("__ratio"), F.col("__share"))).over(by)
    out = out.withColumn("__level", open_share)
    alloc = F.when(F.col("__share") >= F.col("__ratio"), F.col("cap")).otherwise(F.col("__level") * F.col("weight"))
    return out.withColumn("alloc", F.greatest(F.lit(0.0), alloc)).drop("__budget", "__ratio", "__before", "__share", "__level")


def leaf_budgets(leaves: DataFrame, total: float, lang_weights: Mapping[str, float], domain_weights: Mapping[str, float], source_weights: Mapping[str, float]) -> DataFrame:
    """Adds ``alloc`` tokens to leaves ``(__domain, __lang, __source, cap)``."""
    d, l, s = _LEAF
    domains = leaves.groupBy(d).agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(F.col(d), domain_weights))
    domains = water_fill(domains, [], d, F.lit(float(total))).select(d, F.col("alloc").alias("__up"))
    langs = leaves.groupBy(d, l).agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(F.col(l), lang_weights)).join(domains, d)
    langs = water_fill(langs, [d], l, F.col("__up")).select(d, l, F.col("alloc").alias("__up"))
    sources = leaves.withColumn("weight", weight_of(F.col(s), source_weights)).join(langs, [d, l])
    return water_fill(sources, [d, l], s, F.col("__up")).drop("weight", "__up")


def _ends(tokens: DataFrame, budget: DataFrame, order_key) -> DataFrame:
    """Rows ``(*_LEAF, full, last, left)``: the last order key a leaf's budget reaches, and its tokens in reach of that key.

    ``LEVELS`` times the next digits of the order keys are summed, and the digits kept where the budget ends,
    so that a task never sorts more than 256 sums of a leaf; what is left at the end is a 2**24th of a leaf.
    """
    at = budget.where("rest > 0").select(*_LEAF, "full", "rest", F.lit("").alias("cut"), F.lit(0).cast("long").alias("before"))
    at = materialize(at, "mix-level")
    for level in range(LEVELS + 1):
        rows = tokens.join(F.broadcast(at) if _few(at) else at, _LEAF).withColumn("order", order_key(F.col("full"), F.col("id")))
        digits = 2 * (level + 1) if level < LEVELS else 32
        sums = rows.where(F.substring("order", 1, 2 * level) == F.col("cut"))
        sums = sums.groupBy(*_LEAF, "full", "rest", "before", F.substring("order", 1, digits).alias("next")).agg(F.sum("tok").alias("tok"))
        run = Window.partitionBy(*_LEAF).orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("start", F.col("before") + F.coalesce(F.sum("tok").over(run), F.lit(0))).where("start < rest")
        found = sums.groupBy(*_LEAF, "full", "rest").agg(F.max("next").alias("cut"), F.max("start").alias("before"))
        at = materialize(found, "mix-level")
    last = at.select(*_LEAF, F.col("cut").alias("last"), (F.col("rest") - F.col("before")).alias("left"))
    return materialize(budget.select(*_LEAF, "full").join(last, _LEAF, "left"), "mix-ends")


def _few(leaves: DataFrame) -> bool:
    return leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES


def mix_sources(
    df: DataFrame,
    budget_ratio: float = BUDGET_RATIO,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    lang_weights: Mapping[str, float] = LANG_WEIGHTS,
    domain_weights: Mapping[str, float] = {},
    source_weights: Mapping[str, float] = {},
    domain: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    cut: bool = True,
) -> DataFrame:
    """The selected rows with all their columns, one copy for each epoch, and last a struct ``__mix``.

    The text that a budget ends in is cut to the words left (whole with ``cut`` false); ``__mix`` has domain,
    epoch and n_tokens (words taken), and gets more underscores where ``df`` has such a column; any other
    names pass through. The budget is ``budget_ratio`` times all tokens. Null language, source and id count
    as empty strings, null text as no tokens; rows repeated with one id go together and are cut alike; a
    leaf without tokens gives nothing; an empty table gives no rows.
    """
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    source = F.coalesce(F.col(source_col), F.lit(""))
    leaf = [
        (domain_of(source) if domain is None else F.coalesce(domain, F.lit(""))).alias(_LEAF[0]),
        F.coalesce(F.col(lang_col), F.lit("")).alias(_LEAF[1]), source.alias(_LEAF[2]), key.alias("id"),
    ]

    def order_key(epoch: Column, id_: Column) -> Column:
        return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), id_))

    tokens = materialize(df.select(*leaf, F.regexp_count(text, F.lit(WORD)).cast("long").alias("tok")), "mix-tokens")
    leaves = tokens.groupBy(*_LEAF).agg(F.sum("tok").alias("have"))
    leaves = materialize(leaves.withColumn("cap", F.col("have").cast("double") * max_epochs), "mix-leaves")
    total = (leaves.agg(F.sum("have")).first()[0] or 0) * budget_ratio
    budget = leaf_budgets(leaves, total, lang_weights, domain_weights, source_weights)
    budget = budget.withColumn("take", F.floor(F.col("alloc") + 1e-6)).where("have > 0")
    budget = budget.withColumn("full", F.least(F.lit(max_epochs), F.floor(F.col("take") / F.col("have"))).cast("int"))
    rest = F.when(F.col("full") < max_epochs, F.col("take") - F.col("full") * F.col("have")).otherwise(0)
    budget = materialize(budget.withColumn("rest", rest).select(*_LEAF, "full", "rest"), "mix-budget")
    ends = _ends(tokens, budget, order_key)

    columns = [F.col(f"`{c}`") for c in df.columns]
    chosen = df.select(F.struct(*columns).alias("row"), *leaf)
    chosen = chosen.join(F.broadcast(ends) if _few(ends) else ends, _LEAF)
    epochs = F.array(*[F.lit(e) for e in range(max_epochs)])
    order = order_key(F.col("full"), F.col("id"))
    taken = F.filter(epochs, lambda e: (e < F.col("full")) | ((e == F.col("full")) & (order <= F.col("last"))))
    chosen = chosen.withColumn("epoch", F.explode(taken))
    own = F.col("row").getField(text_col)
    count = F.regexp_count(F.coalesce(own, F.lit("")), F.lit(WORD)).cast("long")
    # Only the document that a budget ends in is counted against it; for all others the test is a comparison of keys.
    ended = (F.col("epoch") == F.col("full")) & (order == F.col("last")) & (count > F.col("left"))
    words = F.when(ended & F.lit(cut), F.col("left")).otherwise(count)
    name = "__mix"
    while name in df.columns:
        name += "_"
    mark = F.struct(F.col(_LEAF[0]).alias("domain"), F.col("epoch"), words.alias("n_tokens")).alias(name)
    if not cut:
        return chosen.select("row.*", mark)
    head = F.array_join(F.slice(F.regexp_extract_all(own, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("left").cast("int")), "")
    fields = [F.when(ended, head).otherwise(own).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns]
    return chosen.select(*fields, mark)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "__mix.domain", "lang", "source", F.col("__mix.epoch").cast("long").alias("epoch"), "__mix.n_tokens")


def _fill_sql(name: str, rows: str, parent: str, node: str, budget: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""{name}_a AS (SELECT *, {budget} AS b, cap / weight AS ratio FROM ({rows})),
{name}_b AS (SELECT *, (b - coalesce(sum(cap) OVER ({part} ORDER BY ratio, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER ({part} ORDER BY ratio, {node} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM {name}_a),
{name} AS (SELECT *, greatest(0.0, CASE WHEN share >= ratio THEN cap
    ELSE max(CASE WHEN share < ratio THEN share END) OVER ({part}) * weight END) AS alloc FROM {name}_b)"""


ORACLE = f"""
WITH docs AS (
  SELECT doc_id, lang, source, 'd' || translate(substr(md5(source), 1, 1), '0123456789abcdef', '0123012301230123') AS domain,
    CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS have, sum(n_tokens)::DOUBLE * {MAX_EPOCHS} AS cap FROM docs GROUP BY ALL),
{_fill_sql("dom", "SELECT domain, sum(cap) AS cap, 1.0::DOUBLE AS weight FROM leaves GROUP BY domain", "", "domain",
           f"(SELECT sum(have) FROM leaves) * {BUDGET_RATIO}::DOUBLE")},
{_fill_sql("lan", "SELECT x.domain, lang, x.cap, weight, alloc AS up FROM (SELECT domain, lang, sum(cap) AS cap, "
           "(CASE WHEN lang = 'en' THEN 4.0 WHEN lang IN ('fr', 'de', 'es') THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight FROM leaves GROUP BY ALL) x "
           "JOIN (SELECT domain, alloc FROM dom) y USING (domain)", "domain", "lang", "up")},
{_fill_sql("src", "SELECT x.*, 1.0::DOUBLE AS weight, y.alloc AS up FROM leaves x JOIN lan y USING (domain, lang)", "domain, lang", "source", "up")},
plan AS (SELECT domain, lang, source, least({MAX_EPOCHS}, floor(floor(alloc + 1e-6) / have)) AS full_passes,
    floor(alloc + 1e-6) AS take, have FROM src WHERE have > 0),
passes AS (
  SELECT d.*, e.epoch, p.full_passes, p.take - p.full_passes * p.have AS rest,
    coalesce(sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source, e.epoch ORDER BY md5('{SEED}:' || e.epoch || ':' || doc_id)
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM docs d JOIN plan p USING (domain, lang, source), (SELECT unnest(range({MAX_EPOCHS})) AS epoch) e)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch,
  CAST(CASE WHEN epoch = full_passes THEN least(n_tokens, rest - start) ELSE n_tokens END AS BIGINT) AS n_tokens FROM passes
WHERE epoch < full_passes OR (epoch = full_passes AND start < rest)
"""  # noqa: E501
