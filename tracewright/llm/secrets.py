"""Secret scanning with corpus-wide ownership frequency, in DataFrame functions alone.

Each text is scanned once for candidates of the base kinds and some further ones. The values' hashes are
counted by distinct repositories and owners over the whole corpus: a value that many owners carry is a
copied example, one that few carry and that looks like a credential is live. Base spans always stay; spans
of further kinds are added where the value is live.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import table
from tracewright.plans.storage import materialize

MIN_OWNERS = 3


@dataclass(frozen=True)
class Kind:
    """``group`` holds the value, which must have ``least`` characters; only ASCII letters fold case."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # The same matches as runs of any length of which those of 24 and more are kept.
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?"),
    Kind("forge", r"gh[opusr]_[A-Za-z0-9]{36,}"),
    Kind("login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:([^\s/:@]{6,64})@", 1),
)
_SPAN = "struct<start:int,kind:int,end:int,value:string>"
_BLOCK = 256


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def find_spans(text: Column, number: int, kind: Kind) -> Column:
    """Spans of one kind in code points: what the pattern leaves between its matches gives their places.

    Offsets are sums of steps, of blocks of steps and of blocks of blocks, so each of n matches adds up
    n / 65,536 + 512 numbers at most.
    """
    pattern = F.lit(kind.pattern)

    def place(f: Column) -> Column:
        step = F.zip_with(F.slice(f["gaps"], 1, F.size(f["all"])), f["all"], lambda g, m: F.length(g) + F.length(m))
        return _let(step, lambda steps: _let(blocks(steps), lambda sums: _let(blocks(sums), lambda tops: spans(f, steps, sums, tops))))

    def blocks(steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), lambda b: _sum(F.slice(steps, b * _BLOCK + 1, _BLOCK)))

    def spans(f: Column, steps: Column, sums: Column, tops: Column) -> Column:
        def span(match: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            top = F.floor(block / _BLOCK).cast("int")
            end = _sum(F.slice(tops, 1, top)) + _sum(F.slice(sums, top * _BLOCK + 1, block % _BLOCK)) + _sum(F.slice(steps, block * _BLOCK + 1, i % _BLOCK + 1))
            return F.struct((end - F.length(match)).alias("start"), F.lit(number).alias("kind"), end.alias("end"), F.get(f["value"], i).alias("value"))

        return F.filter(F.transform(f["all"], span), lambda s: F.length(s["value"]) >= kind.least)

    found = F.struct(
        F.split(text, kind.pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, 0).alias("all"),
        F.regexp_extract_all(text, pattern, kind.group).alias("value"),
    )
    return F.when(text.rlike(kind.pattern), _let(found, place)).otherwise(F.from_json(F.lit("[]"), f"array<{_SPAN}>"))


def _join_spans(spans: Column, names: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, number: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def scan_secrets(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_cols: tuple[str, ...] = ("source",),
    min_owners: int = MIN_OWNERS,
    kinds: tuple[Kind, ...] = KINDS,
) -> DataFrame:
    """One row per row of ``df`` with counts, base digest, all spans, and counts of live and copied values.

    Owners decide: a value in many repositories of one owner is still that owner's. How many repositories the
    widest spread value of a row has is returned beside. ``documents`` names neither; its source stands for both.
    A null text counts as empty: no spans, the digest of an empty string. Null owners and repositories
    count as one owner and repository. Repeated rows give repeated results and add no owner. An empty
    table gives no rows; other columns are not read. Values leave this operator only as spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository_cols]).alias("repository"), text.alias("text"),
    )
    parts = [find_spans(F.col("text"), k, kind) for k, kind in enumerate(kinds)]
    narrow = narrow.withColumn("found", F.sort_array(F.concat(*parts))).withColumn("row", F.monotonically_increasing_id())
    hashed = F.transform("found", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"),
        (s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (F.length(s["value"]) >= 12)).alias("looks"),
    ))
    docs = materialize(narrow.select("row", "doc_id", "owner", "repository", hashed.alias("found")), "secrets")

    single = docs.where(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("s"))
    single = single.select("row", "owner", "repository", "s.*")
    copies = single.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    spread = copies.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.count("*").alias("repositories"))
    judged = single.join(materialize(spread, "secret-owners"), "hash")
    copied = F.col("owners") >= min_owners
    judged = judged.withColumn("live", ~copied & F.col("looks")).withColumn("copied", copied)
    is_base = F.get(F.array(*[F.lit(k.base) for k in kinds]), F.col("kind"))
    rows = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(is_base | F.col("live"), F.struct("start", "kind", "end")))).alias("spans"),
        F.sum(F.col("live").cast("long")).alias("n_live"), F.sum(F.col("copied").cast("long")).alias("n_copied"),
        F.max("repositories").cast("long").alias("most_repositories"),
    )
    names = F.array(*[F.lit(k.name) for k in kinds])
    base = F.filter("found", lambda s: F.get(F.array(*[F.lit(k.base) for k in kinds]), s["kind"]))
    counts = [_count(F.col("found"), i).alias(f"n_{k.name}") for i, k in enumerate(kinds) if k.base]
    out = docs.join(rows, "row", "left")
    return out.select(
        "doc_id", *counts, F.sha2(_join_spans(base, names), 256).alias("base_sha256"),
        F.coalesce(_join_spans(F.col("spans"), names), F.lit("")).alias("spans"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_copied", "most_repositories")],
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
