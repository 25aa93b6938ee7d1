"""URL filtering by host-and-path rules and by pattern rules indexed by their rarest literal token.

Every pattern rule names literal tokens that any URL it matches must contain as whole tokens. A count over
all URLs tells which of them is rarest in the corpus; the rule is filed under that one. A URL's tokens fetch
the rules filed under them and only those run their regular expressions.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import map_arrow, table


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` is searched in the URL with A-Z lower-cased; ``tokens`` are runs of a-z0-9 it requires."""

    name: str
    pattern: str
    tokens: tuple[str, ...]


HOST_RULES = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)


def host_word(word: str) -> PatternRule:
    """Blocks hosts with ``word`` between dots, hyphens or the ends."""
    return PatternRule(f"host:{word}", rf"^[a-z][a-z0-9+.-]*://([^/?#]*[.-])?{word}[.-]", (word,))


#: Words for gambling, drugs, sex, advertising and abuse that hosts are commonly blocked by.
HOST_WORDS = "casino poker bet bets betting slots pills pharmacy viagra adult porn sex xxx escort ads adserver track tracker tracking spam phishing malware torrent warez".split()
PATTERN_RULES = (
    *map(host_word, HOST_WORDS),
    PatternRule("login", r"^[^?#]*/login(/|$|[?#])", ("login",)),
    PatternRule("wp-admin", r"/wp-admin(/|$|[?#])", ("wp", "admin")),
)
#: Characters of pattern rules up to which they are broadcast; a longer list is refused, not cut.
MOST_RULE_CHARS = 64 << 20
_run = re.compile(r"[a-z0-9]+")
_upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_parts = re.compile(r"://([^/?#]*)([^?#]*)")


def split_url(url: str | None) -> tuple[str, str]:
    found = _parts.search(url or "")
    return (found.group(1).translate(_upper), found.group(2)) if found else ("", "")


def index_rules(rules: Sequence[PatternRule], counts: dict[str, int]) -> dict[str, list[PatternRule]]:
    """Each rule under the token that the fewest URLs contain; ties go to the first in alphabetical order."""
    index: dict[str, list[PatternRule]] = defaultdict(list)
    for rule in rules:
        if not rule.tokens:
            raise ValueError(f"rule {rule.name} has no literal token to be indexed by")
        index[min(rule.tokens, key=lambda t: (counts.get(t, 0), t))].append(rule)
    return dict(index)


def read_rules(spark: SparkSession, path: str) -> tuple[PatternRule, ...]:
    """Pattern rules from tab-separated lines: name, pattern, tokens parted by spaces; blank lines and those from # on are skipped."""
    lines = (r[0].split("\t") for r in spark.read.text(path).collect() if r[0].strip() and not r[0].startswith("#"))
    return tuple(PatternRule(name, pattern, tuple(tokens.split())) for name, pattern, tokens in lines)


def token_counts(urls: DataFrame, literals: Sequence[str]) -> dict[str, int]:
    """How many URLs of the column ``low`` contain each literal; a row for each literal reaches the driver."""
    if not literals:
        return {}
    wanted = urls.sparkSession.createDataFrame([(t,) for t in literals], "t string")
    seen = urls.select(F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("[a-z0-9]+"), F.lit(0)))).alias("t"))
    return {r["t"]: r["n"] for r in seen.join(F.broadcast(wanted), "t").groupBy("t").agg(F.count("*").alias("n")).collect()}


def filter_urls(
    df: DataFrame,
    host_rules: Sequence[HostRule] = HOST_RULES,
    pattern_rules: Sequence[PatternRule] = PATTERN_RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Rows ``(page_id, host, path, rule, verdict, pattern)``, one per row of ``df``.

    The longest host rule that fits decides; else a URL that some pattern rule matches is blocked (the
    first rule in list order is named in ``pattern``) and any other allowed. A null URL, or one without
    ``://``, has an empty host and path and only pattern rules judge it; null URLs are allowed. Repeated
    rows and null ids pass through; an empty table gives no rows. The rule lists are parameters (see
    :func:`read_rules`): they are broadcast within ``MOST_RULE_CHARS``, and what reaches the driver, a count
    for each literal token, does not grow with the pages.
    """
    if sum(len(r.name) + len(r.pattern) + sum(map(len, r.tokens)) for r in pattern_rules) > MOST_RULE_CHARS:
        raise ValueError("the pattern rules are too long to be held by every worker")
    low_url = df.select(F.translate(F.col(url_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("low"))
    index = index_rules(pattern_rules, token_counts(low_url, sorted({t for r in pattern_rules for t in r.tokens})))
    shared = df.sparkSession.sparkContext.broadcast((index, {r.name: k for k, r in enumerate(pattern_rules)}, list(host_rules)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, order, hosts = shared.value
        compiled: dict[str, re.Pattern] = {}
        patterns = {r.name: r.pattern for rules in index.values() for r in rules}
        by_host: dict[str, list[HostRule]] = defaultdict(list)
        for r in hosts:
            by_host[r.host].append(r)

        def matches(name: str, low: str) -> bool:
            if name not in compiled:
                compiled[name] = re.compile(patterns[name])
            return compiled[name].search(low) is not None

        def judge(url: str | None) -> tuple:
            host, path = split_url(url)
            fits = []
            suffix = host
            while suffix:
                fits += [r for r in by_host.get(suffix, ()) if path.startswith(r.path)]
                suffix = suffix.partition(".")[2]
            if fits:
                best = max(fits, key=lambda r: len(r.host + r.path))
                return host, path, best.host + best.path, best.verdict, None
            low = (url or "").translate(_upper)
            fetched = {r.name for t in set(_run.findall(low)) if t in index for r in index[t]}
            hit = min((n for n in fetched if matches(n, low)), key=order.get, default=None)
            return host, path, None, "block" if hit else "allow", hit

        for batch in batches:
            judged = list(zip(*map(judge, batch.column(1).to_pylist()))) or [[]] * 5
            arrays = [batch.column(0)] + [pa.array(c, pa.string()) for c in judged]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "host", "path", "rule", "verdict", "pattern"])

    narrow = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return map_arrow(narrow, scan, "page_id long, host string, path string, rule string, verdict string, pattern string")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    fits = "\n".join(
        f"    WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.host}{r.path}'"
        for r in sorted(HOST_RULES, key=lambda r: -len(r.host + r.path))
    )
    verdicts = "\n".join(f"    WHEN rule = '{r.host}{r.path}' THEN '{r.verdict}'" for r in HOST_RULES)
    patterns = "\n".join(f"    WHEN regexp_matches(low, '{r.pattern}') THEN '{r.name}'" for r in PATTERN_RULES)
    return f"""
WITH a AS (SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
b AS (SELECT *, CASE
{fits} END AS rule FROM a),
c AS (SELECT *, CASE WHEN rule IS NULL THEN CASE
{patterns} END END AS pattern FROM b)
SELECT page_id, host, path, rule, CASE
{verdicts}
    WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM c
"""


ORACLE = _oracle()
