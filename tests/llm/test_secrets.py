import hashlib
import random
import re
from collections import defaultdict

from tracewright.llm import secrets

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def brute(text):
    spans, counts = [], {}
    for k, (name, (pattern, group, least)) in enumerate(BASE.items()):
        found = [m for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
        counts[name] = len(found)
        spans += [(m.start(), k, m.end(), name) for m in found]
    joined = ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(spans))
    return counts, joined, hashlib.sha256(joined.encode()).hexdigest()


def check(rows, docs):
    for r in rows:
        counts, joined, digest = brute(docs[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (counts["assign"], counts["access"], counts["hex"], digest), r
        assert set(filter(None, joined.split(","))) <= set(filter(None, r.spans.split(",")))


def test_query_against_regular_expressions(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = secrets.op5_secrets(spark, sf).collect()
    assert len(rows) == len(docs) and sum(r.n_assign for r in rows) > 0
    check(rows, docs)


FURTHER = {
    "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?"), 0, 1),
    "forge": (re.compile(r"gh[opusr]_[A-Za-z0-9]{36,}"), 0, 1),
    "login": (re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:([^\s/:@]{6,64})@", re.A), 1, 1),
}


def test_added_spans_and_owner_counts_against_brute_force(spark, sf):
    """Owners of every value over the whole table, and what that makes live, copied and added."""
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text", "source").collect()
    jwt, forge = "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "ghp_" + "aB3" * 13
    extra = [(10**6 + k, f"x {jwt} and {forge[:-1]}{k} postgres://me:pass{k % 2}word12@host/db é {'ab12' * 7} token={'q1w2e3r4t5y6' if k else 'u7i8o9p0a1s2'}", f"own{k}") for k in range(5)]
    rows = [tuple(r) for r in docs] + extra
    kinds = {**BASE, **FURTHER}
    found, owners = {}, defaultdict(set)
    for d, text, source in rows:
        spans = [(m.start(), k, m.end(), n, m.group(g)) for k, (n, (p, g, least)) in enumerate(kinds.items()) for m in p.finditer(text or "") if len(m.group(g)) >= least]
        found[d] = sorted(spans)
        for s in spans:
            owners[s[4]].add(source or "")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    added = 0
    for d, spans in found.items():
        copied = [len(owners[s[4]]) >= secrets.MIN_OWNERS for s in spans]
        live = [not c and len(s[4]) >= 12 and bool(re.search("[0-9]", s[4])) and bool(re.search("[A-Za-z]", s[4])) for c, s in zip(copied, spans)]
        kept = ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s, ok in zip(spans, live) if ok or s[3] in BASE)
        r = got[d]
        assert (r.n_live, r.n_copied, r.spans) == (sum(live), sum(copied), kept)
        assert r.most_repositories == max((len(owners[s[4]]) for s in spans), default=0)
        added += sum(ok and s[3] not in BASE for s, ok in zip(spans, live))
    assert added >= 5


def test_spans_of_awkward_texts(spark):
    rng = random.Random(2)
    bits = ["token=", "secret: ", "API_KEY='", "apikey =\"", "abc123DEF=", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "é", "😀", " ", "\n", "x", "passwd:", "ſecret=abcdefgh"]
    texts = [None, "", "token=secret : abcdefgh", "token=a token=bcdefg", "secret=token : abcdefgh", "AKIA" * 6, "a" * 24, "a" * 23, "😀password=12345678😀"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    texts += [" token=abcdef" * 2000, "é token=abcdef" * 70000]
    docs = dict(enumerate(texts))
    df = spark.createDataFrame([(k, t, None if k % 5 == 0 else f"s{k % 3}", None, 1) for k, t in docs.items()], "doc_id long, text string, source string, lang string, n_hex int")
    rows = secrets.scan_secrets(df).collect()
    assert len(rows) == len(docs)
    check(rows, docs)


def test_ownership_separates_examples_from_live_values(spark):
    example, live, jwt = "AKIA" + "EXAMPLE0" * 2, "AKIA" + "Q1W2E3R4" * 2, "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"
    rows = [(k, f"key {example}", f"s{k}", "en") for k in range(4)] + [(10, f"key {live}", "s1", "en"), (11, f"use {jwt} now", "s1", "en")]
    rows += [(20 + k, "Bearer eyJ0000000000.eyJ1111111111", f"s{k}", "en") for k in range(3)] + [(30, f"key {live}", "s1", "en")] * 2
    found = defaultdict(list)
    for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect():
        found[r.doc_id].append(r)
    assert found[0][0].n_copied == 1 and found[0][0].n_live == 0 and found[0][0].spans == "access:4:24"
    assert found[10][0].n_live == 1 and found[10][0].n_copied == 0
    assert found[11][0].spans == f"jwt:4:{4 + len(jwt)}" and found[11][0].n_live == 1
    assert found[20][0].spans == "" and found[20][0].n_copied == 1
    assert len(found[30]) == 2 and all(r.n_live == 1 for r in found[30])


def test_empty_table(spark):
    assert secrets.scan_secrets(spark.createDataFrame([], "doc_id long, text string, source string, lang string")).count() == 0
