import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.llm import exact, mixing, urls


def against_sql(spark, sf, query, sql):
    got = query(spark, sf).toPandas()
    db = duckdb.connect()
    for name in ("documents", "pages"):
        db.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    want = db.execute(sql).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
    assert key(got) == key(want)


@pytest.mark.parametrize(
    "query, sql", [(mixing.op2_mix, mixing.ORACLE), (exact.op6_exact, exact.ORACLE), (urls.op7_urls, urls.ORACLE)], ids=["op2", "op6", "op7"]
)
def test_query_equals_sql(spark, sf, query, sql):
    against_sql(spark, sf, query, sql)


def fill(budget, children):
    """Water-filling by repeated proportional shares."""
    alloc, open_ = {k: 0.0 for k in children}, dict(children)
    left = budget
    while open_ and left > 1e-9:
        total = sum(w for w, _ in open_.values())
        full = {k for k, (w, cap) in open_.items() if cap - alloc[k] <= left * w / total + 1e-12}
        if not full:
            for k, (w, _) in open_.items():
                alloc[k] += left * w / total
            break
        for k in full:
            left -= open_[k][1] - alloc[k]
            alloc[k] = open_.pop(k)[1]
    return alloc


def test_water_fill_hands_shortages_to_siblings(spark):
    children = {"a": (1.0, 10.0), "b": (2.0, 5.0), "c": (1.0, 100.0), "d": (3.0, 12.0), "e": (1.0, 0.0)}
    df = spark.createDataFrame([(k, w, c) for k, (w, c) in children.items()], "node string, weight double, cap double")
    for budget in (0.0, 3.0, 20.0, 60.0, 127.0, 500.0):
        got = {r.node: r.alloc for r in mixing.water_fill(df, [], "node", F.lit(budget)).collect()}
        want = fill(min(budget, 127.0), children)
        assert got == pytest.approx(want)


def test_shortage_stays_inside_the_domain_before_it_leaves(spark):
    leaves = spark.createDataFrame([("d1", "en", "s", 10.0), ("d1", "fr", "s", 500.0), ("d2", "en", "s", 500.0)], "__domain string, __lang string, __source string, cap double")
    got = {(r["__domain"], r["__lang"]): r.alloc for r in mixing.leaf_budgets(leaves, 200.0, {}, {}, {}).collect()}
    assert got == pytest.approx({("d1", "en"): 10.0, ("d1", "fr"): 90.0, ("d2", "en"): 100.0})


def test_mixing_defined_cases(spark):
    rows = [(k, "w " * (k % 5 + 1), "en" if k % 2 else None, None if k % 3 else "s1", k) for k in range(40)] + [(99, None, "en", "s1", 0), (98, "", None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int")
    out = mixing.mix_sources(df, budget_ratio=1.0, max_epochs=1)
    assert out.columns == [*df.columns, "__mix"]
    assert {r.doc_id for r in out.collect()} >= set(range(40))
    twice = mixing.mix_sources(df, budget_ratio=2.0, max_epochs=2).where("text <> ''").groupBy("doc_id").count().collect()
    assert {r["count"] for r in twice} == {2}
    half = mixing.mix_sources(df, budget_ratio=0.5, max_epochs=1)
    words = sum(r["__mix"].n_tokens for r in half.collect())
    total = sum(len((r[1] or "").split()) for r in rows)
    assert total * 0.5 - 4 <= words <= total * 0.5  # each leaf is cut to the word
    assert sorted(r.doc_id for r in half.collect()) == sorted(r.doc_id for r in mixing.mix_sources(df.repartition(7), budget_ratio=0.5, max_epochs=1).collect())
    assert mixing.mix_sources(df.where("false")).count() == 0
    assert mixing.mix_sources(df.where("doc_id >= 98")).count() == 0
    shuffled = mixing.BROADCAST_LEAVES
    try:
        mixing.BROADCAST_LEAVES = 0
        again = mixing.mix_sources(df, budget_ratio=0.5, max_epochs=1)
        assert sorted(r.doc_id for r in again.collect()) == sorted(r.doc_id for r in half.collect())
    finally:
        mixing.BROADCAST_LEAVES = shuffled
    with pytest.raises(ValueError):
        mixing.mix_sources(df, lang_weights={"en": 0.0})


def test_index_persists_and_takes_only_new_digests(spark):
    index = exact.fresh_index(spark)
    schema = "doc_id long, text string, keep_id string"
    first = spark.createDataFrame([(1, "Abc", "x"), (2, "aBC", "x"), (3, None, "x"), (4, "", "x"), (5, "Ä", "x")], schema)
    got = {r.doc_id: r for r in exact.exact_duplicates(first, index).collect()}
    assert {k for k, r in got.items() if r.kept} == {2, 4, 5}
    assert got[1].keep_id == 2 and got[1].group_size == 2 and got[3].keep_id == 4
    assert got[5].text_sha256 == hashlib.sha256("Ä".encode()).hexdigest()  # only A-Z is folded
    second = spark.createDataFrame([(9, "ABC", "x"), (8, "ä", "x"), (8, "ä", "x")], schema)
    got = exact.exact_duplicates(second, exact.DigestIndex(spark, index.path)).collect()
    assert [(r.doc_id, r.keep_id, r.kept, r.group_size) for r in sorted(got, key=lambda r: -r.doc_id)] == [(9, 2, False, 1), (8, 8, True, 2), (8, 8, True, 2)]
    assert index.read().count() == 4
    assert exact.exact_duplicates(first.where("false"), index).count() == 0


def test_anti_join_reads_the_index_without_a_shuffle(spark):
    index = exact.fresh_index(spark)
    index.add(spark.createDataFrame([(b"a", 1), (b"b", 2)], "digest binary, keep_id long"))
    fresh = spark.createDataFrame([(b"b", 3), (b"c", 4)], "digest binary, keep_id long")
    plan = fresh.hint("merge").join(index.read().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    with exact.sorted_scans(spark):
        plan = fresh.hint("merge").join(index.read().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort [") == 1  # the new digests alone; each bucket of the index is one sorted file
    plan = index.winners(fresh.select("digest"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert {(r.digest, r.keep_id) for r in index.winners(fresh.select("digest")).collect()} == {(b"b", 2)}


def test_index_is_opened_by_a_later_session_and_compacted(spark, monkeypatch):
    index = exact.fresh_index(spark)
    rows = lambda *keys: spark.createDataFrame([(bytes([k]), k) for k in keys], "digest binary, keep_id long")
    index.add(rows(1, 2, 3))
    later = exact.DigestIndex(spark.newSession(), index.path)
    later.add(later.spark.createDataFrame([(bytes([k]), 10 * k) for k in (3, 4)], "digest binary, keep_id long"))
    assert {r.keep_id for r in later.read().collect()} == {1, 2, 3, 40}
    assert later.appends() == 2 or exact.LEAST_BUCKETS > 1
    monkeypatch.setattr(exact, "COMPACT_AFTER", 1)
    monkeypatch.setattr(exact, "BUCKET_ROWS", 2)
    monkeypatch.setattr(exact, "LEAST_BUCKETS", 1)
    third = exact.DigestIndex(spark, index.path)
    third.add(rows(5, 1))
    assert {r.keep_id for r in third.read().collect()} == {1, 2, 3, 40, 5}
    assert [g for g in third._generations()] == [(1, 2)] and third.appends() <= 2
    assert {(r.digest, r.keep_id) for r in third.winners(rows(4, 9).select("digest")).collect()} == {(b"\x04", 40)}
    third.drop()
    assert not exact.DigestIndex(spark, index.path).exists()


def test_internal_names_do_not_clash(spark):
    rows = [(1, "a b", "en", "s", "mine", "k"), (2, "A b", "en", "s", "mine", "k"), (3, "c d", "en", "s", "own", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __digest string, __key string")
    out = exact.drop_exact(df, exact.fresh_index(spark))
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == rows[1:]
    names = ["__mix", "__domain", "__lang", "__source", "__id", "__epoch"]
    mixed = mixing.mix_sources(df.toDF("doc_id", "text", "lang", "source", "__domain", "__mix").withColumns({n: F.lit(n) for n in names[2:]}), budget_ratio=1.0, max_epochs=1)
    assert mixed.columns[-1] == "__mix_" and {(r["__domain"], r["__mix"], r["__id"]) for r in mixed.collect()} == {("mine", "k", "__id"), ("own", "q", "__id")}


def test_budgets_are_met_to_the_word_and_shares_are_those_of_the_weights(spark, sf):
    """The shares are worked out anew from the words that come back, leaf by leaf, in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    have, took = {}, {}
    for r in rows:
        domain = "d" + str(int(hashlib.md5((r.source or "").encode()).hexdigest()[0], 16) % 4)
        key = (domain, r.lang or "", r.source or "")
        have[key] = have.get(key, 0) + len((r.text or "").split())
    for r in mixing.mix_sources(docs).collect():
        words = len((r.text or "").split())
        assert words == r["__mix"].n_tokens
        key = (r["__mix"].domain, r.lang or "", r.source or "")
        took[key] = took.get(key, 0) + words
    cap = {k: mixing.MAX_EPOCHS * n for k, n in have.items()}

    def deal(budget, prefix, weight):
        depth = len(prefix)
        names = sorted({k[depth] for k in have if k[:depth] == prefix})
        given = fill(budget, {n: (weight(depth, n), sum(c for k, c in cap.items() if k[: depth + 1] == (*prefix, n))) for n in names})
        for n in names:
            if depth == 2:
                want = given[n]
                assert want - 1.01 <= took.get((*prefix, n), 0) <= want + 0.01
            else:
                deal(given[n], (*prefix, n), weight)

    deal(sum(have.values()) * mixing.BUDGET_RATIO, (), lambda depth, n: mixing.LANG_WEIGHTS.get(n, 1.0) if depth == 1 else 1.0)


def test_drop_exact_keeps_one_row_of_each_text(spark):
    rows = [(1, "a", "k"), (2, "A", "k"), (None, "b", "k"), (None, "c", "k"), (None, "c", "k"), (7, "d", "k"), (7, "d", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    out = exact.drop_exact(df, exact.fresh_index(spark))
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "b"), (0, "c"), (2, "A"), (7, "d")]


def test_url_rules(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no-scheme/en/": ("", "", None, "allow"),
        "http://EXAMPLE.com/en/1": ("example.com", "/en/1", "example.com/en/", "block"), "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "https://m.www.example.com/en/x?y#z": ("m.www.example.com", "/en/x", "www.example.com/en/", "allow"), "http://xexample.com/en/": ("xexample.com", "/en/", "com/", "allow"),
        "http://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"), "http://a.net/de/1": ("a.net", "/de/1", None, "allow"), "http://a.com": ("a.com", "", None, "allow"),
        "http://Free-Bets.example.org/de/": ("free-bets.example.org", "/de/", None, "block"), "http://freebets.example.org/": ("freebets.example.org", "/", None, "allow"),
        "ftp://x.org/a/wp-admin": ("x.org", "/a/wp-admin", None, "block"), "http://x.org://y/p": ("x.org:", "//y/p", None, "allow"),
    }
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(cases)] + [(None, None, "x")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
    assert urls.filter_urls(df.where("false")).count() == 0
    assert urls.filter_urls(df, pattern_rules=()).where("verdict = 'block'").count() == 3


def test_rules_are_read_from_a_file(spark, tmp_path):
    (tmp_path / "rules").write_text("# blocked\n\ncat\t/cat(/|$)\tcat\nred-dog\tred-dog\tred dog\n")
    rules = urls.read_rules(spark, f"file://{tmp_path}/rules")
    assert rules == (urls.PatternRule("cat", "/cat(/|$)", ("cat",)), urls.PatternRule("red-dog", "red-dog", ("red", "dog")))
    df = spark.createDataFrame([(1, "http://a.org/cat"), (2, "http://a.org/cats"), (3, "http://a.org/RED-dog")], "page_id long, url string")
    assert {r.page_id: r.pattern for r in urls.filter_urls(df, pattern_rules=rules).collect()} == {1: "cat", 2: None, 3: "red-dog"}


def test_rules_are_filed_under_their_rarest_token():
    rules = (urls.PatternRule("r", "x", ("common", "rare")), urls.PatternRule("s", "y", ("b", "a")))
    index = urls.index_rules(rules, {"common": 9, "rare": 1})
    assert {k: [r.name for r in v] for k, v in index.items()} == {"rare": ["r"], "a": ["s"]}
    with pytest.raises(ValueError):
        urls.index_rules((urls.PatternRule("t", "z", ()),), {})
