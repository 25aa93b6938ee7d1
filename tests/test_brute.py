"""Operators without a SQL form against plain Python over whole tables or random graphs."""

import hashlib
import itertools
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_kernels import naive_support, random_rules, rule_frames
from tracewright.catalogue import QUERIES
from tracewright.functions import policy as P
from tracewright.functions import scalars as S
from tracewright.operators import candidates as C
from tracewright.operators import clusters as K
from tracewright.operators import resolve as R
from tracewright.operators import text as X
from tracewright.plans import fixpoint as fix
from tracewright.plans.storage import materialize
from tracewright.sources import documents as D


def test_maintained_counts_are_those_of_the_new_snapshot(spark):
    rng = random.Random(11)
    for n in (7, 12):
        rules, base = random_rules(rng, n), set(rng.sample(range(n), 3))
        b, body = rule_frames(spark, base, rules)
        held = fix.support_counts(b, body, fix.well_founded_support(b, body))
        rules2, base2 = rules[: n - 3] + random_rules(rng, n)[:3], set(list(base)[1:]) | {rng.randrange(n)}
        nb, nbody = rule_frames(spark, base2, rules2)
        want = naive_support(base2, rules2)
        fired = {(h, x) for h, x in rules2 if x <= want}
        got = {r.node: r.support_count for r in fix.maintain_support(held, b, body, nb, nbody).collect()}
        assert got == {x: (x in base2) + sum(h == x for h, _ in fired) for x in want}


def test_rules_of_one_body_have_the_last_ones_strength(spark):
    base = spark.createDataFrame([(1, 0.9)], "node long, confidence double")
    body = spark.createDataFrame([(10, 2, 1, 0.8), (11, 2, 1, 0.3)], "rule long, head long, atom long, strength double")
    held = fix.well_founded_support(base, body)
    assert {r.node: r.value for r in fix.valuate(base, body, held).collect()} == {1: 0.9, 2: 0.3}


def test_deep_closure_is_compacted(spark):
    edges = [(k, k + 1) for k in range(21)] + [(k, k + 2) for k in range(0, 20, 3)]
    got = {(r.part, r.whole): r.depth for r in fix.closure(spark.createDataFrame(edges, "part long, whole long")).collect()}
    want = {}
    for a in range(22):
        reach, depth = {a}, 0
        while reach:
            depth, reach = depth + 1, {w for p, w in edges if p in reach}
            for w in reach:
                want.setdefault((a, w), depth)
    assert got == want


def test_nearest_nodes_with_several_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k % 23), f"m{k % 2}", [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(90)] + [(99, "m0", [0.0] * 4)]
    df = spark.createDataFrame(rows, "node long, model string, vector array<double>")
    queries = df.where("node < 6")

    def cosine(x, y):
        n = np.linalg.norm(x) * np.linalg.norm(y)
        return round(float(np.dot(x, y) / n), 12) if n else 0.0

    exact, pushed = {}, {}
    for h, m, v in rows:
        if h < 6:
            near = sorted((-cosine(v, w), e) for e, mm, w in rows if mm == m and e != h)
            for s, e in near[:5]:
                pushed[h, e] = max(-s, pushed.get((h, e), -2))
            for s, e in near:
                exact[h, e] = max(-s, exact.get((h, e), -2))
    cut = {h: sorted((-s, e) for (hh, e), s in exact.items() if hh == h)[:5] for h in range(6)}
    got = {}
    for r in C.knn_candidates(queries, df, 5).collect():
        got.setdefault(r.hypothesis, []).append((r["rank"], -r.similarity, r.evidence))
    assert {h: [(pytest.approx(s), e) for _, s, e in sorted(x)] for h, x in got.items()} == cut
    found = {(r.hypothesis, r.evidence): r.similarity for r in C.knn_pushdown(queries, df, 5).collect()}
    assert found == pytest.approx(pushed) and found.keys() != {(h, e) for h, x in cut.items() for _, e in x}


def test_blocks_do_not_change_what_is_nearest(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, "m", [float(x) for x in rng.normal(size=6)]) for k in range(120)], "node long, model string, vector array<double>")
    show = lambda: sorted(map(tuple, C.knn_candidates(df.where("node % 10 = 0"), df, 7).collect()))
    whole = show()
    monkeypatch.setattr(C, "QUERY_BLOCK", 3)
    monkeypatch.setattr(C, "ROW_BLOCK", 11)
    assert show() == whole


def best_split(vectors, densities, valleys, level):
    """All segmentations at the cut points, best total first."""
    n = len(vectors)
    marks = sorted({0, n, *(v for v in valleys if 0 < v < n)})
    points = sorted({p for a, b in zip(marks, marks[1:]) for p in range(a, b, level.max_len)} | {n})
    unit = [v / np.linalg.norm(v) if np.linalg.norm(v) else v for v in vectors]
    best = None
    for size in range(len(points) - 1):
        for inner in itertools.combinations(points[1:-1], size):
            edges = [0, *inner, n]
            if all(b - a <= level.max_len for a, b in zip(edges, edges[1:])):
                total = sum(
                    np.linalg.norm(sum(unit[a:b])) + level.density_weight * sum(densities[a:b]) - level.penalty * (b - a) ** level.exponent for a, b in zip(edges, edges[1:])
                )
                if best is None or total > best + 1e-12:
                    best = total
    return best


def test_segments_are_the_best_of_all():
    rng = np.random.default_rng(8)
    for case in range(60):
        n = int(rng.integers(1, 13))
        vectors, densities = rng.normal(size=(n, 3)), rng.random(n)
        vectors[rng.random(n) < 0.2] = 0
        valleys = [int(v) for v in rng.integers(0, n + 1, 4)]
        level = X.Level(0, int(rng.integers(2, 8)), 0.5, float(rng.choice([0.1, 0.5, 1.0])), float(rng.choice([1.0, 1.3])))
        got = X.segment(vectors, densities, valleys, level)
        assert [a for a, _ in got] == [0, *(b for _, b in got[:-1])] and got[-1][1] == n and all(0 < b - a <= level.max_len for a, b in got)
        unit = [v / np.linalg.norm(v) if np.linalg.norm(v) else v for v in vectors]
        total = sum(np.linalg.norm(sum(unit[a:b])) + 0.5 * sum(densities[a:b]) - level.penalty * (b - a) ** level.exponent for a, b in got)
        assert total == pytest.approx(best_split(vectors, densities, valleys, level))


def test_levels_have_their_fixed_values():
    assert X.level_policy() == [X.Level(0, 50, 0.5, 0.1), X.Level(1, 200, 0.5, 0.02)]


def test_permutations_from_digest_words():
    """Worked out from the definition: 32-bit words of SHA-256 of the key, then of key|1, key|2, ..."""
    for key, n in (("q1", 0), ("q1", 1), ("q1", 2), ("q1", 9), ("other", 9), ("long", 40)):
        digest = b"".join(hashlib.sha256((key if not k else f"{key}|{k}").encode()).digest() for k in range(6))
        want = list(range(n))
        for turn, i in enumerate(range(n - 1, 0, -1)):
            j = int.from_bytes(digest[4 * turn : 4 * turn + 4], "big")
            want[i], want[j % (i + 1)] = want[j % (i + 1)], want[i]
        assert K.content_permutation(key, n) == want
        assert [K.content_permutation(key, n)[p] for p in K.inverse_permutation(K.content_permutation(key, n))] == list(range(n))


def test_permuted_panel(spark, sf):
    groups = {}
    for r in QUERIES["permuted_panel"](spark, sf).collect():
        groups.setdefault(r.label, []).append((r.vec_id, r.place))
    for label, rows in groups.items():
        order = K.content_permutation(str(label), len(rows))
        ids = sorted(v for v, _ in rows)
        assert [v for v, _ in sorted(rows, key=lambda r: r[1])] == [ids[i] for i in order]


def test_span_ids_are_in_the_namespace_of_their_document(spark):
    document = uuid.uuid5(uuid.NAMESPACE_URL, "document:7")
    df = spark.range(1).select(D.span_id(F.lit(str(document)), F.lit(3), F.lit(9), F.lit(1)).alias("id"), D.document_uuid(F.lit(7)).alias("d"))
    assert tuple(df.first()) == (str(uuid.uuid5(document, "3:9:1")), str(document))


def clusters(vectors, threshold):
    openers, out = [], []
    for v in vectors:
        hit = next((k for k, o in enumerate(openers) if np.dot(o, v) / (np.linalg.norm(o) * np.linalg.norm(v) or 1) >= threshold), None)
        out.append(len(openers) if hit is None else hit)
        if hit is None:
            openers.append(v)
    return out


@pytest.fixture(scope="module")
def samples(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    return sorted(rows, key=lambda r: (r.vec_id % 5, r.vec_id))


def test_leader_clusters_in_sample_order(spark, sf, samples):
    want = {}
    for label in {r.label for r in samples}:
        mine = [r for r in samples if r.label == label]
        for r, c in zip(mine, clusters([r.embedding for r in mine], 0.6)):
            n, first = want.get((label, c), (0, r.vec_id))
            want[label, c] = n + 1, min(first, r.vec_id)
    assert {(r.label, r.cluster): (r.members, r["first"]) for r in QUERIES["leader_clusters"](spark, sf).collect()} == want


def test_claim_keys_by_model(spark, sf, samples):
    want = {}
    for m in (0, 1):
        mine = sorted((r for r in samples if r.label % 2 == m), key=lambda r: r.vec_id)
        mine = [r for r in mine for _ in range(2 if r.vec_id % 100 == 0 else 1)]
        want |= {r.vec_id: f"m{m}#{c}" for r, c in zip(mine, clusters([r.embedding for r in mine], 0.6))}
    assert {r.proposition: r.claim for r in QUERIES["claim_keys"](spark, sf).collect()} == want


def test_consolidated_samples(spark, sf, samples):
    cos = lambda x, y: float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y) or 1))
    canon = {}
    for label, odd in itertools.product({r.label for r in samples}, (0, 1)):
        mine = [r for r in samples if r.label == label and r.vec_id % 2 == odd]
        got = clusters([r.embedding for r in mine], 0.5)
        for c in set(got):
            members = [r for r, g in zip(mine, got) if g == c]
            mean = lambda r: round(sum(cos(r.embedding, o.embedding) for o in members if o is not r) / max(1, len(members) - 1), 9)
            best = min(members, key=lambda r: (-mean(r), r.vec_id % 5, r.vec_id))
            canon[label, "negated" if odd else "affirmed", c] = best, min(1.0, len({r.vec_id % 5 for r in members}) / 5)
    want = {}
    for (label, pol, c), (best, share) in canon.items():
        twin = any(label2 == label and pol2 != pol and cos(best.embedding, other.embedding) >= 0.5 for (label2, pol2, _), (other, _) in canon.items())
        want[label, pol, c] = best.vec_id, round(share, 6), twin
    assert {(r.label, r.polarity, r.cluster): (r.position, r.agreement, r.twin) for r in QUERIES["consolidated_samples"](spark, sf).collect()} == want


def test_sentences_of_all_documents(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        found = [m for m in re.finditer(r"[^.!?\n]+(?:[.!?]+(?=\s|$)|$)", r.text or "") if m.group().strip()]
        if found:
            want[r.doc_id] = len(found), sum(len(m.group().strip()) for m in found), max(m.end() for m in found)
    assert {r.doc_id: (r.sentences, r.chars, r.last_end) for r in QUERIES["sentence_split"](spark, sf).collect()} == want


def test_guided_extraction_of_all_turns(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    want = sorted((r.conv_id, r.turn, bool(f"extract:\n{r.text}".rstrip().rsplit("\n", 1)[-1].strip()), True) for r in rows if r.text is not None)
    got = sorted((r.conv_id, r.turn, bool(r["items"]), r.ok) for r in QUERIES["guided_extraction"](spark, sf).where("items is not null").collect())
    assert got == want


def test_settling_of_all_cycles(spark, sf):
    """Synchronous sweeps in plain Python over the customers' cycles, with the variance of the last sixteen."""
    orders = {}
    for r in spark.read.parquet(f"{sf}/orders.parquet").collect():
        orders.setdefault(r.o_custkey, []).append((r.o_orderdate, r.o_orderkey))
    edges = {}
    for rows in orders.values():
        keys = [k for _, k in sorted(rows)]
        for a, b in zip(keys, [*keys[1:], keys[0]]):
            if a != b:
                edges.setdefault(b, []).append((a, a % 2 == 0))
    sigma = {k: 0.5 for rows in orders.values() for _, k in rows}
    trail = [dict(sigma)]
    for _ in range(64):
        nxt = {}
        for arg in sigma:
            up, down = 1.0, 1.0
            for src, supports in edges.get(arg, ()):
                up, down = (up * (1 - 0.5 * sigma[src]), down) if supports else (up, down * (1 - 0.5 * sigma[src]))
            s, a = 1 - up, 1 - down
            nxt[arg] = 0.5 + 0.5 * (s - a)
        moved = max(abs(nxt[k] - sigma[k]) for k in sigma)
        sigma = nxt
        trail.append(dict(sigma))
        if moved <= 1e-9:
            break
    got = {r.arg: r for r in QUERIES["qbaf_settled"](spark, sf).collect()}
    assert got.keys() == sigma.keys()
    for k, r in got.items():
        tail = [t[k] for t in trail[-16:]]
        assert abs(r.sigma - sigma[k]) < 2e-6 and abs(r.variance - np.var(tail)) < 2e-9 and r.oscillating == (np.var(tail) > 1e-6)


def test_range_pairs_of_long_documents(spark):
    rng = random.Random(2)
    spans = [(d, k, a, a + rng.randrange(0, 9000)) for d in (1, 2) for k in range(25) for a in [rng.randrange(40_000)]]
    cells = [(d, k, a, a + rng.randrange(0, 9000)) for d in (1, 2) for k in range(25) for a in [rng.randrange(40_000)]]
    left, right = spark.createDataFrame(spans, "doc int, span int, s_start int, s_end int"), spark.createDataFrame(cells, "doc int, position int, start int, end int")
    want = {(d, s): sorted(k for e, k, x, y in cells if e == d and max(a, x) < min(b, y)) for d, s, a, b in spans}
    assert {(r.doc, r.span): r.elements for r in X.layout_overlap(left, right).collect()} == {k: v for k, v in want.items() if v}
    windows = right.select("doc", F.col("position").alias("window"), F.col("start").alias("w_start"), F.col("end").alias("w_end"))
    best = {}
    for d, s, a, b in spans:
        near = [(min(a - x, y - b), -k) for e, k, x, y in cells if e == d and x < b and y > a]
        if near:
            best[d, s] = -max(near)[1]
    assert {(r.doc, r.span): r.window for r in X.best_window(left, windows).collect()} == best
    tokens = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 0, 1, 0, 4), (1, 1, 0, 3, 9), (1, 1, 1, 0, 0)], "doc int, window int, token int, start int, end int")
    span = spark.createDataFrame([(1, 0, 0, 3)], "doc int, span int, s_start int, s_end int")
    assert [tuple(r) for r in X.overlapping_tokens(span, tokens).collect()] == [(1, 0, 0, 1)]
    both = spark.createDataFrame([(1, 0, 0, 4), (1, 1, -9, 99)], "doc int, window int, w_start int, w_end int")
    assert X.best_window(span, both).first().window == 1 and X.best_window(span, both, tokens).first().window == 0


def test_faults_of_parsed_structure(spark):
    rows = [(1, 0, "paragraph", "x", None, None, None, None, None, False), (1, 1, "paragraph", "", None, None, None, None, None, False), (1, 2, "paragraph", "x", 1, None, None, None, None, False),
            (1, 3, "paragraph", "x", 1, [0.0], None, [1.0], "pt", False), (1, 4, "paragraph", "x", 1, [0.0], "top-left", [1.0], "pt", True), (1, 5, "table", "x", None, None, None, None, None, True)]
    df = spark.createDataFrame(rows, "doc int, position int, kind string, text string, page int, bbox array<double>, origin string, page_size array<double>, unit string, has_table boolean")
    assert {r.position: r.fault for r in X.check_elements(df).collect()} == {1: "empty", 2: "half_region", 3: "no_frame", 4: "table_outside_table"}
    cells = [(0, 0, 0, 0, 3, 1, 1, 5, None, False), (0, 0, 1, 3, 3, 1, 1, 5, None, False), (0, 0, 2, 3, 6, 1, 1, 5, None, False), (0, 0, 3, 3, 5, 0, 1, 5, None, False), (0, 0, 4, 3, 5, 1, 1, 5, [0.0], False)]
    df = spark.createDataFrame(cells, "table int, row int, col int, start int, end int, row_span int, col_span int, n_chars int, bbox array<double>, has_region boolean")
    assert {r.col: r.fault for r in X.check_cell_texts(df).collect()} == {1: "reversed", 2: "beyond_text", 3: "no_span", 4: "no_region"}


def test_stored_marks_and_their_reading(spark):
    df = spark.createDataFrame([(None, None), (0.9, '["a"]'), (None, '["a"]'), (0.2, "[]")], "score double, stored string")
    reasons = S.decode_reasons(F.col("stored"))
    got = [(r.flag, r.n) for r in df.select(S.legacy_provisional(F.col("score"), reasons).alias("flag"), F.size(reasons).alias("n")).collect()]
    assert got == [(None, 0), (True, 1), (True, 1), (False, 0)]
    row = spark.range(1).select(
        S.flatten_sensitivity(F.lit(None).cast("string"), F.array(F.lit("b"), F.lit("a"))).alias("flat"), S.read_sensitivity(F.lit("secret"), F.lit("")).alias("read"),
        S.flatten_interest(F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("array<string>")).alias("unknown"), S.flatten_interest(F.lit(True), F.lit("seller"), F.lit(None).cast("array<string>")).alias("known"),
    ).first()
    assert tuple(row.flat) == ("public", '["a","b"]') and tuple(row["read"]) == ("secret", []) and row.unknown is None and tuple(row.known) == ("seller", [])


def test_oscillation_and_settling(spark):
    rows = [(n, "a", 0.5) for n in range(30)] + [(n, "b", n % 2 * 1.0 if n < 10 else 0.3) for n in range(30)] + [(n, "c", n % 2 * 1.0) for n in range(30)]
    df = spark.createDataFrame(rows, "sweep int, arg string, sigma double")
    tail = df.where("sweep >= 14")
    assert tuple(fix.oscillation_summary(tail).first()) == (pytest.approx(0.25), 1, True) and [r.arg for r in fix.oscillating_arguments(tail).collect()] == ["c"]
    quiet = df.where("arg <> 'c'")
    assert fix.settle_cap(quiet, window=4).first()[0] == 13  # sweeps 10 to 12 still look back on 9


def test_values_settle_though_products_are_rounded_by_the_order_of_rows(spark):
    noisy = P.Semiring("noisy", F.product, lambda a, b: a * b * (1 + F.rand() * 1e-15))
    base = spark.createDataFrame([(0, 0.7), (1, 0.9)], "node long, confidence double")
    body = spark.createDataFrame([(h, h, a, 0.9) for h in range(2, 8) for a in (h - 1, h - 2)], "rule long, head long, atom long, strength double")
    want = [0.7, 0.9]
    for h in range(2, 8):
        want.append(want[h - 1] * want[h - 2] * 0.9)
    held = fix.well_founded_support(base, body)
    for semiring in (noisy, P.VITERBI):
        got = {r.node: r.value for r in fix.valuate(base, body, held, semiring, max_rounds=20).collect()}
        assert got == pytest.approx(dict(enumerate(want)), rel=1e-11)


def resolved_by_hand(ents, contexts, roles):
    out = {}
    for (a, ea), (b, eb) in itertools.combinations(sorted(ents.items()), 2):
        if ea[:2] != eb[:2] or not set(ea[2].split()) & set(eb[2].split()):
            continue
        kind = 0 if ea[3] is None or eb[3] is None else 1 if ea[3] == eb[3] else -1
        count = len(contexts[a] & contexts[b]) + 0.5 * bool(roles[a] & roles[b])
        score = min(1.0, max(0.0, 0.5 * (ea[2] == eb[2]) + 0.25 * kind + 0.35 * (1 - 0.5**count)))
        if score >= 0.5:
            out[a, b] = (score, "confirmed" if score >= 0.85 else "candidate")
    return out


def entity_frames(spark, seed, n=70):
    rng = random.Random(seed)
    ents = {i: (rng.choice("xy"), "k", rng.choice(["red pump", "red bolt", "big pump", "old ring"]), rng.choice(["s", "t", None])) for i in range(n)}
    ents |= {n: ("x", "k", "one valve", None), n + 1: ("x", "k", "one valve", "s"), n + 2: ("x", "k", "", "s"), n + 3: ("x", "k", "", "s")}
    contexts = {i: set(rng.sample(range(12), rng.choice((0, 0, 1, 2, 5)))) for i in ents} | {n: set(range(100, 170)), n + 1: set(range(100, 170))}
    roles = {i: set(rng.sample("AB", rng.choice((0, 0, 1, 2)))) for i in ents}
    rows = [(i, b, k, norm, t, norm.split()) for i, (b, k, norm, t) in ents.items()]
    frame = spark.createDataFrame(rows, "id long, box string, kind string, norm string, type string, tokens array<string>")
    ctx = spark.createDataFrame([(i, c) for i, cs in contexts.items() for c in cs] * 2, "id long, context long")
    return resolved_by_hand(ents, contexts, roles), frame, ctx, spark.createDataFrame([(i, r) for i, rs in roles.items() for r in rs], "id long, role string")


def test_resolution_makes_no_pairs_that_are_no_result(spark, monkeypatch):
    """Every pair of all entities; what is written on the way is in proportion to entities, marks and results."""
    written = []
    monkeypatch.setattr(R, "materialize", lambda df, label: written.append(materialize(df, label)) or written[-1])
    for seed in (1, 2):
        want, ents, contexts, roles = entity_frames(spark, seed)
        got = {(r.a, r.b): (round(r.score, 9), r.state) for r in R.resolve(ents, contexts, roles).collect()}
        assert got == {k: (round(s, 9), state) for k, (s, state) in want.items()}
    sizes = [df.count() for df in written]
    # 200 entities of one type and pairwise different labels with a word in common: 19,900 blocked pairs, no result.
    many = spark.createDataFrame([(i, "x", "k", f"pump {i}", "s", ["pump", str(i)]) for i in range(200)], "id long, box string, kind string, norm string, type string, tokens array<string>")
    written.clear()
    assert R.resolve(many, contexts.where("id < 0"), roles).isEmpty() and max(df.count() for df in written) <= 200 and sizes


def test_confirmed_links_join_what_confirmed_pairs_join(spark):
    for seed in (3, 4, 5):
        want, ents, contexts, roles = entity_frames(spark, seed)
        firm = spark.createDataFrame([(a, b, state) for (a, b), (_, state) in want.items()], "a long, b long, state string")
        links = R.confirmed_links(ents, contexts, roles)
        assert {(r.a, r.b) for r in links.collect()} <= {k for k, (_, state) in want.items() if state == "confirmed"}
        assert sorted(map(tuple, R.canonical_components(links).collect())) == sorted(map(tuple, R.canonical_components(firm).collect()))
        for some in (None, roles.where("false")):
            bare = R.resolve(ents, contexts, some)
            assert sorted(map(tuple, R.canonical_components(R.confirmed_links(ents, contexts, some)).collect())) == sorted(map(tuple, R.canonical_components(bare).collect()))


def test_links_are_fewer_than_confirmed_pairs(spark):
    """40 entities of one label, type and role are 780 pairs and 39 links."""
    ents = spark.createDataFrame([(i, "x", "k", "pump", "s", ["pump"]) for i in range(40)], "id long, box string, kind string, norm string, type string, tokens array<string>")
    roles, contexts = ents.selectExpr("id", "'A' AS role"), ents.selectExpr("id", "id AS context")
    assert R.resolve(ents, contexts, roles).count() == 780 and R.confirmed_links(ents, contexts, roles).count() == 39
