"""The near-copy stage against brute force and planted near copies."""

import random

import numpy as np

import corpus_pipeline
from tracewright.llm import near_copies


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def survivors(texts):
    """Ids that are the least of their component, by comparing all pairs."""
    sets, least = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((least[a], least[b]))
                least = {d: low if x == high else x for d, x in least.items()}
    return {d for d, x in least.items() if d == x}


def test_near_dedup_takes_planted_near_copies(spark, sf):
    rng = random.Random(7)
    word = lambda: "w%d" % rng.randrange(10**6)
    texts, n = {}, 0
    for k in range(12):
        base = [word() for _ in range(200)]
        for edits in (0, 1, 2, 3, 4, 5, 8):  # an edit changes five shingles: four leave 0.81 of all, five 0.77
            copy = list(base)
            for at in range(edits):
                copy[20 + 22 * at] = word()
            texts[n := n + 1] = " ".join(copy)
    chain = [word() for _ in range(300)]
    for k in range(40):  # neighbours are near copies, the ends are not
        texts[n := n + 1] = " ".join(chain)
        chain[7 * k + 5] = word()
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.createDataFrame([(d, t, "en", "src0", len(t)) for d, t in texts.items()], schema)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    want = survivors(texts)
    assert got == want and len(want) < len(texts) / 2


def test_near_dedup_of_documents_is_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    empty = {d for d, t in texts.items() if not shingles(t)}
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert got - empty == survivors({d: t for d, t in texts.items() if d not in empty})


def test_rows_are_judged_by_id_and_text(spark, sf):
    """Ids that repeat or are missing lose no text that has no copy; internal names may be columns."""
    text = " ".join(f"a{k}" for k in range(60))
    near = text.replace("a30", "other")
    rows = [(3, text), (5, near), (5, "alone " * 3 + text[:40]), (None, near), (None, "nobody else has this text at all"), (7, "seven"), (7, "seven"), (8, None), (9, " \n"), (2, "")]
    schema = "doc_id long, text string, fp string, id int, text_key string, row int, kept string, `a.b` int"
    docs = spark.createDataFrame([(*r, "f", 1, "k", 2, "no", 3) for r in rows], schema)
    out = corpus_pipeline.near_dedup(spark, docs, sf)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=str)
    want = [(3, text), (5, rows[2][1]), (0, rows[4][1]), (7, "seven"), (2, "")]
    assert got == sorted(want, key=str)
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), sf).count() == 0
    classes = {(r.id, r.rows): r.component_id for r in near_copies.near_copies(docs.where("doc_id in (3, 7) or doc_id is null")).collect()}
    assert classes[(7, 2)] == 7 and classes[(3, 1)] == 3 and {classes[k] for k in classes if k[0] is None} <= {3, None}


def test_fingerprints_reach_a_similarity_of_four_fifths():
    """Of pairs at exactly 0.8 hardly one differs by more than the radius; unrelated ones differ by more."""
    rng = np.random.default_rng(3)
    for size in (5, 10, 45, 450):
        apart = []
        for _ in range(400):
            both = rng.integers(0, 1 << 63, size * 4 // 5, dtype=np.uint64)
            own = rng.integers(0, 1 << 63, size - len(both), dtype=np.uint64)
            split = int(rng.integers(0, len(own) + 1))
            a, b = (near_copies.wide_fingerprint(np.concatenate([both, x])) for x in (own[:split], own[split:]))
            apart.append(int(np.bitwise_count(a ^ b).sum()))
        assert np.mean(np.array(apart) <= near_copies.RADIUS) >= 0.995
    far = [near_copies.wide_fingerprint(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(200)]
    assert min(int(np.bitwise_count(x ^ y).sum()) for k, x in enumerate(far) for y in far[:k]) > near_copies.RADIUS


def test_tiles_and_blocks_lose_no_pair(spark, monkeypatch):
    """Small tiles and blocks give the components of one tile and one block."""
    rng = random.Random(5)
    texts, n = {}, 0
    for k in range(6):
        base = [f"g{k}w{j}" for j in range(80 + 20 * k)]
        for _ in range(25):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randrange(0, 6)):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts[n := n + 1] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = survivors(texts)
    for least, rows, most in ((2048, 512, 1 << 15), (7, 4, 1 << 15), (7, 512, 2)):
        monkeypatch.setattr(near_copies, "TILE_LEAST", least)
        monkeypatch.setattr(near_copies, "BLOCK_MOST", most)
        monkeypatch.setattr(near_copies, "BLOCK_ROWS", rows)
        assert {r.doc_id for r in near_copies.drop_near_copies(docs).collect()} == want


def test_shingle_sets():
    assert len(near_copies.shingle_set(b" \n")) == 0 and not near_copies.wide_fingerprint(near_copies.shingle_set(b"")).any()
    assert len(near_copies.shingle_set(b"A b c")) == 1 and len(near_copies.shingle_set(b"a b c d e f")) == 2
    assert (near_copies.shingle_set(b"A B C D E f") == near_copies.shingle_set(b"a b  c d e F")).all()
    assert len(near_copies.shingle_set(b"a b c d e a b c d e a")) == 5
