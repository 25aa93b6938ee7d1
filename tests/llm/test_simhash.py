import itertools
import random

import numpy as np
from xxhash import xxh64_intdigest

from tracewright.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute_components(marks, radius=2):
    """{fp: set of fps} by all pairs."""
    root = {f: f for f in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= radius:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in root}


def check(rows, docs):
    marks = {d: brute_fingerprint(t) for d, t in docs}
    comp = brute_components(set(marks.values()))
    least = {}
    for d, f in marks.items():
        if d is not None:
            least[comp[f]] = min(d, least.get(comp[f], d))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == sorted((d, f"{f:016x}", least[comp[f]]) for d, f in marks.items())


def test_query_against_all_pairs(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(simhash.op4_simhash(spark, sf).collect(), docs)


def test_links_of_planted_neighbours_and_chains(spark):
    rng = random.Random(3)
    marks = {rng.getrandbits(64) for _ in range(300)}
    for seed in list(marks)[:40]:
        near = seed
        for _ in range(5):
            near ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            marks.add(near)
    marks |= {0, 1, 2**63, 2**64 - 1, 2**64 - 2}
    signed = [(m - (1 << 64) if m >> 63 else m,) for m in marks]
    for tile in (8192, 3):
        links = simhash.link_fingerprints(spark.createDataFrame(signed, "fp long"), tile=tile).collect()
        root = {m: m for m in marks}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in links:
            a, b = find(r.a % (1 << 64)), find(r.b % (1 << 64))
            root[max(a, b)] = min(a, b)
        want = brute_components(marks)
        assert {m: find(m) for m in marks} == want
        assert len(links) < 60 * len(marks)


def test_tile_links_return_a_forest_of_a_dense_group():
    rng = random.Random(5)
    base = rng.getrandbits(63)
    group = np.array(sorted({base ^ (1 << rng.randrange(60)) for _ in range(200)}), np.int64)
    a, b = simhash.tile_links(group, group, True, 2)
    assert len(a) == len(group) - 1 and set(a) | set(b) == set(group)


def test_nulls_blank_ties_and_empty_tables(spark):
    rows = [(4, None), (2, " \t\n"), (9, ""), (7, "One Two"), (3, "one two"), (8, "A b C d"), (5, "a B c D"), (6, "é b c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    check(simhash.near_duplicates(df).collect(), rows)
    found = simhash.near_duplicates(df.union(df.where("doc_id = 7"))).where("doc_id = 7").collect()
    assert len(found) == 2 and {r.component_id for r in found} == {3}
    alone = simhash.near_duplicates(spark.createDataFrame([(None, "x y z")], "doc_id long, text string")).collect()
    assert alone[0].component_id is None
    assert simhash.near_duplicates(df.where("false")).count() == 0
