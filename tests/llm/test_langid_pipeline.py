import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from tracewright.llm import langid, pack
from tests.llm.test_pack import check
from tests.llm.test_near_copies import survivors


def test_held_out_accuracy(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = langid.op10_langid(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) >= 0.95
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def grams(text):
    """Hashed counts of 1- to 3-grams of letters, character by character."""
    line = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    codes = [32]
    for c in line[1:-1]:
        if c != " " or len(codes) == 1 or codes[-1] != 32 or not codes[1:]:
            codes.append(ord(c))
    codes.append(32)
    word, out = 1 << 32, Counter()
    for k, c in enumerate(codes):
        one = c * 0x9E3779B1 % word
        out[one >> 19] += 1
        if k + 1 < len(codes):
            two = ((one ^ 0x55555555) * 0x85EBCA6B + codes[k + 1] * 0xC2B2AE35) % word
            out[two >> 19] += 1
            if k + 2 < len(codes):
                out[((two ^ 0x33333333) * 0x27D4EB2F + codes[k + 2] * 0x165667B1) % word >> 19] += 1
    return out


def test_scores_are_those_of_centroids_worked_out_anew(spark, sf):
    """Weights, clusters, cosines and cut-offs in plain loops over the rows that may be learned from."""
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    learn = [r for r in docs if r.text and r.lang and zlib.crc32(str(r.doc_id).encode()) % 5 and any(c.isalpha() for c in r.text)]
    counts = [grams(r.text) for r in learn]
    seen = Counter(g for c in counts for g in c)
    idf = {g: np.log((1 + len(learn)) / (1 + seen[g])) + 1 for g in range(langid.DIMENSIONS)}

    def vector(c):
        v = np.zeros(langid.DIMENSIONS)
        for g, n in c.items():
            v[g] = np.log1p(n) * idf[g]
        return v / np.linalg.norm(v)

    centres, owner, least = [], [], {}
    for lang in sorted({r.lang for r in learn}):
        own = np.array([vector(c) for c, r in zip(counts, learn) if r.lang == lang])
        sizes = np.array([sum(c.values()).bit_length() for c, r in zip(counts, learn) if r.lang == lang])
        mean = own.mean(axis=0)
        order = sorted(range(len(own)), key=lambda k: -own[k] @ mean)
        found = [own[part].mean(axis=0) for part in np.array_split(order, min(langid.CENTROIDS, len(own)))]
        found = [c / np.linalg.norm(c) for c in found]
        for _ in range(langid.ROUNDS):
            member = [max(range(len(found)), key=lambda c: own[k] @ found[c]) for k in range(len(own))]
            groups = [[k for k in range(len(own)) if member[k] == c] for c in range(len(found))]
            found = [own[g].mean(axis=0) if g else c for g, c in zip(groups, found)]
            found = [c / np.linalg.norm(c) for c in found]
        member = [max(range(len(found)), key=lambda c: own[k] @ found[c]) for k in range(len(own))]
        cosines = np.array([own[k] @ found[member[k]] for k in range(len(own))])
        for at in range(20):
            apart = sorted(abs(sizes - at))
            reach = max(1, apart[min(langid.REJECT_ROWS, len(apart)) - 1])
            near = [c * langid.SHORTER ** max(0, n - at) for c, n in zip(cosines, sizes) if abs(n - at) <= reach]
            least[lang, at] = langid.REJECT_SHARE * np.quantile(near, langid.REJECT_QUANTILE)
        for c in sorted(set(member)):
            centres.append(found[c])
            owner.append(lang)
    got = {r.doc_id: r for r in langid.op10_langid(spark, sf).collect()}
    matrix = np.array(centres)
    for r in docs:
        if r.text and any(c.isalpha() for c in r.text):
            c = grams(r.text)
            cosines = matrix @ vector(c)
            best = int(cosines.argmax())
            assert got[r.doc_id].lang_pred == owner[best] and abs(got[r.doc_id].score - cosines[best]) < 1e-3
            assert got[r.doc_id].rejected == (cosines[best] < least[owner[best], sum(c.values()).bit_length()])


FOREIGN = {
    "hr": "dobar dan, kako ste danas, hvala lijepo, vidimo se sutra na glavnom trgu kada padne noć i kada se otvore vrata",
    "fi": "hyvää päivää, mitä kuuluu tänään, kiitos hyvää, nähdään huomenna torilla kun yö laskeutuu ja ovet avataan",
    "pl": "dzień dobry, jak się dziś pan czuje, dziękuję bardzo, widzimy się jutro na rynku kiedy zapadnie noc i otworzą drzwi",
    "hu": "jó napot kívánok, hogy van ma, köszönöm szépen, holnap találkozunk a főtéren amikor leszáll az éj és kinyílnak az ajtók",
    "tr": "iyi günler, bugün nasılsınız, çok teşekkür ederim, yarın meydanda görüşürüz gece çöktüğünde ve kapılar açıldığında",
    "ru": "добрый день, как вы сегодня, большое спасибо, увидимся завтра на площади, когда наступит ночь и откроются двери",
    "el": "καλημέρα, πώς είστε σήμερα, ευχαριστώ πολύ, θα τα πούμε αύριο στην πλατεία όταν πέσει η νύχτα",
    "junk": "asdf jkl; qwer uiop zxcv xkcd zzqj vbnm qqwx lkjh ptrw zzxq bnmv wqrt plkj hgfd sdfg xcvb rtyu",
    "code": "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQgZW5jb2RlZCB0ZXh0IHdpdGggbm8gd29yZHMgaW4gaXQgYXQgYWxsLCBub25l",
}


def test_rejection_takes_foreign_text_and_junk_and_leaves_the_corpus(spark, sf):
    """Planted texts of other languages and junk, short and long, are rejected; of the corpus less than 0.5 % is."""
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = langid.fit_centroids(docs)
    planted = [(n, text * times) for n, text in enumerate(FOREIGN.values()) for times in (1, 3, 30)]
    rejected = [r.rejected for r in langid.identify(spark.createDataFrame(planted, "doc_id long, text string"), model).collect()]
    assert sum(rejected) >= 0.9 * len(planted)
    own = langid.identify(docs.where("text is not null"), model)
    assert own.where("rejected").count() <= 0.005 * own.count()


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(130):  # far more labels than rows a label
        letters = [chr(0x4E00 + 7 * k + j) for j in range(6)]
        for j in range(6):
            rows.append((len(rows), " ".join("".join(rng.choice(letters, 4)) for _ in range(12)), f"l{k:03d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_centroids(docs, sample_rows=100)
    want = sorted({r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5})
    assert model.languages == want and len(want) > 100
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert sum(got[d] == lang for d, _, lang in rows) >= 0.9 * len(rows)


def test_defined_cases(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit_centroids(docs)
    assert model.languages == sorted({r.lang for r in docs.select("lang").distinct().collect()})
    rows = [(1, None), (2, ""), (3, "123 !? \n"), (4, "the " * 50000), (None, "the of and"), (4, "the"), (6, "Привет, как дела сегодня"), (7, "ĳ")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(df, model).collect()]
    assert [g[1:] for g in got[:3]] == [("und", True)] * 3 and got[3][1] == "en" and len(got) == 8
    assert got[6][1] in model.languages and got[6][2]
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and {r.text for r in kept.collect()} <= {r[1] for r in rows[3:6]} | {"ĳ"}
    assert langid.identify(df.where("false"), model).count() == 0
    empty = langid.fit_centroids(docs.where("false"))
    assert langid.identify(df, empty).where("lang_pred <> 'und'").count() == 0


def test_spherical_kmeans_finds_separate_groups():
    rng = np.random.default_rng(0)
    rows = langid._unit(np.vstack([np.eye(8)[k] + 0.05 * rng.random((20, 8)) for k in range(3)]))
    centres, member = langid.spherical_kmeans(rows, 3)
    assert len(centres) == 3 and [len(set(member[20 * k : 20 * k + 20])) for k in range(3)] == [1, 1, 1] and len(set(member)) == 3
    assert len(langid.spherical_kmeans(rows[:1], 4)[0]) == 1


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        stage(spark, got, sf).write.mode("overwrite").parquet(path)
        got = frames[name] = spark.read.parquet(path)
        assert name == "packing" or got.columns == docs.columns
    ids = {n: {r.doc_id: r.text for r in f.select("doc_id", "text").collect()} for n, f in frames.items() if n != "packing"}
    assert len(ids["language_id"]) >= 0.99 * docs.count()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    keep = {}
    for d, t in ids["language_id"].items():
        keep[low(t)] = max(d, keep.get(low(t), d))
    assert set(ids["exact_dedup"]) == set(keep.values())
    assert set(ids["near_dedup"]) == survivors(ids["exact_dedup"])
    words = {d: len((t or "").encode().split()) for d, t in ids["near_dedup"].items()}
    kept = sum(words[d] for d in ids["source_mix"])
    assert ids["source_mix"].items() <= ids["near_dedup"].items() and 0.88 <= kept / sum(words.values()) <= 1
    assert max(Counter(r.doc_id for r in frames["source_mix"].collect()).values()) == 1
    rows = frames["packing"].collect()
    check(rows, list(ids["source_mix"].items()))
    ran = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in ran if r.start == 0 and r.length == r.doc_tokens)[:1] and sum(r.length for r in ran) == sum(r.length for r in rows)


def test_stages_take_nulls_repeats_and_empty_tables(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "src0", 0), (None, "the of and", "en", None, 10), (3, "the cat and of the", "en", "src0", 18), (3, "the cat and of the", "en", "src0", 18)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name == "language_id":
                out.count()
                continue
            if name == "packing":
                assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
            elif name == "exact_dedup":
                docs = out.cache()
                assert docs.count() == (3 if data else 0)
            else:
                assert out.columns == docs.columns and out.count() <= docs.count()
    assert pack.WINDOW == 1024
