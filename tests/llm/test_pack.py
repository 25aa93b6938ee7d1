import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewright.llm import pack

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
FAST = pack.WordTokenizer()


def ids_of(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcXYZ éß日ſ̀\n\t   '’s.!12३<|endoftext>")) | st.characters(codec="utf-8"), max_size=80))
def test_word_tokenizer_gives_the_ids_of_the_json_tokenizer(text):
    assert np.frombuffer(FAST(text), "<u4").tolist() == ids_of(text)


def test_word_tokenizer_on_awkward_texts():
    for text in ("", " ", "  a  b ", "a" * 5000, " " * 5000, "<|endoftext|> x", "a  b", "don't won't 'tis", "x " * 3000):
        assert np.frombuffer(FAST(text), "<u4").tolist() == ids_of(text)


def test_added_tokens_have_their_own_ids():
    """A literal added token is one id by the contract's call, alone, inside words and at the seams."""
    assert 50256 in ids_of("x <|endoftext|> y")
    for text in ("x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b c", "a <|endoftext|>", "<|endoftext|> <|endoftext|>", "< |endoftext|>", "<|endoftext|"):
        assert np.frombuffer(FAST(text), "<u4").tolist() == ids_of(text)


def test_differencing_deals_every_item_once_and_nearly_evenly():
    rng = random.Random(1)
    for windows in (1, 2, 7, 16):
        sizes = [rng.randrange(1, 129) for _ in range(windows * 12)]
        dealt = pack.karmarkar_karp(sizes, windows)
        assert sorted(i for _, items in dealt for i in items) == list(range(len(sizes)))
        sums = [s for s, _ in dealt]
        assert sums == [sum(sizes[i] for i in items) for _, items in dealt]
        assert len(dealt) == windows and max(sums) - min(sums) <= 16
    assert pack.karmarkar_karp([], 3) == []


def test_deal_raises_the_window_count_when_capacity_is_exceeded():
    pieces = [(("d", k), 0, 64) for k in range(17)]  # 17 pieces of 64 need more than one window of 1024
    windows = pack.deal(pieces, 1024, 1)
    assert len(windows) == 2 and all(sum(p[2] for p in w) <= 1024 for w in windows)


def check(rows, texts, window=1024):
    """rows: the result; texts: (doc_id, text) in order, ids unique."""
    ids = {d: ids_of(t or "") + [0] for d, t in texts}
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = np.asarray(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_length))
    for d, pieces in seen.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == len(ids[d])
    assert set(seen) == set(ids)
    padded = total = 0
    for pieces in sequences.values():
        at = 0
        for offset, length, whole in sorted(pieces):
            assert offset == at
            at += length
        assert at == whole <= window
        total += at
        padded += 0 if at & (at - 1) == 0 else window - at
    return padded / max(1, total)


def test_query_is_an_exact_cover_with_little_padding(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    padding = check(pack.op1_pack(spark, sf).collect(), docs)
    assert padding < 0.02


def test_nulls_empty_repeated_long_and_extra_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "word " * 4000, "x"), (None, "lost", "x"), (5, "same", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(2)
    out = pack.pack_documents(df, with_ids=True)
    found = out.collect()
    check(found, [(d, t) for d, t, _ in rows])
    by = {(r.doc_id, r.start): r.ids for r in found}
    assert by[(5, 0)] == [*ids_of("same"), 0][: len(by[(5, 0)])]
    twice = pack.pack_documents(df.where("doc_id = 5").union(df.where("doc_id = 5"))).collect()
    assert sum(r.length for r in twice) == 2 * (len(ids_of("same")) + 1)
    assert pack.pack_documents(df.where("false")).count() == 0
