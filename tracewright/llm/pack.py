"""Packing of token streams into fixed windows by Karmarkar-Karp multiway differencing.

Documents are tokenised and packed inside the partition that holds them, so nothing is shuffled and a lost
task is simply run again with the same result. Whole windows are cut off long documents; the tails gather
in batches of about ``batch_windows`` windows. A batch is dealt to its windows by multiway differencing:
partial partitions are merged two at a time, the fullest windows of one with the emptiest of the other. Whenever
a window exceeds its capacity the window count rises. What the last batch leaves over after its full windows,
less than a window, is laid out in windows of power-of-two length, which are full.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import map_arrow, table

WINDOW = 1024
BATCH_WINDOWS = 64
#: Share of a window that a batch aims to fill; the rest gives differencing room for its last imbalance.
TARGET_FILL = 0.99
#: Length to which tails are cut before they are dealt.
PIECE_LIMIT = 128
CACHED_WORDS, CACHED_CHARS = 150_000, 64
VOCABULARY = "byte_bpe_50k"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


class WordTokenizer:
    """Ids of whole texts, computed word by word with a bounded cache.

    The vocabulary splits a text before every single space between two non-space characters, so the ids of
    such words stand side by side unchanged. Texts with other white space at a seam go through whole. The
    ranked vocabulary file and the json one describe one tokenizer, but for the added tokens that the json
    one finds in a text: a text that holds one of them is handed to the json engine, as is one on which the
    ranked engine breaks (very long runs of one class).
    """

    _seam = re.compile(r"\s\s|\A\s|\s\Z")

    def __init__(self, vocabulary: str = VOCABULARY):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._json_path = public_tokenizers.path(f"{vocabulary}.json")
        with open(self._json_path, encoding="utf-8") as described:
            added = [token["content"] for token in json.load(described).get("added_tokens") or []]
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        self._json = None
        self._engine = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        try:
            ids = self._engine.encode_ordinary(text)
        except BaseException as error:  # the engine's panic has no class to import and is no Exception
            if type(error).__name__ != "PanicException":
                raise
            return self._by_json(text)
        return np.asarray(ids, dtype="<u4").tobytes()

    def _by_json(self, text: str) -> bytes:
        if self._json is None:
            from tokenizers import Tokenizer

            self._json = Tokenizer.from_file(self._json_path)
        return np.asarray(self._json.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self._added and self._added.search(text):
            return self._by_json(text)
        if self._seam.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        cache, parts = self._words, [self._whole(first)]
        for word in rest:
            ids = cache.get(word)
            if ids is None:
                ids = self._whole(" " + word)
                if len(word) <= CACHED_CHARS:
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    cache[word] = ids
            parts.append(ids)
        return b"".join(parts)


def karmarkar_karp(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """Deal items to ``windows`` windows with near-equal sums: ``(sum, item numbers)``, fullest first.

    Each heap entry is a partial partition, its windows sorted by sum (empty ones left out). The two with
    the widest spread are merged until one is left. Ties go by age, so the result is deterministic.
    """
    if not sizes:
        return []
    age = itertools.count()
    heap: list = [(-size, next(age), [(size, (i,))]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        shared = max(0, len(a) + len(b) - windows)
        split_a, split_b = len(a) - shared, len(b) - shared
        merged = a[:split_a] + b[:split_b]
        merged += [(x + y, (s, t)) for (x, s), (y, t) in zip(a[split_a:], reversed(b[split_b:]))]
        merged.sort(key=lambda window: -window[0])
        emptiest = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (emptiest - merged[0][0], next(age), merged))
    return [(total, sorted(_items(tree))) for total, tree in heap[0][2]]


def _items(tree: tuple) -> Iterator[int]:
    stack = [tree]
    while stack:
        node = stack.pop()
        for part in node:
            if isinstance(part, tuple):
                stack.append(part)
            else:
                yield part


def _cut(pieces: list[tuple], limit: int) -> list[tuple]:
    """Pieces are (document, start, length)."""
    return [(d, s + k, min(limit, n - k)) for d, s, n in pieces for k in range(0, n, limit)]


def deal(pieces: list[tuple], window: int = WINDOW, windows: int | None = None) -> list[list[tuple]]:
    """Pack pieces ``(document, start, length)`` into windows, one more whenever one exceeds its capacity."""
    fine = _cut(pieces, max(1, PIECE_LIMIT * window // WINDOW))
    count = max(1, windows or -(-sum(p[2] for p in fine) // window))
    while True:
        dealt = karmarkar_karp([p[2] for p in fine], count)
        if not dealt or dealt[0][0] <= window:
            return [_joined([fine[i] for i in items]) for _, items in dealt]
        count += 1


def _joined(pieces: list[tuple]) -> list[tuple]:
    """Pieces of one window that follow each other in their document become one piece."""
    out: list[tuple] = []
    for d, s, n in pieces:
        if out and out[-1][0] is d and out[-1][1] + out[-1][2] == s:
            out[-1] = (d, out[-1][1], out[-1][2] + n)
        else:
            out.append((d, s, n))
    return out


def _head(pieces: list[tuple], tokens: int) -> tuple[list[tuple], list[tuple]]:
    """The first ``tokens`` tokens of the pieces, and the rest."""
    head, rest = [], []
    for d, s, n in pieces:
        take = min(n, tokens)
        tokens -= take
        if take:
            head.append((d, s, take))
        if n > take:
            rest.append((d, s + take, n - take))
    return head, rest


def windows_of(documents: Iterator[tuple[int, bytes]], window: int, batch_windows: int) -> Iterator[list[tuple]]:
    """Windows of pieces ((doc_id, ids, doc_tokens), start, length), from (doc_id, ids) one after another."""
    aim = max(1, int(window * TARGET_FILL))
    waiting: list[tuple] = []
    tokens = 0
    for doc_id, ids in documents:
        n = len(ids) // 4
        doc, full = (doc_id, ids, n), n // window * window
        for s in range(0, full, window):
            yield [(doc, s, window)]
        if n > full:
            waiting.append((doc, full, n - full))
            tokens += n - full
        while tokens >= batch_windows * aim:
            batch, waiting = _head(waiting, batch_windows * aim)
            tokens -= batch_windows * aim
            yield from deal(batch, window, batch_windows)
    count = tokens // aim
    batch, rest = _head(waiting, count * aim)
    if count:
        yield from deal(batch, window, count)
    left = tokens - count * aim
    while left:
        size = 1 << (left.bit_length() - 1)
        last, rest = _head(rest, size)
        yield last
        left -= size


def pack_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    batch_windows: int = BATCH_WINDOWS,
    vocabulary: str = VOCABULARY,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's token ids.

    A null or empty text is one closing id. Null ids and repeated rows are packed like others, row by row;
    an empty table gives no rows; other columns are not read. ``sequence_id`` holds the partition number in
    its upper bits.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = WordTokenizer(vocabulary), np.asarray([end_id], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() << 33

        def documents() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield doc_id, encode(text.as_py() or "") + end

        rows: list[tuple] = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"]
        types = [pa.int64()] * 8

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * (8 + with_ids)
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in columns[8]], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

        for number, pieces in enumerate(windows_of(documents(), window, batch_windows)):
            offset, length = 0, sum(p[2] for p in pieces)
            for (doc_id, ids, n), start, size in pieces:
                part = ids[4 * start : 4 * (start + size)]
                rows.append((doc_id, start, size, zlib.crc32(part), n, base + number, offset, length) + ((part,) if with_ids else ()))
                offset += size
            if len(rows) >= 5000:
                yield flush()
        if rows:
            yield flush()

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(narrow, pack, SCHEMA + ", ids array<int>" * with_ids)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
