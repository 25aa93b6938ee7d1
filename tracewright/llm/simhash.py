"""Near-duplicate detection by SimHash with exact tiled comparison.

Fingerprints are first made distinct, so a group of copies is one row. Distinct fingerprints are laid out
in tiles keyed by the population counts of their four 16-bit quarters. Two fingerprints within ``radius``
bits have quarter counts that differ by at most ``radius`` in sum, so all other tile pairs are skipped;
the pairs left are compared in full with numpy exclusive-or and bit counts. A tile pair returns a spanning
forest of its links, never all of them, and components come from star rounds on the cluster.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import map_arrow, table
from tracewright.plans.components import connected_components
from tracewright.plans.storage import materialize

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints in a tile; the bound on what one comparison holds, not on what is compared.
TILE = 8192
#: Matrix cells compared at once inside a tile pair.
BLOCK = 1 << 21


def fingerprint(data: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of UTF-8 text over word shingles, as a signed 64-bit number; 0 if there are no words."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()
    if not words:
        return 0
    if len(words) < width:
        words = [b" ".join(words)]
        width = 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if width > 1 else words
    hashes = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """Rows ``(doc_id, fp)`` for every row of ``df``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(x.as_py() or b"", width) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], ["doc_id", "fp"])

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    return map_arrow(narrow, scan, "doc_id long, fp long")


def forest(src: np.ndarray, dst: np.ndarray, size: int) -> np.ndarray:
    """For nodes 0..size-1 joined by edges, the least node of each one's component."""
    label = np.arange(size)
    while len(src):
        low = np.minimum(label[src], label[dst])
        before = label.copy()
        np.minimum.at(label, label[src], low)
        np.minimum.at(label, label[dst], low)
        np.minimum.at(label, src, low)
        np.minimum.at(label, dst, low)
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
        if np.array_equal(label, before):
            break
    return label


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of ``a`` x ``b`` (or inside ``a``) that differ in 1..radius bits."""
    values = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    src, dst = np.empty(0, np.int64), np.empty(0, np.int64)
    step = max(1, BLOCK // max(1, len(b)))
    for k in range(0, len(a), step):
        near = np.bitwise_count((a[k : k + step, None] ^ b[None, :]).view(np.uint64)) <= radius
        i, j = np.nonzero(near)
        i += k
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            label = forest(np.concatenate([src, i]), np.concatenate([dst, j + shift]), len(values))
            src = np.nonzero(label != np.arange(len(values)))[0]
            dst = label[src]
    return values[src], values[dst]


def _offsets(radius: int) -> list[int]:
    """Cell steps to the quarter counts within ``radius``, one of each opposite pair, and 0."""
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    return [sum(x * 64**k for k, x in enumerate(d)) for d in steps]


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Rows ``(a, b)`` of fingerprints whose components are those of all pairs within ``radius`` bits.

    ``distinct`` has one row per value in ``fp``. Quarter counts have at most 17**4 = 83,521 combinations,
    which bounds the table of tile numbers that is broadcast.
    """
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    cell = sum(((q.cast("long") + 16) * 64**k for k, q in enumerate(quarter)), F.lit(0).cast("long"))
    keyed = distinct.select("fp", cell.alias("cell"))
    sizes = materialize(keyed.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "cells")
    dealt = keyed.join(F.broadcast(sizes), "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    tiles = materialize(dealt.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps")), "tiles")
    left = tiles.select(
        F.col("cell").alias("cell_a"), F.col("tile").alias("tile_a"), F.col("fps").alias("a"),
        F.explode(F.array(*[F.col("cell") + F.lit(o).cast("long") for o in _offsets(radius)])).alias("cell"),
    )
    left = left.join(F.broadcast(sizes), "cell").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    left = left.where("cell <> cell_a or tile >= tile_a").drop("tiles")
    pairs = left.join(tiles.withColumnRenamed("fps", "b"), ["cell", "tile"])
    pairs = pairs.select("a", "b", F.expr("cell = cell_a and tile = tile_a").alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                tile_links(np.asarray(a.values, np.int64), np.asarray(b.values, np.int64), s.as_py(), radius)
                for a, b, s in zip(batch.column(0), batch.column(1), batch.column(2))
            ]
            if found:
                arrays = [pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])

    return map_arrow(pairs, compare, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """Rows ``(doc_id, fingerprint, component_id)``, one per row of ``df``.

    Null and empty texts and texts without words share fingerprint zero and so a component. Repeated rows
    are repeated; ``component_id`` is the least non-null id of the component, null if it has none. An empty
    table gives no rows; only the two columns named are read.
    """
    marks = materialize(fingerprints(df, id_col, text_col, width), "fingerprints")
    distinct = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(link_fingerprints(distinct, radius), "a", "b")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = materialize(rooted.join(least, "root").select("fp", "component_id"), "classes")
    out = marks.join(classes, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
