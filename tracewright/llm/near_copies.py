"""Near copies: wide SimHash candidates from tiled comparison, each link confirmed by exact Jaccard similarity.

A text is the set of its five-word shingles, as 64-bit hashes; texts with equal sets are one row from the
scan on. Its SimHash has ``64 * WORDS`` bits, as 64 are too few to tell a similarity of 0.8 from one of 0.6:
at 0.8 two fingerprints differ by 38 bits of 256 on the average (48 for sets of a few shingles) with a
deviation of 6, and ``RADIUS`` lies four deviations beyond. Tiles hold sets of like size, and tile pairs are
skipped where the sizes rule out the similarity or the population counts differ beyond the radius; all others
are compared whole with exclusive-or and bit counts. They return spanning forests, whose components are the
candidates' groups. Only the texts of such groups are read again: inside a group, in blocks where it is
large, every pair within the radius that is not linked yet is compared by the sets themselves.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import map_arrow
from tracewright.llm.simhash import forest
from tracewright.plans.components import connected_components
from tracewright.plans.storage import discard, materialize

SHINGLE, SEED = 5, 42
#: Least similarity of a link, as a fraction of whole numbers.
PARTS, WHOLE = 4, 5
#: 64-bit words of a fingerprint, and the differing bits within which two texts are compared by their sets.
WORDS, RADIUS = 4, 72
#: A size cell spans a little more than the sizes that may be linked, so links stay in a cell or reach the next.
CELL = 1.2501
#: Rows in a comparison tile: a 64th of all, within these bounds of what a task holds.
TILE_SHARE, TILE_LEAST, TILE_MOST = 64, 2048, 1 << 17
#: A group is split into blocks of so many rows, up to so many blocks; beyond these a block has at most so many rows and shingles.
BLOCK_ROWS, BLOCK_SPLIT, BLOCK_MOST, BLOCK_SHINGLES = 512, 8, 1 << 15, 1 << 22
CACHED_WORDS = 200_000
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, max(SHINGLE, WORDS)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT, _SPREAD = np.uint64(32), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of the numbers over all 64."""
    for _ in range(2):
        h = (h ^ (h >> _SHIFT)) * _SPREAD
    return h ^ (h >> _SHIFT)


class Shingler:
    """Sets of word shingles, with a bounded cache of the words' hashes."""

    def __init__(self, width: int = SHINGLE):
        self.width, self._seen = width, {}

    def __call__(self, data: bytes) -> np.ndarray:
        """Sorted distinct hashes of the shingles of UTF-8 text; fewer words than the width are one shingle."""
        from xxhash import xxh64_intdigest

        words, seen = data.lower().split(), self._seen
        if not words:
            return np.empty(0, np.uint64)
        hashes = np.empty(len(words), np.uint64)
        for k, word in enumerate(words):
            found = seen.get(word)
            if found is None:
                found = xxh64_intdigest(word, SEED)
                if len(word) <= 64:
                    if len(seen) >= CACHED_WORDS:
                        seen.clear()
                    seen[word] = found
            hashes[k] = found
        width = min(self.width, len(words))
        out = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            out = _mixed(out * _ODD[0, k] + hashes[k : k + len(out)])
        return np.unique(out)


def shingle_set(data: bytes, width: int = SHINGLE) -> np.ndarray:
    return Shingler(width)(data)


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of a set in WORDS words; zero for the empty set."""
    counts = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(shingles), 4096):
        part = shingles[k : k + 4096, None]
        bits = np.unpackbits(_mixed(part * _ODD[1, :WORDS] + _ODD[0, :WORDS]).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > len(shingles), bitorder="little").view(np.uint64)


def _id_key(id_col: str) -> Column:
    return F.col(id_col).cast("long").alias("id")


def _text_key(text_col: str) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key")


def shingle_marks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(id, text_key, fp, n, bits)``: digest and size of the set (0 if it is empty), and its fingerprint."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        shingler = Shingler()
        for batch in batches:
            sets = [shingler(x.as_py() or b"") for x in batch.column(2)]
            marks = np.array([xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            bits = pa.array([wide_fingerprint(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks), pa.array([len(s) for s in sets], pa.int64()), bits], ["id", "text_key", "fp", "n", "bits"])

    narrow = df.select(_id_key(id_col), _text_key(text_col), F.encode(F.col(text_col), "UTF-8").alias("text"))
    return map_arrow(narrow, scan, "id long, text_key long, fp long, n long, bits array<long>")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which fingerprints, ``WORDS`` columns each, differ by ``RADIUS`` bits or fewer: rows of a by rows of b."""
    apart = np.zeros((len(a), len(b)), np.uint16)
    for w in range(WORDS):
        apart += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return apart <= RADIUS


def candidate_links(a: tuple, b: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the candidates between two tiles ``(fp, n, bits)``, or inside the one given."""
    same = b is None
    order = [np.argsort(t[1], kind="stable") for t in ((a,) if same else (a, b))]
    (fp_a, n_a, bits_a) = (x[order[0]] for x in a)
    fp_b, n_b, bits_b = (fp_a, n_a, bits_a) if same else (x[order[1]] for x in b)
    fps, shift = (fp_a, 0) if same else (np.concatenate([fp_a, fp_b]), len(fp_a))
    src, dst = np.empty(0, np.int64), np.empty(0, np.int64)
    for k in range(0, len(fp_a), 128):
        rows = slice(k, min(k + 128, len(fp_a)))
        low = np.searchsorted(n_b * WHOLE, n_a[rows.start] * PARTS, "left")
        high = np.searchsorted(n_b * PARTS, n_a[rows.stop - 1] * WHOLE, "right")
        low = max(low, k) if same else low
        found = [(src, dst)]
        for c in range(low, high, 4096):
            i, j = np.nonzero(_near(bits_a[rows], bits_b[c : min(c + 4096, high)]))
            i, j = i + k, j + c
            fits = WHOLE * np.minimum(n_a[i], n_b[j]) >= PARTS * np.maximum(n_a[i], n_b[j])
            fits &= (i < j) if same else True
            found.append((i[fits], j[fits] + shift))
        if sum(len(f[0]) for f in found[1:]):
            label = forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), len(fps))
            src = np.nonzero(label != np.arange(len(fps)))[0]
            dst = label[src]
    return fps[src], fps[dst]


def _tile(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = cell.values
    bits = rows.field("bits").flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
    return rows.field("fp").to_numpy(), rows.field("n").to_numpy(), bits


def candidates(distinct: DataFrame) -> DataFrame:
    """Rows ``(a, b)`` of digests whose components are those of all candidates of ``distinct (fp, n, bits)``.

    Sizes are at most 2**31, so there are fewer than 100 cells, which bounds the table that is broadcast.
    """
    spark = distinct.sparkSession
    keyed = distinct.withColumn("cell", F.floor(F.log(CELL, F.col("n"))).cast("int"))
    sizes = keyed.groupBy("cell").agg(F.count("*").alias("rows")).collect()
    share = max(TILE_LEAST, min(TILE_MOST, sum(r["rows"] for r in sizes) // TILE_SHARE))
    counts = {r["cell"]: -(-r["rows"] // share) for r in sizes}
    if not counts:
        return spark.createDataFrame([], "a long, b long")
    cells = spark.createDataFrame(sorted(counts.items()), "cell int, tiles int")
    work = sum(n * (n + 1) // 2 + n * counts.get(c + 1, 0) for c, n in counts.items())
    tasks = max(4 * spark.sparkContext.defaultParallelism, work // 4)
    dealt = keyed.join(F.broadcast(cells), "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    pop = F.aggregate("bits", F.lit(0), lambda total, word: total + F.bit_count(word))
    rows = F.collect_list(F.struct("fp", "n", "bits")).alias("rows")
    tiles = materialize(dealt.groupBy("cell", "tile").agg(rows, F.min(pop).alias("least"), F.max(pop).alias("most")), "tiles")
    left = tiles.select(
        F.col("cell").alias("cell_a"), F.col("tile").alias("tile_a"), F.col("rows").alias("a"), F.col("least").alias("least_a"),
        F.col("most").alias("most_a"), F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell"),
    )
    left = left.join(F.broadcast(cells), "cell").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    left = left.where("cell <> cell_a or tile >= tile_a").drop("tiles").repartition(tasks, "cell", "tile")
    pairs = left.join(tiles.withColumnRenamed("rows", "b").repartition(tasks, "cell", "tile"), ["cell", "tile"])
    pairs = pairs.where((F.col("least") - F.col("most_a") <= RADIUS) & (F.col("least_a") - F.col("most") <= RADIUS))
    pairs = pairs.select("a", "b", F.expr("cell = cell_a and tile = tile_a").alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [candidate_links(_tile(a), None if s.as_py() else _tile(b)) for a, b, s in zip(*batch.columns)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in (0, 1)], ["a", "b"])

    return materialize(map_arrow(pairs, compare, "a long, b long"), "candidates")


def confirmed_links(fps: np.ndarray, sides: np.ndarray, bits: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the radius whose sets are similar enough.

    Compared are rows of side 0 with rows of side 1, or with each other where there is no side 1. Of rows
    that are linked already no pair is compared again.
    """
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(names), bool)
    label, links = np.arange(len(fps)), []
    left = np.nonzero(sides == 0)[0]
    right = np.nonzero(sides == 1)[0]
    inner = not len(right)
    right = left if inner else right
    for k in range(0, len(left), 256):
        near = _near(bits[left[k : k + 256]], bits[right])
        for i, row in zip(left[k : k + 256], near):
            others = right[row]
            others = others[(label[others] != label[i]) & (WHOLE * np.minimum(sizes[i], sizes[others]) >= PARTS * np.maximum(sizes[i], sizes[others]))]
            others = others[others > i] if inner else others
            if not len(others):
                continue
            mark[ids[starts[i] : ends[i]]] = True
            both = np.array([np.count_nonzero(mark[ids[starts[j] : ends[j]]]) for j in others])
            mark[ids[starts[i] : ends[i]]] = False
            for j in others[WHOLE * both >= PARTS * (sizes[i] + sizes[others] - both)]:
                if label[j] != label[i]:
                    links.append((int(fps[i]), int(fps[j])))
                    label[label == label[j]] = label[i]
    return links


def confirm(df: DataFrame, marks: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(a, b)`` of digests whose components are those of all confirmed links inside the groups ``roots``."""
    nodes = roots.union(roots.select(F.col("root"), F.col("root"))).distinct().toDF("fp", "root")
    picks = marks.join(nodes, "fp").groupBy("fp").agg(F.min(F.struct("id", "text_key")).alias("row"), F.first("root").alias("root"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    picks = materialize(picks.select("fp", "row.id", "row.text_key", "root", "n", "bits"), "picks")
    split = F.least(F.lit(BLOCK_SPLIT), F.ceil(F.count("*") / BLOCK_ROWS))
    bounds = F.ceil(F.count("*") / BLOCK_MOST), F.ceil(F.sum("n") / BLOCK_SHINGLES)
    shares = picks.groupBy("root").agg(F.greatest(split, *bounds).cast("int").alias("blocks"))
    picks = materialize(picks.join(materialize(shares, "shares"), "root"), "placed")
    texts = df.select(_id_key(id_col), _text_key(text_col), F.encode(F.col(text_col), "UTF-8").alias("text"))
    keys = picks.select(F.col("id").alias("__id"), F.col("text_key").alias("__key"), "fp", "root", "blocks", "bits")
    wanted = texts.join(keys, F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")))
    wanted = wanted.select("root", "fp", F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("block"), "blocks", "bits", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sets = pa.array([shingler(x.as_py() or b"").view(np.int64) for x in batch.column(5)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], sets], ["root", "fp", "block", "blocks", "bits", "shingles"])

    sets = map_arrow(wanted, read, "root long, fp long, block int, blocks int, bits array<long>, shingles array<long>")
    sets = materialize(sets, "sets")
    paired = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    paired = paired.select("root", "low", "high", F.when(F.col("block") == F.col("low"), 0).otherwise(1).alias("side"), "fp", "bits", "shingles")
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    paired = paired.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "root", "low", "high")
    paired = paired.sortWithinPartitions("root", "low", "high", "side", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                keys = zip(*[c.to_pylist() for c in batch.columns[:3]])
                for key, side, fp, bits, shingles in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5), batch.column(6)):
                    yield key, side, fp, bits.values.to_numpy().view(np.uint64), shingles.values.to_numpy().view(np.uint64)

        for _, group in itertools.groupby(rows(), key=lambda r: r[0]):
            once = {(side, fp): (side, fp, bits, shingles) for _, side, fp, bits, shingles in group}
            sides, fps, bits, members = zip(*once.values())
            links = confirmed_links(np.array(fps), np.array(sides), np.stack(bits), list(members)) if len(fps) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    return materialize(map_arrow(paired, compare, "a long, b long"), "links")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, text_key, component_id, kept, rows)``, one per id and text of ``df``.

    ``component_id`` is the least id of the component, null if no row of it has one; ``kept`` marks one id
    and text of each component, that with the least id and of those with the least key; ``rows`` counts the
    rows of ``df`` with the id and text. Texts without words, null ones too, are one component. Ids may be
    null or stand for several texts: every text is judged by itself. An empty table gives no rows.
    """
    marks = materialize(shingle_marks(df, id_col, text_col), "shingles")
    distinct = marks.where("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    roots = connected_components(candidates(materialize(distinct, "distinct")), "a", "b")
    links = confirm(df, marks, roots, id_col, text_col)
    classes = connected_components(links, "a", "b")
    keys = marks.groupBy("id", "text_key", "fp").agg(F.count("*").alias("rows"))
    keys = keys.join(classes, F.col("fp") == F.col("node"), "left").select("id", "text_key", F.coalesce("root", "fp").alias("root"), "rows")
    keys = materialize(keys, "keys")
    discard(marks)
    best = keys.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_key")).alias("best"))
    joined = keys.join(materialize(best, "best"), "root")
    kept = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("text_key") == F.col("best.text_key"))
    return joined.select("id", "text_key", F.col("best.id").alias("component_id"), kept.alias("kept"), "rows")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of :func:`near_copies`, with the columns of ``df`` as they are."""
    found = materialize(near_copies(df, id_col, text_col), "near-copies")
    gone = found.where("not kept").select(F.coalesce(F.col("id").cast("string"), F.lit("-")).alias("id"), "text_key")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.select(row.alias("row"), F.coalesce(_id_key(id_col).cast("string"), F.lit("-")).alias("id"), _text_key(text_col))
    stay = keyed.join(gone, ["id", "text_key"], "left_anti")
    if found.where("kept and rows > 1").limit(1).count():
        stay = stay.dropDuplicates(["id", "text_key"])
    return stay.select("row.*")
