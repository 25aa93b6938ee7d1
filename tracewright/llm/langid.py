"""Language identification by nearest centroid over hashed character n-grams.

Texts become TF-IDF vectors of character 1- to 3-grams of their letters, normalised to length one. Each
language has several centroids, found by spherical k-means; a text gets the language of the centroid with
the greatest cosine, and is rejected where it lies much farther out than texts of that language and of its
length do: short texts have few n-grams and lie far from every centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import map_arrow, prepare_workers, table

DIMENSIONS = 8192
CENTROIDS, ROUNDS = 4, 12
#: The bound of the labelled sample that the centroids are fitted on; every language has LEAST_ROWS of it at least.
SAMPLE_ROWS, LEAST_ROWS = 2000, 4
#: A text is rejected below REJECT_SHARE of the cosine that all but REJECT_QUANTILE of the sample of its language
#: and length reach. Lengths are powers of two; one with fewer than REJECT_ROWS rows takes in its neighbours, longer
#: ones at SHORTER of their cosine for each halving, as shorter texts lie farther out.
REJECT_SHARE, REJECT_QUANTILE, REJECT_ROWS, SHORTER = 0.6, 0.01, 40, 0.7
LENGTHS = 64
UNKNOWN = "und"
_SPACE = 32
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams of the whole text; None if it has no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letter_table()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, _SPACE).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]
    codes = np.concatenate([[np.uint32(_SPACE)], codes[keep], [np.uint32(_SPACE)]])
    one = codes * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x55555555)) * np.uint32(0x85EBCA6B) + codes[1:] * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ np.uint32(0x33333333)) * np.uint32(0x27D4EB2F) + codes[2:] * np.uint32(0x165667B1)
    shift = np.uint32(32 - (DIMENSIONS - 1).bit_length())
    return np.bincount(np.concatenate([one, two, three]) >> shift, minlength=DIMENSIONS)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=-1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    vectors: np.ndarray
    owner: np.ndarray
    #: Languages x lengths: the least cosine that is not rejected.
    least: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts).astype(np.float32) * self.idf)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """For each text its language, the cosine in 0..1 and whether it is rejected."""
        out: list[tuple[str, float, bool]] = []
        for text in texts:
            counts = gram_counts(text)
            if counts is None or not self.languages:
                out.append((UNKNOWN, 0.0, True))
                continue
            cosines = self.vectors @ self.vector(counts)
            best = int(cosines.argmax())
            score = float(min(1.0, max(0.0, cosines[best])))
            out.append((self.languages[self.owner[best]], score, score < self.least[self.owner[best], int(counts.sum()).bit_length()]))
        return out


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and each row's centroid.

    Starts from the means of k equal slices of the rows ordered by their cosine with the overall mean, so
    no chance is used and no single odd row becomes a start.
    """
    order = np.argsort(-(rows @ _unit(rows.mean(axis=0))), kind="stable")
    centres = np.stack([_unit(rows[part].mean(axis=0)) for part in np.array_split(order, min(k, len(rows)))])
    for _ in range(rounds):
        member = (rows @ centres.T).argmax(axis=1)
        centres = np.stack([_unit(rows[member == c].mean(axis=0)) if (member == c).any() else centres[c] for c in range(len(centres))])
    return centres, (rows @ centres.T).argmax(axis=1)


def least_cosines(cosines: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each length the cosine below which a text is rejected, from those of a language's sample."""
    least = np.zeros(LENGTHS)
    for at in range(LENGTHS):
        apart = np.abs(lengths - at)
        near = apart <= max(1, np.sort(apart)[min(REJECT_ROWS, len(apart)) - 1])
        least[at] = REJECT_SHARE * np.quantile(cosines[near] * SHORTER ** np.maximum(0, lengths[near] - at), REJECT_QUANTILE)
    return least


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id is not held out, nor learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_centroids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Centroids:
    """Fit on at most ``sample_rows`` labelled rows, equally many a language, or LEAST_ROWS of each if that is more.

    Rows with a null id, text or language and rows held out are not used. The sample is drawn by a hash of
    the id; only n-gram counts reach the driver, so long texts do not. Every language is learned: the driver
    holds a row a language, which is a matter of the label vocabulary and not of the corpus. Without labelled
    rows every prediction is ``und`` and rejected.
    """
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("draw"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    each = max(LEAST_ROWS, sample_rows // max(1, len(sizes)))
    # Twice the rows wanted and 64 more are drawn, so that the least hashes of each language are among them.
    shares = [(r["lang"], min(1 << 30, (1 << 30) * (2 * each + 64) // r["n"])) for r in sizes]
    shares = df.sparkSession.createDataFrame(shares, "lang string, share long")
    drawn = rows.join(F.broadcast(shares), "lang").where(F.pmod("draw", F.lit(1 << 30)) < F.col("share"))
    picked = drawn.select("lang", "text", "draw")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gram_counts(x.as_py()) for x in batch.column(1)]
            keep = [i for i, c in enumerate(found) if c is not None]
            where = [np.nonzero(found[i])[0].astype(np.int32) for i in keep]
            arrays = [batch.column(0).take(pa.array(keep, pa.int64())), batch.column(2).take(pa.array(keep, pa.int64()))]
            arrays.append(pa.array(where, pa.list_(pa.int32())))
            arrays.append(pa.array([found[i][w].astype(np.int32) for i, w in zip(keep, where)], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "draw", "grams", "counts"])

    seen = map_arrow(picked, count, "lang string, draw long, grams array<int>, counts array<int>")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("grams", "counts")))
    seen = seen.withColumn("turn", turn).where(F.col("turn") <= each).orderBy("lang", "turn").toArrow()
    matrix = np.zeros((seen.num_rows, DIMENSIONS), np.float32)
    for i, (at, n) in enumerate(zip(seen.column("grams"), seen.column("counts"))):
        matrix[i, at.values.to_numpy()] = n.values.to_numpy()
    labels = np.array(seen.column("lang").to_pylist(), dtype=object)
    lengths = np.array([int(n).bit_length() for n in matrix.sum(axis=1)], int)
    idf = (np.log((1 + len(matrix)) / (1 + (matrix > 0).sum(axis=0))) + 1).astype(np.float32)
    np.log1p(matrix, out=matrix)
    matrix *= idf
    matrix = _unit(matrix)
    languages, vectors, owner, least = sorted(set(labels)), [], [], []
    for number, lang in enumerate(languages):
        own = matrix[labels == lang]
        centres, member = spherical_kmeans(own, CENTROIDS)
        used = [c for c in range(len(centres)) if (member == c).any()]
        vectors += [centres[c] for c in used]
        owner += [number] * len(used)
        least.append(least_cosines((own * centres[member]).sum(axis=1), lengths[labels == lang]))
    return Centroids(languages, idf, np.array(vectors, np.float32).reshape(-1, DIMENSIONS), np.array(owner, int), np.array(least))


def identify(df: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, held_out, lang_pred, score, rejected)``, one per row of ``df``.

    A null text or one without letters is ``und`` with score 0 and rejected. A rejected text still names
    its nearest language. Whole texts are read; repeated rows repeat; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*shared.value.predict(batch.column(2).to_pylist()))) or [[]] * 3
            arrays = [batch.column(0), batch.column(1)] + [pa.array(c, t) for c, t in zip(found, (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return map_arrow(narrow, scan, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(df: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the model does not reject, with their columns as they are."""
    prepare_workers(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        return pd.Series([not rejected for _, _, rejected in shared.value.predict([x if isinstance(x, str) else None for x in texts])], dtype=bool)

    return df.where(accepted(F.col(text_col)))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_centroids(docs))
