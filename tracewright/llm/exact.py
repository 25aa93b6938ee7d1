"""Exact deduplication against a persistent digest index, bucketed and sorted by hash.

New data is reduced to one keeper per digest, sort-merge anti-joined with the index (whose buckets need no
shuffle, nor a sort while each is one file) and what is new is appended. Texts are hashed where they are
read; only digests, 32 bytes each, and ids move.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import table
from tracewright.plans.storage import materialize, shared_dir

#: Digests in a bucket, about 100 MB of them, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 2_000_000, 64
#: Appends after which an index is written anew, with one file a bucket.
COMPACT_AFTER = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def text_digest(text: Column) -> Column:
    """SHA-256, as binary, of the text in UTF-8 with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), 256))


@contextlib.contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """While it lasts, scans of buckets of one file each are taken as sorted, which they were written."""
    before = spark.conf.get(_SORTED_SCANS, "false")
    spark.conf.set(_SORTED_SCANS, "true")
    try:
        yield
    finally:
        spark.conf.set(_SORTED_SCANS, before)


class DigestIndex:
    """Rows ``(digest, keep_id)``, one per digest, bucketed and sorted by digest, in a folder that outlives the session.

    The folder holds a generation ``g<number>-<buckets>`` of bucket files, and its name says all that a later
    session needs to open it as a table again. The first rows size the buckets; every append adds a sorted
    file to each; after ``COMPACT_AFTER`` of them the next generation is written, with buckets for its size.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/tracewright/exact-index-{uuid.uuid4().hex}"
        self._opened: tuple[str, str] | None = None

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _generations(self) -> list[tuple[int, int]]:
        """Numbers and buckets of the generations that were written to their end, oldest first."""
        files, at = self._files()
        names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
        child = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [tuple(map(int, n[1:].split("-"))) for n in names if n[0] == "g" and files.exists(child(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(found)

    def exists(self) -> bool:
        return bool(self._generations())

    def _open(self) -> tuple[str, int]:
        """Table name and buckets of the newest generation."""
        number, buckets = self._generations()[-1]
        where = f"{self.path}/g{number}-{buckets}"
        if self._opened is None or self._opened[0] != where:
            self._forget()
            self._opened = where, f"exact_index_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {self._opened[1]} (digest BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{where}'"
            )
        return self._opened[1], buckets

    def _forget(self) -> None:
        if self._opened:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._opened[1]}")
            self._opened = None

    def read(self) -> DataFrame:
        """What is in the folder now, whoever has appended it."""
        name = self._open()[0]
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def appends(self) -> int:
        """Files in the fullest bucket."""
        files, _ = self._files()
        number, buckets = self._generations()[-1]
        names = [x.getPath().getName() for x in files.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/g{number}-{buckets}"))]
        seen: dict[str, int] = {}
        for name in names:
            if name.startswith("part-"):
                bucket = name.split("_")[-1].split(".")[0]
                seen[bucket] = seen.get(bucket, 0) + 1
        return max(seen.values(), default=0)

    def add(self, digests: DataFrame) -> None:
        """Append the digests of ``(digest, keep_id)``, unique by digest, that the index lacks."""
        if not self.exists():
            buckets = max(LEAST_BUCKETS, -(-digests.count() // BUCKET_ROWS))
            self._write(digests.select("digest", "keep_id").repartition(buckets, "digest"), 0, buckets)
            return
        if self.appends() >= COMPACT_AFTER:
            self.compact()
        name, buckets = self._open()
        with sorted_scans(self.spark):
            new = digests.select("digest", "keep_id").hint("merge").join(self.read().select("digest"), "digest", "left_anti")
            # The rows come in the buckets' own partitions from the join, so they are not dealt out again.
            new.write.bucketBy(buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(name)

    def _write(self, rows: DataFrame, number: int, buckets: int) -> None:
        """A generation; its ``_SUCCESS`` file comes last, so one that was cut short is never opened."""
        name = f"exact_index_{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(buckets, "digest").sortBy("digest").option("path", f"{self.path}/g{number}-{buckets}")
        writer.format("parquet").mode("overwrite").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")

    def compact(self) -> None:
        """Write the next generation with one file a bucket and delete the ones before."""
        old = self._generations()
        rows = self.read()
        buckets = max(LEAST_BUCKETS, -(-rows.count() // BUCKET_ROWS))
        self._write(rows.repartition(buckets, "digest"), old[-1][0] + 1, buckets)
        self._forget()
        files, _ = self._files()
        for number, had in old:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/g{number}-{had}"), True)

    def winners(self, groups: DataFrame) -> DataFrame:
        """``groups``, one row per digest, with ``keep_id`` of the index, whose buckets are read as they lie."""
        return groups.hint("merge").join(self.read(), "digest")

    def drop(self) -> None:
        """Forget the table and delete the folder."""
        self._forget()
        files, at = self._files()
        files.delete(at, True)


def _judged(df: DataFrame, index: DigestIndex, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Written rows ``(doc_id, digest)`` and groups ``(digest, group_size, keep_id)``; the index grows."""
    rows = materialize(df.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest")), "digests")
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialize(groups, "digest-groups")
    index.add(groups)
    with sorted_scans(df.sparkSession):
        return rows, materialize(index.winners(groups.drop("keep_id")), "digest-winners")


def exact_duplicates(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, keep_id, group_size, kept, text_sha256)``, one per row of ``df``; the index grows.

    Within ``df`` the row with the largest id stays; a digest that an earlier call indexed keeps that
    call's row, so none of its new copies is kept. A null text equals an empty one. Of rows without any
    id in their group none is kept by id: ``keep_id`` is null and ``kept`` true for them. Rows repeated
    with the winning id are all marked kept. An empty table gives no rows; other columns are not read.
    """
    rows, winners = _judged(df, index, id_col, text_col)
    out = rows.join(winners, "digest")
    return out.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`exact_duplicates` keeps, each once, with all their columns as they are.

    Rows meet their winner by digest and id together, so copies of one text are dealt to many tasks.
    """
    rows, winners = _judged(df, index, id_col, text_col)
    best = winners.select(F.col("digest"), _id_key("keep_id").alias("key"))
    kept = rows.select("digest", _id_key("doc_id").alias("key")).join(best, ["digest", "key"], "left_semi")
    repeated = kept.groupBy("digest", "key").count().where("count > 1").limit(1).count() > 0
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    stay = df.select(row, text_digest(F.col(text_col)).alias("digest"), _id_key(id_col).alias("key")).join(best, ["digest", "key"], "left_semi")
    return (stay.dropDuplicates(["digest", "key"]) if repeated else stay).select("row.*")


def _id_key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long").cast("string"), F.lit("-"))


def fresh_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark)


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fresh_index(spark)
    out = exact_duplicates(table(spark, sf_dir, "documents"), index)
    index.drop()  # its answers are written
    return out


ORACLE = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d
"""
