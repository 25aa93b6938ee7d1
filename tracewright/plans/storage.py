"""Shared storage for cut lineage and written intermediate tables.

Executors may be lost at any time, so intermediate results that several plans read go to the shared
folder named by ``spark.checkpoint.dir`` and never to the memory or disks of executors alone.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a fresh local one only where the setting is absent and all runs on this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tracewright-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie, apart from those of others."""
    sc = spark.sparkContext
    if not hasattr(sc, "_tracewright_run"):
        sc._tracewright_run = f"{shared_dir(spark)}/tracewright/run-{uuid.uuid4().hex}"
    return sc._tracewright_run


def clear_run(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that were not written yet can't be read after."""
    files, folder = _path(spark, run_dir(spark))
    files.delete(folder, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back with the lineage cut."""
    return observed(df, label)[0]


def observed(df: DataFrame, label: str, *aggregates: Column) -> tuple[DataFrame, dict]:
    """As :func:`materialize`, with aggregates of the rows that the write itself takes: no job of their own."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    seen = Observation() if aggregates else None
    (df.observe(seen, *aggregates) if seen else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracewright_path = path
    return out, seen.get if seen else {}


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that no later plan reads."""
    path = getattr(df, "_tracewright_path", None)
    if path:
        files, target = _path(df.sparkSession, path)
        files.delete(target, True)


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def commit_tables(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> int:
    """Write several tables as one version below ``path``: readers see all of them or none.

    The tables go to a folder of the version's number, and only when all are there is an empty file
    ``_COMMITTED`` added to it; versions without it are never read. A writer that fails leaves no version;
    one whose number another writer took first fails.
    """
    number = (committed_versions(spark, path) or [0])[-1] + 1
    files, folder = _path(spark, f"{path}/v{number}")
    if files.exists(folder):
        files.delete(folder, True)  # what a writer that failed left
    for name, df in tables.items():
        df.write.parquet(f"{path}/v{number}/{name}")
    _, mark = _path(spark, f"{path}/v{number}/_COMMITTED")
    if not files.createNewFile(mark):
        raise RuntimeError(f"version {number} was committed by another writer")
    return number


def committed_versions(spark: SparkSession, path: str) -> list[int]:
    files, root = _path(spark, path)
    names = [x.getPath().getName() for x in files.listStatus(root)] if files.exists(root) else []
    return sorted(int(n[1:]) for n in names if n[0] == "v" and files.exists(_path(spark, f"{path}/{n}/_COMMITTED")[1]))


def read_committed(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the newest version, or of a given one."""
    versions = committed_versions(spark, path)
    if not versions or version is not None and version not in versions:
        raise ValueError(f"no such version below {path}")
    return spark.read.parquet(f"{path}/v{version or versions[-1]}/{name}")
