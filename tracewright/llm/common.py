"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.plans.shipping import ship_package

#: Characters that separate words in every operator here: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch where the session still has Spark's own default; whole texts come by the megabyte.
BATCH_BYTES, _BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare_workers(spark: SparkSession) -> None:
    """Ship this package and bound the batches that workers and executors hold."""
    ship_package(spark)
    if spark.conf.get(_BATCH_SETTING) in ("67108864b", "64MB"):
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with workers prepared."""
    prepare_workers(df.sparkSession)
    return df.mapInArrow(function, schema)
