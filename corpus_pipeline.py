"""Corpus preparation in five stages, each written as Parquet and read again before the next.

Every stage reads all rows and whole texts of its input and leaves columns other than those of documents as
they are, whatever their names. Language identification drops what it rejects, exact deduplication keeps the
row with the largest id of equal texts, near deduplication keeps one document of each component of texts whose
five-word shingles have a Jaccard similarity of 0.8 or more, mixing cuts sources to their target weights and
packing lays the tokens out in windows. The first four return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm.exact import DigestIndex, drop_exact
from tracewright.llm.langid import fit_centroids, keep_identified
from tracewright.llm.mixing import mix_sources
from tracewright.llm.near_copies import drop_near_copies
from tracewright.llm.pack import pack_documents
from tracewright.plans.storage import materialize

#: Of the words left after deduplication, this share is dealt to sources by weight; no document twice.
MIX_RATIO, MIX_EPOCHS = 0.9, 1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text lies near some centroid of a language learned from ``docs`` itself.

    Rows with a null text, one without letters or one far from every language for its length go. Null ids
    are kept (and not learned from), repeated rows are kept alike. Where no row has a language nothing is
    learned and every row goes; an empty table gives no rows.
    """
    return keep_identified(docs, fit_centroids(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the largest id; A-Z equal a-z and a null text an empty one.

    Rows repeated with that id stay once. Of rows without an id that share a text with none that has one,
    one stays. Equal ids of different texts are different rows. An empty table gives no rows.
    """
    index = DigestIndex(spark)
    kept = drop_exact(docs, index)
    index.drop()
    return kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, that with the least id (a null id is the greatest).

    Rows are judged by id and text: texts that share an id are judged each for itself, and rows repeated
    with one id and text are one. Null and empty texts and texts without words are one component. Texts of
    fewer than five words are one shingle each. An empty table gives no rows.
    """
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows within the word budgets of their sources; the document that a budget ends in stays whole.

    Null languages and sources are a language and a source named ''. Null and empty texts have no words and
    cost nothing; a source without any word gives no rows. Rows repeated with one id (null ids are one)
    stay or go together. An empty table gives no rows.
    """
    mixed = mix_sources(docs, budget_ratio=MIX_RATIO, max_epochs=MIX_EPOCHS, cut=False)
    return mixed.drop(mixed.columns[-1])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows, as :func:`pack_documents` gives them, one row per piece.

    Null and empty texts are one closing id. Null ids and repeated rows are packed row by row. An empty
    table gives no rows.
    """
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("packing", packing)]

#: Learned centroids, star components and byte-pair tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
