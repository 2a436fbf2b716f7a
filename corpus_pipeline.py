"""Five stages from raw documents to a training mix.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
it kept; all but the last return the columns of ``docs``. ``run`` writes each
result to the shared folder and reads it back for the next, so a stage is never
computed twice and a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, language, line_dedup, minhash, mixing
from gleaner.llm.store import stored
from gleaner.operators.skew import at_most

BATCH_BYTES = 4 << 20
"""Most bytes of texts that a Python worker is handed at a time. Workers live on from stage to stage, and so does what they once needed."""


def _small_batches(stage):
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxBytesPerBatch"
        now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        if not 0 < now <= BATCH_BYTES:
            spark.conf.set(name, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)
    return run


@_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, with ``lang`` as predicted; learned from the labelled ones.

    Texts that are null or have no letter are rejected. Where no row has a
    language to learn from, nothing is decided and all documents stay as they are.
    """
    return language.accepted(docs, language.learn(docs.select("doc_id", "text", "lang")))


@_small_batches
def line_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has in the same order are cut from ``text``.

    ``n_chars`` follows the text. Documents of which nothing but white space is left go.
    """
    left = line_dedup.without_shared(docs, line_dedup.every_shared(docs.select("doc_id", "text")))
    cut = F.col(line_dedup.REMOVED) > 0
    left = left.where(~cut | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each component of near copies.

    Of rows that repeat an id one stays, that with the greatest text. Rows without an id stay.
    """
    found = stored(minhash.near_duplicates(docs.select("doc_id", "text")))
    kept = _without(docs, found.where("not kept").select("doc_id").distinct())
    repeated = stored(found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    first = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("text"), F.xxhash64(*docs.columns))
    again = kept.join(repeated, "doc_id", "left_semi").withColumn("_gl_row", F.row_number().over(first)).where("_gl_row = 1").drop("_gl_row")
    return _without(kept, repeated).unionByName(again)


@_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that matches a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.leaks(docs.select("doc_id", "text"), items).select("doc_id").distinct())


@_small_batches
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents by calibrated probabilities, with ``n_tokens, topic, tokens, weight, prob`` of each."""
    rows = mixing.features(docs)
    cells = mixing.fitted(rows.select(*mixing.DIMENSIONS, "n_tokens"))
    return mixing.mixed(rows, cells).where("sampled").drop("sampled")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
]

#: Compression, alignment and components have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``doc_id`` is not among ``ids``; those without one stay."""
    gone = stored(ids.where("doc_id is not null"))
    return docs.join(at_most(gone, gone.count()), "doc_id", "left_anti")
