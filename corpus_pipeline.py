"""A training corpus from documents: quality, near copies, private data, mixture, token ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from channelflow.llm.byte_bpe import encode_documents
from channelflow.llm.common import shared_folder, table
from channelflow.llm.compression_quality import fit_quality, score_quality
from channelflow.llm.private_data import pseudonymise
from channelflow.llm.shingle_join import linked_documents
from channelflow.llm.source_mix import draw_mix, plan_mix

NEAR_WORDS = 5
NEAR_PERCENT = 80
PSEUDONYM_KEY = "spark.pseudonym.key"  # the setting that holds a deployment's key
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20  # of texts that Spark hands to Python at once


def slim(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others as one, so that none clashes with what an operator adds."""
    others = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, *([F.struct(*others).alias("_others")] if others else []))


def widened(slimmed: DataFrame, columns: list[str], *needed: str) -> DataFrame:
    return slimmed.select(*[F.col(c) if c in needed else F.col("_others")[c].alias(c) for c in columns])


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python by so many bytes: 10,000 long texts a batch are held, with room to grow, by the executor and again by its worker. A bound that the session has stays.

    The setting is read when a stage's result is written, so it isn't put back.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject."""
    bound_batches(spark)
    model = fit_quality(table(spark, sf_dir, "labels"), docs.select("doc_id", "text"))
    scored = score_quality(slim(docs, "doc_id", "text"), model).where("predicted = 1")
    return widened(scored, docs.columns, "doc_id", "text")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that of smallest doc_id, of rows without one or with equal ids that of smallest key, of rows equal in id and text that whose other columns hash lowest.

    Rows are linked by a key of id and text, so rows of equal or without id but with different texts are documents of their own; rows equal in both are one. Texts
    without words link with nothing, so they stay here (and give the mix no words).
    """
    bound_batches(spark)
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("_key")
    slimmed = slim(docs, "doc_id", "text").select("*", key)
    others = ["_others"] if "_others" in slimmed.columns else []
    slimmed = slimmed.withColumn("_row", F.xxhash64("_key", *others))
    linked = linked_documents(slimmed.select(F.col("_key").alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT)
    linked = linked.select(F.col("doc_id").alias("_key"), "component_id").distinct().join(slimmed.groupBy("_key", "doc_id").agg(F.min("_row").alias("_row")), "_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_key", "_row"))
    kept = linked.groupBy("component_id").agg(first.alias("first")).select("first._row")
    one = slimmed.join(kept, "_row", "left_semi").dropDuplicates(["_row"])
    return widened(one, docs.columns, "doc_id", "text")


def hide_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for private values, under the deployment's key; reruns under one key agree."""
    key = spark.conf.get(PSEUDONYM_KEY, "key of test corpora")
    return with_length(widened(pseudonymise(slim(docs, "doc_id", "text"), key), docs.columns, "doc_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's draws, laid out by shard: a document as often as it is drawn, the last draw of a source cut to its quota. Documents without words give none."""
    drawn = draw_mix(plan_mix(slim(docs, "doc_id", "text", "source"))).where("words > 0")
    return with_length(widened(drawn, docs.columns, "doc_id", "text", "source"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each draw."""
    bound_batches(spark)
    return encode_documents(docs, with_ids=True)


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_one_of_near_copies),
    ("private_data", hide_private_data),
    ("mix", mix_sources),
    ("encode", encode),
]

#: Compression, links through components and merges aren't SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    run_id = uuid.uuid4().hex
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/pipeline-{run_id}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
