"""Queries of the operators in this subpackage, over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode_documents
from .common import label_hash, table
from .compression_quality import fit_quality, score_quality
from .edit_counts import edited_counts
from .fill_middle import MIDDLE_SQL, fill_in_middle, restored
from .html_text import main_text
from .lexical_search import RANKED_SQL, ranked_documents
from .lexicon_toxicity import fit_toxicity, score_toxicity
from .minhash_dedup import near_duplicates
from .private_data import pseudonymise
from .shingle_join import linked_documents
from .source_mix import TAKEN_SQL, taken_words
from .vector_search import TOP_SQL, top_vectors
from .weighted_fingerprint import edited_fingerprints


KEY = "key of the query over test tables"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(table(spark, sf_dir, "labels"), docs))
    return scored.select("doc_id", F.coalesce(label_hash() % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_vectors(table(spark, sf_dir, "embeddings"))


def op4_weighted_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(table(spark, sf_dir, "labels"), docs))
    return scored.select("doc_id", F.coalesce(label_hash() % 4 == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, KEY).select("doc_id", F.size("private").alias("n_private"), F.array_join("private", ",").alias("kinds"), "text")


def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(table(spark, sf_dir, "documents"))


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


QUERIES = (
    op1_html_text,
    op2_compression_quality,
    op3_vector_search,
    op4_weighted_fingerprint,
    op5_lexicon_toxicity,
    op6_byte_bpe,
    op7_private_data,
    op8_edit_counts,
    op9_shingle_join,
    op10_source_mix,
    op11_minhash_dedup,
    op12_fill_middle,
    op13_lexical_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_vector_search": TOP_SQL, "op10_source_mix": TAKEN_SQL, "op12_fill_middle": MIDDLE_SQL, "op13_lexical_search": RANKED_SQL}
