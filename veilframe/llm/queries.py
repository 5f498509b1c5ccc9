"""Queries over the operators of this subpackage, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, chat, decontam, langid, line_dedup, minhash_forest, mixing, substring_dedup, suffix_dedup, warc
from .common import back_to_id, documents


def op1_substring_dedup(spark, sf_dir):
    """Windows of 20 words that occurred earlier, removed; nulls and repeats as in substring_dedup.repeated_spans()."""
    out = substring_dedup.remove_repeats(documents(spark, sf_dir), 20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_additive_ann(spark, sf_dir):
    """The 10 nearest of each vector whose vec_id is divisible by 100; what takes no part is in ann.valid()."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return ann.search(vectors, vectors.where(F.col("id") % 100 == 0), 10)


def op4_suffix_dedup(spark, sf_dir):
    """Strings of 400 bytes that also start elsewhere, removed; nulls and repeats as in suffix_dedup.remove_repeats()."""
    out = suffix_dedup.remove_repeats(documents(spark, sf_dir), 400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_minhash_forest(spark, sf_dir):
    """Groups of documents of similarity 0.85; nulls and repeats as in minhash_forest.near_duplicates()."""
    return minhash_forest.op6(documents(spark, sf_dir))


def op7_language_id(spark, sf_dir):
    """Language of every document, learned from those not held out; null and letterless texts are und."""
    docs = documents(spark, sf_dir)
    model = langid.fit(docs)
    return langid.predict(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), model)


def op9_decontamination(spark, sf_dir):
    """Each document with each benchmark item that it holds; nulls and repeats as in decontam.contaminated()."""
    found = decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(back_to_id("doc").alias("doc_id"), "item_id", "question_overlap", "answer_overlap")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat_format": chat.op2_chat_format,
    "op3_additive_ann": op3_additive_ann,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_warc_derivatives": warc.op5_warc_derivatives,
    "op6_minhash_forest": op6_minhash_forest,
    "op7_language_id": op7_language_id,
    "op8_mixing": mixing.op8_mixing,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}
ORACLE_SQL: dict[str, str] = {"op2_chat_format": chat.OP2_SQL, "op8_mixing": mixing.OP8_SQL}
