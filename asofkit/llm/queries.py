"""Registered queries of this subpackage: thin digests of the operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.llm import bpe, classifier, fingerprint, hilbert, lm, merkle, minhash, packing, rabitq, repair, rules, suffix, warc
from asofkit.llm.common import row_keyed, table
from asofkit.llm.oracles import SQL

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents to ids and back."""
    return bpe.encode_column(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every text and the verdict of its group's limits."""
    counts = rules.written(rules.measured(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"]), "measures")
    return rules.judged(counts, rules.limits(counts)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents along a curve over language, source, size and id, in 40 runs."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32")
    )
    shards = hilbert.cut_runs(hilbert.along_curve(docs, ["lang", "source", "size", "doc_id"]), "curve", ["doc_id"], 40)
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


@query
def op6_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in as few sequences of 2048 tokens as the exchanges find."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query
def op10_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copies among all documents: four-word shingles, similarity 0.8."""
    docs = row_keyed(table(spark, sf_dir, "documents"), "file", "pos").select("file", "pos", "doc_id", "text")
    return minhash.grouped(docs, 4, 80).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query
def op3_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to archives and back, in the order of the merged index."""
    index, folder = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_back(index, folder).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated quality score of every document."""
    scores = classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return scores.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted"))


@query
def op9_binary_code_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copies among all embeddings: cosine 0.9."""
    return rabitq.near_copies(table(spark, sf_dir, "embeddings"), 0.9)


@query
def op5_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 200-byte strings that occur elsewhere."""
    return suffix.digests(row_keyed(table(spark, sf_dir, "documents"), "file", "pos").select("file", "pos", "doc_id", "text"))


@query
def op2_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document under the network trained on all of them."""
    docs = table(spark, sf_dir, "documents")
    return lm.scored(docs, lm.trained(docs), ["doc_id"])


@query
def op13_postorder_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; every seventh id (by checksum) is verified against a changed row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = lambda n: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = docs.select("doc_id", "lang", fields(F.col("n_chars")).alias("leaf"), F.when(changed, fields(F.col("n_chars") + 1)).alias("tampered"))
    got = merkle.proofs(rows, "lang", ["doc_id"], "leaf")
    got = got.withColumn("proof_sha256", merkle.proof_digest(F.col("steps"))).withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("steps")))
    return got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op12_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edit by the next one, and where the two part."""
    got = fingerprint.edited(table(spark, sf_dir, "documents"), "doc_id", "text")
    return got.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_id", "edit_section", "edit_paragraph")


@query
def op11_least_audit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, their faults and the least of their cheapest repairs."""
    rows = repair.keyed(table(spark, sf_dir, "conversations"))
    return repair.repaired(repair.damaged(rows), rows.select("conv", "conv_id").distinct())
