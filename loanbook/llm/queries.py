"""The operators as named queries; each reads whole tables and returns its full result."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanbook.llm import ann, bpe, hard_negatives, lsh_forest, mixing, passages, pii, syncmers, token_blocks, toxicity, url_filter, warc_audit, whitening
from loanbook.llm.common import shared_folder, staged, table
from loanbook.llm.oracle import SQL

__all__ = ["QUERIES", "SQL"]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = syncmers.compare_with_next(table(spark, sf_dir, "documents"))
    return compared.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_toxicity(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir).select("doc_id", "held_out", "score", "predicted")


def judged_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds held_out, score and predicted; labels of held-out rows are never read by the fit."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "toxic")
    machine = toxicity.fit(table(spark, sf_dir, "documents"), labels, "toxic")
    scored = toxicity.score(docs, machine)
    return scored.withColumn("held_out", held_out).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica with planted damage: by the digest of the id, one record in 64 is gone and one in 64 has another
    first payload character."""
    pages = table(spark, sf_dir, "pages")

    def held(key: Column, record: Column) -> Column:
        drawn = F.substring(F.md5(key.cast("string").cast("binary")), 1, 2)
        at = F.instr(record, F.lit("\r\n\r\n")) + 4
        changed = F.concat(F.substring(record, F.lit(1), at - 1), F.lit("~"), F.substring(record, at + 1, F.length(record)))
        return F.when(drawn.isin("00", "01", "02", "03"), F.lit(None).cast("string")).when(drawn.isin("10", "11", "12", "13"), changed).otherwise(record)

    good = staged(warc_audit.catalogue(pages), "warc-catalogue")
    faults = warc_audit.audit(good, warc_audit.catalogue(pages, held=held))
    known = good.select(F.col("key").alias("page_id"), "file", "offset", "length")
    return faults.join(known, ["file", "offset"], "left").select("page_id", "file", "offset", "length", "fault", "digest", "copy_digest")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()
    encoded = bpe.encode(docs, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), "ids")
    decoded = bpe.decode(encoded, path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-blocks-{uuid.uuid4().hex}"
    token_blocks.write_documents(table(spark, sf_dir, "documents"), path, tokenizer_path())
    held = token_blocks.read_documents(spark, path, as_bytes=True)
    return held.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {f.__name__: f for f in (
    op1_pii, op2_passages, op3_syncmers, op4_lsh_forest, op5_url_filter, op6_toxicity, op7_mixing, op8_warc_audit, op9_bpe, op10_ann,
    op11_hard_negatives, op12_whitening, op13_token_blocks)}
