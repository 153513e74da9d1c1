"""The operators applied to whole tables, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gannet.llm import chat_format, embedding_dedup, html_text, license_scan, lm_scoring, near_dedup, packing, quality_rules, sentencepiece_fst, toxicity
from gannet.llm.common import crc_of_id, table
from gannet.llm.oracle import ORACLE


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_of_id("doc_id", 10) == 0
    scored = lm_scoring.fit_and_score(table(spark, sf_dir, "documents"), held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op3: counts and the smoothed unigram scores, to six decimals."""
    held_out = crc_of_id("doc_id", 10) == 0
    scored = lm_scoring.base_scores(table(spark, sf_dir, "documents"), held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(tricky))
    out = chat_format.render(said.union(own).withColumn("parts", chat_format.text_part(F.col("text"))))
    back = out.withColumn("back", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.under_loss(F.col("formatted"), F.col("loss_spans")))
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", (crc_of_id("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    coded = sentencepiece_fst.encode(table(spark, sf_dir, "documents"), model, carry=["doc_id", "text"]).withColumnRenamed("text", "whole")
    back = sentencepiece_fst.decode(coded, model, carry=["doc_id", "whole", "ids"])
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.md5("text").alias("decoded_md5"), (F.col("text") == F.col("whole")).alias("same"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars"
    )


__all__ = ["ORACLE", "QUERIES"]

QUERIES = {f.__name__: f for f in (op1_packing, op2_license_scans, op3_lm_scoring, op4_embedding_near_dedup, op5_minhash_near_dedup, op6_chat_formatting, op7_toxicity, op8_html_extraction, op9_sentencepiece, op10_quality_rules, lm_base)}
