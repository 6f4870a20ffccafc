"""One query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trove.llm import (
    chat,
    decontaminate,
    divergence,
    hpylm,
    licenses,
    line_dedup,
    ngram_join,
    packing,
    pii,
    quality,
    sharding,
    spelling,
    tokens,
)

BYTE_BPE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.summary(licenses.scan(docs, licenses.fit(docs)))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    return packing.pack(table(spark, sf_dir, "documents"), path)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.shard(docs, ["lang", "source", "n_chars"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "place",
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = line_dedup.removed_lines(table(spark, sf_dir, "documents"))
    return removed.select("doc_id", "line", "n_words")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contained_items(docs, items)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge(docs, quality.fit(docs, labels))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(f"n_{kind}" for kind in pii.BASE_KINDS),
        F.sha2("base_spans", 256).alias("base_sha256"),
        "spans",
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    return tokens.token_counts(table(spark, sf_dir, "documents"), path)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.expr("crc32(coalesce(CAST(doc_id AS string), '')) % 10 = 0").alias("held_out")
    model, rest = hpylm.fit(docs.where(~held_out))
    scored = hpylm.score(docs, model, rest, held_out)
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.digests(chat.format_conversations(turns))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


ALL = [op1_licenses, op2_packing, op3_ngram_join, op4_sharding, op5_line_dedup, op6_decontamination, op7_quality, op8_pii, op9_token_counts, op10_lm_scoring, op11_spelling, op12_chat, op13_divergence]
