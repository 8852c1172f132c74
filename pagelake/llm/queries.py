"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import (
    conversations,
    disclosure,
    divergence,
    fingerprints,
    langid,
    mixing,
    packing,
    quality_model,
    quality_rules,
    sharding,
    simhash,
    token_output,
    toxicity,
)
from pagelake.llm.common import documents, held_out, labels


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, labels(spark, sf_dir).where(~out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.groups(documents(spark, sf_dir))
    return g.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(documents(spark, sf_dir))
    cut = packing.numbered(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    placed = packing.pack(cut.select("row_id", "length"))
    return cut.join(placed, "row_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(documents(spark, sf_dir))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), fill=True).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out(F.col("doc_id"), 4, 2)
    model = quality_model.fit(docs, labels(spark, sf_dir).where(~out))
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out(F.col("doc_id"), 5, 0)
    filters = langid.fit(docs.where(~out))
    return langid.identify(docs, filters).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = disclosure.detect(documents(spark, sf_dir))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == F.lit(kind))).cast("bigint").alias(f"n_{kind}")

    terms = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,remove:boolean>>")),
                        lambda t: F.concat_ws(":", F.lit(disclosure.TERM), t["start"], t["end"]))
    base = F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    return d.select("doc_id", *map(count, disclosure.KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                    F.array_join(F.concat(base, terms), ",").alias("spans"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.folder(spark)
    token_output.write(documents(spark, sf_dir), path)
    return token_output.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", "grown_shard")


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash_groups": op2_simhash_groups,
    "op3_quality_rules": op3_quality_rules,
    "op4_pack_sequences": op4_pack_sequences,
    "op5_fingerprints": op5_fingerprints,
    "op6_mix_sources": op6_mix_sources,
    "op7_quality_model": op7_quality_model,
    "op8_language": op8_language,
    "op9_personal_data": op9_personal_data,
    "op10_token_output": op10_token_output,
    "op11_shard_documents": op11_shard_documents,
    "op12_repair_conversations": op12_repair_conversations,
    "op13_source_divergence": op13_source_divergence,
}
