"""The registered queries of this package: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.llm import bpe, chat, decontaminate, licenses, manifest, media_audio, minhash, mixing, quality, ranked_search, secrets, substring_dedup, warc
from siltstone.llm.shared import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def op1_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_audio.digest(media_audio.audio_features(table(spark, sf_dir, "documents")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("lang", "source")


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.render_perspectives(table(spark, sf_dir, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return out.withColumn("masks", masks)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op6_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.drill(table(spark, sf_dir, "pages"))


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan(table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id").drop("key")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return licenses.scan_licenses(docs.withColumn("path", path))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, threshold=80)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audited(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_media_audio, op2_bpe, op3_quality_mcd, op4_chat_rotation, op5_secret_scan, op6_warc_merkle, op7_temperature_mixing, op8_substring_dedup, op9_license_scan, op10_minhash_near_dedup, op11_ranked_search, op12_decontamination, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_rotation": chat.ORACLE, "op6_warc_merkle": warc.ORACLE, "op9_license_scan": licenses.oracle(), "op11_ranked_search": ranked_search.ORACLE, "op12_decontamination": decontaminate.ORACLE, "op13_merkle_manifest": manifest.oracle()}
