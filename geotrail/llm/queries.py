"""Queries ``opN_<name>`` over the shared tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexical_search import RANKED_SQL
from .merkle import MANIFEST_SQL
from .mixing import mix_sql
from .onebit_ann import NEAREST_SQL
from .substring_dedup import REPEATS_SQL


#: Bytes below which a table may lie in one row group, and is dealt to all cores.
SMALL_TABLE = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < SMALL_TABLE
    return docs.repartition(spark.sparkContext.defaultParallelism) if small else docs


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import training_mix

    return training_mix(documents(spark, sf_dir)).orderBy("position_1", "doc_id")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media_chunks import media_features

    return media_features(documents(spark, sf_dir))


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe_codes

    return bpe_codes(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .onebit_ann import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, toxicity_scores

    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return toxicity_scores(docs, model, keep=["doc_id"]).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


#: Stands in for the secret that a deployment passes in.
PII_KEY = "public-example-key"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit_languages, predict_languages

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    found = predict_languages(docs.select("doc_id", "text"), fit_languages(docs), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import merkle_manifest

    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    return merkle_manifest(documents(spark, sf_dir), tampered)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import ranked_documents

    return ranked_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_shards import lookup, write_shards

    docs = documents(spark, sf_dir)
    shards = write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return lookup(shards, docs.select("doc_id").distinct()).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_mixing": op1_mixing, "op2_media": op2_media, "op3_license": op3_license, "op4_bpe": op4_bpe, "op5_pii": op5_pii, "op6_language": op6_language, "op7_substring": op7_substring, "op8_nearest": op8_nearest, "op9_simhash": op9_simhash, "op10_toxicity": op10_toxicity, "op11_merkle": op11_merkle, "op12_lexical": op12_lexical, "op13_token_ids": op13_token_ids}
ORACLE_SQL: dict[str, str] = {"op1_mixing": mix_sql(), "op7_substring": REPEATS_SQL, "op8_nearest": NEAREST_SQL, "op11_merkle": MANIFEST_SQL, "op12_lexical": RANKED_SQL}
