"""The registered queries opN_<name> of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlspike.llm.ann import search
from marlspike.llm.conversations import repair
from marlspike.llm.jaccard_join import jaccard_join
from marlspike.llm.language_id import identify
from marlspike.llm.minhash import near_duplicates
from marlspike.llm.mixing import SQL as MIX_SQL
from marlspike.llm.mixing import mix
from marlspike.llm.packing import pack
from marlspike.llm.pii import find_pii
from marlspike.llm.quality import quality_rules
from marlspike.llm.secrets import scan_secrets
from marlspike.llm.spelling import spelling_variants
from marlspike.llm.token_count import count_tokens
from marlspike.llm.wavelet import encode_and_read


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), vocabulary())


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op6_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(documents(spark, sf_dir), vocabulary())


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_language_id, op2_token_counts, op3_pii, op4_packing, op5_mixing, op6_wavelet, op7_jaccard_join, op8_nearest_neighbours, op9_quality_rules, op10_secret_scans,
        op11_conversation_repair, op12_minhash_near_dedup, op13_spelling_variants,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": MIX_SQL}
