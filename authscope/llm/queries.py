"""Registered queries of the training-text operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from authscope.llm.codes import vector_codes
from authscope.llm.decontaminate import contaminated
from authscope.llm.fingerprints import fingerprint_with_edits
from authscope.llm.jaccard import near_duplicates
from authscope.llm.language import identify
from authscope.llm.lexical import ranked_search
from authscope.llm.oracles import DECONTAMINATION, RANKED_SEARCH, VECTOR_CODES
from authscope.llm.packing import pack
from authscope.llm.passages import repeated_passages
from authscope.llm.pieces import sample_pieces
from authscope.llm.quality_model import resample
from authscope.llm.rules import judge
from authscope.llm.sharding import shard_by_bytes
from authscope.llm.toxicity import score_toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(_documents(spark, sf_dir))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(_documents(spark, sf_dir))


def op4_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(_documents(spark, sf_dir))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_documents(spark, sf_dir), _labels(spark, sf_dir))[0]


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_documents(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_documents(spark, sf_dir), _benchmark(spark, sf_dir))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_documents(spark, sf_dir), _benchmark(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_sharding": op3_sharding,
    "op4_sentencepiece_sampling": op4_sentencepiece_sampling,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language": op10_language,
    "op11_ranked_search": op11_ranked_search,
    "op12_decontamination": op12_decontamination,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op11_ranked_search": RANKED_SEARCH,
    "op12_decontamination": DECONTAMINATION,
    "op13_vector_codes": VECTOR_CODES,
}
