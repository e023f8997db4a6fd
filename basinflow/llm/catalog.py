"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, jaccard_join, mixing, ngram_lm, packing, pii, quality, topk, winnowing
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score(read(spark, sf_dir, "documents"), order=3)
    return scored.withColumns({"log_score": F.round("log_score", 5), "mean_log_score": F.round("mean_log_score", 7)})


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"), k=4, percent=85)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare(read(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), *tokenizer())


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("source")


def tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of an installed vocabulary."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), *tokenizer(), with_ids=False)


def queries() -> dict[str, Query]:
    found = [op1_lm_score, op2_html_text, op3_jaccard_join, op4_fingerprints, op5_topk, op6_packing, op7_pii, op8_quality, op9_mixing, op10_bpe]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_lm_score": ngram_lm.ORACLE, "op5_topk": topk.ORACLE, "op7_pii": pii.ORACLE, "op9_mixing": mixing.ORACLE}
