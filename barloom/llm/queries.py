"""The registered queries of the operators and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontaminate, exact_dedup, knn_join, langid, licenses, line_dedup, lm_score, merkle, mixing, secrets, sharding, simhash, token_links

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _on_documents(name: str, op: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: op(documents(spark, sf_dir))


_on_documents("op1_mixing", mixing.op1_mixing)
ORACLE["op1_mixing"] = mixing.ORACLE
_on_documents("op2_language_id", langid.op2_language_id)
_on_documents("op3_license_scan", licenses.op3_license_scan)
_on_documents("op4_exact_dedup", exact_dedup.op4_exact_dedup)
ORACLE["op4_exact_dedup"] = exact_dedup.ORACLE
QUERIES["op5_decontamination"] = lambda spark, sf_dir: decontaminate.op5_decontamination(
    documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
ORACLE["op5_decontamination"] = decontaminate.ORACLE
_on_documents("op6_secret_scan", secrets.op6_secret_scan)
_on_documents("op7_line_dedup", line_dedup.op7_line_dedup)
_on_documents("op8_simhash_dedup", simhash.op8_simhash)
_on_documents("op9_lm_score", lm_score.op9_lm_score)
_on_documents("op10_sharding", sharding.op10_sharding)
_on_documents("op11_token_alignment", token_links.op11_token_alignment)
_on_documents("op12_merkle", merkle.op12_merkle)
ORACLE["op12_merkle"] = merkle.ORACLE
QUERIES["op13_top_k"] = lambda spark, sf_dir: knn_join.op13_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
ORACLE["op13_top_k"] = knn_join.ORACLE
