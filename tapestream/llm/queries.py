"""The queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, byte_bpe, collocations, mixing, near_dup, packing, pii, quality, secrets, toxicity, training_order, url_rules, va_topk
from .store import new_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(_table(spark, sf_dir, "documents"))


#: The contract's rules.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op2_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.verdicts(_table(spark, sf_dir, "pages"), URL_RULES, same_page=url_rules.exact_key)  # aliases by edges only


def op3_va_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_topk.top_k(_table(spark, sf_dir, "embeddings"))


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.METRICS, "removed_chars", "kept")


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = training_order.training_order(_table(spark, sf_dir, "documents"), vocabulary())
    return training_order.write_sequences(ordered, new_path(spark, "shards"))


def op6_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op8_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op11_postings_cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(_table(spark, sf_dir, "documents"), a, b, public_tokenizers.PATTERN)


def op12_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op13_apriori_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_secret_novelty": op1_secret_novelty,
    "op2_redirect_equivalence": op2_redirect_equivalence,
    "op3_va_top_k": op3_va_top_k,
    "op4_line_frequency": op4_line_frequency,
    "op5_training_order": op5_training_order,
    "op6_factorization_machine": op6_factorization_machine,
    "op7_hypergeometric_mix": op7_hypergeometric_mix,
    "op8_bootstrapped_pii": op8_bootstrapped_pii,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_order_minhash": op10_order_minhash,
    "op11_postings_cogroup": op11_postings_cogroup,
    "op12_two_tier_bpe": op12_two_tier_bpe,
    "op13_apriori_collocations": op13_apriori_collocations,
}
ORACLE_SQL: dict[str, str] = {"op13_apriori_collocations": collocations.SQL}
