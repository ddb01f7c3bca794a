"""The queries opN_<name> over the driver's tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuforge.llm import oracles as O


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docuforge.llm.substring_dedup import substring_dedup

    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docuforge.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docuforge.llm.quality_classifier import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docuforge.llm.lm_scoring import lm_scores

    scores = lm_scores(_table(spark, sf_dir, "documents"))
    return scores.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


#: Host and path rules of the url filter.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docuforge.llm.url_filter import url_verdicts

    return url_verdicts(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"), URL_RULES)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docuforge.llm.embedding_dedup import embedding_groups

    return embedding_groups(_table(spark, sf_dir, "embeddings"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docuforge.llm.decontaminate import contaminated

    found = contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 9))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docuforge.llm.simhash_dedup import simhash_groups

    groups = simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docuforge.llm.suffix_dedup import suffix_dedup

    out = suffix_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docuforge.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_source_mixing, op3_quality_classifier, op4_lm_scoring, op5_url_filter, op6_embedding_dedup, op7_decontaminate, op8_simhash_dedup, op9_suffix_array_dedup, op10_token_counts)}
ORACLES: dict[str, str] = {"op1_substring_dedup": O.OP1, "op4_lm_scoring": O.OP4, "op6_embedding_dedup": O.OP6, "op7_decontaminate": O.OP7, "op9_suffix_array_dedup": O.OP9}
