"""The corpus pipeline: quality classifier, SimHash near-dedup, substring dedup, benchmark decontamination, source mixing.

Every stage works on all rows its predecessor kept; all but the last return
the columns of ``documents``.  The last returns the rows the mix takes, with their
size, source size, target and the words taken of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuforge.llm.common import free_name
from docuforge.llm.decontaminate import without_contaminated
from docuforge.llm.mixing import mix
from docuforge.llm.near_copies import keep_first
from docuforge.llm.quality_classifier import fit, with_score
from docuforge.llm.substring_dedup import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name("_score", docs.columns)
    return with_score(docs, model, score_col=score, at_least=0.3).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return keep_first(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; documents of which nothing is left go."""
    cut = substring_dedup(docs, carry=True).where((F.col("n_words") > F.col("n_removed")) | (F.col("n_words") == 0))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("_row.text"))
    own = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col("_row.n_chars"))}
    of = lambda c: F.col("_row").getField(c)
    return cut.select(*[own.get(c, of(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with what it takes of them."""
    return mix(docs, keep=[c for c in docs.columns if c != "doc_id"]).where("taken > 0")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
]

#: Learned scores and XXH64 fingerprints have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
