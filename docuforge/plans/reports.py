"""Status reports and result rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from docuforge.functions.text import line_suffix, reason, source_uri
from docuforge.operators.ranking import numbered


def index_counts(files: DataFrame, chunks: DataFrame, embeddings: DataFrame, query_embeddings: DataFrame | None = None) -> DataFrame:
    """One row: files, chunks, active_profile_embeddings, missing_active_profile_embeddings, query_embeddings; one aggregate a table, combined without a collect."""
    have = embeddings.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(files, "files").crossJoin(one(chunks, "chunks")).crossJoin(one(have, "active_profile_embeddings"))
    out = out.crossJoin(one(query_embeddings, "query_embeddings")) if query_embeddings is not None else out.withColumn("query_embeddings", F.lit(0).cast("long"))
    return out.select("files", "chunks", "active_profile_embeddings", (F.col("chunks") - F.col("active_profile_embeddings")).alias("missing_active_profile_embeddings"), "query_embeddings")


def profile_counts(profiles: DataFrame, embeddings: DataFrame, key: str = "profile_hash") -> DataFrame:
    """Profiles with the number of their vectors, zero included."""
    counted = embeddings.groupBy(key).agg(F.count("*").alias("embeddings"))
    return profiles.join(counted, key, "left").withColumn("embeddings", F.coalesce("embeddings", F.lit(0)))


def result_json(rows: DataFrame, root: str = "/") -> DataFrame:
    """One JSON object a result: rank, path, source_uri, kind, level, lines, text, snippet, score, scores, file_type."""
    r = numbered(rows).select(
        "rank", "path", source_uri(root, F.col("path"), F.col("start_line")).alias("source_uri"), F.when(F.col("kind") == "image", "image").otherwise("text").alias("kind"), "level",
        "start_line", "end_line", F.col("snippet").alias("text"), "snippet", "score",
        F.struct(F.col("vector_score").alias("vector"), F.col("keyword_score").alias("keyword"), F.col("metadata_score").alias("metadata"), F.col("rerank_score").alias("rerank")).alias("scores"), "file_type",
    )
    return r.orderBy("rank").select("rank", F.to_json(F.struct(*r.columns), {"ignoreNullFields": "false"}).alias("json"))


def explained(rows: DataFrame) -> DataFrame:
    """Result rows with the parts that made their score."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return rows.select("path", "chunk_id", "level", "score", reason(zero("vector_score"), zero("keyword_score"), zero("metadata_score"), zero("rerank_score")).alias("reason"))


def rendered(rows: list[Row], compact: bool = False) -> str:
    """A page of results as text."""
    out = []
    for i, r in enumerate(rows, 1):
        lines = f":{r.start_line}-{r.end_line}" if r.start_line is not None and r.end_line is not None else ""
        out.append(f"{i}. {r.path}{lines}  {r.score:.3f}  [{r.level}]")
        if not compact:
            out.append("   " + " ".join((r.snippet or "").split()))
    return "\n".join(out)
