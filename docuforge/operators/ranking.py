"""Ranking: one result schema for all retrieval branches, a total order, fusion, caps and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a ranked result and their types.
RESULT = {
    "path": "string", "snippet": "string", "score": "double", "rerank_score": "double", "kind": "string", "file_type": "string", "file_id": "bigint", "chunk_id": "bigint", "chunk_index": "bigint",
    "start_line": "bigint", "end_line": "bigint", "keyword_score": "double", "vector_score": "double", "metadata_score": "double", "profile_hash": "string", "mode": "string", "level": "string",
}
LEXICAL_WEIGHTS = (0.0, 0.85, 0.15)


def result_rows(df: DataFrame, branch_rank: int, **values: Column) -> DataFrame:
    """``df`` as result rows of one branch; columns neither given nor present are null."""
    cols = [values.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in RESULT.items()]
    return df.select(*cols, F.lit(branch_rank).alias("branch_rank"))


def rank_order() -> list[Column]:
    """Scores downwards, then path and kind, then ids and lines with nulls last."""
    down = [F.col(c).desc() for c in ("score", "vector_score", "keyword_score", "metadata_score")]
    up = [F.col(c).asc_nulls_last() for c in ("file_id", "chunk_id", "chunk_index", "start_line", "end_line")]
    return [*down, F.col("path").asc(), F.col("kind").asc(), *up]


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """The first k rows in rank order: a heap a partition, merged (TakeOrderedAndProject)."""
    return rows.orderBy(*rank_order()).limit(k)


def dedup_max(rows: DataFrame) -> DataFrame:
    """One row a (file, chunk, level): the best score, on ties the earlier branch.

    An aggregation to a maximum combines on the map side, so repeats of a hot row never meet in one task.
    """
    keys = ["file_id", "chunk_id", "level"]
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(F.col("score"), (-F.col("branch_rank")).alias("_b"), *[F.col(c).alias(f"_{c}") for c in rest])
    best = rows.groupBy(*keys).agg(F.max(order).alias("_x"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_x._{c}").alias(c) for c in rows.columns])


def cap_per_file(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` chunk-level rows a file, in rank order; other levels and rows without a file are not capped."""
    counted = (F.col("level") == "chunk") & F.col("file_id").isNotNull()
    w = Window.partitionBy("file_id").orderBy(*rank_order())
    capped = rows.where(counted).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    return capped.unionByName(rows.where(F.coalesce(~counted, F.lit(True))))


def cut(rows: DataFrame, n: int, per_file: int) -> DataFrame:
    """Deduplicate, take enough rows for the cap, cap, take n: may return fewer than n."""
    return top_k(cap_per_file(top_k(dedup_max(rows), n * max(per_file, 1)), per_file), n)


def numbered(rows: DataFrame) -> DataFrame:
    """Result rows with their rank from 1; only for rows already cut to a page."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())))


def apply_filters(rows: DataFrame, kind: str = "all", file_types: list[str] | None = None, path_pattern: str | None = None) -> DataFrame:
    """Kind, file type and path filters; an empty filter lets all pass."""
    if kind == "text":
        rows = rows.where(F.col("kind") != "image")
    elif kind == "image":
        rows = rows.where(F.col("kind") == "image")
    if file_types:
        rows = rows.where(F.col("file_type").isin([t.strip().lstrip(".").lower() for t in file_types]))
    return rows.where(F.col("path").rlike(path_pattern)) if path_pattern else rows


def merge_reranked(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Result rows with reranker scores by position (from 0): the first score of an index counts, unknown indexes are dropped, rows without one keep theirs.

    ``scores``: (index, score, position).  Rows that got a score come first, in the order they were returned.
    """
    first = scores.groupBy("index").agg(F.min(F.struct("position", "score")).alias("_s"))
    indexed = rows.withColumn("_i", F.row_number().over(Window.orderBy(*rank_order())) - 1)
    merged = indexed.join(first, indexed["_i"] == first["index"], "left")
    merged = merged.withColumn("rerank_score", F.col("_s.score").cast("double")).withColumn("score", F.coalesce(F.col("_s.score").cast("double"), F.col("score")))
    return merged.withColumn("position", F.coalesce(F.col("_s.position").cast("long"), F.lit(1 << 40) + F.col("_i"))).drop("_i", "_s", "index")
