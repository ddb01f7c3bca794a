"""Relational maintenance: missing rows, upserts, cascading deletes, latest versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, profile: Column | None = None) -> DataFrame:
    """Chunks without a vector (of the profile)."""
    have = embeddings if profile is None else embeddings.where(profile)
    return chunks.join(have.select("chunk_id"), "chunk_id", "left_anti")


def in_scope(path: Column, scope: str) -> Column:
    """The path itself or anything below it; an empty scope is everything."""
    return F.lit(True) if not scope else (path == scope) | path.startswith(scope.rstrip("/") + "/")


def vanished(files: DataFrame, discovered: DataFrame, scope: str = "") -> DataFrame:
    """Files in scope that were not discovered."""
    return files.where(in_scope(F.col("path"), scope)).join(discovered.select("path"), "path", "left_anti")


def upsert_actions(old: DataFrame, new: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, action): insert, update, unchanged or missing, by a full outer join and null-safe comparison."""
    o, n = old.select(key, *compared, F.lit(True).alias("_o")).alias("o"), new.select(key, *compared, F.lit(True).alias("_n")).alias("n")
    same = reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in compared], F.lit(True))
    action = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "missing").when(same, "unchanged").otherwise("update")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), action.alias("action"))


def changed_lists(old: DataFrame, new: DataFrame, parent: str, position: str, compared: list[str]) -> DataFrame:
    """Parents whose ordered lists of children differ in length or at any position."""
    rows = upsert_actions(*[d.withColumn("_at", F.struct(parent, position)) for d in (old, new)], "_at", compared)
    return rows.where("action <> 'unchanged'").select(F.col(f"_at.{parent}").alias(parent)).distinct()


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent survives."""
    return children.join(parents.select(key), key, "left_semi")


def latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of ``new`` replace rows of ``old`` with the same key; last writer wins without a sort."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def file_contents(chunks: DataFrame, files: DataFrame, separator: str = "\n") -> DataFrame:
    """(file_id, path, content): a file's content, or its chunks joined in order where it is not stored."""
    joined = chunks.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), separator).alias("_joined"))
    return files.join(joined, "file_id", "left").select("file_id", "path", F.coalesce("content", "_joined").alias("content"))


def first_characters(chunks: DataFrame, n: int) -> DataFrame:
    """(file_id, sample): the first n characters of a file's chunks joined by line breaks.

    Only chunks that can reach into the sample are gathered: each is cut to n characters before the shuffle.
    """
    rows = chunks.select("file_id", "chunk_index", F.substring("text", 1, n).alias("text"))
    parts = rows.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("_c"))
    return parts.select("file_id", F.substring(F.array_join(F.transform("_c", lambda x: x["text"]), "\n"), 1, n).alias("sample"))
