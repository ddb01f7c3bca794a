"""Free-text retrieval over an index: lexical, vector and image branches, fused by the best score.

Only the branches a query needs are planned; each is a lazy DataFrame with the
result schema.  Nothing is collected before the final page, but for the reranker's pool.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuforge.functions.text import keyword_score, normalize
from docuforge.functions.vectors import centroids, cosine, hybrid, vector_literal
from docuforge.operators.changes import file_contents, first_characters
from docuforge.operators.lexical import bm25, matching, query_terms
from docuforge.operators.ranking import LEXICAL_WEIGHTS, apply_filters, cut, merge_reranked, result_rows, top_k


@dataclass
class Index:
    """The tables of an index; vector tables may be missing."""

    files: DataFrame  # file_id, path, content, file_type
    chunks: DataFrame  # chunk_id, file_id, chunk_index, text, start_line, end_line
    postings: DataFrame | None = None
    stats: DataFrame | None = None
    embeddings: DataFrame | None = None  # chunk_id, vector, of the active profile
    images: DataFrame | None = None  # image_id, file_id
    image_embeddings: DataFrame | None = None  # image_id, vector
    profile_hash: str = ""
    stem: bool = True

    def placed(self) -> DataFrame:
        return self.chunks.drop("path").join(self.files.select("file_id", "path", "file_type"), "file_id")


@dataclass
class Search:
    query: str
    mode: str = "hybrid"  # keyword, vector, hybrid
    level: str = "chunk"  # chunk, file, both
    kind: str = "all"  # all, text, image
    limit: int = 10
    weights: tuple[float, float, float] = (0.65, 0.30, 0.05)
    per_file: int = 3
    snippet_chars: int = 700
    file_types: list[str] = field(default_factory=list)
    path_pattern: str | None = None
    query_vector: list[float] | None = None
    image_vector: list[float] | None = None
    #: Apply filters before the candidates are cut, so that a page fills up; off keeps filters after the cut.
    prefilter: bool = False


def _scored(rows: DataFrame, s: Search, weights, text, vector=None) -> DataFrame:
    """Adds the three scores and their weighted mean."""
    rows = rows.withColumns({"keyword_score": keyword_score(s.query, text), "metadata_score": keyword_score(s.query, F.col("path")), "vector_score": F.lit(0.0) if vector is None else vector})
    if weights == "vector":
        return rows.withColumn("score", F.least(F.greatest(F.col("vector_score"), F.lit(0.0)), F.lit(1.0)))
    return rows.withColumn("score", hybrid(F.col("vector_score"), F.col("keyword_score"), F.col("metadata_score"), weights))


def _rows(rows: DataFrame, branch: int, s: Search, index: Index, level: str, kind: str = "text") -> DataFrame:
    return result_rows(rows, branch, kind=F.lit(kind), level=F.lit(level), mode=F.lit(s.mode), profile_hash=F.lit(index.profile_hash))


def lexical_chunks(index: Index, s: Search) -> DataFrame:
    """Chunks with any term, the best 4 * limit by BM25; the score itself is the keyword score."""
    ranked = bm25(index.postings, index.stats, query_terms(s.query, index.stem)).join(index.placed(), "chunk_id")
    ranked = _narrowed(ranked, s).orderBy(F.col("bm25").desc(), "path", "chunk_index").limit(4 * s.limit)
    rows = _scored(ranked, s, LEXICAL_WEIGHTS, F.concat_ws("\n", "path", "text"))
    return _rows(rows.withColumn("snippet", F.substring("text", 1, s.snippet_chars)), 0, s, index, "chunk")


def lexical_files(index: Index, s: Search) -> DataFrame:
    """Files with any term, the first ``limit`` by path, scored on their whole content.

    Only the page's files have their chunks joined, not the whole corpus.
    """
    hit = matching(index.postings, query_terms(s.query, index.stem)).join(index.chunks.select("chunk_id", "file_id"), "chunk_id").select("file_id").distinct()
    page = _narrowed(index.files, s).join(hit, "file_id", "left_semi").orderBy("path").limit(s.limit)
    content = file_contents(index.chunks.join(F.broadcast(page.select("file_id")), "file_id", "left_semi"), page.select("file_id", "path", "content"))
    rows = _scored(page.drop("content").join(content.drop("path"), "file_id"), s, LEXICAL_WEIGHTS, F.concat_ws("\n", "path", "content"))
    return _rows(rows.withColumn("snippet", F.substring("content", 1, s.snippet_chars)), 1, s, index, "file")


def vector_chunks(index: Index, s: Search) -> DataFrame:
    """Exact nearest chunks: a scan with a heap a partition.

    Texts are only fetched for chunks that can still be among the best 2 * limit: keyword and metadata
    scores add at most their weights, so a chunk further below the 2 * limit-th nearest than that is out.
    """
    near = index.embeddings.withColumn("vector_score", F.greatest(cosine(F.col("vector"), vector_literal(s.query_vector)), F.lit(0.0))).drop("vector")
    wv, wk, wm = s.weights
    if not s.prefilter and (s.mode == "vector" or (wv > 0 and min(wk, wm) >= 0)):
        near = near.join(index.chunks.select("chunk_id"), "chunk_id", "left_semi")
        page = near.select("vector_score").orderBy(F.col("vector_score").desc()).limit(2 * s.limit)
        slack = 0.0 if s.mode == "vector" else (wk + wm) / wv
        floor = page.agg((F.min("vector_score") - slack - 1e-9).alias("_floor"))  # one row
        near = near.crossJoin(F.broadcast(floor)).where(F.col("vector_score") >= F.col("_floor")).drop("_floor")
    rows = _scored(_narrowed(near.join(index.placed(), "chunk_id"), s), s, _weights(s), F.concat_ws("\n", "path", "text"), F.col("vector_score"))
    rows = _rows(rows.withColumn("snippet", F.substring("text", 1, s.snippet_chars)), 2, s, index, "chunk")
    return top_k(rows, 2 * s.limit)


def vector_files(index: Index, s: Search) -> DataFrame:
    """Files by the mean of their chunks' vectors, with a sample of their first characters."""
    placed = index.embeddings.join(index.chunks.select("chunk_id", "file_id"), "chunk_id")
    mean = centroids(placed, "file_id", "vector")
    near = mean.select("file_id", F.greatest(cosine(F.col("centroid"), vector_literal(s.query_vector)), F.lit(0.0)).alias("vector_score"))
    sample = first_characters(index.chunks.join(index.embeddings.select("chunk_id"), "chunk_id", "left_semi"), s.snippet_chars)
    rows = _narrowed(near.join(index.files.select("file_id", "path", "file_type"), "file_id"), s).join(sample, "file_id")
    rows = _scored(rows, s, _weights(s), F.concat_ws("\n", "path", "sample"), F.col("vector_score"))
    return top_k(_rows(rows.withColumn("snippet", F.col("sample")), 3, s, index, "file"), s.limit)


def image_paths(index: Index, s: Search) -> DataFrame:
    """Images whose path holds the query (``%`` and ``_`` are wildcards), the first 8 * limit by path, then the best 2 * limit."""
    low = F.lower(F.col("path"))
    pattern = "%" + s.query.lower().replace("\\", "\\\\") + "%"
    found = _narrowed(index.images.join(index.files.select("file_id", "path", "file_type"), "file_id"), s).where(low.like(pattern)).orderBy("path").limit(8 * s.limit)
    rows = found.withColumn("metadata_score", keyword_score(s.query, F.col("path"))).where("metadata_score > 0")
    rows = rows.withColumns({"score": F.col("metadata_score"), "keyword_score": F.lit(0.0), "vector_score": F.lit(0.0), "chunk_id": F.col("image_id"), "snippet": F.col("path")})
    return top_k(_rows(rows, 4, s, index, "image", "image"), 2 * s.limit)


def image_vectors(index: Index, s: Search) -> DataFrame:
    near = index.image_embeddings.withColumn("vector_score", F.greatest(cosine(F.col("vector"), vector_literal(s.image_vector)), F.lit(0.0))).drop("vector")
    rows = near.join(index.images, "image_id").join(index.files.select("file_id", "path", "file_type"), "file_id")
    rows = _scored(_narrowed(rows, s), s, _weights(s), F.lit(""), F.col("vector_score")).withColumn("keyword_score", F.lit(0.0))
    rows = rows.withColumns({"chunk_id": F.col("image_id"), "snippet": F.col("path")})
    return top_k(_rows(rows, 5, s, index, "image", "image"), 2 * s.limit)


def _weights(s: Search):
    return "vector" if s.mode == "vector" else s.weights


def _narrowed(rows: DataFrame, s: Search) -> DataFrame:
    if not s.prefilter:
        return rows
    if s.file_types:
        rows = rows.where(F.col("file_type").isin([t.strip().lstrip(".").lower() for t in s.file_types]))
    return rows.where(F.col("path").rlike(s.path_pattern)) if s.path_pattern else rows


def search(index: Index, s: Search, rerank=None, candidate_limit: int = 50) -> tuple[DataFrame, list[str]]:
    """(result rows, warnings).  ``rerank(query, texts)`` returns (index, score) pairs for the pool."""
    warnings, branches = [], []
    lexical, vector = s.mode != "vector", s.mode != "keyword"
    if s.kind != "image":
        if lexical and index.postings is not None and query_terms(s.query, index.stem):
            branches += [lexical_chunks] * (s.level != "file") + [lexical_files] * (s.level != "chunk")
        if vector and (index.embeddings is None or s.query_vector is None or index.embeddings.isEmpty()):
            if s.mode == "vector":
                raise ValueError("the active profile has no indexed embeddings")
            warnings.append("the active profile has no indexed embeddings")
        elif vector:
            branches += [vector_chunks] * (s.level != "file") + [vector_files] * (s.level != "chunk")
    if s.kind != "text" and index.images is not None:
        branches += [image_paths] * (lexical and bool(normalize(s.query)))
        if vector and index.image_embeddings is not None:
            if s.image_vector is not None:
                branches.append(image_vectors)
            elif s.kind == "image" or s.mode == "vector":
                raise ValueError("no vector for the image query")
            else:
                warnings.append("image vector search skipped: no vector for the query")
    if not branches:
        return result_rows(index.files.limit(0), 0), warnings
    rows = branches[0](index, s)
    for branch in branches[1:]:
        rows = rows.unionByName(branch(index, s))
    rows = apply_filters(rows, s.kind, s.file_types, s.path_pattern)
    if rerank is None:
        return cut(rows, s.limit, s.per_file), warnings
    return reranked(cut(rows, max(candidate_limit, s.limit), s.per_file), s, rerank, warnings), warnings


def reranked(pool: DataFrame, s: Search, rerank, warnings: list[str]) -> DataFrame:
    """The pool of at most ``candidate_limit`` rows, rescored and cut; an unreachable reranker leaves the order."""
    rows = top_k(pool, 1 << 20).collect()
    spark = pool.sparkSession
    texts = [f"image path: {r.path}" if r.kind == "image" else f"{r.path}\n{r.snippet}" for r in rows]
    try:
        found = list(rerank(s.query, texts)) if texts else []
    except OSError as e:
        warnings.append(f"reranker skipped: {e}")
        return cut(pool, s.limit, s.per_file)
    scores = spark.createDataFrame([(int(i), float(x), p) for p, (i, x) in enumerate(found) if 0 <= i < len(rows)], "index int, score double, position int")
    merged = merge_reranked(spark.createDataFrame(rows, pool.schema), scores).drop("position")
    return cut(merged.select(*pool.columns), s.limit, s.per_file)
