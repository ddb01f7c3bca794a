"""The inverted index and BM25 as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuforge.functions.stemming import index_tokens, stemmed
from docuforge.functions.text import match_terms

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def plain_tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, on the JVM."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def build_index(chunks: DataFrame, stem: bool = True, id_col: str = "chunk_id", path_col: str = "path", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings(term, chunk_id, tf), stats(chunk_id, dl)) over path and text together.

    Term counts combine before the shuffle; write postings partitioned or bucketed by term for
    repeated queries.  Null path or text counts as empty.
    """
    text = F.concat_ws("\n", F.col(path_col), F.col(text_col))
    tokens = chunks.select(F.col(id_col).alias("chunk_id"), (stemmed if stem else plain_tokens)(text).alias("_t"))
    stats = tokens.select("chunk_id", F.size("_t").cast("long").alias("dl"))
    postings = tokens.select("chunk_id", F.explode("_t").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))
    return postings, stats


def query_terms(query: str, stem: bool = True) -> list[str]:
    return index_tokens(query) if stem else match_terms(query)


def matching(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Ids of chunks that hold any of the terms; none without terms."""
    return postings.where(F.col("term").isin(terms) if terms else F.lit(False)).select("chunk_id").distinct()


def bm25(postings: DataFrame, stats: DataFrame, terms: list[str]) -> DataFrame:
    """(chunk_id, bm25), best highest; a term repeated in the query counts as often.

    The query's terms are pushed to the scan of the postings; corpus totals are
    one row, document frequencies one row a term: these small sides are bounded by the query and broadcast.
    """
    times = {t: float(terms.count(t)) for t in terms}
    mine = postings.where(F.col("term").isin(list(times)) if times else F.lit(False))
    totals = stats.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = mine.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.lit(0.0)
    for t, n in times.items():
        weight = F.when(F.col("term") == t, n).otherwise(weight)
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    frequent = df.crossJoin(F.broadcast(totals)).select("term", (weight * idf).alias("w"), "avgdl")
    scored = mine.join(F.broadcast(frequent), "term").join(stats, "chunk_id")
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("chunk_id").agg(F.sum(part).alias("bm25"))
