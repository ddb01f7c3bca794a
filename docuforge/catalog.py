"""Every operator as a query over the driver's tables, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuforge.functions import text as T
from docuforge.functions import vectors as V
from docuforge.functions.chunking import chunk_files
from docuforge.operators import changes as C
from docuforge.operators import lexical as L
from docuforge.operators import ranking as R
from docuforge.plans.reports import explained, index_counts, profile_counts, result_json
from docuforge.plans.search import Index, Search, search
from docuforge.providers import HashingProvider, embed_frame
from docuforge.sources.files import classify, document_files, read_table, turn_chunks
from docuforge.sources.globs import glob_pattern

QUERY = "the tion eaux"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Pieces of SQL shared by several queries.
_FILES = """files AS (SELECT doc_id AS file_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path,
  regexp_replace(text, '\\r\\n?', chr(10), 'g') AS content FROM documents)"""
_TURNS = """turns AS (SELECT conv_id * 100000 + turn AS chunk_id, conv_id AS file_id, turn AS chunk_index, 'chat/' || conv_id || '.md' AS path, text FROM conversations)"""


def _kw(text: str) -> str:
    t = f"lower({text})"
    return f"(CASE WHEN contains({t}, 'the tion eaux') THEN 1.0 ELSE (contains({t}, 'the')::INT + contains({t}, 'tion')::INT + contains({t}, 'eaux')::INT) / 3.0 END)::DOUBLE"


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.v)"
_Q0 = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c):
    return F.round(c, 6)


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    """The vector of vec_id 0: one row by its id."""
    return list(read_table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"])


# --- sources, projections, filters ----------------------------------------------


@query(f"WITH {_FILES} SELECT path, 'txt' AS file_type, octet_length(encode(content))::BIGINT AS size_bytes FROM files")
def files_projection(spark, sf):
    return document_files(spark, sf).select("path", "file_type", "size_bytes")


_PATHS = """paths AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'docs/a' || doc_id WHEN 1 THEN 'node_modules/p' || doc_id || '.js' WHEN 2 THEN 'img/logo' || doc_id || '.png'
 WHEN 3 THEN 'deep/er/x' || doc_id || '.lock' WHEN 4 THEN 'src/m' || doc_id || '.rs' WHEN 5 THEN 'sub/.git/n' || doc_id || '.md' ELSE 'bin/t' || doc_id || '.exe' END AS path FROM documents)"""


def _paths(spark, sf):
    d, n = read_table(spark, sf, "documents"), F.col("doc_id").cast("string")
    shapes = [("docs/a", ""), ("node_modules/p", ".js"), ("img/logo", ".png"), ("deep/er/x", ".lock"), ("src/m", ".rs"), ("sub/.git/n", ".md")]
    path = F.concat(F.lit("bin/t"), n, F.lit(".exe"))
    for i, (a, b) in enumerate(shapes):
        path = F.when(F.col("doc_id") % 7 == i, F.concat(F.lit(a), n, F.lit(b))).otherwise(path)
    return d.select("doc_id", path.alias("path"))


@query(f"""WITH {_PATHS} SELECT doc_id, path, CASE WHEN path LIKE 'node_modules/%' OR path LIKE '%.lock' THEN NULL WHEN path LIKE '%.png' THEN 'image'
 WHEN path LIKE 'docs/%' OR regexp_matches(path, '\\.(rs|js|md)$') THEN 'text' END AS kind FROM paths""")
def path_classify(spark, sf):
    return _paths(spark, sf).select("doc_id", "path", classify(F.col("path")).alias("kind"))


@query(f"WITH {_FILES} SELECT file_id, path FROM files WHERE path LIKE 'src1%/en/%' OR path LIKE 'src0/%'")
def filter_filetype_path(spark, sf):
    rows = document_files(spark, sf).withColumn("kind", F.lit("text"))
    return R.apply_filters(rows, "text", [" .TXT"], glob_pattern(["src1*/en/*", "src0/**"])).select("file_id", "path")


@query(f"""WITH {_FILES}, top AS (SELECT file_id, path, round({_kw("path || chr(10) || content")}, 6) AS s FROM files ORDER BY s DESC, path LIMIT 50)
 SELECT file_id, path, s AS score FROM top WHERE path LIKE '%/fr/%'""")
def post_filter_topk(spark, sf):
    rows = document_files(spark, sf).select("file_id", "path", r6(T.keyword_score(QUERY, F.concat_ws("\n", "path", "content"))).alias("score"))
    return rows.orderBy(F.col("score").desc(), "path").limit(50).where(F.col("path").contains("/fr/"))


@query(f"WITH {_FILES} SELECT file_id, path FROM files WHERE path = 'src3/en' OR starts_with(path, 'src3/en/')")
def scope_filter(spark, sf):
    return document_files(spark, sf).where(C.in_scope(F.col("path"), "src3/en")).select("file_id", "path")


# --- text functions -----------------------------------------------------------------


@query(f"SELECT doc_id, round({_kw('text')}, 6) AS score FROM documents")
def keyword_score_all(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", r6(T.keyword_score(QUERY, F.col("text"))).alias("score"))


@query(f"""WITH {_FILES}, s AS (SELECT file_id, path, {_kw("path || chr(10) || content")} AS k, {_kw("path")} AS m FROM files)
 SELECT file_id, path, round(least(greatest((k * 0.85 + m * 0.15) / 1.0, 0), 1), 6) AS score FROM s ORDER BY score DESC, round(k, 6) DESC, round(m, 6) DESC, path LIMIT 10""")
def keyword_topk(spark, sf):
    rows = document_files(spark, sf).withColumns({"k": T.keyword_score(QUERY, F.concat_ws("\n", "path", "content")), "m": T.keyword_score(QUERY, F.col("path"))})
    rows = rows.select("file_id", "path", r6(V.hybrid(F.lit(0.0), F.col("k"), F.col("m"), R.LEXICAL_WEIGHTS)).alias("score"), "k", "m")
    return rows.orderBy(F.col("score").desc(), r6(F.col("k")).desc(), r6(F.col("m")).desc(), "path").limit(10).select("file_id", "path", "score")


@query("SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS normalized FROM benchmark")
def normalize_query(spark, sf):
    return read_table(spark, sf, "benchmark").select("item_id", T.normalize_column(F.col("text")).alias("normalized"))


@query("SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^0-9a-z]+'), lambda x: x <> ''))), ' ') AS tokens FROM benchmark")
def unique_tokens(spark, sf):
    return read_table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(T.tokens_column(F.col("text"))), " ").alias("tokens"))


@query("SELECT doc_id, substring(text, 1, 700) AS snippet FROM documents")
def snippet_first_n(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("SELECT doc_id, trim(regexp_replace(substring(text, 1, 160), '\\s+', ' ', 'g')) AS snippet FROM documents")
def one_line_snippet(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.one_line(T.snippet(F.col("text"), 160)).alias("snippet"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS words FROM documents")
def word_count(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))


@query("SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents")
def line_range_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.line_range(F.col("text"), 2, 4).alias("lines"))


@query(f"""WITH {_TURNS} SELECT chunk_id, 'file:///corpus/chat/' || file_id || '.md#L' || (chunk_index + 1) AS uri, ':' || (chunk_index + 1) || '-' || (chunk_index + 2) AS suffix FROM turns""")
def source_uri(spark, sf):
    start = (F.col("chunk_index") + 1).cast("long")
    return turn_chunks(spark, sf).select("chunk_id", T.source_uri("/corpus", F.col("path"), start).alias("uri"), T.line_suffix(start, start + 1).alias("suffix"))


@query("SELECT page_id, sha256(html) AS hash FROM pages")
def content_hash(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", T.content_hash(F.col("html")).alias("hash"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&apos;', ''''), '&quot;', '\"') AS html FROM pages")
def xml_entities(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", T.xml_text(F.col("html")).alias("html"))


@query("SELECT item_id, string_agg(t, ' OR ' ORDER BY i) AS match_query FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS t, generate_subscripts(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 1) AS i FROM benchmark) GROUP BY item_id")
def match_query(spark, sf):
    return read_table(spark, sf, "benchmark").select("item_id", F.array_join(L.plain_tokens(F.col("text")), " OR ").alias("match_query"))


# --- vectors ----------------------------------------------------------------------------


@query(f"WITH {_Q0} SELECT vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.v), 6) AS dot FROM embeddings e, q")
def dot_product(spark, sf):
    q = V.vector_literal(query_vector(spark, sf))
    return read_table(spark, sf, "embeddings").select("vec_id", r6(V.dot(F.col("embedding"), q)).alias("dot"))


@query(f"WITH {_Q0} SELECT vec_id, round({_COS}, 6) AS cosine FROM embeddings e, q")
def cosine_similarity(spark, sf):
    q = V.vector_literal(query_vector(spark, sf))
    return read_table(spark, sf, "embeddings").select("vec_id", r6(V.cosine(F.col("embedding"), q)).alias("cosine"))


@query(f"WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0) SELECT vec_id, (q.query // 20)::INT AS query, round({_COS}, 6) AS cosine FROM embeddings e, q")
def cosine_query_batch(spark, sf):
    e = read_table(spark, sf, "embeddings")
    stated = e.where("vec_id % 20 = 0").select(F.expr("cast(vec_id div 20 as int)").alias("query"), "embedding")  # a stated query set, against all rows
    return V.cosine_batch(e, stated, "embedding", ["vec_id"], digits=6).select("vec_id", "query", "cosine")


@query(f"WITH {_Q0} SELECT vec_id, round(greatest({_COS}, 0), 6) AS score FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark, sf):
    q = V.vector_literal(query_vector(spark, sf))
    rows = read_table(spark, sf, "embeddings").select("vec_id", r6(F.greatest(V.cosine(F.col("embedding"), q), F.lit(0.0))).alias("score"))
    return rows.orderBy(F.col("score").desc(), "vec_id").limit(20)


_CENTROID = "c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i)"


@query(f"WITH {_CENTROID} SELECT label, i::INT AS i, round(m, 6) AS m FROM c")
def vector_centroid(spark, sf):
    c = V.centroids(read_table(spark, sf, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("i", "m")).select("label", (F.col("i") + 1).alias("i"), r6(F.col("m")).alias("m"))


@query(f"""WITH {_CENTROID}, v AS (SELECT label, list(m ORDER BY i) AS v FROM c GROUP BY label), {_Q0}
 SELECT label, round(greatest(list_cosine_similarity(v.v, q.v), 0), 6) AS score FROM v, q ORDER BY score DESC, label LIMIT 5""")
def vector_file_topk(spark, sf):
    q = V.vector_literal(query_vector(spark, sf))
    c = V.centroids(read_table(spark, sf, "embeddings"), "label", "embedding")
    return c.select("label", r6(F.greatest(V.cosine(F.col("centroid"), q), F.lit(0.0))).alias("score")).orderBy(F.col("score").desc(), "label").limit(5)


_HYBRID = f"""h AS (SELECT d.doc_id, greatest({_COS}, 0) AS v, {_kw("d.text")} AS k, {_kw("d.source")} AS m FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id, q)"""


@query(f"WITH {_Q0}, {_HYBRID} SELECT doc_id, round(least(greatest(v * 0.65 + k * 0.3 + m * 0.05, 0), 1), 6) AS score FROM h")
def hybrid_score(spark, sf):
    q = V.vector_literal(query_vector(spark, sf))
    rows = read_table(spark, sf, "documents").join(read_table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    v = F.greatest(V.cosine(F.col("embedding"), q), F.lit(0.0))
    return rows.select("doc_id", r6(V.hybrid(v, T.keyword_score(QUERY, F.col("text")), T.keyword_score(QUERY, F.col("source")), (0.65, 0.3, 0.05))).alias("score"))


# --- ranking -------------------------------------------------------------------------------


def _ranked(spark, sf):
    """Line items as result rows with plenty of ties."""
    li = read_table(spark, sf, "lineitem")
    rows = li.select(
        F.concat(F.lit("p/"), F.col("l_partkey").cast("string")).alias("path"), (F.col("l_quantity") / 100).alias("score"), F.lit("text").alias("kind"), (F.col("l_suppkey") % 50).alias("file_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("chunk_index"), F.col("l_tax").alias("vector_score"), F.col("l_discount").alias("keyword_score"), F.lit(0.0).alias("metadata_score"),
    )
    return R.result_rows(rows, 0, level=F.when(F.col("kind") == "text", F.lit("chunk")))


_RANKED = """r AS (SELECT 'p/' || l_partkey AS path, l_quantity / 100 AS score, l_suppkey % 50 AS file_id, l_orderkey * 10 + l_linenumber AS chunk_id,
 CASE WHEN l_linenumber > 1 THEN l_linenumber END AS chunk_index, l_tax AS v, l_discount AS k FROM lineitem)"""
_ORDER = "score DESC, v DESC, k DESC, path, file_id NULLS LAST, chunk_id NULLS LAST, chunk_index NULLS LAST"


@query(f"WITH {_RANKED} SELECT chunk_id, path, round(score, 6) AS score FROM r ORDER BY {_ORDER} LIMIT 100")
def topk_total_order(spark, sf):
    return R.top_k(_ranked(spark, sf), 100).select("chunk_id", "path", r6(F.col("score")).alias("score"))


@query(f"WITH {_RANKED} SELECT chunk_id, file_id FROM r QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY {_ORDER}) <= 3")
def per_file_cap(spark, sf):
    return R.cap_per_file(_ranked(spark, sf), 3).select("chunk_id", "file_id")


@query(f"WITH {_RANKED}, t AS (SELECT * FROM r ORDER BY {_ORDER} LIMIT 40) SELECT chunk_id, row_number() OVER (ORDER BY {_ORDER})::INT AS rank FROM t")
def rank_numbering(spark, sf):
    return R.numbered(R.top_k(_ranked(spark, sf), 40)).select("chunk_id", "rank")


@query("""WITH b AS (SELECT l_orderkey % 1000 AS chunk_id, round(max(l_quantity / 100), 6) AS score FROM lineitem GROUP BY 1) SELECT chunk_id, score FROM b""")
def dedup_max(spark, sf):
    rows = _ranked(spark, sf).withColumns({"chunk_id": F.floor(F.col("chunk_id") / 10) % 1000, "file_id": F.lit(1).cast("long")})
    return R.dedup_max(rows).select("chunk_id", r6(F.col("score")).alias("score"))


@query(f"""WITH {_Q0}, b AS (
 SELECT doc_id, 0 AS br, {_kw("text")} * 0.85 AS s FROM documents UNION ALL
 SELECT vec_id, 2, greatest({_COS}, 0) * 0.65 FROM embeddings e, q),
 best AS (SELECT doc_id, max(round(s, 6)) AS score FROM b GROUP BY doc_id), top AS (SELECT * FROM best ORDER BY score DESC, doc_id LIMIT 30),
 capped AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY doc_id % 7 ORDER BY score DESC, doc_id) <= 3)
 SELECT doc_id, doc_id % 7 AS file_id, score FROM capped ORDER BY score DESC, doc_id LIMIT 10""")
def hybrid_fusion_topk(spark, sf):
    q = V.vector_literal(query_vector(spark, sf))
    shape = lambda df, id_, branch, s: R.result_rows(df.select(F.col(id_).alias("chunk_id"), (F.col(id_) % 7).alias("file_id"), r6(s).alias("score")), branch, path=F.lit("x"), kind=F.lit("text"), level=F.lit("chunk"), file_id=F.col("file_id"))
    lexical = shape(read_table(spark, sf, "documents"), "doc_id", 0, T.keyword_score(QUERY, F.col("text")) * 0.85)
    vector = shape(read_table(spark, sf, "embeddings"), "vec_id", 2, F.greatest(V.cosine(F.col("embedding"), q), F.lit(0.0)) * 0.65)
    # The path orders before the ids: all rows share one, and the file id is only known by the chunk's.
    rows = lexical.unionByName(vector)
    best = R.dedup_max(rows).withColumn("path", F.lpad(F.col("chunk_id").cast("string"), 12, "0"))
    return R.top_k(R.cap_per_file(R.top_k(best, 30), 3), 10).select(F.col("chunk_id").alias("doc_id"), "file_id", "score")


# --- lexical ------------------------------------------------------------------------------------

_TOKENS = f"""{_TURNS}, tok AS (SELECT chunk_id, unnest(regexp_extract_all(lower(path || chr(10) || text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM turns),
 p AS (SELECT term, chunk_id, count(*) AS tf FROM tok GROUP BY ALL), st AS (SELECT chunk_id, count(*) AS dl FROM tok GROUP BY ALL), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM st)"""
_TERMS = "('the', 'tion', 'and', 'ich')"
_BM25 = f"""{_TOKENS}, d AS (SELECT term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM p, tot WHERE term IN {_TERMS} GROUP BY term, n),
 b AS (SELECT p.chunk_id, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS s FROM p JOIN d USING (term) JOIN st USING (chunk_id), tot GROUP BY 1)"""


def _lexical_index(spark, sf, stem=False):
    chunks = turn_chunks(spark, sf)
    return chunks, *L.build_index(chunks, stem)


@query(f"WITH {_TOKENS} SELECT DISTINCT chunk_id FROM p WHERE term IN {_TERMS}")
def fts_match(spark, sf):
    _, postings, _ = _lexical_index(spark, sf)
    return L.matching(postings, ["the", "tion", "and", "ich"])


@query(f"WITH {_BM25} SELECT chunk_id, round(s, 6) AS bm25 FROM b ORDER BY round(s, 6) DESC, chunk_id LIMIT 40")
def bm25_topk(spark, sf):
    _, postings, stats = _lexical_index(spark, sf)
    rows = L.bm25(postings, stats, ["the", "tion", "and", "ich"]).select("chunk_id", r6(F.col("bm25")).alias("bm25"))
    return rows.orderBy(F.col("bm25").desc(), "chunk_id").limit(40)


@query(f"WITH {_TOKENS} SELECT term, sum(tf)::BIGINT AS n, count(*)::BIGINT AS df FROM p GROUP BY term")
def postings_stats(spark, sf):
    _, postings, _ = _lexical_index(spark, sf)
    return postings.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))


@query()
def bm25_stemmed_topk(spark, sf):
    _, postings, stats = _lexical_index(spark, sf, stem=True)
    rows = L.bm25(postings, stats, L.query_terms("the tions and ich")).select("chunk_id", r6(F.col("bm25")).alias("bm25"))
    return rows.orderBy(F.col("bm25").desc(), "chunk_id").limit(40)


@query(f"WITH {_TURNS} SELECT file_id, string_agg(text, chr(10) ORDER BY chunk_index) AS content FROM turns GROUP BY file_id")
def group_concat(spark, sf):
    chunks = turn_chunks(spark, sf)
    files = chunks.select("file_id", "path").distinct().withColumn("content", F.lit(None).cast("string"))
    return C.file_contents(chunks, files).select("file_id", "content")


@query(f"WITH {_TURNS} SELECT file_id, substring(string_agg(text, chr(10) ORDER BY chunk_index), 1, 700) AS sample FROM turns GROUP BY file_id")
def file_sample(spark, sf):
    return C.first_characters(turn_chunks(spark, sf), 700)


@query(f"""WITH {_TOKENS}, f AS (SELECT file_id, path, string_agg(text, chr(10) ORDER BY chunk_index) AS content FROM turns WHERE file_id IN
 (SELECT file_id FROM turns WHERE chunk_id IN (SELECT chunk_id FROM p WHERE term IN ('the', 'tion', 'eaux'))) GROUP BY file_id, path ORDER BY path LIMIT 10)
 SELECT file_id, path, round({_kw("path || chr(10) || content")} * 0.85 + {_kw("path")} * 0.15, 6) AS score FROM f""")
def lexical_file(spark, sf):
    index = _index(spark, sf)
    rows, _ = search(index, Search(QUERY, mode="keyword", level="file", limit=10))
    return rows.select("file_id", "path", r6(F.col("score")).alias("score"))


# --- maintenance joins ------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5)")
def missing_embeddings(spark, sf):
    chunks = read_table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"))
    have = read_table(spark, sf, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return C.missing_embeddings(chunks, have, F.col("label") < 5).select(F.col("chunk_id").alias("doc_id"))


@query("SELECT e.vec_id, d.source, p.url FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id JOIN pages p ON p.page_id = e.vec_id")
def vector_scan_join(spark, sf):
    e, d, p = (read_table(spark, sf, n) for n in ("embeddings", "documents", "pages"))
    return e.join(d, e.vec_id == d.doc_id).join(p, e.vec_id == p.page_id).select("vec_id", "source", "url")


@query("SELECT s_suppkey AS profile, count(l_orderkey) AS embeddings FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def profile_embedding_counts(spark, sf):
    profiles = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("profile"))
    vectors = read_table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "profile")
    return profile_counts(profiles, vectors, "profile")


@query("""SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS files, (SELECT count(*) FROM conversations) AS chunks,
 (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT conv_id * 100000 + turn FROM conversations)) AS active_profile_embeddings,
 (SELECT count(*) FROM conversations) - (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT conv_id * 100000 + turn FROM conversations)) AS missing_active_profile_embeddings, 0::BIGINT AS query_embeddings""")
def index_status(spark, sf):
    chunks = turn_chunks(spark, sf)
    return index_counts(chunks.select("file_id").distinct(), chunks, read_table(spark, sf, "embeddings").withColumnRenamed("vec_id", "chunk_id"))


@query(f"WITH {_FILES} SELECT path FROM files WHERE starts_with(path, 'src1/') AND file_id % 3 <> 0")
def missing_file_diff(spark, sf):
    files = document_files(spark, sf)
    return C.vanished(files, files.where("file_id % 3 = 0"), "src1").select("path")


@query("""WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0),
 b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 11 <> 0)
 SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'insert' WHEN b.doc_id IS NULL THEN 'missing' WHEN a.h = b.h THEN 'unchanged' ELSE 'update' END AS action
 FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def upsert_diff(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("h"))
    new = d.where("doc_id % 11 <> 0").withColumn("h", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("h")))
    return C.upsert_actions(d.where("doc_id % 10 <> 0"), new, "doc_id", ["h"])


@query("SELECT DISTINCT conv_id FROM conversations WHERE (conv_id % 4 = 0 AND turn = 1) OR (conv_id % 5 = 0 AND turn = 0)")
def chunk_list_changed(spark, sf):
    c = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    new = c.where("not (conv_id % 4 = 0 and turn = 1)").withColumn("text", F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0), "changed").otherwise(F.col("text")))
    return C.changed_lists(c, new, "conv_id", "turn", ["text"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'))")
def cascade_delete(spark, sf):
    c = read_table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    orders = C.cascade(read_table(spark, sf, "orders"), c, "o_custkey").withColumnRenamed("o_orderkey", "l_orderkey")
    return C.cascade(read_table(spark, sf, "lineitem"), orders, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert_latest(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return C.latest(o, o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("Z")), ["o_orderkey"])


# --- composite retrieval -------------------------------------------------------------------------------


def _index(spark, sf, **more) -> Index:
    """Conversations as files of turns; every turn has one of the vectors."""
    c = read_table(spark, sf, "conversations")
    chunks = turn_chunks(spark, sf)
    chunks = chunks.withColumns({"start_line": F.col("chunk_index") + 1, "end_line": F.col("chunk_index") + 1})
    files = c.select(F.col("conv_id").alias("file_id")).distinct().select("file_id", F.concat(F.lit("chat/"), F.col("file_id").cast("string"), F.lit(".md")).alias("path"), F.lit(None).cast("string").alias("content"), F.lit("md").alias("file_type"))
    postings, stats = L.build_index(chunks, stem=False)
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").alias("vector"))
    of_turn = c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("chunk_id"), ((F.col("conv_id") * 7 + F.col("turn")) % e.count()).alias("n"))
    vectors = of_turn.join(e, "n").select("chunk_id", "vector")
    return Index(files, chunks, postings, stats, vectors, profile_hash="fixed", stem=False, **more)


# The branches of a search over turns, in SQL: rows (branch, level, path, file_id, chunk_id, chunk_index, text, score, v, k, m).
_ORDERED = "score DESC, v DESC, k DESC, m DESC, path, file_id, chunk_id NULLS LAST"
_VECTORS = f"""{_Q0}, vec AS (SELECT conv_id * 100000 + turn AS chunk_id, conv_id AS file_id, e.embedding::DOUBLE[] AS v FROM conversations JOIN embeddings e ON e.vec_id = (conv_id * 7 + turn) % (SELECT count(*) FROM embeddings)),
 near AS (SELECT t.*, greatest(list_cosine_similarity(vec.v, q.v), 0) AS v, {_kw("path || chr(10) || text")} AS k, {_kw("path")} AS m FROM turns t JOIN vec USING (chunk_id), q)"""
_LEXICAL = f"""terms AS (SELECT term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM p, tot WHERE term IN ('the', 'tion', 'eaux') GROUP BY term, n),
 bm AS (SELECT p.chunk_id, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS s FROM p JOIN terms USING (term) JOIN st USING (chunk_id), tot GROUP BY 1),
 cand AS (SELECT turns.*, {_kw("path || chr(10) || text")} AS k, {_kw("path")} AS m FROM bm JOIN turns USING (chunk_id) ORDER BY s DESC, path, chunk_index LIMIT 40),
 lexical AS (SELECT 0 AS branch, 'chunk' AS level, path, file_id, chunk_id, text, least(greatest(k * 0.85 + m * 0.15, 0), 1) AS score, 0.0::DOUBLE AS v, k, m FROM cand)"""
_FUSED_CHUNKS = f"""vectors AS (SELECT 2 AS branch, 'chunk' AS level, path, file_id, chunk_id, text, least(greatest(v * 0.65 + k * 0.3 + m * 0.05, 0), 1) AS score, v, k, m FROM near ORDER BY {_ORDERED} LIMIT 20)"""
_WHOLE = f"""whole AS (SELECT file_id, path, string_agg(text, chr(10) ORDER BY chunk_index) AS content FROM turns GROUP BY file_id, path),
 page AS (SELECT * FROM whole WHERE file_id IN (SELECT file_id FROM turns WHERE chunk_id IN (SELECT chunk_id FROM p WHERE term IN ('the', 'tion', 'eaux'))) ORDER BY path LIMIT 10),
 lexical_files AS (SELECT 1 AS branch, 'file' AS level, path, file_id, NULL::BIGINT AS chunk_id, content AS text, least(greatest(k * 0.85 + m * 0.15, 0), 1) AS score, 0.0::DOUBLE AS v, k, m FROM (SELECT *, {_kw("path || chr(10) || content")} AS k, {_kw("path")} AS m FROM page)),
 mean AS (SELECT file_id, list(x ORDER BY i) AS c FROM (SELECT file_id, i, avg(x) AS x FROM (SELECT file_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec) GROUP BY file_id, i) GROUP BY file_id),
 near_files AS (SELECT whole.*, greatest(list_cosine_similarity(mean.c, q.v), 0) AS v, {_kw("path || chr(10) || substring(content, 1, 700)")} AS k, {_kw("path")} AS m FROM whole JOIN mean USING (file_id), q),
 vector_files AS (SELECT 3 AS branch, 'file' AS level, path, file_id, NULL::BIGINT AS chunk_id, content AS text, least(greatest(v * 0.65 + k * 0.3 + m * 0.05, 0), 1) AS score, v, k, m FROM near_files ORDER BY {_ORDERED} LIMIT 10)"""


def _cut_sql(rows: str, n: int, name: str = "result") -> str:
    """Best row a (file, chunk, level), enough for the cap, the cap of 3 chunks a file, the first ``n``."""
    return f"""{name}_best AS (SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY file_id, chunk_id, level ORDER BY score DESC, branch) = 1),
 {name}_top AS (SELECT * FROM {name}_best ORDER BY {_ORDERED} LIMIT {3 * n}),
 {name}_capped AS (SELECT * FROM {name}_top QUALIFY level <> 'chunk' OR row_number() OVER (PARTITION BY file_id, level ORDER BY {_ORDERED}) <= 3),
 {name} AS (SELECT * FROM {name}_capped ORDER BY {_ORDERED} LIMIT {n})"""


_BOTH = "SELECT * FROM lexical UNION ALL SELECT * FROM vectors"


@query(f"""WITH {_TOKENS}, {_VECTORS}, {_LEXICAL}, {_FUSED_CHUNKS}, {_WHOLE}, {_cut_sql(_BOTH + " UNION ALL SELECT * FROM lexical_files UNION ALL SELECT * FROM vector_files", 10)}
 SELECT path, level, coalesce(chunk_id, -1) AS chunk_id, round(score, 6) AS score FROM result""")
def search_hybrid(spark, sf):
    s = Search(QUERY, level="both", query_vector=query_vector(spark, sf))
    return search(_index(spark, sf), s)[0].select("path", "level", F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"), r6(F.col("score")).alias("score"))


@query(f"""WITH {_TURNS}, {_VECTORS}, vectors AS (SELECT 2 AS branch, 'chunk' AS level, path, file_id, chunk_id, text, least(v, 1) AS score, v, k, m FROM near ORDER BY {_ORDERED} LIMIT 20), {_cut_sql("SELECT * FROM vectors", 10)}
 SELECT path, level, chunk_id, round(score, 6) AS score FROM result""")
def search_vector(spark, sf):
    s = Search(QUERY, mode="vector", query_vector=query_vector(spark, sf))
    return search(_index(spark, sf), s)[0].select("path", "level", "chunk_id", r6(F.col("score")).alias("score"))


@query(f"""WITH {_TOKENS}, d AS (SELECT term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM p, tot WHERE term IN ('the', 'tion', 'eaux') GROUP BY term, n),
 b AS (SELECT p.chunk_id, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS s FROM p JOIN d USING (term) JOIN st USING (chunk_id), tot GROUP BY 1),
 cand AS (SELECT turns.*, {_kw("path || chr(10) || text")} AS k, {_kw("path")} AS m FROM b JOIN turns USING (chunk_id) ORDER BY s DESC, path, chunk_index LIMIT 40),
 sc AS (SELECT *, least(greatest(k * 0.85 + m * 0.15, 0), 1) AS score FROM cand),
 top AS (SELECT * FROM sc ORDER BY score DESC, k DESC, m DESC, path, file_id, chunk_id LIMIT 30),
 cap AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY score DESC, k DESC, m DESC, path, chunk_id) <= 3)
 SELECT chunk_id, path, round(score, 6) AS score FROM cap ORDER BY score DESC, k DESC, m DESC, path, chunk_id LIMIT 10""")
def search_keyword(spark, sf):
    return search(_index(spark, sf), Search(QUERY, mode="keyword"))[0].select("chunk_id", "path", r6(F.col("score")).alias("score"))


@query(f"""WITH {_TOKENS}, {_LEXICAL}, {_cut_sql("SELECT * FROM lexical", 50, "pool")},
 numbered AS (SELECT *, row_number() OVER (ORDER BY {_ORDERED}) AS n, length(path || chr(10) || substring(text, 1, 700)) / 1000.0::DOUBLE AS longest FROM pool),
 judged AS (SELECT * REPLACE (coalesce(CASE WHEN row_number() OVER (ORDER BY longest DESC, n) <= 5 THEN longest END, score) AS score), CASE WHEN row_number() OVER (ORDER BY longest DESC, n) <= 5 THEN longest END AS rerank_score FROM numbered),
 {_cut_sql("SELECT * FROM judged", 10)} SELECT path, chunk_id, round(score, 6) AS score, round(rerank_score, 6) AS rerank_score FROM result""")
def search_reranked(spark, sf):
    longest = lambda q, texts: sorted(((i, len(t) / 1000) for i, t in enumerate(texts)), key=lambda x: -x[1])[:5]
    return search(_index(spark, sf), Search(QUERY, mode="keyword"), longest)[0].select("path", "chunk_id", r6(F.col("score")).alias("score"), r6(F.col("rerank_score")).alias("rerank_score"))


@query(f"""WITH {_TOKENS}, {_VECTORS}, {_LEXICAL}, {_FUSED_CHUNKS}, {_cut_sql(_BOTH, 10)}
 SELECT path, chunk_id, level, round(score, 6) AS score, array_to_string(list_filter([CASE WHEN v > 0 THEN 'vector' END, CASE WHEN k > 0 THEN 'keyword' END, CASE WHEN m > 0 THEN 'metadata' END], lambda x: x IS NOT NULL), ' + ') AS reason FROM result""")
def search_explained(spark, sf):
    s = Search(QUERY, query_vector=query_vector(spark, sf))
    return explained(search(_index(spark, sf), s)[0]).withColumn("score", r6(F.col("score")))


@query()
def search_json(spark, sf):
    return result_json(search(_index(spark, sf), Search(QUERY, mode="keyword"))[0])


@query("""WITH t AS (SELECT page_id, url FROM pages WHERE lower(url) LIKE '%example.net%' ORDER BY url, page_id LIMIT 80)
 SELECT page_id, url AS path FROM t ORDER BY url, page_id LIMIT 20""")
def image_path_like(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    found = p.where(F.lower("path").like("%example.net%")).orderBy("path", "page_id").limit(80)
    return found.where(T.keyword_score("example.net", F.col("path")) > 0).orderBy("path", "page_id").limit(20)


_IMAGES = "img AS (SELECT doc_id, 'img/' || source || '_' || doc_id || '.png' AS path FROM documents)"


def _image_index(spark, sf) -> Index:
    """Documents as images, with the vectors of the same numbers."""
    d = read_table(spark, sf, "documents")
    path = F.concat(F.lit("img/"), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".png"))
    files = d.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.lit(None).cast("string").alias("content"), F.lit("png").alias("file_type"))
    vectors = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("vector"))
    chunks = spark.createDataFrame([], "chunk_id long, file_id long, chunk_index long, text string, start_line long, end_line long")
    return Index(files, chunks, images=d.select(F.col("doc_id").alias("image_id"), F.col("doc_id").alias("file_id")), image_embeddings=vectors)


@query(f"""WITH {_Q0}, {_IMAGES}, b AS (SELECT doc_id, path, round(greatest({_COS}, 0), 6) AS score FROM img JOIN embeddings e ON e.vec_id = doc_id, q)
 SELECT doc_id, path, score FROM b ORDER BY score DESC, path LIMIT 10""")
def image_vector_topk(spark, sf):
    s = Search("src1_", mode="vector", kind="image", image_vector=query_vector(spark, sf))
    return search(_image_index(spark, sf), s)[0].select(F.col("chunk_id").alias("doc_id"), "path", r6(F.col("score")).alias("score"))


@query(f"WITH {_IMAGES} SELECT doc_id, path, 1.0::DOUBLE AS score FROM img WHERE lower(path) LIKE '%src1_%' ORDER BY path LIMIT 10")
def search_images(spark, sf):
    s = Search("src1_", kind="image", image_vector=query_vector(spark, sf))
    return search(_image_index(spark, sf), s)[0].select(F.col("chunk_id").alias("doc_id"), "path", r6(F.col("score")).alias("score"))


# --- chunking and embedding ------------------------------------------------------------------------------


@query(f"""WITH {_FILES} SELECT file_id, 0::BIGINT AS chunk_index, 1::BIGINT AS start_line,
 greatest(len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END, 1)::BIGINT AS end_line, length(content)::BIGINT AS n FROM files""")
def chunk_off(spark, sf):
    c = chunk_files(document_files(spark, sf), "off", keep=["file_id"])
    return c.select("file_id", "chunk_index", "start_line", "end_line", F.char_length("text").cast("long").alias("n"))


@query(f"""WITH RECURSIVE {_FILES}, l AS (SELECT file_id, string_split(CASE WHEN ends_with(content, chr(10)) THEN content[:-2] ELSE content END, chr(10)) AS lines FROM files WHERE content <> ''),
 w AS (SELECT file_id, lines, list_transform(lines, lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> ''))) AS n, list_transform(lines, lambda x: octet_length(encode(x))) AS b FROM l),
 step AS (SELECT file_id, lines, n, b, 1::BIGINT AS s, 0::BIGINT AS e, 0::BIGINT AS k, 0::BIGINT AS emitted FROM w
  UNION ALL
  SELECT file_id, lines, n, b, nxt AS s, en AS e, k + 1, s AS emitted FROM (
   SELECT *, CASE WHEN en >= len(n) THEN len(n) + 1 ELSE CASE WHEN back <= s THEN least(s + 1, en + 1) ELSE back END END AS nxt FROM (
    SELECT *, coalesce(list_max(list_filter(range(s, en + 1), lambda i: list_sum(n[i:en]) >= 20)), s) AS back FROM (
     SELECT *, coalesce(list_min(list_filter(range(s, len(n) + 1), lambda i: (list_sum(n[s:i]) >= 120 AND list_sum(b[s:i]) + i - s >= 80) OR (i < len(n) AND list_sum(n[s:i + 1]) > 200) OR i = len(n))), len(n)) AS en
     FROM step WHERE s <= len(n)))))
 SELECT file_id, k - 1 AS chunk_index, emitted AS start_line, e AS end_line FROM step WHERE k > 0""")
def chunk_line_window(spark, sf):
    c = chunk_files(document_files(spark, sf), "line-window", keep=["file_id"], target=120, most=200, overlap=20, min_bytes=80)
    return c.select("file_id", "chunk_index", "start_line", "end_line")


@query()
def chunk_smart_text(spark, sf):
    return chunk_files(document_files(spark, sf), keep=["file_id", "path"]).select("file_id", "chunk_index", "chunk_type", "title", "start_line", "end_line", "text")


@query()
def chunk_smart_html(spark, sf):
    pages = read_table(spark, sf, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return chunk_files(pages, keep=["page_id", "path"]).select("page_id", "chunk_index", "language", "chunk_type", "title", "start_line", "end_line", "text")


@query()
def chunk_smart_json(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.col("props").alias("content"))
    return chunk_files(events, keep=["event_id", "path"]).select("event_id", "chunk_index", "chunk_type", "title", "text")


@query()
def embed_batch(spark, sf):
    c = turn_chunks(spark, sf)
    return embed_frame(c, HashingProvider(32), "text", ["chunk_id"]).select("chunk_id", F.transform("vector", lambda x: F.round(x.cast("double"), 6)).alias("vector"))


# --- streams, as the same operator runs on a batch -----------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, sf):
    from docuforge.streaming.incremental import windowed_counts

    w = windowed_counts(read_table(spark, sf, "events"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH img AS (SELECT doc_id AS image_id, md5(source) AS hash FROM documents), vec AS (SELECT vec_id AS image_id, md5(source) AS hash FROM embeddings JOIN documents ON doc_id = vec_id WHERE label < 5)
 SELECT image_id FROM img WHERE NOT EXISTS (SELECT 1 FROM vec WHERE vec.image_id = img.image_id AND vec.hash = img.hash)""")
def missing_images(spark, sf):
    from docuforge.plans.indexing import missing_images as missing

    images = read_table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), F.md5("source").alias("hash"))
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.when(F.col("label") < 5, "p").otherwise("other").alias("profile_hash"))
    return missing(images, e.join(images, "image_id"), "p").select("image_id")


from docuforge import catalog_chunks  # noqa: E402

QUERIES |= catalog_chunks.QUERIES
ORACLES |= catalog_chunks.ORACLES
