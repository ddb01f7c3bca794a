import json

import pytest

from docuforge.plans.indexing import Options, dry_run, embed_missing, as_files, index, remove
from docuforge.plans.reports import index_counts, rendered, result_json
from docuforge.plans.search import Index, Search, search
from docuforge.providers import HashingProvider, QueryCache
from docuforge.sources.store import ConflictError, Store

TEXTS = {"docs/agents.md": "# Agent editing rules\n\nUse small patches for manual edits.\nKeep tests current.\n", "README.md": "This program indexes local documents.\n", "docs/old.md": "gone soon\n"}


def texts(spark, d):
    return spark.createDataFrame(list(d.items()), "path string, text string")


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "index"))
    index(s, texts(spark, TEXTS))
    return s


def opened(store, provider=None):
    t = {n: store.read(n) for n in ("files", "chunks", "postings", "stats")}
    e = store.read("embeddings").where(f"profile_hash = '{provider.profile.hash}'") if provider else None
    return Index(t["files"], t["chunks"], t["postings"], t["stats"], e)


def test_index_is_incremental(spark, store):
    assert store.read("files").count() == 3
    before = {r.path: r.chunk_id for r in store.read("chunks").collect()}
    assert dry_run(store, as_files(texts(spark, TEXTS)), Options()) == {"unchanged": 3}
    new = {**TEXTS, "README.md": "Changed.\n", "docs/new.md": "n\n"}
    del new["docs/old.md"]
    assert index(store, texts(spark, new)) == {"discovered": 3, "changed": 2, "removed": 1}
    paths = sorted(r.path for r in store.read("chunks").collect())
    assert paths == ["README.md", "docs/agents.md", "docs/new.md"]
    assert {r.path: r.chunk_id for r in store.read("chunks").collect()}["docs/agents.md"] == before["docs/agents.md"]
    assert store.vacuum() > 0 and store.read("files").count() == 3


def test_changed_chunking_is_noticed(spark, store):
    assert index(store, texts(spark, TEXTS), Options(chunking="off")) == {"discovered": 3, "changed": 3, "removed": 0}
    assert {r.chunk_type for r in store.read("chunks").collect()} == {"off"}
    assert index(store, texts(spark, TEXTS), Options(chunking="off"))["changed"] == 0


def test_postings_follow_the_chunks(spark, store):
    """After changes, the kept and the new postings are those of an index built at once."""
    from docuforge.operators.lexical import build_index

    index(store, texts(spark, {**TEXTS, "README.md": "Changed words.\n", "docs/new.md": "words\n"}))
    index(store, texts(spark, {"docs/new.md": "words again\n"}), upsert=True)
    postings, stats = build_index(store.read("chunks"))
    rows = lambda df: sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())
    assert rows(store.read("postings")) == rows(postings) and rows(store.read("stats")) == rows(stats)


def test_one_commit_and_conflicts(spark, store):
    before = store.manifest()
    change = store.begin()
    index(store, texts(spark, {**TEXTS, "x.md": "more\n"}))
    after = store.manifest()
    assert {n for n in after["tables"] if after["tables"][n] != before["tables"].get(n)} == {"files", "chunks", "embeddings", "postings", "stats"}
    assert len({f.split("/")[1] for f in after["tables"].values()}) == 1
    change.put("stats", store.read("stats").limit(0))
    with pytest.raises(ConflictError):
        change.commit()
    assert store.manifest() == after


def test_image_index(spark, tmp_path):
    from docuforge.plans import indexing

    class Images:
        dimensions = 2

        def images(self, encoded):
            if "YmFk" in encoded:
                raise ValueError("no image")
            return [[float(len(x)), 1.0] for x in encoded]

    s = Store(spark, str(tmp_path / "index"))
    frame = lambda d: spark.createDataFrame([(p, bytearray(b)) for p, b in d.items()], "path string, content binary")
    first = {"img/a.png": b"aaaa", "img/b.png": b"bad", "pics/c.png": b"cc"}
    assert indexing.index_images(s, frame(first)) == {"discovered": 3, "changed": 3, "removed": 0}
    assert indexing.embed_missing_images(s, frame(first), Images(), "p") == {"embedded": 2, "failed": 1}
    assert indexing.embed_missing_images(s, frame(first), Images(), "p") == {"embedded": 0, "failed": 1}
    then = {"img/a.png": b"changed", "img/d.png": b"d"}
    assert indexing.index_images(s, frame(then), "img") == {"discovered": 2, "changed": 2, "removed": 1}
    assert {r.path for r in s.read("image_files").collect()} == {"img/a.png", "img/d.png", "pics/c.png"}
    assert s.read("image_embeddings").count() == 1
    assert indexing.embed_missing_images(s, frame(then), Images(), "p") == {"embedded": 2, "failed": 0}


def test_scope_limits_removal(spark, store):
    out = index(store, texts(spark, {"docs/agents.md": TEXTS["docs/agents.md"]}), Options(scope="docs"))
    assert out == {"discovered": 1, "changed": 0, "removed": 1}
    assert sorted(r.path for r in store.read("files").collect()) == ["README.md", "docs/agents.md"]


def test_modes(spark, tmp_path):
    s = Store(spark, str(tmp_path / "off"))
    index(s, texts(spark, {"a.txt": "1\n2\n3\n4\n5\n"}), Options(chunking="off", store_full_files=False))
    c = s.read("chunks").first()
    assert (c.start_line, c.end_line, c.text) == (1, 5, "1\n2\n3\n4\n5\n") and s.read("files").first().content is None
    story = "\n".join(f"w{i} x{i}" for i in range(6))
    s = Store(spark, str(tmp_path / "window"))
    index(s, texts(spark, {"a.txt": story}), Options(chunking="line-window", target_tokens=4, max_tokens=6, overlap_tokens=2, min_chunk_chars=1))
    assert [(r.start_line, r.end_line) for r in s.read("chunks").orderBy("chunk_index").collect()] == [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)]
    s = Store(spark, str(tmp_path / "none"))
    index(s, texts(spark, {"a.txt": story}), Options(store_chunks=False))
    assert s.read("chunks").count() == 0


def test_embedding_and_cascade(spark, store):
    p = HashingProvider(16)
    assert embed_missing(store, p) == store.read("chunks").count() and embed_missing(store, p) == 0
    counts = index_counts(store.read("files"), store.read("chunks"), store.read("embeddings")).first()
    assert counts.missing_active_profile_embeddings == 0
    assert embed_missing(store, HashingProvider(8)) > 0
    new = {**TEXTS, "README.md": "Changed.\n"}
    index(store, texts(spark, new))
    counts = index_counts(store.read("files"), store.read("chunks"), store.read("embeddings").where(f"profile_hash = '{p.profile.hash}'")).first()
    assert counts.missing_active_profile_embeddings == 1
    assert remove(store, "docs/") == 2 and remove(store, "nothing") == 0
    assert store.read("chunks").count() == 1 and {r.path for r in store.read("files").collect()} == {"README.md"}
    assert store.read("embeddings").count() == 0


def test_search(spark, store):
    p = HashingProvider(64)
    embed_missing(store, p)
    i, v = opened(store, p), QueryCache(p)
    for mode in ("keyword", "hybrid", "vector"):
        rows, warnings = search(i, Search("agent editing", mode=mode, query_vector=v.vector("agent editing")))
        assert rows.first().path == "docs/agents.md" and not warnings
    rows, _ = search(i, Search("local documents", mode="keyword", level="both"))
    assert {r.level for r in rows.collect()} == {"chunk", "file"}
    assert search(i, Search("local", mode="keyword", path_pattern="^docs/"))[0].count() == 0
    page = result_json(search(i, Search("tests", mode="keyword"))[0], "/r").collect()
    first = json.loads(page[0]["json"])
    assert first["rank"] == 1 and first["source_uri"] == "file:///r/docs/agents.md#L1" and first["scores"]["keyword"] > 0
    assert "docs/agents.md" in rendered(search(i, Search("tests", mode="keyword"))[0].collect())
    with pytest.raises(KeyError):
        v.vector("never asked", cached_only=True)
    assert v.vector("AGENT  editing", cached_only=True)


def test_stems_match(spark, store):
    assert search(opened(store), Search("patching", mode="keyword"))[0].first().path == "docs/agents.md"


def test_missing_vectors(spark, store):
    i = opened(store)
    rows, warnings = search(i, Search("documents"))
    assert rows.first().path == "README.md" and warnings
    with pytest.raises(ValueError):
        search(i, Search("documents", mode="vector"))


def test_images(spark, store):
    files = spark.createDataFrame([(1, "img/logo.png", None, "png"), (2, "img/other.png", None, "png")], "file_id long, path string, content string, file_type string")
    images = spark.createDataFrame([(10, 1), (20, 2)], "image_id long, file_id long")
    vectors = spark.createDataFrame([(10, [0.0, 1.0]), (20, [1.0, 0.0])], "image_id long, vector array<float>")
    base = opened(store)
    i = Index(files, base.chunks.limit(0), base.postings.limit(0), base.stats.limit(0), images=images, image_embeddings=vectors)
    assert [r.path for r in search(i, Search("logo", mode="keyword", kind="image"))[0].collect()] == ["img/logo.png"]
    found = search(i, Search("zzz", kind="image", image_vector=[1.0, 0.0]))[0].collect()
    assert found[0].path == "img/other.png" and found[0].chunk_id == 20
    with pytest.raises(ValueError):
        search(i, Search("zzz", kind="image"))


def test_rerank(spark, store):
    i = opened(store)
    s = Search("documents tests", mode="keyword")
    plain = [r.path for r in search(i, s)[0].collect()]
    turned, warnings = search(i, s, lambda q, t: [(len(t) - 1, 5.0)])
    assert turned.first().path == plain[-1] and turned.first().rerank_score == 5.0 and not warnings

    def down(q, t):
        raise OSError("down")

    rows, warnings = search(i, s, down)
    assert [r.path for r in rows.collect()] == plain and "down" in warnings[0]


def test_stream(spark, tmp_path):
    from docuforge.streaming.incremental import file_stream, index_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("# A\n")
    s = Store(spark, str(tmp_path / "index"))
    for n in (1, 2):
        index_stream(file_stream(spark, str(folder)), s, str(tmp_path / "cp")).awaitTermination()
        assert s.read("files").count() == n
        (folder / "b.md").write_text("# B\n")


def test_stream_without_stored_contents(spark, tmp_path):
    """Files of earlier batches stay, though their contents are not kept; so do their chunks."""
    from docuforge.streaming.incremental import file_stream, index_stream

    folder = tmp_path / "in"
    folder.mkdir()
    s = Store(spark, str(tmp_path / "index"))
    for n, name in enumerate(("a.txt", "b.txt", "c.txt"), 1):
        (folder / name).write_text(f"text of {name}\n")
        index_stream(file_stream(spark, str(folder)), s, str(tmp_path / "cp"), Options(store_full_files=False)).awaitTermination()
        assert s.read("files").count() == n and s.read("chunks").count() == n and s.read("stats").count() == n


def test_pruned_scan_is_exact(spark):
    """The best chunks are those of the whole scan, whatever the weights."""
    import random

    r = random.Random(2)
    n = 300
    files = spark.createDataFrame([(i, f"d/{i}.md", None, "md") for i in range(n)], "file_id long, path string, content string, file_type string")
    chunks = spark.createDataFrame([(i, i, 0, r.choice(["alpha beta", "alpha", "none here"]), 1, 1) for i in range(n)], "chunk_id long, file_id long, chunk_index long, text string, start_line long, end_line long")
    vectors = spark.createDataFrame([(i, [r.random(), r.random()]) for i in range(n + 20)], "chunk_id long, vector array<float>")
    i = Index(files, chunks, chunks.selectExpr("text term", "chunk_id", "1L tf").limit(0), None, vectors)
    for mode, weights in (("hybrid", (0.65, 0.3, 0.05)), ("hybrid", (1.0, 0.0, 0.0)), ("vector", (0.65, 0.3, 0.05))):
        s = dict(query="alpha beta", mode=mode, weights=weights, query_vector=[1.0, 0.2], limit=7)
        from docuforge.plans.search import vector_chunks

        pruned = [(x.chunk_id, round(x.score, 9)) for x in vector_chunks(i, Search(**s)).collect()]
        whole = [(x.chunk_id, round(x.score, 9)) for x in vector_chunks(i, Search(**s, prefilter=True)).collect()]
        assert pruned == whole and len(pruned) == 14
