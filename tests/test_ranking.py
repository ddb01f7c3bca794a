from docuforge.operators import ranking as R

SCHEMA = ", ".join(f"{c} {t}" for c, t in R.RESULT.items()) + ", branch_rank int"


def row(path="p", score=0.5, kind="text", file_id=1, chunk_id=1, chunk_index=1, level="chunk", v=0.0, k=0.0, m=0.0, start=1, end=2, branch=0, ft="md"):
    return (path, "s", score, None, kind, ft, file_id, chunk_id, chunk_index, start, end, k, v, m, "h", "hybrid", level, branch)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_total_order(spark):
    wanted = [
        row(score=0.9, chunk_id=1), row(score=0.5, v=0.9, chunk_id=2), row(v=0.1, k=0.9, chunk_id=3), row(v=0.1, k=0.1, m=0.9, chunk_id=4), row("a", chunk_id=5), row("b", kind="image", chunk_id=6), row("b", chunk_id=7),
        row("b", file_id=2, chunk_id=1), row("b", file_id=2, chunk_id=2, chunk_index=1), row("b", file_id=2, chunk_id=2, chunk_index=2, start=1), row("b", file_id=2, chunk_id=2, chunk_index=2, start=None), row("b", file_id=2, chunk_id=None), row("b", file_id=None),
    ]
    found = [tuple(r) for r in R.top_k(frame(spark, wanted[::-1]), 100).collect()]
    assert found == wanted
    assert R.top_k(frame(spark, wanted), 0).count() == 0
    assert [tuple(r) for r in R.top_k(frame(spark, wanted), 2).collect()] == wanted[:2]


def test_dedup_keeps_the_best_and_the_earlier_branch(spark):
    rows = [row(score=0.5, branch=2, v=1.0), row(score=0.5, branch=0, v=0.0), row(score=0.4, branch=1), row(score=0.1, level="file")]
    found = {(r.level, r.score, r.branch_rank) for r in R.dedup_max(frame(spark, rows)).collect()}
    assert found == {("chunk", 0.5, 0), ("file", 0.1, 0)}


def test_cap(spark):
    rows = [row(score=i / 10, chunk_id=i) for i in range(6)] + [row(level="file", chunk_id=None), row(file_id=None, chunk_id=50), row(file_id=None, chunk_id=51)]
    found = R.cap_per_file(frame(spark, rows), 2).collect()
    assert sorted(r.chunk_id for r in found if r.file_id == 1 and r.level == "chunk") == [4, 5]
    assert len(found) == 5


def test_cut_may_return_less(spark):
    rows = [row(score=1 - i / 100, chunk_id=i) for i in range(50)] + [row("z", score=0.01, file_id=2, chunk_id=99)]
    assert R.cut(frame(spark, rows), 5, 2).count() == 2


def test_filters(spark):
    rows = frame(spark, [row("a.md"), row("b.txt", ft="txt", chunk_id=2), row("c.png", kind="image", ft="png", chunk_id=3)])
    paths = lambda **x: sorted(r.path for r in R.apply_filters(rows, **x).collect())
    assert paths() == ["a.md", "b.txt", "c.png"]
    assert paths(kind="text") == ["a.md", "b.txt"] and paths(kind="image") == ["c.png"]
    assert paths(file_types=[" .TXT"]) == ["b.txt"] and paths(path_pattern="^[ab]") == ["a.md", "b.txt"]


def test_rerank_by_index(spark):
    rows = frame(spark, [row("a", 0.9), row("b", 0.8, chunk_id=2), row("c", 0.7, chunk_id=3)])
    scores = spark.createDataFrame([(1, 0.9, 0), (1, 0.8, 1), (99, 1.0, 2)], "index int, score double, position int")
    found = R.merge_reranked(rows, scores).orderBy("position").collect()
    assert [r.path for r in found] == ["b", "a", "c"]
    assert [r.rerank_score for r in found] == [0.9, None, None]
