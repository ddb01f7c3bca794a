import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docuforge.functions import text as T
from docuforge.functions import vectors as V
from docuforge.functions.stemming import index_tokens, stem


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "query,text,score",
    [("Agent  RULES", "some agent rules here", 1.0), ("agent x1", "AGENT", 0.5), ("", "a", 0.0), ("été", "été", 1.0), ("éé", "éé", 0.0), ("a-b", "b then a", 1.0), ("foo", None, 0.0)],
)
def test_keyword_score(spark, query, text, score):
    assert one(spark, T.keyword_score(query, F.lit(text).cast("string"))) == score
    assert one(spark, T.keyword_score_by(F.lit(query), F.lit(text).cast("string"))) == score


def test_normalization():
    assert T.normalize("  A\u00a0 b\tC ") == "a b c"
    assert T.tokens_of("Foo foo-BAR_1") == ["foo", "bar", "1"]
    assert T.match_terms("l'été 12") == ["l", "été", "12"]


def test_paths(spark):
    for path, kind in (("a/b.TAR.GZ", "gz"), (".bashrc", ""), ("x/.env", ""), ("Makefile", "")):
        assert one(spark, T.file_type(F.lit(path))) == kind
    assert one(spark, T.source_uri("/r", F.lit("a b/ü*~.md"), F.lit(3))) == "file:///r/a%20b/%C3%BC%2A~.md#L3"
    assert one(spark, T.source_uri("/r", F.lit("a.md"), F.lit(None).cast("int"))) == "file:///r/a.md"
    assert one(spark, T.line_suffix(F.lit(1), F.lit(2))) == ":1-2"


def test_vectors(spark):
    a, b = V.vector_literal([1, 2, 3]), V.vector_literal([4, 5, 6])
    assert one(spark, V.dot(a, b)) == 32
    assert one(spark, V.cosine(a, b)) == pytest.approx(0.9746318)
    assert one(spark, V.cosine(a, V.vector_literal([0, 0, 0]))) == 0
    assert one(spark, V.dot(a, V.vector_literal([1, 2]))) == 0
    assert one(spark, V.cosine(a, V.vector_literal([1, 2]))) == 0
    assert V.from_bytes(V.to_bytes([1.5, -2])) == [1.5, -2.0]
    with pytest.raises(ValueError):
        V.from_bytes(b"12345")


def test_hybrid(spark):
    score = lambda v, k, m, w: one(spark, V.hybrid(F.lit(v), F.lit(k), F.lit(m), w))
    assert score(1.0, 0.5, 0.25, (2, 1, 1)) == 0.6875
    assert score(1.0, 1.0, 1.0, (0, 0, 0)) == 0
    assert score(9.0, 9.0, 9.0, (1, 1, 1)) == 1


def test_centroids(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [1.0]), ("b", [3.0, 9.0]), ("c", None)], "k string, v array<float>")
    found = {r.k: r.centroid for r in V.centroids(df, "k", "v").collect()}
    assert found == {"a": [2.0, 3.0], "b": [2.0]}


def test_cosine_batch(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0])], "id long, v array<float>")
    found = {(r.id, r.query): r.cosine for r in V.cosine_batch(df, [[2.0, 0.0], [0.0, 1.0]], "v", ["id"]).collect()}
    assert found[(1, 0)] == 1 and found[(1, 1)] == 0 and found[(2, 0)] == 0 and found[(3, 1)] == 0 and len(found) == 8


def test_cosine_batch_is_bounded(spark, monkeypatch):
    """No batch grows with either table: 3,000 vectors and 700 queries are 2,100,000 results."""
    r = np.random.default_rng(3)
    v, q = r.normal(size=(3000, 4)), r.normal(size=(700, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>").repartition(1)
    plain = type(df).mapInArrow

    def watched(self, f, *rest):
        def run(batches):
            for batch in f(batches):
                assert batch.num_rows <= 1 << 16 and batch.nbytes <= 1 << 23, (batch.num_rows, batch.nbytes)
                yield batch

        return plain(self, run, *rest)

    monkeypatch.setattr(type(df), "mapInArrow", watched)
    found = V.cosine_batch(df, q, "v", ["id"]).toPandas().sort_values(["id", "query"])
    v = v.astype("f4").astype("f8")
    wanted = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    assert (found["id"] == np.repeat(np.arange(3000), 700)).all() and (found["query"] == np.tile(np.arange(700), 3000)).all()
    assert np.allclose(found["cosine"].to_numpy().reshape(3000, 700), wanted)


def test_cosine_batch_of_tables(spark, monkeypatch):
    """Vectors of several lengths in many blocks, null and repeated ones, and numbers of queries with gaps."""
    monkeypatch.setattr(V, "BLOCK_ROWS", 7)
    r = np.random.default_rng(4)
    vectors = [(i % 90, None if i % 11 == 0 else r.normal(size=2 + i % 3).tolist()) for i in range(100)]
    queries = [(i * 13, None if i % 5 == 0 else r.normal(size=2 + i % 2).tolist()) for i in range(20)]
    found = V.cosine_batch(spark.createDataFrame(vectors, "id long, v array<double>"), spark.createDataFrame(queries, "query int, v array<double>"), "v", ["id"], digits=3).collect()
    cosine = lambda a, b: 0.0 if a is None or b is None or len(a) != len(b) else np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    wanted = sorted((i, j, cosine(a, b)) for i, a in vectors for j, b in queries)
    found = sorted(tuple(x) for x in found)
    assert [x[:2] for x in found] == [x[:2] for x in wanted]
    assert all(abs(x[2] - y[2]) <= 0.0005 + 1e-12 and round(x[2], 3) == x[2] for x, y in zip(found, wanted))
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert V.cosine_batch(empty, [[1.0]], "v", ["id"]).collect() == V.cosine_batch(empty, [], "v", ["id"]).collect() == []


@pytest.mark.parametrize(
    "word,root",
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
     ("relational", "relat"), ("rational", "ration"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("electrical", "electr"), ("goodness", "good"), ("adjustment", "adjust"), ("adoption", "adopt"),
     ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("generalizations", "gener"), ("oscillators", "oscil")],
)
def test_stem(word, root):
    assert stem(word) == root


def test_index_tokens():
    assert index_tokens("Élan's Running-dogs 42") == ["elan", "s", "run", "dog", "42"]
    assert index_tokens(None) == []


def test_reason(spark):
    df = spark.createDataFrame([Row(a=1.0, b=0.0, c=0.5, d=0.0)])
    assert df.select(T.reason(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0] == "vector + metadata"
