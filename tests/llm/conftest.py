import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(params=["direct", "two steps"])
def small_segments(request, monkeypatch):
    """Segments and buckets so small that even tiny tables are dealt over many, with packed rows that go to the buckets directly or by ranges."""
    from docuforge.llm import exchange

    monkeypatch.setattr(exchange, "SEGMENT_BYTES", 600)
    monkeypatch.setattr(exchange, "BUCKET_ITEMS", 100)
    monkeypatch.setattr(exchange, "MIN_ENTRIES", 0 if request.param == "direct" else 64)


def docs(spark, rows):
    """(doc_id, text) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", 1, "s") for i, t in rows], "doc_id long, text string, _text string, size int, source string")
