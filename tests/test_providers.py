import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from docuforge.providers import DimensionError, HashingProvider, HttpProvider, Profile, Provider, WithFallback, embed_frame, http_reranker, ollama_vectors, openai_vectors, parse_rerank


class Fixed(Provider):
    def __init__(self, vectors, error=None):
        self.profile, self.vectors, self.error = Profile("m", 2), vectors, error

    def embed(self, texts):
        if self.error:
            raise self.error
        return [self.vectors] * len(texts)


def test_profiles():
    p = Profile("m", 2)
    assert p.hash == Profile("m", 2).hash != Profile("m", 3).hash
    assert Profile("m", 2, fallback=("ollama", None, None)).hash != p.hash


def test_answers():
    assert ollama_vectors({"embeddings": [[1]]}) == [[1]] and ollama_vectors({"embedding": [1]}) == [[1]]
    assert openai_vectors({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}, 2) == [[1], [2]]
    for at in ([0, 0], [0], [0, 2]):
        with pytest.raises(ValueError):
            openai_vectors({"data": [{"index": i, "embedding": []} for i in at]}, 2)
    assert parse_rerank([{"index": 1, "score": 0.5}]) == parse_rerank({"results": [{"index": 1, "relevance_score": 0.5}]}) == [(1, 0.5)]


def test_fallback():
    assert WithFallback(Fixed(None, OSError("x")), Fixed([1, 2])).query("q") == [1, 2]
    with pytest.raises(DimensionError):
        Fixed([1, 2, 3]).query("q")
    with pytest.raises(DimensionError):
        WithFallback(Fixed(None, DimensionError("x")), Fixed([1, 2])).query("q")


def test_guards(monkeypatch):
    with pytest.raises(ValueError):
        HttpProvider(Profile("m", 1), "ftp://x").query("q")
    monkeypatch.delenv("NO_KEY", raising=False)
    with pytest.raises(ValueError):
        HttpProvider(Profile("m", 1), "http://127.0.0.1:1", key_env="NO_KEY").query("q")


def test_http():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            code, answer = 200, {"data": [{"index": i, "embedding": [1.0, 0.0]} for i in range(len(body.get("input", [])))]}
            if "texts" in body:
                code, answer = 422, {"error": "unknown field texts"}
            elif "documents" in body:
                answer = {"results": [{"index": 0, "relevance_score": 0.25}]}
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert HttpProvider(Profile("m", 2, document_prefix="d: "), url).documents(["a", "b"]) == [[1.0, 0.0]] * 2
    assert seen[0] == {"model": "m", "input": ["d: a", "d: b"]}
    assert http_reranker(url, "r")("q", ["a"]) == [(0, 0.25)]
    server.shutdown()


def test_frames(spark):
    df = spark.createDataFrame([(1, "good one"), (2, "bad one"), (3, None)], "id long, t string").coalesce(1)
    rows = {r.id: r for r in embed_frame(df, HashingProvider(8), "t", ["id"]).collect()}
    assert len(rows[1].vector) == 8 and sum(x * x for x in rows[1].vector) == pytest.approx(1)
    assert HashingProvider(8).documents(["same words"]) == HashingProvider(8).documents(["same words"])


def test_bad_rows_are_skipped_by_row(spark):
    def run():
        from docuforge.providers import HashingProvider as H

        class P(H):
            def embed(self, texts):
                if any("bad" in t for t in texts):
                    raise ValueError("bad text")
                return super().embed(texts)

        return P(8)

    df = spark.createDataFrame([(1, "good one"), (2, "bad one")], "id long, t string").coalesce(1)
    rows = {r.id: r for r in embed_frame(df, run(), "t", ["id"], by_row=True).collect()}
    assert rows[1].vector and rows[2].vector is None and rows[2].error == "bad text"
