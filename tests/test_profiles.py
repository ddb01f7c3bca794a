import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from docuforge.providers import HashingProvider, ImageProvider, Profile, embed_images
from docuforge.sources.profiles import StoredQueryCache, is_installed, mark_model, upsert_profile
from docuforge.sources.store import Store


def test_profiles_are_reused(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    p = Profile("m", 3)
    assert upsert_profile(s, p, "native") == p.hash == upsert_profile(s, p, "ollama", endpoint="http://x")
    assert [(r.provider, r.endpoint) for r in s.read("profiles").collect()] == [("ollama", "http://x")]
    other = Profile("m", 3, fallback=("ollama", None, None))
    assert other.hash != p.hash and upsert_profile(s, other, "native") == p.hash
    assert upsert_profile(s, Profile("m", 4), "native") != p.hash and s.read("profiles").count() == 2


def test_query_cache_is_kept(spark, tmp_path):
    s, p = Store(spark, str(tmp_path)), HashingProvider(4)
    c = StoredQueryCache(s, p)
    with pytest.raises(KeyError):
        c.vector("Some words", cached_only=True)
    v = c.vector("Some words")
    assert StoredQueryCache(s, p).vector("  some  WORDS", cached_only=True) == pytest.approx(v)
    with pytest.raises(KeyError):
        StoredQueryCache(s, HashingProvider(8)).vector("some words", cached_only=True)


def test_models(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert not is_installed(s, "native", "m")
    for _ in range(2):
        mark_model(s, "native", None, "m", None, 3, "/c")
    assert is_installed(s, "native", "m") and s.read("model_cache").count() == 1


def test_images_one_by_one_after_a_bad_batch(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            bad = any(x == "YmFk" for x in body.get("images", []))
            self.send_response(400 if bad else 200)
            self.end_headers()
            if not bad:
                self.wfile.write(json.dumps({"embeddings": [[1.0, 0.0]] * max(1, len(body.get("images", [])))}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    p = ImageProvider(f"http://127.0.0.1:{server.server_port}", 2)
    df = spark.createDataFrame([(1, b"a"), (2, b"bad"), (3, b"c")], "id long, content binary").coalesce(1)
    rows = {r.id: r for r in embed_images(df, p, ["id"]).collect()}
    assert rows[1].vector and rows[3].vector and rows[2].vector is None and rows[2].error
    assert p.query("q") == [1.0, 0.0]
    server.shutdown()
