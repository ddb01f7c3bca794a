import json

import pytest

from docuforge import config as C
from docuforge.cli import main


def test_overlay_and_validation(tmp_path):
    (tmp_path / "a.toml").write_text('[search]\nlimit = 5\nmode = "keyword"\n[search.weights]\nvector = 1\n')
    (tmp_path / "b.toml").write_text("[search]\nlimit = 7\n")
    c = C.load(str(tmp_path / "a.toml"), str(tmp_path / "b.toml"), str(tmp_path / "none.toml"), flags={"index": {"chunking": "off"}})
    assert (c.search.limit, c.search.mode, c.search.weights.vector, c.search.weights.keyword, c.index.chunking) == (7, "keyword", 1, 0.3, "off")
    for bad in ({"search": {"limit": 0}}, {"search": {"mode": "x"}}, {"nope": {}}, {"search": {"weights": {"vector": -1}}}, {"index": {"max_tokens": 1}}, {"index": {"overlap_tokens": 450}}, {"embedding": {"provider": "http"}}, {"reranker": {"enabled": True}}):
        with pytest.raises(ValueError):
            C.load(flags=bad)


def test_dump_round_trip(tmp_path):
    c = C.overlay(C.Config(), {"embedding": {"model": 'a"b\\c'}, "search": {"limit": 3}})
    (tmp_path / "x.toml").write_text(C.dumped(c))
    assert C.load(str(tmp_path / "x.toml")) == c


def test_models():
    assert C.model_name("nomic") == "nomic-embed-text-v1.5" and C.model_name("gemma") != C.model_name("gemma", "ollama") and C.model_name("own") == "own"
    assert C.dimensions("gemma", 5) == 768 and C.dimensions("text-embedding-3-large", 5) == 3072 and C.dimensions("own", 5) == 5
    assert C.prefixes("gemma")[0].startswith("title") and C.prefixes("own")[0] == "search_document: "


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("# Rules\n\nAlways keep tests current.\n")
    (tmp_path / "README.md").write_text("A tool for local documents.\n")
    run = lambda *a: (main(["--root", str(tmp_path), *a]), capsys.readouterr().out)
    assert run("init") == (0, "") and run("init")[0] == 1 and run("init", "--force")[0] == 0
    assert run("config", "validate") == (0, "ok\n") and "[search.weights]" in run("config", "show")[1]
    assert run("search", "x")[0] == 1
    assert json.loads(run("index", "--dry-run")[1]) == {"insert": 2}
    assert json.loads(run("index")[1]) == {"discovered": 2, "changed": 2, "removed": 0, "embedded": 2}
    assert json.loads(run("index")[1])["changed"] == 0
    page = json.loads(run("retrieve", "tests current", "--mode", "keyword")[1])
    assert page["results"][0]["path"] == "docs/a.md" and page["results"][0]["rank"] == 1
    assert run("search", "tests", "--jsonl", "--filetype", "txt")[1] == ""
    assert "docs/a.md" in run("search", "tests", "--compact")[1] and "keyword" in run("search", "tests", "--explain")[1]
    assert json.loads(run("status")[1])["counts"]["files"] == 2 and run("doctor")[0] == 0
    assert json.loads(run("remove", "docs")[1]) == {"removed": 1}
