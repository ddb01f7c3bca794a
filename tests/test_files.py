import pytest
from pyspark.sql import functions as F
from test_chunking import docx

from docuforge.sources.files import classify, discover, docx_text, extract_text, scan_binary, tree_paths
from docuforge.sources.globs import Ignore, glob_pattern


def write(root, files):
    for path, content in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content if isinstance(content, bytes) else content.encode())


@pytest.mark.parametrize(
    "path,kind",
    [("docs/x", "text"), ("a/b/c.rs", "text"), ("README.anything", "text"), ("a/README", None), ("i/l.png", "image"), ("x/y.lock", None), (".git/a.md", None), ("sub/.git/a.md", "text"), ("node_modules/a.png", None), ("Dockerfile", "text"), ("a/Dockerfile.x", "text"), ("a.exe", None)],
)
def test_classify(spark, path, kind):
    assert spark.range(1).select(classify(F.lit(path))).first()[0] == kind


def test_globs(spark):
    hit = lambda glob, path: spark.range(1).select(F.lit(path).rlike(glob_pattern([glob]))).first()[0]
    assert hit("*.lock", "a/b.lock") and hit("{a,b}/*.x", "b/c.x") and hit("[!a]?", "bc") and not hit("[!a]?", "ac") and not hit("a.b", "axb")


def test_ignore_rules():
    i = Ignore("# c\n*.skip.md\nbuild/\n/top.txt\nout/**\n!keep.skip.md\n")
    assert i.ignored("a/x.skip.md") and not i.ignored("a/keep.skip.md")
    assert i.ignored("build/x") and not i.ignored("build")
    assert i.ignored("top.txt") and not i.ignored("a/top.txt") and i.ignored("out/a/b")


def test_discovery(spark, tmp_path):
    write(tmp_path, {"docs/guide.md": "g", "sub/AGENTS.md": "a", "notes/keep.txt": "k", ".git/x.md": "x", "node_modules/p.md": "p", "ign/by.md": "i", "a.skip.md": "s", "off/.indexskip": "", "off/x.md": "o", ".hidden/h.md": "h", ".indexignore": "ign/**\n*.skip.md\n"})
    assert [r.path for r in discover(spark, str(tmp_path)).orderBy("path").collect()] == [".hidden/h.md", "docs/guide.md", "notes/keep.txt", "sub/AGENTS.md"]
    assert tree_paths(str(tmp_path), "docs/guide.md") == ["docs/guide.md"]
    assert tree_paths(str(tmp_path), "off/x.md") == [] and tree_paths(str(tmp_path), "a.skip.md") == []
    with pytest.raises(FileNotFoundError):
        tree_paths(str(tmp_path), "none")
    with pytest.raises(ValueError):
        tree_paths(str(tmp_path / "docs"), "..")


def test_extraction(spark, tmp_path):
    body = '<w:p><w:t>A &amp; B</w:t><w:tab/><w:t xml:space="preserve">c</w:t></w:p><w:p><w:t>two</w:t></w:p>'
    write(tmp_path, {"a b+c.md": "x\r\ny\rz", "bad.txt": b"\xff\xfe", "d.docx": docx(body), "e.docx": b"no"})
    rows = {r.path: r for r in extract_text(scan_binary(spark, str(tmp_path))).collect()}
    assert rows["a b+c.md"].text == "x\ny\nz" and rows["bad.txt"].text is None and rows["bad.txt"].error
    assert rows["d.docx"].text == "A & B\tc\ntwo" and rows["e.docx"].error
    assert docx_text("") == ""
