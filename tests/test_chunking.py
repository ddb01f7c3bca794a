import io
import zipfile

import pytest

from docuforge.functions.chunking import chunk_files, smart_chunks
from docuforge.functions.chunking.base import brace_change, lines_of
from docuforge.functions.chunking.windows import full_file, line_window_chunks, line_windows


def test_lines():
    assert lines_of("a\r\nb\n\nc") == ["a", "b", "", "c"] and lines_of("") == [] and lines_of("\n") == [""]


def test_braces():
    assert brace_change('a { "}" \'{\' }') == 0 and brace_change("{{ \\{ }") == 1


# path, source, and (type, title, first line, last line) of every chunk
CASES = [
    ("a.md", "intro\n# A\nx\n```\n# no\n```\n## B\ny\n# C\n", [("markdown_section", None, 1, 1), ("markdown_section", "A", 2, 6), ("markdown_section", "B", 7, 8), ("markdown_section", "C", 9, 9)]),
    ("a.rs", "use x;\n/// doc\npub struct A {\n}\nimpl A {\n    fn f() {}\n}\n", [("code_symbol", None, 1, 2), ("code_symbol", "A", 2, 4), ("code_symbol", "A", 5, 7)]),
    ("a.tsx", "// c\nexport const A = 1;\nfunction B() {}\n", [("code_symbol", None, 1, 1), ("code_symbol", "A", 1, 2), ("code_symbol", "B", 3, 3)]),
    ("a.py", "import x\n@d\ndef f():\n    pass\n\nclass B(C):\n    x = 1\n", [("code_symbol", "f", 2, 5), ("code_symbol", "B", 6, 7)]),
    ("b.py", "x = 1\n# %%\ny = 2\n", [("python_cell", "cell-1", 1, 1), ("python_cell", "cell-2", 2, 3)]),
    ("a.yaml", "services:\n  web:\n    image: a\n  db:\n    image: b\n", [("docker_compose_service", "services.web", 2, 3), ("docker_compose_service", "services.db", 4, 5)]),
    ("b.yml", "on: push\njobs:\n  test:\n    x: 1\n", [("github_actions_job", "jobs.test", 3, 4)]),
    ("c.yml", "kind: Pod\nname: p\n---\nkind: Job\n", [("yaml_document", "Pod/p", 1, 2), ("yaml_document", "Job", 4, 4)]),
    ("d.yml", "a: 1\nb:\n  c: 2\n", [("yaml_object", "a", 1, 1), ("yaml_object", "b", 2, 3)]),
    ("a.json", '{"b": 1}', [("json_object", "$", 1, 1)]),
    ("b.json", "{", [("json_invalid_text", None, 1, 1)]),
    ("a.toml", "x = 1\n# c\n[t.u]\ny = 2\n", [("toml_table", "top-level", 1, 2), ("toml_table", "t.u", 2, 4)]),
    ("a.cs", "namespace N {\n[Attr]\npublic class C {\npublic int M() {\n}\n}\n}\n", [("code_symbol", "N", 1, 1), ("code_symbol", "C", 2, 7)]),
    ("a.cpp", "// c\n#include <x>\nint f(int a) {\n}\nclass K;\n", [("code_symbol", None, 1, 2), ("code_symbol", "f", 3, 4), ("code_symbol", "K", 5, 5)]),
    ("a.java", "package p;\n@A\npublic class C {\n  public void m() {\n  }\n}\n", [("code_symbol", "C", 2, 3), ("code_symbol", "m", 4, 6)]),
    ("a.kt", "/** d */\ndata class P(val x: Int)\nfun f() {}\n", [("code_symbol", "P", 1, 2), ("code_symbol", "f", 3, 3)]),
    ("a.swift", "struct S {}\npublic func f(x: Int) {}\n", [("code_symbol", "S", 1, 1), ("code_symbol", "f", 2, 2)]),
    ("a.go", "package p\n// c\nfunc (t *T) M(a int) {\n}\nvar x = 1\n", [("code_symbol", "M", 2, 4), ("code_symbol", "var x", 5, 5)]),
    ("a.zig", "/// d\npub fn main() void {\n}\ntest \"x\" {}\n", [("code_symbol", "main", 1, 3), ("code_symbol", "x", 4, 4)]),
    ("a.gd", "extends Node\n# c\nfunc f():\n  pass\n", [("code_symbol", None, 1, 2), ("code_symbol", "f", 2, 4)]),
    ("a.lua", "-- c\nlocal function a()\nend\nM.b = function(x)\n", [("code_symbol", "a", 1, 3), ("code_symbol", "M.b", 4, 4)]),
    ("a.wgsl", "struct V { }\n@vertex\nfn main() {}\n", [("shader_symbol", "V", 1, 1), ("shader_symbol", "vertex_entry", 2, 2), ("shader_symbol", "main", 3, 3)]),
    ("a.sh", "#!/bin/sh\n# heading\nfoo() {\n}\n", [("shell_block", "heading", 2, 2), ("shell_block", "foo", 3, 4)]),
    ("a.sql", "-- c\nCREATE TABLE \"t\" (a);\n\nselect 1;\n", [("sql_statement", "create table t", 1, 2), ("sql_statement", "select", 4, 4)]),
    ("a.svg", '<svg id="a">\n<g class="b">\n</g></svg>', [("xml_subtree", "svg#a", 1, 1), ("xml_subtree", "g.b", 2, 3)]),
    ("a.css", "a {\n}\nb { c: d }\n", [("css_rule_group", "a", 1, 3)]),
    ("a.html", '<p>\n<nav id="n">\n</nav>\n<script>\nfunction q() {}\n</script>\n<style>\na {\n}\n</style>\n', [("html_subtree", "nav#n", 2, 3), ("code_symbol", "q", 1, 1), ("css_rule_group", "a", 1, 2)]),
    ("x/Dockerfile.dev", "# c\nFROM a AS Build\nRUN x\nfrom b\n", [("docker_stage", "build", 2, 3), ("docker_stage", "from b", 4, 4)]),
    ("Makefile", "# c\nall: x\n\techo\nX := 1\nt:\n", [("make_target", "all", 1, 4), ("make_target", "t", 5, 5)]),
    ("a.txt", "x y\nTITLE\nbody text\nUnder\n-----\n1.2 numbered\n", [("plain_text_section", "TITLE", 2, 3), ("plain_text_section", "Under", 4, 5), ("plain_text_section", "1.2 numbered", 6, 6)]),
    ("noname", "const a = {};\nfunction b() { let c }\n", [("code_symbol", None, 1, 1), ("code_symbol", "b", 2, 2)]),
    ("notes.rst", "all lower case prose\n", [("plain_text", None, 1, 1)]),
]


@pytest.mark.parametrize("path,source,wanted", CASES, ids=[c[0] for c in CASES])
def test_dialect(path, source, wanted):
    found = [(c.chunk_type, c.title, c.start_line, c.end_line) for c in smart_chunks(path, source)]
    assert found == wanted


def test_script_takes_comments_along():
    found = smart_chunks("a.tsx", "let z = 1\n// c\nexport const A = 1;\n")
    assert [(c.language, c.title, c.start_line, c.end_line) for c in found] == [("tsx", "z", 1, 2), ("tsx", "A", 2, 3)]


def test_header():
    c = smart_chunks("d/a.md", "# A\n## B\nx\n")[1]
    assert c.text == "File: d/a.md\nLanguage: markdown\nChunk type: markdown_section\nSection: A > B\nSymbol: B\n\n## B\nx"


def test_big_units_are_cut():
    method = "    def m{}(self):\n" + "        x = 1  # some words\n" * 60
    found = smart_chunks("a.py", "class A:\n    y = 1\n" + "".join(method.format(i) for i in range(3)))
    assert [c.title for c in found] == ["A"] * 3 and all("y = 1" in c.text for c in found)
    prose = "\n\n".join("some lower words here " * 30 for _ in range(20))
    assert len(smart_chunks("a.txt", prose)) > 1
    section = "# T\n" + "\n\n".join("word " * 200 for _ in range(10))
    assert [c.title for c in smart_chunks("a.md", section)] == ["T"] * len(smart_chunks("a.md", section)) and len(smart_chunks("a.md", section)) > 2
    big = '{"a": [' + ",".join('{"id": "x%d", "t": "%s"}' % (i, "w" * 1500) for i in range(3)) + "]}"
    assert [c.title for c in smart_chunks("a.json", big)] == ["$.a[0]#x0", "$.a[1]#x1", "$.a[2]#x2"]


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document>{body}</w:document>")
    return out.getvalue()


def test_docx():
    body = '<w:p><w:pStyle w:val="Heading1"/><w:t>Top</w:t></w:p><w:p><w:t>a &amp;lt; b</w:t></w:p>'
    found = smart_chunks("a.docx", docx(body))
    assert [(c.title, c.breadcrumb) for c in found] == [("Top", ["Top"])] and "a < b" in found[0].text
    assert smart_chunks("a.docx", b"no zip") == []


def test_windows():
    text = "\n".join(f"w{i} x{i}" for i in range(6))
    assert [(a, b) for a, b, *_ in line_windows(text, 4, 6, 2, 1)] == [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)]
    assert [(a, b) for a, b, *_ in line_windows(text, 4, 6, 0, 1)] == [(1, 2), (3, 4), (5, 6)]
    assert line_windows("", 4, 6, 2, 1) == []
    assert [(c.start_line, c.end_line) for c in line_window_chunks("text", text)] == [(1, 6)]
    assert full_file("text", "a\nb\n\n")[0].text == "a\nb" and full_file("text", "\n") == []


def test_as_table_function(spark):
    df = spark.createDataFrame([(1, "a.md", "# A\n# B\n"), (2, "b.txt", None), (3, "c.txt", "")], "id long, path string, content string")
    assert [(r.id, r.chunk_index, r.title) for r in chunk_files(df, keep=["id"]).orderBy("id", "chunk_index").collect()] == [(1, 0, "A"), (1, 1, "B")]
    assert [(r.id, r.end_line) for r in chunk_files(df, "off", keep=["id"]).orderBy("id").collect()] == [(1, 2), (3, 1)]
    assert chunk_files(df.limit(0)).count() == 0
