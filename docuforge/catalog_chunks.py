"""One query per chunker: every nation has a small file of each kind, and the SQL states the chunks that file must give.

``@@`` in a source or title stands for a name of the nation's own.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from docuforge.functions.chunking import chunk_files
from docuforge.functions.chunking.windows import full_file
from docuforge.sources.files import read_table

# name: (file name, source, [(language, type, title, first line, last line) of every chunk])
CASES: dict[str, tuple[str, str, list[tuple[str, str, str | None, int, int]]]] = {
    "chunk_markdown": ("a.md", "intro\n# @@\nx\n```\n# no\n```\n## B\ny\n# C\n", [("markdown", "markdown_section", None, 1, 1), ("markdown", "markdown_section", "@@", 2, 6), ("markdown", "markdown_section", "B", 7, 8), ("markdown", "markdown_section", "C", 9, 9)]),
    "chunk_general_code": ("noname", "const a = {};\nfunction @@() { let c }\n", [("code", "code_symbol", None, 1, 1), ("code", "code_symbol", "@@", 2, 2)]),
    "chunk_script": ("a.tsx", "// c\nexport const @@ = 1;\nfunction B() {}\n", [("tsx", "code_symbol", None, 1, 1), ("tsx", "code_symbol", "@@", 1, 2), ("tsx", "code_symbol", "B", 3, 3)]),
    "chunk_gdscript": ("a.gd", "extends Node\n# c\nfunc @@():\n  pass\n", [("gdscript", "code_symbol", None, 1, 2), ("gdscript", "code_symbol", "@@", 2, 4)]),
    "chunk_rust": ("a.rs", "use x;\n/// doc\npub struct @@ {\n}\nimpl @@ {\n    fn f() {}\n}\nmacro_rules! m_@@ {\n}\n", [("rust", "code_symbol", None, 1, 2), ("rust", "code_symbol", "@@", 2, 4), ("rust", "code_symbol", "@@", 5, 7), ("rust", "code_symbol", "m_@@", 8, 9)]),
    "chunk_html": ("a.html", '<p>\n<nav id="@@">\n</nav>\n<script>\nfunction q() {}\n</script>\n<style>\na {\n}\n</style>\n', [("html", "html_subtree", "nav#@@", 2, 3), ("javascript", "code_symbol", "q", 1, 1), ("css", "css_rule_group", "a", 1, 2)]),
    "chunk_css": ("a.css", ".@@ {\n}\nb { c: d }\n", [("css", "css_rule_group", ".@@", 1, 3)]),
    "chunk_json": ("a.json", '{"b": "@@"}', [("json", "json_object", "$", 1, 1)]),
    "chunk_json_invalid": ("b.json", "{ @@", [("json", "json_invalid_text", None, 1, 1)]),
    "chunk_toml": ("a.toml", "x = 1\n# c\n[t.@@]\ny = 2\n", [("toml", "toml_table", "top-level", 1, 2), ("toml", "toml_table", "t.@@", 2, 4)]),
    "chunk_yaml": ("d.yml", "a: 1\n@@:\n  c: 2\n", [("yaml", "yaml_object", "a", 1, 1), ("yaml", "yaml_object", "@@", 2, 3)]),
    "chunk_yaml_documents": ("c.yml", "kind: Pod\nname: @@\n---\nkind: Job\n", [("yaml", "yaml_document", "Pod/@@", 1, 2), ("yaml", "yaml_document", "Job", 4, 4)]),
    "chunk_yaml_compose": ("a.yaml", "services:\n  @@:\n    image: a\n  db:\n    image: b\n", [("yaml", "docker_compose_service", "services.@@", 2, 3), ("yaml", "docker_compose_service", "services.db", 4, 5)]),
    "chunk_yaml_actions": ("b.yml", "on: push\njobs:\n  @@:\n    x: 1\n", [("yaml", "github_actions_job", "jobs.@@", 3, 4)]),
    "chunk_python": ("a.py", "import x\n@d\ndef @@():\n    pass\n\nclass B(C):\n    x = 1\n", [("python", "code_symbol", "@@", 2, 5), ("python", "code_symbol", "B", 6, 7)]),
    "chunk_python_cells": ("b.py", "x = '@@'\n# %%\ny = 2\n", [("python", "python_cell", "cell-1", 1, 1), ("python", "python_cell", "cell-2", 2, 3)]),
    "chunk_go": ("a.go", "package p\n// c\nfunc (t *T) @@(a int) {\n}\nvar x = 1\n", [("go", "code_symbol", "@@", 2, 4), ("go", "code_symbol", "var x", 5, 5)]),
    "chunk_zig": ("a.zig", '/// d\npub fn @@() void {\n}\ntest "x" {}\n', [("zig", "code_symbol", "@@", 1, 3), ("zig", "code_symbol", "x", 4, 4)]),
    "chunk_csharp": ("a.cs", "namespace N {\n[Attr]\npublic class @@ {\npublic int M() {\n}\n}\n}\n", [("csharp", "code_symbol", "N", 1, 1), ("csharp", "code_symbol", "@@", 2, 7)]),
    "chunk_cpp": ("a.cpp", "// c\n#include <x>\nint @@(int a) {\n}\nclass K;\n", [("cpp", "code_symbol", None, 1, 2), ("cpp", "code_symbol", "@@", 3, 4), ("cpp", "code_symbol", "K", 5, 5)]),
    "chunk_java": ("a.java", "package p;\n@A\npublic class @@ {\n  public void m() {\n  }\n}\n", [("java", "code_symbol", "@@", 2, 3), ("java", "code_symbol", "m", 4, 6)]),
    "chunk_kotlin": ("a.kt", "/** d */\ndata class @@(val x: Int)\nfun f() {}\n", [("kotlin", "code_symbol", "@@", 1, 2), ("kotlin", "code_symbol", "f", 3, 3)]),
    "chunk_swift": ("a.swift", "struct @@ {}\npublic func f(x: Int) {}\n", [("swift", "code_symbol", "@@", 1, 1), ("swift", "code_symbol", "f", 2, 2)]),
    "chunk_sql": ("a.sql", '-- c\nCREATE TABLE "@@" (a);\n\nselect 1;\n', [("sql", "sql_statement", "create table @@", 1, 2), ("sql", "sql_statement", "select", 4, 4)]),
    "chunk_xml": ("a.svg", '<svg id="@@">\n<g class="b">\n</g></svg>', [("svg", "xml_subtree", "svg#@@", 1, 1), ("svg", "xml_subtree", "g.b", 2, 3)]),
    "chunk_lua": ("a.lua", "-- c\nlocal function @@()\nend\nM.b = function(x)\n", [("lua", "code_symbol", "@@", 1, 3), ("lua", "code_symbol", "M.b", 4, 4)]),
    "chunk_shader": ("a.wgsl", "struct @@ { }\n@vertex\nfn main() {}\n", [("wgsl", "shader_symbol", "@@", 1, 1), ("wgsl", "shader_symbol", "vertex_entry", 2, 2), ("wgsl", "shader_symbol", "main", 3, 3)]),
    "chunk_dockerfile": ("Dockerfile.dev", "# c\nFROM a AS @@\nRUN x\nfrom b\n", [("dockerfile", "docker_stage", "n@", 2, 3), ("dockerfile", "docker_stage", "from b", 4, 4)]),
    "chunk_shell": ("a.sh", "#!/bin/sh\n# heading @@\nfoo() {\n}\n", [("shell", "shell_block", "heading @@", 2, 2), ("shell", "shell_block", "foo", 3, 4)]),
    "chunk_makefile": ("Makefile", "# c\n@@: x\n\techo\nX := 1\nt:\n", [("makefile", "make_target", "@@", 1, 4), ("makefile", "make_target", "t", 5, 5)]),
    "chunk_prose": ("a.txt", "x y\nTITLE @@\nbody text\nUnder\n-----\n1.2 numbered\n", [("text", "plain_text_section", "TITLE @@", 2, 3), ("text", "plain_text_section", "Under", 4, 5), ("text", "plain_text_section", "1.2 numbered", 6, 6)]),
    "chunk_prose_without_headings": ("notes.rst", "all lower case prose of @@ here\n", [("text", "plain_text", None, 1, 1)]),
}


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _sql(chunks) -> str:
    rows = ", ".join(f"({i}, {_quoted(lang)}, {_quoted(kind)}, {_quoted(title)}, {a}, {b})" for i, (lang, kind, title, a, b) in enumerate(chunks))
    name = "replace(replace(title, '@@', 'N' || n_nationkey), 'n@', 'n' || n_nationkey)"
    return f"SELECT n_nationkey::BIGINT AS file_id, i::BIGINT AS chunk_index, language, chunk_type, {name} AS title, a::BIGINT AS start_line, b::BIGINT AS end_line FROM nation, (VALUES {rows}) v(i, language, chunk_type, title, a, b)"


COLUMNS = ["file_id", "chunk_index", "language", "chunk_type", "title", "start_line", "end_line"]


def _query(file: str, source: str):
    def run(spark, sf):
        key = F.col("n_nationkey").cast("string")
        content = F.replace(F.lit(source), F.lit("@@"), F.concat(F.lit("N"), key))
        files = read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("file_id"), F.concat(F.lit("n"), key, F.lit("/" + file)).alias("path"), content.alias("content"))
        return chunk_files(files, keep=["file_id"]).select(*COLUMNS)

    return run


QUERIES = {name: _query(file, source) for name, (file, source, _) in CASES.items()}
ORACLES = {name: _sql(chunks) for name, (_, _, chunks) in CASES.items()}


def chunk_docx(spark, sf):
    """A document with two headings; its bytes are the same for every nation."""
    paragraph = lambda text, style="": f'<w:p>{style and f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>"""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    xml = "<w:document><w:body>" + paragraph("Top", "Heading1") + paragraph("some words") + paragraph("Below", "Heading2") + paragraph("more words") + "</w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    files = read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("file_id"), F.lit("a.docx").alias("path"), F.lit(out.getvalue()).alias("content"))
    return chunk_files(files, keep=["file_id"]).select("file_id", "chunk_index", "title", F.array_join("breadcrumb", " > ").alias("section"))


QUERIES["chunk_docx"] = chunk_docx
ORACLES["chunk_docx"] = "SELECT n_nationkey::BIGINT AS file_id, i::BIGINT AS chunk_index, title, section FROM nation, (VALUES (0, 'Top', 'Top'), (1, 'Below', 'Top > Below')) v(i, title, section)"


def chunk_full_file(spark, sf):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = [(i, c.chunk_type, c.start_line, c.end_line, len(c.text)) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for c in full_file("text", x or "")]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(columns)], names=["doc_id", "chunk_type", "start_line", "end_line", "n"])

    rows = read_table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, chunk_type string, start_line bigint, end_line bigint, n bigint")


QUERIES["chunk_full_file"] = chunk_full_file
ORACLES["chunk_full_file"] = """SELECT doc_id, 'full_file' AS chunk_type, 1::BIGINT AS start_line, greatest(1, len(string_split(text, chr(10))) - ends_with(text, chr(10))::INT)::BIGINT AS end_line,
 length(rtrim(text, chr(10) || chr(13)))::BIGINT AS n FROM documents WHERE rtrim(text, chr(10) || chr(13)) <> ''"""
