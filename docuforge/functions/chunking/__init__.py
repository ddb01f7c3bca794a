"""Structure-aware chunking: the dialect of a file by its name, and chunks as a table function over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuforge.functions.chunking import dialects as D
from docuforge.functions.chunking import structured as S
from docuforge.functions.chunking.base import Chunk
from docuforge.functions.chunking.windows import line_windows

# The dialect of each extension, and the language names that go by extension.
_DIALECTS = {
    "gd": D.GDSCRIPT, "rs": D.RUST, "go": D.GO, "zig": D.ZIG, "cs": D.CSHARP, "java": D.JAVA, "kt": D.KOTLIN, "kts": D.KOTLIN, "swift": D.SWIFT, "lua": D.LUA,
    **dict.fromkeys("js ts jsx tsx".split(), D.SCRIPT), **dict.fromkeys("c cc cpp cxx h hh hpp hxx".split(), D.CPP),
    **dict.fromkeys("xml svg".split(), D.XML), **dict.fromkeys("glsl vert frag comp hlsl wgsl".split(), D.SHADER), **dict.fromkeys("sh bash zsh".split(), D.SHELL),
}
_LANGUAGES = {"ts": "typescript", "tsx": "tsx", "jsx": "jsx", "c": "c", "h": "c_or_cpp_header", "svg": "svg", "wgsl": "wgsl", "hlsl": "hlsl", "mk": "makefile"}
_STRUCTURED = {"md": S.markdown, "markdown": S.markdown, "txt": S.prose, "css": S.css, "json": S.json_values, "toml": S.toml, "tmol": S.toml, "yml": S.yaml, "yaml": S.yaml, "sql": S.sql}
_CODE_MARKS = ("function ", "class ", "const ", "let ", "var ", "fn ", "def ", "func ", "import ", "use ", "package ", "{", "}", "=>")


def smart_chunks(path: str, content: str | bytes) -> list[Chunk]:
    """Chunks of a file by its name and, where that says nothing, by its looks.  DOCX files are given as bytes."""
    name, ext = path.rsplit("/", 1)[-1].lower(), path.rsplit(".", 1)[-1].lower()
    if ext == "docx":
        return S.docx(path, content if isinstance(content, bytes) else content.encode())
    text = content.decode("utf-8", "replace") if isinstance(content, bytes) else content
    if name == "dockerfile" or name.startswith("dockerfile."):
        return D.run(D.DOCKERFILE, path, text)
    if name == "makefile" or name.endswith(".mk"):
        return D.run(D.MAKEFILE, path, text)
    if ext == "py":
        return S.cells(path, text) if "# %%" in text else D.run(D.PYTHON, path, text)
    if ext in ("html", "htm"):
        return S.html(path, text, lambda p, script: D.run(D.SCRIPT, p, script))
    if ext in _STRUCTURED:
        return _STRUCTURED[ext](path, text)
    if ext in _DIALECTS:
        return D.run(_DIALECTS[ext], path, text, _LANGUAGES.get(path.rsplit(".", 1)[-1]))
    if sum(mark in text for mark in _CODE_MARKS) >= 3:
        return D.run(D.GENERAL, path, text)
    return S.prose(path, text)


CHUNK_SCHEMA = "chunk_index bigint, language string, chunk_type string, title string, breadcrumb array<string>, start_line bigint, end_line bigint, text string"


def chunk_files(files: DataFrame, mode: str = "smart", path_col: str = "path", content_col: str = "content", keep: list[str] | None = None, **window) -> DataFrame:
    """One row a chunk: the columns ``keep``, then CHUNK_SCHEMA.

    ``mode`` is smart, line-window (with the options of ``line_windows``) or off.  Only "off" stays
    on the JVM; the others read lines with state, a batch of files at a time.
    Files with null content, and empty ones, have no chunks; "off" keeps a chunk of empty text.
    """
    keep = keep or [path_col]
    if mode == "off":
        lines = F.size(F.split(F.col(content_col), "\n")) - F.when(F.col(content_col).endswith("\n"), 1).otherwise(0)
        own = [F.lit(0).cast("long").alias("chunk_index"), F.lit(None).cast("string").alias("language"), F.lit("off").alias("chunk_type"), F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("breadcrumb")]
        return files.where(F.col(content_col).isNotNull()).select(*keep, *own, F.lit(1).cast("long").alias("start_line"), F.greatest(lines, F.lit(1)).cast("long").alias("end_line"), F.col(content_col).alias("text"))
    n = len(keep)

    def chunks(path: str, content) -> list[Chunk]:
        if mode == "smart":
            return smart_chunks(path, content)
        return [Chunk("", "line_window", None, [], a, b, body) for a, b, _, body in line_windows(content, **window)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, rows = [], []
            for i, (path, content) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())):
                for k, c in enumerate(chunks(path or "", content) if content is not None else ()):
                    parent.append(i)
                    rows.append((k, *c))
            own = [x.take(pa.array(parent, pa.int32())) for x in batch.columns[:n]]
            columns = list(zip(*rows)) if rows else [()] * 8
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
            names = [*keep, *(x.split()[0] for x in CHUNK_SCHEMA.split(", "))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema.fields)
    return files.select(*keep, F.col(path_col).alias("_path"), F.col(content_col).alias("_content")).mapInArrow(run, f"{schema}, {CHUNK_SCHEMA}")
