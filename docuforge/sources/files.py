"""Sources: files of a project tree, with ignore rules, and the corpus tables as files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docuforge.functions.chunking.structured import docx_xml
from docuforge.functions.text import file_type, unix_lines
from docuforge.sources.globs import EXCLUDE, IMAGE_INCLUDE, TEXT_INCLUDE, Ignore, glob_pattern

IGNORE_FILE, SKIP_MARKER = ".indexignore", ".indexskip"


def classify(path: Column, text: list[str] = TEXT_INCLUDE, image: list[str] = IMAGE_INCLUDE, text_exclude: list[str] = EXCLUDE, image_exclude: list[str] = EXCLUDE) -> Column:
    """image, text or null: images win, exclusion beats inclusion."""
    is_image = path.rlike(glob_pattern(image)) & ~path.rlike(glob_pattern(image_exclude))
    is_text = path.rlike(glob_pattern(text)) & ~path.rlike(glob_pattern(text_exclude))
    return F.when(is_image, "image").when(is_text, "text")


def tree_paths(root: str, target: str = ".") -> list[str]:
    """Paths below ``target`` relative to ``root``, sorted: without ignored ones and below no folder with a skip marker.

    Hidden files count.  Neither rule applies to the start of the walk itself.
    """
    root = os.path.realpath(root)
    start = os.path.realpath(os.path.join(root, target))
    if not os.path.exists(start):
        raise FileNotFoundError(f"no such path: {target}")
    if start != root and not start.startswith(root + os.sep):
        raise ValueError(f"{target} is outside {root}")
    rules = os.path.join(root, IGNORE_FILE)
    ignore = Ignore(open(rules, encoding="utf-8").read() if os.path.exists(rules) else "")
    relative = lambda p: os.path.relpath(p, root).replace(os.sep, "/")
    if os.path.isfile(start):
        above = relative(start).split("/")[:-1]
        skipped = any(os.path.exists(os.path.join(root, *above[:k], SKIP_MARKER)) for k in range(len(above) + 1))
        return [] if skipped or ignore.ignored(relative(start)) else [relative(start)]
    out = []
    for folder, folders, names in os.walk(start):
        folders[:] = [d for d in folders if not os.path.exists(os.path.join(folder, d, SKIP_MARKER)) and not ignore.matches(relative(os.path.join(folder, d)), True)]
        out += [p for n in names if not ignore.matches(p := relative(os.path.join(folder, n)), False)]
    return sorted(out)


def discover(spark: SparkSession, root: str, target: str = ".", text: list[str] = TEXT_INCLUDE, image: list[str] = IMAGE_INCLUDE, exclude: list[str] = EXCLUDE) -> DataFrame:
    """(path, kind) of the files to index.  The listing is driver metadata, as in any file scan; contents are read by executors."""
    paths = spark.createDataFrame([(p,) for p in tree_paths(root, target)], "path string")
    return paths.select("path", classify(F.col("path"), text, image, exclude, exclude).alias("kind")).where("kind is not null")


def scan_binary(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, size_bytes, modified_at) of every file below a folder, read by executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = os.path.realpath(root).rstrip("/") if "://" not in root else root.rstrip("/")
    relative = F.expr(f"substring(path, instr(path, '{base}/') + {len(base) + 1})")
    return files.select(F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))).alias("path"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def extract_text(files: DataFrame) -> DataFrame:
    """``files`` (path, content binary...) with ``text`` and ``error``: UTF-8 with LF line ends, DOCX as paragraphs.

    Files that are no UTF-8, or no DOCX inside, get a null text and an error instead of stopping the run.
    """
    at = files.columns.index("content"), files.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for content, path in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist()):
                text, error = _text_of(path or "", content or b"")
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "text", "error"])

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("text", StringType()), StructField("error", StringType())]))


def _text_of(path: str, content: bytes) -> tuple[str | None, str | None]:
    if path.lower().endswith(".docx"):
        xml = docx_xml(content)
        return (docx_text(xml), None) if xml is not None else (None, "no word/document.xml inside")
    try:
        return content.decode().replace("\r\n", "\n").replace("\r", "\n"), None
    except UnicodeDecodeError as e:
        return None, str(e)


def docx_text(xml: str) -> str:
    """Text runs in order; tabs, breaks and paragraph ends become tabs and single line breaks."""
    import re

    out = ""
    for m in re.finditer(r"<w:t(?: [^>]*)?>(.*?)</w:t>|(<w:tab)|(<w:br|<w:cr|</w:p>)", xml, re.S):
        if m[1] is not None:
            text = m[1]
            for name, c in (("lt", "<"), ("gt", ">"), ("amp", "&"), ("apos", "'"), ("quot", '"')):
                text = text.replace(f"&{name};", c)
            out += text
        elif m[2]:
            out += "\t"
        elif not out.endswith("\n"):
            out += "\n"
    return out.strip()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, content, file_type, size_bytes) of the table documents."""
    d = read_table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    d = d.select(F.col("doc_id").alias("file_id"), path.alias("path"), unix_lines(F.col("text")).alias("content"))
    return d.select("*", file_type(F.col("path")).alias("file_type"), F.octet_length("content").cast("long").alias("size_bytes"))


def turn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, file_id, chunk_index, path, text) of the table conversations: a conversation is a file, a turn a chunk."""
    c = read_table(spark, sf_dir, "conversations")
    path = F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit(".md"))
    return c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("file_id"), F.col("turn").alias("chunk_index"), path.alias("path"), "text")
