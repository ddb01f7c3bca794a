"""Text and path functions as column expressions; everything here stays inside whole-stage code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(query: str) -> str:
    """Words of a query in lower case, joined by one blank; also the key of the query cache."""
    return " ".join(query.split()).lower()


def normalize_column(query: Column) -> Column:
    """``normalize`` for a column of queries."""
    return F.lower(F.trim(F.regexp_replace(query, r"(?U)\s+", " ")))


def tokens_of(query: str) -> list[str]:
    """Distinct runs of ASCII letters and digits of the normalised query, in order."""
    return list(dict.fromkeys(t for t in re.split("[^0-9A-Za-z]+", normalize(query)) if t))


def tokens_column(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(normalize_column(text), "[^0-9A-Za-z]+"), ""))


def keyword_score(query: str, text: Column) -> Column:
    """Share of the query's tokens found anywhere in the text; 1 if the whole query is.  0 without tokens; null text scores 0.

    The query is a literal, so tokens are folded once into the plan.
    """
    tokens, whole = tokens_of(query), normalize(query)
    if not tokens:
        return F.lit(0.0)
    low = F.lower(F.coalesce(text, F.lit("")))
    found = sum((low.contains(t).cast("int") for t in tokens[1:]), low.contains(tokens[0]).cast("int"))
    return F.when(low.contains(whole), 1.0).otherwise(found / F.lit(float(len(tokens))))


def keyword_score_by(query: Column, text: Column) -> Column:
    """``keyword_score`` where every row brings its own query."""
    tokens, low = tokens_column(query), F.lower(F.coalesce(text, F.lit("")))
    share = F.size(F.filter(tokens, lambda t: low.contains(t))) / F.greatest(F.size(tokens), F.lit(1))
    whole = (F.size(tokens) > 0) & low.contains(normalize_column(query))
    return F.when(whole, 1.0).otherwise(share)


def match_terms(query: str) -> list[str]:
    """The terms of a match query: runs of letters and digits, lower-cased, repeats kept."""
    return [t.lower() for t in re.findall(r"[^\W_]+", query)]


def snippet(text: Column, n: int = 700) -> Column:
    return F.substring(text, 1, n)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"(?U)\s+"), ""))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.char_length(text) / 4).cast("long")


def line_range(text: Column, first: int, last: int) -> Column:
    """Lines ``first`` to ``last``, counted from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


def file_type(path: Column) -> Column:
    """The extension in lower case; empty for names without one or with only a leading dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def normalized_type(value: str) -> str:
    return value.strip().lstrip(".").lower()


def percent_encoded(path: Column) -> Column:
    """Percent-encoding of all bytes but letters, digits and ``/.-_~:``."""
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%3A", ":"), ("%7E", "~")):
        path = F.replace(path if found != "+" else F.url_encode(path), F.lit(found), F.lit(wanted))
    return path


def source_uri(root: str, path: Column, start_line: Column) -> Column:
    line = F.when(start_line.isNotNull(), F.concat(F.lit("#L"), start_line.cast("string"))).otherwise("")
    return F.concat(F.lit("file://"), percent_encoded(F.concat(F.lit(root.rstrip("/") + "/"), path)), line)


def line_suffix(start_line: Column, end_line: Column) -> Column:
    both = F.concat(F.lit(":"), start_line.cast("string"), F.lit("-"), end_line.cast("string"))
    return F.when(start_line.isNotNull() & end_line.isNotNull(), both).otherwise("")


def content_hash(content: Column) -> Column:
    """Identity of a content; SHA-256, as BLAKE3 is no built-in."""
    return F.sha2(content, 256)


def xml_text(text: Column) -> Column:
    for name, c in (("lt", "<"), ("gt", ">"), ("amp", "&"), ("apos", "'"), ("quot", '"')):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(c))
    return text


def reason(vector: Column, keyword: Column, metadata: Column, rerank: Column) -> Column:
    """Which parts of a score are above zero, joined by `` + ``."""
    parts = [F.when(score > 0, F.lit(name)) for name, score in (("vector", vector), ("keyword", keyword), ("metadata", metadata), ("rerank", rerank))]
    return F.array_join(F.array_compact(F.array(*parts)), " + ")
