"""What every chunker shares: lines, size estimates, chunk rows and the packing of plain blocks."""

from __future__ import annotations

import re
from typing import NamedTuple


class Chunk(NamedTuple):
    language: str
    chunk_type: str
    title: str | None
    breadcrumb: list[str]
    start_line: int
    end_line: int
    text: str


class Limits(NamedTuple):
    """Sizes in estimated tokens: above ``target`` a unit is split, above ``hard`` always."""

    target: int = 900
    hard: int = 1500


def lines_of(text: str) -> list[str]:
    """Lines ended by LF, one CR before it dropped; no empty line after the last LF."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x[:-1] if x.endswith("\r") else x for x in lines]


def size(text: str) -> int:
    """Estimated tokens: four characters each."""
    return len(text) // 4


def chunk(path: str, language: str, kind: str, title: str | None, breadcrumb: list[str], start: int, end: int, body: str) -> Chunk:
    """A chunk whose text starts with a header that makes path, language and symbol searchable."""
    head = [f"File: {path}", f"Language: {language}", f"Chunk type: {kind}"]
    if breadcrumb:
        head.append("Section: " + " > ".join(breadcrumb))
    if title is not None:
        head.append(f"Symbol: {title}")
    return Chunk(language, kind, title, breadcrumb, start, end, "\n".join(head) + "\n\n" + body)


def at_blank_lines(lines: list[str], target: int) -> list[tuple[int, int, int, str]]:
    """(first line, line it ends at, line index of the cut, text): cut at the first blank line after ``target`` is passed."""
    out, first, held = [], 0, ""
    for i, line in enumerate(lines):
        if not line.strip() and size(held) > target and held.strip():
            out.append((first, i, i, held.strip()))
            first, held = i + 1, ""
        else:
            held += line + "\n"
    if held.strip():
        out.append((first, len(lines), len(lines), held.strip()))
    return out


def plain_blocks(path: str, language: str, kind: str, breadcrumb: list[str], text: str, limits: Limits) -> list[Chunk]:
    """Text without structure, cut at blank lines; titled by the innermost section."""
    lines, title = lines_of(text), breadcrumb[-1] if breadcrumb else None
    found = at_blank_lines(lines, limits.target)
    return [chunk(path, language, kind, title, breadcrumb, a + 1, min(b + 1, len(lines)), body) for a, b, _, body in found]


def code_blocks(path: str, language: str, title: str | None, body: str, start: int, limits: Limits) -> list[Chunk]:
    """An oversized unit of code, cut at blank lines; ``start`` is the number of its first line."""
    return [chunk(path, language, "code_block", title, [], start + a, start + b, text) for a, b, _, text in at_blank_lines(lines_of(body), limits.target)]


_QUOTED = re.compile(r"\\.|\\$")


def brace_change(line: str) -> int:
    """Opening less closing braces outside quotes on the line."""
    if "{" not in line and "}" not in line:
        return 0
    change, quote = 0, ""
    for c in _QUOTED.sub("", line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        else:
            change += (c == "{") - (c == "}")
    return change
