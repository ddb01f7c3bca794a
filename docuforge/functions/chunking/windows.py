"""Chunks of whole files and of overlapping line windows, by whitespace-separated words."""

from __future__ import annotations

from docuforge.functions.chunking.base import Chunk, lines_of


def line_windows(text: str, target: int = 450, most: int = 900, overlap: int = 80, min_bytes: int = 80) -> list[tuple[int, int, int, str]]:
    """(first line, last line, words, text): windows end once they have ``target`` words and ``min_bytes`` bytes, or before passing ``most``.

    The next window starts so that it repeats ``overlap`` words or more, and at least one line later.
    """
    lines = lines_of(text)
    words = [len(x.split()) for x in lines]
    target = max(target, 1)
    most, out, a = max(most, target), [], 0
    while a < len(lines):
        b, n, n_bytes = a, 0, -1
        while b < len(lines) and (b == a or n + words[b] <= most):
            n, n_bytes, b = n + words[b], n_bytes + 1 + len(lines[b].encode()), b + 1
            if n >= target and n_bytes >= min_bytes:
                break
        out.append((a + 1, b, n, "\n".join(lines[a:b])))
        if b >= len(lines):
            break
        back, seen = b, 0
        while overlap and back > a and seen < overlap:
            back -= 1
            seen += words[back]
        a = back if back > a else min(a + 1, b)
    return out


def line_window_chunks(language: str, text: str, target: int = 300, most: int = 900, overlap: int = 100) -> list[Chunk]:
    return [Chunk(language, "line_window", None, [], a, b, body) for a, b, _, body in line_windows(text, target, most, overlap, 1)]


def full_file(language: str, text: str) -> list[Chunk]:
    body = text.rstrip("\r\n")
    return [Chunk(language, "full_file", None, [], 1, max(1, len(lines_of(text))), body)] if body else []
