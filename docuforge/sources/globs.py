"""Globs and ignore files as Java regular expressions, compiled once on the driver."""

from __future__ import annotations

import re

# What is indexed as text, as images, and what never is.
TEXT_TYPES = ("rs", "js", "ts", "jsx", "tsx", "py", "go", "zig", "gd", "html", "css", "json", "toml", "tmol", "yml", "yaml", "cs", "c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx", "java", "kt", "kts", "swift", "sql", "xml", "svg", "lua", "glsl", "vert", "frag", "comp", "hlsl", "wgsl", "sh", "bash", "zsh", "mk", "md", "mdx", "txt", "rst", "adoc", "org", "ehmeta", "docx")
TEXT_INCLUDE = ["AGENTS.md", "README*", "CHANGELOG*", "CONTRIBUTING*", "docs/**", "**/Dockerfile", "**/Dockerfile.*", "**/Makefile", *(f"**/*.{t}" for t in TEXT_TYPES)]
IMAGE_INCLUDE = [f"**/*.{t}" for t in ("png", "jpg", "jpeg", "webp", "gif", "bmp", "tif", "tiff")]
EXCLUDE = [".git/**", "node_modules/**", "dist/**", "build/**", "target/**", ".next/**", ".venv/**", "__pycache__/**", "*.lock"]


def _body(glob: str, star: str, mark: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out += "[" + ("^" if inner[0] in "!^" else "") + re.escape(inner.lstrip("!^")).replace(r"\-", "-") + "]"
            i = end
        elif c == "{" and (end := glob.find("}", i)) > 0:
            out += "(?:" + "|".join(_body(x, star, mark) for x in glob[i + 1 : end].split(",")) + ")"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += star if c == "*" else mark if c == "?" else re.escape(c)
        i += 1
    return out


def glob_pattern(globs: list[str]) -> str:
    """A pattern for whole paths that any of the globs matches; ``*`` crosses ``/``.  Nothing matches an empty list."""
    return "(?s)^(?:" + "|".join(_body(g, ".*", ".") for g in globs) + ")$" if globs else "(?!)"


class Ignore:
    """Ignore rules of one file: later rules win, ``!`` re-includes, a final ``/`` means directories, an inner ``/`` anchors."""

    def __init__(self, text: str):
        self.rules: list[tuple[bool, bool, re.Pattern]] = []
        for line in text.split("\n"):
            line = line.rstrip("\r")
            line = line if line.endswith("\\ ") else line.rstrip(" ")
            if not line or line.startswith("#"):
                continue
            again = line.startswith("!")
            line = line[again:].removeprefix("\\") if line[again:].startswith(("\\#", "\\!")) else line[again:]
            only_dirs = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            body = _body(line.lstrip("/"), "[^/]*", "[^/]")
            self.rules.append((again, only_dirs, re.compile(f"(?s)^{'' if anchored else '(?:.*/)?'}{body}$")))

    def matches(self, path: str, is_dir: bool) -> bool:
        hit = False
        for again, only_dirs, pattern in self.rules:
            if (is_dir or not only_dirs) and pattern.match(path):
                hit = not again
        return hit

    def ignored(self, path: str, is_dir: bool = False) -> bool:
        """Whether the path or a directory above it is ignored."""
        parts = path.split("/")
        return any(self.matches("/".join(parts[:k]), True) for k in range(1, len(parts))) or self.matches(path, is_dir)
