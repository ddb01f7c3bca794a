"""Languages with structure beyond lines: Markdown, HTML, CSS, JSON, TOML, YAML, SQL, prose and DOCX."""

from __future__ import annotations

import io
import json
import re
import zipfile

from docuforge.functions.chunking.base import Chunk, Limits, brace_change, chunk, lines_of, plain_blocks, size
from docuforge.functions.chunking.dialects import _element_name


def joined(lines: list[str], a: int, b: int) -> str:
    return "\n".join(lines[a:b])


def between(starts: list[int], end: int):
    return zip(starts, [*starts[1:], end])


# --- Markdown -------------------------------------------------------------------

_FENCE = ("```", "~~~")
_ITEM = re.compile(r"[-*+] |[0-9]+\.")


def heading(line: str) -> tuple[int, str] | None:
    m = re.match(r"(#{1,6})(?!#)(.*)$", line)
    return (len(m[1]), m[2].strip().strip("#").strip()) if m and m[2].strip() else None


class Outline:
    """The headings open at a point, outermost first."""

    def __init__(self):
        self.open: list[tuple[int, str]] = []

    def enter(self, level: int, title: str) -> list[str]:
        self.open = [x for x in self.open if x[0] < level]
        self.open.append((level, title))
        return [t for _, t in self.open]


def markdown(path: str, text: str) -> list[Chunk]:
    lines, limits, outline = lines_of(text), Limits(900, 1500), Outline()
    sections, begin, trail, fenced = [], 0, [], False
    for i, line in enumerate(lines):
        stripped = line.strip()
        if stripped.startswith(_FENCE):
            fenced = not fenced
        elif not fenced and (found := heading(stripped)):
            if i > begin:
                sections.append((begin, i, trail))
            trail, begin = outline.enter(*found), i
    if begin < len(lines):
        sections.append((begin, len(lines), trail))
    out: list[Chunk] = []
    for a, b, trail in sections:
        body, title = joined(lines, a, b), trail[-1] if trail else None
        make = lambda first, last, part: chunk(path, "markdown", "markdown_section", title, trail, first, last, part.strip())  # noqa: B023, E731
        if size(body) <= limits.target:
            out.append(make(a + 1, b, body))
            continue
        held, since, at = "", 0, 0
        for block in _markdown_blocks(lines[a:b]):
            part = "\n".join(block)
            if size(held) and size(held) + size(part) > limits.target:
                out.append(make(a + 1 + since, a + 1 + at, held))
                held, since = "", at
            held, at = held + part + "\n\n", at + len(block)
        if held.strip():
            out.append(make(a + 1 + since, b, held))
    return out


def _markdown_blocks(lines: list[str]):
    """Fences, tables, lists and paragraphs, each as its lines; a paragraph takes the blank line after it."""
    i = 0
    while i < len(lines):
        a, stripped = i, lines[i].strip()
        i += 1
        if stripped.startswith(_FENCE):
            while i < len(lines) and not lines[i].strip().startswith(stripped[:3]):
                i += 1
            i = min(i + 1, len(lines))
        elif stripped.startswith("|") and i < len(lines) and not set(lines[i].strip()) - set("|-: "):
            i += 1
            while i < len(lines) and lines[i].strip().startswith("|"):
                i += 1
        elif _ITEM.match(stripped):
            while i < len(lines) and (not lines[i].strip() or _ITEM.match(lines[i].strip()) or lines[i].startswith(("  ", "\t"))):
                i += 1
        else:
            while i < len(lines) and lines[i].strip():
                i += 1
            i = min(i + 1, len(lines))
        yield lines[a:i]


# --- HTML and CSS -----------------------------------------------------------------

# The elements at which a page is cut.
_ELEMENTS = ("<main", "<section", "<article", "<nav", "<form", "<template", "<header", "<footer", "<script", "<style")


def html(path: str, text: str, script) -> list[Chunk]:
    """``script`` chunks the source of script elements."""
    lines, limits = lines_of(text), Limits(700, 1200)
    starts = [i for i, x in enumerate(lines) if x.lstrip().startswith(_ELEMENTS)]
    if not starts:
        return plain_blocks(path, "html", "html_block", [], text, limits)
    out: list[Chunk] = []
    for a, b in between(starts, len(lines)):
        body = joined(lines, a, b)
        inner = "\n".join(x for x in lines[a:b] if not x.strip().startswith(("<script", "</script", "<style", "</style")))
        if lines[a].lstrip().startswith("<script"):
            out += script(path, inner)
        elif lines[a].lstrip().startswith("<style"):
            out += css(path, inner)
        elif size(body) <= limits.target:
            out.append(chunk(path, "html", "html_subtree", _element_name(lines[a].strip()), [], a + 1, b, body))
        else:
            out += plain_blocks(path, "html", "html_subtree", [], body, limits)
    return out


def css(path: str, text: str) -> list[Chunk]:
    lines, limits = lines_of(text), Limits(600, 1000)
    groups, begin, depth = [], 0, 0
    for i, line in enumerate(lines):
        before, depth = depth, depth + brace_change(line)
        if before > 0 and depth == 0:
            groups.append((begin, i + 1))
            begin = i + 1
        depth = max(depth, 0)
    groups.append((begin, len(lines)))
    out: list[Chunk] = []
    for a, b in groups:
        body = joined(lines, a, b)
        if not body.strip():
            continue
        first = next(x.strip() for x in lines[a:b] if x.strip())
        new = chunk(path, "css", "css_rule_group", first.split("{")[0].strip()[:120], [], a + 1, b, body)
        if out and size(out[-1].text) + size(new.text) <= limits.target:  # small rules are packed
            out[-1] = out[-1]._replace(end_line=b, text=out[-1].text + "\n\n" + new.text)
        else:
            out.append(new)
    return out


# --- JSON, TOML, YAML -------------------------------------------------------------------


def json_values(path: str, text: str) -> list[Chunk]:
    """Values small enough, found from the root down, each with its JSON path; keys in code point order."""
    try:
        root = json.loads(text, parse_constant=lambda x: json.loads(""))
    except ValueError:
        return plain_blocks(path, "json", "json_invalid_text", [], text, Limits())
    out: list[Chunk] = []

    def visit(where: str, value) -> None:
        pretty = json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True)
        nested = isinstance(value, (dict, list))
        if size(pretty) <= 600 or not nested:
            kind = "json_object" if size(pretty) <= 600 else "json_value"
            out.append(chunk(path, "json", kind, where, [where], 1, 1, f"JSON path: {where}\n\n{pretty}"))
        elif isinstance(value, dict):
            for key in sorted(value):
                visit(f"{where}.{key}", value[key])
        else:
            for i, item in enumerate(value):
                known = next((item[k] for k in ("id", "name", "slug", "key", "title") if isinstance(item.get(k), str)), None) if isinstance(item, dict) else None
                visit(f"{where}[{i}]" + (f"#{known}" if known is not None else ""), item)

    visit("$", root)
    return out


def toml(path: str, text: str) -> list[Chunk]:
    lines, limits = lines_of(text), Limits(600, 1000)
    header = lambda x: x.startswith("[") and x.endswith("]")
    spans, begin, lead = [], 0, None
    for i, line in enumerate(lines):
        stripped = line.strip()
        if stripped.startswith("#") and lead is None:
            lead = i
        if header(stripped):
            if i > begin:
                spans.append((begin, i))
            begin, lead = (i if lead is None else lead), None
        if stripped and not stripped.startswith("#"):
            lead = None
    if begin < len(lines):
        spans.append((begin, len(lines)))
    out: list[Chunk] = []
    for a, b in spans:
        body = joined(lines, a, b)
        title = next((x.strip().strip("[").strip("]") for x in lines[a:b] if header(x.strip())), "top-level")
        if size(body) <= limits.target:
            out.append(chunk(path, "toml", "toml_table", title, [title], a + 1, b, body))
        else:
            out += plain_blocks(path, "toml", "toml_table", [title], body, limits)
    return out


def yaml(path: str, text: str) -> list[Chunk]:
    lines = lines_of(text)
    if any(x.strip() == "---" for x in lines):
        return _yaml_documents(path, lines)
    for parent, kind, also in (("services", "docker_compose_service", ""), ("jobs", "github_actions_job", "on:")):
        if f"{parent}:" in text and also in text:
            return _yaml_children(path, text, lines, parent, kind)
    return _yaml_keys(path, text, lines)


def _yaml_keys(path: str, text: str, lines: list[str]) -> list[Chunk]:
    starts = [i for i, x in enumerate(lines) if not x.startswith((" ", "\t")) and ":" in x and not x.lstrip().startswith("#")]
    if not starts:
        return plain_blocks(path, "yaml", "yaml_document", [], text, Limits(600, 1000))
    named = ((a, b, lines[a].split(":")[0].strip()) for a, b in between(starts, len(lines)))
    return [chunk(path, "yaml", "yaml_object", t, [t], a + 1, b, joined(lines, a, b)) for a, b, t in named]


def _yaml_documents(path: str, lines: list[str]) -> list[Chunk]:
    """Separated documents, titled kind/name or by their first line."""
    spans = []
    held: list[str] = []
    first = 1
    for i, line in enumerate(lines):
        if line.strip() == "---" and held:
            spans.append((first, i, held))
            held, first = [], i + 2
        else:
            held.append(line)
    if held:
        spans.append((first, len(lines), held))
    out = []
    for a, b, part in spans:
        seen = {}
        for x in part:
            for key in ("kind", "name"):
                if x.strip().startswith(key + ":"):
                    seen[key] = x.strip()[len(key) + 1 :].strip()
        title = "/".join(seen[k] for k in ("kind", "name") if k in seen) if "kind" in seen else f"document-{a}"
        out.append(chunk(path, "yaml", "yaml_document", title, [title], a, b, "\n".join(part)))
    return out


def _yaml_children(path: str, text: str, lines: list[str], parent: str, kind: str) -> list[Chunk]:
    """Keys two blanks below the parent, read to the end of the file."""
    top = next((i for i, x in enumerate(lines) if x.strip() == f"{parent}:"), None)
    if top is None:
        return _yaml_keys(path, text, lines)
    starts = [i for i, x in enumerate(lines) if i > top and x.startswith("  ") and not x.startswith("    ") and x.rstrip().endswith(":")]
    named = ((a, b, f"{parent}.{lines[a].strip().rstrip(':')}") for a, b in between(starts, len(lines)))
    return [chunk(path, "yaml", kind, t, [t], a + 1, b, joined(lines, a, b)) for a, b, t in named]


# --- Python cells, SQL, prose -------------------------------------------------------------


def cells(path: str, text: str) -> list[Chunk]:
    lines = lines_of(text)
    starts = sorted({0, *(i for i, x in enumerate(lines) if x.strip() == "# %%")}) if lines else []
    return [chunk(path, "python", "python_cell", f"cell-{a + 1}", [], a + 1, b, joined(lines, a, b)) for a, b in between(starts, len(lines))]


# Statements that are named by what they act on.
_STATEMENTS = (
    "create table ", "create view ", "create materialized view ", "create function ", "create trigger ", "create index ",
    "alter table ", "drop table ", "insert into ", "update ", "delete from ",
)


def _statement_name(statement: str) -> str | None:
    line = next((x.strip() for x in lines_of(statement) if x.strip() and not x.strip().startswith("--")), None)
    if line is None:
        return None
    verb = next((v for v in _STATEMENTS if line.lower().startswith(v)), None)
    words = line[len(verb or "") :].split()
    return verb + (words[0].strip('"') if words else "") if verb else words[0]


def sql(path: str, text: str) -> list[Chunk]:
    lines, limits = lines_of(text), Limits(700, 1200)
    out: list[Chunk] = []
    held, first = "", 1
    for i, line in enumerate(lines):
        if not held.strip():
            first = i + 1
        held += line + "\n"
        if not (line.rstrip().endswith(";") or i == len(lines) - 1) or not held.strip():
            continue
        title = _statement_name(held)
        trail = [title] if title is not None else []
        if size(held) > limits.hard:
            out += plain_blocks(path, "sql", "sql_statement", trail, held, limits)
        else:
            out.append(chunk(path, "sql", "sql_statement", title, trail, first, i + 1, held.strip()))
        held = ""
    return out


def is_heading(line: str, after: str | None) -> bool:
    """Underlined, in capitals, numbered, or up to ten words that all start with a capital or digit."""
    line = line.strip()
    if not line:
        return False
    if after is not None and len(after.strip()) >= 3 and not set(after.strip()) - set("-="):
        return True
    if len(line.encode()) < 80 and not any(c.islower() for c in line) and any(c.isalpha() for c in line):
        return True
    words = line.split()
    if "." in words[0] and not set(words[0]) - set("0123456789."):
        return True
    return len(words) <= 10 and all(w[0].isupper() or w[0] in "0123456789" for w in words)


def prose(path: str, text: str) -> list[Chunk]:
    lines, limits = lines_of(text), Limits(900, 1500)
    starts = [i for i, x in enumerate(lines) if is_heading(x, lines[i + 1] if i + 1 < len(lines) else None)]
    if not starts:
        return plain_blocks(path, "text", "plain_text", [], text, limits)
    out: list[Chunk] = []
    for a, b in between(starts, len(lines)):
        body, title = joined(lines, a, b), lines[a].strip()
        if size(body) <= limits.target:
            out.append(chunk(path, "text", "plain_text_section", title, [title], a + 1, b, body))
        else:
            out += plain_blocks(path, "text", "plain_text_section", [title], body, limits)
    return out


# --- DOCX -------------------------------------------------------------------------------

_RUN = re.compile(r"<w:t[^>]*>(.*?)</w:t>", re.S)


def unescape(text: str) -> str:
    for name, c in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        text = text.replace(f"&{name};", c)
    return text


def docx_xml(content: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return z.read("word/document.xml").decode()
    except (zipfile.BadZipFile, KeyError, UnicodeDecodeError):
        return None


def docx(path: str, content: bytes) -> list[Chunk]:
    """Sections below headings of levels 1 to 3; tables stand after all paragraphs once more, each by itself."""
    xml = docx_xml(content)
    if xml is None:
        return []
    limits, outline = Limits(900, 1500), Outline()
    runs = lambda part: "".join(unescape(x) + " " for x in _RUN.findall(part))
    blocks: list[tuple[int, str]] = []  # level 1 to 3: heading, 0: paragraph, -1: table
    for part in xml.split("<w:p"):
        if text := runs(part).strip():
            blocks.append((next((n for n in (1, 2, 3) if f"Heading{n}" in part or f"heading {n}" in part), 0), text))
    blocks += [(-1, t) for part in xml.split("<w:tbl")[1:] if (t := runs(part)).strip()]
    out: list[Chunk] = []
    held, first, trail = "", 0, []

    def flush(end: int) -> None:
        if held.strip():
            if size(held) <= limits.target:
                out.append(chunk(path, "docx", "docx_section", trail[-1] if trail else None, trail, first + 1, end, held.strip()))
            else:
                out.extend(plain_blocks(path, "docx", "docx_section", trail, held, limits))

    for i, (level, text) in enumerate(blocks):
        if level < 0:
            if size(held) > limits.target:
                flush(i + 1)
                held, first = "", i
            out.append(chunk(path, "docx", "docx_table", trail[-1] if trail else None, trail, i + 1, i + 1, text))
            continue
        if level:
            flush(i + 1)
            held, first, trail = "", i, outline.enter(level, text)
        held += text + "\n\n"
    flush(len(blocks))
    return out
