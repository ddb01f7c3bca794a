"""Configuration: frozen sections with defaults, TOML files that overlay them, and validation."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace

from docuforge.sources.globs import EXCLUDE, IMAGE_INCLUDE, TEXT_INCLUDE


@dataclass(frozen=True)
class Embedding:
    provider: str = "native"
    engine: str = "hashing"
    model: str = "nomic-embed-text-v1.5"
    variant: str = "quantized"
    dimensions: int = 768
    batch_size: int = 64
    query_cache: bool = True
    endpoint: str | None = None
    api_key_env: str | None = None
    document_prefix: str = "search_document: "
    query_prefix: str = "search_query: "


@dataclass(frozen=True)
class Weights:
    vector: float = 0.65
    keyword: float = 0.30
    metadata: float = 0.05


@dataclass(frozen=True)
class SearchDefaults:
    mode: str = "hybrid"
    level: str = "chunk"
    limit: int = 10
    max_chunks_per_file: int = 3
    snippet_chars: int = 700
    weights: Weights = field(default_factory=Weights)


@dataclass(frozen=True)
class Indexing:
    chunking: str = "smart"
    target_tokens: int = 450
    max_tokens: int = 900
    overlap_tokens: int = 80
    min_chunk_chars: int = 80
    store_full_files: bool = True
    store_chunks: bool = True


@dataclass(frozen=True)
class Patterns:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = tuple(EXCLUDE)


@dataclass(frozen=True)
class Images:
    enabled: bool = False
    model: str = "ViT-H-14"
    dimensions: int = 1024
    batch_size: int = 16
    normalize: bool = True
    endpoint: str | None = None
    include: tuple[str, ...] = tuple(IMAGE_INCLUDE)
    exclude: tuple[str, ...] = tuple(EXCLUDE)


@dataclass(frozen=True)
class Reranker:
    enabled: bool = False
    model: str = "bge-reranker-v2-m3"
    endpoint: str | None = None
    candidate_limit: int = 50
    timeout_seconds: int = 30


@dataclass(frozen=True)
class Config:
    embedding: Embedding = field(default_factory=Embedding)
    search: SearchDefaults = field(default_factory=SearchDefaults)
    index: Indexing = field(default_factory=Indexing)
    text: Patterns = field(default_factory=lambda: Patterns(include=tuple(TEXT_INCLUDE)))
    image: Images = field(default_factory=Images)
    reranker: Reranker = field(default_factory=Reranker)


# Models that go by several names, and what their vectors are.
_NOMIC = ("nomic", "nomic-embed-text", "nomic-embed-text-v1.5", "nomic-embed-text-v2-moe")
_GEMMA = ("gemma", "google", "embeddinggemma-300m", "embeddinggemma:300m", "google/embeddinggemma-300m")
_SMALL, _LARGE = "text-embedding-3-small", "text-embedding-3-large"
_DIMENSIONS = {_SMALL: 1536, _LARGE: 3072}
CHOICES = {
    ("embedding", "provider"): ("native", "ollama", "openai", "openai-compatible", "http"),
    ("search", "mode"): ("keyword", "vector", "hybrid"),
    ("search", "level"): ("chunk", "file", "both"),
    ("index", "chunking"): ("smart", "line-window", "off"),
}
PRESETS = {
    "local": {"embedding": {"provider": "native"}}, "ollama": {"embedding": {"provider": "ollama", "endpoint": "http://localhost:11434/api/embed"}},
    "openai-small": {"embedding": {"provider": "openai", "model": _SMALL, "dimensions": 1536, "api_key_env": "OPENAI_API_KEY"}}, "openai-large": {"embedding": {"provider": "openai", "model": _LARGE, "dimensions": 3072, "api_key_env": "OPENAI_API_KEY"}},
    "keyword-only": {"search": {"mode": "keyword"}}, "images": {"image": {"enabled": True}}, "rerank": {"reranker": {"enabled": True}},
}


def model_name(model: str, provider: str = "native") -> str:
    """The canonical name of a model; anything unknown keeps its own."""
    if model in _NOMIC:
        return "nomic-embed-text-v1.5"
    if model in _GEMMA:
        return "google/embeddinggemma-300m" if provider == "native" else "embeddinggemma:300m"
    return model


def prefixes(model: str) -> tuple[str, str]:
    """(document prefix, query prefix)."""
    return ("title: none | text: ", "task: search result | query: ") if model in _GEMMA else ("search_document: ", "search_query: ")


def dimensions(model: str, otherwise: int) -> int:
    return 768 if model in (*_NOMIC, *_GEMMA) else _DIMENSIONS.get(model, otherwise)


def overlay(base, values: dict):
    """A section with ``values`` put over it, deeply; unknown keys are errors."""
    known = {f.name for f in fields(base)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    new = {}
    for k, v in values.items():
        old = getattr(base, k)
        new[k] = overlay(old, v) if is_dataclass(old) else tuple(v) if isinstance(v, list) else v
    return replace(base, **new)


def load(*paths: str, flags: dict | None = None) -> Config:
    """Defaults, then the files in order (missing ones are skipped), then flags; validated."""
    config = Config()
    for path in paths:
        try:
            with open(path, "rb") as f:
                config = overlay(config, tomllib.load(f))
        except FileNotFoundError:
            continue
    config = overlay(config, flags or {})
    validate(config)
    return config


def validate(c: Config) -> None:
    for (section, name), allowed in CHOICES.items():
        if (value := getattr(getattr(c, section), name)) not in allowed:
            raise ValueError(f"{section}.{name} must be one of {', '.join(allowed)}, not {value}")
    for section, name in (("embedding", "dimensions"), ("embedding", "batch_size"), ("search", "limit"), ("search", "snippet_chars"), ("index", "target_tokens"), ("reranker", "candidate_limit"), ("image", "dimensions"), ("image", "batch_size")):
        if getattr(getattr(c, section), name) <= 0:
            raise ValueError(f"{section}.{name} must be above 0")
    w = c.search.weights
    if min(w.vector, w.keyword, w.metadata) < 0 or w.vector + w.keyword + w.metadata <= 0:
        raise ValueError("search.weights must not be negative, and not all 0")
    if c.index.max_tokens < c.index.target_tokens:
        raise ValueError("index.max_tokens must not be below index.target_tokens")
    if c.index.overlap_tokens >= c.index.target_tokens:
        raise ValueError("index.overlap_tokens must be below index.target_tokens")
    if c.embedding.provider in ("ollama", "openai-compatible", "http") and not (c.embedding.endpoint or "").startswith(("http://", "https://")):
        raise ValueError("embedding.endpoint must be an http or https address")
    if c.reranker.enabled and not (c.reranker.endpoint or "").startswith(("http://", "https://")):
        raise ValueError("reranker.endpoint must be an http or https address")


def dumped(c: Config) -> str:
    """The configuration as TOML."""
    out: list[str] = []

    def write(section, name: str) -> None:
        plain = [f.name for f in fields(section) if not is_dataclass(getattr(section, f.name))]
        if name and plain:
            out.append(f"[{name}]")
        for k in plain:
            v = getattr(section, k)
            if v is not None:
                out.append(f"{k} = {_toml(v)}")
        out.append("")
        for f in fields(section):
            if is_dataclass(v := getattr(section, f.name)):
                write(v, f"{name}.{f.name}" if name else f.name)

    write(c, "")
    return "\n".join(out).strip() + "\n"


def _toml(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, tuple):
        return "[" + ", ".join(_toml(x) for x in v) + "]"
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return str(v)
