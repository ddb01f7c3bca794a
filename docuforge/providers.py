"""Embedding and reranking providers.

Offline, ``HashingProvider`` stands in for a model: deterministic vectors of hashed words.
HTTP providers speak the public request shapes of Ollama and OpenAI.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import urllib.error
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType

NORMALIZER, CHUNKER, SERIALIZATION = "normalizer-v1", "chunker-v2", "f32-le-v1"


@dataclass(frozen=True)
class Profile:
    """The identity of a vector space: provider, engine and endpoint are no part of it."""

    model: str
    dimensions: int
    document_prefix: str = "search_document: "
    query_prefix: str = "search_query: "
    fallback: tuple[str, str | None, str | None] | None = None

    @property
    def hash(self) -> str:
        fields = {"model": self.model, "dimensions": str(self.dimensions), "document_prefix": self.document_prefix, "query_prefix": self.query_prefix, "normalizer_version": NORMALIZER, "chunker_version": CHUNKER, "serialization_version": SERIALIZATION}
        fields |= dict(zip(("fallback.provider", "fallback.endpoint", "fallback.api_key_env"), self.fallback)) if self.fallback else {}
        return hashlib.sha256(json.dumps(fields, sort_keys=True).encode()).hexdigest()


class Provider(ABC):
    profile: Profile

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def documents(self, texts: list[str]) -> list[list[float]]:
        return self._checked(texts, self.profile.document_prefix)

    def query(self, text: str) -> list[float]:
        return self._checked([text], self.profile.query_prefix)[0]

    def _checked(self, texts: list[str], prefix: str) -> list[list[float]]:
        vectors = self.embed([prefix + t for t in texts])
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        for v in vectors:
            if len(v) != self.profile.dimensions:
                raise DimensionError(f"a vector of {len(v)} dimensions, not {self.profile.dimensions}")
        return vectors


class DimensionError(ValueError):
    """Never answered by a fallback: it would mix vector spaces."""


class HashingProvider(Provider):
    """Unit vectors of signed word hashes: equal words, near vectors.  No model, but the same mechanics."""

    def __init__(self, dimensions: int = 64, model: str = "hashed-words"):
        self.profile = Profile(model, dimensions)

    def _content(self, text: str) -> str:
        """The text without the profile's prefix, which is no content."""
        for prefix in (self.profile.document_prefix, self.profile.query_prefix):
            if prefix and text.startswith(prefix):
                return text[len(prefix) :]
        return text

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.profile.dimensions
            for word in self._content(text).lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % len(v)] += 1.0 if h >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in v))
            out.append([x / size for x in v] if size else v)
        return out


def post(url: str, body: dict, key_env: str | None = None, timeout: float = 60):
    if not url.startswith(("http://", "https://")):
        raise ValueError(f"endpoint must be http or https: {url}")
    headers = {"Content-Type": "application/json"}
    if key_env:
        if not os.environ.get(key_env):
            raise ValueError(f"environment variable {key_env} is not set")
        headers["Authorization"] = f"Bearer {os.environ[key_env]}"
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as r:
        return json.load(r)


def ollama_vectors(answer: dict) -> list[list[float]]:
    return answer["embeddings"] if "embeddings" in answer else [answer["embedding"]]


def openai_vectors(answer: dict, n: int) -> list[list[float]]:
    """Vectors in the order of their ``index``; each from 0 to n - 1 must be there once."""
    at = [d["index"] for d in answer["data"]]
    if sorted(at) != list(range(n)):
        raise ValueError(f"indexes {at} for {n} texts")
    return [d["embedding"] for d in sorted(answer["data"], key=lambda d: d["index"])]


@dataclass
class HttpProvider(Provider):
    profile: Profile
    url: str
    style: str = "openai"  # openai or ollama
    key_env: str | None = None
    timeout: float = 60

    def embed(self, texts: list[str]) -> list[list[float]]:
        answer = post(self.url, {"model": self.profile.model, "input": texts}, self.key_env, self.timeout)
        return ollama_vectors(answer) if self.style == "ollama" else openai_vectors(answer, len(texts))


@dataclass
class WithFallback(Provider):
    """The second provider answers when the first fails, but for wrong dimensions."""

    first: Provider
    second: Provider
    profile: Profile = field(init=False)

    def __post_init__(self):
        self.profile = self.first.profile

    def embed(self, texts: list[str]) -> list[list[float]]:
        try:
            return self.first.embed(texts)
        except DimensionError:
            raise
        except (OSError, ValueError):
            return self.second.embed(texts)


def parse_rerank(answer) -> list[tuple[int, float]]:
    """(index, score) of ``[{index, score}]`` or ``{results: [{index, relevance_score}]}``."""
    rows = answer["results"] if isinstance(answer, dict) else answer
    return [(int(r["index"]), float(r["score"] if "score" in r else r["relevance_score"])) for r in rows]


def http_reranker(url: str, model: str, timeout: float = 30, key_env: str | None = None):
    """A reranker that asks with ``texts`` and, where that is not understood, with ``documents``."""

    def rerank(query: str, texts: list[str]) -> list[tuple[int, float]]:
        body = {"query": query, "model": model, "raw_scores": False, "return_text": True, "truncate": True, "truncation_direction": "right"}
        try:
            return parse_rerank(post(url, body | {"texts": texts}, key_env, timeout))
        except urllib.error.HTTPError as e:
            if e.code != 422 or "texts" not in e.read().decode("utf-8", "replace"):
                raise
            return parse_rerank(post(url, {"query": query, "model": model, "documents": texts, "top_n": len(texts)}, key_env, timeout))

    return rerank


def embed_frame(rows: DataFrame, provider: Provider, text_col: str, keep: list[str], batch: int = 64, by_row: bool = False) -> DataFrame:
    """(keep..., vector, error): texts embedded in batches by executors.

    With ``by_row``, a failed batch is tried row by row and rows that fail get
    a null vector and the error; otherwise a failure stops the job.
    """
    n = len(keep)

    def answered(texts: list[str]):
        try:
            return [(v, None) for v in provider.documents(texts)]
        except (OSError, ValueError) as e:
            if not by_row:
                raise
            return [(None, str(e))] if len(texts) == 1 else [answered([t])[0] for t in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(n).to_pylist()]
            found = [x for i in range(0, len(texts), batch) for x in answered(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array([v for v, _ in found], pa.list_(pa.float32())), pa.array([e for _, e in found], pa.string())], names=[*keep, "vector", "error"])

    schema = rows.select(*keep).schema.add("vector", ArrayType(FloatType())).add("error", "string")
    return rows.select(*keep, text_col).mapInArrow(run, schema)


class QueryCache:
    """Query vectors by normalised query; the vector is that of the raw text."""

    def __init__(self, provider: Provider):
        self.provider, self.known = provider, {}

    def vector(self, query: str, cached_only: bool = False) -> list[float]:
        from docuforge.functions.text import normalize

        key = (self.provider.profile.hash, normalize(query))
        if key not in self.known:
            if cached_only:
                raise KeyError(f"no cached vector for {query!r}")
            self.known[key] = self.provider.query(query)
        return self.known[key]


@dataclass
class ImageProvider:
    """An image embedder: base64 images or a text query in, vectors of a fixed length out."""

    url: str
    dimensions: int
    normalize: bool = True
    timeout: float = 60

    def images(self, encoded: list[str]) -> list[list[float]]:
        return self._checked(post(self.url, {"images": encoded, "normalize": self.normalize}, timeout=self.timeout), len(encoded))

    def query(self, text: str) -> list[float]:
        return self._checked(post(self.url, {"query": text, "normalize": self.normalize}, timeout=self.timeout), 1)[0]

    def _checked(self, answer: dict, n: int) -> list[list[float]]:
        vectors = ollama_vectors(answer)
        if len(vectors) != n or any(len(v) != self.dimensions for v in vectors):
            raise DimensionError(f"{len(vectors)} vectors for {n} images, or not of {self.dimensions} dimensions")
        return vectors


def embed_images(images: DataFrame, provider: ImageProvider, keep: list[str], batch: int = 16) -> DataFrame:
    """(keep..., vector, error) of (content binary): batches, and one by one where a batch fails; bad images get an error."""
    from pyspark.sql import functions as F

    class Encoded(Provider):
        profile = Profile("image", provider.dimensions, "", "")

        def embed(self, texts: list[str]) -> list[list[float]]:
            return provider.images(texts)

    return embed_frame(images.withColumn("_b64", F.base64("content")), Encoded(), "_b64", keep, batch, by_row=True)
