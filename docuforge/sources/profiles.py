"""Small keyed tables of an index: vector-space profiles, cached query vectors, installed models.

They hold one row a profile, query or model, and are merged as tables, never collected whole.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from docuforge.functions.text import normalize
from docuforge.operators.changes import latest
from docuforge.providers import CHUNKER, NORMALIZER, SERIALIZATION, Profile, Provider
from docuforge.sources.store import Store

PROFILES = "profile_hash string, provider string, engine string, model string, variant string, endpoint string, dimensions int, document_prefix string, query_prefix string, normalizer_version string, chunker_version string, serialization_version string, created_at string"
QUERIES = "profile_hash string, normalized_query string, vector array<float>, created_at string, last_used_at string"
MODELS = "provider string, engine string, model string, variant string, dimensions int, cache_path string, installed_at string, last_used_at string, status string"


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def upsert_profile(store: Store, profile: Profile, provider: str, engine: str | None = None, variant: str | None = None, endpoint: str | None = None) -> str:
    """The hash the index keeps this vector space under: its own, else that of the newest profile with the same identity, else it is added.

    Provider, engine, variant and endpoint are no part of the identity; they are brought up to date.
    """
    table, at = store.read("profiles", PROFILES), now()
    same = (
        (F.col("model") == profile.model) & (F.col("dimensions") == profile.dimensions) & (F.col("document_prefix") == profile.document_prefix) & (F.col("query_prefix") == profile.query_prefix)
        & (F.col("normalizer_version") == NORMALIZER) & (F.col("chunker_version") == CHUNKER) & (F.col("serialization_version") == SERIALIZATION)
    )
    exact = F.col("profile_hash") == profile.hash
    known = table.where(exact | same).orderBy((~exact).cast("int"), F.col("created_at").desc(), "profile_hash").first()
    key = known.profile_hash if known else profile.hash
    row = (key, provider, engine, profile.model, variant, endpoint, profile.dimensions, profile.document_prefix, profile.query_prefix, NORMALIZER, CHUNKER, SERIALIZATION, at)
    store.write({"profiles": latest(table, store.spark.createDataFrame([row], PROFILES), ["profile_hash"])})
    return key


class StoredQueryCache:
    """Query vectors in the index, by profile and normalised query; the vector is that of the raw text."""

    def __init__(self, store: Store, provider: Provider):
        self.store, self.provider = store, provider

    def vector(self, query: str, cached_only: bool = False) -> list[float]:
        table = self.store.read("query_embeddings", QUERIES)
        key, text, at = self.provider.profile.hash, normalize(query), now()
        found = table.where((F.col("profile_hash") == key) & (F.col("normalized_query") == text)).first()
        if found is None and cached_only:
            raise KeyError(f"no cached vector for {query!r}")
        vector = list(found.vector) if found else self.provider.query(query)
        if len(vector) != self.provider.profile.dimensions:
            raise ValueError(f"a cached vector of {len(vector)} dimensions, not {self.provider.profile.dimensions}")
        row = self.store.spark.createDataFrame([(key, text, vector, found.created_at if found else at, at)], QUERIES)
        self.store.write({"query_embeddings": latest(table, row, ["profile_hash", "normalized_query"])})
        return vector


def mark_model(store: Store, provider: str, engine: str | None, model: str, variant: str | None, dimensions: int, cache_path: str, status: str = "installed") -> None:
    """Record a model as installed; a null engine or variant is a value of its own."""
    table, at = store.read("model_cache", MODELS), now()
    same = F.lit(True)
    for name, value in (("provider", provider), ("engine", engine), ("model", model), ("variant", variant)):
        same = same & F.col(name).eqNullSafe(F.lit(value))
    row = store.spark.createDataFrame([(provider, engine, model, variant, dimensions, cache_path, at, at, status)], MODELS)
    store.write({"model_cache": table.where(~same).unionByName(row)})


def is_installed(store: Store, provider: str, model: str) -> bool:
    return not store.read("model_cache", MODELS).where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("status") == "installed")).isEmpty()
